"""Operator 5: corpus-wide line deduplication; returns keep bitmaps, not texts."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hold, load, pa_schema, partitions, slices, to_batch

MIN_LENGTH = 10
_LINES = "h1 long, h2 long, doc_id long, pos int"
_MARKS = "doc_id long, lines binary, h1 long, h2 long, first long"
_BLANK = b" \t\n\x0b\x0c\r"


def _keyed(min_length: int):
    schema = pa_schema(_LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, docs, at = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, line in enumerate(text.as_buffer().to_pybytes().split(b"\n")):
                    key = line.strip(_BLANK)
                    if len(key) >= min_length and (len(key) >= 4 * min_length or len(key.decode()) >= min_length):
                        hashes.append(xxhash.xxh3_128_digest(key.lower()))
                        docs.append(doc)
                        at.append(k)
            h = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            yield to_batch({"h1": h[:, 0], "h2": h[:, 1], "doc_id": docs, "pos": at}, schema)

    return run


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines sorted by hash, document and position, the occurrences outside the first document of their hash.

    Rows with ``lines``: positions of one document; of the partition's first hash also with that hash, since the
    first document may lie in a partition before. Rows without: first document here of the first and last hash.
    """
    schema = pa_schema(_MARKS)
    head = last = None
    first = 0

    def packed(docs: np.ndarray, at: np.ndarray, key: tuple | None) -> pa.RecordBatch:
        order = np.lexsort((at, docs))
        docs, at = docs[order], at[order].astype("<i4")
        cut = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        n = len(cut)
        blobs = [x.tobytes() for x in np.split(at, cut[1:])]
        k1, k2 = key or (None, None)
        return to_batch({"doc_id": docs[cut], "lines": blobs, "h1": [k1] * n, "h2": [k2] * n, "first": [None] * n}, schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, docs, at = (batch.column(k).to_numpy() for k in range(4))
        new = np.r_[last != (h1[0], h2[0]), (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1  # -1: the run that goes on from the batch before
        firsts = docs[starts]
        own = np.where(run >= 0, firsts[np.maximum(run, 0)] if len(starts) else first, first)
        if head is None:
            head = (int(h1[0]), int(h2[0]))
            yield to_batch({"doc_id": [None], "lines": [None], "h1": [head[0]], "h2": [head[1]], "first": [int(docs[0])]}, schema)
        of_head = (h1 == head[0]) & (h2 == head[1])
        if of_head.any():
            yield packed(docs[of_head], at[of_head], head)
        drop = ~of_head & (docs != own)
        if drop.any():
            yield packed(docs[drop], at[drop], None)
        last, first = (int(h1[-1]), int(h2[-1])), int(own[-1])
    if last is not None and last != head:
        yield to_batch({"doc_id": [None], "lines": [None], "h1": [last[0]], "h2": [last[1]], "first": [first]}, schema)


def repeated_lines(d: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc_id, dropped`` (arrays of packed positions) of the documents that lose a line."""
    n = partitions(d.sparkSession)
    keys = ["h1", "h2", "doc_id", "pos"]
    lines = d.select("doc_id", "text").mapInArrow(_keyed(min_length), _LINES)
    marks = hold(lines.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(_stream, _MARKS))
    # two hashes a partition at most: bounded by the number of partitions
    carried = marks.where("lines is null").groupBy("h1", "h2").agg(F.min("first").alias("least"))
    decided = marks.where("lines is not null and h1 is null").select("doc_id", "lines")
    open_ = marks.where("lines is not null and h1 is not null").join(F.broadcast(carried), ["h1", "h2"]).where("doc_id <> least").select("doc_id", "lines")
    return decided.unionByName(open_).groupBy("doc_id").agg(F.collect_list("lines").alias("dropped"))


def _bitmap(n: int, dropped: list[bytes] | None) -> tuple[np.ndarray, bytes]:
    keep = np.ones(n, bool)
    for blob in dropped or ():
        keep[np.frombuffer(blob, "<i4")] = False
    return keep, zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def keep_from_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    """The keep flags of a document's lines, from ``keep_bitmap``."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines, bitorder="little").astype(bool)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, emit: str = "bitmap") -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, keep_bitmap``, and with ``emit`` "text" or "digest" ``text`` or ``kept_sha256``.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of ``min_length`` code points or
    more in two documents or more keep only the lines of the smallest id. Lines travel as 128-bit hashes,
    range-partitioned by (hash, document, position) so that a very common line spreads over many partitions; the
    sorted stream finds each hash's first document. Bitmaps (zlib, little-endian bits, 1: keep) carry the result,
    and texts are shuffled only where ``emit`` asks for them.

    A null or empty text is one empty line. Repeated ids, null ids and empty tables: see ``common.documents``.
    """
    d = documents(df, id_col, text_col)
    drops = repeated_lines(d, min_length)
    if emit == "bitmap":
        source = d.select("doc_id", (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n"))
    else:
        source = d
    joined = source.join(drops.hint("shuffle_hash"), "doc_id", "left")
    ddl = "doc_id long, n_lines long, n_dropped long, keep_bitmap binary" + {"bitmap": "", "digest": ", kept_sha256 string", "text": ", text string"}[emit]
    schema = pa_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, body, dropped in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                lines = None if emit == "bitmap" else body.as_buffer().to_pybytes().split(b"\n")
                n = body.as_py() if lines is None else len(lines)
                keep, packed = _bitmap(n, dropped)
                out["doc_id"].append(doc)
                out["n_lines"].append(n)
                out["n_dropped"].append(n - int(keep.sum()))
                out["keep_bitmap"].append(packed)
                if lines is not None:
                    kept = b"\n".join(x for x, k in zip(lines, keep.tolist(), strict=True) if k)
                    if emit == "digest":
                        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    else:
                        out["text"].append(kept.decode())
            yield to_batch(out, schema)

    return joined.mapInArrow(run, ddl)


def dropped_at(bitmap: F.Column, n_lines: F.Column) -> F.Column:
    """The places of the dropped lines, from 0, comma-joined."""

    @F.pandas_udf("string")
    def places(b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([",".join(map(str, np.flatnonzero(~keep_from_bitmap(x, k)).tolist())) for x, k in zip(b, n, strict=True)])

    return places(bitmap, n_lines)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup(load(spark, sf_dir), emit="digest")
    return d.select("doc_id", "n_lines", "n_dropped", "kept_sha256", dropped_at(F.col("keep_bitmap"), F.col("n_lines")).alias("dropped_at"))


OP5_SQL = r"""
WITH docs AS (SELECT doc_id, max(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT *, min(doc_id) OVER (PARTITION BY key) AS first FROM keyed),
kept AS (SELECT *, NOT (length(key) >= 10 AND first < doc_id) AS keep FROM firsts)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256,
  coalesce(string_agg((pos - 1)::VARCHAR, ',' ORDER BY pos) FILTER (NOT keep), '') AS dropped_at
FROM kept GROUP BY doc_id
"""
