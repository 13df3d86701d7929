"""Operator 4: exact deduplication by content sort."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, load, pa_schema, partitions, to_batch

#: Code points of the text that lead the range key. Splitters are sampled keys, so they stay this short however long texts are.
PREFIX = 24
_SORTED = "doc_id long, text_sha256 string, at long, keep_id long, group_size long, edge boolean, last boolean"


def _runs(largest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stream a sorted partition: equal texts are neighbours; compare each with the one before in full."""
    schema = pa_schema(_SORTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in schema}
        ids: list[int | None] = []
        text, sha, mark, first_mark, at = None, "", None, None, -1
        pending: list[tuple] = []  # groups of the newest key: only once another key follows is it known not to end the partition

        def close(edge: bool) -> None:
            for group, digest, no in pending:
                real = [i for i in group if i is not None]
                keep = (max(real) if largest else min(real)) if real else None
                n = len(group)
                for name, col in zip(out, (group, [digest] * n, [no] * n, [keep] * n, [n] * n, [edge] * n, [False] * (n - 1) + [True]), strict=True):
                    out[name] += col
            pending.clear()

        for batch in batches:
            for doc, body, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = body.as_buffer().to_pybytes()
                if raw != text or key != mark:
                    if ids:
                        pending.append((ids, sha, at))
                    if key != mark:
                        first_mark = key if first_mark is None else first_mark
                        close(mark == first_mark)
                    text, sha, mark, ids, at = raw, hashlib.sha256(raw).hexdigest(), key, [], at + 1
                ids.append(doc)
            if len(out["doc_id"]) >= 10_000:
                yield to_batch(out, schema)
                out = {f.name: [] for f in schema}
        if ids:
            pending.append((ids, sha, at))
            close(True)
        if out["doc_id"]:
            yield to_batch(out, schema)

    return run


def content_sort_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalize: Callable[[F.Column], F.Column] | None = None, keep: str = "largest"
) -> DataFrame:
    """One row for each row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after ``normalize`` (none by default). Sampled splitters range-partition
    (prefix, 64-bit hash, id): the prefix puts the order near that of the bytes, the hash separates texts that
    share it, and the id lets one large group of equals spread over many partitions. Spark's external sort then
    places equals side by side, and a stream compares neighbours in full. A group that touches an end of its
    partition may go on in the next; those groups' partial results (two keys a partition at most, so their
    broadcast is bounded by the number of partitions) are merged by digest.

    A null text is empty. Rows that repeat an id are rows of their own: all of them count, and every row whose id
    is the one to keep is kept. A null id counts but is kept only if its whole group has none. Empty in, empty out.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = df.select(F.col(id_col).cast("long").alias("doc_id"), (normalize(text) if normalize else text).alias("text"))
    d = d.select("doc_id", "text", F.xxhash64("text").alias("h"), F.substring("text", 1, PREFIX).alias("p"))
    d = d.repartitionByRange(partitions(spark), "p", "h", "doc_id").sortWithinPartitions("p", "h", "text", "doc_id")
    rows = hold(d.select("doc_id", "text", "h").mapInArrow(_runs(keep == "largest"), _SORTED))
    best = F.max if keep == "largest" else F.min
    ends = rows.where("edge and last").groupBy("text_sha256").agg(best("keep_id").alias("k"), F.sum("group_size").alias("n"))
    return rows.join(F.broadcast(ends), "text_sha256", "left").select(
        "doc_id",
        (k := F.coalesce("k", "keep_id")).alias("keep_id"),
        F.coalesce("n", "group_size").alias("group_size"),
        F.coalesce(F.col("doc_id") == k, F.col("doc_id").isNull() & k.isNull()).alias("kept"),
        "text_sha256",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_dedup(load(spark, sf_dir))


OP4_SQL = """
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, doc_id IS NULL AND keep_id IS NULL) AS kept, text_sha256 FROM (
  SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW g AS (PARTITION BY coalesce(text, '')))
"""
