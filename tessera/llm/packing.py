"""Operator 9: bulk-synchronous best-fit packing of token sequences."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, documents, hold, load, materialize, pa_schema, ranked_rows, settle_rows, slices, to_batch

CONTEXT = 2048
VOCABULARY = "byte_bpe_50k"
#: The id after each document.
END = 0
#: Each value range of the sweeps is this many times as wide as the one below.
WIDER = 8
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of a byte-level BPE vocabulary, as the JSON file's encoder gives them by default: the strings of its special tokens
    become their ids, other text is split and merged. The rank file's encoder does the merging; it is four times faster."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self._encoding = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode(text, allowed_special="all")


def cut(n: int, context: int = CONTEXT) -> list[tuple[int, int]]:
    """Pieces (start, length) of n tokens: whole if they fit, else ``context`` long but for the first."""
    if n <= context:
        return [(0, n)]
    first = n % context
    return ([(0, first)] if first else []) + [(k, context) for k in range(first, n, context)]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the end id, cut where longer than ``context``. One narrow pass."""
    schema = pa_schema(_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in slices(batches):
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encoder.encode(text.as_py()), END], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), context)):
                    for name, v in zip(out, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        out[name].append(v)
            yield to_batch(out, schema)

    return documents(df, id_col, text_col).mapInArrow(run, _PIECES)


def sweep(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], context: int, opened: int | None = None) -> tuple[list[tuple], list[tuple], list[tuple], int | None]:
    """Best-fit of document runs (length, first rank, count) into gap runs (gap, first sequence, count).

    Documents of a length are interchangeable, and so are gaps of a size. Lengths go from long to short; each goes to its
    successor, the smallest gap that holds it. Rank resolves the conflict: the k-th document takes the k-th gap of the run,
    ranks beyond it go on to the next successor, and gaps are updated in bulk. Documents without a gap are left, or, where
    ``opened`` gives the next free sequence, open new ones. Placed rows: (length, first rank, count, first sequence, offset).
    """
    placed: list[tuple[int, int, int, int, int]] = []
    left: list[tuple[int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, count)
    sizes: list[int] = []

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                bisect.insort(sizes, gap)
            runs.setdefault(gap, []).append((first, n))

    for gap, first, n in sorted(gaps, reverse=True):
        put(gap, first, n)
    for length, rank, n_docs in sorted(docs, reverse=True):
        while n_docs:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                if opened is None:
                    left.append((length, rank, n_docs))
                    break
                per = context // length
                full, rest = divmod(n_docs, per)
                for k in range(per if full else 0):
                    placed.append((length, rank, full, opened, k * length))
                    rank += full
                for k in range(rest):
                    placed.append((length, rank, 1, opened + full, k * length))
                    rank += 1
                put(context - per * length, opened, full)
                put(context - rest * length, opened + full, 1 if rest else 0)
                opened += full + bool(rest)
                break
            gap = sizes[at]
            first, n = runs[gap].pop()
            if not runs[gap]:
                del runs[gap]
                sizes.pop(at)
            take = min(n, n_docs)
            put(gap, first + take, n - take)
            placed.append((length, rank, take, first, context - gap))
            put(gap - length, first, take)
            rank, n_docs = rank + take, n_docs - take
    return placed, left, [(gap, first, n) for gap, spots in runs.items() for first, n in spots], opened


#: Rows of the supersteps: documents (kind 0) and gaps (1) as runs, what a superstep has placed (2), and the next free sequence (3).
_STATE = "kind int, size long, first long, n long, seq long, at long, tried int"
#: Where documents go that no gap can hold: to open sequences, or to wait while longer ones are left.
OPEN, WAIT = 1000, -1


def ranges(context: int) -> list[int]:
    """Upper bounds of the value ranges but the last."""
    out = [WIDER]
    while out[-1] * WIDER < context:
        out.append(out[-1] * WIDER)
    return out


def _stepper(context: int, opened: int, bounds: list[int]):
    schema = pa_schema(_STATE)

    def step(key: tuple, table: pa.Table) -> pa.Table:
        here, rows = key[0].as_py(), table.to_pylist()
        out: dict[str, list] = {f.name: [] for f in schema}

        def give(kind: int, run: tuple[int, int, int], seq: int = 0, at: int = 0, tried: int = -1) -> None:
            for name, v in zip(out, (kind, *run, seq, at, tried), strict=True):
                out[name].append(v)

        runs = [[(r["size"], r["first"], r["n"]) for r in rows if r["kind"] == k] for k in (0, 1)]
        placed, left, gaps, last = sweep(*runs, context, opened if here == OPEN else None)
        for length, rank, n, seq, at in placed:
            give(2, (length, rank, n), seq, at)
        for run in left:
            give(0, run, tried=here)
        for run in gaps:
            give(1, run, tried=int(bisect.bisect_left(bounds, run[0]) != here))  # 1: new to its range
        if last is not None:
            give(3, (0, 0, 0), last)
        return pa.table(out, schema=schema)

    return step


def supersteps(lengths: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Bulk-synchronous best-fit of ``length, n``: placements ``length, rank, n, seq, offset``.

    Document runs and gap runs are sorted into value ranges. In a superstep every range sweeps its documents over its gaps
    (``sweep``), all ranges at once; gaps that have shrunk go down to their range, and documents that found none climb to the next
    range that has gaps, or back to one that got new gaps. Documents that no range can hold open new sequences if they are in the highest range
    that still has documents, and wait otherwise. Each superstep writes its state to the shared folder; the
    driver sees a row a pair of ranges. State and placements are runs, so their size depends on ``context``, not on the corpus.
    """
    bounds = ranges(context)
    zero = F.lit(0).cast("long")
    state = lengths.select(F.lit(0).alias("kind"), F.col("length").cast("long").alias("size"), zero.alias("first"), F.col("n").cast("long").alias("n"), zero.alias("seq"), zero.alias("at"), F.lit(-1).alias("tried"))
    home = sum(((F.col("size") > b).cast("int") for b in bounds), F.lit(0))
    done, opened = [], 0
    while True:
        state = materialize(state, "packing")
        done.append(state.where("kind = 2"))
        summary = state.where("kind <> 2").groupBy("kind", home.alias("r"), "tried").agg(F.max("seq").alias("seq")).collect()  # bounded by the pairs of ranges
        opened = max([opened] + [r["seq"] for r in summary if r["kind"] == 3])
        waiting = sorted({(r["r"], r["tried"]) for r in summary if r["kind"] == 0})
        if not waiting:
            break
        held = {r["r"] for r in summary if r["kind"] == 1}
        new = {r["r"] for r in summary if r["kind"] == 1 and r["tried"] == 1}
        busy: set[int] = set()
        place = [[WAIT] * (len(bounds) + 2) for _ in range(len(bounds) + 1)]  # of a range's documents, by the range they have tried last
        for r, tried in waiting:
            open_or_wait = OPEN if r == waiting[-1][0] else WAIT
            place[r][tried + 1] = min([g for g in new if r <= g <= tried] + [g for g in held if g >= r and g > tried], default=open_or_wait)
            busy.add(place[r][tried + 1])
        at = F.when(F.col("kind") == 1, home).otherwise(F.element_at(F.lit([x for row in place for x in row]), (home * (len(bounds) + 2) + F.col("tried") + 2).cast("int")))
        moving = state.where("kind < 2").withColumn("place", at.cast("int")).withColumn("busy", F.array_contains(F.lit(sorted(busy - {WAIT})), F.col("place")))
        swept = moving.where("busy").repartition(len(bounds) + 1, "place").groupBy("place").applyInArrow(_stepper(context, opened, bounds), _STATE)
        still = moving.where("not busy").withColumn("tried", F.when(F.col("kind") == 1, 0).otherwise(F.col("tried")))
        state = swept.unionByName(still.drop("place", "busy"))
    return reduce(DataFrame.unionByName, done).select(F.col("size").alias("length"), F.col("first").alias("rank"), "n", "seq", F.col("at").alias("offset"))


_PACKED = _PIECES + ", sequence_id long, offset long"


def pack(df: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Place pieces (``doc_id, piece, start, length, ids_crc32``, stored, since they are read twice) into sequences.

    Lengths are whole numbers up to ``context``, so the range sort of documents is a rank in a length class. A class is ranked in buckets
    (``common.ranked_rows``), whose counts give each its first rank, so a class with a third of all rows spreads over many tasks.
    ``supersteps`` places runs of ranks; its rows, bounded by ``context``, go to every task, which looks up (length, rank).
    """
    lengths, _ = settle_rows(df.groupBy("length").agg(F.count("*").alias("n")), "lengths")  # bounded by context
    each = ranked_rows(df.sparkSession, lengths.agg(F.sum("n")).first()[0] or 0)
    of = F.broadcast(lengths.select("length", F.ceil(F.col("n") / each).cast("long").alias("buckets")))
    spread = df.join(of, "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), "buckets"))
    counts = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    first, n = settle_rows(counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("first")), "buckets")
    rows = sorted(map(tuple, supersteps(lengths, context).collect()))
    keys = np.array([r[0] << 40 | r[1] for r in rows], dtype=np.int64)
    rank0, seq0, off = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 3, 4))
    schema = pa_schema(_PACKED)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            rank = cols.pop("rank").to_numpy()
            at = np.searchsorted(keys, cols["length"].to_numpy() << 40 | rank, side="right") - 1
            yield to_batch(cols | {"sequence_id": seq0[at] + rank - rank0[at], "offset": off[at]}, schema)

    ranked = spread.withColumn("no", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")))
    ranked = ranked.join(F.broadcast(first) if n <= BROADCAST_ROWS else first, ["length", "bucket"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("no") - 1).alias("rank")).mapInArrow(look_up, _PACKED)


def best_fit_packing(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pack every document into sequences of at most ``context`` tokens: one row per piece with its place.

    A null text is empty and still has its end id. Repeated ids, null ids: see ``common.documents``. Empty in, empty out.
    """
    return pack(hold(pieces(df, id_col, text_col, context, vocabulary)), context)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(load(spark, sf_dir))
