"""Questions that blocks of documents put to segments of a hash space, and the answers.

Several operators must know, of every n-gram of every text, something about its occurrences elsewhere: how often
it occurs, or where first. A row per n-gram would cost many times the text. Here documents are dealt into *blocks*
of a few MB by a hash of their id. A block sends each *segment* (a range of the hash space) one packed row with the
keys it holds, sorted and distinct, so a key that fills the corpus costs one entry a block and no segment is hot.
The segment merges its blocks' keys and answers each block in the same order. The block's texts are shuffled once:
later passes reuse that exchange and recompute the keys, which is cheaper than carrying them.

Rows are blocks times segments. Up to ``EVEN_BYTES`` of text both numbers grow with the corpus; beyond, a block and a
segment each grow with the square root of the corpus, and so do their numbers, so that rows grow in proportion to the
corpus and a row never carries less than a few hundred keys. At 100 TB a block has 300 MB.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pa_schema, partitions, text_chunks

#: Bytes of text in a block, and keys of the corpus in a segment, about. A small corpus is dealt more finely, to give
#: every partition work, but not below the least: a block sends a row to each segment, so rows go with the product.
BLOCK_BYTES, LEAST_BYTES = 4 << 20, 256 << 10
SEGMENT_KEYS, LEAST_KEYS = 2 << 20, 256 << 10
#: Bytes of text from which blocks and segments grow.
EVEN_BYTES = 16 << 30
#: Bits of a sketch cell's number in a segment of SEGMENT_KEYS: one cell in 16 is taken. A larger segment has more.
CELL_BITS, MOST_CELL_BITS = 25, 32
#: Keys that a segment merges at once.
MERGE_KEYS = 4 << 20
_ASKED = "segment int, block int, family int, n int, keys binary, vals binary"
_ANSWERED = "block int, segment int, family int, n int, answer binary"


def squeeze(a: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return pa.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unsqueeze(raw: bytes, dtype: str, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(dtype)


@dataclass(frozen=True)
class Layout:
    blocks: int
    segment_bits: int
    cell_bits: int = CELL_BITS


def dealt(total: int, partitions: int) -> Layout:
    """Numbers of blocks and segments for ``total`` bytes of text."""
    keys, grown = total / 5, max(1.0, math.sqrt(total / EVEN_BYTES))
    blocks = max(total / (BLOCK_BYTES * grown), min(partitions, total / LEAST_BYTES, EVEN_BYTES / BLOCK_BYTES))
    segments = max(keys / (SEGMENT_KEYS * grown), min(partitions, keys / LEAST_KEYS, EVEN_BYTES / 5 / SEGMENT_KEYS), 1)
    return Layout(int(blocks) + 1, (math.ceil(segments) - 1).bit_length(), min(MOST_CELL_BITS, CELL_BITS + math.ceil(math.log2(grown))))


def layout(d: DataFrame) -> Layout:
    """``dealt`` for a corpus, from one pass that adds up its bytes."""
    return dealt(d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0, partitions(d.sparkSession))


def blocked(d: DataFrame, at: Layout) -> DataFrame:
    return d.select(F.pmod(F.xxhash64("doc_id"), F.lit(at.blocks)).cast("int").alias("block"), "doc_id", "text")


def block_chunks(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A block's documents in order of id, by ``common.text_chunks``: the same order in every pass."""
    table = table.select(["doc_id", "text"]).sort_by("doc_id").combine_chunks()
    for batch in table.to_batches():
        yield from text_chunks(batch.column(0), batch.column(1))


def sketch_cells(hashes: np.ndarray, at: Layout, depth: int) -> list[np.ndarray]:
    """Of each row of the sketch: the segment and cell of each hash, in one number."""
    shift = np.uint64(64 - at.segment_bits - at.cell_bits)
    return [(hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * row & 0xFFFFFFFFFFFFFFFF | 1)) >> shift for row in range(depth)]


def _split(numbers: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments present in sorted numbers, and the bounds of each one's."""
    seg = (numbers >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(numbers), np.int64)
    cut = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(seg) else np.zeros(0, np.int64)
    return seg[cut], np.r_[cut, len(seg)]


class Asked:
    """Rows of a block's questions."""

    def __init__(self, block: int, at: Layout) -> None:
        self.block, self.at, self.rows = block, at, {f.name: [] for f in pa_schema(_ASKED)}

    def _add(self, segment: int, family: int, n: int, keys: bytes, vals: bytes) -> None:
        for name, v in zip(self.rows, (segment, self.block, family, n, keys, vals), strict=True):
            self.rows[name].append(v)

    def sketch(self, hashes: np.ndarray, depth: int) -> None:
        """Family 1 and on: this block's part of a count-min sketch, cells with counts, a row of the sketch each."""
        for row, cells in enumerate(sketch_cells(hashes, self.at, depth)):
            cells = np.sort(cells)
            first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
            counts = np.minimum(np.diff(np.r_[first, len(cells)]), 255).astype(np.uint8)
            cells = cells[first]
            for s, a, b in _bounds(*_split(cells, self.at.cell_bits)):
                own = (cells[a:b] & np.uint64((1 << self.at.cell_bits) - 1)).astype(np.uint32)
                self._add(s, 1 + row, b - a, squeeze(np.diff(own, prepend=np.uint32(0))), squeeze(counts[a:b]))

    def digests(self, low: np.ndarray, high: np.ndarray, docs: np.ndarray) -> None:
        """Family 0: digests of whole texts, with the document."""
        order = np.argsort(low, kind="stable")
        low, high, docs = low[order], high[order], docs[order]
        for s, a, b in _bounds(*_split(low, 64 - self.at.segment_bits)):
            self._add(s, 0, b - a, squeeze(low[a:b]), squeeze(np.r_[high[a:b].view(np.int64), docs[a:b]]))

    def table(self) -> pa.Table:
        return pa.table(self.rows, schema=pa_schema(_ASKED))


def _bounds(segments: np.ndarray, cuts: np.ndarray) -> Iterable[tuple[int, int, int]]:
    return zip(segments.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def text_digests(ids: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = memoryview(np.ascontiguousarray(data))
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def ask(b: DataFrame, at: Layout, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], depth: int) -> DataFrame:
    """Pass 1: every block's digests and sketch. ``hashes(bytes, bounds)`` gives the n-gram hashes of a chunk of texts.

    A text that a block holds twice enters its sketch once.
    """

    def run(table: pa.Table) -> pa.Table:
        out = Asked(table.column("block")[0].as_py(), at)
        parts, lows, highs, docs, seen = [], [], [], [], set()
        for ids, data, bounds in block_chunks(table):
            low, high = text_digests(ids, data, bounds)
            lows.append(low)
            highs.append(high)
            docs.append(ids)
            new = np.array([not (k in seen or seen.add(k)) for k in zip(low.tolist(), high.tolist(), strict=True)], bool)
            if not new.all():
                keep = np.repeat(new, np.diff(bounds))
                data, bounds = data[keep], np.r_[0, np.cumsum(np.diff(bounds)[new])]
            parts.append(hashes(data, bounds))
        out.digests(np.concatenate(lows), np.concatenate(highs), np.concatenate(docs))
        out.sketch(np.concatenate(parts), depth)
        return out.table()

    return b.groupBy("block").applyInArrow(run, _ASKED)


def answer(asked: DataFrame) -> DataFrame:
    """A segment adds up its blocks' parts of the sketch and tells each block its cells' totals (255: that or more).

    Of a text's digest it tells the smallest document and how many there are.
    """
    schema = pa_schema(_ANSWERED)

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in schema}
        by: dict[int, list[dict]] = {}
        for r in table.to_pylist():
            by.setdefault(r["family"], []).append(r)
        for family, rows in by.items():
            sizes = [r["n"] for r in rows]
            cuts = np.cumsum(sizes)[:-1]
            if family:
                answers = [squeeze(x) for x in _totals([np.cumsum(unsqueeze(r["keys"], "<u4", r["n"]), dtype=np.uint32) for r in rows], [unsqueeze(r["vals"], "u1", r["n"]) for r in rows])]
            else:
                low = np.concatenate([unsqueeze(r["keys"], "<u8", r["n"]) for r in rows])
                rest = [unsqueeze(r["vals"], "<i8", 2 * r["n"]) for r in rows]
                high, docs = np.concatenate([x[: len(x) // 2] for x in rest]), np.concatenate([x[len(x) // 2 :] for x in rest])
                order = np.lexsort((docs, high, low))
                lo, hi = low[order], high[order]
                first = np.flatnonzero(np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
                n = np.diff(np.r_[first, len(lo)])
                least, many = np.empty(len(lo), np.int64), np.empty(len(lo), np.int64)
                least[order], many[order] = np.repeat(docs[order][first], n), np.repeat(n, n)
                answers = [squeeze(np.r_[x, y, z]) for x, y, z in zip(np.split(docs, cuts), np.split(least, cuts), np.split(many, cuts), strict=True)]
            for r, a in zip(rows, answers, strict=True):
                for name, v in zip(out, (r["block"], r["segment"], family, r["n"], a), strict=True):
                    out[name].append(v)
        return pa.table(out, schema=schema)

    return asked.groupBy("segment").applyInArrow(run, _ANSWERED)


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of equal cells over all parts (each sorted), for each part's cells. The key range is taken in steps, so that the workspace stays small."""
    out = [np.empty(len(k), np.uint8) for k in keys]
    steps = sum(map(len, keys)) // MERGE_KEYS + 1
    top = max((int(k[-1]) for k in keys if len(k)), default=0) + 1
    at = [0] * len(keys)
    for step in range(1, steps + 1):
        to = [int(np.searchsorted(k, top * step // steps)) for k in keys]
        own = np.concatenate([k[a:b] for k, a, b in zip(keys, at, to, strict=True)])
        if len(own):
            order = np.argsort(own)
            first = np.flatnonzero(np.r_[True, (s := own[order])[1:] != s[:-1]])
            total = np.add.reduceat(np.concatenate([c[a:b] for c, a, b in zip(counts, at, to, strict=True)])[order].astype(np.int64), first)
            result = np.empty(len(own), np.uint8)
            result[order] = np.repeat(np.minimum(total, 255).astype(np.uint8), np.diff(np.r_[first, len(own)]))
            for k, part in enumerate(np.split(result, np.cumsum([b - a for a, b in zip(at, to, strict=True)])[:-1])):
                out[k][at[k] : to[k]] = part
        at = to
    return out


class Answers:
    """A block's answers, laid against its own keys."""

    def __init__(self, table: pa.Table, at: Layout) -> None:
        self.at, self.cells, self.classes = at, {}, {}
        for r in sorted(table.to_pylist(), key=lambda r: (r["family"], r["segment"])):
            if r["family"]:
                self.cells.setdefault(r["family"] - 1, []).append(unsqueeze(r["answer"], "u1", r["n"]))
            else:
                docs, least, many = np.split(unsqueeze(r["answer"], "<i8", 3 * r["n"]), 3)
                self.classes.update(zip(docs.tolist(), zip(least.tolist(), many.tolist(), strict=True), strict=True))

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """The sketch's estimate for each hash of the block: never too low. ``hashes`` must be all that pass 1 had, in any order and number."""
        best = np.full(len(hashes), 255, np.uint8)
        for row, cells in enumerate(sketch_cells(hashes, self.at, len(self.cells))):
            kinds, back = np.unique(cells, return_inverse=True)
            best = np.minimum(best, np.concatenate(self.cells[row])[back] if len(kinds) else best)
        return best


def with_answers(b: DataFrame, answers: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return b.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(fn, schema)
