"""Operator 7: benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, gram_hashes, load, pa_schema, text_chunks, to_batch, word_hashes, words

#: Least words of a tile; share of an item's words that tiles must cover.
MIN_MATCH, COVERAGE = 5, 0.6
#: Bytes of benchmark text that go to every task at once; a larger benchmark is taken in several such blocks.
BLOCK_BYTES = 16 << 20
_FOUND = "doc_id long, item_id long, coverage double, tiles int"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: What separates words here: all ASCII but letters and digits, so that punctuation and layout don't hide a passage.
_APART = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
#: Words whose seeds are looked up at once.
STEP = 1 << 18
#: Karp-Rabin multiplier of the running hashes.
BASE = 0x9E3779B97F4A7C15


def token_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word, and the bounds of each text's words."""
    data = _FOLD[data]
    starts, ends, per = words(data, bounds, _APART)
    return *word_hashes(data, starts, ends), per


class Seeds:
    """The benchmark's shared-token seeds: hashes of each item's runs of ``least`` words (of an item with fewer words: all of them), distinct and sorted, with the items that hold each."""

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        raw = [(t or "").encode() for _, t in items]
        data = np.frombuffer(b"".join(raw), np.uint8)
        self.ids, self.least = [i for i, _ in items], least
        self.one, self.two, self.per = token_hashes(data, np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64))
        sizes = np.diff(self.per)
        item = np.repeat(np.arange(len(items)), sizes)
        self.by_length = {}
        for n in sorted({min(least, int(x)) for x in sizes if x}):
            grams = gram_hashes(self.one, n)
            whole = (item[: len(grams)] == item[n - 1 :]) & ((sizes[item[: len(grams)]] >= least) if n == least else (sizes[item[: len(grams)]] == n))
            at = np.flatnonzero(whole)
            pairs = np.unique(np.stack([grams[at], item[at].astype(np.uint64)], axis=1), axis=0)
            hashes, first = np.unique(pairs[:, 0], return_index=True)
            table = np.zeros(1 << 20, bool)
            table[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.by_length[n] = (hashes, np.r_[first, len(pairs)], pairs[:, 1].astype(np.int32), table)

    def pairs(self, one: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Rows (text, item) of texts and items that share a seed. Seeds that a text repeats count once."""
        out = [np.zeros((0, 2), np.int64)]
        for n, (hashes, first, item, table) in self.by_length.items():
            held = [np.zeros(0, np.int64)]
            for start in range(0, len(one), STEP):  # a very long text's seeds are looked up step by step
                grams = gram_hashes(one[start : start + STEP + n - 1], n)
                at = np.flatnonzero(table[(grams >> np.uint64(44)).astype(np.int64)])
                place = np.minimum(np.searchsorted(hashes, grams[at]), len(hashes) - 1)
                same = hashes[place] == grams[at]
                at, place = at[same] + start, place[same]
                doc = np.searchsorted(per, at, side="right") - 1
                inside = at + n <= per[doc + 1]
                held.append(np.unique(doc[inside] * len(hashes) + place[inside]))
            doc, place = np.divmod(np.unique(np.concatenate(held)), len(hashes))
            many = first[place + 1] - first[place]
            spot = np.repeat(first[place] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(place) else np.zeros(0, np.int64)
            out.append(np.stack([np.repeat(doc, many), item[spot]], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def numbered(self, item: int, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A text's and an item's words as numbers (those of the text that the item lacks: -1); both hashes must agree."""
        a, b = self.per[item], self.per[item + 1]
        kinds, first, numbers = np.unique(self.one[a:b], return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(kinds, one), len(kinds) - 1)
        same = (kinds[place] == one) & (self.two[a:b][first][place] == two)
        return np.where(same, place, -1).astype(np.int32), numbers.astype(np.int32)


class _Running:
    """Karp-Rabin hashes of all windows of a length, from prefix sums; which windows are free is told by prefix sums of marks."""

    def __init__(self, numbers: np.ndarray) -> None:
        n = len(numbers)
        powers = np.ones(n + 1, np.uint64)
        powers[1:] = BASE
        self.back = np.ones(n + 1, np.uint64)
        self.back[1:] = pow(BASE, -1, 1 << 64)
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.back, out=self.back)
        powers[1:] = powers[:-1]
        self.sums = numbers.astype(np.uint64)
        self.sums += np.uint64(1)
        self.sums *= np.uint64(0xBF58476D1CE4E5B9)
        self.sums ^= self.sums >> np.uint64(29)
        self.sums *= powers[1:]
        self.sums = np.r_[np.uint64(0), np.cumsum(self.sums)]
        self.free = numbers >= 0

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the free windows of n words."""
        taken = np.r_[0, np.cumsum(~self.free)]
        at = np.flatnonzero(taken[n:] == taken[:-n]) if n < len(taken) else np.zeros(0, np.int64)
        return at, (self.sums[at + n] - self.sums[at]) * self.back[at]


def tile(text: np.ndarray, item: np.ndarray, least: int) -> tuple[int, int]:
    """Greedy string tiling of numbered words: covered words of the item, and tiles.

    The longest match of unmarked words is marked, in text and item, again and again, down to ``least`` words; of equal ones the first
    in the item, then in the text. The longest length is found by bisection, since a match holds shorter ones; all its matches are
    marked in one pass over the hashes, each compared word by word first. Memory goes with the words, not with the matches.
    """
    own = text >= 0
    edge = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
    runs = edge.reshape(-1, 2)
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    if not len(runs):
        return 0, 0
    # only runs of the item's words can hold a match; one foreign word keeps them apart
    keep = np.zeros(len(text) + 1, bool)
    for a, b in runs.tolist():
        keep[a : b + 1] = True
    text = np.r_[text, np.int32(-1)][keep]
    t, p = _Running(text), _Running(item)
    covered = tiles = 0
    longest = min(len(item), int((runs[:, 1] - runs[:, 0]).max()))

    def shared(n: int) -> bool:
        return bool(np.isin(p.windows(n)[1], t.windows(n)[1]).any())

    while longest >= least and covered <= len(item) - least:
        low, high = least - 1, longest  # the longest shared length lies in [low, high]
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        n = low
        if n < least:
            break
        at, h = t.windows(n)
        places, hp = p.windows(n)
        hit = np.isin(h, hp)
        at, h = at[hit], h[hit]
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        begin, end = np.searchsorted(h, hp).tolist(), np.searchsorted(h, hp, side="right").tolist()
        next_at: dict[int, int] = {}
        for a, lo, hi in zip(places.tolist(), begin, end, strict=True):
            if lo == hi or not (p.free[a] and p.free[a + n - 1]):
                continue
            k = next_at.get(lo, lo)
            while k < hi and not (t.free[at[k]] and t.free[at[k] + n - 1]):
                k += 1
            next_at[lo] = k
            while k < hi:
                b = int(at[k])
                if t.free[b] and t.free[b + n - 1] and np.array_equal(text[b : b + n], item[a : a + n]):
                    p.free[a : a + n] = False
                    t.free[b : b + n] = False
                    covered, tiles = covered + n, tiles + 1
                    break
                k += 1
        longest = n - 1
    return covered, tiles


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark by blocks of bounded bytes, so that what goes to a task does not grow with it."""
    b = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    total = b.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    for k in range(n):
        yield [(r["i"], r["t"]) for r in b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").toLocalIterator()]


def find_leaks(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = MIN_MATCH, coverage: float = COVERAGE
) -> DataFrame:
    """One row per document: ``doc_id, contaminated, item_id, coverage, tiles`` (its best covered item; null where none shares a seed).

    Texts are words of letters and digits, case folded in ASCII. Documents and items are joined by shared seeds
    (runs of ``least`` words); each pair is tiled (``tile``): the longest match free of marked words is marked again and again,
    found by running Karp-Rabin hashes and compared. As tiles may lie in any order, a passage with its sentences moved about is
    caught. From a share of ``coverage`` of the item's words on, the document is contaminated; ties go to the
    smallest item, then to the fewest tiles. Texts are read in one narrow pass a benchmark block and not shuffled.

    An item of fewer than ``least`` words matches where all its words occur in a row; one without words never. Null texts are
    empty. Rows of the benchmark that repeat an id count as items of their own; rows without an id or text are none.
    Repeated and null ids: see ``common.documents``.
    """
    d = documents(df, id_col, text_col)
    schema = pa_schema(_FOUND)

    def against(told):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = told.value
            for batch in batches:
                out: dict[str, list] = {f.name: [] for f in schema}
                for ids, data, bounds in text_chunks(batch.column(0), batch.column(1)):
                    one, two, per = token_hashes(data, bounds)
                    best: dict[int, tuple] = {}
                    for doc, item in seeds.pairs(one, per).tolist():
                        text, own = seeds.numbered(item, one[per[doc] : per[doc + 1]], two[per[doc] : per[doc + 1]])
                        covered, tiles = tile(text, own, min(least, len(own)))
                        if tiles:
                            key = (-covered / len(own), seeds.ids[item], tiles)
                            best[doc] = min(best.get(doc, key), key)
                    for k, doc_id in enumerate(ids.tolist()):
                        share, item_id, tiles = best.get(k, (None, None, None))
                        for name, v in zip(out, (doc_id, item_id, None if share is None else -share, tiles), strict=True):
                            out[name].append(v)
                yield to_batch(out, schema)

        return run

    found = None
    for items in _blocks(benchmark, item_col, item_text_col):
        one = d.mapInArrow(against(df.sparkSession.sparkContext.broadcast(Seeds(items, least))), _FOUND)
        found = one if found is None else found.unionByName(one).groupBy("doc_id").agg(F.min(F.struct(F.coalesce(-F.col("coverage"), F.lit(1.0)), "item_id", "coverage", "tiles")).alias("b")).select("doc_id", "b.item_id", "b.coverage", "b.tiles")
    return found.select("doc_id", F.coalesce(F.col("coverage") >= coverage, F.lit(False)).alias("contaminated"), "item_id", "coverage", "tiles")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(load(spark, sf_dir), load(spark, sf_dir, "benchmark"))
