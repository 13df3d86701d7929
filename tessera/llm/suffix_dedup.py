"""Operator 1: removal of long byte strings that occur twice, by a run-length index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Answers, answer, ask, block_chunks, blocked, layout, squeeze, unsqueeze, with_answers
from .common import documents, load, mix, pa_schema, partitions, to_batch

LENGTH = 200
#: Bytes of an anchor; DEPTH rows of the anchors' sketch; window starts worked on at once; bytes in one index.
ANCHOR, DEPTH, STEP, INDEX_BYTES = 32, 1, 1 << 18, 2 << 20
#: Rows after which marks are sent on.
MARKS = 100_000
#: From this count on (the sketch's highest) an anchor's strings are not gathered in one task, however many there are: their windows
#: are grouped by digest over all segments instead.
HOT = 255
_POSITION = np.uint64((1 << 28) - 1)
_PIECES = "anchor long, block int, n int, spots binary, content binary"
_MARKS = "block int, n int, marks binary"
_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# --- the run-length index


@dataclass(frozen=True)
class RunIndex:
    """A run-compressed Burrows-Wheeler transform of a text: a symbol and a length per run, and at each run's ends the
    text position with its common prefix with the suffix beyond that end. Its size follows the runs, not the text."""

    symbols: np.ndarray
    lengths: np.ndarray
    head_at: np.ndarray
    tail_at: np.ndarray
    shared: np.ndarray  # shared[j]: common prefix of tail j - 1 and head j
    size: int


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each round sorts only suffixes that are still tied."""
    n = len(text)
    pad = np.zeros(n + 8, np.uint64)
    pad[:n] = text
    two = pad[:-1] << np.uint64(9) | pad[1:]
    four = two[:-2] << np.uint64(18) | two[2:]
    three = two[:-1] << np.uint64(9) | pad[2:]
    key = four[:n] << np.uint64(27) | three[4 : n + 4]
    sa = np.argsort(key)
    key = key[sa]
    new = np.r_[True, key[1:] != key[:-1]]
    rank = np.full(n + 1, -1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    active = np.flatnonzero(~new | ~np.r_[new[1:], True])
    h = 7
    while len(active):
        s = sa[active]
        k = rank[s] << 32 | rank[np.minimum(s + h, n)] + 1
        o = np.argsort(k)
        s, k = s[o], k[o]
        sa[active] = s
        new = np.r_[True, k[1:] != k[:-1]]
        rank[s] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        active = active[~new | ~np.r_[new[1:], True]]
        h *= 2
    return sa


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b."""
    n = len(text)
    x = np.zeros(n + 8, np.uint64)
    x[:n] = text
    x = x[:-1] | x[1:] << np.uint64(16)
    words = np.append(x[:-2] | x[2:] << np.uint64(32), [np.uint64(0)] * 8)  # four symbols of 16 bits
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        p, q = a[live] + out[live], b[live] + out[live]
        end = np.maximum(p, q) >= n
        same = words[np.minimum(p, n)] ^ words[np.minimum(q, n)]
        whole = (same == 0) & ~end
        part = live[~whole]
        d = same[~whole]
        low = d & (~d + np.uint64(1))
        more = np.where(d == 0, 0, np.where(low < 1 << 16, 0, np.where(low < 1 << 32, 1, np.where(low < 1 << 48, 2, 3))))
        out[part] += np.minimum(more, np.maximum(0, n - np.maximum(p, q)[~whole]))
        live = live[whole]
        out[live] += 4
    return out


def run_index(text: np.ndarray) -> RunIndex:
    sa = suffix_order(text)
    bwt = np.where(sa > 0, text[sa - 1].astype(np.int32), 1 << 16)
    heads = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
    tails = np.r_[heads[1:] - 1, len(sa) - 1]
    shared = np.zeros(len(heads), np.int64)
    shared[1:] = common_prefix(text, sa[heads[1:] - 1], sa[heads[1:]])
    return RunIndex(bwt[heads], np.diff(np.r_[heads, len(sa)]), sa[heads], sa[tails], shared, len(sa))


def matching_statistics(index: RunIndex) -> np.ndarray:
    """At each position the longest string that also starts elsewhere in the indexed text.

    Where the transform does not change, the neighbour of the suffix one byte on is the neighbour's suffix one byte
    on, so its match is shorter by one. Only run ends need a stored value; the text is then passed once.
    """
    out = np.zeros(index.size, np.int64)
    at = np.arange(index.size)
    for where, value in ((index.head_at, index.shared), (index.tail_at, np.r_[index.shared[1:], 0])):
        stored = np.full(index.size, -1, np.int64)
        stored[where] = value
        last = np.maximum.accumulate(np.where(stored >= 0, at, 0))
        out = np.maximum(out, stored[last] - (at - last))
    return out


def long_matches(strings: list[bytes], length: int) -> list[np.ndarray]:
    """Of each of several distinct strings, where a string of ``length`` starts that starts elsewhere in them too."""
    sizes = np.array([len(s) for s in strings], np.int64)
    start = np.r_[0, np.cumsum(sizes + 1)]
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + 1
    text[start[1:] - 1] = 0
    found = matching_statistics(run_index(text)) >= length
    inside = np.zeros(len(text), bool)  # a match that runs over the string's end is none
    hits = np.flatnonzero(found)
    inside[hits] = hits + length <= (start[1:] - 1)[np.searchsorted(start, hits, side="right") - 1]
    return [np.flatnonzero(inside[a:b]) for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


# --- which strings must meet


def anchored(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts (first, last) with the same anchor, and the anchor's hash.

    A window's anchor is its ANCHOR-byte string of the smallest hash, the leftmost of equals: equal windows have
    equal anchors, wherever they lie.
    """
    n, span = len(data), length - ANCHOR + 1
    firsts, lasts, hashes = [], [], []
    ok = np.zeros(n, bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        ok[a : max(a, b - length + 1)] = True
    for a in range(0, n - length + 1, STEP):
        part = data[a : min(n, a + STEP + length - 1)].astype(np.uint64)
        x = part[:-1] | part[1:] << np.uint64(8)
        x = x[:-2] | x[2:] << np.uint64(16)
        x = x[:-4] | x[4:] << np.uint64(32)
        m = len(part) - ANCHOR + 1
        h = x[:m] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(8, ANCHOR, 8):
            h ^= h >> np.uint64(31)
            h = (h + x[k : k + m]) * np.uint64(0xBF58476D1CE4E5B9)
        h = mix(h)
        low = h & ~_POSITION | np.arange(m, dtype=np.uint64)
        step = 1
        while step * 2 <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if span > step:
            low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
        starts = np.flatnonzero(ok[a : a + len(low)])
        if not len(starts):
            continue
        at = (low[starts] & _POSITION).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (np.diff(at) != 0)])
        firsts.append(starts[new] + a)
        lasts.append(starts[np.r_[new[1:] - 1, len(starts) - 1]] + a)
        hashes.append(h[at[new]])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(hashes)


_SPOT = np.dtype([("doc", "<i8"), ("start", "<i8")])


def suspects(b: DataFrame, sketch: DataFrame, at, length: int) -> DataFrame:
    """The strings around anchors that the sketch holds for repeated; equal ones of a block are one row with all their places."""
    schema = pa_schema(_PIECES)
    hot_bits = max(at.segment_bits, (2 * partitions(b.sparkSession) - 1).bit_length())  # digests are dealt at least as finely as anchors

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in schema}
        if not table.num_rows:
            return pa.table(out, schema=schema)
        known = Answers(answers, at)
        block = table.column("block")[0].as_py()
        chunks = [(ids, data, bounds, *anchored(data, bounds, length)) for ids, data, bounds in block_chunks(table)]
        counts = known.counts(np.concatenate([c[5] for c in chunks]))
        seen: dict[tuple[int, bytes], list] = {}
        windows: list[np.ndarray] = []
        base = 0
        for ids, data, bounds, first, last, h in chunks:
            own = np.array([known.classes[i][0] == i for i in ids.tolist()], bool)
            doc = np.searchsorted(bounds, first, side="right") - 1
            estimate = counts[base : base + len(h)]
            hot = np.flatnonzero((estimate >= HOT) & own[doc]) if len(h) else np.zeros(0, np.int64)
            if len(hot):
                windows.append(_digests(ids, data, bounds, first[hot], last[hot], doc[hot], length))
            maybe = np.flatnonzero((estimate >= 2) & (estimate < HOT))
            base += len(h)
            doc = doc[maybe]
            raw = data.tobytes()
            for k, d in zip(maybe[own[doc]].tolist(), doc[own[doc]].tolist(), strict=True):
                a = int(first[k])
                seen.setdefault((int(h[k].view(np.int64)), raw[a : int(last[k]) + length]), []).append((int(ids[d]), a - int(bounds[d])))
        for (anchor, content), spots in seen.items():
            for name, v in zip(out, (anchor, block, len(spots), np.array(spots, _SPOT).tobytes(), content), strict=True):
                out[name].append(v)
        for row in _by_segment(windows, hot_bits):
            for name, v in zip(out, (row[0], block, *row[1:]), strict=True):
                out[name].append(v)
        return pa.table(out, schema=schema)

    return with_answers(b, sketch, run, _PIECES)


def _digests(ids: np.ndarray, data: np.ndarray, bounds: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Of the windows that start from first to last: both halves of an XXH3 digest, document and place, a row each."""
    n = last - first + 1
    at = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    doc = np.repeat(doc, n)
    raw = memoryview(np.ascontiguousarray(data))
    h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a : a + length]) for a in at.tolist()]), "<i8").reshape(-1, 2)
    return np.stack([h[:, 0], h[:, 1], ids[doc], at - bounds[doc]])


def _by_segment(windows: list[np.ndarray], bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Rows (key, minus the number of distinct windows, places, digests) of a block's windows, one a segment."""
    if not windows:
        return
    h1, h2, doc, start = np.concatenate(windows, axis=1)
    order = np.lexsort((start, doc, h2, h1.view(np.uint64)))
    h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
    seg = (h1.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h1), np.int64)
    new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
    cut = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(seg)], strict=True):
        f = np.flatnonzero(new[a:b]) + a
        sizes = np.diff(np.r_[f, b])
        yield int(seg[a]), -len(f), squeeze(np.r_[doc[a:b], start[a:b]]), squeeze(np.r_[h1[f], h2[f], sizes])


def _settle_digests(rows: list[tuple[int, int, bytes, bytes]], length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of a segment's windows those that start twice, whoever holds them: (block, marks)."""
    parts = [unsqueeze(content, "<i8", 3 * n).reshape(3, n) for _, n, _, content in rows]
    h1, h2, sizes = np.concatenate(parts, axis=1)
    order = np.lexsort((h2, h1))
    a, c = h1[order], h2[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
    total = np.add.reduceat(sizes[order], first)
    twice = np.empty(len(h1), bool)
    twice[order] = np.repeat(total >= 2, np.diff(np.r_[first, len(h1)]))
    base = 0
    for block, n, spots, _ in rows:
        size = sizes[base : base + n]
        doc, start = unsqueeze(spots, "<i8", 2 * int(size.sum())).reshape(2, -1)
        hit = np.repeat(twice[base : base + n], size)
        base += n
        doc, start = doc[hit], start[hit]
        if len(doc):
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            cut = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(start) != 1)])
            end = np.r_[cut[1:] - 1, len(doc) - 1]
            yield block, np.stack([doc[cut], start[cut], start[end] + length])


def settle(pieces: DataFrame, length: int) -> DataFrame:
    """Index the strings of anchor after anchor, and tell each block which bytes are covered.

    Equal strings are one; only anchors with several different strings need the index.
    """
    schema = pa_schema(_MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[bytes, list[tuple[int, bytes]]] = {}  # the anchor's strings, with their places by block
        pending: dict[bytes, list[tuple[int, bytes]]] = {}  # strings that wait for an index
        many: set[bytes] = set()
        marks: dict[int, list[np.ndarray]] = {}
        hot: list[tuple[int, int, bytes, bytes]] = []
        size, marked, anchor = 0, 0, None

        def mark(held: list[tuple[int, bytes]], starts: np.ndarray, stops: np.ndarray) -> int:
            for block, spots in held:
                at = np.frombuffer(spots, _SPOT)
                marks.setdefault(block, []).append(
                    np.stack([np.repeat(at["doc"], len(starts)), (at["start"][:, None] + starts).reshape(-1), (at["start"][:, None] + stops).reshape(-1)])
                )
            return len(held)

        def whole(content: bytes, held: list[tuple[int, bytes]]) -> int:
            return mark(held, np.zeros(1, np.int64), np.array([len(content)]))

        def close_anchor() -> int:
            """Bytes that wait for the index. A string that is alone at its anchor matches no other, and itself only if it occurs twice."""
            if len(own) == 1:
                for content, held in own.items():
                    if content in many:
                        whole(content, held)
                        many.discard(content)
                own.clear()
                return 0
            pending.update(own)
            n = sum(map(len, own))
            own.clear()
            return n

        def close() -> Iterator[pa.RecordBatch]:
            if len(pending) > 1:
                names = list(pending)
                for s, hits in zip(names, long_matches(names, length), strict=True):
                    if s in many:
                        whole(s, pending[s])
                    elif len(hits):
                        cut = np.flatnonzero(np.diff(hits) > 1)
                        mark(pending[s], hits[np.r_[0, cut + 1]], hits[np.r_[cut, len(hits) - 1]] + length)
            for block, v in _settle_digests(hot, length) if hot else ():
                marks.setdefault(block, []).append(v)
            if marks:
                rows = {k: np.concatenate(v, axis=1) for k, v in marks.items()}
                yield to_batch({"block": list(rows), "n": [v.shape[1] for v in rows.values()], "marks": [squeeze(v.reshape(-1)) for v in rows.values()]}, schema)
            for held in (pending, many, marks, hot):
                held.clear()

        for batch in batches:
            for key, block, n, spots, content in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if key != anchor:
                    size += close_anchor()
                    if size >= INDEX_BYTES or marked >= MARKS or hot:
                        yield from close()
                        size = marked = 0
                anchor = key
                marked += 1
                if n < 0:
                    hot.append((block, -n, spots, content))
                    continue
                held = own.setdefault(content, [])
                held.append((block, spots))
                if n > 1 or len(held) > 1:
                    many.add(content)
        close_anchor()
        yield from close()

    n = partitions(pieces.sparkSession)
    return pieces.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, _MARKS)


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, emit: str = "digest") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (with ``emit`` "bytes", ``kept`` binary).

    A byte goes if a ``length``-byte string covers it that also starts anywhere else in the corpus; matches never
    cross documents. One index of the whole corpus would neither fit a machine nor be cut freely, so strings are first
    dealt by anchors (minimizers): equal windows have equal anchors and meet. A sketch of anchor counts leaves out
    those that occur once, which is most of a corpus. What is left goes, with its windows' bytes, to the anchor's
    task, which builds a run-length index of them, a run-compressed Burrows-Wheeler transform with sampled run
    ends, streams matching statistics over it and marks matches of ``length``. Of equal texts one stands for all;
    equal strings of a block travel once. Anchors that occur HOT times or more would gather a task too many strings:
    their windows are digested (128 bits) and grouped over all segments, which marks the same bytes.

    A null text is empty; texts below ``length`` bytes keep all. Repeated ids, null ids, empty tables: see ``common.documents``.
    """
    if length < ANCHOR + 8:
        raise ValueError(f"length must be {ANCHOR + 8} or more")
    d = documents(df, id_col, text_col)
    at = layout(d)
    b = blocked(d, at)
    sketch = answer(ask(b, at, lambda data, bounds: anchored(data, bounds, length)[2], DEPTH))
    marks = settle(suspects(b, sketch, at, length), length).withColumn("copies", F.lit(False))
    copies = sketch.where("family = 0").select("block", "n", F.col("answer").alias("marks"), F.lit(True).alias("copies"))
    ddl = _DIGEST if emit == "digest" else _DIGEST.replace("kept_sha256 string", "kept binary")
    schema = pa_schema(ddl)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in schema}
        if not table.num_rows:
            return pa.table(out, schema=schema)
        copied, found = set(), []
        for r in answers.to_pylist():
            got = unsqueeze(r["marks"], "<i8", 3 * r["n"]).reshape(3, -1)
            if r["copies"]:
                copied.update(got[0][got[2] > 1].tolist())
            else:
                found.append(got)
        doc, start, stop = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        order = np.argsort(doc, kind="stable")
        doc, start, stop = doc[order], start[order], stop[order]
        for ids, data, bounds in block_chunks(table):
            lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
            for k, i in enumerate(ids.tolist()):
                text = data[bounds[k] : bounds[k + 1]]
                n = len(text)
                if i in copied and n >= length:
                    kept, removed, spans = b"", n, 1
                elif lo[k] == hi[k]:
                    kept, removed, spans = text.tobytes(), 0, 0
                else:
                    depth = np.zeros(n + 1, np.int32)
                    np.add.at(depth, start[lo[k] : hi[k]], 1)
                    np.add.at(depth, stop[lo[k] : hi[k]], -1)
                    gone = np.cumsum(depth)[:n] > 0
                    kept, removed, spans = text[~gone].tobytes(), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                for name, v in zip(out, (i, n, removed, spans, hashlib.sha256(kept).hexdigest() if emit == "digest" else kept), strict=True):
                    out[name].append(v)
        return pa.table(out, schema=schema)

    return with_answers(b, marks.unionByName(copies), cut, ddl)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(load(spark, sf_dir))
