"""Operator 10: word-window deduplication behind a count-min prefilter."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .blocks import Answers, answer, ask, block_chunks, blocked, layout, squeeze, unsqueeze, with_answers
from .common import documents, gram_hashes, load, pa_schema, word_hashes, words

WINDOW = 13
DEPTH = 2
_EXACT = "segment int, block int, n int, keys binary, least binary, spots binary, n_spots int"
#: ``copies``: ``at`` holds documents that repeat a smaller one's text, sent round so that the answers are computed once.
_GONE = "block int, segment int, n int, at binary, copies boolean"
_WHOLE = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def window_hashes(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words in a chunk of texts, and the number of each window's document in the chunk."""
    starts, ends, per = words(data, bounds)
    grams = gram_hashes(word_hashes(data, starts, ends)[0], width)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(per))
    inside = doc[: len(grams)] == doc[width - 1 :] if len(grams) else np.zeros(0, bool)
    return grams[inside], doc[: len(grams)][inside]


def second_hash(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``window_hashes``, with a second, independent hash and each window's place among the chunk's words."""
    starts, ends, per = words(data, bounds)
    one, two = word_hashes(data, starts, ends)
    grams, other = gram_hashes(one, width), gram_hashes(two, width, seed=77)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(per))
    inside = np.flatnonzero(doc[: len(grams)] == doc[width - 1 :]) if len(grams) else np.zeros(0, np.int64)
    return grams[inside], other[inside], doc[inside], inside


def repeated_windows(b: DataFrame, at, width: int, depth: int) -> DataFrame:
    """Word positions, by block, where a window begins whose words also begin one in a smaller document."""
    sketch = answer(ask(b, at, lambda data, bounds: window_hashes(data, bounds, width)[0], depth))
    schema = pa_schema(_EXACT)

    def suspects(table: pa.Table, answers: pa.Table) -> pa.Table:
        """The block's windows that the sketch holds for repeated, each distinct one with its smallest document here."""
        out: dict[str, list] = {f.name: [] for f in schema}
        if not table.num_rows:
            return pa.table(out, schema=schema)
        known = Answers(answers, at)
        block = table.column("block")[0].as_py()
        later = np.array([doc for doc, (least, _) in known.classes.items() if doc != least], np.int64)
        if len(later):
            for name, v in zip(out, (block & ((1 << at.segment_bits) - 1), block, 0, b"", b"", squeeze(later), len(later)), strict=True):
                out[name].append(v)
        h1, h2, docs, places, stands, first_word = [], [], [], [], [], 0
        for ids, data, bounds in block_chunks(table):
            a, c, doc, place = second_hash(data, bounds, width)
            # of equal texts the smallest document stands for all
            own = np.array([known.classes[i][0] == i for i in ids.tolist()], bool)
            h1.append(a)
            h2.append(c)
            docs.append(ids[doc])
            places.append(place + first_word)
            stands.append(own[doc])
            first_word += len(words(data, bounds)[0])
        h1, h2, docs, places = (np.concatenate(x) for x in (h1, h2, docs, places))
        maybe = np.flatnonzero((known.counts(h1) >= 2) & np.concatenate(stands))
        h1, h2, docs, places = h1[maybe], h2[maybe], docs[maybe], places[maybe]
        order = np.lexsort((docs, h2, h1))
        h1, h2, docs, places = h1[order], h2[order], docs[order], places[order]
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] if len(h1) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        seg = (h1 >> np.uint64(64 - at.segment_bits)).astype(np.int64) if at.segment_bits else np.zeros(len(h1), np.int64)
        cuts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(seg) else np.zeros(0, np.int64)
        ends = np.r_[cuts[1:], len(seg)][: len(cuts)]
        for x, y in zip(cuts.tolist(), ends.tolist(), strict=True):
            g0, g1 = group[x], group[y - 1] + 1
            f = first[g0:g1]
            later = docs[x:y] != docs[first[group[x:y]]]
            spots = (places[x:y] << 1) | later
            n = g1 - g0
            key = squeeze(np.diff(h1[f], prepend=np.uint64(0))) , squeeze(h2[f])
            blob = len(key[0]).to_bytes(4, "little") + key[0] + key[1]
            sizes = np.diff(np.r_[f, y]).astype(np.int32)
            packed = squeeze(np.r_[sizes, spots.astype(np.int32)])
            for name, v in zip(out, (int(seg[x]), block, int(n), blob, squeeze(docs[f]), packed, int(y - x)), strict=True):
                out[name].append(v)
        return pa.table(out, schema=schema)

    gone = pa_schema(_GONE)

    def settle(table: pa.Table) -> pa.Table:
        """Group a segment's windows exactly (128 bits); tell each block which of its places lose their words."""
        out: dict[str, list] = {f.name: [] for f in gone}
        rows = []
        for r in table.to_pylist():
            if r["n"]:
                rows.append(r)
            else:
                for name, v in zip(out, (r["block"], r["segment"], r["n_spots"], r["spots"], True), strict=True):
                    out[name].append(v)
        if not rows:
            return pa.table(out, schema=gone)
        h1, h2 = [], []
        for r in rows:
            k = int.from_bytes(r["keys"][:4], "little")
            h1.append(np.cumsum(unsqueeze(r["keys"][4 : 4 + k], "<u8", r["n"]), dtype=np.uint64))
            h2.append(unsqueeze(r["keys"][4 + k :], "<u8", r["n"]))
        docs = np.concatenate([unsqueeze(r["least"], "<i8", r["n"]) for r in rows])
        h1, h2 = np.concatenate(h1), np.concatenate(h2)
        order = np.lexsort((docs, h2, h1))
        a, c = h1[order], h2[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
        least = np.empty(len(docs), np.int64)
        least[order] = np.repeat(docs[order][first], np.diff(np.r_[first, len(docs)]))
        earlier = least < docs  # another block holds it in a smaller document than any here
        at_row = 0
        for r in rows:
            packed = unsqueeze(r["spots"], "<i4", r["n"] + r["n_spots"])
            sizes, spots = packed[: r["n"]], packed[r["n"] :]
            hit = spots[np.repeat(earlier[at_row : at_row + r["n"]], sizes) | (spots & 1).astype(bool)] >> 1
            at_row += r["n"]
            if len(hit):
                for name, v in zip(out, (r["block"], r["segment"], len(hit), squeeze(np.sort(hit).astype(np.int32)), False), strict=True):
                    out[name].append(v)
        return pa.table(out, schema=gone)

    exact = with_answers(b, sketch, suspects, _EXACT)
    return exact.groupBy("segment").applyInArrow(settle, _GONE)


def window_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, depth: int = DEPTH, emit: str = "digest") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed`` and ``kept_sha256`` (or, with ``emit`` "text", ``text``).

    A word goes if a window of ``width`` words covers it whose words also begin in a document with a smaller id.
    Pass 1: each block of documents adds its windows to a count-min sketch (``depth`` rows; the sketch's cells are
    dealt over segments, so it grows with the corpus and no task holds all of it). The merged sketch overestimates,
    so no repeated window is lost. Pass 2 groups exactly, by 128 bits of hash (two independent ones), only windows with an estimate of two or
    more; a block sends each distinct one once, so a passage that fills the corpus is not a hot key. Pass 3 cuts.
    Of equal texts only the smallest id takes part; the others lose all if they have ``width`` words.

    A null or empty text has no words. Repeated ids, null ids and empty tables: see ``common.documents``.
    """
    d = documents(df, id_col, text_col)
    at = layout(d)
    b = blocked(d, at)
    told = repeated_windows(b, at, width, depth)
    ddl = _WHOLE if emit == "digest" else _WHOLE.replace("kept_sha256", "text")
    schema = pa_schema(ddl)
    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in schema}
        if not table.num_rows:
            return pa.table(out, schema=schema)
        later, at_words = set(), []
        for r in answers.to_pylist():
            if r["copies"]:
                later.update(unsqueeze(r["at"], "<i8", r["n"]).tolist())
            else:
                at_words.append(unsqueeze(r["at"], "<i4", r["n"]))
        spots = np.sort(np.concatenate(at_words)) if at_words else np.zeros(0, np.int32)
        base = 0
        for ids, data, bounds in block_chunks(table):
            starts, ends, per = words(data, bounds)
            own = spots[np.searchsorted(spots, base) : np.searchsorted(spots, base + len(starts))] - base
            base += len(starts)
            cover = np.zeros(len(starts) + width + 1, np.int32)
            np.add.at(cover, own, 1)
            np.add.at(cover, own + width, -1)
            drop = np.cumsum(cover)[: len(starts)] > 0
            raw = data.tobytes()
            for k, doc in enumerate(ids.tolist()):
                x, y = int(per[k]), int(per[k + 1])
                lost = np.ones(y - x, bool) if doc in later and y - x >= width else drop[x:y]
                if lost.any():
                    keep = np.flatnonzero(~lost) + x
                    kept = b" ".join([raw[i:j] for i, j in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
                else:
                    kept = b" ".join([raw[i:j] for i, j in zip(starts[x:y].tolist(), ends[x:y].tolist(), strict=True)])
                value = hashlib.sha256(kept).hexdigest() if emit == "digest" else kept.decode()
                for name, v in zip(out, (doc, y - x, int(lost.sum()), value), strict=True):
                    out[name].append(v)
        return pa.table(out, schema=schema)

    return with_answers(b, told, cut, ddl)


def op10_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup(load(spark, sf_dir))


OP10_SQL = r"""
WITH docs AS (SELECT doc_id, max(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
win AS (SELECT doc_id, p, md5_number(array_to_string(w[p:p + 12], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM w)),
firsts AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS f FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM firsts WHERE f < doc_id),
every AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS t FROM every ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
