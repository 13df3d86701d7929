"""Operators 1, 4, 5, 6 and 10 against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import blocks, exact_dedup, jaccard_join, line_dedup, substring_dedup, suffix_dedup
from tessera.llm.common import gram_hashes, word_hashes
from tessera.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_doc(texts):
    """Documents as the operators see them."""
    out = {}
    for k, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (k, t)
        if i is not None:
            out[i] = max(out.get(i, ""), t or "", key=str.encode)
    return out


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def cut_bytes(texts, length):
    docs = {i: t.encode() for i, t in by_doc(texts).items()}
    seen = Counter(t[k : k + length] for t in docs.values() for k in range(len(t) - length + 1))
    out = {}
    for i, t in docs.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(t), int(gone.sum()), spans, sha(np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


def collected(df, *cols):
    rows = df.select("doc_id", *cols).collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_word_hashes():
    rng = np.random.default_rng(7)
    kinds = {bytes(rng.integers(97, 100, rng.integers(1, 20), dtype=np.uint8)) for _ in range(4000)} | {b"a\0", b"\0", b"\0\0", b"\0a"}
    kinds = sorted(kinds)
    data = np.frombuffer(b" ".join(kinds), np.uint8)
    ends = np.cumsum([len(k) + 1 for k in kinds]) - 1
    starts = ends - [len(k) for k in kinds]
    one, two = word_hashes(data, starts, ends)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(kinds) and not set(one.tolist()) & set(two.tolist())
    for k in (0, 17, len(kinds) - 1):  # the same wherever it lies
        alone = np.frombuffer(kinds[k], np.uint8)
        assert [int(h[0]) for h in word_hashes(alone, np.array([0]), np.array([len(alone)]))] == [int(one[k]), int(two[k])]
    grams = gram_hashes(one, 3)
    assert len(grams) == len(one) - 2 and len(set(grams.tolist())) == len(grams) and gram_hashes(one[:2], 3).tolist() == []


def test_rows_sent_go_with_the_corpus():
    """Blocks times segments, for corpora of 16 GB to 100 TB: in proportion, with hundreds of keys a row and blocks that a task can hold."""
    for total in (16 << 30, 10**12, 10**13, 10**14):
        at = blocks.dealt(total, total // 10**7)
        rows = at.blocks << at.segment_bits
        assert rows < total / 10**3 and total / 5 / rows > 200 and total / at.blocks < 400e6 and at.cell_bits <= 32
    small = blocks.dealt(10**8, 12)
    assert (small.blocks << small.segment_bits) < 2000 and blocks.dealt(0, 12).blocks == 1


def test_sketch_totals(monkeypatch):
    """Parts are added up the same whatever the steps."""
    rng = np.random.default_rng(5)
    keys = [np.unique(rng.integers(0, 500, n)).astype(np.uint32) for n in (0, 1, 200, 300)]
    counts = [rng.integers(1, 200, len(k)).astype(np.uint8) for k in keys]
    total = Counter()
    for k, c in zip(keys, counts, strict=True):
        total.update(dict(zip(k.tolist(), c.tolist(), strict=True)))
    for step in (1 << 20, 7):
        monkeypatch.setattr(blocks, "MERGE_KEYS", step)
        assert [x.tolist() for x in blocks._totals(keys, counts)] == [[min(255, total[k]) for k in own.tolist()] for own in keys]


@pytest.mark.parametrize("length", [40, 64, 200])
def test_suffix(corpus, frame, length):
    got = collected(suffix_dedup.suffix_dedup(frame(corpus), length=length), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == cut_bytes(corpus, length)


def test_suffix_odd(odd, frame):
    got = collected(suffix_dedup.suffix_dedup(frame([*odd, (9, "ab" * 300), (10, "ba" * 300 + "c")]), length=64), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == cut_bytes([*odd, (9, "ab" * 300), (10, "ba" * 300 + "c")], 64)
    assert suffix_dedup.suffix_dedup(frame([])).collect() == []
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.suffix_dedup(frame(["x" * 300, "y"]), emit="bytes").collect()}
    assert kept == {0: b"", 1: b"y"}
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(frame([]), length=10)


@pytest.mark.parametrize("hot", [2, 4])
def test_suffix_hot(corpus, frame, monkeypatch, thue_morse, hot):
    """Anchors that occur often are settled by digests, with the same result."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = corpus + [w for pair in thue_morse for w in pair] + ["q" + thue_morse[0][0][:900], thue_morse[0][1][3:700] + "q"]
    got = collected(suffix_dedup.suffix_dedup(frame(texts), length=64), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == cut_bytes(texts, 64)


def test_words_that_collide_elsewhere(frame, thue_morse):
    common = " w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"
    texts = [w for pair in thue_morse for w in pair] + [w + common for pair in thue_morse for w in pair]
    assert collected(jaccard_join.jaccard_join(frame(texts)), "n_shingles", "component_id") == linked(texts, 4, 85)
    assert collected(substring_dedup.window_dedup(frame(texts)), "n_words", "n_removed", "kept_sha256") == cut_windows(texts, 13)
    for length in (200, 64):
        assert collected(suffix_dedup.suffix_dedup(frame(texts), length=length), "n_bytes", "n_removed", "n_spans", "kept_sha256") == cut_bytes(texts, length)


def test_run_index():
    rng = np.random.default_rng(3)
    for text in (b"banana" * 20, bytes(rng.integers(97, 99, 500, dtype=np.uint8)), b"a" * 100, bytes(rng.integers(0, 256, 300, dtype=np.uint8)), b"x"):
        t = np.frombuffer(text, np.uint8).astype(np.uint16) + 1
        assert suffix_dedup.suffix_order(t).tolist() == sorted(range(len(text)), key=lambda k: text[k:])
        index = suffix_dedup.run_index(t)
        assert index.lengths.sum() == len(text)
        if text.startswith(b"banana"):
            assert len(index.symbols) < len(text) / 5
        common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        want = [max([common(text[i:], text[j:]) for j in range(len(text)) if j != i], default=0) for i in range(len(text))]
        assert suffix_dedup.matching_statistics(index).tolist() == want


@pytest.mark.parametrize("rows", [1, 40])
def test_content_sort(corpus, odd, frame, spark, rows):
    texts = [*corpus, *odd] * (3 if rows > 1 else 1) + [(1000 + k, "hot") for k in range(rows)]
    groups = defaultdict(list)
    pairs = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    for i, t in pairs:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, sha(t)] += 1
    got = exact_dedup.content_sort_dedup(frame(texts)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    low = exact_dedup.content_sort_dedup(frame(["A", "a", "b"]), normalize=lambda c: __import__("pyspark.sql.functions", fromlist=["x"]).lower(c), keep="smallest")
    assert {r.doc_id: r.kept for r in low.collect()} == {0: True, 1: False, 2: True}
    assert exact_dedup.content_sort_dedup(frame([])).collect() == []


def cut_lines(texts, least=10):
    docs, first = by_doc(texts), {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    for i in sorted(docs):
        for x in docs[i].split("\n"):
            first.setdefault(key(x), i)
    out = {}
    for i, t in docs.items():
        lines = t.split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def test_lines(corpus, odd, frame):
    texts = corpus + ["hot line of some length\nown %d" % k for k in range(50)]
    assert collected(line_dedup.line_dedup(frame(texts), emit="digest"), "n_lines", "n_dropped", "kept_sha256") == cut_lines(texts)
    more = [*odd, (7, "short\nÄÖÜäöüßéèê\nÄÖÜäöüßéèê"), (8, " ÄÖÜäöüßéèê\x0b"), (9, "a\nb")]
    assert collected(line_dedup.line_dedup(frame(more), emit="digest"), "n_lines", "n_dropped", "kept_sha256") == cut_lines(more)
    for r in line_dedup.line_dedup(frame(texts)).collect():
        assert r.n_lines - line_dedup.keep_from_bitmap(r.keep_bitmap, r.n_lines).sum() == r.n_dropped
    flags = line_dedup.line_dedup(frame(texts))
    for r in flags.select("n_lines", "keep_bitmap", line_dedup.dropped_at(flags.keep_bitmap, flags.n_lines).alias("at")).collect():
        assert r.at == ",".join(str(k) for k, x in enumerate(line_dedup.keep_from_bitmap(r.keep_bitmap, r.n_lines)) if not x)
    kept = {r.doc_id: r.text for r in line_dedup.line_dedup(frame(["a long enough line\nx", "A long enough line\t\nx"]), emit="text").collect()}
    assert kept == {0: "a long enough line\nx", 1: "x"}
    assert line_dedup.line_dedup(frame([]), emit="digest").collect() == []


def gram_sets(texts, n):
    out = {}
    for i, t in by_doc(texts).items():
        w = WORDS.findall(t.translate(FOLD))
        out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return out


def linked(texts, n, percent):
    sets = gram_sets(texts, n)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("gram, percent", [(4, 85), (5, 80), (2, 50), (1, 30)])
def test_jaccard(corpus, frame, gram, percent):
    got = collected(jaccard_join.jaccard_join(frame(corpus), gram=gram, percent=percent), "n_shingles", "component_id")
    assert got == linked(corpus, gram, percent)


def test_jaccard_in_units(corpus, frame, odd, monkeypatch):
    """A large group is cut by sizes and blocks and loses no link."""
    monkeypatch.setattr(jaccard_join, "UNIT_DOCS", 5)
    monkeypatch.setattr(jaccard_join, "UNIT_GRAMS", 2000)
    base = [f"w{k}" for k in range(60)]
    chain = [" ".join(base[k : k + 40]) for k in range(20)] + [" ".join(base[:40] + [f"x{k}"]) for k in range(25)]
    texts = corpus + chain
    assert collected(jaccard_join.jaccard_join(frame(texts)), "n_shingles", "component_id") == linked(texts, 4, 85)
    assert collected(jaccard_join.jaccard_join(frame(odd)), "n_shingles", "component_id") == linked(odd, 4, 85)
    assert jaccard_join.jaccard_join(frame([])).collect() == []
    # a line that nearly all short texts consist of: one long list of documents that are mostly no partners
    hot = [" ".join(base[:12] + [f"y{k}_{j}" for j in range(k % 4)]) for k in range(40)]
    assert collected(jaccard_join.jaccard_join(frame(hot + chain), percent=60), "n_shingles", "component_id") == linked(hot + chain, 4, 60)
    assert collected(jaccard_join.jaccard_join(frame(hot), percent=100), "n_shingles", "component_id") == linked(hot, 4, 100)
    with pytest.raises(ValueError):
        jaccard_join.jaccard_join(frame([]), percent=0)


def test_units_are_bounded(corpus, frame, monkeypatch):
    """No unit of the search gathers more documents than it may, however many share a token."""
    seen = []
    search = jaccard_join._search

    def counted(units, live, percent):
        seen.append(max([r["count"] for r in units.groupBy("unit").count().collect()], default=0))
        return search(units, live, percent)

    monkeypatch.setattr(jaccard_join, "_search", counted)
    monkeypatch.setattr(jaccard_join, "UNIT_DOCS", 20)
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join(base[:k % 60] + [f"x{k}"] + base[k % 60:]) for k in range(400)]
    got = collected(jaccard_join.jaccard_join(frame(texts)), "n_shingles", "component_id")
    assert got == linked(texts, 4, 85) and len(seen) >= 2 and max(seen) <= 45


def test_t_occurrence():
    rng = np.random.default_rng(2)
    for percent in (40, 60, 85):
        sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25))).astype(np.uint64) for _ in range(60)]
        sets += [s for s in sets[:10]] + [np.arange(25, dtype=np.uint64)] * 3
        sets.sort(key=len)

        def groups(links, sets=sets):
            root = list(range(len(sets)))
            for a, b in links:
                x, y = root[a], root[b]
                root = [x if r == y else r for r in root]
            return [root.index(r) for r in root]

        true = {(q, p) for q in range(len(sets)) for p in range(q) if 100 * len(np.intersect1d(sets[p], sets[q])) >= percent * len(np.union1d(sets[p], sets[q]))}
        found = jaccard_join.t_occurrence(sets, percent)
        assert set(found) <= true
        joined = groups(true)
        assert jaccard_join.t_occurrence(sets, percent, joined) == []

        assert groups(found) == joined


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 50), (60, 100), (7, 7), (50, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 50: 50, 60: 50, 100: 50}


def cut_windows(texts, width):
    docs = {i: WORDS.findall(t) for i, t in by_doc(texts).items()}
    first = {}
    for i in sorted(docs):
        for k in range(len(docs[i]) - width + 1):
            first.setdefault(tuple(docs[i][k : k + width]), i)
    out = {}
    for i, w in docs.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("width, depth", [(13, 2), (3, 1), (1, 2)])
def test_windows(corpus, frame, odd, width, depth):
    texts = corpus + [t + " tail" for t in corpus if t][:20]
    got = collected(substring_dedup.window_dedup(frame(texts), width=width, depth=depth), "n_words", "n_removed", "kept_sha256")
    assert got == cut_windows(texts, width)
    assert collected(substring_dedup.window_dedup(frame(odd), width=width, depth=depth), "n_words", "n_removed", "kept_sha256") == cut_windows(odd, width)


def test_windows_other_forms(frame):
    assert substring_dedup.window_dedup(frame([])).collect() == []
    got = {r.doc_id: r.text for r in substring_dedup.window_dedup(frame(["a b c", "x a b c y"]), width=3, emit="text").collect()}
    assert got == {0: "a b c", 1: "x y"}
