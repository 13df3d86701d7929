"""Operator 6: exact n-gram Jaccard join by T-occurrence search."""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Answers, answer, ask, block_chunks, blocked, layout, with_answers
from .common import BROADCAST_ROWS, documents, gram_hashes, hold, load, pa_schema, passing, settle_rows, word_hashes, words
from .components import components

GRAM, PERCENT = 4, 85
DEPTH = 2
#: A unit of the search holds about this many documents, and n-grams, at most (a longer document meets each other one alone).
UNIT_DOCS, UNIT_GRAMS = 200, 1 << 20
#: DivideSkip's weight of a long list's length.
MU = 0.01
#: Short lists with fewer entries than this are merged by a heap, larger ones by a sort of the same entries.
HEAP_ENTRIES = 64
_SETS = "doc_id long, n_shingles long, rep long, grams binary, prefix array<long>"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def gram_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text (A-Z lower-cased; a shorter text is one gram), end to end, and their bounds."""
    data = _LOWER[data]
    starts, ends, per = words(data, bounds)
    w, _ = word_hashes(data, starts, ends)
    grams = gram_hashes(w, n)
    sets = []
    for a, b in zip(per[:-1].tolist(), per[1:].tolist(), strict=True):
        sets.append(np.unique(grams[a : b - n + 1]) if b - a >= n else gram_hashes(w[a:b], b - a, seed=b - a) if b > a else np.zeros(0, np.uint64))
    return np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])]


def required(total: int, percent: int) -> int:
    """The least overlap of two sets whose sizes add up to ``total``."""
    return -(-percent * total // (100 + percent))


def _finder(root: list[int]):
    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    return find


def t_occurrence(grams: list[np.ndarray], percent: int, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (positions) that join the sets as all pairs of at least ``percent`` similarity would. Sets come by ascending size.
    Sets of equal ``labels`` are joined already.

    Each set in turn asks the inverted lists of those before it for documents in at least T lists. Its L longest
    lists are put aside; the short ones are merged, by a heap if they are tiny, and keep documents with T - L
    occurrences; those are probed in the long lists by binary search. Documents that a link has joined already need no second one:
    of each group joined so far, candidates are tried, best first, until one holds.
    """
    sizes = np.array([len(g) for g in grams], np.int64)
    total = len(grams)
    owner = np.repeat(np.arange(total, dtype=np.int64), sizes)
    _, token = np.unique(np.concatenate(grams), return_inverse=True)
    flat = np.sort(token.astype(np.int64) * total + owner)  # the lists, one after the other, each by position
    list_start = np.searchsorted(flat, np.arange(token.max() + 2 if len(token) else 1, dtype=np.int64) * total)
    bounds = np.r_[0, np.cumsum(sizes)]
    held_by: dict[int, int] = {}
    root = [held_by.setdefault(x, k) for k, x in enumerate(labels or range(total))]
    find = _finder(root)
    links = []
    for q in range(1, total):
        n = int(sizes[q])
        low = int(np.searchsorted(sizes, -(-percent * n // 100)))
        if low >= q or not n:
            continue
        own = token[bounds[q] : bounds[q + 1]].astype(np.int64)
        begin = np.searchsorted(flat, own * total + low) if low else list_start[own]
        end = np.searchsorted(flat, own * total + q)
        length = end - begin
        least = required(n + int(sizes[low]), percent)
        held = int((length > 0).sum())
        if held < least:
            continue
        order = np.argsort(-length, kind="stable")
        longest = int(length[order[0]])
        n_long = min(least - 1, int(least / (MU * math.log2(longest) + 1)) if longest > 1 else least - 1)
        long_, short = order[:n_long], order[n_long:held]
        entries = int(length[short].sum())
        if entries <= HEAP_ENTRIES:
            merged = np.fromiter(heapq.merge(*[(flat[begin[k] : end[k]] % total).tolist() for k in short]), np.int64, entries)
        else:
            merged = np.sort(np.concatenate([flat[begin[k] : end[k]] for k in short]) % total)
        if not len(merged):
            continue
        first = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]])
        count = np.diff(np.r_[first, len(merged)])
        enough = count >= least - n_long
        cand, count = merged[first][enough], count[enough]
        best = np.argsort(-count, kind="stable")
        cand, count = cand[best], count[best]
        lists = own[long_] * total
        tried: dict[int, int] = {}
        left = list(range(len(cand)))
        width = 1
        while left:
            # of each group not yet joined the next `width` candidates
            tried.clear()
            now, later = [], []
            for k in left:
                r = find(int(cand[k]))
                if r == find(q):
                    continue
                tried[r] = tried.get(r, 0) + 1
                (now if tried[r] <= width else later).append(k)
            for a in range(0, len(now), 256):
                c = cand[now[a : a + 256]]
                keys = (lists[None, :] + c[:, None]).reshape(-1)
                at = np.minimum(np.searchsorted(flat, keys), len(flat) - 1)
                overlap = count[now[a : a + 256]] + (flat[at] == keys).reshape(len(c), -1).sum(axis=1)
                for p, o in zip(c.tolist(), overlap.tolist(), strict=True):
                    if 100 * o >= percent * (n + int(sizes[p]) - o) and find(p) != find(q):
                        root[find(p)] = find(q)
                        links.append((q, p))
            left, width = later, width * 2
    return links


def similar_sets(d: DataFrame, gram: int, percent: int, depth: int) -> DataFrame:
    """Each document with its set's size and the smallest document of equal text; of those that may have a partner, the set and its prefix."""
    at = layout(d)
    b = blocked(d, at)
    sketch = answer(ask(b, at, lambda data, bounds: gram_sets(data, bounds, gram)[0], depth))
    schema = pa_schema(_SETS)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in schema}
        if not table.num_rows:
            return pa.table(out, schema=schema)
        known = Answers(answers, at)
        docs, parts, sizes = [], [], []
        for ids, data, bounds in block_chunks(table):
            grams, per = gram_sets(data, bounds, gram)
            docs.append(ids)
            parts.append(grams)
            sizes.append(np.diff(per))
        docs, grams, sizes = np.concatenate(docs), np.concatenate(parts), np.concatenate(sizes)
        counts = known.counts(grams)
        base = 0
        for doc, n in zip(docs.tolist(), sizes.tolist(), strict=True):
            own, c = grams[base : base + n], counts[base : base + n]
            base += n
            rep = known.classes[doc][0]
            blob = prefix = None
            if n and rep == doc:
                need = -(-percent * n // 100)
                if int((c >= 2).sum()) >= need:
                    # rare first: any order serves that all documents share; this one keeps common n-grams out of prefixes
                    head = np.lexsort((own, c))[: n - need + 1]
                    head = own[head[c[head] >= 2]]
                    if len(head):
                        blob, prefix = own.astype("<u8").tobytes(), head.view(np.int64).tolist()
            for name, v in zip(out, (doc, n, rep, blob, prefix), strict=True):
                out[name].append(v)
        return pa.table(out, schema=schema)

    return hold(with_answers(b, sketch, run, _SETS))


_FOUND = "doc_id long, label long, least long, partners array<long>"


def _search(units: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """T-occurrence search in each unit (``unit, doc_id, label``): the links found, and for each document the least label it is joined with."""
    schema = pa_schema(_FOUND)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip((np.frombuffer(x, "<u8") for x in table.column("grams").to_pylist()), *(table.column(c).to_pylist() for c in ("doc_id", "label")), strict=True), key=lambda r: (len(r[0]), r[1]))
        docs, labels = [r[1] for r in rows], [r[2] for r in rows]
        found = t_occurrence([r[0] for r in rows], percent, labels) if len(rows) > 1 else []
        partners: list[list[int]] = [[] for _ in rows]
        least = dict(zip(labels, labels, strict=True))
        find = _finder(least)
        for q, p in found:
            partners[q].append(docs[p])
            x, y = sorted((find(labels[q]), find(labels[p])))
            least[y] = x
        return pa.table({"doc_id": docs, "label": labels, "least": [find(x) for x in labels], "partners": partners}, schema=schema)

    units, rows = settle_rows(units.select("unit", "doc_id", "label"), "units")  # thin; while it is short, sets that no unit asks for are not shuffled
    return hold(live.select("doc_id", "grams").join(_few(units, rows), "doc_id").groupBy("unit").applyInArrow(run, _FOUND))


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Quick turns at most; what they leave is searched whole.
TURNS = 2


def links(sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: verified links that connect whatever all links would.

    Two similar sets share a token (n-gram) of their prefixes, so a list of all documents with a token in their prefix holds all its partners.
    Lists with the same head (the document whose id hashes lowest) are searched together in one unit, so that documents with many tokens in
    common meet once. Large units are thinned first, in quick turns: a document goes with one of its large units to a part of it of UNIT_DOCS, and what
    the search verifies there gets one label; in the second turn the unit's document with the most links goes to all its parts, since many
    copies of one document are often linked through it alone. Then the whole job: units that still hold several labels are searched, those beyond
    the bounds in parts (``_dealt``). Only verified links join documents; shared tokens alone never do.
    """
    live = sets.where("prefix is not null").select("doc_id", "n_shingles", "grams", "prefix")
    posts = hold(live.select("doc_id", "n_shingles", F.explode("prefix").alias("token")))
    tokens = posts.groupBy("token").agg(F.count("*").alias("docs"), F.min(F.struct(F.xxhash64("doc_id").alias("mixed"), "doc_id"))["doc_id"].alias("head"))
    tokens, rows = settle_rows(tokens.where("docs > 1").select("token", "head"), "tokens")
    # thin from here on: a row for each head that a document meets under
    met, _ = settle_rows(posts.join(_few(tokens, rows), "token").select("head", "doc_id", "n_shingles").distinct(), "met")
    heads = met.groupBy("head").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("grams"))
    heads, n_heads = settle_rows(heads.select("head", ((F.col("docs") > UNIT_DOCS) | (F.col("grams") > UNIT_GRAMS)).alias("big"), F.greatest(F.ceil(F.col("docs") / UNIT_DOCS), F.ceil(F.col("grams") / UNIT_GRAMS)).cast("int").alias("parts")), "heads")
    found = [live.sparkSession.createDataFrame([], _FOUND)]
    n_big = heads.where("big").count()
    labelled = met.withColumn("label", F.col("doc_id"))
    for turn in range(TURNS if n_big else 0):
        shared, _ = settle_rows(labelled.join(_few(heads.where("big").drop("big"), n_big), "head"), "shared")
        several = shared.groupBy("head").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("head")
        order = -F.col("parts") if turn == 0 else F.xxhash64("head", F.lit(turn))
        choice = shared.join(_few(several, n_big), "head").groupBy("doc_id", "label").agg(F.min(F.struct(order.alias("order"), "head", "parts")).alias("c"))
        units = choice.select("doc_id", "label", "c.head", F.pmod(F.xxhash64("doc_id", F.lit(turn)), "c.parts").cast("int").alias("part"))
        if turn:
            links_of = _pairs(found).select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("links"))
            hubs = shared.join(links_of, "doc_id").groupBy("head", "parts").agg(F.max(F.struct("links", "doc_id", "label")).alias("hub"))
            units = units.unionByName(hubs.select("hub.doc_id", "hub.label", "head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))).distinct()
        found.append(_search(units.select("doc_id", "label", F.xxhash64("head", "part").alias("unit")), live, percent))
        moved, n = settle_rows(found[-1].where("least < label").groupBy("label").agg(F.min("least").alias("least")), "labels")
        labelled = labelled.join(_few(moved, n), "label", "left").select("head", "doc_id", "n_shingles", F.coalesce("least", "label").alias("label"))
    several = labelled.groupBy("head").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("head")
    open_ = heads.join(_few(several, n_heads), "head")
    whole = labelled.join(_few(open_.where("not big").select("head"), n_heads), "head").select("doc_id", "label", F.xxhash64("head").alias("unit"))
    if n_big:
        whole = whole.unionByName(_dealt(labelled.join(_few(open_.where("big").select("head"), n_big), "head"), percent))
    found.append(_search(whole, live, percent))
    return _pairs(found)


def _dealt(met: DataFrame, percent: int) -> DataFrame:
    """Units (``doc_id, label, unit``) in which all documents meet that share a head and may be partners, of heads beyond the bounds.

    Bands of size come first: partners lie in one of two neighbouring bands. A band's documents are dealt into blocks of half a unit, and each
    pair of blocks is a unit. Documents of one label are joined already, so a large label gets blocks of its own, and blocks of one label do not meet:
    one large group of copies with a few others costs its documents one unit each.
    """
    step = math.log(100 / percent) * 1.0001 + 1e-6  # sets whose sizes differ by more are no partners
    band = F.floor(F.log("n_shingles") / step).cast("int")
    banded = met.select("head", "doc_id", "label", "n_shingles", F.explode(F.array(band, band - 1)).alias("band"))
    size = F.greatest(F.col("docs") / UNIT_DOCS, F.col("grams") / UNIT_GRAMS)
    sums = (F.sum("docs").alias("docs"), F.sum("grams").alias("grams"))
    by_label = banded.groupBy("head", "band", "label").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("grams"))
    by_label = by_label.withColumn("owned", size >= 0.5).withColumn("owner", F.when(F.col("owned"), F.col("label")).otherwise(0))
    groups, rows = settle_rows(by_label.groupBy("head", "band", "owned", "owner").agg(*sums).select("head", "band", "owned", "owner", F.ceil(2 * size).cast("int").alias("parts")), "blocks")
    every = groups.groupBy("head", "band").agg(F.collect_list(F.struct("owned", "owner", "parts")).alias("every"), F.sum("parts").alias("n"))  # an entry a group of blocks
    large = groups.where("owned").select("head", "band", F.col("owner").alias("label"), "owned", "owner")
    placed = banded.join(_few(large, rows), ["head", "band", "label"], "left").na.fill({"owned": False, "owner": 0})
    placed = placed.join(_few(groups, rows), ["head", "band", "owned", "owner"]).join(_few(every, rows), ["head", "band"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    others = F.filter("every", lambda o: ~F.col("owned") | ~o["owned"] | (o["owner"] != F.col("owner")))
    blocks = F.flatten(F.transform(others, lambda o: F.transform(F.sequence(F.lit(0), o["parts"] - 1), lambda q: F.xxhash64(o["owned"], o["owner"], q))))
    pair = placed.select("head", "band", "doc_id", "label", "n", F.xxhash64("owned", "owner", "part").alias("i"), F.explode(blocks).alias("j"))
    return pair.where("n = 1 or i <> j").select("doc_id", "label", F.xxhash64("head", "band", F.least("i", "j"), F.greatest("i", "j")).alias("unit"))


def _pairs(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select(F.col("doc_id").alias("a"), F.explode("partners").alias("b")) for f in found])


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, percent: int = PERCENT, depth: int = DEPTH) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (the least document that links reach).

    Documents link when ``100 * intersection >= percent * union`` of their sets of distinct n-grams; no link between
    different texts is lost. A sketch of how often each n-gram occurs, dealt over segments, first sets aside
    documents with too few shared n-grams to have any partner. Two similar sets share one of the rarest n-grams of
    each (15 % of them at 85 %): documents that share such a token meet in a unit of bounded size, where T-occurrence
    search finds the links (see ``links``). Equal texts are searched once. No candidates are capped.

    Sets hold 64-bit hashes of n-grams: a short word is hashed by a bijection, a longer one by XXH3.

    A text without words is an empty set and linked with nothing. A null text is empty. Repeated ids, null ids and
    empty tables: see ``common.documents``.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    sets = similar_sets(documents(df, id_col, text_col), gram, percent, depth)
    with passing() as keep:
        groups = keep(components(links(sets, percent)))
    whole = sets.select("doc_id", "n_shingles", "rep").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return whole.select("doc_id", "n_shingles", own.alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(load(spark, sf_dir))


OP6_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, max(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM docs),
g AS (SELECT doc_id, md5_number(array_to_string(w[p:p + 3], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM w WHERE len(w) > 0) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
edges AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)),
sym AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM docs UNION SELECT reach.doc_id, sym.b FROM reach JOIN sym ON sym.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = d.doc_id) AS component_id FROM docs d LEFT JOIN n USING (doc_id)
"""
