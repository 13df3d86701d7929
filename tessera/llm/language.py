"""Operator 2: language identification by Bayesian evidence fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, hold, load, pa_schema, settle_rows, slices, text_chunks, to_batch

#: Labelled rows that the text model is fitted on, at most. Their labels are its languages, however many.
TRAIN_ROWS = 4000
#: Buckets of byte trigrams.
BITS = 15
#: Trigrams of a text beyond which its likelihood counts no more: neighbours are not independent.
EVIDENCE_GRAMS = 60
#: A text is rejected from so many trigrams on, if each is on average so much likelier as loose bytes than in any language.
#: Prose with licence lines, addresses or keys in it stays above; digests and digit tables fall below.
MIN_GRAMS, MARGIN = 48, -2.5
#: Pseudo-counts: of a domain for its host, of the corpus for a domain or suffix, and of a language for its declaration.
HOST_WEIGHT, DOMAIN_WEIGHT, DECLARED_WEIGHT = 8.0, 32.0, 4.0
#: Hosts times languages that go to every task at most: with 16 bytes each, a few tens of MB.
BROADCAST_CELLS = 2_000_000
_FOLD = np.array([c + 32 if 65 <= c < 91 else c if c >= 128 or 97 <= c < 123 else 32 for c in range(256)], dtype=np.uint8)
_SUMS = "lang string, gram int, n long"


def _grams(data: np.ndarray) -> np.ndarray:
    x = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:].astype(np.uint32) << np.uint32(16)
    return (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


class TextModel:
    """Log-probabilities of a byte trigram's bucket for each language, and of loose bytes. ``cut``: the greatest key of the rows it was fitted on."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], cut: int | None = None) -> None:
        self.languages, self.cut = sorted(counts), cut
        rows, loose = [], np.zeros(256)
        for name in self.languages:
            grams, single = counts[name]
            # a trigram unseen in a language falls back on an even spread
            rows.append(np.log((grams + 0.05) / (grams.sum() + 0.05 * len(grams))))
            loose += single
        self.table = np.array(rows, np.float32).reshape(len(rows), 1 << BITS)
        p = np.log((loose + 0.5) / (loose.sum() + 128)).astype(np.float32)
        x = np.arange(256, dtype=np.uint8)
        self.loose = p[x]

    def score(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text: mean log-likelihood a language, that of loose bytes, and the numbers of trigrams and letters."""
        folded = _FOLD[data]
        n_letters = np.diff(np.r_[0, np.cumsum(folded != 32)][bounds])
        n = np.maximum(np.diff(bounds) - 2, 0)
        if len(data) < 3:
            return np.zeros((len(n), len(self.languages))), np.zeros(len(n)), n * 0, n_letters
        grams = _grams(folded)
        letters = (folded[:-2] != 32) | (folded[1:-1] != 32) | (folded[2:] != 32)
        inside = letters
        for b in bounds[1:-1].tolist():
            inside[max(0, b - 2) : b] = False
        at = np.searchsorted(np.flatnonzero(inside), bounds)
        used = grams[inside]
        n = np.diff(at)
        mean = lambda v: np.diff(np.r_[0.0, np.cumsum(v, dtype=np.float64)][at]) / np.maximum(n, 1)
        loose = self.loose[folded]
        return np.stack([mean(row[used]) for row in self.table], axis=1), mean((loose[:-2] + loose[1:-1] + loose[2:])[inside]), n, n_letters


def _key(doc_id: F.Column) -> F.Column:
    return F.xxhash64(doc_id.cast("long"))


def fold(name: F.Column) -> F.Column:
    """A label or declaration as languages are named here: trimmed, in lower case; an empty one is null."""
    name = F.lower(F.trim(name.cast("string")))
    return F.when(name != "", name)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = TRAIN_ROWS) -> TextModel:
    """Fit on ``rows`` labelled documents at most, those whose ids hash lowest: bounded, and the same at every run.

    Documents with a null or empty label teach nothing. Repeated and null ids: see ``common.documents``.
    """
    labelled = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), fold(F.col(label_col)).alias("label"))
    labelled = documents(labelled, keep=["label"]).where("label is not null")
    cut = labelled.select(_key(F.col("doc_id")).alias("k")).orderBy("k").limit(rows).agg(F.max("k")).first()[0]
    if cut is None:
        return TextModel({})
    sample = labelled.where(_key(F.col("doc_id")) <= cut).select("label", "text").repartition(4)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trigrams by bucket, and single bytes as buckets -1 to -256."""
        for batch in slices(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = _FOLD[np.frombuffer(text.as_buffer(), np.uint8)]
                kinds, n = np.unique(np.r_[_grams(data).astype(np.int32), -1 - data.astype(np.int32)] if len(data) > 2 else np.zeros(0, np.int32), return_counts=True)
                yield to_batch({"lang": [label] * len(kinds), "gram": kinds, "n": n}, pa_schema(_SUMS))

    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    # at most the buckets of each language, which the sample bounds
    for r in sample.mapInArrow(count, _SUMS).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for lang, gram, n in zip(*(r.column(k).to_pylist() for k in range(3)), strict=True):
            grams, single = total.setdefault(lang, (np.zeros(1 << BITS, np.int64), np.zeros(256, np.int64)))
            if gram >= 0:
                grams[gram] = n
            else:
                single[-1 - gram] = n
    return TextModel(total, cut)


def _smoothed(counts: F.Column, prior: F.Column, weight: float) -> F.Column:
    """Counts by language with ``weight`` pseudo-counts shared out as ``prior`` has it."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda c, p: (c + weight * p) / (total + weight))


def identify(
    df: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = None, url_col: str | None = None, host_col: str | None = None
) -> DataFrame:
    """One row per document: ``doc_id, language, confidence, margin, n_grams, kept``.

    Four sources of evidence are added as log-probabilities: the text's likelihood under each language's trigrams;
    the declared language, weighed by how often declarations of that language agree with texts; the address suffix
    (the host's last label); and the host's prior, smoothed by its domain's, smoothed by the corpus's. The three
    tables behind the last ones are grouped aggregations over all rows, each row voting with its text's likelihoods,
    and a row's own vote is taken out of its host's before it is judged. Only ids, scores and the evidence columns are
    shuffled. A very common host is partially aggregated, and its rows are few bytes each.

    Labels and declarations are folded alike (``fold``). Of languages that are equally likely the first by name is given. A declaration that the
    model does not know counts against each language as that of another language does.

    ``kept`` is false (and ``language`` is ``und``) for texts without letters, and for texts of MIN_GRAMS trigrams or more that loose bytes
    explain better than any language does, by MARGIN a trigram. Evidence that is missing or null says nothing. Repeated ids, null
    ids and empty tables: see ``common.documents``; of repeated ids the evidence goes with the text that stays.
    """
    names = model.languages
    size = len(names)
    if not size:
        return documents(df, id_col, text_col).select("doc_id", F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("margin"), F.lit(0).cast("long").alias("n_grams"), F.lit(False).alias("kept"))
    none = F.lit(None).cast("string")
    url = F.col(url_col).cast("string") if url_col else none
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.col(host_col).cast("string") if host_col else none)
    source = df.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), fold(F.col(declared_col) if declared_col else none).alias("declared"),
        host.alias("host"), F.when(url.isNotNull(), F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"),
    )
    d = documents(source, keep=["declared", "host", "suffix"])
    ddl = "doc_id long, declared string, host string, suffix string, means array<double>, loose double, n_grams long, letters long"
    schema = pa_schema(ddl)

    told = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for batch in batches:
            means, loose, n, letters = zip(*(model.score(data, bounds) for _, data, bounds in text_chunks(batch.column(0), batch.column(1))), strict=True)
            flat = np.concatenate(means)
            lists = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * size, flat.reshape(-1))
            yield to_batch({"doc_id": batch.column(0), "declared": batch.column(2), "host": batch.column(3), "suffix": batch.column(4), "means": lists, "loose": np.concatenate(loose), "n_grams": np.concatenate(n), "letters": np.concatenate(letters)}, schema)

    scored = hold(d.mapInArrow(score, ddl))  # thin, and read several times
    weight = F.least("n_grams", F.lit(EVIDENCE_GRAMS))
    top = F.array_max("means")
    raw = F.transform("means", lambda m: F.exp((m - top) * weight))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    # a text without letters votes for no language
    s = scored.withColumn("vote", F.transform(raw, lambda x: F.when(F.col("n_grams") > 0, x / total).otherwise(0.0)))
    votes = lambda: F.array(*(F.sum(F.col("vote")[k]) for k in range(size)))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    agree = F.array(*(F.sum(F.when(F.col("declared") == n, F.col("vote")[k]).otherwise(0.0)) for k, n in enumerate(names)))
    known = F.array(*(F.sum(F.when(F.col("declared").isNotNull(), F.col("vote")[k]).otherwise(0.0)) for k in range(size)))
    whole = s.agg(votes().alias("v"), agree.alias("a"), known.alias("k")).first()
    corpus = np.array([x or 0.0 for x in whole["v"]]) + 1.0
    corpus = F.array(*(F.lit(float(x)) for x in corpus / corpus.sum()))
    # how often a text of the language is declared so, where anything is declared
    trust = [((a or 0.0) + DECLARED_WEIGHT / 2) / ((k or 0.0) + DECLARED_WEIGHT) for a, k in zip(whole["a"], whole["k"], strict=True)]
    hosts = s.where("host is not null").groupBy("host").agg(votes().alias("host_votes")).withColumn("domain", domain)
    domains = hosts.groupBy("domain").agg(F.array(*(F.sum(F.col("host_votes")[k]) for k in range(size))).alias("domain_votes"))
    hosts, n = settle_rows(hosts.join(domains, "domain").select("host", "host_votes", _smoothed(F.col("domain_votes"), corpus, DOMAIN_WEIGHT).alias("domain_prior")), "hosts")
    # a host with a third of all rows is no hot key of a shuffle while the hosts' table is short; a long one is joined
    j = s.join(F.broadcast(hosts) if n * size <= BROADCAST_CELLS else hosts, "host", "left")
    suffixes, n = settle_rows(s.where("suffix is not null").groupBy("suffix").agg(votes().alias("suffix_votes")), "suffixes")
    j = j.join(F.broadcast(suffixes) if n * size <= BROADCAST_CELLS else suffixes, "suffix", "left")
    others = F.zip_with("host_votes", "vote", lambda h, v: F.greatest(h - v, F.lit(0.0)))
    prior = F.coalesce(_smoothed(others, F.col("domain_prior"), HOST_WEIGHT), corpus)
    # P(suffix | language) up to a factor that all languages share
    by_suffix = F.coalesce(F.zip_with(_smoothed(F.col("suffix_votes"), corpus, DOMAIN_WEIGHT), corpus, lambda p, c: p / c), F.array(*[F.lit(1.0)] * size))
    declared = F.array(*(F.when(F.col("declared").isNull(), 0.0).when(F.col("declared") == n, F.log(F.lit(t))).otherwise(F.log(F.lit((1 - t) / max(1, size - 1)))) for n, t in zip(names, trust, strict=True)))
    logs = F.zip_with(F.zip_with(F.transform("means", lambda m: m * weight), declared, lambda a, b: a + b), F.zip_with(prior, by_suffix, lambda p, q: F.log(p * q)), lambda a, b: a + b)
    j = j.withColumn("logs", logs)
    best = F.array_max("logs")
    sure = 1 / F.aggregate(F.transform("logs", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x)
    kept = (F.col("letters") > 0) & ((F.col("n_grams") < MIN_GRAMS) | (F.array_max("means") - F.col("loose") > MARGIN))
    which = F.element_at(F.array(*map(F.lit, names)), F.array_position("logs", best).cast("int"))
    return j.select(
        "doc_id", F.when(kept, which).otherwise("und").alias("language"), F.when(kept, sure).otherwise(0.0).alias("confidence"),
        (F.array_max("means") - F.col("loose")).alias("margin"), "n_grams", kept.alias("kept"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: the declared language is ``lang``, the host is ``source``; they have no address.

    ``lang`` is also the label that the text model is fitted on, so the documents of the sample declare nothing.
    """
    d = load(spark, sf_dir)
    return identify_documents(d)


def identify_documents(d: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``identify`` for a table with ``doc_id, text, lang, source``, fitted on ``rows`` of its own rows."""
    model = fit(d, rows=rows)
    declared = fresh("declared", d)
    unseen = F.lit(True) if model.cut is None else _key(F.col("doc_id")) > model.cut
    return identify(d.withColumn(declared, F.when(unseen, F.col("lang"))), model, declared_col=declared, host_col="source")


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages``, with all four sources: text of the markup, its ``lang`` attribute, the address suffix and the host."""
    return identify_pages(load(spark, sf_dir, "pages"), fit(load(spark, sf_dir)))


def identify_pages(p: DataFrame, model: TextModel) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    declared = F.regexp_extract("html", r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1)
    p = p.select("page_id", "url", bare.alias("text"), declared.alias("declared"))
    return identify(p, model, id_col="page_id", declared_col="declared", url_col="url").withColumnRenamed("doc_id", "page_id")
