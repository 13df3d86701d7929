"""Operator 8: secret scan with corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, load

#: Fixed values of the contract: kind, pattern of the base scan, and the least number of characters.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A run of hex digits is matched whole, so asking for 32 in the pattern equals dropping shorter runs.
HEX = r"[0-9a-f]{32,}"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: A value that this many owners or this many repositories or more hold is a copied example; one that fewer hold looks live.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 2, 4


def _matches(text: F.Column, pattern: str, kind: str, rank: int, min_length: int, group: int) -> F.Column:
    """Spans of a pattern's matches: split() gives the gaps between them, so starts are sums of lengths (in code points)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), F.transform(whole, F.length), lambda g, w: F.struct(g.alias("g"), w.alias("w")))
    spans = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["g"] + p["w"]).alias("at"),
            F.array_append(acc["out"], F.struct((acc["at"] + p["g"]).alias("s"), (acc["at"] + p["g"] + p["w"]).alias("e"))).alias("out"),
        ),
    )["out"]
    made = F.zip_with(
        spans, value,
        lambda s, v: F.struct(s["s"].alias("start"), F.lit(rank).alias("rank"), s["e"].alias("end"), F.lit(kind).alias("kind"), F.length(v).alias("n"), F.sha2(v, 256).alias("value")),
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,n:int,value:string>>")
    found = F.contains(text, F.lit("AKIA")) if kind == "access" else text.rlike(pattern)
    return F.when(found, F.filter(made, lambda m: m["n"] >= min_length)).otherwise(none)


def base_spans(text: F.Column) -> F.Column:
    """The base scan's spans by start, then kind as listed: array of (start, rank, end, kind, n, value), ``value`` a SHA-256."""
    return F.array_sort(F.concat(
        _matches(text, ASSIGN, "assign", 0, MIN_ASSIGN, 1),
        _matches(text, ACCESS, "access", 1, MIN_ACCESS, 0),
        _matches(text, HEX, "hex", 2, MIN_HEX, 0),
    ))


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = "lang", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS
) -> DataFrame:
    """One row per document: counts by kind, ``base_sha256``, ``spans``, ``n_live`` and ``n_example``.

    A candidate is the SHA-256 of a matched value; values themselves are never shuffled. Each is counted over the
    corpus by distinct owner and by distinct repository (owner and ``repo_col`` together; null is an owner of its
    own). Counting first makes (value, owner, repository) distinct, with partial aggregation, so that a widely
    copied example costs a row per repository and not per copy. A span whose value fewer than ``example_owners`` owners and fewer than
    ``example_repos`` repositories hold is given again as kind ``live``; other values are copied examples and add nothing to ``spans``.

    A null text is empty; rows without an id are left out. Of rows that repeat an id the one with the greatest text is the
    document, but every row counts as evidence of its owner and repository.
    """
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    repo = F.concat_ws("/", owner, F.coalesce(F.col(repo_col).cast("string"), F.lit(""))) if repo_col else owner
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), owner.alias("owner"), repo.alias("repo"))
    # the thin table is read twice, the texts once
    held = hold(rows.select("doc_id", "owner", "repo", base_spans(F.col("text")).alias("base")))
    seen = held.select("owner", "repo", F.explode("base.value").alias("value")).distinct()
    owners = seen.groupBy("value").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repo").alias("n_repos"))
    base = held.select("doc_id", "base")
    if base.groupBy("doc_id").count().where("count > 1").limit(1).count():
        base = rows.groupBy("doc_id").agg(F.max("text").alias("text")).select("doc_id", base_spans(F.col("text")).alias("base"))
    spots = base.select("doc_id", F.posexplode("base").alias("no", "m")).withColumn("value", F.col("m.value"))
    known = spots.join(owners, "value").groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("no", ((F.col("n_owners") < example_owners) & (F.col("n_repos") < example_repos)).alias("own")))).alias("held"),
        F.max("n_repos").alias("max_repos"),
    )
    j = base.join(known, "doc_id", "left")
    live = F.filter(F.transform("base", lambda m, i: F.struct(m["start"].alias("start"), F.lit(3).alias("rank"), m["end"].alias("end"), F.lit("live").alias("kind"), F.when(F.col("held")[i], 1).otherwise(0).alias("n"), m["value"].alias("value"))), lambda m: m["n"] == 1)
    n = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long")
    return j.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", live))).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        (F.size("base") - F.size(live)).cast("long").alias("n_example"),
        F.coalesce("max_repos", F.lit(0)).cast("long").alias("max_repos"),
    )


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(load(spark, sf_dir))


_SPANS = """SELECT doc_id, best, owner, repo, '{kind}' AS kind, {rank} AS rank, m AS whole, {value} AS value, p AS no,
  (list_sum(list_transform(gaps[1:p], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:p - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (SELECT doc_id, best, owner, repo, unnest(regexp_extract_all(text, '{re}')) AS m, unnest(regexp_extract_all(text, '{re}', {group})) AS g,
  generate_subscripts(regexp_extract_all(text, '{re}'), 1) AS p, regexp_extract_all(text, '{re}') AS found, regexp_split_to_array(text, '{re}') AS gaps FROM texts)
  WHERE length({value}) >= {least}"""
_QUOTED = ASSIGN.replace("'", "''")
_LIVE = f"n_owners < {EXAMPLE_OWNERS} AND n_repos < {EXAMPLE_REPOS}"
OP8_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(text, '') = max(coalesce(text, '')) OVER (PARTITION BY doc_id) AS best, coalesce(source, '') AS owner,
  concat_ws('/', coalesce(source, ''), coalesce(lang, '')) AS repo FROM documents WHERE doc_id IS NOT NULL),
spans AS (
  {_SPANS.format(kind="assign", rank=0, re=_QUOTED, group=1, value="g", least=MIN_ASSIGN)}
  UNION ALL {_SPANS.format(kind="access", rank=1, re=ACCESS, group=0, value="g", least=MIN_ACCESS)}
  UNION ALL {_SPANS.format(kind="hex", rank=2, re=HEX, group=0, value="g", least=MIN_HEX)}),
owned AS (SELECT value, count(DISTINCT owner) AS n_owners, count(DISTINCT repo) AS n_repos FROM spans GROUP BY value),
known AS (SELECT DISTINCT doc_id, kind, rank, start, start + length(whole) AS stop, n_owners, n_repos FROM spans s JOIN owned USING (value) WHERE best),
every AS (SELECT doc_id, kind, rank, start, stop FROM known UNION ALL SELECT doc_id, 'live', 3, start, stop FROM known WHERE {_LIVE}),
joined AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans FROM every GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS base, count(*) FILTER ({_LIVE}) AS n_live, count(*) AS n, max(n_repos) AS max_repos FROM known GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(j.spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n - n_live, 0) AS n_example, coalesce(max_repos, 0) AS max_repos
FROM (SELECT DISTINCT doc_id FROM texts) d LEFT JOIN counts c USING (doc_id) LEFT JOIN joined j USING (doc_id)
"""
