"""Key dictionaries, interned strings and content ids over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import quote_text, string_text
from ..functions.text import key_dict
from .ordered import numbered

#: The least length and number of occurrences of a pooled string, strings in a stream's dictionary, and frames it learns from.
POOL_MIN_LENGTH, POOL_MIN_COUNT, DICT_LIMIT, LEARN_FRAMES = 20, 2, 4096, 10


def _in_order(keys: DataFrame) -> DataFrame:
    n = numbered(keys, [F.col("key")], "idx")
    return n.select(F.col("idx").cast("int").alias("idx"), "key", "n")


def corpus_keys(df: DataFrame, column: str) -> DataFrame:
    """All keys of a column of JSON objects, with counts and their places in sorted order: ``idx, key, n``.

    Top-level keys of flat objects come from the JVM's own ``json_object_keys``.
    """
    keys = df.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return _in_order(keys)


def nested_keys(df: DataFrame, column: str) -> DataFrame:
    """As ``corpus_keys``, with keys at any depth."""
    keys = df.select(F.explode(key_dict(F.col(column))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return _in_order(keys)


def stream_dictionary(df: DataFrame, key: str, order: str, limit: int = DICT_LIMIT) -> DataFrame:
    """Keys in order of first sight: ``code, key, n``. Beyond ``limit`` a key has no code and is written out."""
    first = df.groupBy(key).agg(F.min(order).alias("_at"), F.count("*").alias("n"))
    # a bounded dictionary: the top-k keeps `limit` rows a task, and only they are ranked
    kept = first.orderBy("_at", key).limit(limit)
    return kept.withColumn("code", (F.row_number().over(Window.orderBy("_at", key)) - 1).cast("int")).select("code", F.col(key).alias("key"), "n")


def pool_candidates(df: DataFrame, column: str, min_length: int = POOL_MIN_LENGTH, min_count: int = POOL_MIN_COUNT) -> DataFrame:
    """Strings worth pooling, most frequent first, then longest, then in order: ``idx, value, n, saved``."""
    c = F.col(column)
    n = df.where(F.octet_length(c) >= min_length).groupBy(c.alias("value")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    out = numbered(n, [-F.col("n"), -F.octet_length("value"), F.col("value")], "idx")
    return out.select(F.col("idx").cast("int").alias("idx"), "value", "n", ((F.col("n") - 1) * F.octet_length("value")).cast("long").alias("saved"))


def pool_header(pool: DataFrame, pool_id: str = "S1") -> DataFrame:
    """One row ``text``: ``@pool.str id=S1 ["…" "…"]``."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: quote_text(x["value"]))
    return pool.agg(F.concat(F.lit(f"@pool.str id={pool_id} ["), F.array_join(items, " "), F.lit("]")).alias("text"))


def pool_encode(df: DataFrame, column: str, pool: DataFrame, pool_id: str = "S1") -> DataFrame:
    """``column`` with pooled strings as references ``^S1:N``, others as canonical strings. A left join, broadcast by size."""
    p = pool.select(F.col("value").alias("_v"), F.col("idx").alias("_i"))
    j = df.join(p, F.col(column) == F.col("_v"), "left")
    return j.withColumn(column, F.when(F.col("_i").isNotNull(), F.concat(F.lit(f"^{pool_id}:"), F.col("_i").cast("string"))).otherwise(string_text(F.col(column)))).drop("_v", "_i")


def pool_resolve(df: DataFrame, column: str, pool: DataFrame, pool_id: str = "S1") -> DataFrame:
    """The inverse: references as their strings. A reference to no entry is null."""
    at = F.when(F.col(column).rlike(rf"\A\^{pool_id}:\d+\z"), F.substring_index(column, ":", -1).cast("int"))
    j = df.withColumn("_at", at).join(pool.select(F.col("idx").alias("_at"), F.col("value").alias("_v")), "_at", "left")
    return j.withColumn(column, F.when(F.col("_at").isNotNull(), F.col("_v")).otherwise(F.col(column))).drop("_at", "_v")


def intern_first_seen(df: DataFrame, column: str, order: str, min_length: int = 50, limit: int = 256) -> DataFrame:
    """Strings in order of first sight (``order`` is a number) in pools of ``limit``: ``pool, idx, value``."""
    first = df.where(F.octet_length(column) >= min_length).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("_at"))
    n = F.col("_n")
    first = numbered(first, [F.col("_at"), F.col("value")], "_n")
    return first.select(F.concat(F.lit("S"), (F.floor(n / limit) + 1).cast("string")).alias("pool"), (n % limit).cast("int").alias("idx"), "value")


def cid(c: Column) -> Column:
    """Content id: ``sha256:`` and the digest."""
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def blob_text(c: Column, mime: Column, name: Column | None = None, caption: Column | None = None) -> Column:
    """``@blob cid=… mime=… bytes=…`` of bytes or of a string's UTF-8."""
    more = [F.when(x.isNotNull(), F.concat(F.lit(f" {k}="), quote_text(x))).otherwise("") for k, x in (("name", name), ("caption", caption)) if x is not None]
    return F.concat(F.lit("@blob cid="), cid(c), F.lit(" mime="), mime, F.lit(" bytes="), F.octet_length(c).cast("string"), *more)


def parse_blob(c: Column) -> Column:
    get = lambda k: F.nullif(F.regexp_extract(c, rf'\s{k}=("(?:[^"\\]|\\.)*"|\S+)', 1), F.lit(""))
    return F.when(c.startswith("@blob"), F.struct(get("cid").alias("cid"), get("mime").alias("mime"), get("bytes").cast("long").alias("bytes"), F.regexp_replace(get("name"), '^"|"$', "").alias("name")))


def blob_registry(df: DataFrame, content: str) -> DataFrame:
    """One row for each distinct content: ``cid, bytes, n``."""
    c = F.col(content)
    return df.groupBy(cid(c).alias("cid")).agg(F.first(F.octet_length(c)).cast("long").alias("bytes"), F.count("*").alias("n"))
