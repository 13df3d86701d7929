"""Operator 3: jump consistent hashing of stable keys into shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, MIX1, MIX2, documents, fresh, load, mix, ranked_rows, settle_rows

SHARDS = 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump consistent hash of 64-bit keys. No ring table; expected ln(shards) steps."""
    key = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(key), np.int64)
    jump = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = jump[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        jump[live] = ((at[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[jump[live] < shards]
    return at.astype(np.int32)


def placed(key: F.Column, shards: int, buckets: int = 1) -> F.Column:
    """Of a long key: ``shard`` and ``grown_shard`` (with one shard more), the mixed key as a number that keeps its unsigned order, and which of ``buckets`` even ranges of it."""

    @F.pandas_udf("shard int, grown_shard int, mixed long, bucket long")
    def run(k: pd.Series) -> pd.DataFrame:
        m = mix(k.to_numpy(dtype=np.int64).view(np.uint64))
        bucket = ((m >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        return pd.DataFrame({"shard": jump_hash(m, shards), "grown_shard": jump_hash(m, shards + 1), "mixed": (m ^ np.uint64(1 << 63)).view(np.int64), "bucket": bucket.view(np.int64)})

    return run(key.cast("long"))


def assign_shards(df: DataFrame, shards: int = SHARDS, key_col: str = "doc_id") -> DataFrame:
    """Add ``shard``, ``slot`` (gapless from 0 in each shard, in order of the mixed key) and ``grown_shard`` (with one shard more).

    The key alone and the number of shards decide; when a shard is appended a row stays or moves into the new one.
    Slots need no task that sees a whole shard: rows are ranked in even ranges of the mixed key (of about ``common.ranked_rows`` rows), and the
    ranges' counts give each its first slot (broadcast if they are few). Null keys are
    not addressable and are left out. An empty table gives an empty table. Rows that repeat a key share a shard
    and take neighbouring slots. Columns of ``df`` named as the added ones give way to them; other columns stay, whatever their names.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = F.col(key_col)
    df = df.drop(*({"shard", "slot", "grown_shard"} - {key_col})).where(key.isNotNull())
    at, bucket, before, no = (fresh(c, df) for c in ("at", "bucket", "before", "no"))
    rows = df.count()
    s = df.withColumn(at, placed(key, shards, min(1 << 32, rows // (shards * ranked_rows(df.sparkSession, rows)) + 1)))
    s = s.withColumns({"shard": F.col(at)["shard"], "grown_shard": F.col(at)["grown_shard"], bucket: F.col(at)["bucket"], at: F.col(at)["mixed"]})
    counts = s.groupBy("shard", bucket).agg(F.count("*").alias(no))
    first, n = settle_rows(counts.select("shard", bucket, (F.sum(no).over(Window.partitionBy("shard").orderBy(bucket)) - F.col(no)).alias(before)), "buckets")
    ranked = s.withColumn(no, F.row_number().over(Window.partitionBy("shard", bucket).orderBy(at)))
    ranked = ranked.join(F.broadcast(first) if n <= BROADCAST_ROWS else first, ["shard", bucket])
    return ranked.withColumn("slot", F.col(before) + F.col(no) - 1).drop(at, bucket, before, no)


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 16 shards by the law ``key``. Only ids, sizes and checksums are shuffled, never texts.

    A null text has size 1 and the checksum of the empty string.
    """
    d = documents(load(spark, sf_dir)).select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32")
    )
    return assign_shards(d).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def _crc_step(n: int) -> int:
    for _ in range(8):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


_WORD = f"{1 << 64}::UHUGEINT"
OP3_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, max(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
m0 AS (SELECT doc_id, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + {1 << 64}::HUGEINT ELSE doc_id::HUGEINT END)::UHUGEINT AS x FROM docs),
m1 AS (SELECT doc_id, (xor(x, x // {1 << 30}::UHUGEINT) * {int(MIX1)}::UHUGEINT) % {_WORD} AS x FROM m0),
m2 AS (SELECT doc_id, (xor(x, x // {1 << 27}::UHUGEINT) * {int(MIX2)}::UHUGEINT) % {_WORD} AS x FROM m1),
mixed AS (SELECT doc_id, xor(x, x // {1 << 31}::UHUGEINT) AS x FROM m2),
step(doc_id, n, k, b, j) AS (SELECT doc_id, n, x, -1::BIGINT, 0::BIGINT FROM mixed, (VALUES ({SHARDS}), ({SHARDS + 1})) AS t(n)
  UNION ALL SELECT doc_id, n, y, j, floor((j + 1)::DOUBLE * ({1 << 31}::DOUBLE / ((y // {1 << 33}::UHUGEINT)::DOUBLE + 1::DOUBLE)))::BIGINT FROM (SELECT *, (k * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % {_WORD} AS y FROM step WHERE j < n)),
jumped AS (SELECT doc_id, max(b) FILTER (n = {SHARDS}) AS shard, max(b) FILTER (n = {SHARDS + 1}) AS grown_shard FROM step WHERE j >= n GROUP BY doc_id),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda c, b: xor(c >> 8, list_extract([{', '.join(str(_crc_step(k)) for k in range(256))}], (xor(c, b) & 255) + 1)))::BIGINT, 4294967295) AS c FROM docs)
SELECT doc_id, strlen(text) + 1 AS size, c AS text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY x) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM docs JOIN mixed USING (doc_id) JOIN jumped USING (doc_id) JOIN crc USING (doc_id)
"""
