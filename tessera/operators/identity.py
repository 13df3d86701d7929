"""Identity of rows by canonical form: duplicates, equality, change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import canon_row, fingerprint_row
from ..values import NO_TABULAR


def with_fingerprint(df: DataFrame, cols: list[str] | None = None, name: str = "fp", **how) -> DataFrame:
    return df.withColumn(name, fingerprint_row(df, cols, **how))


def duplicate_groups(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``fp, n`` of fingerprints that occur more than once."""
    return df.select(fingerprint_row(df, cols).alias("fp")).groupBy("fp").agg(F.count("*").alias("n")).where("n > 1")


def distinct_rows(df: DataFrame, cols: list[str] | None = None, order: Column | None = None) -> DataFrame:
    """One row for each fingerprint; with ``order`` the first by it, else any."""
    d = with_fingerprint(df, cols, "_fp")
    if order is None:
        return d.dropDuplicates(["_fp"]).drop("_fp")
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("_fp").orderBy(order))).where("_n = 1").drop("_fp", "_n")


def count_distinct(df: DataFrame, cols: list[str] | None = None, approximate: bool = False) -> DataFrame:
    fp = fingerprint_row(df, cols)
    return df.agg((F.approx_count_distinct(fp) if approximate else F.count_distinct(fp)).alias("n"))


def changed(before: DataFrame, after: DataFrame, key: str, cols: list[str] | None = None) -> DataFrame:
    """``key, change`` (added, removed, changed) of rows whose fingerprints differ."""
    side = lambda df, n: df.select(key, fingerprint_row(df, cols or [c for c in df.columns if c != key]).alias(n))
    j = side(before, "_a").join(side(after, "_b"), key, "full_outer")
    return j.select(key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").alias("change")).where("change is not null")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that ``b`` holds too, by canonical form."""
    return a.withColumn("_c", canon_row(a, options=NO_TABULAR)).join(b.select(canon_row(b, options=NO_TABULAR).alias("_c")).distinct(), "_c", "left_semi").drop("_c")


def savings(df: DataFrame, json: str, text: str) -> DataFrame:
    """Bytes of two encodings, summed, and the saving in percent."""
    a, b = F.sum(F.octet_length(json)), F.sum(F.octet_length(text))
    return df.agg(a.alias("json_bytes"), b.alias("text_bytes"), F.round((1 - b / a) * 100, 2).alias("saved_pct"))
