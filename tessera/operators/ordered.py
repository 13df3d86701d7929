"""Order at scale: rows of a key as a stream (one sort, no group in memory, no cost per group), and global numbers without a global sort."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_key(df: DataFrame, key: str, order: str, value: str, fn: Callable[[Any, Iterator[Any]], Iterable[tuple]], ddl: str, columns: list[str], rows: int = 10_000) -> DataFrame:
    """``fn(key, values in order)`` gives rows. A key that goes on over batches is one stream."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = ((k, v) for part in parts for k, v in zip(part[key].tolist(), part[value].tolist(), strict=True))
        out: list[tuple] = []
        for k, group in groupby(pairs, key=lambda p: p[0]):
            stream = (v for _, v in group)
            out += fn(k, stream)
            if len(out) >= rows:
                yield pd.DataFrame(out, columns=columns, dtype=object)
                out = []
        if out:
            yield pd.DataFrame(out, columns=columns, dtype=object)

    return df.select(key, order, value).repartition(key).sortWithinPartitions(key, order).mapInPandas(run, ddl)


#: Keys that are sampled for each splitter.
SAMPLED = 20


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with gapless numbers from 0 in ascending order of ``order`` (which should leave no ties).

    A bounded sample of the keys, those that hash lowest, gives splitters; rows are ranked inside the ranges between them, and the ranges'
    counts, a row a range, give each its first number. No task sorts all rows, and the splitters are constants of the plan.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("_k", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order))))
    sample = sorted(tuple(r["_k"]) for r in d.select("_k").orderBy(F.xxhash64("_k"), "_k").limit(SAMPLED * n).collect())  # bounded by the partitions
    kinds = [f.dataType for f in d.schema["_k"].dataType.fields]
    literal = lambda k: F.struct(*(F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(k, kinds, strict=True))))
    splitters = sorted(set(sample[SAMPLED::SAMPLED]))
    d = d.withColumn("_range", sum(((F.col("_k") >= literal(k)).cast("int") for k in splitters), F.lit(0)))
    counts = d.groupBy("_range").agg(F.count("*").alias("_n"))
    first = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_first"))
    ranked = d.withColumn("_r", F.row_number().over(Window.partitionBy("_range").orderBy("_k")))
    return ranked.join(F.broadcast(first), "_range").withColumn(name, F.col("_first") + F.col("_r") - 1).drop("_range", "_r", "_first", "_k")
