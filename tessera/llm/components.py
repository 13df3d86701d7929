"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, settle_rows


def _pull(edges: DataFrame) -> DataFrame:
    """Each (u, v), with the least of u and all its v."""
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) of links ``a, b``. Nodes without a link are left out.

    Rounds grow with the logarithm of the nodes; each writes its links to the shared folder, and the driver sees
    only a count and a checksum.
    """
    edges, rows = settle_rows(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _pull(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        pulled = _pull(large)
        small = pulled.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(pulled.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, edges = edges, materialize(small, "stars", 2 * rows)
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, rows = now, now[0]
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
    out.stored_at = edges.stored_at
    return out
