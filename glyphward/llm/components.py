"""Connected components by alternating star contraction, each round a few joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_staged, stage_table


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node it is linked with) for every node of a non-trivial edge.

    A hub with many links is never gathered: minima are aggregates, and links meet them in a join that AQE may split.
    """
    now = stage_table(_links(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))), "links")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _links(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # every link now points down; each node's lower neighbours are tied to its least one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = now
        now = stage_table(_links(tied.unionByName(low.select("u", F.col("m").alias("v")))), "links")
        drop_staged(before)
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        seen = sign
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
