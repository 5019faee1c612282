"""Connected components of an edge table by alternating large and small stars; nothing but sizes reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (u, v: long), root the smallest node of its component.

    Each round re-hangs neighbours on the smallest one seen, with partial aggregation before the shuffle; a hub's rows meet
    its one minimum in a join that is broadcast or split by size. Rounds grow with the logarithm of a component's diameter.
    """
    edges, before = common.durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        both = edges.union(edges.select("v", "u"))
        up = common.durable(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = common.durable(both.join(up, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = common.durable(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(low, "u")
        small = common.durable(hung.select("u", F.col("m").alias("v")).union(hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        for past in (edges, up, large, low):
            common.discard(past)
        edges = small
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = now
