"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apertura.llm.shared import written


def _large(edges: DataFrame) -> DataFrame:
    """Points each larger neighbour of a node at the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Points a node and its smaller neighbours at the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component``: for each node of an edge that reaches a smaller one, the smallest node it reaches.

    The smallest node of a component, like a node without edges, has no row.
    ``edges`` has the columns u and v of an ordered type; rows with a null are ignored. Each round reads and
    writes the edge table in the shared folder; the number of rounds grows with the logarithm of the size.
    """
    now, before = written(edges.where("u != v").select("u", "v").distinct(), name), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        now = written(_small(_large(now)), name, instead=now)
