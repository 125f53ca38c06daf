"""Connected components of links that only a cluster can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_evenly, written


def _signature(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def _least_of(links: DataFrame) -> DataFrame:
    """For each u, the smallest of it and its neighbours, and how many there are."""
    low = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return low.withColumn("m", F.least("u", "m"))


def connected(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``links`` (two long columns) to one row (node, root) per node; root: smallest node reachable.

    Large-star and small-star steps alternate until the links stand still. Each step is an
    aggregate and a join on the node; nodes with very many links are joined by broadcast, so a hub's
    links stay where they are. Every step is written to the shared folder. Links with a null end and
    links from a node to itself say nothing and are left out.
    """
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"), F.col(u).isNotNull().alias("a"), F.col(v).isNotNull().alias("b"))
    edges = written(edges.where("a and b and u != v").select("u", "v").distinct(), "links")
    before = _signature(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(_least_of(both), "least")
        # large star: all larger neighbours are hung under the smallest one
        hung = joined_evenly(both.where("v > u"), low.select("u", "m"), ["u"], low.select("u", "n"), 2 * before[0])
        large = written(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "links")
        # small star: smaller neighbours and the node itself go under the smallest of them
        low = written(_least_of(large), "least")
        hung = joined_evenly(large, low.select("u", "m"), ["u"], low.select("u", "n"), before[0])
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionAll(low.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "links")
        now = _signature(edges)
        if now == before:
            break
        before = now
    root = edges.groupBy("u").agg(F.min("v").alias("root"))
    tops = root.select(F.col("root").alias("node")).distinct()
    return root.select(F.col("u").alias("node"), "root").unionAll(tops.select("node", F.col("node").alias("root")))
