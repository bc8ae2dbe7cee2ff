"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Table


def connected_components(edges: DataFrame, most: int | None = None) -> Table:
    """(u, v): every node that has an edge to another node and is not the
    smallest of its component, with the smallest as v. most: the number of
    edges, where it is known.

    Large-star and small-star steps alternate until all components are stars;
    every step is written, so that a lost executor costs one step at most.
    Nothing but three counts comes to the driver.
    """
    now = Table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges", most)
    while True:
        centres = now.df.select(F.col("v").alias("u"), F.lit(1).alias("centre")).distinct()
        n, nodes, both = now.df.join(centres, "u", "left").groupBy("u").agg(F.count("*").alias("n"), F.max("centre").alias("c")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count("c")).first()
        if n == nodes and not both:
            return now
        ways = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = ways.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        step = Table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges", 2 * n)
        now.drop()
        now = step
