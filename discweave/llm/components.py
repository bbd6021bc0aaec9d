"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discweave.llm.common import Workspace


def star_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge, component being the smallest node it reaches.

    ``edges`` has columns u and v of one ordered type; loops, repeated edges and null ends are
    dropped. Each half of a round is one plan written to the shared folder, so that the driver never
    holds a large plan: large-star hangs a node's larger neighbours on its smallest one, small-star
    the smaller ones. A table that a round
    leaves as it was is a set of stars, and rounds go on until then. A node with many neighbours
    costs rows, never memory. No edges give no rows.
    """
    spark = edges.sparkSession
    work = Workspace(spark, "components")

    def written(df: DataFrame, n: int) -> tuple[DataFrame, tuple]:
        back = work.put(df, str(n))
        return back, tuple(back.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    def hung(df: DataFrame) -> DataFrame:
        """Edges (u, v): v and u itself hang on the smallest of them."""
        least = df.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return df.join(least, "u")

    pairs = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = written(pairs, 0)
    before, n = None, 0
    while seen[0] and seen != before:
        n += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = work.put(hung(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"large-{n}")
        small = hung(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before = seen
        now, seen = written(small, n)
        work.drop(str(n - 1), f"large-{n}")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    stars = work.put(leaves.unionByName(leaves.select("component").distinct().select(F.col("component").alias("node"), "component")), "stars")
    work.drop(str(n))
    return stars
