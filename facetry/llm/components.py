"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import stored


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("v").agg(F.min("u").alias("_least")).select(F.col("v").alias("_v"), F.least("_v", "_least").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node on its least one, then the smaller ones."""
    both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    large = both.where("u > v").join(_least(both), F.col("v") == F.col("_v")).select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
    # every edge now points to a smaller node
    down = large.where("u < v")
    least = _least(down)
    small = down.join(least, F.col("v") == F.col("_v")).select("v", "u", "m")
    return small.select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").unionByName(small.select("v", F.col("m").alias("u"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """v, root (the least node of its component) for every node with an edge (v, u), itself left out as its own root.

    A round is two partial minima and two joins; neighbours are never gathered, so a hub
    of any degree is only a skewed join.  Each round is written to the shared folder.
    """
    now = stored(edges.where("v <> u").select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct(), name)
    mark = _mark(now)
    while mark[0]:
        after = stored(_round(now), name)
        new = _mark(after)
        now = after
        if new == mark:
            break
        mark = new
    return now.select("v", F.col("u").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0)).alias("x"), F.countDistinct("v").alias("d")).first()
    return row["n"], row["x"], row["d"]
