"""Quantiles of many groups from mergeable KLL sketches, beside the exact ones of ``ordering``.

A sketch is one small binary value a group.  Sketches of parts of the data, of earlier runs
or of finer groups merge into the sketch of the whole without reading rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size parameter: a sketch holds a few times as many values, and its rank error is about 1.3 % at 200.
SIZE = 200


def rank_error(size: int = SIZE) -> float:
    """Rank error of one quantile, as a share of the rows, that 99 of 100 sketches of this size keep (fixed values of the sketch's authors)."""
    return 2.296 / size ** 0.9021


def axis_sketches(df: DataFrame, axis_col: str, value_col: str, size: int = SIZE) -> DataFrame:
    """(axis, sketch, n): one sketch a group by a partial aggregate; null values are left out."""
    rows = df.where(F.col(value_col).isNotNull()).select(axis_col, F.col(value_col).cast("double").alias("_v"))
    return rows.groupBy(axis_col).agg(F.kll_sketch_agg_double("_v", size).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged_sketches(sketches: DataFrame, axis_col: str) -> DataFrame:
    """Sketches of several parts of the data or of finer groups as one a group."""
    return sketches.groupBy(axis_col).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, axis_col: str, probabilities: Sequence[float]) -> DataFrame:
    """(axis, p, value) for every probability."""
    each = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in probabilities])
    return sketches.select(axis_col, F.explode(each).alias("_q")).select(axis_col, F.col("_q.p").alias("p"), F.col("_q.value").alias("value"))


def rank_errors(df: DataFrame, axis_col: str, value_col: str, quantiles: DataFrame) -> DataFrame:
    """(axis, p, value, error): distance of p from the range of ranks that the value has among all rows of its group.

    One pass over the rows: each group's few quantiles travel as an array and are counted side by side.
    """
    asked = quantiles.groupBy(axis_col).agg(F.array_sort(F.collect_list(F.struct("p", "value"))).alias("_q"))  # one entry a probability
    rows = df.where(F.col(value_col).isNotNull()).select(axis_col, F.col(value_col).cast("double").alias("_v")).join(asked, axis_col)
    counted = rows.select(axis_col, "_v", F.explode("_q").alias("_q")).groupBy(axis_col, F.col("_q.p").alias("p"), F.col("_q.value").alias("value")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_v") < F.col("_q.value")).alias("_below"), F.count_if(F.col("_v") <= F.col("_q.value")).alias("_upto"))
    low, high = F.col("_below") / F.col("_n"), F.col("_upto") / F.col("_n")
    return counted.select(axis_col, "p", "value", F.greatest(low - F.col("p"), F.col("p") - high, F.lit(0.0)).alias("error"))
