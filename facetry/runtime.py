"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    A cluster names it in ``spark.checkpoint.dir``.  In local mode, where driver and
    tasks share one machine, a private folder is made when nothing is named; anywhere
    else its absence is an error, for other machines would not see such a folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = named or tempfile.mkdtemp(prefix="spark-facetry-")
    sc.setCheckpointDir(folder)
    return folder


def reliable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on shared storage and cut its lineage.

    Used where a result is read more than once or where an iteration would
    otherwise grow the plan; survives the loss of executors.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scalar(df: DataFrame, expr: Column) -> Column:
    """One aggregate value of ``df`` as an uncorrelated scalar subquery.

    This is how a dataset-level number (row count, calibration row) reaches
    every row without a join; always exactly one row, whatever the data size.
    """
    return df.agg(expr.alias("value")).scalar()


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def total(agg: Column) -> Column:
    """Null-free sum for joins that may find no partner."""
    return F.coalesce(agg, F.lit(0.0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)
