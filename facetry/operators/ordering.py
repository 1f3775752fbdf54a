"""Global positions, order statistics, paging and bounded lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.functions.color import count_below
from facetry.runtime import reliable, scalar


def with_position(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """0-based rank of every row in a global order.

    One range exchange sorts the rows; a row's number inside its partition plus
    the sizes of the partitions before it is its rank.  No task ever sees more
    than one range, and a total order (end it with an id) splits hot values.
    The sorted rows are materialised so that both reads see the same ranges.
    """
    numbered = reliable(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()))
    part = F.shiftright("_slot", 33).alias("_part")
    sizes = numbered.groupBy(part).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: the window is bounded by the partition count
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    local = F.col("_slot").bitwiseAND((1 << 33) - 1)
    return (
        numbered.withColumn("_part", F.shiftright("_slot", 33))
        .join(F.broadcast(starts), "_part")  # one row per partition
        .withColumn(name, F.col("_start") + local)
        .drop("_part", "_slot", "_start")
    )


_STRIDE = 4096
_PRIOR = (Window.unboundedPreceding, -1)


def order_statistics(df: DataFrame, axis_col: str, value_col: str, ranks: Column) -> DataFrame:
    """Exact order statistics per axis at the 0-based ``ranks`` (ascending array over ``n``).

    Equal values are counted before the sort, so a value held by most rows is
    one row in it.  Sorted values fall into runs of 4096; the runs that hold an
    asked rank are found on the table of run sums, and only their rows are read
    again.  Returns (axis, slot, rank, value).
    """
    counted = df.where(F.col(value_col).isNotNull()).groupBy(axis_col, value_col).agg(
        F.count(F.lit(1)).alias("_copies"))
    placed = reliable(with_position(counted, F.col(axis_col), F.col(value_col), name="_pos").withColumn(
        "_run", F.floor(F.col("_pos") / _STRIDE)))
    runs = _run_starts(placed.groupBy(axis_col, "_run").agg(F.sum("_copies").alias("_sum")), axis_col)
    sizes = placed.groupBy(axis_col).agg(F.sum("_copies").alias("n"))
    wanted = reliable(sizes.select(axis_col, ranks.alias("_ranks")))
    asked = F.array_distinct("_ranks")
    first = count_below(F.col("_asked"), F.col("_run_from"))
    last = count_below(F.col("_asked"), F.col("_run_from") + F.col("_sum"))
    hits = (
        runs.join(wanted.select(axis_col, asked.alias("_asked")), axis_col)
        .withColumn("_hits", F.slice("_asked", first + 1, last - first))
        .where(F.size("_hits") > 0)
        .select(axis_col, "_run", "_run_from", "_hits")
    )
    inside = Window.partitionBy(axis_col, "_run").orderBy("_pos").rowsBetween(*_PRIOR)
    rows = placed.join(hits, [axis_col, "_run"]).withColumn(
        "_from", F.col("_run_from") + F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    mine = F.filter("_hits", lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_copies")))
    found = rows.select(axis_col, F.explode(mine).alias("rank"), F.col(value_col).alias("value"))
    slots = wanted.select(axis_col, F.posexplode("_ranks").alias("slot", "rank"))
    return slots.join(found, [axis_col, "rank"])


def _run_starts(runs: DataFrame, axis_col: str) -> DataFrame:
    """Rows before each run of its axis; a second level of runs keeps every window short."""
    upper = runs.withColumn("_super", F.floor(F.col("_run") / _STRIDE))
    tops = upper.groupBy(axis_col, "_super").agg(F.sum("_sum").alias("_top"))
    over_tops = Window.partitionBy(axis_col).orderBy("_super").rowsBetween(*_PRIOR)
    tops = tops.select(axis_col, "_super", F.coalesce(F.sum("_top").over(over_tops), F.lit(0)).alias("_base"))
    over_runs = Window.partitionBy(axis_col, "_super").orderBy("_run").rowsBetween(*_PRIOR)
    return upper.join(tops, [axis_col, "_super"]).select(
        axis_col, "_run", "_sum",
        (F.col("_base") + F.coalesce(F.sum("_sum").over(over_runs), F.lit(0))).alias("_run_from"))


def axis_quantiles(df: DataFrame, axis_col: str, value_col: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles per axis: (axis, p, value)."""
    probs = F.array(*[F.lit(float(p)) for p in probabilities])
    place = lambda p: (F.col("n") - 1) * p
    ranks = F.flatten(F.transform(probs, lambda p: F.array(
        F.floor(place(p)).cast("bigint"), F.ceil(place(p)).cast("bigint"))))  # ascending with p
    stats = order_statistics(df, axis_col, value_col, ranks)
    sizes = df.where(F.col(value_col).isNotNull()).groupBy(axis_col).agg(F.count(F.lit(1)).alias("n"))
    at = F.floor(F.col("slot") / 2).cast("int")
    ends = stats.groupBy(axis_col, at.alias("_i")).agg(
        F.min("value").alias("_low"), F.max("value").alias("_high"))
    p = F.element_at(probs, F.col("_i") + 1)
    share = place(p) - F.floor(place(p))
    return ends.join(sizes, axis_col).select(
        axis_col, p.alias("p"),
        (F.col("_low") + (F.col("_high") - F.col("_low")) * share).alias("value"))


def cdf_points(df: DataFrame, axis_col: str, value_col: str, buckets: int = 512) -> DataFrame:
    """Empirical CDF per axis: the value at rank floor(i (n-1) / (buckets-1)), (axis, slot, value)."""
    ranks = F.transform(
        F.sequence(F.lit(0), F.lit(buckets - 1)),
        lambda i: F.floor(i * (F.col("n") - 1) / F.lit(float(buckets - 1))).cast("bigint"))
    return order_statistics(df, axis_col, value_col, ranks).select(axis_col, "slot", "value")


def rank_no_ties(df: DataFrame, value_col: str, id_col: str, name: str = "rank") -> DataFrame:
    """1-based global rank in which equal values are ordered by id, not averaged."""
    return with_position(df, F.col(value_col), F.col(id_col), name=name).withColumn(name, F.col(name) + 1)


def spearman(df: DataFrame, x_col: str, y_col: str, id_col: str, min_pairs: int = 30,
             pass_at: float = 0.25, fail_below: float = 0.15) -> DataFrame:
    """Rank correlation of two columns with its gate: pass, warn, fail or skip."""
    ranked = rank_no_ties(rank_no_ties(df, x_col, id_col, "_rx"), y_col, id_col, "_ry")
    stats = ranked.agg(F.count(F.lit(1)).alias("pairs"),
                       F.corr(F.col("_rx").cast("double"), F.col("_ry").cast("double")).alias("rho"))
    rho = F.coalesce(F.col("rho"), F.lit(0.0))
    status = (F.when(F.col("pairs") < min_pairs, "skip").when(rho >= pass_at, "pass")
              .when(rho >= fail_below, "warn").otherwise("fail"))
    return stats.select("pairs", rho.alias("rho"), status.alias("status"))


def chunk_ids(df: DataFrame, chunks: int, *order: Column) -> DataFrame:
    """``chunks`` consecutive runs of ceil(n / chunks) rows; the last may be short."""
    placed = reliable(with_position(df, *order))
    size = F.ceil(scalar(placed, F.count(F.lit(1))) / F.lit(chunks))
    return placed.withColumn("chunk", F.floor(F.col("position") / size))


def split_batches(df: DataFrame, size: int, *order: Column) -> DataFrame:
    """Consecutive batches of ``size`` rows as a ``batch_id`` column."""
    placed = with_position(df, *order)
    return placed.withColumn("batch_id", F.floor(F.col("position") / size))


def page(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_stats(df: DataFrame, limit: int, offset: int) -> DataFrame:
    """Total rows, number of this page and number of pages."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return total.select(
        "total",
        F.lit(offset // limit + 1).cast("bigint").alias("page"),
        F.ceil(F.col("total") / F.lit(limit)).cast("bigint").alias("total_pages"))


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First n rows of an order (also the worst-n lists): TakeOrderedAndProject."""
    return df.orderBy(*order).limit(n)


def top_k_per_group(df: DataFrame, group: Sequence[str], k: int, *order: Column, name: str = "rank") -> DataFrame:
    """Rank at most k per group; Spark prunes each input partition to k before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def capped_list(df: DataFrame, group: Sequence[str], value_col: str, shown: int, *order: Column) -> DataFrame:
    """Text list of the first ``shown`` values per group with "+n more"."""
    totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    first = top_k_per_group(df, group, shown, *order, name="_rank").groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("_rank", value_col))).alias("_shown"))
    text = F.concat_ws(", ", F.transform("_shown", lambda s: s[value_col].cast("string")))
    more = F.col("_n") - shown
    return totals.join(first, list(group)).select(
        *group, F.col("_n").alias("total"),
        F.when(more > 0, F.concat(text, F.lit(" +"), more.cast("string"), F.lit(" more")))
        .otherwise(text).alias("listing"))
