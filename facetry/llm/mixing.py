"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.common import WORD, row_key, stored, text_of

WEIGHTS = (3, 1, 2)
#: 2**32 divided by the golden ratio, to the nearest odd number.
GOLDEN = 2654435769
BEFORE = (Window.unboundedPreceding, -1)


def sized(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, source, size (words of the text) of every row."""
    return docs.select(row_key().alias("row_key"), "doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("bigint").alias("size"))


def targets(rows: DataFrame, percent: int = 150, repeats: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, weight, target: the share of every source, filled up like connected vessels.

    Sources that reach ``repeats`` times their size stop there; what they leave goes to
    the others by weight.  In the order of size / weight the full ones come first, so
    one pass over the table of sources finds the level.  One row per source: the windows
    here run over that table only.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    kinds = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.element_at(kinds, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    by = Window.orderBy((F.col("source_size") / F.col("weight")), F.asc_nulls_last("source"))
    whole = Window.partitionBy()
    full = F.coalesce(F.sum("source_size").over(by.rowsBetween(*BEFORE)), F.lit(0))
    rest = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("_top", F.lit(percent) * F.sum("source_size").over(whole) - F.lit(100 * repeats) * full).withColumn("_rest", rest)
    # level of the source, would it be the first that is not full
    per = per.withColumn("_level", F.when(F.col("weight") * F.col("_top") <= F.lit(100 * repeats) * F.col("source_size") * F.col("_rest"),
                                          F.col("_top") / (100 * F.col("_rest"))))
    first = F.first("_level", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.withColumn("target", F.least(F.coalesce(F.col("weight") * first, F.lit(float("inf"))), (repeats * F.col("source_size")).cast("double"))).select(
        "source", "source_size", "weight", "target")


def point(i: Column, total: Column) -> Column:
    """Word number of the i-th point of the golden-ratio sequence over ``total`` words."""
    h = (i % F.lit(1 << 31)) * F.lit(GOLDEN) % F.lit(1 << 32)
    return F.floor(h / F.lit(float(1 << 32)) * total).cast("bigint")


def schedule(per: DataFrame, block: int = 128, cells: int = 1024, chunk: int = 65536) -> DataFrame:
    """slot, source, rank: which source every slot of the mix draws from, and its how-manieth draw that is.

    Slots are the points of the golden-ratio sequence laid over the cumulative targets.
    Slots and source ranges meet in ``cells`` equal stretches.  Ranks come from counts per
    chunk of slots, so no source's slots are gathered in one place.
    """
    spark = per.sparkSession
    wide = per.select("source", F.round("target").cast("bigint").alias("_share")).where("_share > 0")
    order = Window.orderBy(F.asc_nulls_last("source"))
    ranges = wide.select("source", F.coalesce(F.sum("_share").over(order.rowsBetween(*BEFORE)), F.lit(0)).alias("_low"),
                         F.sum("_share").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_high"),
                         F.sum("_share").over(Window.partitionBy()).alias("_total"))
    total = wide.agg(F.coalesce(F.sum("_share"), F.lit(0)).alias("t")).first()["t"]
    slots = -(-total // block)
    cell = lambda x: F.floor(x / F.lit(float(max(1, total))) * cells).cast("int")
    stretched = ranges.withColumn("_cell", F.explode(F.sequence(cell(F.col("_low")), cell(F.col("_high") - 1))))
    drawn = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id"), F.lit(float(total))).alias("_at")).withColumn("_cell", cell(F.col("_at")))
    chosen = drawn.join(stretched, "_cell").where("_at >= _low AND _at < _high").select("slot", "source", F.expr(f"slot div {chunk}").alias("_chunk"))
    counts = chosen.groupBy("source", "_chunk").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("source").alias("_source"), F.col("_chunk").alias("_of"),
        F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_chunk").rowsBetween(*BEFORE)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("source", "_chunk").orderBy("slot")) - 1
    return chosen.withColumn("_within", within).join(
        counts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_chunk") == F.col("_of"))).select(
        "slot", "source", (F.col("_before") + F.col("_within")).alias("rank"))


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` with _start, the word at which the row begins in the shuffled stream of its source.

    Rows follow the digest of their id.  Sums run inside 4096 stretches of the digest per
    source and over the sums of the stretches, so a source of any size is split.
    """
    at = rows.withColumn("_digest", F.md5(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))).withColumn("_stretch", F.substring("_digest", 1, 3))
    sums = at.groupBy("source", "_stretch").agg(F.sum("size").alias("_n")).select(
        F.col("source").alias("_source"), F.col("_stretch").alias("_of"),
        F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_stretch").rowsBetween(*BEFORE)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source", "_stretch").orderBy("_digest", "size", "row_key").rowsBetween(*BEFORE)
    return at.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_stretch") == F.col("_of"))).withColumn(
        "_start", F.col("_before") + F.col("_within")).drop("_digest", "_stretch", "_source", "_of", "_before", "_within")


def mix_sources(docs: DataFrame, percent: int = 150, repeats: int = 2, weights: tuple[int, ...] = WEIGHTS, block: int = 128) -> DataFrame:
    """How many words of every row the mix takes.

    Every source's rows form a shuffled stream, cut into blocks of ``block`` words (the
    last one shorter).  The draw of rank r takes block r modulo the number of blocks, so
    a second pass begins only when every block was taken.  A row's ``taken`` is the sum
    of its words in the taken blocks, never above ``repeats`` times its size.

    A null text or one without words has size 0 and takes nothing; a null source is one
    source, the last; an empty table gives no rows; equal rows share their digest and lie
    side by side.  Reruns agree.
    Returns row_key, doc_id, size, source, source_size, target, taken.
    """
    rows = stored(sized(docs), "mix-sizes")  # texts are read once
    per = targets(rows, percent, repeats, weights)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(block)))
    takes = schedule(per, block).join(per.select(F.col("source").alias("_source"), blocks.alias("_blocks")), F.col("source").eqNullSafe(F.col("_source"))).where(
        F.col("rank") < repeats * F.col("_blocks")).groupBy("source", (F.col("rank") % F.col("_blocks")).alias("block")).agg(F.count(F.lit(1)).alias("times"))
    placed = shuffled(rows.where("size > 0"))
    first, last = F.expr(f"_start div {block}"), F.expr(f"(_start + size - 1) div {block}")
    pieces = placed.select("row_key", "doc_id", "size", "source", "_start", F.explode(F.sequence(first, last)).alias("_block"))
    words = F.least(F.col("_start") + F.col("size"), (F.col("_block") + 1) * block) - F.greatest(F.col("_start"), F.col("_block") * block)
    taken = pieces.join(takes.select(F.col("source").alias("_source"), F.col("block").alias("_of"), "times"),
                        F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_of")), "left").groupBy(
        "row_key", "doc_id", "source", "size", "_start").agg(F.coalesce(F.sum(words * F.col("times")), F.lit(0)).alias("taken"))
    every = taken.drop("_start").unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("bigint")))
    return every.join(per.select(F.col("source").alias("_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
