"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.common import ascii_lower, row_key, stored, text_of

#: Items up to this many shingles are broadcast; beyond it Spark joins by shuffle.
BROADCAST_SHINGLES = 500_000
#: Words here are runs of letters, digits and everything beyond ASCII, so punctuation and line breaks do not hide a passage.
BLANKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), BLANKS), lambda w: w != "")


def shingle_hashes(rows: DataFrame, keep: list[str], size: int) -> DataFrame:
    """``keep`` and one row ``shingle`` for each run of ``size`` words; a shorter text is one shingle, one without words none.

    ``rows`` hold ``words``.  The positions are exploded, so hashing runs in generated code.
    """
    n = F.size("words")
    last = F.greatest(F.lit(1), n - (size - 1))
    at = rows.select(*keep, "words", F.explode(F.when(n > 0, F.sequence(F.lit(1), last))).alias("_at"))
    parts = [F.get(F.col("words"), F.col("_at") + (i - 1)) for i in range(size)]
    # two hashes side by side: words of a short text run into nulls, which the hash skips
    return at.select(*keep, F.xxhash64(*parts).alias("shingle"))


def needed_hits(n: Column) -> Column:
    """Sketched shingles that a document must hold: one for items below 32 shingles, one more for each doubling from there on."""
    return F.greatest(F.lit(1), F.floor(F.log2(n.cast("double"))).cast("int") - 3)


def item_shingles(items: DataFrame, size: int, percent: int) -> DataFrame:
    """item_id, n (distinct shingles), shingle, need, sketched of every benchmark item.

    Items are partitioned by the power of two of their size n, which sets how many hits a
    candidate needs.  The sketch is the bottom of the MinHash order: the n - c + need
    smallest shingles (n at most), c = ceil(percent * n / 100).  A document that holds c
    of the item's shingles misses n - c at most, so it holds ``need`` sketched ones, and
    the search loses nothing.
    """
    rows = items.where("item_id IS NOT NULL").select("item_id", words(text_of()).alias("words"))
    once = shingle_hashes(rows, ["item_id"], size).distinct()
    item = Window.partitionBy("item_id")
    order = F.row_number().over(item.orderBy(F.xxhash64("shingle"), "shingle"))
    counted = once.withColumn("n", F.count(F.lit(1)).over(item)).withColumn("_r", order).withColumn("_c", F.ceil(F.lit(percent) * F.col("n") / 100))
    counted = counted.withColumn("need", F.least(needed_hits(F.col("n")), F.col("_c")).cast("int"))
    return counted.select("item_id", "n", "shingle", "need", (F.col("_r") <= F.col("n") - F.col("_c") + F.col("need")).alias("sketched"))


def _met(shingles: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """Document shingles beside the item shingles they equal; only those that meet one are shuffled while the items are few."""
    return shingles.join(F.broadcast(wanted) if small else wanted, "shingle")


def candidates(docs: DataFrame, wanted: DataFrame, size: int, small: bool) -> DataFrame:
    """row_key, item_id of the documents that hold as many sketched shingles of an item as it needs; ``wanted`` as of ``item_shingles``."""
    rows = docs.select(row_key().alias("row_key"), words(text_of()).alias("words"))
    sketch = wanted.where("sketched").select("item_id", "need", "shingle")
    once = _met(shingle_hashes(rows, ["row_key"], size), sketch, small).distinct()
    return once.groupBy("row_key", "item_id", "need").agg(F.count(F.lit(1)).alias("hits")).where("hits >= need").select("row_key", "item_id")


def contained(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """row_key, doc_id, item_id, n_item, n_found for every document that holds ``percent`` of an item's shingles.

    Short items are sought in long documents: the documents' shingles stream past the
    sketches of the items, partitioned by size (see ``item_shingles``).  Documents that hold
    enough of a sketch are candidates; only their texts are read again, and each candidate
    pair is verified by its exact number of shingles.

    Null or empty texts and items hold nothing; items with fewer than ``size`` words are
    one shingle and match documents of just these words; copies of a document are found
    each; an item given twice is found once; empty tables give no pairs.
    """
    wanted = stored(item_shingles(items, size, percent), "leak-items")
    small = wanted.count() <= BROADCAST_SHINGLES
    found = stored(candidates(docs, wanted, size, small), "leak-candidates")
    rows = docs.select("doc_id", row_key().alias("row_key"), "text").join(found.select("row_key").distinct(), "row_key", "left_semi")
    asked = wanted.join(found.select("item_id").distinct(), "item_id", "left_semi").select("item_id", "n", "shingle")
    own = shingle_hashes(rows.select("doc_id", "row_key", words(text_of()).alias("words")), ["row_key", "doc_id"], size)
    once = _met(own, asked, small).join(found, ["row_key", "item_id"], "left_semi").distinct()
    pairs = once.groupBy("row_key", "doc_id", "item_id", "n").agg(F.count(F.lit(1)).alias("n_found"))
    return pairs.where(F.col("n_found") * 100 >= F.col("n") * percent).select("row_key", "doc_id", "item_id", F.col("n").alias("n_item"), "n_found")
