"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import row_key, text_of
from facetry.operators.ordering import with_position

#: Added in each round, and the two odd multipliers of the round function.
ROUND_ADD = (0x1B873593, 0x0CC9E2D5, 0x3C6EF372, 0x2545F491)
MULTIPLY = (0x2C1B3C6D, 0x297A2D39)
WORD32 = 0xFFFFFFFF
#: Steps of a walk: below 4096 rows no walk can be longer, above it one step leaves the numbers with a chance under 1/64.
WALK = 64


def sides(n: int) -> tuple[int, int]:
    """The smallest near-square a x b that holds n numbers; less than a of them lie outside 0..n-1."""
    a = max(1, int(n ** 0.5))
    while a * a < n:
        a += 1
    return a, max(1, -(-n // a))


def _round(x: Column, r: int, seed: int) -> Column:
    h = ((x + F.lit((ROUND_ADD[r] + seed) & 0x7FFFFFFF)) * F.lit(MULTIPLY[0])).bitwiseAND(F.lit(WORD32))
    h = h.bitwiseXOR(F.shiftright(h, 15))
    h = (h * F.lit(MULTIPLY[1])).bitwiseAND(F.lit(WORD32))
    return h.bitwiseXOR(F.shiftright(h, 13))


def feistel(x: Column, n: int, seed: int) -> Column:
    """One application of the keyed permutation of 0..a*b-1: each round shifts one half by a hash of the other."""
    a, b = sides(n)

    def halves(left: Column, right: Column) -> Column:
        return F.struct(left.alias("l"), right.alias("r"))

    def even(r: int):
        return lambda s: halves((s["l"] + _round(s["r"], r, seed)) % F.lit(a), s["r"])

    def odd(r: int):
        return lambda s: halves(s["l"], (s["r"] + _round(s["l"], r, seed)) % F.lit(b))

    state = halves(((x - x % F.lit(b)) / F.lit(b)).cast("bigint"), x % F.lit(b))
    for r in range(len(ROUND_ADD)):
        step = even if r % 2 == 0 else odd
        state = F.element_at(F.transform(F.array(state), step(r)), 1)
    return F.element_at(F.transform(F.array(state), lambda s: s["l"] * F.lit(b) + s["r"]), 1)


def permuted(x: Column, n: int, seed: int = 0) -> Column:
    """Reproducible permutation of 0..n-1: where the Feistel step leaves the numbers, its cycle is walked until it returns."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel(x, n, seed),
                       lambda p, _: F.when(p < F.lit(n), p).otherwise(feistel(p, n, seed)))


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """Every row of ``docs`` with its global number, place in the shuffled order, shard and slot.

    Numbers follow (doc_id, size, crc, key), null ids first; the permuted number p gives
    shard p mod ``shards`` and slot p div ``shards``, so any reader computes where a row
    went, counts differ by one at most and slots have no gaps.  Law ``rows``.

    A null text has size 1 and the crc of no bytes; equal rows get different numbers,
    in either order; an empty table gives no rows.  Only keys are sorted, not texts.
    Returns row_key, doc_id, size, text_crc32, row_number, place, shard, slot.
    """
    keys = docs.select(row_key().alias("row_key"), F.col("doc_id"), (F.octet_length(text_of()) + F.lit(1)).cast("bigint").alias("size"),
                       F.crc32(F.encode(text_of(), "UTF-8")).alias("text_crc32"))
    numbered = with_position(keys, F.asc_nulls_first("doc_id"), F.asc("size"), F.asc("text_crc32"), F.asc("row_key"), name="row_number")
    n = numbered.count()
    place = permuted(F.col("row_number"), max(1, n), seed)
    return (numbered.withColumn("place", place)
            .withColumn("shard", (F.col("place") % shards).cast("int"))
            .withColumn("slot", F.expr(f"place div {shards}")))
