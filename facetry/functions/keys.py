"""Feature keys, entity keys and labels as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trim_all(key: Column) -> Column:
    """Strip every kind of leading and trailing white space, not only blanks."""
    return F.regexp_replace(key, r"(?U)^\s+|\s+$", "")


def canonical_key(key: Column) -> Column:
    return F.lower(trim_all(key))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Every BMP letter whose compatibility form is one ASCII letter or digit."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        letter = chr(code)
        base = "".join(
            c for c in unicodedata.normalize("NFKD", letter) if not 0x300 <= ord(c) <= 0x36F
        ).lower()
        if len(base) == 1 and base.isascii() and base.isalnum():
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


def fold_accents(text: Column) -> Column:
    source, target = _accent_table()
    return F.regexp_replace(F.translate(text, source, target), r"[̀-ͯ]", "")


@F.pandas_udf(T.StringType())
def _nfkd(text: pd.Series) -> pd.Series:
    """Exact compatibility decomposition (ligatures expand to several letters)."""
    plain = text.str.normalize("NFKD")
    return plain.str.replace("[̀-ͯ]", "", regex=True)


def slug_key(key: Column, exact: bool = False) -> Column:
    """Lower-case ASCII slug.  ``exact`` also expands ligatures, through Arrow."""
    lowered = canonical_key(key)
    plain = _nfkd(lowered) if exact else fold_accents(lowered)
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def entity_key(*parts: Column) -> Column:
    """Join the non-empty parts with ``__``; null when every part is empty."""
    filled = [F.nullif(trim_all(p.cast("string")), F.lit("")) for p in parts]
    joined = F.lower(F.concat_ws("__", *filled))
    return F.nullif(F.regexp_replace(joined, r"(?U)\s+", "_"), F.lit(""))


def city_id(name: Column, state: Column, country: Column) -> Column:
    return F.concat(name, F.lit("-"), state, F.lit("-"), country)


def pretty_label(key: Column) -> Column:
    return F.initcap(F.translate(key, "_-", "  "))


def family_label(first: Column, second: Column, number: Column) -> Column:
    """``A & B``, else ``A``, else ``Cluster n``."""
    return F.coalesce(
        F.concat(pretty_label(first), F.lit(" & "), pretty_label(second)),
        pretty_label(first),
        F.concat(F.lit("Cluster "), (number + 1).cast("string")),
    )


def with_alias(
    df: DataFrame, alias: DataFrame, key_col: str = "feature", kind_col: str | None = "kind",
    out_col: str = "feature",
) -> DataFrame:
    """One-hop alias lookup with identity default.

    The alias table is a plain join side: Spark broadcasts it while it is below
    the session's size limit and shuffles it otherwise.  A table with several
    targets for one raw key takes the smallest, so that rows never multiply.
    """
    keys = ["raw_key"] + (["kind"] if kind_col else [])
    names = alias.groupBy(*keys).agg(F.min("canonical").alias("_canonical"))
    names = names.withColumnRenamed("raw_key", "_raw")
    cond = F.col("_k") == F.col("_raw")
    if kind_col:
        names = names.withColumnRenamed("kind", "_alias_kind")
        cond = cond & (F.col(kind_col) == F.col("_alias_kind"))
    joined = df.withColumn("_k", canonical_key(F.col(key_col))).join(names, cond, "left")
    return joined.withColumn(out_col, F.coalesce("_canonical", "_k")).drop(
        "_k", "_raw", "_canonical", "_alias_kind"
    )


def resolve_to_schema_key(
    df: DataFrame, alias: DataFrame, key_col: str = "feature", kind_col: str = "kind",
    entity_col: str = "entity_id", score_col: str = "score",
) -> DataFrame:
    """Map answer keys to catalogue keys: reverse alias, then alias, then itself.

    Non-finite scores are dropped; when two keys meet, the larger score stays,
    limited to 1 only in that case.
    """
    pairs = alias.where(F.col("raw_key") != F.col("canonical"))
    back = pairs.groupBy("kind", F.col("canonical").alias("_key")).agg(
        F.max("raw_key").alias("_back"))
    forward = alias.groupBy("kind", F.col("raw_key").alias("_key")).agg(
        F.min("canonical").alias("_forward"))
    finite = F.col(score_col).isNotNull() & ~F.isnan(score_col) & (
        F.abs(F.col(score_col)) < F.lit(float("inf")))
    rows = df.where(finite).withColumn("_key", F.col(key_col)).withColumn("kind", F.col(kind_col))
    named = (
        rows.join(back, ["kind", "_key"], "left")
        .join(forward, ["kind", "_key"], "left")
        .withColumn("_name", F.coalesce("_back", "_forward", "_key"))
    )
    merged = named.groupBy(entity_col, "kind", F.col("_name").alias(key_col)).agg(
        F.max(score_col).alias("_max"), F.count(F.lit(1)).alias("_n"))
    return merged.select(
        entity_col, "kind", key_col,
        F.when(F.col("_n") > 1, F.least(F.lit(1.0), F.col("_max"))).otherwise(F.col("_max"))
        .alias(score_col))


def outside_catalogue(resolved: DataFrame, catalog: DataFrame, key_col: str = "feature") -> DataFrame:
    """Keys that ``resolve_to_schema_key`` leaves outside the catalogue: (kind, key, entities, best), counted once an entity."""
    known = catalog.select("kind", F.col("feature").alias(key_col)).distinct()
    return resolved.join(known, ["kind", key_col], "left_anti").groupBy("kind", key_col).agg(
        F.count(F.lit(1)).alias("entities"), F.max("score").alias("best"))
