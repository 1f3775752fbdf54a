"""Score predicates and map or vector coercions as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative gap below which two values differ by rounding alone.
TIE = 1e-12
from pyspark.sql import types as T

# Scores that mark machine-filled data.
FILLER_SCORE = 0.44
FILLER_TOLERANCE = 0.0005
FILLER_SET = (0.44, 0.4656, 0.4386, 0.4325, 0.4086, 0.3694, 0.3256, 0.2944, 0.45, 0.35)

_NUMBER_TYPES = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"
_NUMBER_OR_BOOL = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$"


def variant_number(value: Column, allow_bool: bool = True) -> Column:
    """The double behind a variant when it is a JSON number, else null.

    ``allow_bool`` keeps the compatibility rule that ``true`` counts as 1.
    """
    kind = F.schema_of_variant(value)
    pattern = _NUMBER_OR_BOOL if allow_bool else _NUMBER_TYPES
    return F.when(kind.rlike(pattern), F.try_variant_get(value, "$", "double"))


def raw_variant(df: DataFrame, name: str) -> Column:
    """A raw score with its JSON type: a variant as it is, JSON text parsed (``0.5`` is a number, ``"0.5"`` is text), a number as itself."""
    kind = df.schema[name].dataType
    value = F.col(name)
    if isinstance(kind, T.VariantType):
        return value
    if isinstance(kind, T.StringType):
        return F.try_parse_json(value)
    return F.try_parse_json(value.cast("string"))


def positive_numeric(value: Column, allow_bool: bool = True) -> Column:
    return F.coalesce(variant_number(value, allow_bool) > 0, F.lit(False))


def is_filler_tol(value: Column) -> Column:
    number = value.try_cast("double")
    return F.coalesce(F.abs(number - FILLER_SCORE) <= FILLER_TOLERANCE, F.lit(False))


def is_filler_set(value: Column, fillers: Iterable[float] = FILLER_SET) -> Column:
    return F.round(value, 4).isin([float(v) for v in fillers])


def coerce_scores(scores: Column) -> Column:
    """Keep numbers and numeric text of a ``map<string,string>``; empty becomes null."""
    numbers = F.transform_values(scores, lambda _, v: v.try_cast("double"))
    kept = F.map_filter(
        numbers,
        lambda _, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))),
    )
    return F.when(F.size(kept) > 0, kept)


def coerce_variant_scores(scores: Column) -> Column:
    """The same for ``map<string,variant>``: text such as ``"0.5"`` counts, booleans do not."""
    numbers = F.transform_values(
        scores,
        lambda _, v: F.when(
            F.schema_of_variant(v) != "BOOLEAN", F.try_variant_get(v, "$", "double")
        ),
    )
    kept = F.map_filter(numbers, lambda _, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def coerce_vector(text: Column) -> Column:
    """JSON text of an array of numbers, else null."""
    values = F.from_json(text, "array<double>")
    return F.when(F.forall(values, lambda v: v.isNotNull()), values)


def sort_map_desc(scores: Column) -> Column:
    """Entries as an array ordered by score (descending), then key."""
    entries = F.transform(
        F.map_entries(scores),
        lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("key"), e["value"].alias("score")),
    )
    return F.transform(
        F.array_sort(entries),
        lambda e: F.struct(e["key"].alias("key"), e["score"].alias("score")),
    )


def top_k_features(scores: Column, k: int) -> Column:
    return F.slice(sort_map_desc(scores), 1, k)


def drop_small_and_cap(scores: Column, k: int, minimum: float = 0.05) -> Column:
    return top_k_features(F.map_filter(scores, lambda _, v: v >= minimum), k)


def distance_score(distance: Column) -> Column:
    """Similarity percent of a distance, held between 3 and 99 (half rounds up)."""
    percent = F.floor((1 - distance / 35.0) * 100 + 0.5)
    return F.least(F.greatest(percent, F.lit(3)), F.lit(99))
