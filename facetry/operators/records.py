"""Record level operators: dedupe, merge, upsert, pending work, id correction, groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions.keys import entity_key, trim_all
from facetry.operators.ordering import top_k_per_group, with_position
from facetry.runtime import scalar


def dedupe_richest(entities: DataFrame, richness: DataFrame, seq_cols: Sequence[str],
                   name_col: str = "name", group_col: str = "group") -> DataFrame:
    """Per trimmed (name, group) the entity with most positive features; first in file order wins ties.

    rank = 1 is pruned per input partition, so many copies of one name cost one
    candidate per partition.
    """
    rows = (
        entities.join(richness.select("entity_id", "n_positive"), "entity_id", "left")
        .withColumn("n_positive", F.coalesce("n_positive", F.lit(0)))
        .withColumn("_name", trim_all(F.col(name_col)))
        .withColumn("_group", F.coalesce(trim_all(F.col(group_col).cast("string")), F.lit("")))
        .where(F.col("_name") != "")
    )
    best = top_k_per_group(rows, ["_name", "_group"], 1, F.desc("n_positive"), *[F.col(c) for c in seq_cols])
    return best.drop("_name", "_group", "rank")


def dedupe_heaviest(entities: DataFrame, seq_col: str, name_col: str = "name", weight_col: str = "weight") -> DataFrame:
    heavy = F.coalesce(F.col(weight_col), F.lit(0.0))
    return top_k_per_group(entities, [name_col], 1, heavy.desc(), F.col(seq_col)).drop("rank")


def sparsest_per_group(counts: DataFrame, supergroup_col: str, k: int = 5, below: int | None = 8, gaps: DataFrame | None = None) -> DataFrame:
    """Entities with the fewest features of each super-group (only those under ``below``).

    ``gaps`` (entity_id) are entities that fail the dimension test; they are reported there and take no part here.
    """
    thin = counts if below is None else counts.where(F.col("n_features") < below)
    thin = thin if gaps is None else thin.join(gaps.select("entity_id").distinct(), "entity_id", "left_anti")
    return top_k_per_group(thin, [supergroup_col], k, F.col("n_features"), F.col("name"), F.col("entity_id"))


def merge_extended(base: DataFrame, extended: DataFrame, fields: Sequence[str], key: str = "id",
                   seq_col: str | None = None) -> DataFrame:
    """Replace ``fields`` by those of the extension row with the same key; keep all else.

    The last extension row of a key wins (``seq_col``), so base rows never multiply.
    """
    order = F.col(seq_col).desc() if seq_col else F.lit(0)
    newest = top_k_per_group(extended, [key], 1, order, name="_rank")
    side = newest.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = base.join(side, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    columns = [F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
               for c in base.columns]
    columns += [F.col(f"_new_{f}").alias(f) for f in fields if f not in base.columns]
    return joined.select(*columns)


def pending(base: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return base.join(done.select(key), key, "left_anti")


def resume_guard(base: DataFrame, merged: DataFrame) -> DataFrame:
    """Whether an earlier merged state may be resumed: it must have as many rows as the base."""
    counts = base.agg(F.count(F.lit(1)).alias("base_rows"))
    return counts.withColumn("merged_rows", scalar(merged, F.count(F.lit(1)))).withColumn(
        "resumable", F.col("base_rows") == F.col("merged_rows"))


def upsert_by_key(rows: DataFrame, seq_col: str, *key_parts) -> DataFrame:
    """Newest row per key; the key is the first non-null of ``key_parts``."""
    keyed = rows.withColumn("upsert_key", F.coalesce(*key_parts))
    return top_k_per_group(keyed, ["upsert_key"], 1, F.desc(seq_col)).drop("rank")


def place_key(id_col="id", slug_col="slug", lat="lat", lon="lon", name="name"):
    """id, else slug, else ``lat|lon|name``."""
    return [F.col(id_col).cast("string"), F.col(slug_col),
            F.concat_ws("|", F.col(lat).cast("string"), F.col(lon).cast("string"), F.col(name))]


def correct_ids(entities: DataFrame, parts: Sequence[str], file_col: str = "file", id_col: str = "id", name_col: str = "name") -> DataFrame:
    """Rewrite ids from their name parts; a row without id or name, or without any part, keeps its id and is marked failed."""
    key, old = entity_key(*[F.col(p) for p in parts]), F.col(id_col).cast("string")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    failed = key.isNull() | blank(old) | blank(F.col(name_col).cast("string"))
    return entities.withColumn("new_id", F.when(failed, old).otherwise(key)).withColumn(
        "outcome", F.when(failed, "failed").when(key == old, "same").otherwise("updated"))


def failed_ids(corrected: DataFrame, file_col: str = "file", id_col: str = "id") -> DataFrame:
    """The rows whose id could not be corrected."""
    return corrected.where("outcome = 'failed'").select(file_col, id_col, "name")


def correction_report(corrected: DataFrame, file_col: str = "file") -> DataFrame:
    return corrected.groupBy(file_col).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") == "updated").alias("updated"),
        F.count_if(F.col("outcome") == "failed").alias("failed"))


def group_by_country(entities: DataFrame, group_col: str = "group") -> DataFrame:
    return entities.groupBy(F.coalesce(F.col(group_col).cast("string"), F.lit("UNKNOWN")).alias("group")).agg(
        F.count(F.lit(1)).alias("entities"))


def with_place_group(entities: DataFrame, group_col: str = "group") -> DataFrame:
    return entities.withColumn(group_col, F.coalesce(F.col(group_col).cast("string"), F.lit("UNKNOWN")))


def nested_groups(entities: DataFrame, country: str, city: str, place: str, part: int = 1000) -> DataFrame:
    """country -> city -> places: (country, city, part, places, n_places), places in order.

    A city of more than ``part`` places has several rows with ``part`` of them each, so no
    list outgrows a row; ``n_places`` counts all of the city's.  Rows come clustered by
    country and in order, so a writer can stream the nested document.
    """
    placed = with_position(entities.select(country, city, place), F.col(country), F.col(city), F.col(place), name="_pos")
    starts = placed.groupBy(F.col(country).alias("_country"), F.col(city).alias("_city")).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("n_places"))
    same = [F.col(country).eqNullSafe(F.col("_country")), F.col(city).eqNullSafe(F.col("_city"))]
    rows = placed.join(starts, same).select(country, city, F.floor((F.col("_pos") - F.col("_first")) / part).alias("part"), "_pos", place, "n_places")
    lists = rows.groupBy(country, city, "part", "n_places").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", place))), lambda s: s[place]).alias("places"))
    return lists.select(country, city, "part", "places", "n_places").repartitionByRange(F.col(country), F.col(city), F.col("part")).sortWithinPartitions(country, city, "part")


def members_of_group(entities: DataFrame, group_col: str, group: str, name_col: str = "name") -> DataFrame:
    return entities.where(F.col(group_col) == group).orderBy(name_col)


def name_lookup(rows: DataFrame, names: DataFrame, key: str, name_col: str = "name") -> DataFrame:
    """Display name of a code, the code itself when unknown."""
    side = names.groupBy(F.col(key).alias("_code")).agg(F.min(name_col).alias("_name"))
    return rows.join(side, F.col(key) == F.col("_code"), "left").withColumn(
        f"{key}_name", F.coalesce("_name", F.col(key).cast("string"))).drop("_code", "_name")


def new_keys(seen: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct keys that the catalogue lacks."""
    return seen.select("kind", "feature").distinct().join(catalog, ["kind", "feature"], "left_anti")


def grow_catalog(seen: DataFrame, catalog: DataFrame) -> DataFrame:
    return catalog.select("kind", "feature").unionByName(seen.select("kind", "feature")).distinct()


def project_metadata(entities: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return entities.select(*[c for c in wanted if c in entities.columns])


select_fields = project_metadata


def fingerprint(document):
    """First 12 hex digits of the md5 of a document (a struct whose fields are sorted by name)."""
    return F.substring(F.md5(F.to_json(document)), 1, 12)


def fingerprint_check(artifact: DataFrame, recorded: DataFrame) -> DataFrame:
    """The artifact row with a verified fingerprint; fails the job when it differs."""
    expected = scalar(recorded, F.max("hash"))
    return artifact.where(F.assert_true(F.col("hash") == expected, F.lit("fingerprint differs")).isNull())


def with_processed_at(rows: DataFrame, name: str = "extended_at") -> DataFrame:
    """One UTC time stamp per query."""
    return rows.withColumn(name, F.current_timestamp())
