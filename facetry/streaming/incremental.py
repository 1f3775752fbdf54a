"""Incremental extension of records as Structured Streaming jobs.

State is a set of folders partitioned by batch number.  A batch writes only its
own partition and replaces it when it is run again, so a restart after a crash
neither loses nor doubles work; merged tables are views over the partitions.
``compact_stores`` and ``compact_latest`` turn many partitions into one
generation (see ``generations``), so reads do not slow down with the batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from facetry.functions.keys import slug_key
from facetry.functions.scores import variant_number
from facetry.operators import profiles, quality
from facetry.operators.ordering import top_k_per_group
from facetry.operators.records import merge_extended, new_keys, with_processed_at
from facetry.runtime import reliable
from facetry.streaming import generations

STORES = ("entities", "scores", "catalog", "proposals", "rejected")
CITY_FIELDS = "entity_id string, id string, name string, famous_dishes array<string>, extended_at timestamp"


@dataclass(frozen=True)
class Stores:
    """Folders of the incremental state below one root on shared storage."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"


def read_store(spark: SparkSession, stores: Stores, name: str, schema: str) -> DataFrame:
    """All batches of one store, or no rows before the first."""
    return generations.read(spark, stores.root, name, schema)


def first_batch(spark: SparkSession, checkpoint: str, paths: list[str]) -> int:
    """Number of the partition of a run's batch 0, kept with its checkpoint.

    A new checkpoint counts from 0 again; its partitions begin after all that earlier
    runs have written to the stores at ``paths`` or compacted, so it never replaces their state.
    """
    note = f"{checkpoint}/first_batch"
    if generations.exists(spark, note):
        return spark.read.schema("n bigint").json(note).first()["n"]
    # a store may be a root of generations itself or lie in one
    roots = {*paths, *(p.rstrip("/").rsplit("/", 1)[0] for p in paths)}
    last = max([*(generations.state(spark, r).upto for r in roots), *(n for p in paths for n in generations.batches(spark, p, ""))])
    spark.range(1).select(F.lit(last + 1).cast("bigint").alias("n")).coalesce(1).write.json(note)
    return last + 1


def parse_payloads(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(payload_id, payload text) -> cities, proposals, unreadable payloads."""
    parsed = payloads.withColumn("doc", F.try_parse_json("payload"))
    cities_v = F.try_variant_get("doc", "$.cities", "array<variant>")
    bad = parsed.where(F.col("doc").isNull() | cities_v.isNull()).select(
        "payload_id", "payload", F.when(F.col("doc").isNull(), "invalid_json").otherwise("missing_cities").alias("reason"))
    rows = parsed.where(cities_v.isNotNull()).select("payload_id", "doc", F.posexplode(cities_v).alias("pos", "city"))

    def text(field):
        value = F.try_variant_get("city", f"$.{field}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get("city", f"$.{field}", "string"))

    cities = rows.select(
        "payload_id", F.concat_ws("#", F.col("payload_id").cast("string"), F.col("pos").cast("string")).alias("entity_id"),
        F.lit(None).cast("string").alias("group"), text("id").alias("id"), text("name").alias("name"),
        F.try_variant_get("city", "$.ingredients", "map<string,variant>").alias("ingredients"),
        F.try_variant_get("city", "$.cookingMethods", "map<string,variant>").alias("methods"),
        F.try_variant_get("city", "$.famousDishes", "variant").alias("dishes"), text("extendedAt").alias("extended_at"))
    parts = None
    for field, kind in (("ingredients", "ing"), ("cookingMethods", "met")):
        part = parsed.select("payload_id", F.lit(kind).alias("kind"), F.posexplode(
            F.try_variant_get("doc", f"$.proposedNewKeys.{field}", "array<variant>")).alias("pos", "p"))
        parts = part if parts is None else parts.unionByName(part)
    get = lambda n: F.try_variant_get("p", f"$.{n}", "variant")
    proposals = parts.select(
        "payload_id", "kind", F.concat_ws("#", F.col("payload_id").cast("string"), "kind", F.col("pos").cast("string")).alias("entity_id"),
        F.lit(None).cast("string").alias("group"), get("key").alias("key"), get("mapTo").alias("map_to"),
        get("reason").alias("reason"), get("confidence").alias("confidence"))
    return cities, proposals, bad


def raw_scores(cities: DataFrame) -> DataFrame:
    """Long numeric scores of parsed rows: (entity_id, kind, feature, score)."""
    out = None
    for field, kind in (("ingredients", "ing"), ("methods", "met")):
        part = cities.select("entity_id", F.lit(kind).alias("kind"), F.explode(field).alias("feature", "_v")).select(
            "entity_id", "kind", "feature", variant_number(F.col("_v"), False).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("score").isNotNull())


def canonical_scores(scores: DataFrame, alias: DataFrame) -> DataFrame:
    """Slug, one-hop alias, then ingredients summed to at most 1 and methods by maximum."""
    names = alias.groupBy("kind", F.col("raw_key").alias("_slug")).agg(F.min("canonical").alias("_to"))
    named = scores.withColumn("_slug", slug_key(F.col("feature"))).join(names, ["kind", "_slug"], "left").withColumn(
        "feature", F.coalesce("_to", "_slug")).drop("_slug", "_to")
    ing = profiles.merge_sum_capped(named.where(F.col("kind") == "ing"))
    met = profiles.merge_max_methods(named.where(F.col("kind") == "met"))
    return ing.unionByName(met)


def process_batch(batch: DataFrame, batch_id: int, stores: Stores, alias: DataFrame, catalog: DataFrame,
                  required: DataFrame | None = None, dry_run: bool = False) -> None:
    """Validate, canonicalise, stamp and write one batch of payloads.

    A payload with any violation is rejected as a whole, with its reasons.
    """
    spark = batch.sparkSession
    batch = reliable(batch)
    cities, proposals, bad = parse_payloads(batch)
    cities = reliable(cities)
    city_faults = quality.payload_rules(cities, required)
    faults = city_faults.unionByName(quality.proposal_rules(proposals))
    payload_of = cities.select("entity_id", "payload_id").unionByName(proposals.select("entity_id", "payload_id"))
    rejected = reliable(faults.join(payload_of, "entity_id").groupBy("payload_id").agg(
        F.concat_ws("; ", F.array_sort(F.collect_set("rule"))).alias("reason")))
    # entities finished in earlier batches are skipped; the own partition may be from a first try
    done = read_store(spark, stores, "entities", CITY_FIELDS).where(F.col("batch_id") < batch_id).select("id").distinct()
    fresh = cities.join(rejected, "payload_id", "left_anti").join(done, "id", "left_anti")
    # the last city of a batch wins when an id occurs twice
    fresh = reliable(top_k_per_group(fresh, ["id"], 1, F.desc("extended_at"), F.desc("entity_id")).drop("rank"))
    scores = canonical_scores(profiles.drop_small_cap(raw_scores(fresh), {"ing": 35, "met": 12}).drop("rank"), alias)
    scores = reliable(scores.join(fresh.select("entity_id", "id"), "entity_id"))
    entities = with_processed_at(fresh.select(
        "entity_id", "id", "name",
        F.slice(F.try_variant_get("dishes", "$", "array<string>"), 1, 5).alias("famous_dishes")))
    known = catalog.select("kind", "feature").unionByName(
        read_store(spark, stores, "catalog", "kind string, feature string").where(F.col("batch_id") < batch_id).select("kind", "feature"))
    accepted = proposals.join(rejected, "payload_id", "left_anti")
    outputs = {
        "entities": entities, "scores": scores, "catalog": new_keys(scores, known),
        "proposals": accepted.select("kind", F.try_variant_get("key", "$", "string").alias("key"),
                                     F.to_json("map_to").alias("map_to"), F.try_variant_get("reason", "$", "string").alias("reason"),
                                     F.try_variant_get("confidence", "$", "double").alias("confidence")),
        "rejected": bad.select("payload_id", "payload", "reason").unionByName(
            batch.join(rejected, "payload_id").select("payload_id", "payload", "reason")),
    }
    for name, rows in outputs.items():
        if dry_run:
            rows.write.format("noop").mode("overwrite").save()
        else:
            rows.write.mode("overwrite").parquet(f"{stores.path(name)}/batch_id={batch_id}")


def extend_stream(payloads: DataFrame, stores: Stores, alias: DataFrame, catalog: DataFrame, checkpoint: str,
                  required: DataFrame | None = None, dry_run: bool = False) -> StreamingQuery:
    """Run ``process_batch`` over a stream of (payload_id, payload); resumes from its checkpoint."""
    first = first_batch(payloads.sparkSession, checkpoint, [stores.path(n) for n in STORES])
    return (payloads.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda rows, n: process_batch(rows, first + n, stores, alias, catalog, required, dry_run)).start())


def merged_entities(spark: SparkSession, base: DataFrame, stores: Stores) -> DataFrame:
    """Base rows with the newest extension of each id."""
    ext = read_store(spark, stores, "entities", CITY_FIELDS).drop("name", "entity_id")
    return merge_extended(base, ext, ["famous_dishes", "extended_at"], seq_col="batch_id")


def merged_scores(spark: SparkSession, base: DataFrame, stores: Stores) -> DataFrame:
    """Base scores (id, kind, feature, score), all of an id's replaced by those of its newest extension."""
    ext = read_store(spark, stores, "entities", CITY_FIELDS)
    newest = top_k_per_group(ext, ["id"], 1, F.desc("batch_id")).select("id", "batch_id")
    scores = read_store(spark, stores, "scores", "entity_id string, kind string, feature string, score double, id string")
    fresh = scores.join(newest, ["id", "batch_id"], "left_semi").select("id", "kind", "feature", "score")
    return base.select("id", "kind", "feature", "score").join(newest.select("id"), "id", "left_anti").unionByName(fresh)


def live_catalog(spark: SparkSession, catalog: DataFrame, stores: Stores) -> DataFrame:
    """The catalogue with every key that batches have added."""
    grown = read_store(spark, stores, "catalog", "kind string, feature string").select("kind", "feature")
    return catalog.select("kind", "feature").unionByName(grown).distinct()


def latest_stream(rows: DataFrame, key: str, time_col: str, path: str, checkpoint: str, id_col: str | None = None) -> StreamingQuery:
    """Keep the newest record per key, however late a record comes.

    Each batch adds its own newest rows as a partition; ``latest_table`` reads the newest
    over all partitions.  Copies of a record are equal there, so none has to be dropped
    by a watermark, which would lose late keys as well.
    """
    first = first_batch(rows.sparkSession, checkpoint, [path])

    def store(batch: DataFrame, batch_id: int) -> None:
        order = [F.desc(time_col)] + ([F.desc(id_col)] if id_col else [])
        newest = top_k_per_group(batch, [key], 1, *order).drop("rank")
        newest.write.mode("overwrite").parquet(f"{path}/batch_id={first + batch_id}")

    return (rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .outputMode("append").foreachBatch(store).start())


def latest_table(spark: SparkSession, path: str, key: str, time_col: str, id_col: str | None = None) -> DataFrame:
    return _newest(generations.read(spark, path, ""), key, time_col, id_col).drop("batch_id")


def _newest(rows: DataFrame, key: str, time_col: str, id_col: str | None) -> DataFrame:
    order = [F.desc(time_col)] + ([F.desc(id_col)] if id_col else []) + [F.desc("batch_id")]
    return top_k_per_group(rows, [key], 1, *order).drop("rank")


def compact_latest(spark: SparkSession, path: str, key: str, time_col: str, id_col: str | None = None, upto: int | None = None) -> generations.State:
    """Keep only the newest record of each key of the finished batches; run it between two runs of the stream."""
    return generations.compact(spark, path, {"": (None, lambda rows: _newest(rows, key, time_col, id_col))}, upto)


def compact_stores(spark: SparkSession, stores: Stores, upto: int | None = None) -> generations.State:
    """One generation of all five stores: entities by their newest batch, catalogue keys once, the rest as it is."""
    newest = lambda rows: top_k_per_group(rows, ["id"], 1, F.desc("batch_id")).drop("rank")
    once = lambda rows: rows.groupBy("kind", "feature").agg(F.min("batch_id").alias("batch_id"))
    rewrite = {"entities": newest, "catalog": once}
    return generations.compact(spark, stores.root, {name: (None, rewrite.get(name)) for name in STORES}, upto)
