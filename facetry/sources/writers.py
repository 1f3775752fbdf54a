"""Sinks.  Every writer goes through Spark's own writers; nothing is gathered on the driver."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from facetry.functions.geo import close_ring
from facetry.functions.scores import sort_map_desc
from facetry.operators.ordering import chunk_ids


def write_profiles(entities: DataFrame, path: str, map_cols: tuple[str, ...] = ("ingredients", "cookingMethods"),
                   fmt: str = "json", mode: str = "errorifexists") -> None:
    """Metadata, vectors and score maps as arrays ordered by score (maps keep no order)."""
    cols = [sort_map_desc(F.col(c)).alias(c) if c in map_cols else F.col(c) for c in entities.columns]
    entities.select(*cols).write.mode(mode).format(fmt).save(path)


def write_calibration(calibration: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The calibration row and, beside it, its fingerprint."""
    calibration.write.mode(mode).json(f"{path}/calibration")
    calibration.select("hash").write.mode(mode).json(f"{path}/calibration_hash")


def run_report(entities: DataFrame, catalog: DataFrame, params: Mapping[str, object], seconds: float) -> DataFrame:
    """One row: counts, parameters and duration of a build."""
    from facetry.runtime import scalar

    counts = catalog.groupBy("kind").agg(F.count(F.lit(1)).alias("_n"))
    per_kind = counts.agg(F.sum("_n").alias("features"), F.sum(F.when(F.col("kind") == "ing", F.col("_n"))).alias("ingredient_features"),
                          F.sum(F.when(F.col("kind") == "met", F.col("_n"))).alias("method_features"))
    out = per_kind.withColumn("entities", scalar(entities, F.count(F.lit(1)))).withColumn("seconds", F.lit(float(seconds)))
    for name, value in sorted(params.items()):
        out = out.withColumn(f"param_{name}", F.lit(value))
    return out.withColumn("finished_at", F.current_timestamp())


def observed_build(entities: DataFrame, catalog: DataFrame, path: str, params: Mapping[str, object], fmt: str = "parquet") -> DataFrame:
    """Write a build's entities and catalogue, and give its report row from what the same two passes observed.

    Counts, sums and null counts come from ``Observation`` on the written frames, so nothing is computed twice.
    """
    seen, keys = Observation("entities"), Observation("catalog")
    begun = time.time()
    entities.observe(seen, F.count(F.lit(1)).alias("entities"), F.count_if(F.col("name").isNull()).alias("without_name")).write.format(fmt).save(f"{path}/entities")
    catalog.observe(keys, F.count(F.lit(1)).alias("features"), F.count_if(F.col("kind") == "ing").alias("ingredient_features"),
                    F.count_if(F.col("kind") == "met").alias("method_features")).write.format(fmt).save(f"{path}/catalog")
    found = {**seen.get, **keys.get}
    row = entities.sparkSession.range(1).select(*[F.lit(found[n]).cast("bigint").alias(n) for n in sorted(found)], F.lit(time.time() - begun).alias("seconds"))
    for name, value in sorted(params.items()):
        row = row.withColumn(f"param_{name}", F.lit(value))
    return row.withColumn("finished_at", F.current_timestamp())


def write_run_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    report.write.mode(mode).json(path)


def write_insights(insights: Mapping[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """One dataset per insight below one folder; each is a short top-n report."""
    for name, rows in insights.items():
        rows.write.mode(mode).json(f"{path}/{name}")


def write_insights_document(insights: Mapping[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """All insights as one JSON document, an array each; every insight is a short top-n report, so the document is one row."""
    from facetry.runtime import scalar

    spark = next(iter(insights.values())).sparkSession
    parts = [scalar(rows.select(F.struct(*rows.columns).alias("_r")), F.collect_list("_r")).alias(name) for name, rows in insights.items()]
    spark.range(1).select(F.to_json(F.struct(*parts)).alias("value")).coalesce(1).write.mode(mode).text(path)


def polygon_features(cells: DataFrame, vertices: Column, properties: Column) -> DataFrame:
    """GeoJSON polygon feature text per cell, rings closed and free of antimeridian jumps."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(close_ring(vertices)).alias("coordinates")).alias("geometry"),
        properties.alias("properties"))
    return cells.select(F.to_json(feature).alias("value"))


def point_features(rows: DataFrame, point: Column, properties: Column) -> DataFrame:
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties"))
    return rows.where(point.isNotNull()).select(F.to_json(feature).alias("value"))


def write_geojson(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Newline-delimited GeoJSON, written in parallel."""
    features.select("value").write.mode(mode).text(path)


def write_chunked(rows: DataFrame, path: str, chunks: int, *order: Column, mode: str = "errorifexists") -> None:
    """Consecutive chunks of ceil(n / chunks) rows, one folder each."""
    placed = chunk_ids(rows, chunks, *order)
    placed.drop("position").write.mode(mode).partitionBy("chunk").json(path)


def write_clean_report(report: DataFrame, path: str, mode: str = "errorifexists", details: DataFrame | None = None) -> None:
    """Counts per file and, with ``details``, the removed keys of every entity and the names of those left empty."""
    if details is None:
        report.write.mode(mode).json(path)
        return
    report.write.mode(mode).json(f"{path}/files")
    details.write.mode(mode).json(f"{path}/entities")
    details.where("emptied").select("file", "name").write.mode(mode).json(f"{path}/emptied")


def overwrite_with_backup(rows: DataFrame, path: str, version: str) -> str:
    """Write a new version; the first one of all is kept beside as ``backup`` and never written again.

    The data being read is never overwritten, as every version has a folder of its own.
    """
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(where)) if fs.exists(where) else []
    if not any(n == "_backup" for _, n in names):
        first = next((n for _, n in names if n.startswith("version=")), None)
        if first:
            spark.read.parquet(f"{path}/{first}").write.parquet(f"{path}/_backup")
    target = f"{path}/version={version}"
    rows.write.mode("errorifexists").parquet(target)
    return target


def append_proposals(proposals: DataFrame, path: str) -> None:
    """Append-only log; never applied to data."""
    proposals.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def publish_key_catalog(catalog: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sorted distinct keys per kind."""
    catalog.select("kind", "feature").distinct().orderBy("kind", "feature").write.mode(mode).partitionBy("kind").json(path)


def quarantine(rows: DataFrame, path: str) -> None:
    """Keep the raw text of payloads that failed to parse."""
    rows.withColumn("quarantined_at", F.current_timestamp()).write.mode("append").json(path)
