"""Readers and writers on files: what is written is what is read back."""

import json

import pytest
from pyspark.sql import functions as F

from facetry.sources import readers, writers
from facetry.streaming import incremental as inc


def test_strict_sources_fail(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"id": "1"}')
    (tmp_path / "many.json").write_text(' [{"id": "1"}, {"id": "2"}]')
    assert readers.scan_profiles_strict(spark, str(tmp_path / "many.json"), "id string").count() == 2
    with pytest.raises(ValueError, match="array"):
        readers.scan_profiles_strict(spark, str(tmp_path / "one.json"), "id string")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        readers.scan_profiles_strict(spark, str(tmp_path / "none.json"), "id string")
    with pytest.raises(FileNotFoundError):
        readers.scan_profiles(spark, str(tmp_path), "data.*.json")


def test_profiles_and_calibration_round_trip(spark, tmp_path):
    rows = spark.sql("SELECT '1' AS id, map('a', 0.5D, 'b', 0.9D) AS ingredients, map('boil', 1D) AS cookingMethods, array(0.1D, 0.2D) AS embedding")
    writers.write_profiles(rows, str(tmp_path / "profiles"))
    got = spark.read.json(str(tmp_path / "profiles")).first()
    assert got.id == "1" and got.embedding == [0.1, 0.2] and [list(x)[0] for x in got.ingredients] == ["b", "a"]
    writers.write_calibration(spark.sql("SELECT array(1D) AS mu, 'abc' AS hash"), str(tmp_path / "cal"))
    assert spark.read.json(str(tmp_path / "cal/calibration")).first().mu == [1.0]
    assert spark.read.json(str(tmp_path / "cal/calibration_hash")).first().hash == "abc"


def test_reports_insights_features_and_catalogue(spark, tmp_path):
    catalog = spark.createDataFrame([("ing", "a"), ("ing", "b"), ("met", "boil"), ("met", "boil")], "kind string, feature string")
    writers.write_run_report(writers.run_report(spark.range(3), catalog.distinct(), {"k": 5}, 1.5), str(tmp_path / "report"))
    report = spark.read.json(str(tmp_path / "report")).first()
    assert (report.entities, report.features, report.ingredient_features, report.param_k, report.seconds) == (3, 3, 2, 5, 1.5)
    writers.write_insights({"x": spark.range(2), "y": spark.range(1)}, str(tmp_path / "insights"))
    assert spark.read.json(str(tmp_path / "insights/x")).count() == 2
    points = writers.point_features(spark.sql("SELECT 1D AS lat, 2D AS lon"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")), F.struct("lat"))
    writers.write_geojson(points, str(tmp_path / "geo"))
    assert json.loads(spark.read.text(str(tmp_path / "geo")).first().value)["geometry"] == {"type": "Point", "coordinates": [2.0, 1.0]}
    writers.publish_key_catalog(catalog, str(tmp_path / "catalog"))
    assert sorted((r.kind, r.feature) for r in spark.read.json(str(tmp_path / "catalog")).collect()) == [("ing", "a"), ("ing", "b"), ("met", "boil")]


def test_logs_append_and_versions_stay(spark, tmp_path):
    rows = spark.range(1)
    for n in range(2):
        writers.append_proposals(rows, str(tmp_path / "log"))
        writers.quarantine(rows, str(tmp_path / "bad"))
        writers.overwrite_with_backup(rows, str(tmp_path / "data"), str(n))
    assert spark.read.json(str(tmp_path / "log")).count() == 2 and spark.read.json(str(tmp_path / "bad")).count() == 2
    assert spark.read.parquet(str(tmp_path / "data")).select("version").distinct().count() == 2


def test_extensions_replace_scores(spark, tmp_path):
    stores = inc.Stores(str(tmp_path))
    for batch, score in ((0, 0.1), (1, 0.7)):
        spark.sql(f"SELECT 'e' AS entity_id, 'x' AS id, 'n' AS name, array('d') AS famous_dishes, current_timestamp() AS extended_at").write.parquet(f"{tmp_path}/entities/batch_id={batch}")
        spark.sql(f"SELECT 'e' AS entity_id, 'ing' AS kind, 'f{batch}' AS feature, {score}D AS score, 'x' AS id").write.parquet(f"{tmp_path}/scores/batch_id={batch}")
    base = spark.createDataFrame([("x", "ing", "old", 0.5), ("y", "met", "kept", 0.4)], "id string, kind string, feature string, score double")
    got = {(r.id, r.feature, r.score) for r in inc.merged_scores(spark, base, stores).collect()}
    assert got == {("x", "f1", 0.7), ("y", "kept", 0.4)}
