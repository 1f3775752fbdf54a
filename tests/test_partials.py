"""Cleaning with types, reports with details, listings, sinks and sources that no query reads."""

import json
import os

import pytest
from pyspark.sql import functions as F

from facetry.functions import keys
from facetry.operators import cluster, embed, grid, profiles, quality, records
from facetry.plans import insights
from facetry.sources import readers, writers

RAW = [(1, "ing", "Salt", "0.5"), (1, "ing", "salt", "0.7"), (1, "ing", "pepper", '"0.5"'), (1, "ing", "oil", "0.4401"), (1, "ing", "stone", "0.9"), (1, "met", "boil", "true"),
       (2, "ing", "oil", "-1"), (2, "ing", "salt", "null"), (2, "met", "fry", "0.2"), (2, "ing", "pepper", "not json"), (3, "ing", "oil", "[1]")]
WHITE = [("ing", "salt"), ("ing", "pepper"), ("ing", "oil"), ("met", "boil"), ("met", "fry")]


def split(spark):
    rows = spark.createDataFrame(RAW, "entity_id long, kind string, feature string, raw_score string")
    alias = spark.createDataFrame([("ing", "Salt", "salt")], "kind string, raw_key string, canonical string")
    return rows, spark.createDataFrame(WHITE, "kind string, feature string"), alias


def test_text_is_no_number_and_keys_that_meet_are_one(spark):
    rows, white, alias = split(spark)
    got = {(r.entity_id, r.kind, r.feature): r.score for r in profiles.clean_profile(rows, white, alias).collect()}
    assert got == {(1, "ing", "salt"): 0.7, (1, "met", "boil"): 1.0, (2, "met", "fry"): 0.2}
    typed = rows.withColumn("raw_score", F.try_parse_json("raw_score"))
    assert profiles.clean_profile(typed, white, alias).count() == 3
    reasons = {(r.entity_id, r.raw_key): r.reason for r in profiles.split_scores(rows, white, alias).collect()}
    assert reasons[1, "pepper"] == "non_positive" and reasons[1, "oil"] == "filler" and reasons[1, "stone"] == "not_in_master"
    rules = {(r.entity_id, r.detail): r.rule for r in quality.score_rules(rows.withColumn("group", F.lit("g"))).collect()}
    assert rules[1, 'pepper="0.5"'] == "not_a_number" and rules[2, "oil=-1"] == "score_range" and (1, "boil=true") not in rules


def test_clean_report_with_details(spark, tmp_path):
    rows, white, alias = split(spark)
    parts = profiles.split_scores(rows, white, alias)
    entities = spark.createDataFrame([(1, "one", "a"), (2, "two", "a"), (3, "three", "b"), (4, "four", "b")], "entity_id long, name string, file string")
    details = profiles.clean_details(parts, entities)
    got = {r.name: r for r in details.collect()}
    assert (got["one"].kept_ingredients, got["one"].kept_methods, got["one"].emptied) == (1, 1, False)
    assert [tuple(x) for x in got["one"].removed] == [("ing", "oil", "filler"), ("ing", "pepper", "non_positive"), ("ing", "stone", "not_in_master")]
    assert got["two"].emptied and got["two"].kept_methods == 1 and got["four"].emptied and got["four"].removed == []
    report = profiles.clean_report(parts.join(entities, "entity_id"))
    writers.write_clean_report(report, str(tmp_path / "report"), details=details)
    assert sorted(r.name for r in spark.read.json(str(tmp_path / "report/emptied")).collect()) == ["four", "three", "two"]
    assert {r.file: r.empty_entities for r in spark.read.json(str(tmp_path / "report/files")).collect()} == {"a": 1, "b": 1}


def test_group_context_and_hue_lists(spark):
    members = spark.createDataFrame([(i, f"n{i:02d}", "g" if i else None) for i in range(30)], "entity_id long, name string, grp string")
    profile = spark.createDataFrame([(i, "ing", f"f{i % 3}", 1.0) for i in range(30)], "entity_id long, kind string, feature string, score double")
    row = profiles.group_context(profile, members, "grp", 2, 5).where("grp = 'g'").head()
    assert row.members == 29 and row.names == [f"n{i:02d}" for i in range(1, 6)] and [f.feature for f in row.features] == ["f1", "f2"]
    hues = spark.createDataFrame([(i, "ab"[i % 2] if i else None, float(-i)) for i in range(7)], "entity_id long, supergroup string, hue double")
    got = sorted((r.panel, str(r.supergroup), r["rank"], r.entity_id, r.members) for r in grid.supergroup_members(hues, ["b", "a"]).collect())
    assert got == [(0, "b", 1, 5, 3), (0, "b", 2, 3, 3), (0, "b", 3, 1, 3), (1, "a", 1, 6, 3), (1, "a", 2, 4, 3), (1, "a", 3, 2, 3), (2, "None", 1, 0, 1)]


def test_nested_places_in_parts(spark):
    rows = spark.createDataFrame([("x", "c", f"p{i}") for i in range(7)] + [("x", None, "q"), (None, "c", "r")], "country string, city string, place string")
    got = {(r.country, r.city, r.part): (r.places, r.n_places) for r in records.nested_groups(rows, "country", "city", "place", 3).collect()}
    assert got == {("x", "c", 0): (["p0", "p1", "p2"], 7), ("x", "c", 1): (["p3", "p4", "p5"], 7), ("x", "c", 2): (["p6"], 7), ("x", None, 0): (["q"], 1), (None, "c", 0): (["r"], 1)}


def test_sparsest_only_among_those_that_pass(spark):
    counts = spark.createDataFrame([(1, "a", "s", 1), (2, "b", "s", 2), (3, "c", "s", 3)], "entity_id long, name string, supergroup string, n_features int")
    gaps = spark.createDataFrame([(1,)], "entity_id long")
    assert [r.entity_id for r in records.sparsest_per_group(counts, "supergroup", 1, 8, gaps).collect()] == [2]


def test_mapping_quality_equals_each_variant_alone(spark):
    profile = spark.createDataFrame([(i, "ing", f"f{(i % 3) * 2 + j}", 1.0 + 0.01 * (i % 5)) for i in range(45) for j in range(2)] + [(i, "ing", f"x{i}", 0.1) for i in range(45)],
                                    "entity_id long, kind string, feature string, score double")
    after = profile.where("feature NOT LIKE 'x%'")
    got = {r.variant: r for r in quality.mapping_quality(profile, after, 3, 2).collect()}
    weighed = profiles.idf_weight(profiles.l1_normalize(profiles.merge_max(after)))
    labels = cluster.kmeans(embed.dense_profile(weighed), 3, restarts=2)
    assert got["after"].features == 6 and got["before"].features == 51 and got["after"].entities == 45
    assert got["after"].silhouette == pytest.approx(cluster.silhouette(labels).head().silhouette) and got["after"].silhouette > got["before"].silhouette


def test_family_listing_names_the_largest(spark):
    fams = spark.createDataFrame([(i, f"F{i}", m, "s") for i, m in enumerate([5, 9, 9, 1, 3, 7])], "label int, family string, members long, supergroups string")
    rows = insights.family_listing(fams).collect()
    assert [r.family for r in rows] == ["F1", "F2", "F5", "F0", "F4", "F3"] and {r.largest for r in rows} == {"F1, F2, F5, F0"}


def test_keys_outside_the_catalogue(spark):
    alias = spark.createDataFrame([("ing", "a", "b")], "kind string, raw_key string, canonical string")
    rows = spark.createDataFrame([(1, "ing", "b", 0.5), (1, "ing", "z", 0.2), (2, "ing", "z", 0.9), (2, "met", "a", 0.1)], "entity_id long, kind string, feature string, score double")
    resolved = keys.resolve_to_schema_key(rows, alias)
    catalog = spark.createDataFrame([("ing", "a")], "kind string, feature string")
    got = {(r.kind, r.feature): (r.entities, r.best) for r in keys.outside_catalogue(resolved, catalog).collect()}
    assert got == {("ing", "z"): (2, 0.9), ("met", "a"): (1, 0.1)}


def test_first_version_is_kept_as_backup(spark, tmp_path):
    path = str(tmp_path / "data")
    for n, version in enumerate(("c", "b", "a")):
        writers.overwrite_with_backup(spark.range(n, n + 1), path, version)
    assert [r.id for r in spark.read.parquet(f"{path}/_backup").collect()] == [0]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2]


def test_insights_in_one_document(spark, tmp_path):
    writers.write_insights_document({"lonely": spark.range(2), "twins": spark.sql("SELECT 'a' AS x, 1.5D AS y"), "none": spark.range(0)}, str(tmp_path / "doc"))
    [line] = spark.read.text(str(tmp_path / "doc")).collect()
    assert json.loads(line.value) == {"lonely": [{"id": 0}, {"id": 1}], "twins": [{"x": "a", "y": 1.5}], "none": []}


def test_report_is_observed_in_the_passes_that_write(spark, tmp_path):
    log = tmp_path / "seen"
    log.mkdir()
    folder = str(log)

    def counted(batches):
        import uuid
        for pdf in batches:
            for _ in range(len(pdf)):
                open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            yield pdf
    entities = spark.createDataFrame([(i, None if i == 3 else f"n{i}") for i in range(9)], "entity_id long, name string").mapInPandas(counted, "entity_id long, name string")
    catalog = spark.createDataFrame([("ing", "a"), ("ing", "b"), ("met", "c")], "kind string, feature string")
    row = writers.observed_build(entities, catalog, str(tmp_path / "out"), {"k": 8}).head()
    assert (row.entities, row.without_name, row.features, row.ingredient_features, row.method_features, row.param_k) == (9, 1, 3, 2, 1, 8)
    assert len(os.listdir(folder)) == 9 and spark.read.parquet(str(tmp_path / "out/entities")).count() == 9


def test_polygon_features_close_rings(spark, tmp_path):
    cells = spark.sql("SELECT 7 AS cell, 10D AS lat, 179.5D AS lon")
    corner = grid.cell_vertices(F.col("lat"), F.col("lon"), F.lit(2.0), F.lit(2.0))
    writers.write_geojson(writers.polygon_features(cells, corner, F.struct("cell")), str(tmp_path / "geo"))
    feature = json.loads(spark.read.text(str(tmp_path / "geo")).head().value)
    ring = feature["geometry"]["coordinates"][0]
    assert len(ring) == 5 and ring[0] == ring[-1] == [178.5, 9.0] and feature["properties"] == {"cell": 7}


def test_sources_that_no_query_reads(spark, tmp_path):
    (tmp_path / "white.json").write_text('["salt", "oil", "salt"]')
    assert sorted((r.kind, r.feature) for r in readers.load_whitelist(spark, str(tmp_path / "white.json"), "ing").collect()) == [("ing", "oil"), ("ing", "salt")]
    (tmp_path / "schema.ts").write_text("interface X {\n  salt: number;\n  'olive_oil'?: number,\n  name: string;\n}\n")
    (tmp_path / "empty.ts").write_text("nothing\n")
    paths = [str(tmp_path / n) for n in ("missing.ts", "empty.ts", "schema.ts")]
    assert sorted(r.feature for r in readers.load_key_catalog(spark, paths, "ing").collect()) == ["olive_oil", "salt"]
    assert readers.load_key_catalog(spark, paths[:2], "ing").collect() == []
    (tmp_path / "labels.jsonl").write_text('{"id": "a", "label": 3}\n{"id": "b", "label": -1}\n')
    assert sorted((r.id, r.label) for r in readers.scan_labels(spark, str(tmp_path / "labels.jsonl")).collect()) == [("a", 3), ("b", -1)]
    (tmp_path / "artifact.json").write_text('[{"id": "1", "name": "n", "ingredients": {"a": 0.5, "b": "0.25", "c": "x", "d": true}, "embedding": "[1, 2]", "hue2d": "no"}]')
    row = readers.scan_artifact(spark, [str(tmp_path / "none.json"), str(tmp_path / "artifact.json")]).head()
    assert row.ingredients == {"a": 0.5, "b": 0.25} and row.embedding == [1.0, 2.0] and row.color_xyz is None and row.cookingMethods is None
    with pytest.raises(FileNotFoundError):
        readers.scan_artifact(spark, [str(tmp_path / "none.json")])


def test_batch_source_hands_out_files(spark, tmp_path):
    for i in range(3):
        spark.range(i, i + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = readers.batch_source(spark, str(tmp_path / "in"), "id long").writeStream.option("checkpointLocation", str(tmp_path / "check"))
    stream.trigger(availableNow=True).foreachBatch(lambda rows, n: seen.append(sorted(r.id for r in rows.collect()))).start().awaitTermination()
    assert sorted(seen) == [[0], [1], [2]]


def test_keys_and_fingerprints(spark):
    rows = spark.createDataFrame([("1", "s", 1.0, 2.0, "n"), (None, "s", 1.0, 2.0, "n"), (None, None, 1.5, 2.0, "n")], "id string, slug string, lat double, lon double, name string")
    got = [r.k for r in rows.select(F.coalesce(*records.place_key()).alias("k")).collect()]
    assert got == ["1", "s", "1.5|2.0|n"]
    artifact = spark.range(1).select(F.lit(3).alias("v")).withColumn("hash", records.fingerprint(F.struct("v")))
    assert records.fingerprint_check(artifact, artifact.select("hash")).count() == 1
    with pytest.raises(Exception, match="fingerprint differs"):
        records.fingerprint_check(artifact, spark.sql("SELECT 'other' AS hash")).collect()
