import json

from pyspark.sql import functions as F

from facetry.operators import quality
from facetry.sources import readers, writers
from facetry.streaming import incremental as inc


def test_scan_takes_arrays_and_single_objects_and_sets_bad_files_aside(spark, tmp_path):
    (tmp_path / "data.a.json").write_text(json.dumps([{"id": "1", "name": "A", "ingredients": {"rice": 0.5, "x": "0.5", "y": True, "z": 0}}, {"id": "2", "name": "B"}]))
    (tmp_path / "data.b.json").write_text(json.dumps({"id": "3", "name": "C", "latitude": 1.5, "cookingMethods": {"boil": 1}}))
    (tmp_path / "data.c.json").write_text("{broken")
    raw = readers.scan_profiles(spark, str(tmp_path))
    assert [(r.id, r.name, r.pos) for r in readers.entities_of(raw).orderBy("file", "pos").collect()] == [("1", "A", 0), ("2", "B", 1), ("3", "C", 0)]
    assert {(r.kind, r.raw_key, r.score) for r in readers.scores_of(raw).collect()} == {("ing", "rice", 0.5), ("ing", "y", 1.0), ("met", "boil", 1.0)}
    assert readers.bad_files(spark, str(tmp_path)).count() == 1


def test_chunks_and_optional_sources(spark, tmp_path):
    writers.write_chunked(spark.range(10).withColumnRenamed("id", "n"), str(tmp_path / "out"), 4, F.col("n"))
    sizes = {r.chunk: r["count"] for r in spark.read.json(str(tmp_path / "out")).groupBy("chunk").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 3, 3: 1}
    assert readers.scan_optional(spark, str(tmp_path / "nothing.json"), "id string").count() == 0
    (tmp_path / "alias.json").write_text(json.dumps({"ingredients": {"chilli": "chili"}, "cookingMethods": {}}))
    assert [tuple(r) for r in readers.load_alias_map(spark, str(tmp_path / "alias.json")).collect()] == [("ing", "chilli", "chili")]


def test_extension_is_resumable_and_idempotent(spark, tmp_path):
    def city(i, **more):
        return dict({"id": i, "name": i, "ingredients": {"Chilli ": 0.7, "chili": 0.6}, "cookingMethods": {"boil": 1}, "extendedAt": "t"}, **more)
    src, stores = tmp_path / "in", inc.Stores(str(tmp_path / "out"))
    src.mkdir()
    schema = "payload_id string, payload string"
    alias = spark.createDataFrame([("ing", "chilli", "chili")], "kind string, raw_key string, canonical string")
    catalog = spark.createDataFrame([("met", "boil")], "kind string, feature string")

    def put(name, doc):
        (src / f"{name}.json").write_text(json.dumps({"payload_id": name, "payload": json.dumps(doc)}))

    def run(dry=False, check="cp"):
        stream = spark.readStream.schema(schema).json(str(src))
        inc.extend_stream(stream, stores, alias, catalog, str(tmp_path / check), dry_run=dry).awaitTermination()

    put("p1", {"cities": [city("a"), city("b", extendedAt=None)]})
    run(dry=True, check="dry")
    assert inc.read_store(spark, stores, "entities", inc.CITY_FIELDS).count() == 0
    put("p2", {"cities": [city("c")]})
    run()
    put("p3", {"cities": [city("c"), city("d")]})
    run()
    ids = [r.id for r in inc.read_store(spark, stores, "entities", inc.CITY_FIELDS).collect()]
    assert sorted(ids) == ["c", "d"]
    scores = inc.read_store(spark, stores, "scores", "id string, kind string, feature string, score double")
    assert {(r.id, r.feature, r.score) for r in scores.where("kind = 'ing'").collect()} == {("c", "chili", 1.0), ("d", "chili", 1.0)}
    assert [(r.kind, r.feature) for r in inc.live_catalog(spark, catalog, stores).orderBy("kind").collect()] == [("ing", "chili"), ("met", "boil")]
    assert inc.read_store(spark, stores, "rejected", "payload_id string, reason string").where("payload_id = 'p1'").first().reason == "missing_timestamp"


def test_alias_audit(spark):
    rows = [("ing", "a", "b"), ("ing", "b", "c"), ("ing", "x", "y"), ("ing", "y", "x"), ("ing", "q", "r"), ("ing", "q", "s")]
    got = {(r.raw_key, r.finding) for r in quality.alias_audit(spark.createDataFrame(rows, "kind string, raw_key string, canonical string")).collect()}
    assert got == {("a", "chain"), ("x", "cycle"), ("y", "cycle"), ("q", "conflict")}


def test_food_rules_on_the_fixed_lists(spark):
    from facetry.sources import vocabulary as v
    entities = spark.createDataFrame([(1, "IT"), (2, "JP")], "entity_id bigint, group string")
    rows = [(1, "ing", f, 1.0) for f in ("taro", "beef", "garlic")] + [(2, "ing", f, 1.0) for f in ("rice", "egg", "butter", "onion")]
    profile = spark.createDataFrame(rows, "entity_id bigint, kind string, feature string, score double")
    found = lambda build: {(r.entity_id, r.severity, r.detail) for r in quality.dimension_coverage(
        profile, entities, v.dimension_table(spark, build)).collect()}
    assert found(False) == {(1, "warning", "fat")} and found(True) == {(1, "error", "fat,starch")}
    assert {(r.entity_id, r.rule) for r in quality.regional_rules(profile, entities, v.regional_table(spark)).collect()} == {(1, "mediterranean_olive_oil")}
    assert v.alias_table(spark).count() == 52
