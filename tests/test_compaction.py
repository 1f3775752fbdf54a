import os

import pytest
from pyspark.sql import functions as F

from facetry.operators import ordering, sketch
from facetry.streaming import generations
from facetry.streaming import incremental as inc


def fill(spark, path, first, last):
    """Batches of records (k, t, v): each key again and again, one new key a batch."""
    for n in range(first, last):
        rows = spark.createDataFrame([(f"k{n % 7}", n, n * 10), (f"new{n}", n, n)], "k string, t long, v long")
        rows.coalesce(1).write.parquet(f"{path}/batch_id={n}")


def newest(spark, path):
    return {r.k: r.v for r in inc.latest_table(spark, path, "k", "t").collect()}


def test_many_batches_become_one_generation(spark, tmp_path):
    path = str(tmp_path / "store")
    fill(spark, path, 0, 60)
    want = newest(spark, path)
    assert len(want) == 67
    state = inc.compact_latest(spark, path, "k", "t")
    assert state.upto == 59 and newest(spark, path) == want
    assert generations.read(spark, path, "").count() == 67  # older records are gone
    fill(spark, path, 60, 63)
    more = newest(spark, path)
    assert more["k4"] == 600 and len(more) == 70
    # readers list the generation and the batches since, whatever came before
    assert len(generations.read(spark, path, "").inputFiles()) <= 3 + len(os.listdir(f"{state.folder}/rows"))
    assert generations.vacuum(spark, path, [""]) == 60
    assert newest(spark, path) == more and [d for d in os.listdir(path) if d.startswith("batch_id")] != []
    inc.compact_latest(spark, path, "k", "t")
    generations.vacuum(spark, path, [""])
    assert newest(spark, path) == more and len(os.listdir(f"{path}/_generations")) == 1
    assert inc.first_batch(spark, str(tmp_path / "check"), [path]) == 63  # batches go on after those that were removed


def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    fill(spark, path, 0, 8)
    want = newest(spark, path)

    def broken(rows):
        raise RuntimeError("stopped")
    with pytest.raises(RuntimeError):
        generations.compact(spark, path, {"": (None, broken)})
    # a run that dies after it wrote its generation, and one that dies while it writes the manifest
    spark.createDataFrame([("k0", 99, 99, 0)], "k string, t long, v long, batch_id long").write.parquet(f"{path}/_generations/00000000-dead/rows")
    os.makedirs(f"{path}/_manifests/00000000")
    assert generations.state(spark, path).number == -1 and newest(spark, path) == want
    os.rmdir(f"{path}/_manifests/00000000")
    assert inc.compact_latest(spark, path, "k", "t").upto == 7 and newest(spark, path) == want
    generations.vacuum(spark, path, [""])
    assert len(os.listdir(f"{path}/_generations")) == 1 and newest(spark, path) == want


def test_stores_are_compacted_together(spark, tmp_path):
    stores = inc.Stores(str(tmp_path))
    payload = '{"cities": [{"id": "c%d", "name": "n", "ingredients": {%s}, "cookingMethods": {"boil": 1, "fry": 0.9, "bake": 0.7}, "famousDishes": ["a", "b", "c", "d", "e"], "extendedAt": "2024-01-01T00:00:00Z"}]}'
    scores = ", ".join(f'"k{i}": {0.1 + 0.03 * i:.2f}' for i in range(20))
    alias = spark.createDataFrame([], "kind string, raw_key string, canonical string")
    catalog = spark.createDataFrame([], "kind string, feature string")
    for n in range(3):
        batch = spark.createDataFrame([(n, payload % (n % 2, scores))], "payload_id long, payload string")
        inc.process_batch(batch, n, stores, alias, catalog)
    before = {name: inc.read_store(spark, stores, name, "id string" if name == "entities" else "kind string").count() for name in ("entities", "scores", "catalog")}
    live = sorted(map(tuple, inc.live_catalog(spark, catalog, stores).collect()))
    assert inc.compact_stores(spark, stores).upto == 2
    generations.vacuum(spark, stores.root, list(inc.STORES))
    assert before == {name: inc.read_store(spark, stores, name, "id string" if name == "entities" else "kind string").count() for name in ("entities", "scores", "catalog")}
    assert live == sorted(map(tuple, inc.live_catalog(spark, catalog, stores).collect()))
    # a finished id is still known
    inc.process_batch(spark.createDataFrame([(9, payload % (1, scores))], "payload_id long, payload string"), 3, stores, alias, catalog)
    assert inc.read_store(spark, stores, "entities", "id string").count() == before["entities"]


def test_merged_sketches_keep_the_rank_error(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("axis"), (F.pow(F.rand(7), F.lit(3.0)) * 1000).alias("x"), (F.col("id") % 2).alias("half")).cache()
    probabilities = [0.01, 0.1, 0.5, 0.9, 0.99]
    whole = sketch.axis_sketches(rows, "axis", "x")
    halves = sketch.axis_sketches(rows.where("half = 0"), "axis", "x").unionByName(sketch.axis_sketches(rows.where("half = 1"), "axis", "x"))
    merged = sketch.merged_sketches(halves, "axis")
    exact = {(r.axis, r.p): r.value for r in ordering.axis_quantiles(rows, "axis", "x", probabilities).collect()}
    for made in (whole, merged):
        assert {r.axis: r.n for r in made.collect()} == {0: 10_000, 1: 10_000, 2: 10_000}
        found = sketch.sketch_quantiles(made, "axis", probabilities).cache()
        errors = sketch.rank_errors(rows, "axis", "x", found).collect()
        assert len(errors) == 15 and max(r.error for r in errors) <= 2 * sketch.rank_error()
        assert {(r.axis, r.p) for r in found.collect()} == set(exact)
