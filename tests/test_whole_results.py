"""Cases in which a limit, a prefix or an offset once changed a result."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.functions.color import count_below
from facetry.operators import neighbours as nb
from facetry.operators import quality, similarity
from facetry.operators.ordering import cdf_points
from facetry.plans import search
from facetry.streaming import incremental as inc


def test_more_than_1023_points(spark):
    values = spark.range(5000).select(F.lit("x").alias("axis"), (F.col("id") * 2).cast("double").alias("v"))
    for buckets in (1024, 2048):
        got = [r.value for r in cdf_points(values, "axis", "v", buckets).orderBy("slot").collect()]
        assert got == [2.0 * int(np.floor(i * 4999 / (buckets - 1))) for i in range(buckets)]
    row = spark.range(1).select(count_below(F.sequence(F.lit(1), F.lit(3000)), F.lit(2500)).alias("n"), count_below(F.array().cast("array<int>"), F.lit(1)).alias("none")).first()
    assert (row.n, row.none) == (2499, 0)


@pytest.mark.parametrize("offset", [0.0, 1e4, 1e7, 1e8])
def test_neighbours_far_from_the_origin(spark, offset):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) + offset
    rows = nb.dense_rows(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {i: set(np.argsort(d[i])[:5].tolist()) for i in range(len(x))}
    got = {}
    for r in nb.knn_join(rows, 5, "euclidean").collect():
        got.setdefault(r.id, set()).add(r.neighbour_id)
    assert got == want
    pairs = {(r.id, r.neighbour_id) for r in nb.radius_join(rows, 0.6, "euclidean").collect()}
    assert pairs == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= 0.6}


def test_late_records_and_new_checkpoints_lose_nothing(spark, tmp_path):
    files = [[("a", 10, 1), ("c", 10, 2)], [("a", 11, 3)], [("b", 1, 4), ("a", 2, 5)]]
    schema = "key string, ts timestamp, id long"

    def feed(n, rows):
        spark.createDataFrame([(k, dt.datetime(2024, 1, d), i) for k, d, i in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    def run(check):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        inc.latest_stream(stream, "key", "ts", f"{tmp_path}/state", f"{tmp_path}/{check}", id_col="id").awaitTermination()
        return {r.key: r.id for r in inc.latest_table(spark, f"{tmp_path}/state", "key", "ts", "id").collect()}

    for n, rows in enumerate(files):
        feed(n, rows)
        got = run("check")
    assert got == {"a": 3, "b": 4, "c": 2}
    assert inc.first_batch(spark, f"{tmp_path}/check", [f"{tmp_path}/state"]) == 0
    feed(9, [("d", 5, 6)])
    assert run("other") == {"a": 3, "b": 4, "c": 2, "d": 6}
    assert inc.first_batch(spark, f"{tmp_path}/other", []) == 3


def test_search_uses_the_whole_query(spark):
    long = "abcdefghijklmnopqrstuvwxyz"
    rows = spark.createDataFrame([(1, long), (2, long[:20] + "000000")], "id long, name string")
    assert [r.id for r in search.prefix_search(rows, long[:25], ["name"]).collect()] == [1]
    assert search.name_search(rows, "  ", ["name"], "id").count() == 0


def test_payloads_are_judged_after_the_caps(spark):
    ing = {f"k{i}": 0.9 for i in range(35)} | {f"z{i}": 0.5 for i in range(40)}
    text = [(1, ing, {}), (2, {f"k{i}": 0.5 for i in range(5)}, {}), (3, {"k": 0.049, "l": 0.9}, {"m": 0.5})]
    rows = spark.createDataFrame(text, "entity_id long, i map<string,double>, m map<string,double>")
    maps = {c: F.transform_values(s, lambda _, v: v.cast("variant")) for c, s in (("ingredients", "i"), ("methods", "m"))}
    cities = rows.select("entity_id", F.lit("g").alias("group"), F.lit("x").alias("id"), F.lit("n").alias("name"), *[m.alias(c) for c, m in maps.items()],
                         F.lit(None).cast("variant").alias("dishes"), F.lit("2024").alias("extended_at"))
    assert {(r.entity_id, r.rule) for r in quality.payload_rules(cities).collect()} == {(2, "too_flat"), (3, "too_flat")}


def test_pairs_without_vectors_are_lost(spark):
    rows = nb.dense_rows(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.02])], "id long, v array<double>"), "id", "v")
    rows = nb.unit_rows(rows)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "entity_id long, vector array<double>")
    got = similarity.similarity_preserved(rows, vectors).first()
    assert (got.pairs, got.lost, got.without_vector, got.preserved) == (3, 2, 2, False)


def test_similarity_preserved_reads_all_vectors(spark):
    import __spark_entry__
    from conftest import SF
    known = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    suppliers = {r.s_suppkey for r in spark.read.parquet(f"{SF}/supplier.parquet").select("s_suppkey").collect()}
    got = __spark_entry__.queries()["similarity_preserved"](spark, SF).first()
    assert suppliers <= known and got.pairs > 0 and got.without_vector == 0


def test_queries_run_the_operators_default_steps(spark, monkeypatch):
    import __spark_entry__
    from facetry.plans import color_queries
    seen = []
    monkeypatch.setattr(color_queries, "tidy", lambda rows: rows)
    monkeypatch.setattr(color_queries, "reliable", lambda rows: rows)
    for name in ("dense_profile", "pca_embed", "knn_graph"):
        monkeypatch.setattr(color_queries.embed, name, lambda rows, *_: rows)
    monkeypatch.setattr(color_queries.embed, "color_embed", lambda rows: (rows, None))
    for name in ("sphere_coords", "calibrate_colors", "axis_norms"):
        monkeypatch.setattr(color_queries.calibrate, name, lambda rows, *_: rows)
    monkeypatch.setattr(color_queries.insights, "families", lambda *_, **given: seen.append(given))
    real = color_queries.embed.structural_embed
    monkeypatch.setattr(color_queries.embed, "structural_embed", lambda *given: seen.append(given[2:]) or spark.range(1).selectExpr("id AS entity_id", "array_repeat(0.0, 12) AS embedding"))
    for name in ("kmeans_families", "structural_embed"):
        __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert seen == [{}, ()] and real.__defaults__[-1] == 10
