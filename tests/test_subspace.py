import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import embed, subspace


def profile_of(spark, x, drop=0.0, seed=0):
    rng = np.random.default_rng(seed)
    cells = [(i, "ing", f"f{j:03d}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v and rng.random() >= drop]
    return spark.createDataFrame(cells, "entity_id long, kind string, feature string, score double").repartition(3)


def exact(x, k):
    centred = x - x.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(-values)[:k]
    return values[order], axes[:, order]


@pytest.mark.parametrize("features", [20, 90])
def test_axes_equal_the_exact_ones_within_the_residual(spark, features, monkeypatch):
    monkeypatch.setattr(subspace, "FEATURES", 32)
    rng = np.random.default_rng(features)
    x = np.maximum(0, rng.standard_normal((150, 4)) @ rng.standard_normal((4, features)) + 0.3 * rng.standard_normal((150, features)))
    x[:, -1] += 0.1  # every feature is in the catalogue
    rows, catalog = subspace.indexed_rows(profile_of(spark, x))
    found = subspace.principal_axes(rows, catalog.count(), 3, tolerance=1e-7)
    names = [r["feature"] for r in catalog.orderBy("feature_index").collect()]
    columns = [int(n[1:]) for n in names]
    values, axes = exact(x[:, columns], 3)
    assert found.residual <= 1e-7 and np.allclose(found.variance, values, rtol=1e-6)
    assert np.allclose(np.abs(np.sum(found.axes.T * axes, axis=0)), 1, atol=1e-6)
    got = {r["entity_id"]: r["c"] for r in subspace.coordinates(rows, found, "c").collect()}
    want = (x[:, columns] - x[:, columns].mean(0)) @ found.axes.T
    assert np.allclose([got[i] for i in range(len(x))], want)


def test_sparse_colours_equal_those_of_dense_profiles(spark):
    rng = np.random.default_rng(3)
    profile = profile_of(spark, rng.uniform(0.1, 1, (80, 3)) @ rng.uniform(0, 1, (3, 25)) ** 3, 0.3).cache()
    rows, found = subspace.sparse_color_embed(profile, 3, 2, tolerance=1e-8)
    dense, axes = embed.color_embed(embed.dense_profile(profile, 2))
    got = {r["entity_id"]: r["color_raw"] for r in rows.collect()}
    want = {r["entity_id"]: r["color_raw"] for r in dense.collect()}
    assert set(got) == set(want) and np.allclose([got[i] for i in sorted(got)], [want[i] for i in sorted(got)], atol=1e-6)
    assert found.residual <= 1e-8


def test_few_rows_and_no_rows(spark):
    one = profile_of(spark, np.array([[1.0, 2.0]]))
    rows, found = subspace.sparse_color_embed(one, 3)
    assert np.allclose(rows.head()["color_raw"], 0) and found.residual == 0.0
    rows, found = subspace.sparse_color_embed(one.where(F.lit(False)), 3)
    assert rows.collect() == []


def test_structure_tells_how_far_it_came(spark):
    """Two rings that hang together weakly: the iteration goes on until its subspace stands still."""
    edges = [(i, j, 1.0) for r in range(2) for i in range(r * 12, r * 12 + 12) for j in range(r * 12, r * 12 + 12) if i != j] + [(0, 12, 0.1), (12, 0, 0.1)]
    graph = spark.createDataFrame(edges, "i long, j long, w double")
    loose = embed.structural_embed(graph, 1, iterations=1).head()["residual"]
    rows = embed.structural_embed(graph, 1, 60, tolerance=1e-4).collect()
    assert rows[0]["residual"] <= 1e-4 < loose
    signs = {r["entity_id"]: r["embedding"][0] > 0 for r in rows}
    assert len({signs[i] for i in range(12)}) == 1 and signs[0] != signs[12]


def test_sums_by_columns_equal_sums_by_rows(monkeypatch):
    rng = np.random.default_rng(1)
    row, at, weight, values = rng.integers(0, 50, 4000), rng.integers(0, 30, 4000), rng.uniform(size=4000), rng.standard_normal((30, 5))
    want = np.zeros((50, 5))
    np.add.at(want, row, weight[:, None] * values[at])
    monkeypatch.setattr(subspace.np, "add", None)  # no element at a time
    assert (subspace._product(row, at, weight, 50, values) == want).all()
