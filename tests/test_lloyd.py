import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import cluster, lloyd


def brute(keys, x, k, seed, restarts, rounds=20, tolerance=1e-4):
    """The same restarts one after the other over the whole matrix."""
    best = None
    for r in range(restarts):
        centres = np.zeros((0, x.shape[1]))
        for step in range(k):
            got = lloyd.drawn(keys, x, centres, seed + r, step)
            centres = np.vstack((centres, got[1] if got else centres[-1]))
        for _ in range(rounds):
            label = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(k)])
            shift = ((new - centres) ** 2).sum(1).max()
            centres = new
            if shift <= tolerance ** 2:
                break
        far = ((x[:, None, :] - centres[None]) ** 2).sum(2)
        cost = far.min(1).sum()
        if best is None or cost < best[0] - 1e-9:
            best = cost, far.argmin(1)
    return best


@pytest.mark.parametrize("case", ["groups", "even", "few"])
def test_labels_of_the_best_restart_equal_brute_force(spark, case):
    rng = np.random.default_rng(2)
    x = {"groups": rng.standard_normal((240, 5)) + rng.integers(0, 4, (240, 1)) * 6, "even": rng.standard_normal((150, 3)), "few": np.repeat(rng.standard_normal((3, 4)), 20, axis=0)}[case]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entity_id long, vector array<double>").repartition(3)
    keys = {r["entity_id"]: r["key"] for r in rows.select("entity_id", F.xxhash64(F.col("entity_id").cast("string")).alias("key")).collect()}
    got = {r["entity_id"]: r["label"] for r in cluster.kmeans(rows, 5, 42, 4).collect()}
    cost, label = brute(np.array([keys[i] for i in range(len(x))]), x, 5, 42, 4)
    groups = {}
    for i, c in enumerate(label.tolist()):
        groups.setdefault(c, []).append(i)
    ranked = sorted(groups.values(), key=lambda g: (-len(g), g[0]))
    assert got == {i: n for n, g in enumerate(ranked) for i in g}


def test_many_parts_are_added_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "DIRECT", 2)
    monkeypatch.setattr(lloyd, "PACK", 7)
    x = np.random.default_rng(3).standard_normal((90, 2)) + np.repeat([[0, 0], [9, 9], [0, 9]], 30, axis=0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entity_id long, vector array<double>").repartition(5)
    labels = [r["label"] for r in cluster.kmeans(rows, 3, 1, 3).orderBy("entity_id").collect()]
    assert labels == [0] * 30 + [1] * 30 + [2] * 30


def test_null_vectors_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, None), (3, [5.0]), (4, [1.1])], "entity_id long, vector array<double>")
    assert {r["entity_id"]: r["label"] for r in cluster.kmeans(rows, 2).collect()} == {1: 0, 4: 0, 3: 1, 2: -1}
    assert cluster.kmeans(rows.where("entity_id = 2"), 2).head()["label"] == -1
    assert cluster.kmeans(rows.limit(0), 2).collect() == []


def test_restarts_share_a_product(monkeypatch):
    rng = np.random.default_rng(8)
    x, centres = rng.standard_normal((300, 6)), rng.standard_normal((5, 4, 6))
    for columns in (256, 9, 1):
        monkeypatch.setattr(lloyd, "COLUMNS", columns)
        assert len(list(lloyd.together(x, centres, lloyd.squares(x)))) == -(-5 // max(1, columns // 4))
        got = lloyd.sums(x, centres)
        for r, c in enumerate(centres):
            far = ((x[:, None, :] - c[None]) ** 2).sum(2)
            label = far.argmin(1)
            want = np.array([[*x[label == i].sum(0), (label == i).sum(), far[label == i, i].sum()] for i in range(4)])
            np.testing.assert_allclose(got[r], want, rtol=1e-10, atol=1e-10)
