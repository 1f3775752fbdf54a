import numpy as np
from pyspark.sql import functions as F

from facetry.operators import cluster, tree
from facetry.operators import neighbours as nb


def rows_of(spark, x):
    return nb.dense_rows(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entity_id long, vector array<double>"), "entity_id", "vector")


def brute_tree(x, samples):
    """Prim over all pairs."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    far = d.copy()
    np.fill_diagonal(far, np.inf)
    core = np.sort(far, axis=1)[:, min(samples, len(x) - 1) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside, out = [0], []
    while len(inside) < len(x):
        rest = [i for i in range(len(x)) if i not in inside]
        part = reach[np.ix_(inside, rest)]
        out.append(part.min())
        inside.append(rest[int(part.min(0).argmin())])
    return sorted(out)


def points(rng):
    return np.concatenate([rng.standard_normal((40, 2)) * 0.4 + c for c in ((0, 0), (5, 5), (0, 6))] + [rng.uniform(-4, 9, (15, 2))])


def test_least_forest_equals_kruskal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(2, 25))
        m = int(rng.integers(0, 60))
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        rank = rng.permutation(m)
        label, want = list(range(n)), []
        for e in np.argsort(rank):
            a, b = label[i[e]], label[j[e]]
            if a != b:
                want.append(int(e))
                label = [a if c == b else c for c in label]
        assert sorted(set(tree.least_forest(i, j, rank, n).tolist())) == sorted(want)


def test_tree_weights_equal_prim(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 24)
    x = points(np.random.default_rng(2))
    got = sorted(r["reach"] for r in tree.reach_tree(rows_of(spark, x), 100.0, 4).collect())
    assert np.allclose(got, brute_tree(x, 4))


def test_every_cut_equals_density_clusters(spark, monkeypatch):
    x = points(np.random.default_rng(3))
    rows = rows_of(spark, x)
    grid = [(0.3, 5, 4), (0.6, 3, 4), (1.2, 10, 4), (2.5, 5, 4), (0.9, 5, 2), (-1.0, 5, 4)]
    calls = []
    reduce = nb.radius_reduce
    monkeypatch.setattr(nb, "radius_reduce", lambda *a, **k: calls.append(1) or reduce(*a, **k))
    got = {(r["eps"], r["min_cluster_size"], r["min_samples"]): r for r in cluster.density_sweep(rows, grid).collect()}
    assert len(calls) == 2  # one pass for each number of samples
    assert got[(-1.0, 5, 4)]["error"] and got[(-1.0, 5, 4)]["clusters"] is None
    for eps, size, samples in grid[1:3]:
        labels = cluster.label_stats(cluster.density_clusters(rows, eps, size, samples)).head()
        row = got[(eps, size, samples)]
        assert (row["clusters"], round(row["noise_ratio"], 9)) == (labels["clusters"], round(labels["noise_ratio"], 9))


def test_empty_and_single(spark):
    rows = rows_of(spark, np.zeros((1, 2)))
    assert tree.reach_tree(rows, 1.0).collect() == []
    one = cluster.density_sweep(rows, [(1.0, 5, 5)]).head()
    assert (one["clusters"], one["noise_ratio"]) == (0, 1.0)
    assert tree.reach_tree(rows.where(F.lit(False)), 1.0).collect() == []
