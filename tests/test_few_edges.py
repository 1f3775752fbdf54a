import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import cluster, tree


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_and_forest_are_the_same_in_one_task_and_in_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(cluster, "FEW_EDGES", few)
    if few:
        def rounds(*_a):
            raise AssertionError("rounds over the whole table for a few edges")
        monkeypatch.setattr(cluster, "_large_star", rounds)
        monkeypatch.setattr(tree, "_jumped", rounds)
    rng = np.random.default_rng(1)
    ends = {tuple(sorted(map(int, p))) for p in rng.integers(0, 60, (70, 2)) if p[0] != p[1]}
    parts = {v: v for v in range(60)}
    for _ in range(60):
        for u, v in ends:
            parts[u] = parts[v] = min(parts[u], parts[v])
    edges = spark.createDataFrame([(u, v, float(rng.integers(1, 9))) for u, v in sorted(ends)], "id long, neighbour_id long, reach double")
    nodes = spark.range(60).select("id")
    assert {r["id"]: r["component"] for r in cluster.connected_components(nodes, edges).collect()} == parts
    pair = lambda c: F.struct(F.lit(1).alias("setting"), F.col(c).alias("id")).alias(c)
    found = cluster.connected_components(nodes.select(pair("id")), edges.select(pair("id"), pair("neighbour_id")))
    assert {r["id"]["id"]: r["component"]["id"] for r in found.collect()} == parts
    rows = sorted((r["reach"], r["id"], r["neighbour_id"]) for r in edges.collect())
    at, want = list(range(60)), set()
    for _, u, v in rows:
        if at[u] != at[v]:
            want.add((u, v))
            at = [at[u] if x == at[v] else x for x in at]
    assert {(r["id"], r["neighbour_id"]) for r in tree.least_tree(edges).collect()} == want
