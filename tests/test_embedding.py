import numpy as np

from facetry.functions import color as C
from facetry.operators import calibrate, embed
from facetry.operators import neighbours as nb
from facetry.operators import similarity


def test_graph_is_symmetric_and_structure_keeps_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = np.repeat(rng.normal(size=(4, 6)) * 4, 15, axis=0)
    x = centres + rng.normal(size=(60, 6)) * 0.3
    v = spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(60)], "entity_id bigint, vector array<double>")
    rows = nb.dense_rows(v, "entity_id", "vector")
    graph = nb.reliable(embed.knn_graph(rows, 8))
    w = {(r.i, r.j): r.w for r in graph.collect()}
    assert all(0 < value <= 1 + 1e-12 and abs(w[(j, i)] - value) < 1e-12 for (i, j), value in w.items())
    out = embed.structural_embed(graph, 4, 12)
    e = np.array([r.embedding for r in out.orderBy("entity_id").collect()])
    assert np.abs(e.T @ e / 60 - np.eye(4)).max() < 1e-6
    kept = similarity.knn_fidelity(nb.knn_join(rows, 8), nb.knn_join(nb.dense_rows(out, "entity_id", "embedding"), 8))
    # neighbours stay within their own cluster of 15
    assert np.mean([r.jaccard for r in kept.collect()]) > 0.2


def test_recalibration_repeats_the_cdfs_and_counts_short_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.normal(size=12)], [float(c) for c in rng.normal(size=3)]) for i in range(50)]
    v = spark.createDataFrame(rows, "entity_id bigint, embedding array<double>, color_raw array<double>")
    s = nb.reliable(calibrate.sphere_coords(v))
    cal = nb.reliable(calibrate.calibrate_colors(s))
    short = spark.createDataFrame([(99, [1.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0])], s.schema)
    again = calibrate.recalibrate(s.unionByName(short), cal).first()
    before = cal.first()
    assert again.skipped == 1
    for name in calibrate.CDF_COLUMNS:
        assert len(before[name]) == 512 and np.allclose(again[name], before[name], atol=1e-12)
    colors = calibrate.color_entities(s.unionByName(s.limit(1).selectExpr(
        "entity_id + 1000 AS entity_id", "embedding", "color_raw", "cast(null AS array<double>) AS color_xyz")), cal)
    got = {r.entity_id: r.color for r in colors.collect()}
    assert sum(c == C.NO_COLOR for c in got.values()) == 1 and all(len(c) == 7 for c in got.values())
