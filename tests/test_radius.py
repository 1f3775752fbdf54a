import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.functions import color as C
from facetry.operators import cells, grid


def places(spark, name, lat, lon):
    rows = [(i, None if a is None else float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    return spark.createDataFrame(rows, f"{name} long, lat double, lon double")


@pytest.mark.parametrize("radius", [0.4, 6.0, 75.0, 400.0])
def test_pairs_within_a_radius(spark, monkeypatch, radius):
    """Poles, the antimeridian, copies and rows without place; cells of many nodes are dealt."""
    monkeypatch.setattr(cells, "MEET_PLACES", 4)
    rng = np.random.default_rng(2)
    at = np.degrees(np.arcsin(rng.uniform(-1, 1, 60))), rng.uniform(-180, 180, 60)
    near = np.concatenate((at[0], [90, 90, -90, 10, 10, 10])), np.concatenate((at[1], [0, 170, 5, 179.9, -179.9, -179.9]))
    sites = np.concatenate((at[0][:30] + 0.1, [89.9, -89.95, 10.1])).clip(-90, 90), np.concatenate((at[1][:30], [90, -90, 180.0]))
    got = grid.radius_sites(places(spark, "node", [*near[0], None], [*near[1], 0]), places(spark, "entity_id", *sites), radius)
    assert "MapInPandas" not in got._jdf.queryExecution().toString()  # pairs stay where they are made
    a, b = (np.radians(np.array(v)) for v in near), (np.radians(np.array(v)) for v in sites)
    (p, q), (r, s) = a, b
    h = np.sin((r[None] - p[:, None]) / 2) ** 2 + np.cos(p)[:, None] * np.cos(r)[None] * np.sin((s[None] - q[:, None]) / 2) ** 2
    degrees = 2 * 6371.0 * np.arcsin(np.sqrt(np.clip(h, 0, 1))) / 111.0
    want = {(int(i), int(j)): round(degrees[i, j], 9) for i, j in zip(*np.nonzero(degrees <= radius))}
    rows = got.collect()
    assert len(rows) == len(want)
    assert {(x["node"], x["entity_id"]): round(x["distance"], 9) for x in rows} == pytest.approx(want, abs=1e-8)


def test_colour_of_a_node_is_summed_where_its_sites_meet_it(spark):
    nodes = places(spark, "node", [0.0, 0.0, 50.0], [0.0, 3.0, 0.0])
    sites = places(spark, "entity_id", [0.1, 0.0, -0.2], [0.0, 1.0, 2.9]).selectExpr("*", "array('#ff0000', '#00ff00', '#0000ff')[entity_id] AS color")
    out = grid.oklab_idw(nodes, sites, 1.5)
    assert "MapInPandas" not in out._jdf.queryExecution().toString()
    rows = {r["node"]: r for r in out.collect()}
    assert {n: r["sites"] for n, r in rows.items()} == {0: 2, 1: 1}  # the third node has no site
    lab = {r["entity_id"]: r for r in sites.select("entity_id", C.hex_to_oklab(F.col("color")).alias("p")).selectExpr("entity_id", "p.L", "p.a", "p.b").collect()}
    degree = 6371.0 * np.pi / 180 / 111.0
    w = 1 / (0.1 * degree + 0.001) ** 2, 1 / (1.0 * degree + 0.001) ** 2
    assert rows[0]["L"] == pytest.approx((w[0] * lab[0]["L"] + w[1] * lab[1]["L"]) / sum(w))
    assert rows[1]["a"] == pytest.approx(lab[2]["a"])
