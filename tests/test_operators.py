import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.functions import color as C
from facetry.functions import geo as G
from facetry.functions import keys as K
from facetry.functions import scores as S
from facetry.operators import cluster, embed, ordering, profiles, quality, records, similarity
from facetry.operators import neighbours as nb


def one(df):
    return df.collect()[0]


def test_keys(spark):
    df = spark.createDataFrame([("  Crème Brûlée ", " A  b", "", None)], "k string, a string, b string, c string")
    r = one(df.select(K.canonical_key(F.col("k")).alias("c"), K.slug_key(F.col("k")).alias("s"), K.slug_key(F.lit("ﬁg"), True).alias("x"),
                      K.entity_key(F.col("a"), F.col("b"), F.col("c")).alias("e"), K.entity_key(F.col("b"), F.col("c")).alias("none"),
                      K.family_label(F.lit("soy_sauce"), F.lit(None).cast("string"), F.lit(3)).alias("l"),
                      K.family_label(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(3)).alias("n")))
    assert (r.c, r.s, r.x, r.e, r.none, r.l, r.n) == ("crème brûlée", "creme_brulee", "fig", "a_b", None, "Soy Sauce", "Cluster 4")


def test_scores(spark):
    df = spark.sql("""SELECT parse_json('0.5') AS num, parse_json('"0.5"') AS txt, parse_json('true') AS yes, parse_json('-1') AS neg""")
    r = one(df.select(S.positive_numeric(F.col("num")).alias("num"), S.positive_numeric(F.col("txt")).alias("txt"),
                      S.positive_numeric(F.col("yes")).alias("yes"), S.positive_numeric(F.col("yes"), False).alias("strict"),
                      S.positive_numeric(F.col("neg")).alias("neg"), S.is_filler_tol(F.lit("0.4404")).alias("f1"), S.is_filler_tol(F.lit("0.4406")).alias("f2"),
                      S.is_filler_tol(F.lit("x")).alias("f3"), S.coerce_vector(F.lit("[1, 2.5]")).alias("v"), S.coerce_vector(F.lit("[1, null]")).alias("bad"),
                      S.distance_score(F.lit(0.0)).alias("top"), S.distance_score(F.lit(100.0)).alias("low")))
    assert (r.num, r.txt, r.yes, r.strict, r.neg) == (True, False, True, False, False)
    assert (r.f1, r.f2, r.f3, r.v, r.bad, r.top, r.low) == (True, False, False, [1.0, 2.5], None, 99, 3)


def test_cdf_ranks_extrapolate_clamp_and_handle_plateaus(spark):
    p = F.array(*[F.lit(float(v)) for v in (0, 1, 1, 1, 2)])
    r = one(spark.range(1).select(
        C.equalize_radius(F.lit(3.0), p).alias("above"), C.equalize_radius(F.lit(-1.0), p).alias("below"), C.equalize_radius(F.lit(1.0), p).alias("flat"),
        C.equalize_signed(F.lit(3.0), p).alias("s_above"), C.equalize_signed(F.lit(1.0), p).alias("s_flat"), C.equalize_signed(F.lit(-1.0), p).alias("s_below")))
    assert (r.above, r.below, r.flat) == (1.25, 0.0, 0.25)
    assert (r.s_above, r.s_flat, r.s_below) == (1.0, 0.75, 0.0)


def test_hex_round_trip_and_gamut(spark):
    df = spark.createDataFrame([("#3a7f2c",), ("#ffffff",), ("#000000",), ("#d01055",)], "c string").withColumn("lab", C.hex_to_oklab(F.col("c")))
    for r in df.select("c", C.oklab_to_hex(F.col("lab.L"), F.col("lab.a"), F.col("lab.b"), 5e-4).alias("back")).collect():
        assert r.c == r.back
    r = one(spark.range(1).select(C.fit_chroma(F.lit(0.9), F.lit(0.46), F.lit(260.0)).alias("c"), C.hue_diff(F.lit(350.0), F.lit(10.0)).alias("d")))
    assert 0 < r.c < 0.46 and r.d == 20.0


def test_ring_crosses_the_antimeridian_without_a_jump(spark):
    verts = F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(o)).alias("lon")) for a, o in ((0, 179.5), (0, -179.5), (1, -179.5), (1, 179.5))])
    ring = one(spark.range(1).select(G.close_ring(verts).alias("r"))).r
    assert ring == [[179.5, 0.0], [180.5, 0.0], [180.5, 1.0], [179.5, 1.0], [179.5, 0.0]]


def test_order_statistics_with_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(ordering, "_STRIDE", 8)
    rng = np.random.default_rng(0)
    x = np.concatenate([np.full(100, 0.25), rng.random(211)])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 7.0)], "axis string, x double")
    got = {(r.axis, r.p): r.value for r in ordering.axis_quantiles(df, "axis", "x", [0.02, 0.5, 0.98]).collect()}
    for p in (0.02, 0.5, 0.98):
        assert got[("a", p)] == pytest.approx(np.percentile(x, p * 100), abs=1e-12) and got[("b", p)] == 7.0
    cdf = {r.slot: r.value for r in ordering.cdf_points(df.where("axis = 'a'"), "axis", "x").collect()}
    s = np.sort(x)
    assert cdf == {i: s[int(i * (len(x) - 1) / 511)] for i in range(512)}


def test_positions_are_dense_and_ordered(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.col("id") * 7919, F.lit(13)))
    rows = ordering.with_position(df, F.col("v"), F.col("id")).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.position)] == [r.id for r in sorted(rows, key=lambda r: (r.v, r.id))]
    assert sorted(r.position for r in rows) == list(range(1000))


def test_dedupe_keeps_the_first_of_a_tie(spark):
    e = spark.createDataFrame([(1, " Rome", "IT", 5), (2, "Rome ", "IT", 1), (3, "Rome", None, 0), (4, " ", "IT", 0)], "entity_id int, name string, group string, seq int")
    rich = spark.createDataFrame([(1, 3), (2, 3), (4, 9)], "entity_id int, n_positive int")
    assert sorted(r.entity_id for r in records.dedupe_richest(e, rich, ["seq"]).collect()) == [2, 3]


def test_variance_counts_absent_features_as_zero(spark):
    p = spark.createDataFrame([(1, "ing", "a", 1.0), (2, "ing", "b", 1.0), (3, "ing", "b", 1.0), (4, "ing", "b", 1.0)], "entity_id int, kind string, feature string, score double")
    got = {r.feature: r.variance for r in profiles.feature_variance(p).collect()}
    assert got["a"] == pytest.approx(np.var([1, 0, 0, 0]))


def test_group_similarity_counts_copies_without_listing_pairs(spark):
    rows = [(i, "ing", "a", 1.0) for i in range(10)] + [(10, "ing", "a", 1.0), (10, "ing", "b", 0.05), (11, "ing", "c", 1.0)]
    p = spark.createDataFrame(rows, "entity_id bigint, kind string, feature string, score double")
    g = spark.createDataFrame([(i, "G") for i in range(12)], "entity_id bigint, group string")
    stats = similarity.group_similarity(nb.sparse_rows(p), g)
    r = one(stats)
    assert (r.members, r.pairs, r.identical_pairs, r.high_pairs, r.near_pairs) == (12, 66, 45, 55, 55)
    assert {v.rule for v in quality.homogeneity_rules(stats).collect()} == {"identical_profiles", "homogeneous_group", "near_duplicates"}


def test_twins_match_a_brute_force_greedy_choice(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 8)
    rng = np.random.default_rng(5)
    n = 60
    x, lat, lon = rng.random((n, 4)), rng.uniform(-80, 80, n), rng.uniform(-180, 180, n)
    v = spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(n)], "entity_id bigint, vector array<double>")
    e = spark.createDataFrame([(i, f"e{i}", float(lat[i]), float(lon[i])) for i in range(n)], "entity_id bigint, name string, lat double, lon double")
    got = [(r.id, r.neighbour_id) for r in similarity.farthest_twins(nb.dense_rows(v, "entity_id", "vector"), e).orderBy("round").collect()]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = []
    for i in range(n):
        for j in range(i + 1, n):
            a, b = math.radians(lat[i]), math.radians(lat[j])
            h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon[j] - lon[i]) / 2) ** 2
            if u[i] @ u[j] > 0.7 and 2 * 6371 * math.asin(math.sqrt(h)) > 10000:
                pairs.append((-(u[i] @ u[j]), i, j))
    want, used = [], set()
    for _, i, j in sorted(pairs):
        if len(want) < 5 and i not in used and j not in used:
            want.append((i, j))
            used |= {i, j}
    assert got == want and len(want) == 5


def test_components_and_density_noise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 41)], "id bigint, neighbour_id bigint")
    nodes = spark.createDataFrame([(i,) for i in range(31)] + [(40,), (41,), (50,)], "id bigint")
    got = {r.id: r.component for r in cluster.connected_components(nodes, edges).collect()}
    assert {got[i] for i in range(31)} == {0} and (got[40], got[41], got[50]) == (40, 40, 50)
    v = spark.createDataFrame([(i, [float(i)]) for i in range(10)] + [(20 + i, [100.0 + i]) for i in range(6)] + [(99, [500.0])], "entity_id bigint, vector array<double>")
    labels = {r.entity_id: r.label for r in cluster.density_clusters(nb.dense_rows(v, "entity_id", "vector"), 1.5, 4, 1).collect()}
    assert {labels[i] for i in range(10)} == {0} and {labels[20 + i] for i in range(6)} == {1} and labels[99] == -1


def test_color_embedding_equals_cosine_kernel_pca(spark):
    rng = np.random.default_rng(6)
    x = rng.random((40, 6))
    v = spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(40)], "entity_id bigint, vector array<double>")
    rows, _ = embed.color_embed(v)
    got = np.array([r.color_raw for r in rows.orderBy("entity_id").collect()])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    k = u @ u.T
    c = np.eye(40) - 1 / 40
    w, vec = np.linalg.eigh(c @ k @ c)
    want = vec[:, ::-1][:, :3] * np.sqrt(w[::-1][:3])
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-9


def test_payload_and_proposal_rules(spark):
    from facetry.streaming.incremental import parse_payloads
    good = {"id": "a", "name": "A", "ingredients": {"x": 0.9, "y": 0.2}, "cookingMethods": {"boil": 1}, "famousDishes": ["d"], "extendedAt": "t"}
    docs = [("ok", {"cities": [good]}), ("flat", {"cities": [dict(good, ingredients={"x": 0.45, "y": 0.55}, cookingMethods={"boil": 1})]}),
            ("score", {"cities": [dict(good, ingredients={"x": "0.5", "y": 1.2})]}), ("dish", {"cities": [dict(good, famousDishes=[1])]}),
            ("noid", {"cities": [{k: v for k, v in good.items() if k != "id"}]}),
            ("prop", {"cities": [good], "proposedNewKeys": {"ingredients": [{"key": "k", "mapTo": [], "reason": "r", "confidence": 1.01}], "cookingMethods": []}}),
            ("none", {})]
    df = spark.createDataFrame([(n, json.dumps(d)) for n, d in docs] + [("bad", "{oops")], "payload_id string, payload string")
    cities, proposals, bad = parse_payloads(df)
    found = {(r.entity_id.split("#")[0], r.rule) for r in quality.payload_rules(cities).unionByName(quality.proposal_rules(proposals)).collect()}
    assert found == {("flat", "too_flat"), ("score", "bad_ingredient_score"), ("dish", "dishes_not_texts"), ("noid", "missing_id"), ("prop", "proposal_confidence")}
    assert {(r.payload_id, r.reason) for r in bad.collect()} == {("none", "missing_cities"), ("bad", "invalid_json")}
