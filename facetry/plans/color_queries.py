"""Queries on embeddings, calibration, colours, clusters and the grid."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from facetry.functions import color as C
from facetry.functions import geo as G
from facetry.functions import vectors as V
from facetry.operators import calibrate, cells, cluster, cover, embed, grid, ordering, profiles
from facetry.operators import neighbours as nb
from facetry.plans import bindings as B
from facetry.plans import insights
from facetry.plans.registry import query, tidy
from facetry.runtime import reliable

AXES = "ax AS (SELECT 'x' AS axis, vector[1] AS x FROM em UNION ALL SELECT 'y', vector[2] FROM em UNION ALL SELECT 'z', vector[3] FROM em)"


def _axes(spark, sf):
    v = F.col("vector")
    return calibrate.axis_rows(B.embeddings(spark, sf), {"x": v[0], "y": v[1], "z": v[2]})


@query("axis_quantiles", f"""WITH {B.EM}, {AXES}, p AS (SELECT unnest([0.02, 0.25, 0.5, 0.75, 0.98])::DOUBLE AS p)
SELECT axis, p, round(CASE p WHEN 0.02 THEN quantile_cont(x, 0.02) WHEN 0.25 THEN quantile_cont(x, 0.25) WHEN 0.5 THEN quantile_cont(x, 0.5) WHEN 0.75 THEN quantile_cont(x, 0.75) ELSE quantile_cont(x, 0.98) END, 6) AS value
FROM ax, p GROUP BY axis, p""")
def axis_quantiles(spark, sf):
    return tidy(ordering.axis_quantiles(_axes(spark, sf), "axis", "x", [0.02, 0.25, 0.5, 0.75, 0.98]))


_SKETCHED = [0.02, 0.25, 0.5, 0.75, 0.98]


@query("price_sketches", """SELECT l_suppkey AS axis, p, true AS within, n FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), (SELECT unnest([0.02, 0.25, 0.5, 0.75, 0.98]::DOUBLE[]) AS p)""")
def price_sketches(spark, sf):
    """Price quantiles of every supplier from sketches of two halves that were merged; all within twice the stated rank error."""
    from facetry.operators import sketch

    li = B.table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_extendedprice")
    halves = [sketch.axis_sketches(li.where(F.col("l_linenumber") <= 3), "l_suppkey", "l_extendedprice", 400), sketch.axis_sketches(li.where(F.col("l_linenumber") > 3), "l_suppkey", "l_extendedprice", 400)]
    merged = reliable(sketch.merged_sketches(halves[0].unionByName(halves[1]), "l_suppkey"))
    found = reliable(sketch.sketch_quantiles(merged, "l_suppkey", _SKETCHED))
    errors = sketch.rank_errors(li, "l_suppkey", "l_extendedprice", found)
    return tidy(errors.join(merged.select("l_suppkey", "n"), "l_suppkey").select(
        F.col("l_suppkey").alias("axis"), "p", (F.col("error") <= 2 * sketch.rank_error(400)).alias("within"), "n"))


@query("price_quantiles", """SELECT l_returnflag AS axis, 0.98::DOUBLE AS p, round(quantile_cont(l_extendedprice, 0.98), 6) AS value FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 0.5, round(quantile_cont(l_extendedprice, 0.5), 6) FROM lineitem GROUP BY 1""")
def price_quantiles(spark, sf):
    """The same quantiles over the largest table."""
    return tidy(ordering.axis_quantiles(B.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", [0.5, 0.98]).withColumnRenamed("l_returnflag", "axis"))


@query("cdf_points", f"""WITH {B.EM}, {AXES}, s AS (SELECT axis, x, row_number() OVER (PARTITION BY axis ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY axis) AS n FROM ax),
i AS (SELECT unnest(range(512)) AS slot), w AS (SELECT DISTINCT axis, slot, floor(slot * (n - 1) / 511)::BIGINT AS r FROM s, i)
SELECT axis, slot, round(x, 6) AS value FROM w JOIN s USING (axis, r)""")
def cdf_points(spark, sf):
    return tidy(ordering.cdf_points(_axes(spark, sf), "axis", "x"))


SPHERE = f"""{B.EM}, med AS (SELECT quantile_cont(vector[1], 0.5) AS mx, quantile_cont(vector[2], 0.5) AS my, quantile_cont(vector[3], 0.5) AS mz FROM em),
cen AS (SELECT entity_id, name, "group", supergroup, vector, vector[1] - mx AS x, vector[2] - my AS y, vector[3] - mz AS z FROM em, med),
sc AS (SELECT greatest(quantile_cont(sqrt(x * x + y * y + z * z), 0.98), 1e-8) AS s FROM cen),
sph AS (SELECT entity_id, name, "group", supergroup, vector, x / s AS x, y / s AS y, z / s AS z FROM cen, sc),
geo3 AS (SELECT *, atan2(y, x) + pi() AS az, atan2(z, sqrt(x * x + y * y)) AS el, sqrt(x * x + y * y) AS rad FROM sph)"""


def _sphere(spark, sf):
    rows = B.embeddings(spark, sf).withColumn("color_raw", F.slice("vector", 1, 3))
    return reliable(calibrate.sphere_coords(rows))


@query("sphere_coords", f"WITH {SPHERE} SELECT entity_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(az, 6) AS azimuth, round(el, 6) AS elevation, round(rad, 6) AS radius FROM geo3")
def sphere_coords(spark, sf):
    s = _sphere(spark, sf)
    xyz = F.col("color_xyz")
    return tidy(s.select("entity_id", xyz[0].alias("x"), xyz[1].alias("y"), xyz[2].alias("z"), calibrate.azimuth(xyz).alias("azimuth"),
                         calibrate.elevation(xyz).alias("elevation"), F.hypot(xyz[0], xyz[1]).alias("radius")))


def _cdf_sql(name: str, expr: str) -> str:
    return f"""{name}_s AS (SELECT {expr} AS v, row_number() OVER (ORDER BY {expr}) - 1 AS r, count(*) OVER () AS n FROM geo3),
{name} AS (SELECT list(v ORDER BY slot) AS p FROM (SELECT slot, v FROM (SELECT slot, floor(slot * ((SELECT count(*) FROM geo3) - 1) / 511)::BIGINT AS r FROM (SELECT unnest(range(512)) AS slot)) JOIN {name}_s USING (r)))"""


def _rank_sql(value: str, points: str) -> str:
    """Lower bound and linear interpolation in a list of points."""
    lo = f"least(len(list_filter({points}, lambda q: q < {value})), 511)"
    return (f"CASE WHEN {lo} > 0 THEN ({lo} - 1 + CASE WHEN {points}[{lo} + 1] > {points}[{lo}] THEN ({value} - {points}[{lo}]) / ({points}[{lo} + 1] - {points}[{lo}]) ELSE 0 END) / 511 ELSE 0 END")


_CDFS = ", ".join([_cdf_sql("cdf_a", "az"), _cdf_sql("cdf_r", "rad"), _cdf_sql("cdf_z", "z")])
RANKS = f"""{SPHERE}, {_CDFS},
rk AS (SELECT geo3.*, {_rank_sql("az", "cdf_a.p")} AS ra, {_rank_sql("rad", "cdf_r.p")} AS rr, {_rank_sql("z", "cdf_z.p")} AS rz FROM geo3, cdf_a, cdf_r, cdf_z),
lch AS (SELECT *, (ra * 2 * pi() * 180 / pi()) % 360 AS hue, least(greatest(0.10 + 0.36 * rr, 0.10), 0.46) AS chroma, least(greatest(0.45 + 0.45 * pow(rz, 0.55), 0.45), 0.90) AS lightness FROM rk)"""


def _three_cdfs(s, extra=None):
    """A calibration with only the CDFs that the newest colour form needs."""
    xyz = F.col("color_xyz")
    axes = {"angle_percentiles": calibrate.azimuth(xyz), "radius_percentiles": F.hypot(xyz[0], xyz[1]), "z_percentiles": xyz[2]}
    points = reliable(ordering.cdf_points(calibrate.axis_rows(s, axes), "axis", "x"))
    cdf = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("axis") == n, F.struct("slot", "value")))), lambda p: p["value"])
    return reliable(points.agg(*[cdf(n).alias(n) for n in axes]))


@query("equalize_rank", f"WITH {RANKS} SELECT entity_id, round(ra * 2 * pi(), 6) AS angle, round(rr, 6) AS radius, round(rz, 6) AS z FROM rk")
def equalize_rank(spark, sf):
    s = _sphere(spark, sf)
    xyz = F.col("color_xyz")
    rows = s.withColumn("cal", _three_cdfs(s).agg(F.first(F.struct("angle_percentiles", "radius_percentiles", "z_percentiles")).alias("c")).scalar())
    return tidy(rows.select("entity_id", C.equalize_angle(calibrate.azimuth(xyz), F.col("cal.angle_percentiles")).alias("angle"),
                            C.equalize_radius(F.hypot(xyz[0], xyz[1]), F.col("cal.radius_percentiles")).alias("radius"),
                            C.equalize_radius(xyz[2], F.col("cal.z_percentiles")).alias("z")))


@query("equalize_signed", f"""WITH {SPHERE}, {_cdf_sql("cdf_z", "z")}, v AS (SELECT entity_id, z * 1.5 AS v, p, len(list_filter(p, lambda q: q <= z * 1.5)) AS k FROM geo3, cdf_z)
SELECT entity_id, round(CASE WHEN v <= p[1] THEN 0 WHEN v >= p[512] THEN 1 ELSE (k - 1 + CASE WHEN p[k + 1] > p[k] THEN (v - p[k]) / (p[k + 1] - p[k]) ELSE 0 END) / 511 END, 6) AS rank FROM v""")
def equalize_signed(spark, sf):
    """Clamped rank of stretched values, so that some lie outside the CDF."""
    s = _sphere(spark, sf)
    rows = s.withColumn("p", _three_cdfs(s).agg(F.first("z_percentiles").alias("c")).scalar())
    return tidy(rows.select("entity_id", C.equalize_signed(F.col("color_xyz")[2] * 1.5, F.col("p")).alias("rank")))


def _rgb_sql(chroma: str) -> str:
    a, b = f"({chroma}) * cos(radians(hue))", f"({chroma}) * sin(radians(hue))"
    l3, m3, s3 = (f"pow(lightness + {k1} * {a} + {k2} * {b}, 3)" for k1, k2 in C.LAB_TO_LMS)
    return [f"({r[0]} * {l3} + {r[1]} * {m3} + {r[2]} * {s3})" for r in C.LMS_TO_RGB]


def _gamut_sql(chroma: str) -> str:
    return " AND ".join(f"{c} BETWEEN -5e-4 AND 1 + 5e-4" for c in _rgb_sql(chroma))


def _hex_sql(linear: str) -> str:
    x = f"least(greatest({linear}, 0), 1)"
    return f"format('{{:02x}}', round_even((CASE WHEN {x} <= 0.0031308 THEN 12.92 * {x} ELSE 1.055 * pow({x}, 1 / 2.4) - 0.055 END) * 255, 0)::INT)"


_R, _GREEN, _BLUE = _rgb_sql("c")
HEX = f"""{RANKS}, bis AS (SELECT 0 AS step, entity_id, lightness, hue, 0.0::DOUBLE AS lo, chroma AS hi, chroma, {_gamut_sql("chroma")} AS fits FROM lch
  UNION ALL SELECT step + 1, entity_id, lightness, hue, CASE WHEN {_gamut_sql("(lo + hi) / 2")} THEN (lo + hi) / 2 ELSE lo END,
   CASE WHEN {_gamut_sql("(lo + hi) / 2")} THEN hi ELSE (lo + hi) / 2 END, chroma, fits FROM bis WHERE step < 18),
fin AS (SELECT entity_id, lightness, hue, CASE WHEN fits THEN chroma ELSE lo END AS c, chroma FROM bis WHERE step = 18),
hexes AS (SELECT entity_id, '#' || {_hex_sql(_R)} || {_hex_sql(_GREEN)} || {_hex_sql(_BLUE)} AS color FROM fin)"""


@query("oklch_linear_rgb", f"WITH {RANKS} SELECT entity_id, round({_rgb_sql('chroma')[0]}, 6) AS r, round({_rgb_sql('chroma')[1]}, 6) AS g, round({_rgb_sql('chroma')[2]}, 6) AS b FROM lch")
def oklch_linear_rgb(spark, sf):
    s = _sphere(spark, sf)
    rows = calibrate.color_entities(s, _three_cdfs(s)).withColumn("rgb", C.oklch_to_linear_rgb(F.col("lightness"), F.col("chroma"), F.col("hue")))
    return tidy(rows.select("entity_id", "rgb.r", "rgb.g", "rgb.b"))


@query("entity_colors", f"WITH RECURSIVE {HEX} SELECT entity_id, round(hue, 6) AS hue, round(chroma, 6) AS chroma, round(lightness, 6) AS lightness, color FROM lch JOIN hexes USING (entity_id)")
def entity_colors(spark, sf):
    s = _sphere(spark, sf)
    return tidy(calibrate.color_entities(s, _three_cdfs(s)).select("entity_id", "hue", "chroma", "lightness", "color"))


@query("luminance", f"""WITH RECURSIVE {HEX}, ch AS (SELECT entity_id, ('0x' || color[2:3])::INT / 255 AS r, ('0x' || color[4:5])::INT / 255 AS g, ('0x' || color[6:7])::INT / 255 AS b FROM hexes),
y AS (SELECT entity_id, 0.2126 * CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END + 0.7152 * CASE WHEN g <= 0.04045 THEN g / 12.92 ELSE pow((g + 0.055) / 1.055, 2.4) END
 + 0.0722 * CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END AS y FROM ch)
SELECT entity_id, round(y, 6) AS luminance, CASE WHEN y > 0.35 THEN '#000' ELSE '#fff' END AS label FROM y""")
def luminance(spark, sf):
    s = _sphere(spark, sf)
    rows = calibrate.color_entities(s, _three_cdfs(s))
    return tidy(rows.select("entity_id", C.luminance(F.col("color")).alias("luminance"), C.label_color(F.col("color")).alias("label")))


@query("hue_diff", f"""WITH {B.EM}, h AS (SELECT entity_id, degrees(atan2(vector[2], vector[1])) + 180 AS hue FROM em)
SELECT a.entity_id, round(least(abs(a.hue - b.hue), 360 - abs(a.hue - b.hue)), 6) AS gap FROM h a JOIN h b ON b.entity_id = a.entity_id + 1""")
def hue_diff(spark, sf):
    h = B.embeddings(spark, sf).select("entity_id", (F.degrees(F.atan2(F.col("vector")[1], F.col("vector")[0])) + 180).alias("hue"))
    after = h.select((F.col("entity_id") - 1).alias("entity_id"), F.col("hue").alias("next"))
    return tidy(h.join(after, "entity_id").select("entity_id", C.hue_diff(F.col("hue"), F.col("next")).alias("gap")))


@query("normalize_robust", f"""WITH {B.EM}, q AS (SELECT quantile_cont(vector[1], 0.02) AS p02, quantile_cont(vector[1], 0.5) AS p50, quantile_cont(vector[1], 0.98) AS p98 FROM em)
SELECT entity_id, round(least(greatest((vector[1] - p50) / CASE WHEN vector[1] >= p50 THEN greatest(1e-8, p98 - p50) ELSE greatest(1e-8, p50 - p02) END, -1), 1), 6) AS norm,
 round(least(greatest((vector[1] - p02) / greatest(1e-8, p98 - p02), 0), 1) * 2 - 1, 6) AS older FROM em, q""")
def normalize_robust(spark, sf):
    e = reliable(B.embeddings(spark, sf))
    q = calibrate.quantile_struct(calibrate.axis_rows(e, {"u": F.col("vector")[0]}), ["u"])
    rows = e.withColumn("q", q)
    x, u = F.col("vector")[0], F.col("q.u")
    return tidy(rows.select("entity_id", V.normalize_robust(x, u["p02"], u["p50"], u["p98"]).alias("norm"),
                            V.normalize_robust(x, u["p02"], F.lit(None).cast("double"), u["p98"]).alias("older")))


@query("circular_std", f"""WITH {SPHERE}, a AS (SELECT "group", az + el AS t FROM geo3), r AS (SELECT "group", count(*) AS members, greatest(sqrt(pow(avg(cos(t)), 2) + pow(avg(sin(t)), 2)), 1e-10) AS r FROM a GROUP BY 1)
SELECT "group", members, round(degrees(sqrt(-2 * ln(r))), 6) AS hue_std_deg FROM r WHERE members >= 4 ORDER BY hue_std_deg DESC, "group" LIMIT 5""")
def circular_std(spark, sf):
    """Groups with the widest hue spread."""
    return tidy(insights.diverse_groups(_sphere(spark, sf)))


@query("axis_coverage", f"""WITH {SPHERE}, ax AS (SELECT 'x' AS axis, x FROM geo3 UNION ALL SELECT 'y', y FROM geo3 UNION ALL SELECT 'z', z FROM geo3)
SELECT axis, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x) + 0, 6) AS mean, round(stddev_pop(x), 6) AS std, round(avg(CASE WHEN abs(x) >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS clipped FROM ax GROUP BY 1""")
def axis_coverage(spark, sf):
    xyz = F.col("color_xyz")
    return tidy(grid.axis_coverage(calibrate.axis_rows(_sphere(spark, sf), {"x": xyz[0], "y": xyz[1], "z": xyz[2]}), 0.5))


@query("supergroup_panel", f"WITH {SPHERE} SELECT entity_id, supergroup, coalesce(list_position(['7', '3', '1'], supergroup::VARCHAR), 4) - 1 AS panel, round(az, 6) AS hue FROM geo3")
def supergroup_panel(spark, sf):
    rows = _sphere(spark, sf).withColumn("hue", calibrate.azimuth(F.col("color_xyz"))).withColumn("supergroup", F.col("supergroup").cast("string"))
    return tidy(grid.supergroup_panel(rows, ["7", "3", "1"]).select("entity_id", F.col("supergroup").cast("bigint").alias("supergroup"), "panel", "hue"))


@query("supergroup_members", f"""WITH {SPHERE}, p AS (SELECT *, coalesce(list_position(['7', '3', '1'], supergroup::VARCHAR), 4) - 1 AS panel FROM geo3)
SELECT panel, supergroup, row_number() OVER (PARTITION BY supergroup ORDER BY az, entity_id) AS rank, entity_id, count(*) OVER (PARTITION BY supergroup) AS members FROM p""")
def supergroup_members(spark, sf):
    rows = _sphere(spark, sf).withColumn("supergroup", F.col("supergroup").cast("string"))
    rows = rows.withColumn("hue", calibrate.azimuth(F.col("color_xyz")))
    return tidy(grid.supergroup_members(rows, ["7", "3", "1"]).withColumn("supergroup", F.col("supergroup").cast("bigint")))


@query("extent", f"WITH {B.EM} SELECT round(min(vector[1]) - (max(vector[1]) - min(vector[1])) * 0.06, 6) AS u_min, round(max(vector[1]) + (max(vector[1]) - min(vector[1])) * 0.06, 6) AS u_max, round(min(vector[2]) - (max(vector[2]) - min(vector[2])) * 0.06, 6) AS v_min, round(max(vector[2]) + (max(vector[2]) - min(vector[2])) * 0.06, 6) AS v_max FROM em")
def extent(spark, sf):
    e = B.embeddings(spark, sf).select(F.col("vector")[0].alias("u"), F.col("vector")[1].alias("v"))
    return tidy(grid.extent(e, ["u", "v"]))


# ---------------------------------------------------------------- embeddings and clusters (checked by invariants in the tests)

def _full_build(spark, sf):
    """Embedding, colour coordinates and calibration of the vectors."""
    e = B.embeddings(spark, sf)
    colored, _ = embed.color_embed(e)
    rows = reliable(calibrate.sphere_coords(embed.pca_embed(colored, 12)))
    return rows, reliable(calibrate.calibrate_colors(rows))


@query("color_embed")
def color_embed(spark, sf):
    profile = profiles.idf_weight(profiles.l1_normalize(B.supplier_profile(spark, sf)))
    rows, _ = embed.color_embed(reliable(embed.dense_profile(profile, 5)))
    return tidy(rows.select("entity_id", *[F.col("color_raw")[i].alias(f"c{i}") for i in range(3)]))


@query("calibration")
def calibration(spark, sf):
    _, cal = _full_build(spark, sf)
    return cal.select("version", F.size("mu").alias("dims"), *[F.size(c).alias(c) for c in calibrate.CDF_COLUMNS], "hash")


@query("recalibrate")
def recalibrate(spark, sf):
    """CDFs rebuilt from saved vectors and the saved axes: sizes, skipped rows and the new fingerprint."""
    rows, cal = _full_build(spark, sf)
    again = calibrate.recalibrate(rows, cal)
    return again.select("skipped", *[F.size(c).alias(c) for c in calibrate.CDF_COLUMNS], "hash")


@query("calibrated_colors")
def calibrated_colors(spark, sf):
    rows, cal = _full_build(spark, sf)
    normed = calibrate.axis_norms(rows, cal)
    return tidy(calibrate.color_entities(normed, cal, w_abs_col="w_abs").select("entity_id", "hue", "chroma", "lightness", "color", "u", "v", "w"))


@query("legacy_colors")
def legacy_colors(spark, sf):
    rows, cal = _full_build(spark, sf)
    normed = calibrate.axis_norms(rows, cal)
    hue = F.pmod(F.degrees(F.atan2("v", "u") + math.pi), F.lit(360.0))
    return tidy(normed.select("entity_id", C.legacy_color(F.col("u"), F.col("v"), F.col("w"), hue).alias("c")).select("entity_id", "c.color", "c.lightness", "c.chroma"))


@query("knn_graph")
def knn_graph(spark, sf):
    return tidy(embed.knn_graph(nb.dense_rows(B.embeddings(spark, sf), "entity_id", "vector"), 20))


@query("structural_embed")
def structural_embed(spark, sf):
    graph = embed.knn_graph(nb.dense_rows(B.embeddings(spark, sf), "entity_id", "vector"), 20)
    rows = embed.structural_embed(graph, 12)
    return tidy(rows.select("entity_id", *[F.col("embedding")[i].alias(f"e{i:02d}") for i in range(12)]))


@query("sparse_axes")
def sparse_axes(spark, sf):
    """Colour coordinates of customers straight from their long profiles, with the residual of the axes."""
    from facetry.operators import subspace

    profile = reliable(profiles.idf_weight(profiles.l1_normalize(B.customer_profile(spark, sf))))
    rows, found = subspace.sparse_color_embed(profile, 3, 5)
    xyz = F.col("color_raw")
    return tidy(rows.select("entity_id", *[xyz[i].alias(f"axis_{i}") for i in range(3)], F.lit(found.residual <= 1e-4).alias("settled")))


@query("kmeans_families")
def kmeans_families(spark, sf):
    """Customer families: clusters of profile coordinates, named by their strongest features."""
    profile = reliable(profiles.idf_weight(profiles.l1_normalize(B.customer_profile(spark, sf))))
    vectors = reliable(embed.dense_profile(profile, 5))
    colored, _ = embed.color_embed(vectors)
    rows = reliable(calibrate.sphere_coords(embed.pca_embed(colored, 12).drop("vector")))  # later steps take the coordinates
    cal = reliable(calibrate.calibrate_colors(rows))
    normed = calibrate.axis_norms(rows, cal).join(B.customers(spark, sf).select("entity_id", "supergroup"), "entity_id")
    return tidy(insights.families(reliable(normed), profile, cal))


@query("family_listing")
def family_listing(spark, sf):
    """Customer families, largest first, beside the labels of the four largest."""
    return tidy(insights.family_listing(reliable(kmeans_families(spark, sf))))


@query("cluster_summary", f"""WITH {SPHERE} SELECT supergroup AS label, count(*) AS members, string_agg(DISTINCT "group"::VARCHAR, ',' ORDER BY "group"::VARCHAR) AS groups, round(avg(x) + 0, 6) AS x, round(avg(y) + 0, 6) AS y, round(avg(z) + 0, 6) AS z, round(avg(abs(vector[4])), 6) AS w_abs FROM geo3 GROUP BY 1""")
def cluster_summary(spark, sf):
    rows = _sphere(spark, sf).withColumn("label", F.col("supergroup")).withColumn("w_abs", F.abs(F.col("vector")[3]))
    s = cluster.cluster_summary(rows, supergroup_col="group")
    xyz = F.col("color_xyz")
    return tidy(s.select("label", "members", F.concat_ws(",", "supergroups").alias("groups"), xyz[0].alias("x"), xyz[1].alias("y"), xyz[2].alias("z"), "w_abs"))


_DIST = f"""{B.EM}, d AS (SELECT a.entity_id AS i, b.entity_id AS j, list_distance(a.vector, b.vector) AS d FROM em a JOIN em b ON a.entity_id <> b.entity_id),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 5), core AS (SELECT i, max(d) AS core FROM k GROUP BY 1)"""


@query("mutual_reachability", f"""WITH {_DIST} SELECT k.i, k.j, round(k.d, 6) AS d, round(greatest(a.core, b.core, k.d), 6) AS reach FROM k JOIN core a ON a.i = k.i JOIN core b ON b.i = k.j""")
def mutual_reachability(spark, sf):
    return tidy(cluster.mutual_reachability(nb.dense_rows(B.embeddings(spark, sf), "entity_id", "vector"), 5))


EPS = 1.12


@query("density_clusters", f"""WITH RECURSIVE {_DIST}, e AS (SELECT d.i, d.j FROM d JOIN core a ON a.i = d.i JOIN core b ON b.i = d.j WHERE greatest(d, a.core, b.core) <= {EPS}),
reach AS (SELECT i, i AS j FROM core WHERE core <= {EPS} UNION SELECT reach.i, e.j FROM reach JOIN e ON e.i = reach.j),
comp AS (SELECT i, min(j) AS c FROM reach GROUP BY 1), big AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) - 1 AS label FROM comp GROUP BY 1 HAVING count(*) >= 5)
SELECT entity_id, coalesce(label, -1) AS label FROM em LEFT JOIN comp ON comp.i = entity_id LEFT JOIN big ON big.c = comp.c""")
def density_clusters(spark, sf):
    return tidy(cluster.density_clusters(nb.dense_rows(B.embeddings(spark, sf), "entity_id", "vector"), EPS, 5, 5))


_SWEEP = f"""WITH RECURSIVE {_DIST}, g AS (SELECT unnest([1.0::DOUBLE, {EPS}::DOUBLE]) AS eps),
e AS (SELECT eps, d.i, d.j FROM d JOIN core a ON a.i = d.i JOIN core b ON b.i = d.j JOIN g ON greatest(d, a.core, b.core) <= eps),
reach AS (SELECT eps, i, i AS j FROM core JOIN g ON core <= eps UNION SELECT reach.eps, reach.i, e.j FROM reach JOIN e ON e.i = reach.j AND e.eps = reach.eps),
comp AS (SELECT eps, i, min(j) AS c FROM reach GROUP BY 1, 2), big AS (SELECT eps, c, count(*) AS n FROM comp GROUP BY 1, 2 HAVING count(*) >= 5),
r AS (SELECT g.eps, count(c) AS clusters, coalesce(sum(n), 0) AS held FROM g LEFT JOIN big ON big.eps = g.eps GROUP BY 1)
SELECT eps, 5 AS min_cluster_size, 5 AS min_samples, clusters, round(1 - held / (SELECT count(*) FROM em), 6) AS noise_ratio, NULL::VARCHAR AS error FROM r
UNION ALL SELECT -1.0, 5, 5, NULL, NULL, 'eps must not be negative'"""


@query("density_sweep", _SWEEP)
def density_sweep(spark, sf):
    rows = nb.dense_rows(B.embeddings(spark, sf), "entity_id", "vector")
    return tidy(cluster.density_sweep(rows, [(1.0, 5, 5), (EPS, 5, 5), (-1.0, 5, 5)]))


@query("label_stats", """SELECT count(DISTINCT label) FILTER (WHERE label <> 3) AS clusters, count(*) AS entities, round(avg(CASE WHEN label = 3 THEN 1.0 ELSE 0.0 END), 6) AS noise_ratio FROM embeddings""")
def label_stats(spark, sf):
    """Cluster count and noise share, with label 3 read as noise."""
    e = B.table(spark, sf, "embeddings").select(F.when(F.col("label") == 3, -1).otherwise(F.col("label")).alias("label"))
    return tidy(cluster.label_stats(e))


@query("silhouette", f"""WITH {B.EM}, d AS (SELECT a.entity_id, a.supergroup AS own, b.supergroup AS other, sum(pow(list_distance(a.vector, b.vector), 2)) AS s, count(*) AS n FROM em a JOIN em b ON true GROUP BY 1, 2, 3),
p AS (SELECT entity_id, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY 1)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM p""")
def silhouette(spark, sf):
    e = B.embeddings(spark, sf).withColumn("label", F.col("supergroup"))
    return tidy(cluster.silhouette(e))


@query("quality_gates", f"""WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = 3) AS k FROM embeddings) SELECT round(k / n, 6) AS noise_ratio, CASE WHEN k / n > 0.05 THEN 'silhouette,noise_ratio' ELSE 'silhouette' END AS failed_gates, 'degraded' AS status FROM s""")
def quality_gates(spark, sf):
    from facetry.operators.quality import quality_gates as gates
    stats = label_stats(spark, sf).withColumn("silhouette", F.lit(0.1))
    return gates(stats, max_noise=0.05).select("noise_ratio", "failed_gates", "status")


@query("max_min_colors")
def max_min_colors(spark, sf):
    s = _sphere(spark, sf)
    colors = calibrate.color_entities(s, _three_cdfs(s)).select(F.col("entity_id").alias("id"), "color")
    return tidy(calibrate.max_min_colors(colors, 8))


# ---------------------------------------------------------------- geography

_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


@query("haversine", f"WITH {B.CM} SELECT a.entity_id, round({_KM.format(a='a', b='b')}, 6) AS km FROM cm a JOIN cm b ON b.entity_id = a.entity_id + 1")
def haversine(spark, sf):
    c = B.customers(spark, sf).select("entity_id", "lat", "lon")
    after = c.select((F.col("entity_id") - 1).alias("entity_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return tidy(c.join(after, "entity_id").select("entity_id", G.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("km")))


@query("unit_xyz", f"WITH {B.CM} SELECT entity_id, round(cos(radians(lat)) * cos(radians(lon)), 6) AS x, round(cos(radians(lat)) * sin(radians(lon)), 6) AS y, round(sin(radians(lat)), 6) AS z FROM cm")
def unit_xyz(spark, sf):
    c = B.customers(spark, sf).withColumn("p", G.unit_xyz(F.col("lat"), F.col("lon")))
    return tidy(c.select("entity_id", *[F.col("p")[i].alias(n) for i, n in enumerate("xyz")]))


@query("bbox", f"WITH {B.CM} SELECT entity_id FROM cm WHERE lat BETWEEN -10.5 AND 40.2 AND lon BETWEEN -20.3 AND 100.7")
def bbox(spark, sf):
    c = B.customers(spark, sf)
    return c.where(G.bbox_filter(F.col("lat"), F.col("lon"), -10.5, -20.3, 40.2, 100.7)).select("entity_id")


@query("geo_points", f"WITH {B.CM} SELECT entity_id, round(lon, 6) AS x, round(lat, 6) AS y, 'Point' AS kind FROM cm")
def geo_points(spark, sf):
    c = B.customers(spark, sf).withColumn("point", G.to_point(F.col("lat"), F.col("lon")))
    return tidy(c.select("entity_id", F.col("point.coordinates")[0].alias("x"), F.col("point.coordinates")[1].alias("y"), F.col("point.type").alias("kind")))


# Customers are the cells, suppliers the sites: both grow with the data.

_SITES = f"""{B.CM}, {B.SM}, dd AS (SELECT cm.entity_id AS cell, sm.entity_id AS site, sqrt(pow(cos(radians(cm.lat)) * cos(radians(cm.lon)) - cos(radians(sm.lat)) * cos(radians(sm.lon)), 2)
  + pow(cos(radians(cm.lat)) * sin(radians(cm.lon)) - cos(radians(sm.lat)) * sin(radians(sm.lon)), 2) + pow(sin(radians(cm.lat)) - sin(radians(sm.lat)), 2)) AS chord FROM cm JOIN sm ON true),
near AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY chord, site) AS rank FROM dd QUALIFY rank <= 30)"""


def _near(spark, sf, k=30):
    return grid.knn_sphere(B.customers(spark, sf), B.suppliers(spark, sf), k, "entity_id")


@query("knn_sphere", f"WITH {_SITES} SELECT cell, site, round(chord, 6) AS chord, rank FROM near")
def knn_sphere(spark, sf):
    return tidy(_near(spark, sf).select(F.col("id").alias("cell"), F.col("neighbour_id").alias("site"), F.col("value").alias("chord"), "rank"))


@query("knn_cells", f"WITH {_SITES} SELECT cell, site, round(chord, 6) AS chord, rank FROM near")
def knn_cells(spark, sf):
    """The same lists by hierarchical cells and ring search."""
    near = cells.knn_cells(B.customers(spark, sf), B.suppliers(spark, sf), 30, "entity_id")
    return tidy(near.select(F.col("id").alias("cell"), F.col("neighbour_id").alias("site"), F.col("value").alias("chord"), "rank"))


@query("coverage_gate", f"""WITH {_SITES}, g AS (SELECT cell, max(chord) FILTER (WHERE rank = 1) AS one, max(chord) FILTER (WHERE rank = 2) AS two FROM near GROUP BY 1)
SELECT cell FROM g WHERE one <= 2 * sin(800 / 12742.0) AND coalesce(two <= 2 * sin(1500 / 12742.0), true)""")
def coverage_gate(spark, sf):
    return grid.coverage_gate(_near(spark, sf, 2), 800, 1500)


@query("nearest_site", f"WITH {_SITES} SELECT cell, site AS entity_id, round(chord, 6) AS chord FROM near WHERE rank = 1")
def nearest_site(spark, sf):
    return tidy(grid.nearest_site(B.customers(spark, sf), B.suppliers(spark, sf), cell_col="entity_id"))


def _colored_sites(spark, sf):
    """Suppliers with the colour coordinates of the vector of the same number."""
    s = _sphere(spark, sf)
    cal = _three_cdfs(s)
    sites = B.suppliers(spark, sf).join(s.select("entity_id", "color_xyz", F.abs(F.col("vector")[3]).alias("w_abs")), "entity_id")
    return reliable(sites), cal


_SIGMA = "(2 * sin(50 / 12742.0))"
_BLEND = f"""{SPHERE}, {B.CM}, {B.SM}, ss AS (SELECT sm.entity_id, sm.lat, sm.lon, g.x, g.y, g.z FROM sm JOIN geo3 g ON g.entity_id = sm.entity_id),
dd AS (SELECT cm.entity_id AS cell, ss.entity_id AS site, x, y, z, sqrt(pow(cos(radians(cm.lat)) * cos(radians(cm.lon)) - cos(radians(ss.lat)) * cos(radians(ss.lon)), 2)
  + pow(cos(radians(cm.lat)) * sin(radians(cm.lon)) - cos(radians(ss.lat)) * sin(radians(ss.lon)), 2) + pow(sin(radians(cm.lat)) - sin(radians(ss.lat)), 2)) AS chord FROM cm JOIN ss ON true),
near AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY chord, site) AS rank FROM dd QUALIFY rank <= 30),
w AS (SELECT *, exp(-chord * chord / (2 * {_SIGMA} * {_SIGMA})) AS g FROM near WHERE chord * chord <= pow(2 * sin(5000 / 12742.0), 2)),
b AS (SELECT cell, count(*) AS candidates, sum(g) AS t, sum(g * x) AS sx, sum(g * y) AS sy, sum(g * z) AS sz, arg_min(x, rank) AS nx, arg_min(y, rank) AS ny, arg_min(z, rank) AS nz FROM w GROUP BY 1)"""


@query("blend_cells", f"""WITH {_BLEND} SELECT cell, candidates, round(CASE WHEN candidates = 1 OR t < 1e-12 THEN nx ELSE sx / t END, 6) AS x, round(CASE WHEN candidates = 1 OR t < 1e-12 THEN ny ELSE sy / t END, 6) AS y,
 round(CASE WHEN candidates = 1 OR t < 1e-12 THEN nz ELSE sz / t END, 6) AS z FROM b""")
def blend_cells(spark, sf):
    """Customers as cells, coloured by the suppliers around them."""
    sites, cal = _colored_sites(spark, sf)
    cells = calibrate.blend_cells(grid.knn_sphere(B.customers(spark, sf), sites, 30, "entity_id"), sites, cal)
    xyz = F.col("color_xyz")
    return tidy(cells.select("cell", "candidates", xyz[0].alias("x"), xyz[1].alias("y"), xyz[2].alias("z")))


@query("world_colors")
def world_colors(spark, sf):
    """Equal-area world cells with the blended colour of the suppliers, gated by coverage."""
    sites, cal = _colored_sites(spark, sf)
    cells = reliable(grid.world_grid(spark, 60))
    near = reliable(grid.knn_sphere(cells, sites, 30))
    open_cells = grid.coverage_gate(near, 2000, 4000)
    return tidy(calibrate.blend_cells(near, sites, cal).join(open_cells, "cell", "left_semi").select("cell", "candidates", "color"))


@query("radius_sites", f"""WITH {B.CM}, {B.SM}, d AS (SELECT cm.entity_id AS node, sm.entity_id, {_KM.format(a='cm', b='sm')} / 111.0 AS distance FROM cm JOIN sm ON true)
SELECT node, entity_id, round(distance, 6) AS distance FROM d WHERE distance <= 6""")
def radius_sites(spark, sf):
    return tidy(grid.radius_sites(B.customers(spark, sf).withColumnRenamed("entity_id", "node"), B.suppliers(spark, sf), 6.0))



def _lab_sql(color: str) -> str:
    ch = [f"('0x' || {color}[{i}:{i + 1}])::INT / 255" for i in (2, 4, 6)]
    lin = [f"(CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END)" for c in ch]
    lms = [f"cbrt({r[0]} * {lin[0]} + {r[1]} * {lin[1]} + {r[2]} * {lin[2]})" for r in C.RGB_TO_LMS]
    return [f"{r[0]} * {lms[0]} + {r[1]} * {lms[1]} + {r[2]} * {lms[2]}" for r in C.LMS_TO_LAB]


_L, _A, _B2 = _lab_sql("color")


@query("radius_idw", f"""WITH RECURSIVE {HEX}, {B.CM}, {B.SM}, s AS (SELECT sm.entity_id, lat, lon, {_L} AS l, {_A} AS a, {_B2} AS b FROM sm JOIN hexes ON hexes.entity_id = sm.entity_id),
d AS (SELECT cm.entity_id AS node, s.*, {_KM.format(a='cm', b='s')} / 111.0 AS distance FROM cm JOIN s ON true), w AS (SELECT *, 1 / pow(distance + 0.001, 2) AS w FROM d WHERE distance <= 6)
SELECT node, round(sum(w * l) / sum(w), 6) AS "L", round(sum(w * a) / sum(w), 6) AS a, round(sum(w * b) / sum(w), 6) AS b, count(*) AS sites FROM w GROUP BY 1""")
def radius_idw(spark, sf):
    """Inverse-distance OKLab colour at every customer from the suppliers within 6 degrees."""
    sites, cal = _colored_sites(spark, sf)
    colored = calibrate.color_entities(sites, cal)
    rows = grid.oklab_idw(B.customers(spark, sf).withColumnRenamed("entity_id", "node"), colored, 6.0)
    return tidy(rows.select("node", "L", "a", "b", "sites"))


@query("idw_grid")
def idw_grid(spark, sf):
    """A 31 x 31 grid over the bounds of the suppliers."""
    sites, cal = _colored_sites(spark, sf)
    colored = reliable(calibrate.color_entities(sites, cal))
    nodes = grid.idw_nodes(colored, 30, 8.0)
    return tidy(grid.oklab_idw(reliable(nodes), colored, 8.0).select("node", "sites", "color"))


@query("nearest_within", f"""WITH {B.EM}, p AS (SELECT entity_id, vector[1:2] AS xy FROM em), s AS (SELECT entity_id, vector[3:4] AS xy FROM em),
n AS (SELECT p.entity_id AS point, s.entity_id, list_distance(p.xy, s.xy) AS distance FROM p JOIN s ON true QUALIFY row_number() OVER (PARTITION BY p.entity_id ORDER BY list_distance(p.xy, s.xy), s.entity_id) = 1)
SELECT point, entity_id, round(distance, 6) AS distance FROM n WHERE distance < 0.02""")
def nearest_within(spark, sf):
    e = B.embeddings(spark, sf)
    points = e.select(F.col("entity_id").alias("point"), F.slice("vector", 1, 2).alias("xy"))
    return tidy(grid.nearest_within(points, e.select("entity_id", F.slice("vector", 3, 2).alias("xy")), 0.02))


_POLY = """poly AS (SELECT n_nationkey AS k, -175.3 + 14 * n_nationkey AS x, -60.7 + 4 * n_nationkey AS y FROM nation),
edges AS (SELECT k AS poly_id, 1 AS edge_id, x AS x1, y AS y1, x + 22 AS x2, y + 5 AS y2 FROM poly UNION ALL SELECT k, 2, x + 22, y + 5, x + 9, y + 31 FROM poly UNION ALL SELECT k, 3, x + 9, y + 31, x, y FROM poly)"""


def _edges(spark, sf):
    """One triangle per nation."""
    n = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("poly_id"), (F.col("n_nationkey") * 14 - 175.3).alias("x"), (F.col("n_nationkey") * 4 - 60.7).alias("y"))
    corner = [(0, 0), (22, 5), (9, 31)]
    sides = F.array(*[F.struct(F.lit(i + 1).alias("edge_id"), *[(F.col(a) + float(p[j])).cast("double").alias(f"{a}{e}") for e, p in ((1, corner[i]), (2, corner[(i + 1) % 3])) for j, a in enumerate("xy")])
                      for i in range(3)])
    return n.select("poly_id", F.explode(sides).alias("s")).select("poly_id", "s.*")


@query("point_in_polygon", f"""WITH {B.CM}, {_POLY}, h AS (SELECT entity_id AS cell, poly_id FROM cm JOIN edges ON (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1))
SELECT cell, poly_id::BIGINT AS poly_id FROM h GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def point_in_polygon(spark, sf):
    return tidy(grid.point_in_polygon(B.customers(spark, sf).withColumnRenamed("entity_id", "cell"), _edges(spark, sf)))


_TURNS = "(SELECT unnest([-360.0, 0.0, 360.0]::DOUBLE[]) AS turn)"
_SLAB = "CASE WHEN {d} = 0 THEN CASE WHEN {p} BETWEEN {low} AND {high} THEN {flat} ELSE {out} END ELSE {pick}(({low} - {p}) / nullif({d}, 0), ({high} - {p}) / nullif({d}, 0)) END"
_LAND = f"""WITH {B.CM}, {_POLY}, h AS (SELECT entity_id AS cell, poly_id FROM cm, {_TURNS}, edges WHERE (y1 > lat) <> (y2 > lat) AND lon + turn < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2, turn HAVING count(*) % 2 = 1),
b AS (SELECT entity_id AS cell, lon + turn - 1 AS w, lon + turn + 1 AS e, lat - 1 AS s, lat + 1 AS n FROM cm, {_TURNS}),
t AS (SELECT cell, {_SLAB.format(d='(x2 - x1)', p='x1', low='w', high='e', flat='0.0', out='2.0', pick='least')} AS x0, {_SLAB.format(d='(x2 - x1)', p='x1', low='w', high='e', flat='1.0', out='-1.0', pick='greatest')} AS x9,
  {_SLAB.format(d='(y2 - y1)', p='y1', low='s', high='n', flat='0.0', out='2.0', pick='least')} AS y0, {_SLAB.format(d='(y2 - y1)', p='y1', low='s', high='n', flat='1.0', out='-1.0', pick='greatest')} AS y9 FROM b, edges)
SELECT DISTINCT cell FROM (SELECT cell FROM h UNION ALL SELECT cell FROM t WHERE greatest(x0, y0, 0.0) <= least(x9, y9, 1.0))"""


@query("land_cells", _LAND)
def land_cells(spark, sf):
    """Customer boxes of two degrees that a nation's triangle contains or touches, also over the antimeridian."""
    cells = B.customers(spark, sf).withColumnRenamed("entity_id", "cell").withColumn("height", F.lit(2.0)).withColumn("width", F.lit(2.0))
    return cover.land_cells(cells, _edges(spark, sf), 2.0).select("cell")


@query("point_in_cover", f"""WITH {B.CM}, {_POLY}, h AS (SELECT entity_id AS cell, poly_id, turn, count(*) AS n FROM cm, {_TURNS}, edges
  WHERE (y1 > lat) <> (y2 > lat) AND lon + turn < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2, 3)
SELECT DISTINCT cell, poly_id::BIGINT AS poly_id FROM h WHERE n % 2 = 1""")
def point_in_cover(spark, sf):
    """Customers inside the nations' triangles, by inner and border cells."""
    points = B.customers(spark, sf).withColumnRenamed("entity_id", "cell")
    return tidy(cover.points_in_cover(points, cover.polygon_cover(_edges(spark, sf), 2.0), 2.0))


@query("heat_points", f"WITH {B.CM} SELECT entity_id, round(lon, 6) AS x, 15.0::DOUBLE AS radius, 25.0::DOUBLE AS blur, round(weight, 6) AS intensity FROM cm")
def heat_points(spark, sf):
    rows = grid.heat_points(B.customers(spark, sf).withColumn("color", F.lit(C.NO_COLOR)))
    return tidy(rows.select("entity_id", F.col("coordinates")[0].alias("x"), "radius", "blur", "intensity"))


@query("glow_points", f"""WITH {B.CM} SELECT entity_id, CASE WHEN segment = 'MACHINERY' THEN '#123456' ELSE '#cccccc' END AS color FROM cm""")
def glow_points(spark, sf):
    c = B.customers(spark, sf).withColumn("color", F.when(F.col("segment") == "MACHINERY", "#123456")).withColumn("computed_color", F.lit(C.NO_COLOR))
    return grid.glow_points(c).select("entity_id", "color")


@query("cell_rings", f"""WITH {B.CM} SELECT entity_id, round(lon - 1 , 3) AS first_lon, round(lat - 1, 3) AS first_lat, 5::BIGINT AS points FROM cm""")
def cell_rings(spark, sf):
    """Closed rings of two-degree boxes around every customer."""
    c = B.customers(spark, sf)
    ring = G.close_ring(grid.cell_vertices(F.col("lat"), F.col("lon"), F.lit(2.0), F.lit(2.0)))
    rows = c.withColumn("ring", ring)
    return tidy(rows.select("entity_id", F.col("ring")[0][0].alias("first_lon"), F.col("ring")[0][1].alias("first_lat"), F.size("ring").alias("points")))
