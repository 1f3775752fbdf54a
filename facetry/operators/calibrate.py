"""Colour jobs: calibrate from vectors, colour entities, blend colours over cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions import color as C
from facetry.functions import vectors as V
from facetry.functions.geo import chord
from facetry.operators import embed
from facetry.operators.ordering import axis_quantiles, cdf_points
from facetry.operators.profiles import column_moments
from facetry.operators.records import fingerprint
from facetry.runtime import reliable, scalar

QUANTILES = (("p02", 0.02), ("p25", 0.25), ("p50", 0.50), ("p75", 0.75), ("p98", 0.98))
CDF_COLUMNS = ("angle_percentiles", "radius_percentiles", "z_percentiles", "w_abs_percentiles",
               "elevation_percentiles", "uv_magnitude_percentiles")


def axis_rows(df: DataFrame, axes: dict[str, Column]) -> DataFrame:
    """Long (axis, x) form of a few named expressions."""
    cells = F.array(*[F.struct(F.lit(name).alias("axis"), expr.cast("double").alias("x")) for name, expr in axes.items()])
    return df.select(F.explode(cells).alias("c")).select("c.axis", "c.x")


def quantile_struct(rows: DataFrame, axes: list[str]) -> Column:
    """``struct<axis: struct<p02,p25,p50,p75,p98>>`` of long (axis, x) rows as a scalar."""
    q = axis_quantiles(rows, "axis", "x", [p for _, p in QUANTILES])
    pick = lambda axis, p: F.max(F.when((F.col("axis") == axis) & (F.col("p") == p), F.col("value")))
    return scalar(q, F.struct(*[F.struct(*[pick(axis, p).alias(name) for name, p in QUANTILES]).alias(axis) for axis in axes]))


def sphere_coords(vectors: DataFrame, raw_col: str = "color_raw", out_col: str = "color_xyz") -> DataFrame:
    """Median-centred coordinates scaled by the 98th percentile of their radius."""
    x = lambda i: F.col(raw_col)[i]
    rows = reliable(vectors.where(F.col(raw_col).isNotNull()))
    medians = axis_quantiles(axis_rows(rows, {"x": x(0), "y": x(1), "z": x(2)}), "axis", "x", [0.5])
    centre = scalar(medians, F.struct(*[F.max(F.when(F.col("axis") == a, F.col("value"))).alias(a) for a in "xyz"]))
    centred = rows.withColumn("_m", centre).withColumn(
        out_col, F.array(*[x(i) - F.col("_m")[a] for i, a in enumerate("xyz")])).drop("_m")
    centred = reliable(centred)
    radius = V.norm(F.col(out_col))
    reach = scalar(axis_quantiles(axis_rows(centred, {"r": radius}), "axis", "x", [0.98]), F.max("value"))
    return centred.withColumn("_scale", F.greatest(reach, F.lit(1e-8))).withColumn(
        out_col, F.transform(out_col, lambda v: v / F.col("_scale"))).drop("_scale")


def azimuth(xyz: Column) -> Column:
    return F.atan2(xyz[1], xyz[0]) + math.pi


def elevation(xyz: Column) -> Column:
    return F.atan2(F.coalesce(F.get(xyz, 2), F.lit(0.0)), F.hypot(xyz[0], xyz[1]))


def hue_angle(xyz: Column, mode: str = "azimuth") -> Column:
    """Raw hue angle: pure azimuth, or azimuth plus elevation (``spherical``)."""
    if mode == "azimuth":
        return azimuth(xyz)
    return F.pmod(azimuth(xyz) + elevation(xyz), F.lit(2 * math.pi))


def axis_norms(vectors: DataFrame, calibration: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """u, v, w scores of the whitened vectors, scaled into [-1, 1]: adds u, v, w, w_abs, uv_magnitude."""
    cal = scalar(calibration, F.first(F.struct("mu", "sigma", "B", "quantiles")))
    rows = vectors.withColumn("_cal", cal)
    scored = rows.withColumn("_p", V.project_whitened(
        F.col(vector_col).cast("array<double>"), F.col("_cal.mu"), F.col("_cal.sigma"), F.col("_cal.B")))
    for i, axis in enumerate("uvw"):
        q = F.col("_cal.quantiles")[axis]
        scored = scored.withColumn(axis, V.normalize_robust(F.col("_p")[i], q["p02"], q["p50"], q["p98"]))
    return scored.withColumn("w_abs", F.abs("w")).withColumn("uv_magnitude", F.hypot("u", "v")).drop("_cal", "_p")


def calibrate_colors(vectors: DataFrame, vector_col: str = "embedding", xyz_col: str = "color_xyz",
                     buckets: int = 512) -> DataFrame:
    """One calibration row: moments, principal axes, quantiles, CDFs and a fingerprint."""
    rows = reliable(vectors.select(F.col(vector_col).cast("array<double>").alias("e"), F.col(xyz_col).alias("xyz")))
    moments = reliable(column_moments(rows, "e"))
    stack = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("dim", name))), lambda s: s[name])
    mu, sigma = scalar(moments, stack("mu")), scalar(moments, stack("sigma"))
    white = reliable(rows.withColumn("_mu", mu).withColumn("_sigma", sigma).withColumn(
        "white", F.zip_with(F.zip_with("e", "_mu", lambda a, m: a - m), "_sigma", lambda a, s: a / s)))
    axes = embed.principal_axes(white, 3, "white")
    scored = reliable(white.select("xyz", F.transform(embed.matrix_literal(axes), lambda a: V.dot(F.col("white"), a)).alias("p")))
    p = lambda i: F.col("p")[i]
    quantiles = quantile_struct(axis_rows(scored, {"u": p(0), "v": p(1), "w": p(2)}), ["u", "v", "w"])
    base = moments.agg(stack("mu").alias("mu"), stack("sigma").alias("sigma")).withColumn(
        "B", embed.matrix_literal(axes)).withColumn("quantiles", quantiles)
    return add_cdfs(reliable(base), scored, buckets)


def add_cdfs(base: DataFrame, scored: DataFrame, buckets: int = 512) -> DataFrame:
    """Attach the six CDFs and the fingerprint; ``scored`` holds raw scores ``p`` and ``xyz``."""
    q = scalar(base, F.first("quantiles"))
    rows = scored.withColumn("_q", q)
    for i, axis in enumerate("uvw"):
        a = F.col("_q")[axis]
        rows = rows.withColumn(axis, V.normalize_robust(F.col("p")[i], a["p02"], a["p50"], a["p98"]))
    xyz = F.col("xyz")
    long = axis_rows(rows, {
        "angle_percentiles": azimuth(xyz), "radius_percentiles": F.hypot(xyz[0], xyz[1]),
        "z_percentiles": F.coalesce(F.get(xyz, 2), F.lit(0.0)), "w_abs_percentiles": F.abs("w"),
        "elevation_percentiles": F.abs(elevation(xyz)), "uv_magnitude_percentiles": F.hypot("u", "v")})
    points = reliable(cdf_points(long, "axis", "x", buckets))
    cdf = lambda name: F.transform(F.array_sort(F.collect_list(F.when(  # noqa: E731 - `buckets` points
        F.col("axis") == name, F.struct("slot", "value")))), lambda s: s["value"])
    out = base.withColumn("version", F.lit("5"))
    for name in CDF_COLUMNS:
        out = out.withColumn(name, scalar(points, cdf(name)))
    fields = sorted(c for c in out.columns)
    return out.withColumn("hash", fingerprint(F.struct(*fields)))


def recalibrate(features: DataFrame, calibration: DataFrame, vector_col: str = "embedding",
                xyz_col: str = "color_xyz", buckets: int = 512) -> DataFrame:
    """Rebuild the CDFs and the fingerprint from saved embeddings, keeping axes and quantiles.

    Rows with short vectors are skipped; their number is in ``skipped``.
    """
    cal = scalar(calibration, F.first(F.struct("mu", "sigma", "B")))
    rows = features.withColumn("_cal", cal)
    usable = (F.size(vector_col) == F.size("_cal.mu")) & (F.size(xyz_col) >= 2)
    rows = reliable(rows.withColumn("_ok", F.coalesce(usable, F.lit(False))))
    scored = reliable(rows.where("_ok").select(F.col(xyz_col).alias("xyz"), V.project_whitened(
        F.col(vector_col).cast("array<double>"), F.col("_cal.mu"), F.col("_cal.sigma"), F.col("_cal.B")).alias("p")))
    base = calibration.select("mu", "sigma", "B", "quantiles")
    return add_cdfs(base, scored, buckets).withColumn("skipped", scalar(rows.where(~F.col("_ok")), F.count(F.lit(1))))


def _cal_struct(calibration: DataFrame) -> Column:
    return scalar(calibration, F.first(F.struct(*[c for c in CDF_COLUMNS if c in calibration.columns])))


def color_entities(entities: DataFrame, calibration: DataFrame, xyz_col: str = "color_xyz",
                   w_abs_col: str | None = None, out_col: str = "color", signed_z: bool = False) -> DataFrame:
    """OKLCH colour of every entity: adds hue, chroma, lightness and the hex colour.

    Hue is the ranked azimuth.  Chroma ranks the flat radius, else \\|w\\|; lightness
    ranks z, else the elevation.  Whatever CDF the calibration lacks falls back
    to the next form; entities without coordinates are grey.  ``signed_z`` uses
    the clamped rank of the display side.
    """
    has = lambda name: name in calibration.columns
    xyz = F.col(xyz_col)
    w_abs = F.col(w_abs_col) if w_abs_col else F.lit(0.0)
    rows = entities.withColumn("_cdf", _cal_struct(calibration)).withColumn("_az", azimuth(xyz))
    z = F.coalesce(F.get(xyz, 2), F.lit(0.0))
    if has("radius_percentiles"):
        chroma_rank = C.equalize_radius(F.hypot(xyz[0], xyz[1]), F.col("_cdf.radius_percentiles"))
    elif has("w_abs_percentiles"):
        chroma_rank = C.equalize_radius(w_abs, F.col("_cdf.w_abs_percentiles"))
    else:
        chroma_rank = w_abs
    if has("z_percentiles"):
        rank = C.equalize_signed if signed_z else C.equalize_radius
        light_rank = rank(z, F.col("_cdf.z_percentiles"))
    elif has("elevation_percentiles"):
        light_rank = C.equalize_radius(F.abs(elevation(xyz)), F.col("_cdf.elevation_percentiles"))
    elif has("uv_magnitude_percentiles") and "uv_magnitude" in entities.columns:
        light_rank = C.equalize_radius(F.col("uv_magnitude"), F.col("_cdf.uv_magnitude_percentiles"))
    else:
        light_rank = F.least(F.abs(elevation(xyz)) / (math.pi / 2), F.lit(1.0))
    angle_cdf = F.col("_cdf.angle_percentiles") if has("angle_percentiles") else None
    rows = (rows.withColumn("hue", C.hue_degrees(F.col("_az"), angle_cdf))
            .withColumn("chroma", C.chroma_of_rank(chroma_rank))
            .withColumn("lightness", C.lightness_of_rank(light_rank)).drop("_cdf", "_az"))
    return rows.withColumn(out_col, F.coalesce(
        F.when(F.size(xyz_col) >= 2, C.oklch_to_hex(F.col("lightness"), F.col("chroma"), F.col("hue"))), F.lit(C.NO_COLOR)))


def blend_cells(near: DataFrame, entities: DataFrame, calibration: DataFrame, sigma_km: float = 50.0,
                max_km: float = 5000.0, xyz_col: str = "color_xyz", w_abs_col: str = "w_abs") -> DataFrame:
    """Colour of every cell from its nearest entities (id = cell, neighbour_id, value = chord).

    Gaussian weights of the chord; a single candidate or a vanishing total
    weight takes the nearest entity's own colour.
    """
    spread = 2 * chord(sigma_km) ** 2
    side = entities.select(F.col("entity_id").alias("neighbour_id"), F.col(xyz_col).alias("xyz"),
                           F.col(w_abs_col).alias("w_abs"))
    rows = near.where(F.col("value") * F.col("value") <= chord(max_km) ** 2).join(side, "neighbour_id").withColumn(
        "g", F.exp(-F.col("value") * F.col("value") / spread))
    weighted = lambda e: F.sum(F.col("g") * e)
    z = F.coalesce(F.get("xyz", 2), F.lit(0.0))
    first = lambda e: F.min_by(e, F.struct("value", "neighbour_id"))
    cells = rows.groupBy(F.col("id").alias("cell")).agg(
        F.count(F.lit(1)).alias("candidates"), F.sum("g").alias("_g"),
        weighted(F.col("xyz")[0]).alias("_x"), weighted(F.col("xyz")[1]).alias("_y"), weighted(z).alias("_z"),
        weighted(F.col("w_abs")).alias("_w"), first(F.col("xyz")).alias("_near"), first(F.col("w_abs")).alias("_near_w"))
    alone = (F.col("candidates") == 1) | (F.col("_g") < 1e-12)
    blended = F.array(*[F.try_divide(F.col(c), F.col("_g")) for c in ("_x", "_y", "_z")])
    cells = cells.select(
        "cell", "candidates", F.when(alone, F.col("_near")).otherwise(blended).alias("color_xyz"),
        F.when(alone, F.col("_near_w")).otherwise(F.try_divide(F.col("_w"), F.col("_g"))).alias("w_abs"))
    return color_entities(cells, calibration, "color_xyz", "w_abs")


def max_min_colors(candidates: DataFrame, k: int, id_col: str = "id", color_col: str = "color") -> DataFrame:
    """Greedy choice of k colours, each as far as possible (OKLab distance) from those chosen.

    Every round is one pass with a running minimum distance; one row per round
    reaches the driver.
    """
    rows = reliable(candidates.select(id_col, color_col, C.hex_to_oklab(F.col(color_col)).alias("_lab")))
    state = rows.withColumn("_gap", F.lit(float("inf")))
    taken: list = []
    for rank in range(1, k + 1):
        best = state.where(F.col("_gap") > 0).orderBy(F.desc("_gap"), id_col).limit(1).collect()
        if not best:
            break
        row = best[0]
        taken.append((row[id_col], row[color_col], rank, None if rank == 1 else float(row["_gap"])))
        lab = F.struct(*[F.lit(float(row["_lab"][c])).alias(c) for c in ("L", "a", "b")])
        state = reliable(state.withColumn("_gap", F.least("_gap", C.delta_e_ok(F.col("_lab"), lab))))
    id_type = candidates.schema[id_col].dataType.simpleString()
    return candidates.sparkSession.createDataFrame(taken, f"{id_col} {id_type}, {color_col} string, rank int, min_delta_e double")
