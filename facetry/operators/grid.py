"""Cells, sites and polygons: grids, nearest sites, radius joins, point in polygon."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetry.functions import color as C
from facetry.functions.geo import EARTH_RADIUS_KM, chord, unit_xyz
from facetry.operators import cells
from facetry.operators import neighbours as nb
from facetry.operators.ordering import with_position


def world_grid(spark: SparkSession, rows: int = 180, equal_area: bool = True) -> DataFrame:
    """Lattice over the Earth: (cell, lat, lon, height, width).

    Rows of equal height; with ``equal_area`` each row has cells in proportion
    to the cosine of its latitude, so that all cells cover about the same area.
    """
    height = 180.0 / rows
    widest = 2 * rows
    lat = (F.col("_row") + 0.5) * height - 90.0
    count = F.greatest(F.round(F.cos(F.radians(lat)) * widest), F.lit(1.0)) if equal_area else F.lit(float(widest))
    base = spark.range(rows * widest).select(
        F.floor(F.col("id") / widest).alias("_row"), F.pmod(F.col("id"), F.lit(widest)).alias("_col"), F.col("id").alias("cell"))
    grid = base.withColumn("lat", lat).withColumn("_n", count).where(F.col("_col") < F.col("_n"))
    return grid.select("cell", "lat", (((F.col("_col") + 0.5) / F.col("_n")) * 360.0 - 180.0).alias("lon"),
                       F.lit(height).alias("height"), (360.0 / F.col("_n")).alias("width"))


def cell_vertices(lat: Column, lon: Column, height: Column, width: Column) -> Column:
    """Four corners of a lattice cell as ``array<struct<lat,lon>>``."""
    corner = lambda a, b: F.struct((lat + a * height / 2).alias("lat"), (lon + b * width / 2).alias("lon"))
    return F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1))


def _sphere_rows(df: DataFrame, id_col: str, lat: str, lon: str) -> DataFrame:
    placed = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("_xyz", unit_xyz(F.col(lat), F.col(lon)))
    return nb.dense_rows(placed, id_col, "_xyz")


def knn_sphere(cells: DataFrame, sites: DataFrame, k: int = 30, cell_col: str = "cell", site_col: str = "entity_id",
               lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Nearest sites on the sphere by chord length: (id, neighbour_id, value, rank)."""
    return nb.knn_join(_sphere_rows(cells, cell_col, lat, lon), k, "euclidean", _sphere_rows(sites, site_col, lat, lon))


def coverage_gate(near: DataFrame, first_km: float = 200.0, second_km: float = 500.0) -> DataFrame:
    """Cells whose nearest site and, when there is one, second site are close enough."""
    stats = near.where(F.col("rank") <= 2).groupBy("id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("_one"),
        F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("_two"))
    ok = (F.col("_one") <= chord(first_km)) & F.coalesce(F.col("_two") <= chord(second_km), F.lit(True))
    return stats.where(ok).select(F.col("id").alias("cell"))


def nearest_site(cells: DataFrame, sites: DataFrame, **columns) -> DataFrame:
    """Territory: the site that owns each cell."""
    return knn_sphere(cells, sites, 1, **columns).select(F.col("id").alias("cell"), F.col("neighbour_id").alias("entity_id"),
                                                         F.col("value").alias("chord"))


def radius_sites(nodes: DataFrame, sites: DataFrame, radius: float, node_col: str = "node",
                 site_col: str = "entity_id", lat: str = "lat", lon: str = "lon", carry: tuple[str, ...] = ()) -> DataFrame:
    """Sites within ``radius`` (km / 111) of each node: (node, entity_id, distance) and the sites' columns of ``carry``.

    Pairs are made, measured and given out in one task, and all of a node in the same; only nodes and sites move.
    """
    def placed(rows: DataFrame, side: str, axes: tuple[str, ...], *kept) -> DataFrame:
        known = rows.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("_xyz", unit_xyz(F.col(lat), F.col(lon)))
        phi = F.radians(F.col(lat))
        return known.select(*kept, phi.alias(f"_{side}phi"), F.cos(phi).alias(f"_{side}cos"), F.col(lon).alias(f"_{side}lon"),
                            *[F.col("_xyz")[i].alias(a) for i, a in enumerate(axes)])

    far = chord(min(radius * 111.0, math.pi * EARTH_RADIUS_KM)) + 1e-7
    met = cells.pairs_within(placed(nodes, "n", ("x", "y", "z"), F.col(node_col).alias("_node")),
                             placed(sites, "s", ("sx", "sy", "sz"), F.col(site_col).alias("_site"), *carry), far)
    half_lat, half_lon = F.sin((F.col("_sphi") - F.col("_nphi")) / 2), F.sin(F.radians(F.col("_slon") - F.col("_nlon")) / 2)
    h = half_lat * half_lat + F.col("_ncos") * F.col("_scos") * half_lon * half_lon  # as haversine_km, cosines taken once a row
    distance = 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0)))) / 111.0
    return met.select(F.col("_node").alias(node_col), F.col("_site").alias(site_col), distance.alias("distance"), *carry).where(F.col("distance") <= radius)


def nearest_within(points: DataFrame, sites: DataFrame, radius: float, point_col: str = "point",
                   site_col: str = "entity_id", vector_col: str = "xy") -> DataFrame:
    """Closest site of each point in a plane, when one lies within the radius."""
    near = nb.knn_join(nb.dense_rows(points, point_col, vector_col), 1, "euclidean", nb.dense_rows(sites, site_col, vector_col))
    return near.where(F.col("value") < radius).select(F.col("id").alias(point_col), F.col("neighbour_id").alias(site_col),
                                                      F.col("value").alias("distance"))


def extent(points: DataFrame, columns: list[str], pad: float = 0.06) -> DataFrame:
    """Padded minimum and maximum of each column over rows in which all are numbers."""
    valid = points
    for c in columns:
        valid = valid.where(F.col(c).isNotNull() & ~F.isnan(c))
    span = lambda c: F.max(c) - F.min(c)
    return valid.agg(*[e for c in columns for e in (
        (F.min(c) - span(c) * pad).alias(f"{c}_min"), (F.max(c) + span(c) * pad).alias(f"{c}_max"))])


def idw_nodes(sites: DataFrame, size: int = 50, radius: float = 0.6, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(size + 1)^2 grid nodes over the padded bounds of the sites."""
    pad = radius * 0.5
    box = sites.agg(F.struct(*[f(c).alias(f"{n}_{a}") for c, a in ((lat, "lat"), (lon, "lon"))
                               for n, f in (("lo", F.min), ("hi", F.max))]).alias("b")).scalar()
    nodes = sites.sparkSession.range((size + 1) ** 2).withColumn("_b", box)
    at = lambda axis, step: F.col(f"_b.lo_{axis}") - pad + step * (
        F.col(f"_b.hi_{axis}") - F.col(f"_b.lo_{axis}") + 2 * pad) / size
    return nodes.select(F.col("id").alias("node"), at("lat", F.pmod("id", F.lit(size + 1))).alias("lat"),
                        at("lon", F.floor(F.col("id") / (size + 1))).alias("lon"))


def oklab_idw(nodes: DataFrame, sites: DataFrame, radius: float = 0.6, power: float = 2.0,
              color_col: str = "color", weight_col: str | None = None) -> DataFrame:
    """Inverse-distance mean colour in OKLab of the sites near each node; nodes without sites drop out."""
    weight = F.col(weight_col) if weight_col else F.lit(1.0)
    side = sites.select("entity_id", "lat", "lon", C.hex_to_oklab(F.col(color_col)).alias("_lab"), F.coalesce(weight, F.lit(1.0)).alias("_w0"))
    rows = radius_sites(nodes, side, radius, carry=("_lab", "_w0")).withColumn("_w", F.col("_w0") / F.pow(F.col("distance") + 0.001, F.lit(power))).where("_w > 0")
    mean = lambda c: (F.sum(F.col("_w") * F.col("_lab")[c]) / F.sum("_w")).alias(c)
    out = rows.groupBy("node").agg(mean("L"), mean("a"), mean("b"), F.count(F.lit(1)).alias("sites"))
    return out.withColumn("color", C.oklab_to_hex(F.col("L"), F.col("a"), F.col("b")))


def point_in_polygon(points: DataFrame, edges: DataFrame, point_col: str = "cell", x: str = "lon", y: str = "lat",
                     bands: float = 1.0) -> DataFrame:
    """Points inside a polygon (poly_id): odd number of edge crossings to the right of the point.

    ``edges`` is (poly_id, edge_id, x1, y1, x2, y2).  Both sides meet on the
    latitude band, so a point reads only edges that can cross its parallel.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = edges.where(F.col("y1") != F.col("y2")).withColumn("_band", F.explode(F.sequence(
        F.floor(low / bands).cast("bigint"), F.floor(high / bands).cast("bigint"))))
    at = points.select(F.col(point_col), F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor(F.col(y) / bands).cast("bigint").alias("_band"))
    cross = F.col("x1") + (F.col("_y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    spans = (F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y"))
    hits = at.join(banded, "_band").where(spans & (F.col("_x") < cross))
    return hits.groupBy(point_col, "poly_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") % 2 == 1).select(point_col, "poly_id")


def polygon_touches_cell(cells: DataFrame, edges: DataFrame, bands: float = 1.0) -> DataFrame:
    """Cells (cell, lat, lon, height, width) whose box is crossed by a polygon edge."""
    south, north = F.col("lat") - F.col("height") / 2, F.col("lat") + F.col("height") / 2
    west, east = F.col("lon") - F.col("width") / 2, F.col("lon") + F.col("width") / 2
    box = cells.select("cell", south.alias("_s"), north.alias("_n"), west.alias("_w"), east.alias("_e")).withColumn(
        "_band", F.explode(F.sequence(F.floor(F.col("_s") / bands).cast("bigint"), F.floor(F.col("_n") / bands).cast("bigint"))))
    banded = edges.withColumn("_band", F.explode(F.sequence(
        F.floor(F.least("y1", "y2") / bands).cast("bigint"), F.floor(F.greatest("y1", "y2") / bands).cast("bigint"))))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def clip(p: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column]:
        """Share of the edge inside a slab."""
        a, b = F.try_divide(low - p, d), F.try_divide(high - p, d)
        inside = p.between(low, high)
        return (F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(a, b)),
                F.when(d == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(a, b)))

    x0, x1 = clip(F.col("x1"), dx, F.col("_w"), F.col("_e"))
    y0, y1 = clip(F.col("y1"), dy, F.col("_s"), F.col("_n"))
    enter, leave = F.greatest(x0, y0, F.lit(0.0)), F.least(x1, y1, F.lit(1.0))
    return box.join(banded, "_band").where(enter <= leave).select("cell", "poly_id").distinct()


def land_cells(cells: DataFrame, edges: DataFrame, bands: float = 1.0) -> DataFrame:
    """Cells whose centre is inside a polygon or whose box an edge touches."""
    inside = point_in_polygon(cells, edges, bands=bands)
    return cells.join(inside.unionByName(polygon_touches_cell(cells, edges, bands)).select("cell").distinct(), "cell", "left_semi")


def heat_points(entities: DataFrame, base_radius: float = 15.0, blur: float = 25.0, weight_col: str = "weight") -> DataFrame:
    """One map feature per positioned entity: colour, radius, blur, intensity."""
    return entities.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "entity_id", F.array("lon", "lat").alias("coordinates"), "color", F.lit(base_radius).alias("radius"),
        F.lit(blur).alias("blur"), F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)).alias("intensity"))


def glow_points(entities: DataFrame, computed_col: str = "computed_color") -> DataFrame:
    """Own colour when present, else the computed one."""
    return entities.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("color", F.coalesce("color", computed_col))


def hue_histogram(hues: DataFrame, buckets: int = 18, hue_col: str = "hue") -> DataFrame:
    """Entities per hue bucket, empty buckets included, with the uniformity test (max <= 3 x mean)."""
    width = 360.0 / buckets
    n = hues.where(F.col(hue_col).isNotNull()).groupBy(F.pmod(F.floor(F.col(hue_col) / width), F.lit(buckets)).cast("bigint").alias("bucket")).agg(
        F.count(F.lit(1)).alias("_n"))
    every = hues.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    rows = every.join(n, "bucket", "left").select("bucket", F.coalesce("_n", F.lit(0)).alias("entities"))
    everything = Window.partitionBy(F.lit(0))  # `buckets` rows
    return rows.withColumn("uniform", F.max("entities").over(everything) <= 3 * F.avg("entities").over(everything))


def circular_std(hues: DataFrame, group_col: str = "group", angle_col: str = "angle", min_members: int = 4) -> DataFrame:
    """Circular standard deviation in degrees of an angle (radians) per group."""
    stats = hues.groupBy(F.col(group_col).alias("group")).agg(
        F.count(F.lit(1)).alias("members"), F.avg(F.cos(angle_col)).alias("_c"), F.avg(F.sin(angle_col)).alias("_s"))
    r = F.greatest(F.hypot("_c", "_s"), F.lit(1e-10))
    return stats.where(F.col("members") >= min_members).select(
        "group", "members", (F.sqrt(F.greatest(-2 * F.log(r), F.lit(0.0))) * (180 / math.pi)).alias("hue_std_deg"))


def supergroup_panel(entities: DataFrame, order: list[str], supergroup_col: str = "supergroup", hue_col: str = "hue") -> DataFrame:
    """Members of each super-group in hue order, super-groups in a fixed order (rank, not a list)."""
    known = F.coalesce(*[F.when(F.col(supergroup_col) == s, F.lit(i)) for i, s in enumerate(order)], F.lit(len(order)))
    return entities.withColumn("panel", known).orderBy("panel", supergroup_col, hue_col, "entity_id")


def supergroup_members(entities: DataFrame, order: list[str], supergroup_col: str = "supergroup", hue_col: str = "hue") -> DataFrame:
    """Each super-group's members in hue order with their rank in it and its size: (panel, supergroup, rank, entity_id, members).

    Ranks come from one range sort, so a super-group that holds most rows is no single task.
    """
    rows = supergroup_panel(entities, order, supergroup_col, hue_col).select("panel", F.col(supergroup_col).alias("supergroup"), F.col(hue_col).alias("hue"), "entity_id")
    placed = with_position(rows, F.col("panel"), F.col("supergroup"), F.col("hue"), F.col("entity_id"), name="_pos")
    starts = placed.groupBy(F.col("supergroup").alias("_group")).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("members"))
    return placed.join(starts, F.col("supergroup").eqNullSafe(F.col("_group"))).select(
        "panel", "supergroup", (F.col("_pos") - F.col("_first") + 1).alias("rank"), "entity_id", "members")


def axis_coverage(rows: DataFrame, limit: float = 1.0) -> DataFrame:
    """Range, mean, deviation and clipped share per axis of long (axis, x) rows."""
    return rows.groupBy("axis").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"),
                                    F.stddev_pop("x").alias("std"), F.avg(F.when(F.abs("x") >= limit, 1.0).otherwise(0.0)).alias("clipped"))
