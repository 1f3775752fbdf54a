"""Polygons as covers of lattice cells: points in an inner cell need no edge, points in a border cell only that cell's edges.

Edges are (poly_id, edge_id, x1, y1, x2, y2) in degrees.  Polygons over the antimeridian are
unrolled: where an edge jumps by more than 180 degrees the polygon's western half moves
360 degrees east, and every point is looked up at x and at x + 360.

A border cell knows whether its south-west corner is inside.  From there the way to a point
leads up the west side and then east, and each edge that it crosses turns inside to outside;
all of them belong to the cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.runtime import reliable

#: The lattice begins beside all round numbers, so no corner of a polygon lies on one of its lines.
OFFSET = 1.7320508e-7


def unrolled(edges: DataFrame) -> DataFrame:
    """Edges without jumps over the antimeridian."""
    jumps = edges.where(F.abs(F.col("x2") - F.col("x1")) > 180).select("poly_id").distinct().withColumn("_jumps", F.lit(True))
    east = lambda x: F.when(F.col("_jumps") & (F.col(x) < 0), F.col(x) + 360.0).otherwise(F.col(x)).alias(x)
    return edges.join(jumps, "poly_id", "left").select("poly_id", "edge_id", east("x1"), "y1", east("x2"), "y2")


def _slot(value: Column, step: float) -> Column:
    return F.floor((value - OFFSET) / step).cast("bigint")


def _line(slot: Column, step: float) -> Column:
    """The lower side of a row or the west side of a column."""
    return slot * F.lit(float(step)) + OFFSET


def _x_at(y: Column) -> Column:
    return F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))


def _by_row(edges: DataFrame, step: float) -> DataFrame:
    """Each edge once for every row of cells that it touches."""
    rows = F.sequence(_slot(F.least("y1", "y2"), step), _slot(F.greatest("y1", "y2"), step))
    return edges.withColumn("r", F.explode(rows)).withColumn("_s", _line(F.col("r"), step)).withColumn("_n", _line(F.col("r") + 1, step))


def polygon_cover(edges: DataFrame, step: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(border, inner): cells (poly_id, r, c, corner, edges) that edges touch, and runs (poly_id, r, low, high) of cells wholly inside.

    ``corner`` tells whether the cell's south-west corner is inside.  A cell's edges are
    those that touch it; nothing of a polygon is ever gathered as a whole.
    """
    rows = _by_row(unrolled(edges), step)
    # the stretch of the edge inside its row; a level edge keeps its whole width
    level = F.col("y1") == F.col("y2")
    low, high = F.greatest(F.least("y1", "y2"), F.col("_s")), F.least(F.greatest("y1", "y2"), F.col("_n"))
    a, b = F.when(level, F.col("x1")).otherwise(_x_at(low)), F.when(level, F.col("x2")).otherwise(_x_at(high))
    wide = F.sequence(_slot(F.least(a, b) - 1e-9, step), _slot(F.greatest(a, b) + 1e-9, step))
    edge = F.struct("x1", "y1", "x2", "y2")
    touched = rows.select("poly_id", "r", F.explode(wide).alias("c"), edge.alias("e"))
    cells = touched.groupBy("poly_id", "r", "c").agg(F.collect_list("e").alias("edges"))
    # crossings of the row's lower line to the west of a corner
    crossing = rows.where((F.col("y1") > F.col("_s")) != (F.col("y2") > F.col("_s"))).select("poly_id", "r", _x_at(F.col("_s")).alias("x"), F.lit(1).alias("hit"), F.lit(None).cast("bigint").alias("c"))
    corners = cells.select("poly_id", "r", _line(F.col("c"), step).alias("x"), F.lit(0).alias("hit"), "c")
    line = Window.partitionBy("poly_id", "r").orderBy("x", F.desc("hit")).rowsBetween(Window.unboundedPreceding, 0)
    marked = corners.unionByName(crossing).withColumn("corner", F.sum("hit").over(line) % 2 == 1).where("hit = 0").select("poly_id", "r", "c", "corner")
    border = reliable(cells.join(marked, ["poly_id", "r", "c"]))
    before = F.lag("c").over(Window.partitionBy("poly_id", "r").orderBy("c"))
    gaps = border.select("poly_id", "r", "c", "corner").withColumn("_b", before).where(F.col("corner") & (F.col("_b") < F.col("c") - 1))
    return border, gaps.select("poly_id", "r", (F.col("_b") + 1).alias("low"), (F.col("c") - 1).alias("high"))


def _crossings(x: Column, y: Column, west: Column, south: Column) -> Column:
    """Edges of a border cell that the way from its corner up to y and then east to x crosses."""
    def one(e):
        up = (e["x1"] > west) != (e["x2"] > west)
        at = e["y1"] + (west - e["x1"]) * (e["y2"] - e["y1"]) / (e["x2"] - e["x1"])
        side = F.coalesce(up & (at > south) & (at <= y), F.lit(False))
        across = (e["y1"] > y) != (e["y2"] > y)
        cut = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
        east = F.coalesce(across & (cut > west) & (cut <= x), F.lit(False))
        return side.cast("int") + east.cast("int")
    return F.aggregate("edges", F.lit(0), lambda n, e: n + one(e))


def points_in_cover(points: DataFrame, cover: tuple[DataFrame, DataFrame], step: float = 1.0, point_col: str = "cell", x: str = "lon", y: str = "lat") -> DataFrame:
    """(point, poly_id) for each point inside a polygon of the cover; both joins are on cells."""
    border, inner = cover
    turns = F.explode(F.array(F.lit(0.0), F.lit(360.0)))
    at = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(point_col), F.col(x).alias("_lon"), F.col(y).alias("_y"), turns.alias("_turn"))
    at = at.withColumn("_x", F.col("_lon") + F.col("_turn")).withColumn("r", _slot(F.col("_y"), step)).withColumn("c", _slot(F.col("_x"), step))
    whole = at.join(inner.select("poly_id", "r", F.explode(F.sequence("low", "high")).alias("c")), ["r", "c"])
    crossed = _crossings(F.col("_x"), F.col("_y"), _line(F.col("c"), step), _line(F.col("r"), step))
    near = at.join(border, ["r", "c"]).where((F.col("corner").cast("int") + crossed) % 2 == 1)
    return whole.select(point_col, "poly_id").unionByName(near.select(point_col, "poly_id")).distinct()


def boxes_on_cover(boxes: DataFrame, cover: tuple[DataFrame, DataFrame], step: float = 1.0) -> DataFrame:
    """(cell, poly_id) for each box (cell, lat, lon, height, width) that an edge touches; boxes over the antimeridian are wrapped."""
    border, _ = cover
    south, north = F.col("lat") - F.col("height") / 2, F.col("lat") + F.col("height") / 2
    turned = boxes.withColumn("_turn", F.explode(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0))))
    west, east = F.col("lon") + F.col("_turn") - F.col("width") / 2, F.col("lon") + F.col("_turn") + F.col("width") / 2
    box = turned.select("cell", south.alias("_s"), north.alias("_n"), west.alias("_w"), east.alias("_e"))
    box = box.withColumn("r", F.explode(F.sequence(_slot(F.col("_s"), step), _slot(F.col("_n"), step)))).withColumn(
        "c", F.explode(F.sequence(_slot(F.col("_w"), step), _slot(F.col("_e"), step))))

    def touches(e):
        def clip(p, d, low, high):
            """Share of the edge inside a slab."""
            a, b = F.try_divide(low - p, d), F.try_divide(high - p, d)
            inside = p.between(low, high)
            return (F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(a, b)),
                    F.when(d == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(a, b)))
        x0, x1 = clip(e["x1"], e["x2"] - e["x1"], F.col("_w"), F.col("_e"))
        y0, y1 = clip(e["y1"], e["y2"] - e["y1"], F.col("_s"), F.col("_n"))
        return F.greatest(x0, y0, F.lit(0.0)) <= F.least(x1, y1, F.lit(1.0))

    return box.join(border, ["r", "c"]).where(F.exists("edges", touches)).select("cell", "poly_id").distinct()


def land_cells(boxes: DataFrame, edges: DataFrame, step: float = 1.0) -> DataFrame:
    """Boxes whose centre is inside a polygon or that an edge touches."""
    cover = polygon_cover(edges, step)
    found = points_in_cover(boxes, cover, step).unionByName(boxes_on_cover(boxes, cover, step))
    return boxes.join(found.select("cell").distinct(), "cell", "left_semi")
