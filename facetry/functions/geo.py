"""Positions on the sphere as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    h = F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(h))


def chord(km: float) -> float:
    """Chord length on the unit sphere of a great-circle distance."""
    return 2.0 * math.sin(km / (2.0 * EARTH_RADIUS_KM))


def unit_xyz(lat: Column, lon: Column) -> Column:
    phi, lam = F.radians(lat), F.radians(lon)
    return F.array(F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))


def bbox_filter(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def to_point(lat: Column, lon: Column) -> Column:
    """GeoJSON point, null without a numeric position."""
    position = F.array(lon.try_cast("double"), lat.try_cast("double"))
    return F.when(
        F.forall(position, lambda v: v.isNotNull()),
        F.struct(F.lit("Point").alias("type"), position.alias("coordinates")),
    )


def close_ring(vertices: Column) -> Column:
    """``array<struct<lat,lon>>`` -> closed ``array<array<double>>`` ring of [lon, lat].

    Longitudes are shifted by full turns so that no edge jumps over the
    antimeridian; positions are rounded to three decimals.
    """
    empty = F.lit(None).cast("double")

    def step(acc, v):
        previous = acc["last"]
        shift = F.when(previous.isNull(), F.lit(0.0)).otherwise(
            F.ceil((v["lon"] - previous - 180.0) / 360.0).cast("double")
        )
        # ceil gives the turns to take off above +180 and, negative, to add below -180.
        lon = v["lon"] - 360.0 * F.when(v["lon"] - previous > 180, shift).when(
            previous - v["lon"] > 180, -F.ceil((previous - v["lon"] - 180.0) / 360.0).cast("double")
        ).otherwise(F.lit(0.0))
        lon = F.round(lon, 3)
        return F.struct(
            F.concat(acc["ring"], F.array(F.array(lon, F.round(v["lat"], 3)))).alias("ring"),
            lon.alias("last"),
        )

    start = F.struct(
        F.array().cast("array<array<double>>").alias("ring"), empty.alias("last")
    )
    ring = F.aggregate(vertices, start, step, lambda acc: acc["ring"])
    return F.concat(ring, F.slice(ring, 1, 1))
