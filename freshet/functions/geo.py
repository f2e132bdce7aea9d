"""Distances, circles and grid buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Planar kilometres per degree, Earth radius, circle vertices.
KM_PER_DEGREE = 111.0
EARTH_RADIUS_KM = 6371.0
CIRCLE_VERTICES = 32

BUCKET_DEGREES = 0.1
_EDGE = 1e-9


def planar_km(
    lat: Column, lon: Column, center_lat: Column, center_lon: Column, lon_scale: Column | None = None
) -> Column:
    """Flat-earth distance with longitude scaled at the centre's latitude.

    `lon_scale` is that scale when the caller has it as a column, to keep the cosine out of a join.
    """
    scale = F.cos(F.radians(center_lat)) if lon_scale is None else lon_scale
    north = (lat - center_lat) * KM_PER_DEGREE
    east = (lon - center_lon) * KM_PER_DEGREE * scale
    return F.sqrt(north * north + east * east)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def circle_polygon(lat: Column, lon: Column, radius: Column, vertices: int = CIRCLE_VERTICES) -> Column:
    """Closed ring ARRAY<STRUCT<lon, lat>> around a centre."""
    up = radius / KM_PER_DEGREE
    across = F.try_divide(radius, KM_PER_DEGREE * F.cos(F.radians(lat)))
    ring = F.transform(
        F.sequence(F.lit(0), F.lit(vertices - 1)),
        lambda i: F.struct(
            (lon + across * F.cos(i * (2 * math.pi) / vertices)).alias("lon"),
            (lat + up * F.sin(i * (2 * math.pi) / vertices)).alias("lat"),
        ),
    )
    return F.concat(ring, F.slice(ring, 1, 1))


def bucket(degrees: Column, size: float = BUCKET_DEGREES) -> Column:
    return F.floor(degrees / F.lit(size))


def covering_buckets(lat: Column, lon: Column, reach_km: Column, size: float = BUCKET_DEGREES) -> Column:
    """All (by, bx) buckets touched by the box around a circle of `reach_km`.

    Near a pole the box spans all longitudes; it ends at the poles and at a full turn either way, so a
    centre never unrolls more than its rows times that. Longitudes are not wrapped, as in `planar_km`.
    """
    up = reach_km / KM_PER_DEGREE + _EDGE
    across = reach_km / (KM_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))) + _EDGE
    rows = F.sequence(bucket(F.greatest(lat - up, F.lit(-90.0)), size), bucket(F.least(lat + up, F.lit(90.0)), size))
    cols = F.sequence(bucket(F.greatest(lon - across, F.lit(-360.0)), size), bucket(F.least(lon + across, F.lit(360.0)), size))
    return F.flatten(
        F.transform(rows, lambda y: F.transform(cols, lambda x: F.struct(y.alias("by"), x.alias("bx"))))
    )
