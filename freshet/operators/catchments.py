"""Catchment weather and catchment outlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Kilometres per degree, sampling limits, default terrain means.
KM_PER_DEGREE = 111.0
ONE_POINT_KM2 = 100.0
CORNER_POINTS_KM2 = 1000.0
DEFAULT_MEAN_HAND = 5.0
DEFAULT_MEAN_SLOPE = 2.5
FORECAST_DAYS = 16


def areal_mean(
    points: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("catchment_id", "timestamp")
) -> DataFrame:
    """Mean of every variable over a catchment's sampling points at each time; absent points are skipped."""
    return points.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in variables])


def catchment_rainfall(df: DataFrame, catchment_id: str | None = None) -> DataFrame:
    """Standard layout: catchment_id, timestamp, rainfall_mm, then the remaining variables."""
    if catchment_id is not None:
        df = df.withColumn("catchment_id", F.lit(catchment_id))
    df = df.withColumnRenamed("precipitation", "rainfall_mm")
    first = ["catchment_id", "timestamp", "rainfall_mm"]
    return df.select(*first, *[c for c in df.columns if c not in first])


def forecast_window(df: DataFrame, as_of: str, days: int, time: str = "timestamp") -> DataFrame:
    """Rows of the day `as_of` and the `days` - 1 after it; forecasts reach FORECAST_DAYS at most."""
    if not 1 <= days <= FORECAST_DAYS:
        raise ValueError(f"days must be 1 to {FORECAST_DAYS}, not {days}")
    start = F.lit(as_of).cast("date")
    day = F.col(time).cast("date")
    return df.where((day >= start) & (day < F.date_add(start, days)))


def rain_totals(df: DataFrame, variables: Sequence[str] = ("rainfall_mm",)) -> DataFrame:
    aggregates = [F.sum("rainfall_mm").alias("total_rainfall_mm")]
    for v in variables:
        aggregates += [F.avg(v).alias(f"mean_{v}"), F.min(v).alias(f"min_{v}"), F.max(v).alias(f"max_{v}")]
    return df.groupBy("catchment_id").agg(*aggregates)


def rain_outlook(df: DataFrame, as_of: str, rain: str = "rainfall_mm", time: str = "timestamp") -> DataFrame:
    """Rain of the day `as_of`, and of that day and the next, per catchment."""
    offset = F.date_diff(F.col(time).cast("date"), F.lit(as_of).cast("date"))
    return df.groupBy("catchment_id").agg(
        F.coalesce(F.sum(F.when(offset == 0, F.col(rain))), F.lit(0.0)).alias("rain_24h"),
        F.coalesce(F.sum(F.when(offset.isin(0, 1), F.col(rain))), F.lit(0.0)).alias("rain_48h"),
    )


# --- outlines: a ring is ARRAY<STRUCT<lon, lat>>, closed, one row per catchment ---


def ring_edges(ring: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.size(ring) - 1),
        lambda i: F.struct(
            F.element_at(ring, i).alias("a"), F.element_at(ring, i + 1).alias("b")
        ),
    )


def _total(edges: Column, term) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + term(e))


def _cross(e: Column) -> Column:
    return e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]


def covers(edges: Column, lon: Column, lat: Column) -> Column:
    """Inside by crossing parity, or on an edge."""

    def on_edge(e):
        turn = (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) - (e["b"]["lat"] - e["a"]["lat"]) * (
            lon - e["a"]["lon"]
        )
        return (
            (turn == 0)
            & lon.between(F.least(e["a"]["lon"], e["b"]["lon"]), F.greatest(e["a"]["lon"], e["b"]["lon"]))
            & lat.between(F.least(e["a"]["lat"], e["b"]["lat"]), F.greatest(e["a"]["lat"], e["b"]["lat"]))
        )

    def crosses(e):
        # multiplied out by the sign of the edge's height, so no division is needed
        height = e["b"]["lat"] - e["a"]["lat"]
        side = (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) - (lon - e["a"]["lon"]) * height
        return ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (side * F.signum(height) > 0)

    return F.exists(edges, on_edge) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def outline_measures(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Bounding box, centroid, area in deg² and km² (longitude scaled at the box's middle latitude)."""
    lons = F.transform(ring, lambda p: p["lon"])
    lats = F.transform(ring, lambda p: p["lat"])
    edged = df.withColumns(
        {
            "_edges": ring_edges(F.col(ring)),
            "min_lon": F.array_min(lons),
            "max_lon": F.array_max(lons),
            "min_lat": F.array_min(lats),
            "max_lat": F.array_max(lats),
        }
    )
    edges = F.col("_edges")
    twice = _total(edges, _cross)
    measured = edged.withColumns(
        {
            "_twice": twice,
            "_mx": _total(edges, lambda e: (e["a"]["lon"] + e["b"]["lon"]) * _cross(e)),
            "_my": _total(edges, lambda e: (e["a"]["lat"] + e["b"]["lat"]) * _cross(e)),
        }
    )
    mid = F.radians((F.col("min_lat") + F.col("max_lat")) / 2)
    return measured.withColumns(
        {
            "centroid_lon": F.try_divide(F.col("_mx"), 3 * F.col("_twice")),
            "centroid_lat": F.try_divide(F.col("_my"), 3 * F.col("_twice")),
            "area_deg2": F.abs(F.col("_twice")) / 2,
            "area_km2": F.abs(F.col("_twice")) / 2 * F.lit(KM_PER_DEGREE**2) * F.cos(mid),
        }
    ).drop("_twice", "_mx", "_my")


def sampling_points(df: DataFrame, key: str = "catchment_id", ring: str = "ring") -> DataFrame:
    """Weather sampling points: centroid, plus box corners or a 3×3 lattice inside larger outlines."""
    m = outline_measures(df, ring)
    lo_x, hi_x, lo_y, hi_y = (F.col(c) for c in ("min_lon", "max_lon", "min_lat", "max_lat"))

    def point(lat, lon):
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    corners = F.array(point(lo_y, lo_x), point(lo_y, hi_x), point(hi_y, lo_x), point(hi_y, hi_x))
    lattice = F.array(
        *[
            point(lo_y + (i + 0.5) * ((hi_y - lo_y) / 3), lo_x + (j + 0.5) * ((hi_x - lo_x) / 3))
            for i in range(3)
            for j in range(3)
        ]
    )
    candidates = F.when(F.col("area_km2") < CORNER_POINTS_KM2, corners).otherwise(lattice)
    inside = F.filter(candidates, lambda p: covers(F.col("_edges"), p["lon"], p["lat"]))
    centre = F.array(point(F.col("centroid_lat"), F.col("centroid_lon")))
    points = F.when(F.col("area_km2") < ONE_POINT_KM2, centre).otherwise(F.concat(centre, inside))
    return m.select(key, F.posexplode(points).alias("point_no", "_p")).select(key, "point_no", "_p.lat", "_p.lon")


def terrain_from_outline(df: DataFrame, key: str = "station_id", ring: str = "ring", zonal: DataFrame | None = None) -> DataFrame:
    """catchment_area, mean_hand, mean_slope; the means come from `zonal` where it has them."""
    area = outline_measures(df, ring).select(key, F.col("area_km2").alias("catchment_area"))
    if zonal is None:
        return area.withColumns(
            {"mean_hand": F.lit(DEFAULT_MEAN_HAND), "mean_slope": F.lit(DEFAULT_MEAN_SLOPE)}
        )
    return area.join(zonal, key, "left").select(
        key,
        "catchment_area",
        F.coalesce("mean_hand", F.lit(DEFAULT_MEAN_HAND)).alias("mean_hand"),
        F.coalesce("mean_slope", F.lit(DEFAULT_MEAN_SLOPE)).alias("mean_slope"),
    )


def request_key(*parts: Column, length: int = 16) -> Column:
    """Stable hex key of a request: sha-256 prefix of its parts joined by underscores."""
    return F.substring(F.sha2(F.concat_ws("_", *parts), 256), 1, length)
