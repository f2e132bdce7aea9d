"""Hazard zones: from predictions, by time and hazard, and against points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.clock import plus_hours, stamp
from freshet.functions.geo import bucket, circle_polygon, covering_buckets, planar_km
from freshet.functions.risk import RISK_RANK, SEVERITY_RANK, choose, radius_km, worst, zone_severity
from freshet.functions.series import salted_lookup

# Validity, request bounds, list lengths.
FLOOD_EXTRA_HOURS = 6
LANDSLIDE_HOURS = 24
DEFAULT_LEAD_HOURS = 12
DEFAULT_PROBABILITY = 0.5
DEFAULT_RISK = "MEDIUM"
COMBINED_DRIVERS = 3
NEAR_KM = 5.0
NEARBY_LISTED = 5
REQUEST_BOUNDS = {
    "lat": (-90.0, 90.0),
    "lon": (-180.0, 180.0),
    "probability": (0.0, 1.0),
    "lead_time_hours": (1.0, 72.0),
    "buffer_km": (0.1, 50.0),
}

POINT_SALTS = 8


def _optional(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def _stamp_text(as_of: Column) -> Column:
    return F.date_format(as_of, "yyyyMMddHHmm")


def _zone_columns(df: DataFrame, as_of: Column, **parts: Column) -> DataFrame:
    fields = ["station_id", "lat", "lon", "probability", "susceptibility", "risk_level", "lead_time_hours"]
    return df.select(
        parts["zone_id"].alias("zone_id"),
        F.lit(parts["hazard"]).alias("hazard_type"),
        zone_severity(parts["risk_level"]).alias("severity"),
        F.col("lat").alias("center_lat"),
        F.col("lon").alias("center_lon"),
        parts["radius"].alias("radius_km"),
        circle_polygon(F.col("lat"), F.col("lon"), parts["radius"]).alias("polygon"),
        as_of.alias("valid_from"),
        parts["valid_until"].alias("valid_until"),
        F.struct(*[parts[f].alias(f) for f in fields]).alias("source_prediction"),
    )


def flood_zones(predictions: DataFrame, as_of: str) -> DataFrame:
    """station_id, lat, lon, probability[, risk_level, lead_time_hours] -> one flood zone per row."""
    now = stamp(as_of)
    risk = _optional(predictions, "risk_level", DEFAULT_RISK)
    lead = _optional(predictions, "lead_time_hours", DEFAULT_LEAD_HOURS).cast("int")
    return _zone_columns(
        predictions,
        now,
        zone_id=F.concat(F.lit("FLD_"), "station_id", F.lit("_"), _stamp_text(now)),
        hazard="flood",
        risk_level=risk,
        radius=radius_km(risk),
        valid_until=plus_hours(now, lead + FLOOD_EXTRA_HOURS),
        station_id=F.col("station_id"),
        lat=F.lit(None).cast("double"),
        lon=F.lit(None).cast("double"),
        probability=_optional(predictions, "probability", DEFAULT_PROBABILITY),
        susceptibility=F.lit(None).cast("double"),
        lead_time_hours=lead,
    )


def landslide_zones(predictions: DataFrame, as_of: str) -> DataFrame:
    """lat, lon, susceptibility[, risk_level] -> one landslide zone per row."""
    now = stamp(as_of)
    risk = _optional(predictions, "risk_level", DEFAULT_RISK)

    def hundredths(c):
        return (F.col(c) * 100).cast("int").cast("string")

    return _zone_columns(
        predictions,
        now,
        zone_id=F.concat_ws("_", F.lit("LND"), hundredths("lat"), hundredths("lon"), _stamp_text(now)),
        hazard="landslide",
        risk_level=risk,
        radius=radius_km(risk, F.lit("landslide")),
        valid_until=plus_hours(now, LANDSLIDE_HOURS),
        station_id=F.lit(None).cast("string"),
        lat=F.col("lat"),
        lon=F.col("lon"),
        probability=F.lit(None).cast("double"),
        susceptibility=_optional(predictions, "susceptibility", DEFAULT_PROBABILITY),
        lead_time_hours=F.lit(None).cast("int"),
    )


def active_zones(zones: DataFrame, as_of: str) -> DataFrame:
    return zones.where(F.col("valid_until") > stamp(as_of))


def expired_zones(zones: DataFrame, as_of: str) -> DataFrame:
    return zones.where(F.col("valid_until") <= stamp(as_of))


def zones_by_hazard(zones: DataFrame, hazard: str | None = None) -> DataFrame:
    return zones if hazard is None else zones.where(F.col("hazard_type") == hazard)


def near_zones(
    points: DataFrame,
    zones: DataFrame,
    buffer_km: float = 0.0,
    point_key: Sequence[str] = ("user_id",),
    how: str = "inner",
    zone_columns: Sequence[str] = ("zone_id", "radius_km", "severity", "hazard_type"),
    valid_at: str | None = None,
) -> DataFrame:
    """Points (lat, lon) with every zone whose edge is within `buffer_km`; adds distance_km, is_inside.

    Each zone is laid over the grid buckets its reach covers and each point lies in one bucket, so
    the distance test becomes an equi-join with a residual condition and no pair appears twice.
    Crowded buckets are salted on the point side. With `valid_at`, a time column of `points`, a zone
    counts only while its `valid_until` lies after that time.
    """
    center = ["center_lat", "center_lon", *zone_columns, *(["valid_until"] if valid_at else [])]
    reach = F.col("radius_km") + F.lit(buffer_km)
    laid = (
        zones.select(*dict.fromkeys([*center, "radius_km"]))
        .withColumn("_lon_scale", F.cos(F.radians("center_lat")))
        .withColumn("_b", F.explode(covering_buckets(F.col("center_lat"), F.col("center_lon"), reach)))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(POINT_SALTS - 1))))
        .withColumns({"_by": F.col("_b.by"), "_bx": F.col("_b.bx")})
        .drop("_b")
        .alias("z")
    )
    placed = points.withColumns(
        {
            "_by": bucket(F.col("lat")),
            "_bx": bucket(F.col("lon")),
            "_salt": F.pmod(F.xxhash64(*point_key), F.lit(POINT_SALTS)).cast("int"),
        }
    ).alias("p")
    distance = planar_km(
        F.col("p.lat"), F.col("p.lon"), F.col("z.center_lat"), F.col("z.center_lon"), F.col("z._lon_scale")
    )
    on = (
        (F.col("p._by") == F.col("z._by"))
        & (F.col("p._bx") == F.col("z._bx"))
        & (F.col("p._salt") == F.col("z._salt"))
        & (distance <= F.col("z.radius_km") + F.lit(buffer_km))
    )
    if valid_at:
        on &= F.col("z.valid_until") > F.col(f"p.{valid_at}")
    if how in ("left_semi", "left_anti"):
        return placed.join(laid, on, how).select(*points.columns)
    joined = placed.join(laid, on, how)
    return joined.select(
        *[F.col(f"p.{c}") for c in points.columns],
        *[F.col(f"z.{c}") for c in dict.fromkeys(center)],
        distance.alias("distance_km"),
        (distance <= F.col("z.radius_km")).alias("is_inside"),
    )


def points_in_zones(points, zones, point_key=("user_id",), how: str = "inner") -> DataFrame:
    """Pairs of point and containing zone; `left_semi` / `left_anti` give endangered / clear points."""
    return near_zones(points, zones, 0.0, point_key, how)


def location_status(
    points: DataFrame, zones: DataFrame, buffer_km: float = NEAR_KM, point_key: Sequence[str] = ("user_id",),
    lexical_severity: bool = False,
) -> DataFrame:
    """IN_DANGER_ZONE / NEAR_DANGER_ZONE / CLEAR per point with its zones and worst severity.

    `lexical_severity` ranks severities as plain strings instead of by seriousness.
    """
    pairs = near_zones(points, zones, buffer_km, point_key, "left")
    inside = F.coalesce(F.col("is_inside"), F.lit(False))
    outside = F.col("zone_id").isNotNull() & ~inside
    from pyspark.sql import Window as W

    nearness = W.partitionBy(*point_key, inside).orderBy("distance_km", "zone_id")
    ranked = pairs.withColumn("_rank", F.row_number().over(nearness))
    listed = F.struct(F.col("distance_km"), F.col("zone_id"))
    ranks = choose(F.col("severity"), SEVERITY_RANK)
    worst_inside = (
        F.max(F.when(inside, F.col("severity")))
        if lexical_severity
        else choose(F.max(F.when(inside, ranks)), {v: k for k, v in SEVERITY_RANK.items()})
    )
    grouped = ranked.groupBy(*points.columns).agg(
        F.sort_array(F.collect_list(F.when(inside, F.col("zone_id")))).alias("zones_inside"),
        F.sort_array(F.collect_list(F.when(outside & (F.col("_rank") <= NEARBY_LISTED), listed))).alias("_near"),
        worst_inside.alias("_worst"),
        F.min_by("severity", F.struct("distance_km", "zone_id")).alias("_nearest"),
    )
    is_in, is_near = F.size("zones_inside") > 0, F.size("_near") > 0
    return grouped.select(
        *points.columns,
        F.when(is_in, "IN_DANGER_ZONE").when(is_near, "NEAR_DANGER_ZONE").otherwise("CLEAR").alias("status"),
        F.when(is_in, F.col("_worst")).when(is_near, F.col("_nearest")).otherwise("NONE").alias("max_severity"),
        "zones_inside",
        F.transform(
            "_near", lambda s: F.struct(s["zone_id"].alias("zone_id"), F.round(s["distance_km"], 2).alias("distance_km"))
        ).alias("zones_nearby"),
    )


def zone_summary(zones: DataFrame) -> DataFrame:
    return zones.agg(
        F.count_if(F.col("hazard_type") == "flood").alias("flood_zones"),
        F.count_if(F.col("hazard_type") == "landslide").alias("landslide_zones"),
        F.when(F.count(F.lit(1)) > 0, "HIGH").otherwise("LOW").alias("overall"),
    )


def blocked_segments(zones: DataFrame, as_of: str) -> DataFrame:
    return active_zones(zones, as_of).select(
        "zone_id",
        "hazard_type",
        F.struct(F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon")).alias("center"),
        "radius_km",
        "severity",
        F.concat(F.lit("Blocked due to "), "hazard_type", F.lit(" hazard")).alias("description"),
    )


def combined_risk(
    landslide: DataFrame, flood: DataFrame, station: str = "station_id", spread: Sequence[str] = ("user_id",), k: int = COMBINED_DRIVERS
) -> DataFrame:
    """Per location: its landslide answer, the flood answer of its station, and the worse level of both.

    Landslide rows have risk_level, flood rows risk_level and probability; `susceptibility`,
    `lead_time_hours` and `top_drivers` (strongest first; the first `k` are kept) are carried where
    they are given. Flood columns are null for a location without a station or one that no answer
    exists for. Levels rank HIGH, MEDIUM, LOW, NEGLIGIBLE; without any, the risk is UNKNOWN.
    """
    names = {"probability": "flood_probability", "risk_level": "flood_risk", "lead_time_hours": "lead_time_hours"}
    carried = [F.col(c).alias(n) for c, n in names.items() if c in flood.columns]
    if "top_drivers" in flood.columns:
        carried.append(F.slice("top_drivers", 1, k).alias("flood_drivers"))
    located = landslide
    if "top_drivers" in landslide.columns:
        located = landslide.withColumn("landslide_drivers", F.slice("top_drivers", 1, k)).drop("top_drivers")
    both = salted_lookup(located, flood.select(station, *carried), [station], spread)
    return both.withColumn(
        "overall_risk", F.coalesce(worst(RISK_RANK, F.col("risk_level"), F.col("flood_risk")), F.lit("UNKNOWN"))
    )


def check_bounds(requests: DataFrame, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Add `violations` (names of out-of-range parameters) and `is_valid`; nulls mean "not given"."""
    present = {c: b for c, b in (bounds or REQUEST_BOUNDS).items() if c in requests.columns}
    marks = [F.when(~F.col(c).between(lo, hi), F.lit(c)) for c, (lo, hi) in present.items()]
    violations = F.filter(F.array(*marks), lambda m: m.isNotNull())
    return requests.withColumn("violations", violations).withColumn("is_valid", F.size("violations") == 0)
