"""Alerts written from zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.clock import plus_hours, stamp
from freshet.functions.risk import choose
from freshet.operators.zones import DEFAULT_LEAD_HOURS, active_zones, expired_zones

# Alert kinds, severities and texts.
SERIOUS = ("CRITICAL", "HIGH")
ALERT_SEVERITY = {"CRITICAL": "EXTREME", "HIGH": "SEVERE", "MEDIUM": "MODERATE", "LOW": "MINOR"}
OTHER_ALERT_SEVERITY = "MODERATE"
ACTIONS = {
    "EXTREME": "EVACUATE IMMEDIATELY to higher ground. Follow official instructions.",
    "SEVERE": "PREPARE TO EVACUATE. Move valuables to upper floors. Avoid low-lying areas.",
    "MODERATE": "STAY ALERT. Monitor official channels. Avoid unnecessary travel in affected areas.",
}
OTHER_ACTION = "BE AWARE. Stay informed of weather conditions."
FLOOD_MESSAGE = (
    "Flood risk detected near %s. Probability: %.0f%%. Expected within %d hours. "
    "Affected radius: %.1fkm. Avoid low-lying areas and waterways."
)
LANDSLIDE_MESSAGE = (
    "Landslide susceptibility elevated in area. Susceptibility: %.0f%%. "
    "Affected radius: %.1fkm. Avoid steep slopes, cuts, and unstable terrain."
)
FLOOD_HEADLINE = "%s: Flood Risk in %s"
LANDSLIDE_HEADLINE = "%s: Landslide Risk at (%.2f, %.2f)"
CLEAR_HEADLINE = "ALL CLEAR: Hazard zone %s has been cleared"
CLEAR_MESSAGE = "The previous hazard warning has been lifted. Normal activities may resume."
CLEAR_ACTION = "Continue to monitor official channels."
CLEAR_HOURS = 1


def alert_type(hazard: Column, severity: Column) -> Column:
    serious = severity.isin(*SERIOUS)
    return (
        F.when((hazard == "flood") & serious, "FLOOD_WARNING")
        .when(hazard == "flood", "FLOOD_WATCH")
        .when(serious, "LANDSLIDE_ALERT")
        .otherwise("LANDSLIDE_WATCH")
    )


def alert_severity(severity: Column) -> Column:
    return choose(severity, ALERT_SEVERITY, OTHER_ALERT_SEVERITY)


def recommended_action(severity: Column) -> Column:
    return choose(severity, ACTIONS, OTHER_ACTION)


def text(pattern: str, *args: Column) -> Column:
    return F.format_string(pattern, *args)


def half_even(value: Column, digits: int) -> Column:
    """`format_string` rounds half up; text here rounds half to even, so round first."""
    return F.bround(value, digits)


def alert_id(prefix: str, zone_id: Column, now: Column) -> Column:
    day = F.date_format(now, "yyyyMMdd")
    token = F.upper(F.substring(F.sha2(F.concat(zone_id, F.date_format(now, "yyyy-MM-dd HH:mm:ss")), 256), 1, 8))
    return F.concat_ws("_", F.lit(prefix), day, token)


def alerts_from_zones(zones: DataFrame, as_of: str) -> DataFrame:
    """One alert per active zone; expires with the zone."""
    now = stamp(as_of)
    pred = F.col("source_prediction")
    kind = alert_type(F.col("hazard_type"), F.col("severity"))
    flood = F.col("hazard_type") == "flood"
    level = alert_severity(F.col("severity"))
    radius = half_even(F.col("radius_km"), 1)
    headline = F.when(
        flood, text(FLOOD_HEADLINE, kind, F.coalesce(pred["station_id"], F.lit("Area")))
    ).otherwise(
        text(LANDSLIDE_HEADLINE, kind, half_even(F.col("center_lat"), 2), half_even(F.col("center_lon"), 2))
    )
    message = F.when(
        flood,
        text(
            FLOOD_MESSAGE,
            F.coalesce(pred["station_id"], F.lit("Unknown")),
            half_even(F.coalesce(pred["probability"], F.lit(0.0)) * 100, 0),
            F.coalesce(pred["lead_time_hours"], F.lit(DEFAULT_LEAD_HOURS)),
            radius,
        ),
    ).otherwise(
        text(LANDSLIDE_MESSAGE, half_even(F.coalesce(pred["susceptibility"], F.lit(0.0)) * 100, 0), radius)
    )
    return active_zones(zones, as_of).select(
        alert_id("ALT", F.col("zone_id"), now).alias("alert_id"),
        kind.alias("alert_type"),
        level.alias("severity"),
        F.col("hazard_type"),
        F.col("zone_id"),
        F.struct(F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon")).alias("center"),
        "radius_km",
        headline.alias("headline"),
        message.alias("message"),
        recommended_action(level).alias("recommended_action"),
        now.alias("issued_at"),
        F.col("valid_until").alias("expires_at"),
    )


def all_clear(zones: DataFrame, as_of: str) -> DataFrame:
    """One all-clear notice per zone that has expired by `as_of`."""
    now = stamp(as_of)
    return expired_zones(zones, as_of).select(
        alert_id("CLR", F.col("zone_id"), now).alias("alert_id"),
        F.lit("ALL_CLEAR").alias("alert_type"),
        F.lit("MINOR").alias("severity"),
        "zone_id",
        text(CLEAR_HEADLINE, F.col("zone_id")).alias("headline"),
        F.lit(CLEAR_MESSAGE).alias("message"),
        F.lit(CLEAR_ACTION).alias("recommended_action"),
        now.alias("issued_at"),
        plus_hours(now, CLEAR_HOURS).alias("expires_at"),
    )
