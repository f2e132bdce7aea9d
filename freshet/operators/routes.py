"""Routes against hazard zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.functions.geo import haversine_km
from freshet.operators.zones import points_in_zones

# Vertex sampling, waypoint offset, fallback speed, texts.
SAMPLE_EVERY = 10
AVOID_FACTOR = 0.5
FALLBACK_KMH = 30.0
DETOUR_WARNING = "Detour applied to avoid: "
BLOCKED_WARNING = "Route unavoidably passes through: "
CAUTION_WARNING = "Exercise extreme caution or postpone travel"
FALLBACK_WARNING = "Routing service unavailable. Showing straight-line distance."


def sample_vertices(vertices: DataFrame, every: int = SAMPLE_EVERY) -> DataFrame:
    """Every tenth vertex of each route and its last one; the last vertex comes from a partial
    aggregate, so long routes are not gathered."""
    rest = [c for c in vertices.columns if c not in ("route_id", "pos")]
    regular = vertices.where(F.col("pos") % every == 0)
    last = (
        vertices.groupBy("route_id")
        .agg(F.max("pos").alias("pos"), F.max_by(F.struct(*rest), "pos").alias("_v"))
        .where(F.col("pos") % every != 0)
        .select("route_id", "pos", "_v.*")
    )
    return regular.unionByName(last)


def route_hits(vertices: DataFrame, zones: DataFrame, every: int = SAMPLE_EVERY) -> DataFrame:
    """Distinct (route_id, zone) pairs over the sampled vertices, with the zone's centre and radius."""
    pairs = points_in_zones(sample_vertices(vertices, every), zones, ("route_id", "pos"))
    return pairs.select("route_id", "zone_id", "center_lat", "center_lon", "radius_km").distinct()


def route_zones(vertices: DataFrame, zones: DataFrame, every: int = SAMPLE_EVERY) -> DataFrame:
    """The set of zones each affected route touches, sorted by id."""
    hits = route_hits(vertices, zones, every)
    return hits.groupBy("route_id").agg(F.sort_array(F.collect_set("zone_id")).alias("zones"))


def avoidance_waypoints(routes: DataFrame, hits: DataFrame) -> DataFrame:
    """Waypoint per affected route: its midpoint pushed away from the affected zone nearest to it.

    `routes`: route_id, origin and destination as structs of lat, lon.
    """
    met = routes.join(hits, "route_id").withColumns(
        {
            "mid_lat": (F.col("origin.lat") + F.col("destination.lat")) / 2,
            "mid_lon": (F.col("origin.lon") + F.col("destination.lon")) / 2,
        }
    )
    km = haversine_km(F.col("mid_lat"), F.col("mid_lon"), F.col("center_lat"), F.col("center_lon"))
    zone = F.struct("zone_id", "center_lat", "center_lon")
    nearest = met.groupBy("route_id", "mid_lat", "mid_lon").agg(
        F.min_by(zone, F.struct(km.alias("km"), F.col("zone_id"))).alias("_z")
    )
    return nearest.select(
        "route_id",
        F.col("_z.zone_id").alias("zone_id"),
        (F.col("mid_lat") + (F.col("mid_lat") - F.col("_z.center_lat")) * AVOID_FACTOR).alias("lat"),
        (F.col("mid_lon") + (F.col("mid_lon") - F.col("_z.center_lon")) * AVOID_FACTOR).alias("lon"),
    )


def eta_fallback(routes: DataFrame) -> DataFrame:
    """Straight-line distance and minutes at 30 km/h for routes nobody could compute."""
    km = haversine_km(F.col("origin.lat"), F.col("origin.lon"), F.col("destination.lat"), F.col("destination.lon"))
    return routes.withColumn("distance_km", km).withColumns(
        {
            "eta_minutes": (F.col("distance_km") / FALLBACK_KMH * 60).cast("int"),
            "route_status": F.lit("UNKNOWN"),
            "warnings": F.array(F.lit(FALLBACK_WARNING)),
        }
    )


def route_status(
    requests: DataFrame, direct: DataFrame, detour: DataFrame, direct_hits: DataFrame, detour_hits: DataFrame
) -> DataFrame:
    """Decide each request from its direct route and, where that is blocked, its detour.

    `requests`: route_id, origin, destination. `direct` / `detour`: route_id, distance_km,
    eta_minutes[, steps]. `*_hits`: route_id, zones (see `route_zones`). A request without a direct
    route, or blocked without a detour, falls back to the straight line.
    """

    def side(df, mark):
        steps = F.size("steps") if "steps" in df.columns else F.lit(0)
        return df.select(
            "route_id",
            F.struct(F.col("distance_km").alias("km"), F.col("eta_minutes").alias("eta"), steps.alias("steps")).alias(mark),
        )

    all_routes = (
        eta_fallback(requests)
        .withColumnRenamed("distance_km", "_line_km")
        .withColumnRenamed("eta_minutes", "_line_eta")
        .drop("route_status", "warnings")
        .join(side(direct, "_direct"), "route_id", "left")
        .join(side(detour, "_detour"), "route_id", "left")
        .join(direct_hits.select("route_id", F.col("zones").alias("_hit")), "route_id", "left")
        .join(detour_hits.select("route_id", F.col("zones").alias("_hit2")), "route_id", "left")
    )
    no_text = F.array().cast("array<string>")
    clear = F.col("_direct").isNotNull() & F.col("_hit").isNull()
    avoided = F.col("_direct").isNotNull() & F.col("_hit").isNotNull() & F.col("_detour").isNotNull() & F.col("_hit2").isNull()
    blocked = F.col("_direct").isNotNull() & F.col("_hit").isNotNull() & F.col("_detour").isNotNull() & F.col("_hit2").isNotNull()

    def pick(direct_value, detour_value, line_value):
        return F.when(clear, direct_value).when(avoided | blocked, detour_value).otherwise(line_value)

    names = F.array_join("_hit", ", ")
    names2 = F.array_join("_hit2", ", ")
    return all_routes.select(
        "route_id",
        "origin",
        "destination",
        F.when(clear | avoided, "SAFE").when(blocked, "BLOCKED").otherwise("UNKNOWN").alias("route_status"),
        pick(F.col("_direct.km"), F.col("_detour.km"), F.col("_line_km")).alias("distance_km"),
        pick(F.col("_direct.eta"), F.col("_detour.eta"), F.col("_line_eta")).cast("int").alias("eta_minutes"),
        F.when(avoided, F.col("_hit")).otherwise(no_text).alias("avoided_hazards"),
        F.when(clear, no_text)
        .when(avoided, F.array(F.concat(F.lit(DETOUR_WARNING), names)))
        .when(blocked, F.array(F.concat(F.lit(BLOCKED_WARNING), names2), F.lit(CAUTION_WARNING)))
        .otherwise(F.array(F.lit(FALLBACK_WARNING)))
        .alias("warnings"),
        F.lit(0).alias("segment_count"),
        pick(F.col("_direct.steps"), F.col("_detour.steps"), F.lit(0)).alias("steps_count"),
    )


def route_safety(statuses: DataFrame) -> DataFrame:
    return statuses.select(
        "route_id", (F.col("route_status") == "SAFE").alias("is_safe"), "route_status", "avoided_hazards", "warnings"
    )
