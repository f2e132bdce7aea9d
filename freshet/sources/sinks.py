"""Records written out: GeoJSON zones, alert and route records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.series import salted_lookup


def polygon_geometry(ring: Column) -> Column:
    """GeoJSON Polygon from an ARRAY<STRUCT<lon, lat>> ring."""
    pairs = F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))
    return F.struct(F.lit("Polygon").alias("type"), F.array(pairs).alias("coordinates"))


def zone_features(zones: DataFrame) -> DataFrame:
    """One GeoJSON Feature string per zone, keyed by hazard so the sink can partition on it."""
    properties = F.struct(
        "zone_id", "hazard_type", "severity", "radius_km",
        F.date_format("valid_from", "yyyy-MM-dd'T'HH:mm:ss").alias("valid_from"),
        F.date_format("valid_until", "yyyy-MM-dd'T'HH:mm:ss").alias("valid_until"),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"), polygon_geometry(F.col("polygon")).alias("geometry"), properties.alias("properties")
    )
    return zones.select("hazard_type", "zone_id", F.to_json(feature).alias("feature"))


def zone_collections(zones: DataFrame, per_shard: int = 10_000) -> DataFrame:
    """FeatureCollections per hazard, in shards of about `per_shard` zones; a reader concatenates a hazard's shards."""
    sizes = zones.groupBy("hazard_type").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_shard)).alias("_shards"))
    shard = F.pmod(F.xxhash64("zone_id"), F.col("_shards"))
    return (
        salted_lookup(zone_features(zones), sizes, ["hazard_type"], ["zone_id"], "inner")
        .groupBy("hazard_type", shard.alias("shard"))
        .agg(F.sort_array(F.collect_list("feature")).alias("_f"))
        .select(
            "hazard_type",
            "shard",
            F.concat(
                F.lit('{"type":"FeatureCollection","features":['), F.array_join("_f", ","), F.lit("]}")
            ).alias("collection"),
        )
    )


def write_zone_features(zones: DataFrame, path: str, mode: str = "overwrite") -> None:
    zone_features(zones).select("hazard_type", "feature").write.mode(mode).partitionBy("hazard_type").text(path)


def alert_records(alerts: DataFrame) -> DataFrame:
    """Flat alert record with the nested centre and ISO times."""
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return alerts.withColumns({c: F.date_format(c, iso) for c in ("issued_at", "expires_at")})


def route_records(routes: DataFrame) -> DataFrame:
    """Flat route record: distance to 2 decimals, counts of segments and steps."""
    return routes.select(
        "route_id",
        "origin",
        "destination",
        "route_status",
        F.round("distance_km", 2).alias("distance_km"),
        "eta_minutes",
        "avoided_hazards",
        "warnings",
        "segment_count",
        "steps_count",
    )


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
