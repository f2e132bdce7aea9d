"""Landed JSON payloads: hourly weather, routes, station records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

STATION_SCHEMA = (
    "station_id string, river string, location string, warning_level double, danger_level double, "
    "latitude double, longitude double"
)
ROUTE_SCHEMA = (
    "features array<struct<geometry: struct<coordinates: array<array<double>>>,"
    "properties: struct<summary: struct<distance: double, duration: double>,"
    "segments: array<struct<steps: array<struct<instruction: string, distance: double, duration: double>>>>>>>"
)
METRES, KILOMETRES = 1000.0, 1.0


def parse_hourly_payload(df: DataFrame, variables: Sequence[str], payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """{hourly: {time: [...], v: [...]}} -> one row per time; arrays shorter than `time` give nulls."""
    arrays = ", ".join(["time: array<string>", *[f"`{v}`: array<double>" for v in variables]])
    hourly = df.select(*keep, F.from_json(payload, f"hourly struct<{arrays}>").alias("_p"))
    zipped = F.arrays_zip(F.col("_p.hourly.time"), *[F.col(f"_p.hourly.`{v}`") for v in variables])
    rows = hourly.select(*keep, F.explode(zipped).alias("_r"))
    time = F.coalesce(
        F.try_to_timestamp(F.col("_r.time"), F.lit("yyyy-MM-dd'T'HH:mm")), F.col("_r.time").try_cast("timestamp")
    )
    return rows.select(
        *keep, time.cast("timestamp_ntz").alias("timestamp"), *[F.col(f"_r.`{v}`").alias(v) for v in variables]
    )


def parse_route_payload(df: DataFrame, payload: str = "payload", unit: float = METRES, keep: Sequence[str] = ("route_id",)) -> DataFrame:
    """Route GeoJSON -> coordinates, distance_km, duration_minutes and the flattened steps.

    `unit` says how many payload distance units make a kilometre.
    """
    feature = F.from_json(payload, ROUTE_SCHEMA)["features"][0]
    parsed = df.select(*keep, feature.alias("_f"))
    summary = F.col("_f.properties.summary")
    # payloads without segments or steps give an empty step list
    segments = F.coalesce(F.col("_f.properties.segments"), F.from_json(F.lit("[]"), "array<struct<steps: array<struct<instruction: string, distance: double, duration: double>>>>"))
    steps = F.flatten(F.filter(F.transform(segments, lambda s: s["steps"]), lambda a: a.isNotNull()))
    return parsed.select(
        *keep,
        F.transform("_f.geometry.coordinates", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).alias("coordinates"),
        (summary["distance"] / unit).alias("distance_km"),
        (summary["duration"] / 60).cast("int").alias("duration_minutes"),
        F.transform(
            steps,
            lambda s: F.struct(
                F.coalesce(s["instruction"], F.lit("")).alias("instruction"),
                (F.coalesce(s["distance"], F.lit(0.0)) / unit).alias("distance_km"),
                (F.coalesce(s["duration"], F.lit(0.0)) / 60).cast("int").alias("duration_minutes"),
            ),
        ).alias("steps"),
    )


def read_station_dim(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Stations from one JSON document per file, or from JSON lines with `lines`."""
    return spark.read.schema(STATION_SCHEMA).json(path, multiLine=not lines)
