"""Registry of queries and of the checking SQL, plus the stand-in tables both sides share.

The supplied tables are a star schema plus events; the stand-ins below read them as gauges, rain,
elevation cells, zones, users and so on. Each stand-in exists twice: as a DataFrame (`Tables`) and
as a SQL common table expression (`CTES`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.functions.clock import plus_hours, stamp
from freshet.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-15 12:00:00"
# Stand-ins keep their density at any scale: so many users make one gauge, and so many suppliers and
# customers share a tile of two degrees (60 tiles by latitude, then 179 by longitude). Rain is scaled
# by a number that leaves no short decimals, so that two engines never round a tie differently.
GAUGE_USERS, TILE_ZONES, TILE_USERS = 10, 100, 1500


def query(name: str, sql: str | None = None):
    def register(fn: Callable[["Tables"], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register


CTES: dict[str, str] = {
    "gauge_raw": """
        SELECT 'ST' || (user_id // 10) AS station_id, date_trunc('hour', ts)::TIMESTAMP AS "timestamp",
               47 + value / 41 AS water_level, 49.0::DOUBLE AS warning_level,
               50.0::DOUBLE AS danger_level, event_id AS seq
        FROM events""",
    "gauge": """
        SELECT station_id, "timestamp", arg_min(water_level, seq) AS water_level,
               49.0::DOUBLE AS warning_level, 50.0::DOUBLE AS danger_level
        FROM gauge_raw GROUP BY station_id, "timestamp" """,
    "rain_points": """
        SELECT 'ST' || (user_id // 10) AS catchment_id, event_type AS point_id,
               date_trunc('hour', ts)::TIMESTAMP AS "timestamp",
               sum(value) / 53.000377::DOUBLE AS precipitation, 15 + avg(value) / 53 AS temperature_2m
        FROM events GROUP BY 1, 2, 3""",
    "rain_hourly": """
        SELECT catchment_id, "timestamp", avg(precipitation) AS rainfall_mm,
               avg(temperature_2m) AS temperature_2m
        FROM rain_points GROUP BY 1, 2""",
    "rain_daily": """
        SELECT 'R' || n_regionkey AS catchment_id, o_orderdate AS "timestamp",
               sum(o_totalprice) / 97000 AS rainfall_mm,
               15 + 20 * avg(o_totalprice) / 489000 AS temperature_2m
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY 1, 2""",
    "stations": """
        SELECT 'ST' || s_suppkey AS station_id, -60 + 2 * ((43 + s_suppkey // 100) % 60) + (s_suppkey * 37 % 200) / 100.0::DOUBLE AS lat,
               -179 + 2 * ((135 + s_suppkey // 6000) % 179) + (s_suppkey * 53 % 200) / 100.0::DOUBLE AS lon,
               least(greatest((s_acctbal + 1000) / 11000, 0), 1) AS probability,
               CASE WHEN s_suppkey % 2 = 0 THEN 'flood' ELSE 'landslide' END AS hazard_type,
               s_suppkey AS key
        FROM supplier""",
    "zones": """
        SELECT 'Z' || lpad(key::VARCHAR, 8, '0') AS zone_id, hazard_type, lat AS center_lat,
               lon AS center_lon, probability, station_id,
               CASE WHEN probability >= 0.6 THEN 'HIGH' WHEN probability >= 0.3 THEN 'MEDIUM'
                    WHEN probability >= 0.1 THEN 'LOW' ELSE 'NEGLIGIBLE' END AS risk_level,
               CASE WHEN probability >= 0.6 THEN 'CRITICAL' WHEN probability >= 0.3 THEN 'HIGH'
                    WHEN probability >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
               CASE WHEN probability >= 0.6 THEN 5.0 WHEN probability >= 0.3 THEN 3.0
                    WHEN probability >= 0.1 THEN 1.0 ELSE 0.5 END::DOUBLE
                 * CASE WHEN hazard_type = 'landslide' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS radius_km,
               TIMESTAMP '2024-01-15 12:00:00' + to_hours(key % 48 - 6) AS valid_until
        FROM stations""",
    "active": """
        SELECT * FROM zones WHERE valid_until > TIMESTAMP '2024-01-15 12:00:00'""",
    "users": """
        SELECT 'U' || lpad(c_custkey::VARCHAR, 9, '0') AS user_id,
               -60 + 2 * ((43 + c_custkey // 1500) % 60) + (c_custkey * 7919 % 2000) / 1000.0::DOUBLE AS lat,
               -179 + 2 * ((135 + c_custkey // 90000) % 179) + (c_custkey * 104729 % 2000) / 1000.0::DOUBLE AS lon, c_custkey AS seq
        FROM customer""",
    "movers": """
        SELECT *, TIMESTAMP '2024-01-15 12:00:00' + to_hours(seq % 60 - 20) AS ts FROM users""",
    "near": """
        SELECT u.user_id, z.*, sqrt(((u.lat - center_lat) * 111.0) ** 2
                 + ((u.lon - center_lon) * 111.0 * cos(radians(center_lat))) ** 2) AS distance_km
        FROM users u JOIN active z
          ON sqrt(((u.lat - center_lat) * 111.0) ** 2
                 + ((u.lon - center_lon) * 111.0 * cos(radians(center_lat))) ** 2) <= radius_km + 5.0""",
    "slides": """
        SELECT 25 + (l_orderkey * 104729 % 1000) / 1000.0::DOUBLE AS lat,
               91 + (l_partkey * 7919 % 1000) / 1000.0::DOUBLE AS lon,
               l_shipdate::DATE AS date, l_orderkey, l_linenumber
        FROM lineitem""",
    "cells": """
        SELECT (p_partkey // 20)::INTEGER AS "row", (p_partkey % 20)::INTEGER AS col,
               CASE WHEN p_partkey % 97 = 0 THEN NULL
                    WHEN (p_partkey // 20) % 25 BETWEEN 6 AND 8 AND p_partkey % 20 BETWEEN 3 AND 5
                      THEN 480.0
                    ELSE 500 - 0.2::DOUBLE * (p_partkey // 20) + 3 * abs(p_partkey % 20 - 10)
                         - CASE WHEN p_partkey % 53 = 0 THEN 8 ELSE 0 END END::DOUBLE AS elevation
        FROM part""",
    "scored": """
        SELECT doc_id AS id, quality AS label,
               0.5::DOUBLE * ((doc_id * 7919 % 1000) / 1000.0::DOUBLE) + 0.3::DOUBLE * quality
                 AS probability
        FROM labels""",
    "vertices": """
        SELECT l_orderkey AS route_id,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                  l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 AS pos,
               25 + (l_orderkey * 104729 % 1000) / 1000.0::DOUBLE
                 + (l_suppkey * 31 % 1000) / 1000.0::DOUBLE AS lat,
               91 + (l_partkey * 7919 % 1000) / 1000.0::DOUBLE AS lon
        FROM lineitem""",
    "contributions": """
        SELECT vec_id AS row_id, 'f' || lpad(i::VARCHAR, 3, '0') AS feature,
               embedding[i + 1]::DOUBLE AS contribution
        FROM embeddings, unnest(range(len(embedding))) AS t(i)""",
}


def with_ctes(sql: str) -> str:
    """Prefix `sql` with the stand-in CTEs it needs, in dependency order."""
    import re

    def needed(text: str) -> set[str]:
        found: set[str] = set()
        for name in CTES:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text, re.I) or re.search(
                rf"\bFROM\b[^()]*,\s*{name}\b", text, re.I
            ):
                found |= {name} | needed(CTES[name])
        return found

    wanted = needed(sql)
    head = ",\n".join(f"{name} AS ({body})" for name, body in CTES.items() if name in wanted)
    body = sql.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def tile_lat(key: Column, size: int) -> Column:
    return -60 + 2 * ((43 + F.floor(key / size)) % 60)


def tile_lon(key: Column, size: int) -> Column:
    return -179 + 2 * ((135 + F.floor(key / (60 * size))) % 179)


def users_of(customers: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customers.select(
        F.concat(F.lit("U"), F.lpad(key.cast("string"), 9, "0")).alias("user_id"),
        (tile_lat(key, TILE_USERS) + (key * 7919 % 2000) / 1000.0).alias("lat"),
        (tile_lon(key, TILE_USERS) + (key * 104729 % 2000) / 1000.0).alias("lon"),
        key.alias("seq"),
    )


def raster_of(key: Column) -> Column:
    """All stand-in cells lie in raster 1 until keys pass a thousand million."""
    return (F.floor(key / 1_000_000_000) + 1).cast("int").alias("dem_id")


class Tables:
    """The supplied tables of one scale folder, and the stand-ins derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir
        self.made: dict[str, DataFrame] = {}  # tables that several steps of one query share

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def gauge_raw(self) -> DataFrame:
        return self.read("events").select(
            F.concat(F.lit("ST"), F.floor(F.col("user_id") / GAUGE_USERS)).alias("station_id"),
            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp"),
            (47 + F.col("value") / 41).alias("water_level"),
            F.lit(49.0).alias("warning_level"),
            F.lit(50.0).alias("danger_level"),
            F.col("event_id").alias("seq"),
        )

    def gauge(self) -> DataFrame:
        return (
            self.gauge_raw()
            .groupBy("station_id", "timestamp")
            .agg(F.min_by("water_level", "seq").alias("water_level"))
            .withColumns({"warning_level": F.lit(49.0), "danger_level": F.lit(50.0)})
        )

    def rain_points(self) -> DataFrame:
        return (
            self.read("events")
            .groupBy(
                F.concat(F.lit("ST"), F.floor(F.col("user_id") / GAUGE_USERS)).alias("catchment_id"),
                F.col("event_type").alias("point_id"),
                F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp"),
            )
            .agg(
                (F.sum("value") / 53.000377).alias("precipitation"),
                (15 + F.avg("value") / 53).alias("temperature_2m"),
            )
        )

    def rain_daily(self) -> DataFrame:
        orders = self.read("orders").select("o_custkey", "o_totalprice", "o_orderdate")
        homes = (
            self.read("customer")
            .select("c_custkey", "c_nationkey")
            .join(self.read("nation").select("n_nationkey", "n_regionkey"), F.expr("c_nationkey = n_nationkey"))
        )
        return (
            orders.join(homes, F.expr("o_custkey = c_custkey"))
            .groupBy(
                F.concat(F.lit("R"), F.col("n_regionkey")).alias("catchment_id"),
                F.col("o_orderdate").alias("timestamp"),
            )
            .agg(
                (F.sum("o_totalprice") / 97000).alias("rainfall_mm"),
                (15 + 20 * F.avg("o_totalprice") / 489000).alias("temperature_2m"),
            )
        )

    def stations(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.read("supplier").select(
            F.concat(F.lit("ST"), key).alias("station_id"),
            (tile_lat(key, TILE_ZONES) + (key * 37 % 200) / 100.0).alias("lat"),
            (tile_lon(key, TILE_ZONES) + (key * 53 % 200) / 100.0).alias("lon"),
            F.least(F.greatest((F.col("s_acctbal") + 1000) / 11000, F.lit(0.0)), F.lit(1.0)).alias("probability"),
            F.when(key % 2 == 0, "flood").otherwise("landslide").alias("hazard_type"),
            key.alias("key"),
        )

    def zones(self) -> DataFrame:
        from freshet.functions.risk import classify_risk, radius_km, zone_severity

        level = classify_risk(F.col("probability"))
        return self.stations().select(
            F.concat(F.lit("Z"), F.lpad(F.col("key").cast("string"), 8, "0")).alias("zone_id"),
            "hazard_type",
            F.col("lat").alias("center_lat"),
            F.col("lon").alias("center_lon"),
            "probability",
            "station_id",
            level.alias("risk_level"),
            zone_severity(level).alias("severity"),
            radius_km(level, F.col("hazard_type")).alias("radius_km"),
            plus_hours(stamp(AS_OF), F.col("key") % 48 - 6).alias("valid_until"),
        )

    def users(self) -> DataFrame:
        return users_of(self.read("customer"))

    def moving_users(self, customers: DataFrame) -> DataFrame:
        """Users who report once each, at hours before and after the zones' common instant."""
        return users_of(customers).withColumn("ts", plus_hours(stamp(AS_OF), F.col("seq") % 60 - 20))

    def slides(self) -> DataFrame:
        return self.read("lineitem").select(
            (25 + (F.col("l_orderkey") * 104729 % 1000) / 1000.0).alias("lat"),
            (91 + (F.col("l_partkey") * 7919 % 1000) / 1000.0).alias("lon"),
            F.col("l_shipdate").cast("date").alias("date"),
            "l_orderkey",
            "l_linenumber",
        )

    def cells(self) -> DataFrame:
        key = F.col("p_partkey")
        row, col = F.floor(key / 20), key % 20
        plane = 500 - F.lit(0.2) * row + 3 * F.abs(col - 10) - F.when(key % 53 == 0, 8).otherwise(0)
        return self.read("part").select(
            raster_of(key),
            row.cast("int").alias("row"),
            col.cast("int").alias("col"),
            F.when(key % 97 == 0, F.lit(None))
            .when((row % 25).between(6, 8) & col.between(3, 5), F.lit(480.0))
            .otherwise(plane)
            .cast("double")
            .alias("elevation"),
        )

    def scored(self) -> DataFrame:
        key = F.col("doc_id")
        return self.read("labels").select(
            key.alias("id"),
            F.col("quality").alias("label"),
            (0.5 * ((key * 7919 % 1000) / 1000.0) + 0.3 * F.col("quality")).alias("probability"),
        )

    def vertices(self) -> DataFrame:
        from pyspark.sql import Window as W

        order = W.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
            "l_quantity", "l_discount", "l_tax",
        )
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("route_id"),
            (F.row_number().over(order) - 1).cast("bigint").alias("pos"),
            (
                25 + (F.col("l_orderkey") * 104729 % 1000) / 1000.0 + (F.col("l_suppkey") * 31 % 1000) / 1000.0
            ).alias("lat"),
            (91 + (F.col("l_partkey") * 7919 % 1000) / 1000.0).alias("lon"),
        )

    def contributions(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("i", "v")
        ).select(
            "row_id",
            F.concat(F.lit("f"), F.lpad(F.col("i").cast("string"), 3, "0")).alias("feature"),
            F.col("v").cast("double").alias("contribution"),
        )
