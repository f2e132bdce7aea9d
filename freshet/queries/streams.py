"""Streaming jobs run to the end of the supplied tables with the available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions.clock import plus_hours
from freshet.queries.gauges import r
from freshet.queries.registry import GAUGE_USERS, query
from freshet.queries.travel import scratch
from freshet.streaming import watch


def stream_of(t, name: str):
    """The table's file as a stream."""
    schema = t.read(name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)


def drained(t, stream):
    path, checkpoint = scratch(t), scratch(t)
    watch.append_to(stream, path, checkpoint).awaitTermination()
    return t.spark.read.parquet(path)


@query(
    "st3_gauge_watch",
    """
    WITH gauge_at AS (SELECT 'ST' || (user_id // 10) AS station_id, ts AS "timestamp", 47 + value / 41 AS water_level FROM events),
    lim AS (SELECT max("timestamp") - INTERVAL 1 HOUR AS mark FROM gauge_at),
    hourly AS (SELECT station_id, date_trunc('hour', "timestamp")::TIMESTAMP AS hour, avg(water_level) AS mean_level,
                      max(water_level) AS max_level FROM gauge_at GROUP BY 1, 2)
    SELECT station_id, hour, round(mean_level, 6) AS mean_level, round(max_level, 6) AS max_level,
           CASE WHEN mean_level >= 50 THEN 'DANGER' WHEN mean_level >= 49 THEN 'WARNING' ELSE 'NORMAL' END AS state
    FROM hourly, lim WHERE hour + INTERVAL 1 HOUR <= mark""",
)
def gauges(t):
    readings = stream_of(t, "events").select(
        F.concat(F.lit("ST"), F.floor(F.col("user_id") / GAUGE_USERS)).alias("station_id"), F.col("ts").alias("timestamp"),
        (47 + F.col("value") / 41).alias("water_level"), F.lit(49.0).alias("warning_level"), F.lit(50.0).alias("danger_level"),
    )
    return drained(t, watch.gauge_watch(readings)).select("station_id", "hour", r("mean_level"), r("max_level"), "state")


@query(
    "st3_contact_spells",
    """
    WITH levels AS (SELECT 'ST' || (user_id // 10) AS station_id, ts::TIMESTAMP AS "timestamp", max(47 + value / 41) AS water_level FROM events GROUP BY 1, 2),
    gapped AS (SELECT l.*, to_hours(CASE WHEN s_suppkey IS NULL THEN 6 ELSE 2 + s_suppkey % 4 END) AS gap
               FROM levels l LEFT JOIN supplier ON l.station_id = 'ST' || s_suppkey),
    marked AS (SELECT *, CASE WHEN lag("timestamp") OVER w + gap >= "timestamp" THEN 0 ELSE 1 END AS opens
               FROM gapped WINDOW w AS (PARTITION BY station_id ORDER BY "timestamp")),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY station_id ORDER BY "timestamp") AS spell FROM marked),
    spells AS (SELECT station_id, min("timestamp") AS first_reading, max("timestamp") AS last_reading, max("timestamp") + any_value(gap) AS silent_from,
                      count(*) AS readings FROM numbered GROUP BY station_id, spell)
    SELECT * FROM spells WHERE silent_from <= (SELECT date_trunc('millisecond', max("timestamp")) - INTERVAL 1 HOUR FROM levels)""",
)
def spells(t):
    """Every gauge reading comes twice; supplier keys give stations their gaps, others take six hours."""
    twice = stream_of(t, "events").select(
        F.concat(F.lit("ST"), F.floor(F.col("user_id") / GAUGE_USERS)).alias("station_id"), F.col("ts").alias("timestamp"),
        (47 + F.col("value") / 41).alias("water_level"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"),
    )
    gaps = t.read("supplier").select(
        F.concat(F.lit("ST"), "s_suppkey").alias("station_id"), F.concat((2 + F.col("s_suppkey") % 4).cast("string"), F.lit(" hours")).alias("report_gap")
    )
    return drained(t, watch.contact_spells(twice.drop("copy"), gaps)).drop("max_level")


@query(
    "st1_zone_registry",
    """
    WITH regs AS (
      SELECT 'Z' || user_id AS zone_id, CASE WHEN value >= 200 THEN 'CRITICAL' WHEN value >= 50 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
             ts::TIMESTAMP AS issued, ts::TIMESTAMP + to_hours(floor(value / 10)::BIGINT + 1) AS until FROM events),
    seen AS (SELECT *, lead(issued) OVER (PARTITION BY zone_id ORDER BY issued, until, severity) AS next FROM regs)
    SELECT zone_id, 'ACTIVE' AS event, severity, until AS valid_until, issued AS event_time FROM regs
    UNION ALL
    SELECT zone_id, 'ALL_CLEAR', severity, until, until FROM seen
    WHERE (next IS NULL OR until <= next) AND until < (SELECT date_trunc('millisecond', max(issued)) FROM regs)""",
)
def registry(t):
    """Every event registers its user's zone for a number of hours given by its value.

    Files may hold events in any order, so the watermark waits for the whole span of the table.
    """
    until = plus_hours("ts", F.floor(F.col("value") / 10).cast("int") + 1)
    severity = F.when(F.col("value") >= 200, "CRITICAL").when(F.col("value") >= 50, "HIGH").otherwise("MEDIUM")
    registrations = stream_of(t, "events").select(
        F.concat(F.lit("Z"), "user_id").alias("zone_id"), severity.alias("severity"), F.col("ts").alias("issued_at"), until.alias("valid_until")
    )
    events = drained(t, watch.zone_registry(registrations))
    return events.select(
        "zone_id", "event", "severity", F.col("valid_until").cast("timestamp_ntz").alias("valid_until"),
        F.col("event_time").cast("timestamp_ntz").alias("event_time"),
    )


@query(
    "st2_position_alerts",
    "SELECT user_id, priority, action, zones FROM moving",
)
def positions(t):
    """Customers report at hours of their own, spread over the days in which zones expire."""
    users = t.moving_users(stream_of(t, "customer"))
    path, checkpoint = scratch(t), scratch(t)
    watch.position_alerts(users, t.zones, path, checkpoint).awaitTermination()
    return t.spark.read.parquet(path).select("user_id", "priority", "action", F.array_join("zones", ",").alias("zones"))
