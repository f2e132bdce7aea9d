"""Structured Streaming jobs: zone registry, position alerts, gauge watch.

All three read an append-only source and can run continuously or with `available_now`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from freshet.operators.alerts import alert_id
from freshet.operators.targeting import user_priority

REGISTRY_SCHEMA = "zone_id string, event string, severity string, valid_until timestamp, event_time timestamp"
_STATE_SCHEMA = "held string"


def _micros(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000)


def _instant(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


def _register(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Emit every registration of one zone, and an all-clear for each that lapses before the zone's next one.

    Held are the registrations that nothing known has superseded, as [issued, until, severity] in
    microseconds. One is superseded by a later one issued before its end. Only when the watermark
    has passed its end is it cleared, as by then no earlier registration can still come.
    """
    held = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
    rows = []
    if not state.hasTimedOut:
        for batch in batches:
            arrived = sorted(
                zip(map(_micros, batch["issued_at"]), map(_micros, batch["valid_until"]), map(str, batch["severity"]))
            )
            for issued, until, severity in arrived:
                rows.append((key[0], "ACTIVE", severity, _instant(until), _instant(issued)))
            held = sorted([*held, *arrived])
    held = [x for x, later in zip(held, [*held[1:], None]) if later is None or x[1] <= later[0]]
    passed = state.getCurrentWatermarkMs() * 1000
    for _, until, severity in (x for x in held if x[1] < passed):
        rows.append((key[0], "ALL_CLEAR", severity, _instant(until), _instant(until)))
    held = [x for x in held if x[1] >= passed]
    if held:
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(min(x[1] for x in held) // 1000)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(rows, columns=["zone_id", "event", "severity", "valid_until", "event_time"])


def zone_registry(registrations: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Stream of zone registrations (zone_id, severity, issued_at, valid_until) -> ACTIVE / ALL_CLEAR rows.

    One ACTIVE row per registration; one ALL_CLEAR row, at `valid_until`, for each registration that
    ends no later than the zone's next one is issued, and for the last one once the watermark has
    passed its end. How rows fall into batches makes no difference. A row older than the watermark
    (the newest `issued_at` seen, less `delay`) is late: it is dropped and changes nothing. State is a
    few numbers per live zone; the event-time timer removes them.
    """
    kept = registrations.select(
        "zone_id",
        "severity",
        F.col("issued_at").cast("timestamp").alias("issued_at"),
        F.col("valid_until").cast("timestamp").alias("valid_until"),
    )
    return (
        kept.withWatermark("issued_at", delay)
        .groupBy("zone_id")
        .applyInPandasWithState(
            _register, REGISTRY_SCHEMA, _STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def all_clear_notices(events: DataFrame) -> DataFrame:
    return events.where(F.col("event") == "ALL_CLEAR").withColumn(
        "alert_id", alert_id("CLR", F.col("zone_id"), F.col("event_time"))
    )


def gauge_watch(readings: DataFrame, delay: str = "1 hour", station: str = "station_id") -> DataFrame:
    """Hourly mean level per station against its warning and danger levels, as windows close.

    `readings`: station_id, timestamp, water_level, warning_level, danger_level.
    """
    timed = readings.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    hourly = timed.withWatermark("timestamp", delay).groupBy(station, F.window("timestamp", "1 hour")).agg(
        F.avg("water_level").alias("mean_level"),
        F.max("water_level").alias("max_level"),
        F.max("warning_level").alias("warning_level"),
        F.max("danger_level").alias("danger_level"),
    )
    level = F.col("mean_level")
    return hourly.select(
        station,
        F.col("window.start").cast("timestamp_ntz").alias("hour"),
        "mean_level",
        "max_level",
        F.when(level >= F.col("danger_level"), "DANGER")
        .when(level >= F.col("warning_level"), "WARNING")
        .otherwise("NORMAL")
        .alias("state"),
    )


def contact_spells(
    readings: DataFrame, stations: DataFrame, delay: str = "1 hour", default_gap: str = "6 hours", station: str = "station_id"
) -> DataFrame:
    """Spells in which a station kept reporting, given out once its silence is certain.

    `readings` (a stream): station_id, timestamp, water_level; `stations` (a table, one row each):
    station_id, report_gap, an interval text such as '3 hours'. A reading later than the station's
    gap after the last one begins a new spell; stations that the table lacks, or whose gap is null,
    take `default_gap`. Readings of a station at one time count once, also when a repeat comes in a
    later batch within `delay`. `silent_from` is the last reading plus the gap: the spell comes out
    when the watermark has passed it. Readings without station or time are left out.
    """
    timed = readings.withColumn("timestamp", F.col("timestamp").cast("timestamp")).dropna(subset=[station, "timestamp"])
    once = timed.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark([station, "timestamp"])
    gapped = once.join(stations.select(station, "report_gap"), station, "left")
    gap = F.coalesce("report_gap", F.lit(default_gap))
    spells = gapped.groupBy(station, F.session_window("timestamp", gap).alias("spell")).agg(
        F.count(F.lit(1)).alias("readings"), F.max("timestamp").alias("last_reading"), F.max("water_level").alias("max_level")
    )
    return spells.select(
        station,
        F.col("spell.start").cast("timestamp_ntz").alias("first_reading"),
        F.col("last_reading").cast("timestamp_ntz").alias("last_reading"),
        F.col("spell.end").cast("timestamp_ntz").alias("silent_from"),
        "readings",
        "max_level",
    )


def position_alerts(
    positions: DataFrame, read_zones: Callable[[], DataFrame], path: str, checkpoint: str, buffer_km: float = 5.0,
    time: str = "ts", available_now: bool = True,
) -> StreamingQuery:
    """Decide every arriving user position against the zones that are valid at its own time.

    Each micro-batch reads the zones anew, so zones registered since the start count and expired ones
    do not. A zone holds for a position while `time` is before its `valid_until`. The batch's output
    goes to a directory named by the batch id and is overwritten on replay, so a restarted batch
    leaves no duplicates.
    """

    def decide(batch: DataFrame, batch_id: int) -> None:
        decided = user_priority(batch, read_zones(), buffer_km, valid_at=time)
        decided.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = positions.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)
