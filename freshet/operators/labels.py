"""Flood labels, lead times and events on cleaned gauge series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from freshet.functions.clock import hours_between
from freshet.functions.series import SLICE, add_slice


def label_floods(
    df: DataFrame,
    keys: Sequence[str] = ("station_id",),
    time: str = "timestamp",
    level: str = "water_level",
    danger: str = "danger_level",
) -> DataFrame:
    """Add label, lead_time_hours, event_id, event_duration_hours and peak_level.

    A crossing is a 0 -> 1 change between consecutive rows; an event that begins on a series' first
    row is numbered but is not a crossing. Lead time is set on label-0 rows that have a later crossing.
    """
    base = add_slice(df, time).withColumn(
        "label", F.when(F.col(level) >= F.col(danger), F.lit(1)).otherwise(F.lit(0))
    )
    within = W.partitionBy(*keys, SLICE)
    starts = (F.col("label") == 1) & (F.lag("label").over(within.orderBy(time)) == 0)
    rows = base.withColumn("_start", F.coalesce(starts, F.lit(False)).cast("int"))
    # state of each slice, then what it inherits from its neighbours in time
    across = W.partitionBy(*keys).orderBy(SLICE)
    summary = (
        rows.groupBy(*keys, SLICE)
        .agg(
            F.sum("_start").alias("_starts"),
            F.min(F.when(F.col("_start") == 1, F.col(time))).alias("_crossing"),
            F.min(time).alias("_first"),
            F.min_by("label", time).alias("_first_label"),
            F.max_by("label", time).alias("_last_label"),
        )
        .withColumn("_before", F.lag("_last_label").over(across))
        .withColumn(
            "_head", ((F.col("_first_label") == 1) & (F.coalesce("_before", F.lit(0)) == 0)).cast("int")
        )
        .withColumn(
            "_crossing",
            F.when((F.col("_head") == 1) & F.col("_before").isNotNull(), F.col("_first")).otherwise(
                F.col("_crossing")
            ),
        )
    )
    until_now = across.rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(F.desc(SLICE)).rowsBetween(W.unboundedPreceding, -1)
    inherited = summary.select(
        *keys,
        SLICE,
        (F.coalesce(F.sum(F.col("_starts") + F.col("_head")).over(until_now), F.lit(0)) + F.col("_head")).alias(
            "_events_before"
        ),
        F.last("_crossing", ignorenulls=True).over(later).alias("_later_crossing"),
    )
    so_far = within.orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    following = within.orderBy(F.desc(time)).rowsBetween(W.unboundedPreceding, -1)
    crossing = F.when(F.col("_start") == 1, F.col(time))
    runs = rows.withColumn("_run", F.sum("_start").over(so_far))
    stats = _event_stats(runs, inherited, keys, time, level)
    return (
        runs.withColumn("_next", F.last(crossing, ignorenulls=True).over(following))
        .join(inherited, [*keys, SLICE], "inner")
        .join(stats, [*keys, SLICE, "_run", "label"], "left")
        .withColumn(
            "lead_time_hours",
            F.when(
                F.col("label") == 0,
                hours_between(time, F.coalesce("_next", "_later_crossing")),
            ),
        )
        .withColumn("event_id", F.when(F.col("label") == 1, F.col("_events_before") + F.col("_run")))
        .select(*df.columns, "label", "lead_time_hours", "event_id", "event_duration_hours", "peak_level")
    )


def _event_stats(runs: DataFrame, inherited: DataFrame, keys: Sequence[str], time: str, level: str) -> DataFrame:
    """Duration and peak of each event, repeated for every (slice, run) it passes through.

    An event is first reduced to one row per slice, so one that covers most of a series stays small.
    """
    parts = (
        runs.where(F.col("label") == 1)
        .groupBy(*keys, SLICE, "_run", "label")
        .agg(F.min(time).alias("_from"), F.max(time).alias("_to"), F.max(level).alias("_peak"))
        .join(inherited.select(*keys, SLICE, "_events_before"), [*keys, SLICE])
    )
    event = W.partitionBy(*keys, F.col("_events_before") + F.col("_run"))
    return parts.select(
        *keys,
        SLICE,
        "_run",
        "label",
        hours_between(F.min("_from").over(event), F.max("_to").over(event)).alias("event_duration_hours"),
        F.max("_peak").over(event).alias("peak_level"),
    )


def label_summary(df: DataFrame, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_points"),
        F.sum("label").cast("bigint").alias("flood_points"),
        F.round(100.0 * F.avg("label"), 2).alias("flood_percentage"),
        F.coalesce(F.max("event_id"), F.lit(0)).cast("bigint").alias("num_events"),
    )
