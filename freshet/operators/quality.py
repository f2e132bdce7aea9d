"""Checking and cleaning of gauge and rainfall series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from freshet.functions.clock import HOUR_MICROS, as_col, from_micros, hours_between, micros
from freshet.functions.quantiles import exact_percentiles
from freshet.functions.series import first_per_time, salted_lookup, step_hours, with_previous
from freshet.session import materialize

# Cleaning limits and quality flags.
MAX_JUMP_M_PER_HOUR = 3.0
MAX_GAP_HOURS = 6.0
GAP_TOLERANCE = 1.5
GOOD, INTERPOLATED, GAP, JUMP_REMOVED = "good", "interpolated", "gap", "jump_removed"

STATION = ("station_id",)


def validate_gauge(
    df: DataFrame,
    keys: Sequence[str] = STATION,
    time: str = "timestamp",
    level: str = "water_level",
    arrival: str = "seq",
) -> DataFrame:
    """One report row per station: counts of each problem, the messages and an `is_valid` flag."""
    missing = [c for c in (time, level) if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    if not dict(df.dtypes)[time].startswith("timestamp"):
        raise ValueError(f"'{time}' column must be a timestamp")
    ordered = with_previous(df.select(*keys, arrival, time, level), keys, arrival, [time])
    report = ordered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(level) < 0).alias("negatives"),
        (F.count(F.lit(1)) - F.count_distinct(time)).alias("duplicates"),
        F.count_if(F.col(time) < F.col("_prev").getField(time)).alias("backward_steps"),
    )
    messages = F.array(
        F.when(
            F.col("negatives") > 0,
            F.format_string("Found %d negative water level values", "negatives"),
        ),
        F.when(F.col("backward_steps") > 0, F.lit("Timestamps are not monotonically increasing")),
        F.when(
            F.col("duplicates") > 0, F.format_string("Found %d duplicate timestamps", "duplicates")
        ),
    )
    return report.withColumn("errors", F.filter(messages, lambda m: m.isNotNull())).withColumn(
        "is_valid", F.size("errors") == 0
    )


def iqr_anomalies(df: DataFrame, column: str, keys: Sequence[str] = STATION, threshold: float = 3.0) -> DataFrame:
    quartiles = exact_percentiles(df, keys, column, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    bounds = quartiles.select(
        *keys,
        "q1",
        "q3",
        (F.col("q1") - threshold * spread).alias("lower_bound"),
        (F.col("q3") + threshold * spread).alias("upper_bound"),
    )
    value = F.col(column)
    flag = (value < F.col("lower_bound")) | (value > F.col("upper_bound"))
    return salted_lookup(df, bounds, keys, [column]).withColumn("is_anomaly", F.coalesce(flag, F.lit(False)))


def zscore_anomalies(df: DataFrame, column: str, keys: Sequence[str] = STATION, threshold: float = 3.0) -> DataFrame:
    stats = df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    score = F.abs(F.try_divide(F.col(column) - F.col("mean"), F.col("std")))
    return (
        salted_lookup(df, stats, keys, [column])
        .withColumn("z", score)
        .withColumn("is_anomaly", F.coalesce(F.col("z") > threshold, F.lit(False)))
    )


def detect_anomalies(
    df: DataFrame, column: str, keys: Sequence[str] = STATION, method: str = "iqr", threshold: float = 3.0
) -> DataFrame:
    if method == "iqr":
        return iqr_anomalies(df, column, keys, threshold)
    if method == "zscore":
        return zscore_anomalies(df, column, keys, threshold)
    raise ValueError(f"Unknown method: {method}. Use 'iqr' or 'zscore'")


def jump_flags(
    df: DataFrame,
    keys: Sequence[str] = STATION,
    time: str = "timestamp",
    level: str = "water_level",
    max_jump: float = MAX_JUMP_M_PER_HOUR,
) -> DataFrame:
    """Flag rows that moved faster than `max_jump` m/h since the previous raw row."""
    linked = with_previous(df, keys, time, [level])
    rate = F.try_divide(
        F.abs(F.col(level) - F.col("_prev").getField(level)),
        hours_between(F.col("_prev").getField(time), time),
    )
    return linked.withColumn("is_jump", F.coalesce(rate > max_jump, F.lit(False))).drop("_prev")


def drop_jumps(df: DataFrame, keys: Sequence[str] = STATION, time: str = "timestamp",
               level: str = "water_level", max_jump: float = MAX_JUMP_M_PER_HOUR) -> DataFrame:
    return jump_flags(df, keys, time, level, max_jump).where(~F.col("is_jump")).drop("is_jump")


def _with_filled(linked: DataFrame, columns: list[str], current: dict[str, Column], inserted, count: Column) -> DataFrame:
    """Explode each row into itself plus `count` inserted rows built by `inserted(i)`."""
    types = {f.name: f.dataType for f in linked.schema.fields}

    def packed(values: dict[str, Column]) -> Column:
        return F.struct(
            *[values[c].cast(types[c]).alias(c) for c in columns],
            values["quality_flag"].alias("quality_flag"),
        )

    own = F.array(packed(current))
    extra = F.transform(F.sequence(F.lit(1), count), lambda i: packed(inserted(i)))
    rows = F.when(count >= 1, F.concat(own, extra)).otherwise(own)
    return linked.select(F.explode(rows).alias("_row")).select("_row.*")


def fill_even(
    df: DataFrame,
    keys: Sequence[str] = STATION,
    time: str = "timestamp",
    level: str = "water_level",
    max_gap: float = MAX_GAP_HOURS,
) -> DataFrame:
    """Fill short gaps with evenly spaced points on the series' own step; flag rows after long gaps."""
    columns = df.columns
    rest = [c for c in columns if c not in (*keys, time)]
    linked = with_previous(df, keys, time, rest)
    stepped = salted_lookup(linked, step_hours(df, keys, time), keys, [time])
    prev = {c: F.col("_prev").getField(c) for c in (*rest, time)}
    gap = hours_between(prev[time], time)
    is_gap = F.coalesce(gap > GAP_TOLERANCE * F.col("step_hours"), F.lit(False))
    points = F.coalesce(F.try_divide(gap, F.col("step_hours")).cast("int") - 1, F.lit(0))
    count = F.when(is_gap & (gap <= max_gap), points).otherwise(F.lit(0))
    span = micros(time) - micros(prev[time])

    def inserted(i: Column) -> dict[str, Column]:
        values = {c: F.col(c) for c in keys} | {c: prev[c] for c in rest}
        weight = i / (count + 1)
        values[time] = from_micros(micros(prev[time]) + (span * weight).cast("bigint"))
        values[level] = prev[level] + (F.col(level) - prev[level]) * weight
        values["quality_flag"] = F.lit(INTERPOLATED)
        return values

    flag = F.when(is_gap & (gap > max_gap), F.lit(GAP)).otherwise(F.lit(GOOD))
    current = {c: F.col(c) for c in columns} | {"quality_flag": flag}
    return _with_filled(stepped, columns, current, inserted, count)


def fill_hourly(
    df: DataFrame,
    keys: Sequence[str] = ("catchment_id",),
    time: str = "timestamp",
    max_gap: float = MAX_GAP_HOURS,
) -> DataFrame:
    """Insert hourly rows into gaps of more than 1.5 h and at most `max_gap` h, linear per numeric column."""
    columns = df.columns
    rest = [c for c in columns if c not in (*keys, time)]
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    linked = with_previous(df, keys, time, rest)
    prev = {c: F.col("_prev").getField(c) for c in (*rest, time)}
    gap = hours_between(prev[time], time)
    fillable = F.coalesce((gap > GAP_TOLERANCE) & (gap <= max_gap), F.lit(False))
    count = F.when(fillable, F.greatest(F.floor(gap).cast("int") - 1, F.lit(0))).otherwise(F.lit(0))

    def inserted(i: Column) -> dict[str, Column]:
        values = {c: F.col(c) for c in keys}
        weight = i / gap
        for c in rest:
            values[c] = prev[c] + weight * (F.col(c) - prev[c]) if c in numeric else prev[c]
        values[time] = from_micros(micros(prev[time]) + i * F.lit(HOUR_MICROS))
        values["quality_flag"] = F.lit(INTERPOLATED)
        return values

    flag = F.when(F.coalesce(gap > max_gap, F.lit(False)), F.lit(GAP)).otherwise(F.lit(GOOD))
    current = {c: F.col(c) for c in columns} | {"quality_flag": flag}
    return _with_filled(linked, columns, current, inserted, count)


def gap_flags(df: DataFrame, keys: Sequence[str] = ("catchment_id",), time: str = "timestamp",
              max_gap: float = MAX_GAP_HOURS) -> DataFrame:
    """`is_gap` (> 1.5 h since the previous row) and the quality flag of each existing row."""
    linked = with_previous(df, keys, time, [])
    gap = hours_between(F.col("_prev").getField(time), time)
    return (
        linked.withColumn("gap_hours", gap)
        .withColumn("is_gap", F.coalesce(gap > GAP_TOLERANCE, F.lit(False)))
        .withColumn("quality_flag", F.when(F.coalesce(gap > max_gap, F.lit(False)), GAP).otherwise(GOOD))
        .drop("_prev")
    )


def sanitize_rain(df: DataFrame, keys: Sequence[str] = ("catchment_id",), time: str = "timestamp",
                  max_gap: float = MAX_GAP_HOURS, arrival: str | None = None) -> DataFrame:
    deduped = first_per_time(df, keys, time, arrival) if arrival else df
    return fill_hourly(deduped, keys, time, max_gap)


def clean_levels(
    df: DataFrame,
    keys: Sequence[str] = STATION,
    time: str = "timestamp",
    level: str = "water_level",
    arrival: str | None = "seq",
    max_jump: float = MAX_JUMP_M_PER_HOUR,
    max_gap: float = MAX_GAP_HOURS,
    repair: bool = False,
) -> DataFrame:
    """Full gauge cleaning. Stations failing validation yield no rows unless `repair` is set.

    `arrival=None` states that the input already holds one row per (station, time).
    """
    if arrival is None:
        usable = df
    elif repair:
        usable = first_per_time(df, keys, time, arrival)
    else:
        accepted = validate_gauge(df, keys, time, level, arrival).where("is_valid").select(*keys)
        usable = salted_lookup(df, accepted, keys, [arrival], "inner").select(*df.columns)
    kept = materialize(drop_jumps(usable, keys, time, level, max_jump))
    return fill_even(kept, keys, time, level, max_gap)


def keep_quality(df: DataFrame, flags: Sequence[str] = (GOOD, INTERPOLATED)) -> DataFrame:
    return df.where(F.col("quality_flag").isin(*flags))


def quality_summary(df: DataFrame, keys: Sequence[str] = STATION) -> DataFrame:
    counts = [F.count_if(F.col("quality_flag") == f).alias(f) for f in (GOOD, INTERPOLATED, GAP)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *counts)
