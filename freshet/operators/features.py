"""Lag, rolling and interaction features on station and grid-cell series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from freshet.functions.series import (
    BLOCK,
    BLOCK_ROWS,
    ORDINAL,
    SLICE_SECONDS,
    block_window,
    home_rows,
    in_blocks,
    salted_lookup,
    step_hours,
)
from freshet.session import materialize

# Default lags and windows in days, and the non-feature columns of both data sets.
LAG_DAYS = (1, 2, 3, 5, 7)
ROLLING_DAYS = (3, 5, 7)
ARI_DAYS = (3, 7, 14, 30)
FLOOD_META = {
    "timestamp", "station_id", "label", "event_id", "lead_time_hours", "event_duration_hours",
    "peak_level", "quality_flag", "river", "location", "water_level", "warning_level", "danger_level",
}
LANDSLIDE_META = {"date", "grid_id", "label", "num_events", "center_lon", "center_lat", "geometry"}
TERRAIN_COLUMNS = ("catchment_area", "mean_hand", "mean_slope")
SLOPE_COLUMNS = ("slope", "aspect", "curvature", "elevation")

AGGREGATES = {"sum": F.sum, "mean": F.avg, "max": F.max}
_SCALE = 1_000_000_000


def _scaled_position(n: Column) -> Column:
    """Integer position whose range frames mean "n rows back" although n differs per series.

    floor(ordinal·M / n) moves by exactly M over n rows and by at most M − 1 over fewer.
    """
    x = (F.col(ORDINAL) - F.col("_base")) * F.lit(_SCALE)
    return ((x - F.pmod(x, n)) / n).cast("bigint")


def windowed_features(
    df: DataFrame,
    lags: dict[str, Sequence[int]],
    rolls: dict[str, tuple[Sequence[int], Sequence[str]]],
    keys: Sequence[str] = ("station_id",),
    time: str = "timestamp",
    step: float | None = None,
    roll_name: str = "{column}_{days}d_{agg}",
) -> DataFrame:
    """All lag and rolling columns in one layout of the series.

    Days become row counts through the series' step: `step` hours when the caller knows it, else
    each series' own median step. Frames count rows, as irregular series shift by rows, not time.
    Series with a whole number of rows a day take one sort for all columns, the others one per count.
    """
    days = [d for ds in lags.values() for d in ds] + [d for ds, _ in rolls.values() for d in ds]
    if not days:
        return df
    if step is not None:
        counts = {d: int(d * 24 / step) for d in days}
        # slices long enough to hold a block of rows at this step
        slice_seconds = max(SLICE_SECONDS, int(step * 3600) * BLOCK_ROWS)
        blocks = in_blocks(df, keys, time, max(max(counts.values()), 1), slice_seconds)
        w = block_window(keys)
        new = {
            f"{c}_lag_{d}": F.lag(c, counts[d]).over(w) if counts[d] else F.col(c)
            for c, ds in lags.items()
            for d in ds
        }
        for c, (ds, aggs) in rolls.items():
            for d in ds:
                frame = w.rowsBetween(-(max(counts[d], 1) - 1), 0)
                for a in aggs:
                    new[roll_name.format(column=c, days=d, agg=a)] = AGGREGATES[a](c).over(frame)
        return home_rows(blocks.withColumns(new))

    stepped = salted_lookup(df, step_hours(df, keys, time), keys, [time]).withColumn(
        "_step", F.coalesce("step_hours", F.lit(1.0))
    )
    counts = {d: F.floor(F.lit(d * 24.0) / F.col("_step")).cast("bigint") for d in set(days)}
    daily = F.floor(F.lit(24.0) / F.col("_step")).cast("bigint")
    named = stepped.withColumns(
        # a whole number of rows a day makes every count a multiple of it
        {"_a_day": daily, "_whole": (daily >= 1) & (daily * F.col("_step") == 24.0), **{f"_n_{d}": n for d, n in counts.items()}}
    )
    reach = F.greatest(F.col(f"_n_{max(days)}"), F.lit(1)).cast("bigint")
    blocks = materialize(
        in_blocks(named, keys, time, reach).withColumn("_base", F.col(BLOCK) * F.greatest(reach, F.lit(BLOCK_ROWS)))
    )

    def widened(rows: DataFrame, at, per_day) -> DataFrame:
        """All columns, where `at(d)` orders the rows and moves by `per_day(d)` over the rows of d days."""
        new = {}
        for c, ds in lags.items():
            for d in ds:
                back = W.partitionBy(*keys, BLOCK).orderBy(at(d)).rangeBetween(-per_day(d), -per_day(d))
                new[f"{c}_lag_{d}"] = F.when(F.col(f"_n_{d}") == 0, F.col(c)).otherwise(F.max(c).over(back))
        for c, (ds, aggs) in rolls.items():
            for d in ds:
                frame = W.partitionBy(*keys, BLOCK).orderBy(at(d)).rangeBetween(-(per_day(d) - 1), 0)
                for a in aggs:
                    new[roll_name.format(column=c, days=d, agg=a)] = AGGREGATES[a](c).over(frame)
        return home_rows(rows.withColumns(new))

    whole = blocks.where("_whole").withColumn("_at", _scaled_position(F.col("_a_day")))
    other = blocks.where("not _whole").withColumns(
        {f"_at_{d}": _scaled_position(F.greatest(F.col(f"_n_{d}"), F.lit(1))) for d in counts}
    )
    helper = ["_base", "_step", "step_hours", "_a_day", "_whole", "_at", *[f"_n_{d}" for d in counts], *[f"_at_{d}" for d in counts]]
    parts = [
        widened(whole, lambda d: "_at", lambda d: d * _SCALE).drop(*helper),
        widened(other, lambda d: f"_at_{d}", lambda d: _SCALE).drop(*helper),
    ]
    return parts[0].unionByName(parts[1])


def lag_features(df, columns, days=LAG_DAYS, keys=("station_id",), time="timestamp", step=None) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return windowed_features(df, {c: days for c in present}, {}, keys, time, step)


def rolling_features(
    df, columns, days=ROLLING_DAYS, aggs=("sum", "mean", "max"), keys=("station_id",), time="timestamp", step=None
) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return windowed_features(df, {}, {c: (days, aggs) for c in present}, keys, time, step)


def antecedent_rainfall(df, rain="rainfall_mm", days=ARI_DAYS, keys=("grid_id",), time="date", step=24.0) -> DataFrame:
    return windowed_features(df, {}, {rain: (days, ("sum",))}, keys, time, step, "{column}_ari_{days}d")


def physics_interactions(df: DataFrame, rain: str = "rainfall_mm") -> DataFrame:
    have = set(df.columns)
    new = {}
    if {"slope", rain} <= have:
        new["slope_rainfall_interaction"] = F.col("slope") * F.col(rain)
    ari = [c for c in df.columns if "ari_14d" in c]
    if "slope" in have and ari:
        new["slope_ari14d_interaction"] = F.col("slope") * F.col(ari[0])
    if {"curvature", rain} <= have:
        new["curvature_rainfall_interaction"] = F.col("curvature") * F.col(rain)
    return df.withColumns(new) if new else df


def static_report(columns: Sequence[str], wanted: Sequence[str] = TERRAIN_COLUMNS) -> dict[str, list[str]]:
    return {
        "present": [c for c in wanted if c in columns],
        "missing": [c for c in wanted if c not in columns],
    }


def drop_incomplete(df: DataFrame, marks: Sequence[str] = ("_lag_",)) -> DataFrame:
    subset = [c for c in df.columns if any(m in c for m in marks)]
    return df.dropna(subset=subset) if subset else df


def feature_columns(df: DataFrame, meta=frozenset(FLOOD_META)) -> list[str]:
    return [c for c in df.columns if c not in meta]


def validate_features(df: DataFrame, expected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Require exactly the expected feature columns, then put them in model order."""
    actual = set(df.columns) - set(keep)
    missing, extra = sorted(set(expected) - actual), sorted(actual - set(expected))
    if missing or extra:
        raise ValueError(f"Feature mismatch: missing {missing}, extra {extra}")
    return df.select(*keep, *expected)


def flood_features(
    df: DataFrame, columns: Sequence[str] = ("rainfall_mm", "temperature_2m"), step: float | None = None
) -> DataFrame:
    """Lags of every column, rolling rainfall sums, complete rows only."""
    present = [c for c in columns if c in df.columns]
    rolls = {"rainfall_mm": (ROLLING_DAYS, ("sum",))} if "rainfall_mm" in present else {}
    return drop_incomplete(windowed_features(df, {c: LAG_DAYS for c in present}, rolls, step=step))


def landslide_features(df: DataFrame, rain: str = "rainfall_mm") -> DataFrame:
    """Antecedent rain, lags, rolling sums and terrain interactions per grid cell on daily rows."""
    keys, time, step = ("grid_id",), "date", 24.0
    lagged = [c for c in (rain, "temperature") if c in df.columns]
    wide = windowed_features(
        df, {c: (1, 3, 7) for c in lagged}, {rain: (ARI_DAYS, ("sum",))}, keys, time, step, "{column}_ari_{days}d"
    )
    # the 3- and 7-day sums are the same frames as the antecedent sums, kept under both names
    wide = wide.withColumns({f"{rain}_{d}d_sum": F.col(f"{rain}_ari_{d}d") for d in (3, 7)})
    return drop_incomplete(physics_interactions(wide, rain), ("_lag_", "_ari_"))
