"""Ordered per-series computations that never put a whole series into one task.

A gauge network may have five stations holding a century of readings, or one station holding a
third of all rows, so `Window.partitionBy(station)` is not a usable unit of work. Every helper
here works on *slices* (series key + fixed span of time): a window inside the slice, one small
summary row per slice, a window over those summaries (their number is the observed time span
divided by the slice length), and a join of the carried value back on (key, slice). The row-level
window and the join share one hash partitioning, so the rows are shuffled once.

Inputs are expected to hold one row per (key, time); see `first_per_time`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from freshet.functions.clock import micros

SLICE = "_slice"
ORDINAL = "_ordinal"
BLOCK = "_block"
HOME = "_home_block"
SLICE_SECONDS = 30 * 24 * 3600
SLICE_ARRIVALS = 1_000_000
BLOCK_ROWS = 8192
LOOKUP_SALTS = 32


def add_slice(df: DataFrame, time: str, seconds: int = SLICE_SECONDS) -> DataFrame:
    """Slice number of the ordering column: a time span, or a run of an arrival counter."""
    if dict(df.dtypes)[time] in ("int", "bigint"):
        return df.withColumn(SLICE, F.floor(F.col(time) / F.lit(SLICE_ARRIVALS)))
    return df.withColumn(SLICE, F.floor(micros(time) / F.lit(seconds * 1_000_000)))


def first_per_time(df: DataFrame, keys: Sequence[str], time: str, arrival: str) -> DataFrame:
    """Keep the earliest-arrived row of every (key, time); combines map-side, so copies are cheap."""
    rest = [c for c in df.columns if c not in (*keys, time)]
    picked = df.groupBy(*keys, time).agg(F.min_by(F.struct(*rest), arrival).alias("_row"))
    return picked.select(*keys, time, "_row.*").select(*df.columns)


def salted_lookup(
    df: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    salts: int = LOOKUP_SALTS,
) -> DataFrame:
    """Join a one-row-per-key table onto rows whose key may be very hot.

    Rows of a hot key are spread by a hash of `spread`; the lookup side is repeated per salt. If
    the lookup side turns out small, AQE broadcasts it and the salt costs nothing.
    """
    big = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    side = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.join(side, [*keys, "_salt"], how).drop("_salt")


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    columns: Sequence[str],
    name: str = "_prev",
    keep: Column | None = None,
) -> DataFrame:
    """Add struct `name` = (time, *columns) of the nearest earlier row, among rows where `keep`."""
    out_columns = [*df.columns, name]
    sliced = add_slice(df, time)
    packed = F.struct(time, *columns)
    if keep is None:
        local = F.lag(packed).over(W.partitionBy(*keys, SLICE).orderBy(time))
        tail = F.max_by(packed, time)
    else:
        kept = F.coalesce(keep, F.lit(False))
        before = W.partitionBy(*keys, SLICE).orderBy(time).rowsBetween(W.unboundedPreceding, -1)
        local = F.last(F.when(kept, packed), ignorenulls=True).over(before)
        tail = F.max_by(packed, F.when(kept, F.col(time)))
    earlier = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carried = (
        sliced.groupBy(*keys, SLICE)
        .agg(tail.alias("_tail"))
        .select(*keys, SLICE, F.last("_tail", ignorenulls=True).over(earlier).alias("_carry"))
    )
    return (
        sliced.withColumn(name, local)
        .join(carried, [*keys, SLICE], "left")
        .withColumn(name, F.coalesce(F.col(name), F.col("_carry")))
        .select(*out_columns)
    )


def latest_at(
    df: DataFrame, rows: DataFrame, keys: Sequence[str], at: str, time: str, name: str = "_latest",
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Add struct `name`: the latest row of `rows` (all columns but `keys`) in the same series at or before `at`.

    Each row of `df` brings its own time. Both tables are merged in time order inside (series, slice),
    where the last row seen is carried on; one summary row a slice carries it across slices, so a gap
    of any length costs nothing and a hot series is spread over its slices. `rows` holds one row per
    series and time. A null key or time finds nothing and is found by nothing; every row of `df` stays.
    """
    rest = [c for c in rows.columns if c not in keys]
    known = rows.where(F.col(time).isNotNull()).dropna(subset=list(keys))
    found = known.select(*keys, micros(time).alias("_when"), F.lit(0).alias("_side"), F.struct(*rest).alias(name))
    asked = df.select(*keys, micros(at).alias("_when"), F.lit(1).alias("_side"), F.struct(*df.columns).alias("_own"))
    merged = found.unionByName(asked, allowMissingColumns=True).withColumn(
        SLICE, F.floor(F.col("_when") / F.lit(slice_seconds * 1_000_000))
    )
    upto = W.partitionBy(*keys, SLICE).orderBy("_when", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carried = (
        merged.groupBy(*keys, SLICE)
        .agg(F.max_by(name, F.when(F.col("_side") == 0, F.col("_when"))).alias("_tail"))
        .select(*keys, SLICE, F.last("_tail", ignorenulls=True).over(earlier).alias("_carry"))
    )
    return (
        merged.withColumn(name, F.last(name, ignorenulls=True).over(upto))
        .where(F.col("_side") == 1)
        .join(carried, [*keys, SLICE], "left")
        .select("_own.*", F.coalesce(F.col(name), F.col("_carry")).alias(name))
    )


def with_ordinal(
    df: DataFrame, keys: Sequence[str], time: str, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Number the rows of every series 0..n-1 in time order."""
    sliced = add_slice(df, time, slice_seconds)
    earlier = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, SLICE)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, SLICE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    local = F.row_number().over(W.partitionBy(*keys, SLICE).orderBy(time)) - 1
    return (
        sliced.withColumn("_local", local)
        .join(offsets, [*keys, SLICE], "inner")
        .withColumn(ORDINAL, F.col("_local") + F.col("_offset"))
        .select(*df.columns, ORDINAL)
    )


def in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    reach: Column | int,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Lay each series out in blocks of rows, repeating the last `reach` rows into the next block.

    Any frame of at most `reach` preceding rows is then exact inside (key, block); rows with
    `_home_block` false are the repeated ones and are dropped by `home_rows`.
    """
    reach = reach if isinstance(reach, Column) else F.lit(reach)
    size = F.greatest(reach, F.lit(BLOCK_ROWS)).cast("bigint")
    own = F.floor(F.col(ORDINAL) / size)
    spill = F.col(ORDINAL) - own * size >= size - reach
    return (
        with_ordinal(df, keys, time, slice_seconds)
        .withColumn(BLOCK, F.explode(F.when(spill, F.array(own, own + 1)).otherwise(F.array(own))))
        .withColumn(HOME, own == F.col(BLOCK))
    )


def block_window(keys: Sequence[str]):
    return W.partitionBy(*keys, BLOCK).orderBy(ORDINAL)


def home_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(HOME)).drop(BLOCK, HOME, ORDINAL)


def step_hours(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Median hours between consecutive rows, one row per series with at least two rows.

    The rank is bracketed by a sketch first, so the work stays bounded per task however many
    different steps a series has.
    """
    from freshet.functions.quantiles import exact_percentiles  # which builds on this module

    linked = with_previous(df.select(*keys, time), keys, time, [])
    gap = micros(time) - micros(F.col("_prev").getField(time))
    gaps = linked.where(F.col("_prev").isNotNull()).select(*keys, gap.alias("_gap"))
    middle = exact_percentiles(gaps, keys, "_gap", {"_median": 0.5})
    return middle.select(*keys, (F.col("_median") / F.lit(3.6e9)).alias("step_hours"))
