"""Global row numbers and running totals without a one-partition window over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from freshet.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index of a partition in its low 33 bits


def _ranged(df: DataFrame, order: Sequence) -> DataFrame:
    """Range-partition and sort, number inside partitions, and pin the layout by writing it."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(spread.withColumn("_mid", F.monotonically_increasing_id())).withColumn(
        "_part", F.shiftright("_mid", _LOCAL_BITS)
    )


def _before(parts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Totals of all earlier partitions; `parts` has one row per shuffle partition."""
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return parts.select(
        "_part",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in columns],
        *[F.sum(c).over(W.partitionBy()).alias(f"_total_{c}") for c in columns],
    )


def global_ordinal(
    df: DataFrame, order: Sequence, name: str = "ordinal", total: str | None = None
) -> DataFrame:
    """Number all rows 0..n-1 in `order`, which should end in a unique column; `total` adds n."""
    ranged = _ranged(df, order)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # broadcast bound: one row per shuffle partition of the range exchange
    offsets = F.broadcast(_before(sizes, ["_n"]))
    local = F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1)
    return (
        ranged.join(offsets, "_part")
        .withColumn(name, F.col("_before__n") + local)
        .withColumn(total or "_unused", F.col("_total__n"))
        .drop("_mid", "_part", "_before__n", "_total__n", "_unused")
    )


def running_totals(df: DataFrame, order: Sequence, columns: dict[str, str]) -> DataFrame:
    """Inclusive running sums over the whole table, and the grand totals as `<name>_total`.

    `columns` maps source column -> output name.
    """
    ranged = _ranged(df, order)
    sums = ranged.groupBy("_part").agg(*[F.sum(c).alias(c) for c in columns])
    # broadcast bound: one row per shuffle partition of the range exchange
    offsets = F.broadcast(_before(sums, list(columns)))
    upto = W.partitionBy("_part").orderBy("_mid").rowsBetween(W.unboundedPreceding, 0)
    return (
        ranged.join(offsets, "_part")
        .withColumns({out: F.sum(c).over(upto) + F.col(f"_before_{c}") for c, out in columns.items()})
        .withColumns({f"{out}_total": F.col(f"_total_{c}") for c, out in columns.items()})
        .drop("_mid", "_part", *[f"_{part}_{c}" for c in columns for part in ("before", "total")])
    )
