"""Train/test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from freshet.functions.ordering import global_ordinal, running_totals
from freshet.functions.selection import first_by_hash

# Test share and seed.
TEST_SIZE = 0.2
SEED = 42


def time_split(
    df: DataFrame, test_size: float = TEST_SIZE, mode: str = "time", order: Sequence[str] = ("station_id", "timestamp"),
    time: str = "timestamp",
) -> DataFrame:
    """Add `split`: "time" cuts at the timestamp of the (1 - test_size) row; "positional" cuts the
    rows sorted by `order` at that position, whatever their time."""
    if mode == "positional":
        placed = global_ordinal(df, list(order), "_at", total="_total")
        cut = F.floor(F.col("_total") * (1 - test_size))
        return placed.withColumn("split", F.when(F.col("_at") < cut, "train").otherwise("test")).drop("_at", "_total")
    if mode != "time":
        raise ValueError(f"Unknown split mode: {mode}")
    counts = df.groupBy(time).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(counts, [time], {"_n": "_upto"})
    # the first time whose rows reach past the cut position starts the test part
    cut = placed.where(F.col("_upto") > F.floor(F.col("_upto_total") * (1 - test_size))).agg(F.min(time))
    return df.withColumn("split", F.when(F.col(time) < cut.scalar(), "train").otherwise("test"))


def stratified_split(
    df: DataFrame, unique: Sequence[str], test_size: float = TEST_SIZE, label: str = "label", seed: int = SEED
) -> DataFrame:
    """Add `split`: the rounded `test_size` share of each label, picked by seeded hash, is test."""
    quotas = df.groupBy(label).agg(F.round(F.count(F.lit(1)) * test_size).cast("bigint").alias("quota"))
    picked = first_by_hash(df.select(label, *unique), quotas, label, unique, seed).select(
        *unique, F.lit("test").alias("split")
    )
    return df.join(picked, list(unique), "left").withColumn("split", F.coalesce("split", F.lit("train")))
