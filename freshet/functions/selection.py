"""Exact-size pseudo-random selection by a seeded hash, without sorting everything in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKET_HEX = 4  # 65 536 hash buckets


def seeded_hash(columns: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def first_by_hash(
    df: DataFrame, quotas: DataFrame | Column, group: str, unique: Sequence[str], seed: int = 42
) -> DataFrame:
    """The first `quota` rows of every group in order of a seeded hash of the `unique` columns.

    Hash buckets are even whatever the data, so a bucket is a bounded share of a group. Buckets
    wholly under the quota are taken as they are; only the one bucket that straddles it is ranked.
    `quotas` has one row (group, quota) per group, or is one quota for all, such as a scalar subquery.
    """
    hashed = df.withColumn("_hash", seeded_hash(unique, seed)).withColumn(
        "_bucket", F.substring("_hash", 1, BUCKET_HEX)
    )
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = (
        hashed.groupBy(group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    limited = sizes.withColumn("quota", quotas) if isinstance(quotas, Column) else sizes.join(quotas, group)
    taken = (
        limited.where(F.col("_before") < F.col("quota"))
        .select(
            group,
            "_bucket",
            F.when(F.col("_before") + F.col("_n") > F.col("quota"), F.col("quota") - F.col("_before")).alias("_room"),
        )
    )
    kept = hashed.join(taken, [group, "_bucket"])
    order = W.partitionBy(group, "_bucket").orderBy("_hash", *unique)
    straddling = (
        kept.where(F.col("_room").isNotNull())
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= F.col("_room"))
    )
    return kept.where(F.col("_room").isNull()).select(*df.columns).unionByName(straddling.select(*df.columns))
