"""Ranking of per-row feature contributions held as (row_id, feature, contribution[, value])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

TOP_DRIVERS = 5
TOP_FEATURES = 5


def ranked_contributions(df: DataFrame, row: str = "row_id") -> DataFrame:
    """Contributions of each row by size; a row has one entry per model feature, so groups are small."""
    order = W.partitionBy(row).orderBy(F.desc(F.abs("contribution")), "feature")
    return df.withColumn("rank", F.row_number().over(order))


def signed(impact: Column) -> Column:
    """+0.123 / -0.123, rounded half to even."""
    sign = F.when(impact >= 0, "+").otherwise("-")
    return F.concat(sign, F.format_string("%.3f", F.bround(F.abs(impact), 3)))


def driver_strings(df: DataFrame, k: int = TOP_DRIVERS, row: str = "row_id") -> DataFrame:
    top = ranked_contributions(df, row).where(F.col("rank") <= k)
    entry = F.struct("rank", "feature", signed(F.col("contribution")).alias("impact"))
    return top.groupBy(row).agg(F.sort_array(F.collect_list(entry)).alias("_d")).select(
        row, F.transform("_d", lambda d: F.struct(d["feature"].alias("feature"), d["impact"].alias("impact"))).alias("top_drivers")
    )


def top_drivers(df: DataFrame, k: int = TOP_DRIVERS, row: str = "row_id") -> DataFrame:
    """Wide form: top1_feature, top1_contribution, top1_value, …"""
    top = ranked_contributions(df, row).where(F.col("rank") <= k)
    fields = ["feature", "contribution"] + (["value"] if "value" in df.columns else [])
    wide = [F.max(F.when(F.col("rank") == i, F.col(f))).alias(f"top{i}_{f}") for i in range(1, k + 1) for f in fields]
    return top.groupBy(row).agg(*wide)


def top_features(importances: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    """(feature, importance) -> the k most important features."""
    return importances.orderBy(F.desc("importance"), "feature").limit(k)
