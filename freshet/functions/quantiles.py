"""Exact percentiles per group without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from freshet.functions.series import salted_lookup


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], accuracy: int = 10_000
) -> DataFrame:
    """Linear-interpolated percentiles of `value` per key, one output column per probability.

    A mergeable sketch brackets each wanted rank (it is guaranteed within n/accuracy ranks), then
    only values inside the bracket are counted and ranked. Groups no larger than `accuracy` use
    their full range as bracket; the result is exact on both sides of that size. The ranked remainder is about 8 n/accuracy rows per group.
    """
    margin = 3.0 / accuracy
    names = list(probabilities)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    bounds = [max(0.0, probabilities[n] - margin) for n in names] + [
        min(1.0, probabilities[n] + margin) for n in names
    ]
    sketch = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", bounds, accuracy).alias("_q"),
    )
    small = F.col("_n") <= accuracy
    brackets = sketch.select(
        *keys,
        "_n",
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("name"),
                    (F.lit(probabilities[n]) * (F.col("_n") - 1)).alias("rank"),
                    F.when(small, F.col("_min")).otherwise(F.col("_q")[i]).alias("low"),
                    F.when(small, F.col("_max")).otherwise(F.col("_q")[len(names) + i]).alias("high"),
                )
                for i, n in enumerate(names)
            ]
        ).alias("_brackets"),
    )
    placed = (
        salted_lookup(rows, brackets, keys, ["_v"], "inner")
        .select(*keys, "_v", F.explode("_brackets").alias("_b"))
        .where(F.col("_v") <= F.col("_b.high"))
        .withColumn("_below", F.col("_v") < F.col("_b.low"))
    )
    # values under the bracket collapse to one counted row per group, the rest to distinct values
    counted = placed.groupBy(
        *keys,
        F.col("_b.name").alias("_name"),
        F.col("_b.rank").alias("_rank"),
        F.when(F.col("_below"), F.lit(None)).otherwise(F.col("_v")).alias("_value"),
    ).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(
        W.partitionBy(*keys, "_name").orderBy(F.col("_value").asc_nulls_first())
    )
    ranked = counted.withColumn("_last", upto - 1).withColumn("_first", F.col("_last") - F.col("_c") + 1)

    def holds(rank):
        return (F.col("_first") <= rank) & (rank <= F.col("_last"))

    picked = ranked.groupBy(*keys, "_name", "_rank").agg(
        F.max(F.when(holds(F.floor("_rank")), F.col("_value"))).alias("_lo"),
        F.max(F.when(holds(F.ceil("_rank")), F.col("_value"))).alias("_hi"),
    )
    result = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_rank") - F.floor("_rank"))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, result)).alias(n) for n in names]
    )
