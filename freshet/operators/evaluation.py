"""Class balance, confusion metrics, ranking metrics and threshold choice on scored rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from freshet.functions.ordering import running_totals
from freshet.functions.quantiles import exact_percentiles

# The swept thresholds (17 of them, last bits included) and the recall weight.
THRESHOLDS = np.arange(0.1, 0.95, 0.05).tolist()
RECALL_BETA = 2.0


def ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b2 = beta * beta
    return ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)


def class_balance(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    return df.groupBy(split).agg(
        F.sum(label).cast("bigint").alias("positive"),
        (F.count(label) - F.sum(label)).cast("bigint").alias("negative"),
        F.round(ratio(F.sum(label), F.count(label)), 3).alias("ratio"),
    )


def scale_pos_weight(df: DataFrame, label: str = "label") -> DataFrame:
    positive, negative = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(F.coalesce(F.try_divide(negative.cast("double"), positive), F.lit(1.0)).alias("scale_pos_weight"))


def confusion_metrics(df: DataFrame, threshold: float = 0.5, score: str = "probability", label: str = "label") -> DataFrame:
    hit, truth = F.col(score) >= threshold, F.col(label) == 1
    counts = df.agg(
        F.count_if(~hit & ~truth).alias("true_negatives"),
        F.count_if(hit & ~truth).alias("false_positives"),
        F.count_if(~hit & truth).alias("false_negatives"),
        F.count_if(hit & truth).alias("true_positives"),
    )
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1_score": f_beta(tp, fp, fn, 1.0),
            "f2_score": f_beta(tp, fp, fn, RECALL_BETA),
            "threshold": F.lit(float(threshold)),
        }
    )


def ranking_metrics(df: DataFrame, score: str = "probability", label: str = "label") -> DataFrame:
    """ROC AUC (ties count half) and average precision, exact, from counts per distinct score."""
    per_score = df.groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    c = running_totals(per_score, [F.desc(score)], {"_pos": "_tp", "_neg": "_fp"})
    above = F.col("_tp") - F.col("_pos")
    precision = F.col("_tp") / (F.col("_tp") + F.col("_fp"))
    positives, negatives = F.max("_tp_total"), F.max("_fp_total")
    return c.agg(
        F.try_divide(F.sum(F.col("_neg") * (above + F.col("_pos") / 2.0)), positives * negatives).alias("roc_auc"),
        F.try_divide(F.sum(F.col("_pos") * precision), positives).alias("pr_auc"),
    )


def threshold_scores(df: DataFrame, score: str = "probability", label: str = "label") -> DataFrame:
    """f1, f2 and recall at each of the 17 thresholds.

    Rows are counted once by how many thresholds they reach; the 18 counts are then accumulated
    from the top, so no row is repeated per threshold.
    """
    cuts = F.array(*[F.lit(x) for x in THRESHOLDS])
    reached = F.size(F.filter(cuts, lambda x: x <= F.col(score)))
    counts = df.groupBy(reached.alias("_k")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    # a fixed ladder of 0..17 steps keeps thresholds that no row stops at
    ladder = counts.sparkSession.range(len(THRESHOLDS) + 1).select(F.col("id").cast("int").alias("_k"))
    full = ladder.join(counts, "_k", "left").fillna(0, ["_pos", "_neg"])
    from_top = W.orderBy(F.desc("_k")).rowsBetween(W.unboundedPreceding, 0)
    summed = full.select(
        "_k",
        F.sum("_pos").over(from_top).alias("_tp"),
        F.sum("_neg").over(from_top).alias("_fp"),
        F.sum("_pos").over(W.partitionBy()).alias("_p"),
    ).where(F.col("_k") > 0)
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_p") - F.col("_tp")
    return summed.select(
        F.element_at(cuts, F.col("_k")).alias("threshold"),
        f_beta(tp, fp, fn, 1.0).alias("f1"),
        f_beta(tp, fp, fn, RECALL_BETA).alias("f2"),
        ratio(tp, tp + fn).alias("recall"),
    )


def optimal_threshold(df: DataFrame, metric: str = "f2", score: str = "probability", label: str = "label") -> DataFrame:
    """The lowest threshold with the highest score."""
    if metric not in ("f1", "f2", "recall"):
        raise ValueError(f"Unknown metric: {metric}")
    scores = threshold_scores(df, score, label)
    return scores.select(F.col("threshold").alias("optimal_threshold"), F.col(metric).alias("best_score")).orderBy(
        F.desc("best_score"), "optimal_threshold"
    ).limit(1)


def lead_time_stats(df: DataFrame, predicted: str = "prediction", strict: bool = False) -> DataFrame:
    """Lead-time statistics of early warnings: predicted 1 while the label is still 0.

    `strict` instead asks for predicted 1 on label-1 rows; those never carry a lead time, so the
    statistics are then null.
    """
    wanted = F.col("label") == (1 if strict else 0)
    rows = df.where((F.col(predicted) == 1) & wanted & F.col("lead_time_hours").isNotNull())
    plain = rows.agg(
        F.avg("lead_time_hours").alias("mean_lead_time_hours"),
        F.min("lead_time_hours").alias("min_lead_time_hours"),
        F.max("lead_time_hours").alias("max_lead_time_hours"),
    )
    middle = exact_percentiles(rows, [], "lead_time_hours", {"median_lead_time_hours": 0.5})
    return _one_row(plain, middle)


def _one_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put two one-row tables side by side; the second is a scalar subquery, not a join."""
    row = right.select(F.struct(*right.columns).alias("_row")).scalar()
    return left.withColumn("_row", row).select(*left.columns, "_row.*")


def evaluate(df: DataFrame, threshold: float = 0.5, score: str = "probability", label: str = "label") -> DataFrame:
    """One row with confusion and ranking metrics."""
    return _one_row(confusion_metrics(df, threshold, score, label), ranking_metrics(df, score, label))
