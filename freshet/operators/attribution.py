"""Exact contributions of features to a boosted model's margin, from the node tables of the saved booster."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from freshet.operators.explain import TOP_DRIVERS, driver_strings
from freshet.operators.models import MISSING, score
from freshet.session import checkpoint_root

CELLS = 4_000_000  # (row, leaf, feature) cells that are worked on at once


@dataclass(frozen=True)
class Leaves:
    """Leaves whose paths test the same number m of different features.

    A row meets the k-th test of a leaf if low < x <= high. `table[leaf, pattern, k]` is what the leaf
    gives the k-th feature when the tests met are the bits of `pattern`.
    """

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    table: np.ndarray


@dataclass(frozen=True)
class Booster:
    base: float
    groups: tuple[Leaves, ...]


def booster_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(tree, weight, id, left, right, feature, threshold, prediction, cover) of the boosted trees saved under `path`.

    `cover` is the weighted number of training rows that reached the node. The trees split numbers only.
    """
    stage = f"{path}/stages/*_GBTClassifier_*"
    weights = spark.read.parquet(f"{stage}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    n = F.col("nodeData")
    nodes = spark.read.parquet(f"{stage}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), n["split"]["numCategories"].alias("categories"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        n["prediction"].alias("prediction"), F.get(n["impurityStats"], F.lit(0)).alias("cover"),
    )
    return nodes.join(weights, "tree")


def booster(nodes: DataFrame) -> Booster:
    """The leaves of all trees, ready for scoring; a profile bounds the nodes, some thousands in all."""
    rows = nodes.collect()
    if any(r.left >= 0 and r.categories >= 0 for r in rows):
        raise ValueError("categorical splits have no thresholds")
    trees: dict[int, dict] = {}
    for r in rows:
        trees.setdefault(r.tree, {})[r.id] = r
    by_size: dict[int, list] = {}
    base = 0.0
    for tree in trees.values():
        waiting = [(tree[0], {})]
        while waiting:
            node, path = waiting.pop()
            if node.left < 0:
                value = node.weight * node.prediction
                base += value * math.prod(share for _, _, share in path.values())
                by_size.setdefault(len(path), []).append((path, value))
                continue
            low, high, share = path.get(node.feature, (-math.inf, math.inf, 1.0))
            for child, test in ((tree[node.left], (low, min(high, node.threshold))), (tree[node.right], (max(low, node.threshold), high))):
                part = child.cover / node.cover if node.cover else 0.0
                waiting.append((child, path | {node.feature: (*test, share * part)}))
    return Booster(base, tuple(_leaves(m, group) for m, group in sorted(by_size.items()) if m))


def _leaves(m: int, group: list) -> Leaves:
    features = np.array([list(path) for path, _ in group])
    low, high, share = (np.array([[t[k] for t in path.values()] for path, _ in group]) for k in range(3))
    value = np.array([v for _, v in group])
    met = np.arange(1 << m)[:, None] >> np.arange(m) & 1
    table = np.empty((len(group), 1 << m, m))
    for j in range(m):
        # coefficient s: all ways in which s of the other features are known and the rest are averaged over
        ways = np.ones((len(group), 1 << m, 1))
        for k in range(m):
            if k != j:
                longer = np.zeros((*ways.shape[:2], ways.shape[2] + 1))
                longer[:, :, :-1] += ways * share[:, None, k, None]
                longer[:, :, 1:] += ways * met[None, :, k, None]
                ways = longer
        chance = np.array([math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)])
        table[:, :, j] = value[:, None] * (met[None, :, j] - share[:, None, j]) * (ways @ chance)
    return Leaves(features, low, high, table)


def attribute(model: Booster, x: np.ndarray) -> np.ndarray:
    """Contribution of each column of `x` to each row's margin."""
    out = np.zeros(x.shape)
    for g in model.groups:
        leaves, m = g.features.shape
        spread = np.zeros((leaves * m, x.shape[1]))
        spread[np.arange(leaves * m), g.features.ravel()] = 1.0
        step = max(1, CELLS // (leaves * m))
        for start in range(0, len(x), step):
            values = x[start : start + step][:, g.features]
            met = ((values > g.low) | np.isneginf(g.low)) & (values <= g.high)
            pattern = (met * (1 << np.arange(m))).sum(axis=2)
            out[start : start + step] += g.table[np.arange(leaves), pattern].reshape(len(values), -1) @ spread
    return out


def attributions(model: Booster, df: DataFrame, features: Sequence[str], row: Sequence[str]) -> DataFrame:
    """Per row and feature: `contribution` to the margin, with `value`, `base_value` and the row's `margin`.

    These are the Shapley values of the trees' path-dependent expectation: a feature that is not known
    sends a row down both branches by the training rows that took them. A row's contributions and the
    base value add up to its margin, which is half the log-odds of the event. Missing values go in as
    the model saw them in training, and come out as null. An empty table gives no rows.
    """
    filled = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(MISSING)).alias(f"_x{k}") for k, f in enumerate(features)]
    frame = df.select(*row, *[F.col(f).cast("double").alias(f"_v{k}") for k, f in enumerate(features)], *filled)
    width = len(features)
    kept = [frame.schema[c] for c in row]
    schema = StructType([*kept, StructField("_value", ArrayType(DoubleType())), StructField("_shares", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"_x{k}").to_numpy(zero_copy_only=False) for k in range(width)])
            shares = attribute(model, x).ravel()
            ends = pa.array(np.arange(0, len(shares) + 1, width), pa.int32())
            values = np.column_stack([batch.column(f"_v{k}").to_numpy(zero_copy_only=False) for k in range(width)]).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in row],
                    pa.ListArray.from_arrays(ends, pa.array(values, from_pandas=True)), pa.ListArray.from_arrays(ends, pa.array(shares)),
                ],
                [*row, "_value", "_shares"],
            )

    wide = frame.mapInArrow(run, schema)
    margin = F.lit(model.base) + F.aggregate("_shares", F.lit(0.0), lambda s, x: s + x)
    names = F.array(*[F.lit(f) for f in features])
    cell = F.explode(F.arrays_zip(names.alias("feature"), F.col("_value").alias("value"), F.col("_shares").alias("contribution")))
    return wide.select(*row, F.lit(model.base).alias("base_value"), margin.alias("margin"), cell.alias("_c")).select(
        *row, F.col("_c.feature").alias("feature"), F.col("_c.value").alias("value"), F.col("_c.contribution").alias("contribution"),
        "base_value", "margin",
    )


def booster_of(model: PipelineModel, spark: SparkSession) -> Booster:
    """The booster of a fitted model, through the node tables that saving writes."""
    path = f"{checkpoint_root(spark)}/freshet-booster-{uuid.uuid4().hex}"
    model.write().save(path)
    return booster(booster_nodes(spark, path))


def predict_with_drivers(
    model: PipelineModel, df: DataFrame, features: Sequence[str], row: Sequence[str], threshold: float, hazard: str = "flood",
    k: int = TOP_DRIVERS, trees: Booster | None = None,
) -> DataFrame:
    """The scores of `df` with `top_drivers`, the k features with the largest exact contributions to each score."""
    trees = trees or booster_of(model, df.sparkSession)
    made = attributions(trees, df, features, row).withColumn("_row", F.struct(*row))
    drivers = driver_strings(made, k, "_row").select("_row.*", "top_drivers")
    return score(model, df, threshold, hazard).join(drivers, list(row), "left")
