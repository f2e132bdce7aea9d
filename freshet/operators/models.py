"""Training, scoring and explaining the two hazard models with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from freshet.functions.clock import stamp
from freshet.functions.risk import classify_risk, confidence, estimate_lead_time
from freshet.functions.series import latest_at
from freshet.operators.evaluation import scale_pos_weight
from freshet.operators.grid import BBox, points_in_grid
from freshet.session import checkpoint_root

DEFAULT_THRESHOLD = 0.5
# Spark's trees take no missing values: a value below every real one lets splits set them apart.
MISSING = -1e9
_FILLED = "filled_"


@dataclass(frozen=True)
class Profile:
    """Boosting parameters of a hazard model."""

    depth: int
    rate: float
    trees: int
    row_share: float = 0.8
    feature_share: str = "0.8"
    seed: int = 42


FLOOD = Profile(depth=4, rate=0.05, trees=200)
LANDSLIDE = Profile(depth=5, rate=0.03, trees=300)


def balanced(df: DataFrame) -> DataFrame:
    """`df`, a stored table, dealt evenly over whole waves of the cluster's cores; what fits one partition stays there.

    Every level of every tree is one stage over all rows, so a last wave that is half empty is paid for
    again at each of them.
    """
    parts, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, round(parts / cores)) * cores) if parts > 1 else df


def train(df: DataFrame, features: Sequence[str], profile: Profile = FLOOD, label: str = "label") -> PipelineModel:
    """Gradient-boosted trees; positives are weighted by negatives per positive."""
    checkpoint_root(df.sparkSession)  # the booster cuts its lineage there
    weight = scale_pos_weight(df, label).first().scale_pos_weight  # one number
    weighted = df.select(
        *features, F.col(label).cast("double").alias(label), F.when(F.col(label) == 1, weight).otherwise(1.0).alias("_weight")
    )
    # Node ids are not cached: a row finds its node in at most `depth` steps, while the cache writes another
    # array per row and level and about doubles the time of a level.
    booster = GBTClassifier(
        featuresCol="features", labelCol=label, weightCol="_weight", maxDepth=profile.depth, stepSize=profile.rate,
        maxIter=profile.trees, subsamplingRate=profile.row_share, featureSubsetStrategy=profile.feature_share,
        seed=profile.seed, cacheNodeIds=False, checkpointInterval=10,
    )
    filled = ", ".join(f"coalesce(nanvl(double(`{f}`), NULL), {MISSING}D) AS `{_FILLED}{f}`" for f in features)
    complete = SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")
    assembler = VectorAssembler(inputCols=[_FILLED + f for f in features], outputCol="features")
    return Pipeline(stages=[complete, assembler, booster]).fit(balanced(weighted))


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """(feature, importance) in model order; one entry per feature."""
    _, assembler, booster = model.stages
    names = [c.removeprefix(_FILLED) for c in assembler.getInputCols()]
    return list(zip(names, booster.featureImportances.toArray().tolist()))


def with_probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    scored = model.transform(df).withColumn("probability", vector_to_array("probability")[1])
    return scored.select(*df.columns, "probability")


def with_margin(model: PipelineModel, df: DataFrame) -> DataFrame:
    """`df` with the model's raw margin, half the log-odds of the event."""
    return model.transform(df).withColumn("model_margin", vector_to_array("rawPrediction")[1]).select(*df.columns, "model_margin")


def score(
    model: PipelineModel, df: DataFrame, threshold: float = DEFAULT_THRESHOLD, hazard: str = "flood",
    quality: str | None = None, cached: bool = True,
) -> DataFrame:
    """Probability, risk, lead time (floods), confidence and the threshold used, per input row."""
    p = F.col("probability")
    good = F.col(quality) if quality else F.lit("good")
    out = with_probability(model, df).withColumns(
        {
            "hazard": F.lit(hazard),
            "risk_level": classify_risk(p),
            "confidence": confidence(good, F.lit(cached)),
            "threshold_used": F.lit(float(threshold)),
        }
    )
    if hazard == "flood":
        out = out.withColumn("lead_time_hours", estimate_lead_time(p))
    name = "probability" if hazard == "flood" else "susceptibility"
    return out.withColumn("probability", F.round(p, 4)).withColumnRenamed("probability", name)


def inference_features(features: DataFrame, as_of: str, keys: Sequence[str] = ("station_id",), time: str = "timestamp") -> DataFrame:
    """The latest feature row of each series at or before `as_of`; picked by a partial aggregate."""
    rest = [c for c in features.columns if c not in keys]
    past = features.where(F.col(time) <= stamp(as_of))
    return past.groupBy(*keys).agg(F.max_by(F.struct(*rest), time).alias("_row")).select(*keys, "_row.*")


def features_at(
    requests: DataFrame, features: DataFrame, keys: Sequence[str] = ("station_id",), at: str = "requested_at", time: str = "timestamp"
) -> DataFrame:
    """Every request with the latest feature row of its series at or before its own time `at`.

    No row after a request is used. A request without an earlier row, key or time keeps null features.
    Requests and features must not share names besides `keys`.
    """
    rest = [c for c in features.columns if c not in keys]
    shared = sorted(set(rest) & set(requests.columns))
    if shared:
        raise ValueError(f"Requests and features share columns: {shared}")
    found = latest_at(requests, features, keys, at, time)
    return found.select(*requests.columns, *[F.col("_latest").getField(c).alias(c) for c in rest])


def contributions(model: PipelineModel, df: DataFrame, features: Sequence[str], row: Sequence[str], background: DataFrame | None = None) -> DataFrame:
    """Per row and feature: how much the score drops when that feature is set to its background mean.

    Every row is laid out once per feature plus once unchanged, and all are scored in one pass.
    """
    means = (background or df).agg(*[F.avg(f).alias(f) for f in features]).first()  # one row
    cases = F.explode(F.array(F.lit("_none"), *[F.lit(f) for f in features]))
    base = df.select(*row, *features).withColumn("_case", cases)
    swapped = base.select(
        *row,
        "_case",
        *[F.when(F.col("_case") == f, F.lit(means[f])).otherwise(F.col(f)).alias(f) for f in features],
        F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f).cast("double") for f in features])).alias("_own"),
    )
    scored = with_probability(model, swapped).select(*row, "_case", "probability", "_own")
    per_row = scored.groupBy(*row).agg(
        F.max(F.when(F.col("_case") == "_none", F.col("probability"))).alias("_full"),
        F.collect_list(F.when(F.col("_case") != "_none", F.struct("_case", "probability"))).alias("_without"),
        F.any_value("_own").alias("_own"),
    )
    return per_row.select(*row, "_full", "_own", F.explode("_without").alias("_w")).select(
        *row,
        F.col("_w._case").alias("feature"),
        (F.col("_full") - F.col("_w.probability")).alias("contribution"),
        F.col("_own")[F.col("_w._case")].alias("value"),
    )


def landslide_inference_features(
    points: DataFrame, features: DataFrame, as_of: str, bbox: BBox, cell_km: float = 1.0, key: Sequence[str] = ("point_id",)
) -> DataFrame:
    """The latest features, at or before the day `as_of`, of the grid cell that each point (lat, lon) lies in."""
    latest = inference_features(features.withColumn("date", F.col("date").cast("timestamp_ntz")), as_of, ("grid_id",), "date")
    latest = latest.withColumn("date", F.col("date").cast("date"))
    placed = points_in_grid(points, bbox, cell_km).select(*key, "grid_id")
    return placed.join(latest, "grid_id", "left")


def landslide_features_at(
    points: DataFrame, features: DataFrame, bbox: BBox, cell_km: float = 1.0, key: Sequence[str] = ("point_id",), at: str = "asked_on"
) -> DataFrame:
    """The latest features, at or before each point's own day `at`, of the grid cell that the point (lat, lon) lies in."""
    placed = points_in_grid(points, bbox, cell_km).select(*key, at, "grid_id")
    return features_at(placed, features, ("grid_id",), at, "date")
