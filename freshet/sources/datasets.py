"""Training sets, the weather store and model artifacts on shared storage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from freshet.functions.clock import as_col
from freshet.operators.catchments import request_key
from freshet.session import discard, materialize


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    writer.csv(path, header=True) if fmt == "csv" else writer.parquet(path)


def read_dataset(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """Read with the known schema, so CSV needs no inference pass and timestamps come back typed."""
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if fmt == "csv" else reader.parquet(path)


def write_weather(weather: DataFrame, path: str, kind: str, time: str = "timestamp") -> None:
    """Merge into the store laid out as kind=/date=, files sorted by catchment.

    A (kind, catchment, date) that `weather` holds is replaced whole; all others stay. Catchments are
    too many for directories, so the touched dates are rewritten: what stays of them is staged in the
    shared folder first. Sorting lets row-group statistics find a catchment. Rows without a time have
    no date and go to the store's default partition.
    """
    keyed = weather.withColumns(
        {
            "kind": F.lit(kind),
            "date": F.to_date(time),
            "key": request_key(F.lit(kind), as_col("catchment_id"), F.date_format(time, "yyyy-MM-dd")),
        }
    )
    stored = _stored(weather.sparkSession, path)
    staged = None
    if stored is not None:
        staged = _untouched(stored.where(F.col("kind") == kind), keyed)
        keyed = keyed.unionByName(staged, allowMissingColumns=True)
    (
        keyed.repartition("date", F.pmod(F.xxhash64("catchment_id"), F.lit(16)))
        .sortWithinPartitions("date", "catchment_id", time)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy("kind", "date")
        .parquet(path)
    )
    if staged is not None:
        discard(staged)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The store as it is, or None before the first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _untouched(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows of the incoming dates whose (catchment, date) does not come in, written apart."""
    touched = materialize(incoming.select(F.col("catchment_id").alias("_catchment"), F.col("date").alias("_date")).distinct())
    span = touched.agg(F.min("_date").alias("first"), F.max("_date").alias("last"), F.bool_or(F.col("_date").isNull()).alias("undated")).first()
    near = F.col("date").between(F.lit(span.first), F.lit(span.last))  # prunes partitions; the joins decide
    if span.undated:
        near = near | F.col("date").isNull()
    dates = touched.select("_date").distinct()
    same_day = F.col("date").eqNullSafe(F.col("_date"))
    same_key = same_day & F.col("catchment_id").eqNullSafe(F.col("_catchment"))
    kept = materialize(stored.where(near).join(dates, same_day, "left_semi").join(touched, same_key, "left_anti"))
    discard(touched)
    return kept


def read_weather(
    spark: SparkSession, path: str, kind: str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Only the wanted kind= / date= directories are listed and read."""
    stored = spark.read.parquet(path)
    if kind is not None:
        stored = stored.where(F.col("kind") == kind)
    if start is not None:
        stored = stored.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        stored = stored.where(F.col("date") <= F.lit(end).cast("date"))
    return stored


def prune_weather(spark: SparkSession, path: str, as_of: str, days: int) -> int:
    """Delete date partitions older than `days` before `as_of`; returns how many. Metadata only."""
    from datetime import date, timedelta

    oldest = date.fromisoformat(as_of[:10]) - timedelta(days=days)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/kind=*/date=*")
    fs = pattern.getFileSystem(conf)
    removed = 0
    for entry in fs.globStatus(pattern) or []:
        if date.fromisoformat(entry.getPath().getName().split("=", 1)[1]) < oldest:
            fs.delete(entry.getPath(), True)
            removed += 1
    return removed


def save_model_artifacts(model, path: str, features: list[str], importances: list[float], thresholds: dict) -> None:
    """The fitted model, its ordered feature list with importances, and its thresholds."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    rows = [(i, f, float(w)) for i, (f, w) in enumerate(zip(features, importances))]
    spark.createDataFrame(rows, "position int, feature string, importance double").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{path}/features")
    spark.createDataFrame([{k: float(v) for k, v in thresholds.items()}]).coalesce(1).write.mode("overwrite").json(
        f"{path}/thresholds"
    )


def load_model_artifacts(spark: SparkSession, path: str):
    """(model, ordered feature names, thresholds); the two tables have one row per model feature and one row."""
    from pyspark.ml import PipelineModel

    features = spark.read.schema("position int, feature string, importance double").json(f"{path}/features")
    names = [row.feature for row in features.orderBy("position").collect()]
    thresholds = spark.read.json(f"{path}/thresholds").first().asDict()
    return PipelineModel.load(f"{path}/model"), names, thresholds
