"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans joins from measured shuffle sizes: a side is broadcast only once its real size is
# known to be under the threshold, and oversized join partitions are split. Before that, Spark knows
# a table by the size of its files alone: columns of cells compress a hundredfold, and exploded rows
# (salts) do not count, so only what is tiny by that measure is broadcast without being measured.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.autoBroadcastJoinThreshold": "128KB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "8MB",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "freshet", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def measure_broadcasts(spark: SparkSession) -> None:
    """In a session somebody else built, let joins without a hint broadcast only what AQE has measured to be small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    key = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    spark.conf.set(key, SETTINGS[key])


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch folder only for local masters."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="freshet-checkpoint-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back as a fresh, short-lineage table.

    Parquet rather than `checkpoint()` so that later stages still prune columns and skip row
    groups. Survives lost executors: nothing downstream depends on executor-local blocks.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/freshet-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.freshet_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete what `materialize` wrote for `tables`, once no frame that is still wanted reads them."""
    for table in tables:
        path = getattr(table, "freshet_path", None)
        context = getattr(table.sparkSession, "_jsc", None)
        if path and context is not None:  # the file system is only reachable in the driver's own JVM
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context.hadoopConfiguration()).delete(folder, True)
