"""Spatial grid, landslide labels per cell and day, and class balancing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.functions.selection import first_by_hash

# Kilometres per degree, cell naming, sampling ratio.
KM_PER_DEGREE = 111.0
CELL_NAME = "CELL_%04d_%04d"
NEGATIVES_PER_POSITIVE = 10

BBox = tuple[float, float, float, float]  # min_lon, min_lat, max_lon, max_lat


def grid_shape(bbox: BBox, cell_km: float) -> tuple[float, int, int]:
    step = cell_km / KM_PER_DEGREE
    nx = math.ceil((bbox[2] - bbox[0]) / step)
    ny = math.ceil((bbox[3] - bbox[1]) / step)
    return step, nx, ny


def cell_name(ix: Column, iy: Column) -> Column:
    return F.format_string(CELL_NAME, ix, iy)


def spatial_grid(spark: SparkSession, bbox: BBox, cell_km: float = 1.0) -> DataFrame:
    """One row per cell: indices, id, bounds and centre. The polygon follows from the bounds."""
    step, nx, ny = grid_shape(bbox, cell_km)
    cells = spark.range(nx * ny).select(
        F.floor(F.col("id") / ny).cast("int").alias("ix"), (F.col("id") % ny).cast("int").alias("iy")
    )
    lon, lat = bbox[0] + F.col("ix") * F.lit(step), bbox[1] + F.col("iy") * F.lit(step)
    return cells.select(
        "ix",
        "iy",
        cell_name(F.col("ix"), F.col("iy")).alias("grid_id"),
        lon.alias("min_lon"),
        lat.alias("min_lat"),
        (lon + step).alias("max_lon"),
        (lat + step).alias("max_lat"),
        (lon + step / 2).alias("center_lon"),
        (lat + step / 2).alias("center_lat"),
    )


def points_in_grid(points: DataFrame, bbox: BBox, cell_km: float = 1.0, drop_edges: bool = False) -> DataFrame:
    """Give each point the id of its half-open cell by arithmetic; points outside get null.

    `drop_edges` leaves points lying exactly on a cell edge without a cell.
    """
    step, nx, ny = grid_shape(bbox, cell_km)
    fx, fy = (F.col("lon") - bbox[0]) / F.lit(step), (F.col("lat") - bbox[1]) / F.lit(step)
    ix, iy = F.floor(fx), F.floor(fy)
    inside = ix.between(0, nx - 1) & iy.between(0, ny - 1)
    if drop_edges:
        inside = inside & (fx != ix) & (fy != iy)
    return points.withColumn("grid_id", F.when(inside, cell_name(ix.cast("int"), iy.cast("int"))))


def events_per_cell_day(points: DataFrame, date: str = "date") -> DataFrame:
    return (
        points.where(F.col("grid_id").isNotNull())
        .groupBy("grid_id", F.to_date(date).alias("date"))
        .agg(F.count(F.lit(1)).cast("int").alias("num_events"))
    )


def cell_days(grid: DataFrame, start: str, end: str) -> DataFrame:
    """The full calendar of every cell: each cell unrolls its own days, no join."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 DAY"))
    return grid.withColumn("date", F.explode(days))


def grid_day_labels(grid: DataFrame, events: DataFrame, start: str, end: str) -> DataFrame:
    """Every cell and day of the range with its event count (0 if none) and label."""
    counts = events_per_cell_day(events)
    return (
        cell_days(grid.select("grid_id"), start, end)
        .join(counts, ["grid_id", "date"], "left")
        .withColumn("num_events", F.coalesce("num_events", F.lit(0)))
        .withColumn("label", (F.col("num_events") > 0).cast("int"))
    )


def grid_features(labels: DataFrame, terrain: DataFrame) -> DataFrame:
    """Terrain columns per cell; every cell has the same number of days, so the key cannot be hot."""
    return labels.join(terrain, "grid_id", "left")


def negative_sampling(
    df: DataFrame, ratio: int = NEGATIVES_PER_POSITIVE, unique: Sequence[str] = ("grid_id", "date"), seed: int = 42
) -> DataFrame:
    """All positives and exactly `ratio` negatives per positive, or all negatives if there are fewer."""
    negatives = df.where(F.col("label") == 0)
    quota = df.agg(F.count_if(F.col("label") == 1) * ratio).scalar()
    return df.where(F.col("label") == 1).unionByName(first_by_hash(negatives, quota, "label", unique, seed))


def monthly_distribution(events: DataFrame, date: str = "date") -> DataFrame:
    return events.groupBy(F.month(date).alias("month")).agg(F.count(F.lit(1)).alias("events"))
