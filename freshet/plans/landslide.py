"""Landslide training set: grid, labels, terrain, weather, features, then sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame

from freshet.operators.features import landslide_features
from freshet.operators.grid import (
    BBox,
    NEGATIVES_PER_POSITIVE,
    grid_day_labels,
    grid_features,
    negative_sampling,
    points_in_grid,
    spatial_grid,
)
from freshet.session import materialize


def labelled_cell_days(
    slides: DataFrame, terrain: DataFrame, weather: DataFrame, bbox: BBox, start: str, end: str, cell_km: float = 1.0
) -> DataFrame:
    """Daily rows of every cell with label, terrain and weather (weather is keyed by cell and date)."""
    grid = spatial_grid(slides.sparkSession, bbox, cell_km)
    labels = grid_day_labels(grid, points_in_grid(slides, bbox, cell_km), start, end)
    return grid_features(labels, terrain).join(weather, ["grid_id", "date"], "left")


def landslide_dataset(
    slides, terrain, weather, bbox: BBox, start: str, end: str, cell_km: float = 1.0,
    ratio: int = NEGATIVES_PER_POSITIVE, seed: int = 42,
) -> DataFrame:
    rows = materialize(labelled_cell_days(slides, terrain, weather, bbox, start, end, cell_km))
    return negative_sampling(rows, ratio, seed=seed)


def landslide_training_set(
    slides, terrain, weather, bbox: BBox, start: str, end: str, cell_km: float = 1.0,
    ratio: int = NEGATIVES_PER_POSITIVE, seed: int = 42,
) -> DataFrame:
    """Features on the full calendar of each cell first, sampling last, so lags see every day."""
    full = labelled_cell_days(slides, terrain, weather, bbox, start, end, cell_km)
    return negative_sampling(materialize(landslide_features(full)), ratio, seed=seed)
