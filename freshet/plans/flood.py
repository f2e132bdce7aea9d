"""End-to-end flood data sets: labelled gauges, training rows, model features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from freshet.functions.series import salted_lookup
from freshet.operators.labels import label_floods
from freshet.operators.quality import STATION, clean_levels, keep_quality
from freshet.session import materialize


def labelled_gauges(df: DataFrame, keys: Sequence[str] = STATION, arrival: str | None = "seq", **limits) -> DataFrame:
    """Clean every station, keep good and interpolated rows, then label."""
    cleaned = materialize(keep_quality(clean_levels(df, keys, arrival=arrival, **limits)))
    return label_floods(cleaned, keys)


def flood_training_set(
    gauges: DataFrame,
    weather: DataFrame,
    terrain: DataFrame,
    keys: Sequence[str] = STATION,
    arrival: str | None = "seq",
    quality: Sequence[str] = ("good",),
) -> DataFrame:
    """Labelled gauge rows with the weather of the same hour and the station's terrain, good rows only.

    Labels are drawn before the quality filter, since lead times span interpolated rows. Weather
    joins on (station, hour), so no station is a hot key there; the terrain lookup is salted.
    """
    labelled = labelled_gauges(gauges, keys, arrival)
    joined = labelled.where(labelled.quality_flag.isin(*quality)).join(weather, [*keys, "timestamp"], "inner")
    return salted_lookup(joined, terrain, keys, ["timestamp"])
