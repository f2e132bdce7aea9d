"""Registered queries over the supplied tables, each with the SQL that checks it where SQL can."""

from freshet.queries import (  # noqa: F401
    gauges,
    features,
    hazards,
    learning,
    rasters,
    travel,
    models,
    streams,
)
from freshet.queries.registry import ORACLES, QUERIES  # noqa: F401
