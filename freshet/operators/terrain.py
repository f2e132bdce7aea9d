"""Neighbourhood operators on cell tables: filling, flats, D8 direction, slope, masks.

A 3×3 neighbourhood is read with two windows, along rows and then along columns of the result, so
each cell is shuffled twice instead of being copied to its eight neighbours. A window group is one
raster line: its size is the raster's width or height, never the raster.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from freshet.functions.series import salted_lookup
from freshet.session import materialize

# D8 codes by compass point in order of precedence, (row, col) offsets, diagonal length.
D8_CODE = {"n": 64, "ne": 128, "e": 1, "se": 2, "s": 4, "sw": 8, "w": 16, "nw": 32}
D8_OFFSET = {
    "n": (-1, 0), "ne": (-1, 1), "e": (0, 1), "se": (1, 1),
    "s": (1, 0), "sw": (1, -1), "w": (0, -1), "nw": (-1, -1),
}
DIAGONAL = 1.414
FLAT_EPSILON = 1e-4
CHANNEL_THRESHOLD = 1000
MANY_FILLED_PERCENT = 10.0

COMPASS = list(D8_CODE)
RASTER = ("dem_id",)


def neighbours(cells: DataFrame, value: str = "elevation", keys: Sequence[str] = RASTER) -> DataFrame:
    """Add struct `nb` with the value at n, ne, …, nw and `nb_count`, the number of in-grid neighbours."""
    along_row = W.partitionBy(*keys, "row").orderBy("col")
    along_col = W.partitionBy(*keys, "col").orderBy("row")

    def beside(shift, step):
        touching = shift("col").over(along_row) == F.col("col") + step
        return F.when(touching, F.struct(shift(value).over(along_row).alias("v")))

    flanked = cells.withColumns({"_w": beside(F.lag, -1), "_e": beside(F.lead, 1)})
    line = F.struct(F.col("_w").alias("w"), F.struct(F.col(value).alias("v")).alias("c"), F.col("_e").alias("e"))
    flanked = flanked.withColumn("_line", line)

    def across(shift, step):
        return F.when(shift("row").over(along_col) == F.col("row") + step, shift("_line").over(along_col))

    both = flanked.withColumns({"_n": across(F.lag, -1), "_s": across(F.lead, 1)})
    at = {
        "n": F.col("_n.c"), "ne": F.col("_n.e"), "e": F.col("_e"), "se": F.col("_s.e"),
        "s": F.col("_s.c"), "sw": F.col("_s.w"), "w": F.col("_w"), "nw": F.col("_n.w"),
    }
    count = sum((at[d].isNotNull().cast("int") for d in COMPASS), F.lit(0))
    return both.withColumns(
        {"nb": F.struct(*[at[d]["v"].alias(d) for d in COMPASS]), "nb_count": count}
    ).drop("_w", "_e", "_n", "_s", "_line")


def _all(nb: str = "nb") -> list[Column]:
    return [F.col(f"{nb}.{d}") for d in COMPASS]


def _valid_neighbours() -> Column:
    return sum((c.isNotNull().cast("int") for c in _all()), F.lit(0))


def fill_depressions(cells: DataFrame, keys: Sequence[str] = RASTER) -> DataFrame:
    """Raise every interior pit to its lowest neighbour; adds `filled`.

    A pit lies below all eight of its neighbours, none of them nodata. One pass is the fixed
    point: a raised pit equals a neighbour and so is no pit, and no other cell becomes one,
    because a pit's new height never exceeds any cell that had it as a neighbour.
    """
    around = neighbours(cells, keys=keys)
    lowest = F.least(*_all())
    pit = (_valid_neighbours() == 8) & (F.col("elevation") < lowest)
    return around.withColumn("filled", F.when(pit, lowest).otherwise(F.col("elevation"))).drop("nb", "nb_count")


def fill_stats(filled: DataFrame, keys: Sequence[str] = RASTER) -> DataFrame:
    depth = F.col("filled") - F.col("elevation")
    raised = F.when(depth > 0, depth)
    return filled.groupBy(*keys).agg(
        F.count(raised).alias("pits_filled"),
        F.round(F.coalesce(F.avg(raised), F.lit(0.0)), 3).alias("mean_fill_depth"),
        F.round(F.coalesce(F.max(raised), F.lit(0.0)), 3).alias("max_fill_depth"),
        F.coalesce(
            F.try_divide(100.0 * F.count(raised), F.count("elevation")) > MANY_FILLED_PERCENT, F.lit(False)
        ).alias("excessive"),
    )


def flat_cells(cells: DataFrame, value: str = "elevation", keys: Sequence[str] = RASTER) -> DataFrame:
    """Add `is_flat`: the cell and all its in-grid neighbours are valid and equal."""
    around = neighbours(cells, value, keys)
    same = (F.least(*_all(), F.col(value)) == F.col(value)) & (F.greatest(*_all(), F.col(value)) == F.col(value))
    complete = _valid_neighbours() == F.col("nb_count")
    flat = F.coalesce(F.col(value).isNotNull() & complete & same, F.lit(False))
    return around.withColumn("is_flat", flat).drop("nb", "nb_count")


def _line_distance(lines: pd.DataFrame) -> pd.DataFrame:
    """Squared distance along one raster line from squared distances down its columns.

    Each column with a void above or below it is a parabola over the line, and a cell's distance is
    the lowest parabola there. The lower envelope is built left to right, in time linear in the width.
    """
    lines = lines.sort_values("col")
    place = lines[["dem_id", "row", "col"]]
    known = lines["down2"].notna().to_numpy()
    if not known.any():
        return place.assign(dist=np.nan)
    cols = lines["col"].to_numpy(dtype=float)
    hull_at, hull_low, begins = [], [], []
    for at, low in zip(cols[known].tolist(), lines["down2"].to_numpy(dtype=float)[known].tolist()):
        begin = -np.inf
        while hull_at:
            begin = (low + at * at - hull_low[-1] - hull_at[-1] ** 2) / (2 * (at - hull_at[-1]))
            if begin > begins[-1]:
                break
            hull_at.pop(), hull_low.pop(), begins.pop()
            begin = -np.inf
        hull_at.append(at), hull_low.append(low), begins.append(begin)
    lowest = np.searchsorted(np.array(begins), cols, side="right") - 1
    found = np.array(hull_low)[lowest] + (cols - np.array(hull_at)[lowest]) ** 2
    return place.assign(dist=np.sqrt(found))


def nodata_distance(cells: DataFrame, value: str = "elevation") -> DataFrame:
    """Exact Euclidean distance in cells to the nearest nodata cell; null in rasters without one.

    Separable: nearest nodata up or down each column by windows, then one pass along each row.
    """
    up = W.partitionBy("dem_id", "col").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("dem_id", "col").orderBy(F.desc("row")).rowsBetween(W.unboundedPreceding, 0)
    void_row = F.when(F.col(value).isNull(), F.col("row"))
    above = F.col("row") - F.last(void_row, ignorenulls=True).over(up)
    below = F.last(void_row, ignorenulls=True).over(down) - F.col("row")
    nearest = F.least(above, below).cast("double")
    lines = cells.select("dem_id", "row", "col", (nearest * nearest).alias("down2"))
    return lines.groupBy("dem_id", "row").applyInPandas(
        _line_distance, "dem_id int, row int, col int, dist double"
    )


def resolve_flats(cells: DataFrame, value: str = "filled", epsilon: float = FLAT_EPSILON) -> DataFrame:
    """Tilt flat cells by epsilon × distance to nodata ÷ the raster's largest such distance.

    Adds `conditioned`. Rasters without nodata have no distance to go by and are left as they are.
    """
    distance = nodata_distance(cells, value)
    largest = distance.groupBy("dem_id").agg(F.max("dist").alias("_max"))
    tilt = F.lit(epsilon) * F.coalesce(F.try_divide("dist", "_max"), F.lit(0.0))
    measured = flat_cells(cells, value).join(distance, ["dem_id", "row", "col"], "left")
    return (
        salted_lookup(measured, largest, ["dem_id"], ["row", "col"])
        .withColumn("conditioned", F.when(F.col("is_flat"), F.col(value) + tilt).otherwise(F.col(value)))
        .drop("dist", "_max")
    )


def flat_stats(resolved: DataFrame, value: str = "filled") -> DataFrame:
    """Flats before and after, and the size of the gradient that was added."""
    before = resolved.groupBy("dem_id").agg(
        F.count_if("is_flat").alias("_before"),
        F.round(F.avg(F.abs(F.col("conditioned") - F.col(value))), 6).alias("mean_gradient_added"),
        F.round(F.max(F.abs(F.col("conditioned") - F.col(value))), 6).alias("max_gradient_added"),
    )
    after = (
        flat_cells(resolved.drop("is_flat"), "conditioned").groupBy("dem_id").agg(F.count_if("is_flat").alias("_after"))
    )
    return before.join(after, "dem_id").select(
        "dem_id", (F.col("_before") - F.col("_after")).alias("flats_resolved"), "mean_gradient_added", "max_gradient_added"
    )


def condition_dem(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill, resolve flats; returns the conditioned cells (written once) and one row of statistics per raster."""
    filled = materialize(fill_depressions(cells))
    resolved = materialize(resolve_flats(filled))
    lost = F.count_if(F.col("elevation").isNotNull() & F.col("conditioned").isNull())
    check = resolved.groupBy("dem_id").agg(
        F.when(lost > 0, F.raise_error(F.lit("Conditioning created new NoData cells")).cast("bigint"))
        .otherwise(F.count("conditioned"))
        .alias("valid_cells")
    )
    stats = fill_stats(filled).join(flat_stats(resolved), "dem_id").join(check, "dem_id")
    return resolved.select("dem_id", "row", "col", "elevation", "conditioned"), stats


def flow_direction(
    cells: DataFrame, value: str = "elevation", cell_size: float = 30.0, keys: Sequence[str] = RASTER,
    allow_uphill: bool = False,
) -> DataFrame:
    """Steepest-descent D8 code as `flow_dir`; 0 at sinks, outlets and nodata; the first code wins ties.

    `allow_uphill` sends a sink to its least-uphill neighbour instead, which makes two-cell cycles.
    """
    around = neighbours(cells, value, keys)
    run = {d: cell_size * (DIAGONAL if len(d) == 2 else 1.0) for d in COMPASS}
    slopes = {d: (F.col(value) - F.col(f"nb.{d}")) / F.lit(run[d]) for d in COMPASS}
    around = around.withColumn("_steepest", F.greatest(*slopes.values()))
    code = None
    for d in COMPASS:
        hit = slopes[d] == F.col("_steepest")
        code = F.when(hit, D8_CODE[d]) if code is None else code.when(hit, D8_CODE[d])
    flows = F.lit(True) if allow_uphill else F.col("_steepest") > 0
    return around.withColumn(
        "flow_dir", F.when(F.col(value).isNotNull() & flows, F.coalesce(code, F.lit(0))).otherwise(0)
    ).drop("nb", "nb_count", "_steepest")


def slope_aspect_curvature(cells: DataFrame, value: str = "elevation", cell_size: float = 30.0, keys: Sequence[str] = RASTER) -> DataFrame:
    """Horn slope (degrees), downslope aspect (degrees from north) and curvature (minus the Laplacian).

    Null wherever the full 3×3 neighbourhood is not valid.
    """
    around = neighbours(cells, value, keys)
    n, ne, e, se, s, sw, w, nw = _all()
    east = ((ne + 2 * e + se) - (nw + 2 * w + sw)) / (8 * cell_size)
    south = ((sw + 2 * s + se) - (nw + 2 * n + ne)) / (8 * cell_size)
    aspect = F.pmod(F.degrees(F.atan2(-east, south)), F.lit(360.0))
    bend = -((n + e + s + w) - 4 * F.col(value)) / (cell_size * cell_size)
    steep = F.degrees(F.atan(F.sqrt(east * east + south * south)))
    return around.withColumns(
        {"slope": steep, "aspect": F.when(steep.isNotNull(), aspect), "curvature": F.when(steep.isNotNull(), bend)}
    ).drop("nb", "nb_count")


def channel_mask(cells: DataFrame, threshold: int = CHANNEL_THRESHOLD) -> DataFrame:
    return cells.withColumn("is_channel", F.coalesce(F.col("flow_acc") >= threshold, F.lit(False)))


def flood_mask(cells: DataFrame, levels: Sequence[float], hand: str = "hand") -> DataFrame:
    """The flooded cells of every level: valid cells whose height above drainage is below it."""
    reached = F.filter(F.array(*[F.lit(float(x)) for x in levels]), lambda x: F.col(hand) < x)
    return cells.withColumn("level", F.explode(reached))
