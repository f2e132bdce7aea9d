"""Operators along flow paths: accumulation, catchments, height above nearest drainage.

Flow paths are chains of unknown length. Every operator here doubles its reach per round: a cell
that knows its ancestor 2^k steps downstream learns the one 2^(k+1) steps down from it. A raster
whose longest path has L cells takes about log2 L rounds of one join, and each round is written to
the shared folder. Cells pointing at one ancestor all lie exactly 2^k steps upstream of it, so a
big river mouth is not a hot key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.ordering import running_totals
from freshet.functions.tours import cut_cycles, forest_intervals, pairs_under
from freshet.operators.terrain import D8_CODE, D8_OFFSET
from freshet.session import discard, materialize

_BASE = 1 << 31


def cell_key(row: Column, col: Column) -> Column:
    return row.cast("bigint") * F.lit(_BASE) + col.cast("bigint")


def downstream(cells: DataFrame, valid: str = "elevation") -> DataFrame:
    """Add `cell` and `to`, the key of the cell flow_dir points at; null at sinks and where flow
    leaves the grid or enters nodata."""
    row_step, col_step = F.lit(0), F.lit(0)
    for d, code in D8_CODE.items():
        dr, dc = D8_OFFSET[d]
        row_step = F.when(F.col("flow_dir") == code, dr).otherwise(row_step)
        col_step = F.when(F.col("flow_dir") == code, dc).otherwise(col_step)
    inside = cells.where(F.col(valid).isNotNull())
    aimed = inside.withColumn("cell", cell_key(F.col("row"), F.col("col"))).withColumn(
        "_aim",
        F.when(
            (F.col("flow_dir") != 0) & (F.col("col") + col_step >= 0),
            cell_key(F.col("row") + row_step, F.col("col") + col_step),
        ),
    )
    targets = aimed.select("dem_id", F.col("cell").alias("_aim"), F.lit(True).alias("_hit"))
    return (
        aimed.join(targets, ["dem_id", "_aim"], "left")
        .withColumn("to", F.when(F.col("_hit"), F.col("_aim")))
        .drop("_aim", "_hit")
    )


def upstream_edges(cells: DataFrame, valid: str = "elevation") -> DataFrame:
    """Adjacency downstream -> upstream."""
    linked = downstream(cells, valid).where(F.col("to").isNotNull())
    row, col = F.floor(F.col("to") / _BASE).cast("int"), F.pmod(F.col("to"), F.lit(_BASE)).cast("int")
    return linked.select(
        "dem_id", row.alias("row"), col.alias("col"), F.col("row").alias("up_row"), F.col("col").alias("up_col")
    )


def _rounds(cells: DataFrame) -> int:
    """Enough doublings for the longest possible acyclic path."""
    return max(1, math.ceil(math.log2(max(2, cells.count())))) + 1


def flow_accumulation(cells: DataFrame, valid: str = "elevation") -> DataFrame:
    """`flow_acc` = 1 + number of upstream cells; null for cells on a cycle and for nodata.

    Before round k each cell holds the count of cells fewer than 2^k steps upstream (itself
    included) and its ancestor 2^k steps down; adding the counts of the cells exactly 2^k steps
    upstream doubles the depth covered.
    """
    linked = materialize(downstream(cells, valid).select("dem_id", "cell", "to", F.lit(1).cast("bigint").alias("acc")))
    # A round carries only cells that still have an ancestor to reach. Counts of the others, and what
    # reaches them later, are rows of the tables the rounds leave behind, summed once at the end.
    tables, live = [linked], linked.where(F.col("to").isNotNull())
    cyclic = True
    for _ in range(_rounds(linked)):
        if live.isEmpty():
            cyclic = False
            break
        gains = live.groupBy("dem_id", F.col("to").alias("cell")).agg(F.sum("acc").alias("_gain"))
        hops = live.select("dem_id", F.col("cell").alias("to"), F.col("to").alias("_next"))
        met = live.join(gains, ["dem_id", "cell"], "full_outer").select(
            "dem_id",
            "cell",
            # what only gains has no pointer; its key is its own, which no cell has
            F.coalesce("to", -1 - F.col("cell")).alias("to"),
            (F.coalesce("acc", F.lit(0)) + F.coalesce("_gain", F.lit(0))).alias("acc"),
        )
        moved = materialize(
            met.join(hops, ["dem_id", "to"], "left").select("dem_id", "cell", F.col("_next").alias("to"), "acc")
        )
        tables.append(moved)
        live = moved.where(F.col("to").isNotNull())
    ended = live.select("dem_id", "cell", "acc")
    for part in tables:
        ended = ended.unionByName(part.where(F.col("to").isNull()).select("dem_id", "cell", "acc"))
    result = ended.groupBy("dem_id", "cell").agg(F.sum("acc").alias("flow_acc"))
    if cyclic:
        # after more steps than there are cells, every pointer that is left lands on a cycle member;
        # only those have no finite count
        members = live.select("dem_id", F.col("to").alias("cell"), F.lit(True).alias("_cyclic")).distinct()
        result = result.join(members, ["dem_id", "cell"], "left").withColumn(
            "flow_acc", F.when(F.col("_cyclic").isNull(), F.col("flow_acc"))
        )
    result = materialize(result)
    discard(*tables)
    keyed = cells.withColumn("_cell", cell_key(F.col("row"), F.col("col")))
    return keyed.join(result.select("dem_id", F.col("cell").alias("_cell"), "flow_acc"), ["dem_id", "_cell"], "left").drop(
        "_cell"
    )


def _follow(state: DataFrame, merge_open, merge_done, payload: list[str]) -> DataFrame:
    """Advance every open cell along its pointer until it meets a finished one.

    `state`: dem_id, cell, to, done, *payload. `merge_open` / `merge_done` give the payload after
    taking in the ancestor's payload (`v_*`), when the ancestor is itself open / finished. Cells
    that never finish lie on a cycle and stay open.
    """
    state = materialize(state)
    # finished cells stay in the table of the round that finished them
    tables, active = [state], state.where(~F.col("done"))
    ended = state.where(F.col("done"))
    for _ in range(_rounds(state)):
        if active.isEmpty():
            break
        ahead = ended.unionByName(active).select(
            "dem_id",
            F.col("cell").alias("to"),
            F.col("to").alias("v_to"),
            F.col("done").alias("v_done"),
            *[F.col(c).alias(f"v_{c}") for c in payload],
        )
        met = active.join(ahead, ["dem_id", "to"])
        opened, finished = merge_open(), merge_done()
        moved = met.select(
            "dem_id",
            "cell",
            F.when(F.col("v_done"), F.lit(None)).otherwise(F.col("v_to")).alias("to"),
            F.col("v_done").alias("done"),
            *[F.when(F.col("v_done"), finished[c]).otherwise(opened[c]).alias(c) for c in payload],
        )
        latest = materialize(moved.select(*state.columns))
        tables.append(latest)
        active, ended = latest.where(~F.col("done")), ended.unionByName(latest.where(F.col("done")))
    result = materialize(ended.unionByName(active))
    discard(*tables)
    return result


def compute_hand(
    cells: DataFrame, value: str = "elevation", channel: str = "is_channel", unreached_zero: bool = False
) -> DataFrame:
    """Height above nearest drainage as `hand`, with `reached`.

    Channels and cells whose flow ends or leaves the grid have 0. Elsewhere one step down adds the
    drop and clamps at 0; a step is h -> max(0, d + h), and such steps compose to h -> max(a, b + h),
    so the clamped value survives doubling exactly. Cells on a cycle are not reached: null, or 0
    with `unreached_zero`.
    """
    linked = downstream(cells, value)
    heights = linked.select("dem_id", F.col("cell").alias("to"), F.col(value).alias("_below"))
    start = linked.join(heights, ["dem_id", "to"], "left")
    end = F.coalesce(F.col(channel), F.lit(False)) | F.col("to").isNull()
    state = start.select(
        "dem_id",
        "cell",
        F.when(~end, F.col("to")).alias("to"),
        end.alias("done"),
        F.lit(0.0).alias("a"),
        F.when(end, F.lit(0.0)).otherwise(F.col(value) - F.col("_below")).alias("b"),
        F.when(end, F.lit(0.0)).alias("h"),
    )

    def merge_open():
        return {
            "a": F.greatest(F.col("a"), F.col("b") + F.col("v_a")),
            "b": F.col("b") + F.col("v_b"),
            "h": F.lit(None).cast("double"),
        }

    def merge_done():
        return {"a": F.col("a"), "b": F.col("b"), "h": F.greatest(F.col("a"), F.col("b") + F.col("v_h"))}

    solved = _follow(state, merge_open, merge_done, ["a", "b", "h"]).select(
        "dem_id", F.col("cell").alias("_cell"), F.col("h").alias("hand"), F.col("done").alias("reached")
    )
    keyed = cells.withColumn("_cell", cell_key(F.col("row"), F.col("col")))
    joined = keyed.join(solved, ["dem_id", "_cell"], "left").drop("_cell")
    if unreached_zero:
        joined = joined.withColumn("hand", F.when(F.col(value).isNotNull(), F.coalesce("hand", F.lit(0.0))))
    return joined.withColumn("reached", F.coalesce("reached", F.lit(False)))


def snap_pour_points(points: DataFrame, cells: DataFrame, radius: int = 5) -> DataFrame:
    """Move each point (dem_id, point_id, row, col) to the highest-accumulation cell of its window.

    The window has (2·radius + 1)² cells, so each point is laid over that many keys and met by an
    equi-join; ties go to the first cell in row-major order. A valid cell beats nodata (read as 0).
    """
    reach = F.sequence(F.lit(-radius), F.lit(radius))
    laid = (
        points.select("dem_id", "point_id", F.col("row").alias("orig_row"), F.col("col").alias("orig_col"))
        .withColumn("row", F.explode(F.transform(reach, lambda d: F.col("orig_row") + d)))
        .withColumn("col", F.explode(F.transform(reach, lambda d: F.col("orig_col") + d)))
    )
    met = laid.join(cells.select("dem_id", "row", "col", "flow_acc"), ["dem_id", "row", "col"])
    acc = F.coalesce("flow_acc", F.lit(0))
    best = met.groupBy("dem_id", "point_id", "orig_row", "orig_col").agg(
        F.min(F.struct((-acc).alias("order"), F.col("row"), F.col("col"))).alias("_b")
    )
    row, col = F.col("_b.row"), F.col("_b.col")
    drow, dcol = row - F.col("orig_row"), col - F.col("orig_col")
    return best.select(
        "dem_id", "point_id", row.alias("row"), col.alias("col"), F.sqrt(drow * drow + dcol * dcol).alias("snap_distance"),
        (-F.col("_b.order")).alias("flow_acc"),
    )


def outlet_tree(cells: DataFrame, points: DataFrame, valid: str = "elevation", strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Disjoint basins, the tree of their outlets, and the points on it.

    Returns basins (dem_id, cell, pour), where `pour` is the nearest pour point at or below a cell;
    outlets (dem_id, pour, enter, leave), whose catchment is all basins with an `enter` inside the interval;
    and points (dem_id, point_id, pour). With `strict`, a point outside the grid or on nodata fails.
    Pour points on one cycle of the flow share a catchment.
    """
    linked = materialize(downstream(cells, valid).select("dem_id", "cell", "to"))
    # the grid cell decides; several points may share one
    at = points.select("dem_id", "point_id", cell_key(F.col("row"), F.col("col")).alias("cell"))
    placed = at.join(linked.select("dem_id", "cell", F.lit(True).alias("_on")), ["dem_id", "cell"], "left")
    if strict:
        problem = F.raise_error(F.lit("Pour point outside grid or on NoData cell")).cast("bigint")
        placed = placed.withColumn("cell", F.when(F.col("_on"), F.col("cell")).otherwise(problem))
    else:
        placed = placed.where(F.col("_on"))
    placed = materialize(placed.select("dem_id", "point_id", F.col("cell").alias("pour")))
    outlets = placed.select("dem_id", "pour").distinct()
    marked = linked.join(outlets.select("dem_id", F.col("pour").alias("cell"), F.lit(True).alias("_pour")), ["dem_id", "cell"], "left")
    end = F.col("_pour").isNotNull() | F.col("to").isNull()
    state = marked.select(
        "dem_id",
        "cell",
        F.when(~end, F.col("to")).alias("to"),
        end.alias("done"),
        F.when(F.col("_pour"), F.col("cell")).alias("pour"),
    )
    basins = _follow(
        state, lambda: {"pour": F.lit(None).cast("bigint")}, lambda: {"pour": F.col("v_pour")}, ["pour"]
    ).where(F.col("pour").isNotNull()).select("dem_id", "cell", "pour")
    # an outlet's parent is the outlet that its own downstream cell drains to
    steps = outlets.withColumnRenamed("pour", "cell").join(linked, ["dem_id", "cell"]).select("dem_id", F.col("cell").alias("pour"), F.col("to").alias("cell"))
    below = steps.join(basins.select("dem_id", "cell", F.col("pour").alias("parent")), ["dem_id", "cell"], "left")
    own = F.when(F.col("parent") != F.col("pour"), F.col("parent"))
    tree = materialize(cut_cycles(below.select(F.col("dem_id").alias("tree"), F.col("pour").alias("node"), own.alias("parent"))))
    spans = materialize(forest_intervals(tree))
    shared = spans.select("tree", F.col("node").alias("head"), "enter", "leave")
    labelled = tree.select("tree", "node", "head").join(shared, ["tree", "head"])
    outlets = labelled.select(F.col("tree").alias("dem_id"), F.col("node").alias("pour"), "enter", "leave", F.col("head"))
    discard(linked)
    return basins, materialize(outlets), placed


def delineate_catchments(cells: DataFrame, points: DataFrame, valid: str = "elevation", strict: bool = True) -> DataFrame:
    """All cells draining to each pour point (dem_id, point_id, row, col): rows (point_id, row, col).

    Each cell learns the nearest pour point below it; a catchment is then the union of those areas over the
    pour points inside its outlet's interval. Nested catchments repeat their cells, as they are the result;
    `catchment_means` needs no such rows.
    """
    basins, outlets, placed = outlet_tree(cells, points, valid, strict)
    heads = outlets.where(F.col("pour") == F.col("head")).select(F.col("dem_id").alias("tree"), F.col("pour").alias("node"), "enter", "leave")
    under = pairs_under(heads).select(F.col("tree").alias("dem_id"), F.col("node").alias("outlet_head"), F.col("under").alias("head"))
    members = under.join(outlets.select("dem_id", "head", "pour"), ["dem_id", "head"]).select("dem_id", "outlet_head", F.col("pour").alias("member"))
    at = placed.join(outlets.select("dem_id", "pour", F.col("head").alias("outlet_head")), ["dem_id", "pour"])
    owners = at.join(members, ["dem_id", "outlet_head"]).select("dem_id", F.col("member").alias("pour"), "point_id")
    inside = basins.join(owners, ["dem_id", "pour"])
    return inside.select(
        "dem_id",
        "point_id",
        F.floor(F.col("cell") / _BASE).cast("int").alias("row"),
        F.pmod(F.col("cell"), F.lit(_BASE)).cast("int").alias("col"),
    )


def catchment_means(
    cells: DataFrame, points: DataFrame, values: dict[str, str] | None = None, valid: str = "elevation", strict: bool = True
) -> DataFrame:
    """Cells and means of each pour point's catchment: dem_id, point_id, area_cells and what `values` names (column -> output).

    Every basin is summed once; a catchment's sums are differences of prefix sums along the outlets'
    tour, so nested catchments cost no pairs. Sums are decimals of nine places, which makes the differences exact.
    A mean leaves null and NaN out; a catchment without values has a null mean.
    """
    values = values or {}
    basins, outlets, placed = outlet_tree(cells, points, valid, strict)
    keyed = cells.select("dem_id", cell_key(F.col("row"), F.col("col")).alias("cell"), *values)
    met = basins.join(keyed, ["dem_id", "cell"])
    numbers = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)).cast("decimal(24,9)") for c in values}
    one = met.groupBy("dem_id", "pour").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(x), F.lit(0)).cast("decimal(34,9)").alias(f"s_{c}") for c, x in numbers.items()],
        *[F.count(x).alias(f"n_{c}") for c, x in numbers.items()],
    )
    sums = ["n", *[f"{k}_{c}" for c in values for k in "sn"]]
    spots = outlets.join(one, ["dem_id", "pour"], "left").na.fill(0, sums)
    per_head = materialize(spots.groupBy("dem_id", "head", "enter", "leave").agg(*[F.sum(c).alias(c) for c in sums]))
    opened = per_head.select("dem_id", "head", F.col("enter").alias("spot"), *sums)
    closed = per_head.select("dem_id", "head", F.col("leave").alias("spot"), *[F.lit(0).cast(per_head.schema[c].dataType).alias(c) for c in sums])
    upto = running_totals(opened.unionByName(closed), ["spot"], {c: f"upto_{c}" for c in sums})
    spans = upto.groupBy("dem_id", "head").agg(
        # between its two spots a head's totals grow by what lies under it; its own sums count from the first
        *[(F.max_by(f"upto_{c}", "spot") - F.min_by(f"upto_{c}", "spot") + F.min_by(c, "spot")).alias(f"all_{c}") for c in sums]
    )
    at = placed.join(outlets.select("dem_id", "pour", "head"), ["dem_id", "pour"]).join(spans, ["dem_id", "head"])
    return at.select(
        "dem_id", "point_id", F.col("all_n").alias("area_cells"),
        *[F.try_divide(F.col(f"all_s_{c}").cast("double"), F.col(f"all_n_{c}")).alias(n) for c, n in values.items()],
    )


def zonal_mean(catchments: DataFrame, cells: DataFrame, values: dict[str, str], zone: str = "point_id") -> DataFrame:
    """Mean of cell columns over each catchment: `values` maps column -> output name."""
    met = catchments.join(cells.select("dem_id", "row", "col", *values), ["dem_id", "row", "col"])
    return met.groupBy("dem_id", zone).agg(
        F.count(F.lit(1)).alias("area_cells"), *[F.avg(c).alias(n) for c, n in values.items()]
    )


def flow_stats(cells: DataFrame, value: str = "elevation") -> DataFrame:
    return cells.groupBy("dem_id").agg(
        F.count_if((F.col("flow_dir") == 0) & F.col(value).isNotNull()).alias("outlets"),
        F.count_if(F.col(value).isNull()).alias("nodata_cells"),
        F.max("flow_acc").alias("max_accumulation"),
        F.avg("flow_acc").alias("mean_accumulation"),
        F.count_if("is_channel").alias("channel_cells"),
    )


def flooded_share(flooded: DataFrame, cells: DataFrame, hand: str = "hand") -> DataFrame:
    valid = cells.groupBy("dem_id").agg(F.count(hand).alias("valid_cells"))
    return (
        flooded.groupBy("dem_id", "level")
        .agg(F.count(F.lit(1)).alias("flooded_cells"))
        .join(valid, "dem_id")
        .withColumn("flooded_percent", F.try_divide(100.0 * F.col("flooded_cells"), F.col("valid_cells")))
    )
