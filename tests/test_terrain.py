"""Raster operators against brute force on small elevation tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.functions import tours
from freshet.functions.series import salted_lookup
from freshet.operators import drainage, extents, terrain
from freshet.session import materialize, prepare
from freshet.sources import rasters

OFFSETS = list(terrain.D8_OFFSET.items())


def cells(spark, dem, dem_id=1):
    rows = [
        (dem_id, r, c, None if np.isnan(v) else float(v)) for r, line in enumerate(np.asarray(dem, float)) for c, v in enumerate(line)
    ]
    return spark.createDataFrame(rows, rasters.CELL_SCHEMA)


def grid(df, column, shape, fill=np.nan):
    out = np.full(shape, fill, float)
    for row in df.select("row", "col", column).collect():
        if row[2] is not None:
            out[row[0], row[1]] = row[2]
    return out


def brute_flow(dem, uphill=False):
    code = np.zeros(dem.shape, int)
    for (r, c), v in np.ndenumerate(dem):
        best = -np.inf if uphill else 0.0
        for name, (dr, dc) in OFFSETS:
            y, x = r + dr, c + dc
            if np.isnan(v) or not (0 <= y < dem.shape[0] and 0 <= x < dem.shape[1]) or np.isnan(dem[y, x]):
                continue
            slope = (v - dem[y, x]) / (30 * (1.414 if dr and dc else 1.0))
            if slope > best:
                best, code[r, c] = slope, terrain.D8_CODE[name]
    return code


def step(code, r, c):
    name = next((n for n, k in terrain.D8_CODE.items() if k == code[r, c]), None)
    return None if name is None else (r + terrain.D8_OFFSET[name][0], c + terrain.D8_OFFSET[name][1])


def brute_acc(dem, code):
    acc = np.where(np.isnan(dem), np.nan, 0.0)
    for (r, c), v in np.ndenumerate(dem):
        at, seen = (r, c), set()
        while not np.isnan(v) and at is not None and at not in seen:
            acc[at] += 1
            seen.add(at)
            at = step(code, *at)
    return acc


def random_dem(seed, shape=(13, 11), holes=8):
    rng = np.random.default_rng(seed)
    dem = rng.integers(0, 40, shape).astype(float) + np.add.outer(np.arange(shape[0]) * -2.0, np.arange(shape[1]) * 1.0)
    dem.flat[rng.choice(dem.size, holes, replace=False)] = np.nan
    return dem


def test_bowl_drains_to_its_centre(spark):
    dem = np.array([[10, 9, 8], [9, 5, 7], [8, 7, 6]], float)
    acc = drainage.flow_accumulation(terrain.flow_direction(cells(spark, dem)))
    assert grid(acc, "flow_acc", dem.shape)[1, 1] == 9


def test_plane_catchment(spark):
    dem = 10.0 - np.add.outer(np.arange(5), np.arange(5))
    flow = terrain.flow_direction(cells(spark, dem))
    point = spark.createDataFrame([(1, "p", 4, 4)], "dem_id int, point_id string, row int, col int")
    assert drainage.delineate_catchments(flow, point).count() >= 20
    with pytest.raises(Exception, match="outside grid"):
        outside = spark.createDataFrame([(1, "p", 9, 9)], "dem_id int, point_id string, row int, col int")
        drainage.delineate_catchments(flow, outside).count()


@pytest.mark.parametrize("seed", [1, 2])
def test_flow_accumulation_hand_and_catchments_match_brute_force(spark, seed):
    dem = random_dem(seed)
    code = brute_flow(dem)
    flow = terrain.flow_direction(cells(spark, dem))
    assert (grid(flow, "flow_dir", dem.shape) == code).all()
    acc_df = terrain.channel_mask(drainage.flow_accumulation(flow), 6)
    acc = grid(acc_df, "flow_acc", dem.shape)
    want = brute_acc(dem, code)
    assert np.allclose(acc, want, equal_nan=True)
    hand_df = drainage.compute_hand(acc_df)
    hand = grid(hand_df, "hand", dem.shape)
    for (r, c), v in np.ndenumerate(dem):
        if np.isnan(v):
            continue
        at, base = (r, c), v
        while want[at] < 6 and step(code, *at) is not None:
            at = step(code, *at)
            base = dem[at]
        assert hand[r, c] == pytest.approx(max(0.0, v - base))
    assert (hand[acc >= 6] == 0).all()
    # nested pour points
    tops = [tuple(int(x) for x in np.unravel_index(i, dem.shape)) for i in np.argsort(-np.nan_to_num(want), axis=None)[:12:2]]
    points = spark.createDataFrame([(1, f"p{i}", r, c) for i, (r, c) in enumerate(tops)], "dem_id int, point_id string, row int, col int")
    found = drainage.delineate_catchments(flow, points).toPandas()
    for i, top in enumerate(tops):
        inside = set()
        for (r, c), v in np.ndenumerate(dem):
            at = (r, c)
            while not np.isnan(v) and at is not None and at != top:
                at = step(code, *at)
            if not np.isnan(v) and at == top:
                inside.add((r, c))
        got = found[found.point_id == f"p{i}"]
        assert set(zip(got.row, got.col)) == inside and len(got) == len(inside)
    # the same catchments as sums over the outlets' tour, in a second raster too
    two = flow.unionByName(flow.withColumn("dem_id", F.lit(2)))
    again = points.unionByName(points.withColumn("dem_id", F.lit(2)).limit(2))
    means = drainage.catchment_means(two, again, {"elevation": "mean_elevation"}).collect()
    assert len(means) == len(tops) + 2
    for m in means:
        mine = found[found.point_id == m.point_id]
        assert m.area_cells == len(mine)
        assert m.mean_elevation == pytest.approx(np.mean([dem[r, c] for r, c in zip(mine.row, mine.col)]), abs=1e-6)


def test_pour_points_on_one_cycle_share_a_catchment(spark):
    dem = np.array([[10, 9, 8], [9, 5, 7], [8, 7, 6]], float)
    flow = terrain.flow_direction(cells(spark, dem), allow_uphill=True)
    points = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 2, 2), (1, "b again", 2, 2), (1, "c", 0, 0)], "dem_id int, point_id string, row int, col int")
    found = drainage.delineate_catchments(flow, points).groupBy("point_id").count().collect()
    sizes = {r.point_id: r["count"] for r in found}
    assert sizes == {"a": 9, "b": 9, "b again": 9, "c": 1}
    assert {r.point_id: r.area_cells for r in drainage.catchment_means(flow, points).collect()} == sizes


@pytest.mark.parametrize("seed", [0, 1])
def test_forest_intervals_hold_what_lies_under_a_node(spark, seed):
    rng = np.random.default_rng(seed)
    parents = {k: (None if rng.random() < 0.15 else int(rng.integers(0, 60))) for k in range(60)}
    parents |= {100 + k: 99 + k for k in range(1, 30)} | {100: 5000}  # a chain, and a parent that is no node
    rows = [(t, k, p) for t in ("x", "y") for k, p in parents.items() if t == "x" or k % 2 or p is None]
    made = tours.cut_cycles(spark.createDataFrame(rows, "tree string, node bigint, parent bigint")).collect()
    heads, links = {(r.tree, r.node): r.head for r in made}, {(r.tree, r.node): r.parent for r in made}

    def above(tree, node):
        seen = [node]
        while (tree, seen[-1]) in links and links[tree, seen[-1]] is not None:
            seen.append(links[tree, seen[-1]])
            assert len(seen) <= len(links)
        return seen

    given = {(t, k): p for t, k, p in rows}
    for t, k, _ in rows:
        path, at = [k], given[t, k]
        while at is not None and (t, at) in given and at not in path:
            path.append(at)
            at = given[t, at]
        circle = set(path[path.index(at):]) if at in path else set()
        assert heads[t, k] == (min(circle) if k in circle else k)
        assert {heads[t, n] for n in path} == {heads[t, n] for n in above(t, k)}
    frame = spark.createDataFrame([(t, k, p) for (t, k), p in links.items()], "tree string, node bigint, parent bigint")
    spans = tours.forest_intervals(frame)
    pairs = {(r.tree, r.node, r.under) for r in tours.pairs_under(spans, block=7).collect()}
    assert pairs == {(t, a, k) for t, k in links for a in above(t, k)}
    assert tours.forest_intervals(frame.where("false")).count() == 0


def test_uphill_directions_make_cycles_that_are_reported(spark):
    dem = np.array([[10, 9, 8], [9, 5, 7], [8, 7, 6]], float)
    flow = terrain.flow_direction(cells(spark, dem), allow_uphill=True)
    assert (grid(flow, "flow_dir", dem.shape) == brute_flow(dem, uphill=True)).all()
    acc = grid(drainage.flow_accumulation(flow), "flow_acc", dem.shape)
    assert np.isnan(acc[1, 1]) and np.isnan(acc[2, 2]) and acc[0, 0] == 1
    hand = drainage.compute_hand(flow.withColumn("is_channel", F.lit(False)))
    assert hand.where("reached").count() == 0
    zero = drainage.compute_hand(flow.withColumn("is_channel", F.lit(False)), unreached_zero=True)
    assert zero.where("hand = 0").count() == 9


def test_hand_clamps_at_every_step(spark):
    # directions given by hand, running uphill in the middle: 0 <- 1 <- 2 <- 3
    rows = [(1, 0, 0, 5.0, 0), (1, 0, 1, 2.0, 16), (1, 0, 2, 4.0, 16), (1, 0, 3, 9.0, 16)]
    flow = spark.createDataFrame(rows, rasters.CELL_SCHEMA + ", flow_dir int").withColumn("is_channel", F.lit(False))
    assert grid(drainage.compute_hand(flow), "hand", (1, 4)).tolist() == [[0.0, 0.0, 2.0, 7.0]]


def test_filling_is_a_fixed_point(spark):
    dem = np.round(np.random.default_rng(3).random((15, 15)) * 20)
    once = terrain.fill_depressions(cells(spark, dem))
    filled = grid(once, "filled", dem.shape)
    twice = terrain.fill_depressions(cells(spark, filled))
    assert (grid(twice, "filled", dem.shape) == filled).all() and (filled >= dem).all() and (filled > dem).any()
    stats = terrain.fill_stats(once).first()
    assert stats.pits_filled == (filled > dem).sum()


def test_flats_and_their_gradient(spark):
    dem = np.full((7, 9), 3.0)
    dem[0, 0] = np.nan
    dem[5, 7] = 4.0
    out = terrain.resolve_flats(cells(spark, dem).withColumn("filled", F.col("elevation")))
    flat = grid(out, "is_flat", dem.shape).astype(bool)
    lift = grid(out, "conditioned", dem.shape) - dem
    distance = np.sqrt(np.add.outer(np.arange(7) ** 2, np.arange(9) ** 2))
    assert not flat[1, 1] and not flat[4, 6] and flat[3, 3]
    assert np.allclose(lift[flat], 1e-4 * distance[flat] / distance.max(), atol=1e-12)
    assert np.allclose(lift[~flat & ~np.isnan(dem)], 0)
    stats = terrain.flat_stats(out).first()
    assert stats.flats_resolved > 0


def test_distance_is_exact_and_null_without_nodata(spark):
    dem = random_dem(9, (20, 17), 5)
    got = grid(terrain.nodata_distance(cells(spark, dem)), "dist", dem.shape)
    voids = np.argwhere(np.isnan(dem))
    for (r, c), _ in np.ndenumerate(dem):
        assert got[r, c] == pytest.approx(np.sqrt(((voids - [r, c]) ** 2).sum(1).min()))
    assert terrain.nodata_distance(cells(spark, np.ones((3, 3)))).where("dist is not null").isEmpty()


def test_condition_keeps_valid_cells(spark):
    dem = random_dem(4)
    out, stats = terrain.condition_dem(cells(spark, dem))
    assert out.where("conditioned is not null").count() == stats.first().valid_cells == (~np.isnan(dem)).sum()


def test_slope_of_a_tilted_plane(spark):
    dem = np.add.outer(np.zeros(5), np.arange(5) * 30.0)  # rises eastward one to one
    out = terrain.slope_aspect_curvature(cells(spark, dem)).where("row = 2 and col = 2").first()
    assert out.slope == pytest.approx(45.0) and out.aspect == pytest.approx(270.0) and out.curvature == pytest.approx(0.0)


def test_flood_grows_with_level(spark):
    dem = random_dem(6)
    acc = terrain.channel_mask(drainage.flow_accumulation(terrain.flow_direction(cells(spark, dem))), 6)
    flooded = terrain.flood_mask(drainage.compute_hand(acc), [0.5, 1, 2, 3, 5, 50])
    counts = [r["count"] for r in flooded.groupBy("level").count().orderBy("level").collect()]
    assert counts == sorted(counts) and counts[-1] == (~np.isnan(dem)).sum()


def brute_regions(mask):
    label = np.zeros(mask.shape, int)
    n = 0
    for start in zip(*np.nonzero(mask)):
        if label[start]:
            continue
        n += 1
        stack = [start]
        while stack:
            r, c = stack.pop()
            if 0 <= r < mask.shape[0] and 0 <= c < mask.shape[1] and mask[r, c] and not label[r, c]:
                label[r, c] = n
                stack += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_regions_and_rings_match_brute_force(spark, seed):
    mask = np.random.default_rng(seed).random((12, 12)) < 0.6
    wanted = brute_regions(mask)
    rows = [(1, int(r), int(c)) for r, c in zip(*np.nonzero(mask))]
    labelled = extents.regions(spark.createDataFrame(rows, "dem_id int, row int, col int"))
    pdf = labelled.toPandas()
    pairs = {(wanted[r, c], g) for r, c, g in zip(pdf.row, pdf.col, pdf.region)}
    assert len(pairs) == wanted.max() == pdf.region.nunique() and len(pdf) == mask.sum()
    rings = extents.rings(labelled).toPandas().sort_values(["region", "ring", "position"])
    area = {}
    for (region, ring), part in rings.groupby(["region", "ring"]):
        assert part.position.tolist() == list(range(len(part)))
        x, y = part.vcol.to_numpy(float), -part.vrow.to_numpy(float)
        assert (np.abs(np.diff(np.r_[x, x[0]])) + np.abs(np.diff(np.r_[y, y[0]])) == 1).all()
        area[region] = area.get(region, 0.0) + (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2
    assert area == pdf.groupby("region").size().astype(float).to_dict()


def test_outline_geometry_has_shell_and_hole(spark):
    ring = [(1, r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    labelled = extents.regions(spark.createDataFrame(ring, "dem_id int, row int, col int"))
    meta = spark.createDataFrame([(1, 0.5, -0.5, 10.0, 20.0, None, "EPSG:4326", True)],
                                 "dem_id int, dx double, dy double, left double, top double, nodata double, crs string, is_geographic boolean")
    shape = extents.region_geometry(extents.outline_vertices(extents.rings(labelled), meta)).first()
    assert shape.holes == 1
    shell, hole = json.loads(shape.geometry)["coordinates"]
    assert len(shell) == 13 and len(hole) == 5 and shell[0] == shell[-1]
    extent = extents.flood_extent(labelled.drop("region").withColumn("level", F.lit(1.0)), meta).first()
    assert extent.num_cells == 8 and extent.num_regions == 1


def test_snapping_prefers_largest_then_first(spark):
    acc = np.ones((20, 20))
    acc[4, 9] = acc[9, 4] = 50
    df = cells(spark, acc).withColumn("flow_acc", F.col("elevation").cast("long"))
    points = spark.createDataFrame([(1, "a", 7, 7), (1, "b", 0, 0)], "dem_id int, point_id string, row int, col int")
    out = {r.point_id: (r.row, r.col) for r in drainage.snap_pour_points(points, df).collect()}
    assert out == {"a": (4, 9), "b": (0, 0)}


def test_dem_quality_warnings(spark):
    dem = np.full((2, 5), np.nan)
    dem[0, :3] = 7
    meta = spark.createDataFrame([(1, 0.001, -0.001, 91.0, 27.0, None, None, True)],
                                 "dem_id int, dx double, dy double, left double, top double, nodata double, crs string, is_geographic boolean")
    row = rasters.dem_quality(cells(spark, dem), meta).first()
    assert not row.valid and row.void_pct == 70.0 and len(row.warnings) == 3 and row.resolution == 111.32


def test_row_distance_is_the_nearest_void_on_wide_lines(spark):
    rng = np.random.default_rng(5)
    dem = np.where(rng.random((7, 300)) < 0.004, np.nan, 1.0)
    dem[3, 17] = np.nan
    void = np.argwhere(np.isnan(dem))
    found = grid(terrain.nodata_distance(cells(spark, dem)), "dist", dem.shape)
    for (r, c), _ in np.ndenumerate(dem):
        assert found[r, c] == pytest.approx(np.sqrt(((void - (r, c)) ** 2).sum(axis=1).min()))
    assert np.isnan(grid(terrain.nodata_distance(cells(spark, np.ones((3, 50)))), "dist", (3, 50))).all()


def test_loops_remove_the_tables_they_supersede(spark):
    import os

    from freshet.session import checkpoint_root

    root = checkpoint_root(spark).removeprefix("file:")
    flowing = terrain.flow_direction(cells(spark, [[40.0 - r - c for c in range(20)] for r in range(20)]))
    before = set(os.listdir(root))
    drainage.flow_accumulation(flowing).collect()
    assert len(set(os.listdir(root)) - before) == 1  # what the result reads


def test_compressed_tables_are_not_broadcast_unmeasured(spark):
    """Columns that compress well make small files, which say nothing of the rows that the driver would hold."""
    prepare(spark)
    wide = materialize(spark.range(300_000).select(F.lit(1).alias("dem_id"), "id", F.lit(0).alias("level")))
    tiny = materialize(spark.range(20).select(F.lit(1).alias("dem_id"), "id"))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" not in plan(wide.join(wide.select("dem_id", "id", F.col("level").alias("other")), ["dem_id", "id"]))
    assert "BroadcastHashJoin" not in plan(salted_lookup(wide, wide.select("id", F.col("level").alias("other")), ["id"], ["dem_id"]))
    assert "BroadcastHashJoin" in plan(wide.join(tiny, ["dem_id", "id"]))
