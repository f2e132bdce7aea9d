"""Connected regions of a cell set and their outlines.

A region, and even one ring around it, may span most of a raster, so neither is gathered into one
task. Regions are labelled by repeated minimum over row runs; ring vertices are numbered by pointer
doubling along the boundary, where every edge has exactly one successor. The result is a vertex
table (region, ring, position), which a sink may fold into GeoJSON.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from freshet.functions.series import salted_lookup
from freshet.operators.drainage import cell_key
from freshet.session import discard, materialize
from freshet.sources.rasters import M2_PER_DEGREE2


def regions(cells: DataFrame, keys: Sequence[str] = ("dem_id",)) -> DataFrame:
    """Label 4-connected regions of a sparse cell set; `region` is the region's first cell in row-major order."""
    keys = list(keys)
    row_line = W.partitionBy(*keys, "row").orderBy("col")
    begins = F.coalesce(F.lag("col").over(row_line) != F.col("col") - 1, F.lit(True))
    run_start = F.last(F.when(F.col("_begins"), F.col("col")), ignorenulls=True).over(
        row_line.rowsBetween(W.unboundedPreceding, 0)
    )
    runs = materialize(
        cells.select(*keys, "row", "col")
        .withColumn("_begins", begins)
        .withColumn("node", cell_key(F.col("row"), run_start))
        .drop("_begins")
    )
    col_line = W.partitionBy(*keys, "col").orderBy("row")
    upper = F.when(F.lag("row").over(col_line) == F.col("row") - 1, F.lag("node").over(col_line))
    touching = runs.select(*keys, F.col("node").alias("u"), upper.alias("v")).where(F.col("v").isNotNull()).distinct()
    edges = materialize(touching.unionByName(touching.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))))
    state = materialize(runs.select(*keys, "node").distinct().withColumn("p", F.col("node")))
    tables = [state]
    while True:
        # every run of a large region has the same parent, so that lookup is salted
        parents = state.select(*keys, F.col("node").alias("p"), F.col("p").alias("gp"))
        lifted = materialize(salted_lookup(state, parents, [*keys, "p"], ["node"], "inner"))
        offered = (
            edges.join(lifted.select(*keys, F.col("node").alias("v"), "gp"), [*keys, "v"])
            .groupBy(*keys, F.col("u").alias("node"))
            .agg(F.min("gp").alias("m"))
        )
        met = lifted.join(offered, [*keys, "node"], "left")
        low = F.least("gp", F.coalesce("m", F.col("gp")))
        offers = met.select(*keys, F.explode(F.array(F.col("node"), F.col("p"))).alias("node"), low.alias("_offer"))
        best = offers.groupBy(*keys, "node").agg(F.min("_offer").alias("_best"))
        moved = materialize(
            state.join(best, [*keys, "node"])
            .withColumn("_new", F.least("p", "_best"))
            .withColumn("_moved", F.col("_new") != F.col("p"))
            .select(*keys, "node", F.col("_new").alias("p"), "_moved")
        )
        discard(lifted, *tables)
        tables, state = [moved], moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            break
    discard(edges)
    return runs.join(state.withColumnRenamed("p", "region"), [*keys, "node"]).drop("node")


def boundary_edges(labelled: DataFrame, keys: Sequence[str] = ("dem_id",)) -> DataFrame:
    """Directed unit edges with the region on their left: corner (ar, ac) -> corner (br, bc)."""
    r, c = F.col("row"), F.col("col")

    def edge(ar, ac, br, bc, across, line):
        # `line` names the undirected edge, so an edge shared by two cells of the set has one name
        return F.struct(
            ar.alias("ar"), ac.alias("ac"), br.alias("br"), bc.alias("bc"), F.lit(across).alias("axis"), *line
        )

    def line(y, x):
        return (y.alias("ly"), x.alias("lx"))

    sides = F.array(
        edge(r, c + 1, r, c, "h", line(r, c)),
        edge(r + 1, c, r + 1, c + 1, "h", line(r + 1, c)),
        edge(r, c, r + 1, c, "v", line(r, c)),
        edge(r + 1, c + 1, r, c + 1, "v", line(r, c + 1)),
    )
    return (
        labelled.select(*keys, "region", F.explode(sides).alias("e"))
        .groupBy(*keys, "e.axis", "e.ly", "e.lx")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.first("region").alias("region"),
            F.first("e.ar").alias("ar"),
            F.first("e.ac").alias("ac"),
            F.first("e.br").alias("br"),
            F.first("e.bc").alias("bc"),
        )
        .where(F.col("_n") == 1)
        .select(*keys, "region", "ar", "ac", "br", "bc")
    )


def rings(labelled: DataFrame, keys: Sequence[str] = ("dem_id",)) -> DataFrame:
    """Boundary vertices of every region: (…keys, region, ring, position, vrow, vcol), open rings.

    `ring` and `position` count from the ring's smallest edge. Where two cells of a region touch
    only at a corner the path turns left, keeping to the cell it follows.
    """
    keys = list(keys)
    heading = (
        F.when(F.col("br") < F.col("ar"), 0)  # north
        .when(F.col("bc") < F.col("ac"), 1)  # west, a left turn from north
        .when(F.col("br") > F.col("ar"), 2)
        .otherwise(3)
    )
    edges = materialize(
        boundary_edges(labelled, keys).withColumn("dir", heading).withColumn(
            "edge", cell_key(F.col("ar"), F.col("ac")) * 4 + F.col("dir")
        )
    )
    outgoing = edges.select(
        *keys, "region", F.col("ar").alias("br"), F.col("ac").alias("bc"), F.col("edge").alias("next"), F.col("dir").alias("ndir")
    )
    turn = F.pmod(F.col("ndir") - F.col("dir") + 3, F.lit(4))  # 0 for a left turn
    linked = (
        edges.join(outgoing, [*keys, "region", "br", "bc"])
        .groupBy(*keys, "region", "edge")
        .agg(F.min_by("next", turn).alias("next"))
    )
    # the smallest edge of each cycle, learnt by doubling along successors
    linked = materialize(linked)
    state = materialize(linked.withColumn("ring", F.least("edge", "next")))
    tables = [state]
    while True:
        ahead = state.select(*keys, F.col("edge").alias("next"), F.col("next").alias("_to"), F.col("ring").alias("_ring"))
        moved = materialize(
            state.join(ahead, [*keys, "next"])
            .withColumn("_moved", F.col("_ring") < F.col("ring"))
            .select(*keys, "region", "edge", F.col("_to").alias("next"), F.least("ring", "_ring").alias("ring"), "_moved")
        )
        discard(*tables)
        tables, state = [moved], moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            break
    heads = state.select(*keys, "edge", "ring")
    # distance to the head, by doubling; the head is where counting ends
    steps = linked.join(heads, [*keys, "edge"]).select(
        *keys,
        "region",
        "ring",
        "edge",
        F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"),
        F.lit(1).cast("bigint").alias("left"),
    )
    state = materialize(steps)
    discard(linked, *tables)
    while not state.where(F.col("next").isNotNull()).isEmpty():
        ahead = state.select(*keys, F.col("edge").alias("next"), F.col("next").alias("_to"), F.col("left").alias("_left"))
        # edges whose count has ended look up a key of their own, which no edge has
        own = F.coalesce("next", -1 - F.col("edge"))
        before = state
        state = materialize(
            state.withColumn("next", own).join(ahead, [*keys, "next"], "left").select(
                *keys, "region", "ring", "edge", F.col("_to").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")
            )
        )
        discard(before)
    length = state.where(F.col("edge") == F.col("ring")).select(*keys, "ring", F.col("left").alias("_length"))
    return (
        salted_lookup(state, length, [*keys, "ring"], ["edge"], "inner")
        .join(edges.select(*keys, "edge", "ar", "ac"), [*keys, "edge"])
        .select(*keys, "region", "ring", (F.col("_length") - F.col("left")).alias("position"), F.col("ar").alias("vrow"), F.col("ac").alias("vcol"))
    )


def outline_vertices(ring_rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Add lon and lat of each ring vertex from the raster's affine terms."""
    m = meta.select("dem_id", "dx", "dy", "left", "top")
    return salted_lookup(ring_rows, m, ["dem_id"], ["vrow", "vcol"], "inner").withColumns(
        {"lon": F.col("left") + F.col("vcol") * F.col("dx"), "lat": F.col("top") + F.col("vrow") * F.col("dy")}
    ).drop("dx", "dy", "left", "top")


def region_geometry(vertices: DataFrame, keys: Sequence[str] = ("dem_id",)) -> DataFrame:
    """One polygon per region: its rings as JSON, shell first. The row holds the region's outline,
    which is what the record is for; use the vertex table where outlines may be huge."""
    keys = list(keys)
    point = F.struct("position", F.array("lon", "lat").alias("xy"))
    per_ring = vertices.groupBy(*keys, "region", "ring").agg(F.sort_array(F.collect_list(point)).alias("_p"))
    xy = F.transform("_p", lambda p: p["xy"])
    closed = per_ring.select(*keys, "region", "ring", F.concat(xy, F.slice(xy, 1, 1)).alias("ring_xy"))
    shells_first = F.struct((F.col("ring") != F.col("_shell")).alias("hole"), "ring", "ring_xy")
    # the ring holding the region's smallest edge bounds it from outside
    shell = F.min("ring").over(W.partitionBy(*keys, "region"))
    return (
        closed.withColumn("_shell", shell)
        .groupBy(*keys, "region")
        .agg(F.sort_array(F.collect_list(shells_first)).alias("_r"))
        .select(
            *keys,
            "region",
            F.to_json(
                F.struct(F.lit("Polygon").alias("type"), F.transform("_r", lambda r: r["ring_xy"]).alias("coordinates"))
            ).alias("geometry"),
            (F.size("_r") - 1).alias("holes"),
        )
    )


def flood_extent(flooded: DataFrame, meta: DataFrame) -> DataFrame:
    """Per raster and level: flooded cells, area, and number of separate regions."""
    labelled = regions(flooded, ("dem_id", "level"))
    counts = labelled.groupBy("dem_id", "level").agg(
        F.count(F.lit(1)).alias("num_cells"), F.count_distinct("region").alias("num_regions")
    )
    m = meta.select("dem_id", "dx", "dy", "crs", "is_geographic")
    area = F.col("num_cells") * F.abs(F.col("dx") * F.col("dy")) * F.when(F.col("is_geographic"), M2_PER_DEGREE2).otherwise(1.0)
    return counts.join(m, "dem_id").select(
        "dem_id", "level", "num_cells", "num_regions", F.round(area, 1).alias("area_m2"), F.round(area / 1e6, 3).alias("area_km2"), "crs"
    )


def catchment_outline(catchment: DataFrame, meta: DataFrame, zone: str = "point_id") -> DataFrame:
    """Outline vertices of each catchment's first region in row-major order, with its area columns."""
    keys = ("dem_id", zone)
    labelled = materialize(regions(catchment, keys))
    totals = labelled.groupBy(*keys).agg(F.count(F.lit(1)).alias("area_cells"), F.min("region").alias("region"))
    first = labelled.join(totals.select(*keys, "region"), [*keys, "region"], "left_semi")
    vertices = outline_vertices(rings(first, keys), meta)
    sized = totals.join(meta.select("dem_id", "dx", "crs"), "dem_id").select(
        *keys,
        "area_cells",
        F.round(F.col("area_cells") * F.col("dx") * F.col("dx"), 6).alias("area_deg2"),
        F.round(F.col("area_cells") * F.col("dx") * F.col("dx") * 111.32 * 111.32, 2).alias("area_km2_approx"),
        "crs",
    )
    return salted_lookup(vertices, sized, list(keys), ["vrow", "vcol"], "inner")
