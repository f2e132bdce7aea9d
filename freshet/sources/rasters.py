"""Elevation rasters as cell tables (dem_id, row, col, elevation) with one `dem_meta` row each.

A cell table is dense: every in-grid cell has a row, nodata cells with a null elevation. `dem_meta`
holds dem_id, the affine terms (dx, dy, left, top; dy negative when rows run south), nodata, crs
and is_geographic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.functions.series import salted_lookup

# Metres per degree, quality limits, request buffer.
METRES_PER_DEGREE = 111320.0
MIN_RESOLUTION_M, MAX_RESOLUTION_M, WARN_RESOLUTION_M = 20.0, 40.0, 100.0
MAX_VOID_PERCENTAGE = 30.0
BUFFER_DEGREES = 0.01
KM2_PER_DEGREE2_EQUATOR = 111.32 * 111.32
M2_PER_DEGREE2 = 111000.0**2

CELL_SCHEMA = "dem_id int, row int, col int, elevation double"


def read_cells(spark: SparkSession, path: str, meta: DataFrame | None = None, fmt: str = "parquet") -> DataFrame:
    """Cell table with nodata turned into null; `meta` supplies each raster's nodata value."""
    reader = spark.read.schema(CELL_SCHEMA)
    cells = reader.csv(path, header=True) if fmt == "csv" else reader.parquet(path)
    return cells if meta is None else nodata_to_null(cells, meta)


def nodata_to_null(cells: DataFrame, meta: DataFrame) -> DataFrame:
    # one raster may hold most cells: salted
    joined = salted_lookup(cells, meta.select("dem_id", "nodata"), ["dem_id"], ["row", "col"])
    void = F.isnan("elevation") | F.col("elevation").eqNullSafe(F.col("nodata"))
    return joined.withColumn("elevation", F.when(~void, F.col("elevation"))).drop("nodata")


def resolution_m(dx: Column, dy: Column, geographic: Column) -> Column:
    mean = (F.abs(dx) + F.abs(dy)) / 2
    return F.when(geographic, mean * METRES_PER_DEGREE).otherwise(mean)


def latlon_to_cell(points: DataFrame, meta: DataFrame) -> DataFrame:
    """Row and column of each point (dem_id, lat, lon) in its raster."""
    m = meta.select("dem_id", "dx", "dy", "left", "top")
    return salted_lookup(points, m, ["dem_id"], ["lat", "lon"], "inner").withColumns(
        {
            "row": F.floor((F.col("lat") - F.col("top")) / F.col("dy")).cast("int"),
            "col": F.floor((F.col("lon") - F.col("left")) / F.col("dx")).cast("int"),
        }
    ).drop("dx", "dy", "left", "top")


def buffered_bbox(df: DataFrame, buffer: float = BUFFER_DEGREES) -> DataFrame:
    """Box columns widened by `buffer` degrees, with `is_valid` when the given box was not inverted."""
    ok = (F.col("min_lon") < F.col("max_lon")) & (F.col("min_lat") < F.col("max_lat"))
    return df.withColumn("is_valid", ok).withColumns(
        {
            "min_lon": F.col("min_lon") - buffer,
            "min_lat": F.col("min_lat") - buffer,
            "max_lon": F.col("max_lon") + buffer,
            "max_lat": F.col("max_lat") + buffer,
        }
    )


def dem_quality(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Void share, elevation range, resolution, warnings and overall validity of each raster."""
    stats = cells.groupBy("dem_id").agg(
        F.count(F.lit(1)).alias("_cells"),
        F.count("elevation").alias("_valid"),
        F.round(F.min("elevation"), 2).alias("min_elev"),
        F.round(F.max("elevation"), 2).alias("max_elev"),
    )
    res = resolution_m(F.col("dx"), F.col("dy"), F.col("is_geographic"))
    joined = stats.join(meta, "dem_id").withColumns(
        {"_res": res, "_void": 100.0 * (F.col("_cells") - F.col("_valid")) / F.col("_cells")}
    )
    r, void = F.col("_res"), F.col("_void")
    warnings = F.array(
        F.when(r < MIN_RESOLUTION_M, F.format_string("Resolution (%.1fm) finer than expected (20-40m)", r))
        .when(r > WARN_RESOLUTION_M, F.format_string("Resolution (%.1fm) too coarse (>100.0m)", r))
        .when(r > MAX_RESOLUTION_M, F.format_string("Resolution (%.1fm) outside optimal range (20-40m)", r)),
        F.when(F.col("nodata").isNull(), F.lit("No NoData value defined")),
        F.when(void > MAX_VOID_PERCENTAGE, F.format_string("Excessive voids: %.1f%% (max 30.0%%)", void)),
        F.when(F.col("_valid") == 0, F.lit("No valid elevation data found")),
    )
    valid = (
        F.col("crs").isNotNull() & (r <= WARN_RESOLUTION_M) & (void <= MAX_VOID_PERCENTAGE) & (F.col("_valid") > 0)
    )
    return joined.select(
        "dem_id",
        valid.alias("valid"),
        "crs",
        F.round(r, 2).alias("resolution"),
        "nodata",
        "min_elev",
        "max_elev",
        F.round(void, 2).alias("void_pct"),
        F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"),
    )


def cell_area(cells: Column, dx: Column, dy: Column, method: str = "equator_km2", mid_lat: Column | None = None) -> Column:
    """Area of a number of cells: "deg2", "equator_km2" (square cells), "metre_km2" or "latitude_km2"."""
    degrees = cells * F.abs(dx) * F.abs(dy)
    if method == "deg2":
        return degrees
    if method == "equator_km2":
        return cells * dx * dx * KM2_PER_DEGREE2_EQUATOR
    if method == "metre_km2":
        return degrees * (M2_PER_DEGREE2 / 1e6)
    if method == "latitude_km2":
        return degrees * (111.0**2) * F.cos(F.radians(mid_lat))
    raise ValueError(f"Unknown area method: {method}")
