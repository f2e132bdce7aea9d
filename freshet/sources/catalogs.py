"""Landslide catalogs and inventories from CSV."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Accepted box, date formats in order of trial, standard columns and known names.
DEFAULT_BBOX = {"min_lat": 6.0, "max_lat": 37.0, "min_lon": 68.0, "max_lon": 98.0}
DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy/M/d",
    "d-M-yyyy",
    "d/M/yyyy",
    "yyyy-M-d H:m:s",
    "yyyy/M/d H:m:s",
    "M/d/yyyy",
    "M-d-yyyy",
)
FIELD_WIDTH = {"yyyy": r"\d{4}", "d": r"\d{1,2}", "M": r"\d{1,2}", "H": r"\d{1,2}", "m": r"\d{1,2}", "s": r"\d{1,2}"}
CATALOG_SCHEMA = (
    "timestamp timestamp_ntz, lat double, lon double, event_type string, source string, "
    "location_name string, fatalities double"
)
CATALOG_COLUMNS = ("timestamp", "lat", "lon", "event_type", "source", "location_name", "fatalities")
CATALOG_NAMES = {
    "event_date": "timestamp",
    "latitude": "lat",
    "longitude": "lon",
    "landslide_category": "event_type",
    "location_description": "location_name",
    "fatality_count": "fatalities",
}
CATALOG_SOURCE = "NASA_GLC"
CUSTOM_SOURCE = "CUSTOM_"
DEFAULT_EVENT = "landslide"


def _shape(pattern: str) -> str:
    """Regular expression of the texts a format can possibly read."""
    return "^" + re.sub("yyyy|[dMHms]", lambda m: FIELD_WIDTH[m.group()], pattern) + "$"


def parse_date(text: Column) -> Column:
    """First format that fits, day before month; then Spark's own timestamp syntax; else null.

    Each attempt is guarded by the text's shape: a failed parse costs far more than the match.
    """
    tries = [F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMATS]
    return F.coalesce(*tries, text.try_cast("timestamp")).cast("timestamp_ntz")


def in_bbox(lat: Column, lon: Column, bbox: dict[str, float] = DEFAULT_BBOX) -> Column:
    inside = lat.between(bbox["min_lat"], bbox["max_lat"]) & lon.between(bbox["min_lon"], bbox["max_lon"])
    return F.coalesce(inside, F.lit(False))


def bbox_filter(df: DataFrame, bbox: dict[str, float] = DEFAULT_BBOX, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.where(in_bbox(F.col(lat), F.col(lon), bbox))


def _number(c: str) -> Column:
    value = F.col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def standardize(raw: DataFrame, names: dict[str, str], source: Column, bbox=DEFAULT_BBOX) -> DataFrame:
    """Rename, parse, and keep rows with a date and coordinates inside the box.

    A file without one of the required columns gives an empty table of the standard schema.
    """
    present = {new: F.col(f"`{old}`") for old, new in names.items() if old in raw.columns}
    for c in ("timestamp", "lat", "lon"):
        if c not in present and c in raw.columns:
            present[c] = F.col(c)
    if not {"timestamp", "lat", "lon"} <= set(present):
        return raw.sparkSession.createDataFrame([], CATALOG_SCHEMA)
    text = raw.select(*[v.cast("string").alias(k) for k, v in present.items()], source.alias("source"))
    absent = {"event_type": F.lit(DEFAULT_EVENT), "location_name": F.lit(None), "fatalities": F.lit(None)}
    text = text.withColumns({k: v.cast("string") for k, v in absent.items() if k not in present})
    parsed = text.select(
        parse_date(F.col("timestamp")).alias("timestamp"),
        _number("lat").alias("lat"),
        _number("lon").alias("lon"),
        "event_type",
        "source",
        "location_name",
        _number("fatalities").alias("fatalities"),
    )
    return bbox_filter(parsed, bbox).where(F.col("timestamp").isNotNull())


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    # every column as text: no inference pass over the files
    return spark.read.csv(path, header=True)


def read_landslide_catalog(spark: SparkSession, path: str) -> DataFrame:
    return standardize(_read_csv(spark, path), CATALOG_NAMES, F.lit(CATALOG_SOURCE))


def read_custom_catalog(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Caller-named columns; `source` is the stem of the file each row came from."""
    raw = _read_csv(spark, path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return standardize(raw, names, F.concat(F.lit(CUSTOM_SOURCE), stem))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    raw = _read_csv(spark, path)
    missing = [c for c in ("lat", "lon", "date") if c not in raw.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    casts = {"lat": "double", "lon": "double", "magnitude": "int"}
    return raw.select(
        *[
            F.to_date(parse_date(F.col(c))).alias(c) if c == "date" else F.col(c).cast(casts.get(c, "string")).alias(c)
            for c in raw.columns
        ]
    )


def normalize_catalog(df: DataFrame, bbox: dict[str, float] = DEFAULT_BBOX, strict: bool = True) -> DataFrame:
    """Drop undated rows and exact repeats of (timestamp, lat, lon), sort by time, check the box.

    With `strict`, a row outside the box fails the job when it is reached.
    """
    kind = dict(df.dtypes)["timestamp"]
    time = parse_date(F.col("timestamp")) if kind == "string" else F.col("timestamp").cast("timestamp_ntz")
    dated = df.withColumn("timestamp", time).where(F.col("timestamp").isNotNull())
    unique = dated.dropDuplicates(["timestamp", "lat", "lon"])
    if strict:
        inside = in_bbox(F.col("lat"), F.col("lon"), bbox)
        checked = F.when(inside, F.col("lat")).otherwise(
            F.raise_error(F.lit("Invalid coordinates found")).cast("double")
        )
        unique = unique.withColumn("lat", checked)
    return unique.orderBy("timestamp")
