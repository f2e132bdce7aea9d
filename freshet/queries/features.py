"""Catchment weather, training rows and engineered features."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import catchments, features
from freshet.plans.flood import flood_training_set
from freshet.queries.gauges import r, rain_hourly
from freshet.queries.registry import CTES, query

LAGS, WINDOWS = features.LAG_DAYS, features.ROLLING_DAYS

CTES.update(
    {
        "outlines": """
        SELECT 'ST' || s_suppkey AS station_id, x, y, s,
               [{'lon': x, 'lat': y}, {'lon': x + s, 'lat': y}, {'lon': x + s, 'lat': y + 0.8::DOUBLE * s},
                {'lon': x + 0.3::DOUBLE * s, 'lat': y + s}, {'lon': x, 'lat': y}] AS ring
        FROM (SELECT s_suppkey, 91 + (s_suppkey * 53 % 200) / 100.0::DOUBLE AS x,
                     26 + (s_suppkey * 37 % 200) / 100.0::DOUBLE AS y,
                     0.05::DOUBLE + 0.1::DOUBLE * (s_suppkey % 7) AS s FROM supplier)""",
        "outline_edges": """
        SELECT station_id, ring[i].lon AS x1, ring[i].lat AS y1, ring[i + 1].lon AS x2, ring[i + 1].lat AS y2
        FROM outlines, unnest(range(1, 5)) AS t(i)""",
        "outline_measures": """
        SELECT *, area_deg2 * 12321.0::DOUBLE * cos(radians((min_lat + max_lat) / 2)) AS area_km2 FROM (
          SELECT station_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area_deg2,
               sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS centroid_lon,
               sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS centroid_lat,
               min(x1) AS min_lon, max(x1) AS max_lon, min(y1) AS min_lat, max(y1) AS max_lat
          FROM outline_edges GROUP BY 1)""",
        "terrain": """
        SELECT station_id, area_km2 AS catchment_area, 5.0::DOUBLE AS mean_hand, 2.5::DOUBLE AS mean_slope
        FROM outline_measures""",
        "rain_steps": """
        SELECT catchment_id AS station_id, coalesce(median(h), 1.0) AS step FROM (
            SELECT catchment_id, (epoch_ms("timestamp") - epoch_ms(lag("timestamp")
                     OVER (PARTITION BY catchment_id ORDER BY "timestamp"))) / 3600000.0::DOUBLE AS h
            FROM rain_hourly) GROUP BY 1""",
        "rain_numbered": """
        SELECT catchment_id AS station_id, "timestamp", rainfall_mm, temperature_2m, step,
               row_number() OVER (PARTITION BY catchment_id ORDER BY "timestamp") AS rn
        FROM rain_hourly JOIN rain_steps ON station_id = catchment_id""",
        "training": """
        SELECT l.station_id, l."timestamp", l.label, l.water_level, l.quality_flag, rainfall_mm, temperature_2m,
               catchment_area, mean_hand, mean_slope
        FROM labelled l JOIN rain_hourly w ON w.catchment_id = l.station_id AND w."timestamp" = l."timestamp"
        LEFT JOIN terrain t ON t.station_id = l.station_id
        WHERE quality_flag = 'good'""",
        "training_steps": """
        SELECT station_id, coalesce(median(h), 1.0) AS step FROM (
            SELECT station_id, (epoch_ms("timestamp") - epoch_ms(lag("timestamp")
                     OVER (PARTITION BY station_id ORDER BY "timestamp"))) / 3600000.0::DOUBLE AS h
            FROM training) GROUP BY 1""",
    }
)


def lag_sql(source: str, column: str, days) -> str:
    return ", ".join(
        f"round(lag({column}, floor({d} * 24 / step)::INTEGER) OVER w, 6) AS {column}_lag_{d}" for d in days
    )


def roll_sql(column: str, days, aggs) -> str:
    names = {"sum": "sum", "mean": "avg", "max": "max"}
    return ", ".join(
        f"round({names[a]}({column}) OVER (PARTITION BY station_id ORDER BY \"timestamp\" ROWS BETWEEN "
        f"(greatest(floor({d} * 24 / step)::INTEGER, 1) - 1) PRECEDING AND CURRENT ROW), 6) AS {column}_{d}d_{a}"
        for d in days
        for a in aggs
    )


W12_SQL = f"""
    WITH wide AS (
      SELECT station_id, "timestamp", label, round(rainfall_mm, 6) AS rainfall_mm,
             round(temperature_2m, 6) AS temperature_2m, round(catchment_area, 6) AS catchment_area,
             mean_hand, mean_slope,
             {lag_sql("training", "rainfall_mm", LAGS)}, {lag_sql("training", "temperature_2m", LAGS)},
             {roll_sql("rainfall_mm", WINDOWS, ["sum"])}
      FROM training JOIN training_steps USING (station_id)
      WINDOW w AS (PARTITION BY station_id ORDER BY "timestamp"))
    SELECT * FROM wide WHERE rainfall_mm_lag_1 IS NOT NULL AND rainfall_mm_lag_2 IS NOT NULL AND rainfall_mm_lag_3 IS NOT NULL
      AND rainfall_mm_lag_5 IS NOT NULL AND rainfall_mm_lag_7 IS NOT NULL"""


def rain_series(t):
    return rain_hourly(t).withColumnRenamed("catchment_id", "station_id")


def outlines(t, key: str = "station_id"):
    k = F.col("s_suppkey")
    base = t.read("supplier").select(
        F.concat(F.lit("ST"), k).alias(key),
        (91 + (k * 53 % 200) / 100.0).alias("x"),
        (26 + (k * 37 % 200) / 100.0).alias("y"),
        (0.05 + F.lit(0.1) * (k % 7)).alias("s"),
    )
    x, y, s = F.col("x"), F.col("y"), F.col("s")

    def p(lon, lat):
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    ring = F.array(p(x, y), p(x + s, y), p(x + s, y + F.lit(0.8) * s), p(x + F.lit(0.3) * s, y + s), p(x, y))
    return base.select(key, ring.alias("ring"))


def training_set(t):
    weather = rain_series(t)
    terrain = catchments.terrain_from_outline(outlines(t))
    return flood_training_set(t.gauge(), weather, terrain, arrival=None)


def flood_rows(t):
    from freshet.session import materialize

    keep = ["station_id", "timestamp", "label", "rainfall_mm", "temperature_2m", *features.TERRAIN_COLUMNS]
    return features.flood_features(materialize(training_set(t).select(*keep)))


@query(
    "a1_areal_mean_precip",
    """SELECT catchment_id, "timestamp", round(avg(precipitation), 6) AS precipitation,
              round(avg(temperature_2m), 6) AS temperature_2m FROM rain_points GROUP BY 1, 2""",
)
def areal(t):
    return catchments.areal_mean(t.rain_points(), ["precipitation", "temperature_2m"]).select(
        "catchment_id", "timestamp", r("precipitation"), r("temperature_2m")
    )


@query(
    "j2_areal_align",
    """
    WITH a AS (SELECT * FROM rain_points WHERE point_id <= 'l'), b AS (SELECT * FROM rain_points WHERE point_id > 'l'),
         sa AS (SELECT catchment_id, "timestamp", sum(precipitation) s, count(*) n FROM a GROUP BY 1, 2),
         sb AS (SELECT catchment_id, "timestamp", sum(precipitation) s, count(*) n FROM b GROUP BY 1, 2)
    SELECT coalesce(sa.catchment_id, sb.catchment_id) AS catchment_id,
           coalesce(sa."timestamp", sb."timestamp") AS "timestamp",
           round((coalesce(sa.s, 0) + coalesce(sb.s, 0)) / (coalesce(sa.n, 0) + coalesce(sb.n, 0)), 6) AS precipitation
    FROM sa FULL JOIN sb ON sa.catchment_id = sb.catchment_id AND sa."timestamp" = sb."timestamp" """,
)
def align(t):
    points = t.rain_points()
    first, second = points.where("point_id <= 'l'"), points.where("point_id > 'l'")
    return catchments.areal_mean(first.unionByName(second), ["precipitation"]).select(
        "catchment_id", "timestamp", r("precipitation")
    )


@query(
    "p5_catchment_rainfall",
    """SELECT catchment_id, "timestamp", round(rainfall_mm, 6) AS rainfall_mm,
              round(temperature_2m, 6) AS temperature_2m FROM rain_hourly""",
)
def rainfall(t):
    return rain_hourly(t).select("catchment_id", "timestamp", r("rainfall_mm"), r("temperature_2m"))


@query(
    "a24_areal_rain_total",
    """SELECT catchment_id, round(sum(rainfall_mm), 4) AS total_rainfall_mm, round(avg(rainfall_mm), 6) AS mean_rainfall_mm,
              round(min(rainfall_mm), 6) AS min_rainfall_mm, round(max(rainfall_mm), 6) AS max_rainfall_mm
       FROM rain_hourly GROUP BY 1""",
)
def totals(t):
    return catchments.rain_totals(rain_hourly(t)).select(
        "catchment_id", r("total_rainfall_mm", 4), r("mean_rainfall_mm"), r("min_rainfall_mm"), r("max_rainfall_mm")
    )


@query(
    "a23_rain_24_48h",
    """SELECT catchment_id,
              round(coalesce(sum(rainfall_mm) FILTER ("timestamp"::DATE = DATE '2024-01-15'), 0), 6) AS rain_24h,
              round(coalesce(sum(rainfall_mm) FILTER ("timestamp"::DATE IN (DATE '2024-01-15', DATE '2024-01-16')), 0), 6) AS rain_48h
       FROM rain_hourly GROUP BY 1""",
)
def outlook(t):
    return catchments.rain_outlook(rain_hourly(t), "2024-01-15").select("catchment_id", r("rain_24h"), r("rain_48h"))


@query(
    "f23_sampling_points",
    """
    WITH cand AS (
      SELECT station_id, 1 + u.k AS no, CASE WHEN area_km2 < 1000 THEN [min_lat, min_lat, max_lat, max_lat][u.k + 1]
               ELSE min_lat + (u.k // 3 + 0.5::DOUBLE) * ((max_lat - min_lat) / 3) END AS lat,
             CASE WHEN area_km2 < 1000 THEN [min_lon, max_lon, min_lon, max_lon][u.k + 1]
               ELSE min_lon + (u.k % 3 + 0.5::DOUBLE) * ((max_lon - min_lon) / 3) END AS lon
      FROM outline_measures, unnest(range(0, CASE WHEN area_km2 < 100 THEN 0 WHEN area_km2 < 1000 THEN 4 ELSE 9 END)) AS u(k)),
    tested AS (
      SELECT station_id, no, c.lat, c.lon,
             count(*) FILTER ((y1 > c.lat) <> (y2 > c.lat) AND c.lon < (x2 - x1) * (c.lat - y1) / (y2 - y1) + x1) % 2 = 1
             OR count(*) FILTER ((x2 - x1) * (c.lat - y1) - (y2 - y1) * (c.lon - x1) = 0
               AND c.lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND c.lat BETWEEN least(y1, y2) AND greatest(y1, y2)) > 0
             AS inside
      FROM cand c JOIN outline_edges USING (station_id) GROUP BY 1, 2, 3, 4),
    allp AS (SELECT station_id, 0 AS no, centroid_lat AS lat, centroid_lon AS lon FROM outline_measures
             UNION ALL SELECT station_id, no, lat, lon FROM tested WHERE inside)
    SELECT station_id AS catchment_id, (row_number() OVER (PARTITION BY station_id ORDER BY no) - 1)::INTEGER AS point_no,
           round(lat, 6) AS lat, round(lon, 6) AS lon FROM allp""",
)
def points(t):
    return catchments.sampling_points(outlines(t, "catchment_id")).select(
        "catchment_id", "point_no", r("lat"), r("lon")
    )


@query(
    "f24_terrain_from_polygon",
    "SELECT station_id, round(catchment_area, 6) AS catchment_area, mean_hand, mean_slope FROM terrain",
)
def terrain(t):
    return catchments.terrain_from_outline(outlines(t)).withColumn("catchment_area", F.round("catchment_area", 6))


@query(
    "f28_request_key",
    """SELECT station_id, substr(sha256(concat_ws('_', 'historical', station_id, printf('%.6f', x), printf('%.6f', y))), 1, 16) AS key
       FROM outlines""",
)
def request_keys(t):
    ring = F.col("ring")
    return outlines(t).select(
        "station_id",
        catchments.request_key(
            F.lit("historical"),
            F.col("station_id"),
            F.format_string("%.6f", ring[0]["lon"]),
            F.format_string("%.6f", ring[0]["lat"]),
        ).alias("key"),
    )


@query(
    "j1_gauge_weather",
    """SELECT station_id, g."timestamp", round(water_level, 6) AS water_level, round(rainfall_mm, 6) AS rainfall_mm
       FROM gauge g JOIN rain_hourly w ON w.catchment_id = g.station_id AND w."timestamp" = g."timestamp" """,
)
def gauge_weather(t):
    return t.gauge().join(rain_series(t), ["station_id", "timestamp"]).select(
        "station_id", "timestamp", r("water_level"), r("rainfall_mm")
    )


@query(
    "j3_terrain_lookup",
    """SELECT station_id, "timestamp", round(catchment_area, 6) AS catchment_area, mean_hand, mean_slope
       FROM gauge LEFT JOIN terrain USING (station_id)""",
)
def terrain_lookup(t):
    from freshet.functions.series import salted_lookup

    joined = salted_lookup(t.gauge(), catchments.terrain_from_outline(outlines(t)), ["station_id"], ["timestamp"])
    return joined.select("station_id", "timestamp", r("catchment_area"), "mean_hand", "mean_slope")


@query(
    "m1_build_flood_dataset",
    """SELECT station_id, "timestamp", label, round(water_level, 6) AS water_level, quality_flag,
              round(rainfall_mm, 6) AS rainfall_mm, round(temperature_2m, 6) AS temperature_2m,
              round(catchment_area, 6) AS catchment_area, mean_hand, mean_slope FROM training""",
)
def flood_dataset(t):
    return training_set(t).select(
        "station_id", "timestamp", "label", r("water_level"), "quality_flag", r("rainfall_mm"),
        r("temperature_2m"), r("catchment_area"), "mean_hand", "mean_slope",
    )


@query(
    "a9_dataset_summary",
    """SELECT count(*) AS rows, count(DISTINCT station_id) AS stations, round(avg(label), 6) AS positive_rate,
              min("timestamp") AS first_time, max("timestamp") AS last_time FROM training""",
)
def dataset_summary(t):
    return training_set(t).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("station_id").alias("stations"),
        F.round(F.avg("label"), 6).alias("positive_rate"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )


@query(
    "w9_lag_features",
    f"""SELECT station_id, "timestamp", {lag_sql("rain_numbered", "rainfall_mm", LAGS)}
        FROM rain_numbered WINDOW w AS (PARTITION BY station_id ORDER BY "timestamp")""",
)
def lags(t):
    out = features.lag_features(rain_series(t), ["rainfall_mm"])
    return out.select("station_id", "timestamp", *[r(f"rainfall_mm_lag_{d}") for d in LAGS])


@query(
    "w10_rolling_features",
    f"""SELECT station_id, "timestamp", {roll_sql("rainfall_mm", WINDOWS, ["sum", "mean", "max"])} FROM rain_numbered""",
)
def rolling(t):
    out = features.rolling_features(rain_series(t), ["rainfall_mm"])
    names = [f"rainfall_mm_{d}d_{a}" for d in WINDOWS for a in ("sum", "mean", "max")]
    return out.select("station_id", "timestamp", *[r(n) for n in names])


@query(
    "w10_rolling_known_step",
    f"""WITH k AS (SELECT catchment_id AS station_id, "timestamp", rainfall_mm, 24 AS step FROM rain_daily)
        SELECT station_id, "timestamp", {roll_sql("rainfall_mm", WINDOWS, ["sum", "max"])},
               {lag_sql("k", "rainfall_mm", LAGS)}
        FROM k WINDOW w AS (PARTITION BY station_id ORDER BY "timestamp")""",
)
def rolling_known(t):
    daily = t.rain_daily().withColumnRenamed("catchment_id", "station_id")
    out = features.windowed_features(
        daily, {"rainfall_mm": LAGS}, {"rainfall_mm": (WINDOWS, ("sum", "max"))}, step=24.0
    )
    names = [f"rainfall_mm_{d}d_{a}" for d in WINDOWS for a in ("sum", "max")] + [f"rainfall_mm_lag_{d}" for d in LAGS]
    return out.select("station_id", "timestamp", *[r(n) for n in names])


FLOOD_NAMES = (
    ["rainfall_mm", "temperature_2m", "catchment_area", "mean_hand", "mean_slope"]
    + [f"rainfall_mm_lag_{d}" for d in LAGS]
    + [f"temperature_2m_lag_{d}" for d in LAGS]
    + [f"rainfall_mm_{d}d_sum" for d in WINDOWS]
)


@query("w12_flood_features", W12_SQL)
def flood_feature_rows(t):
    return flood_rows(t).select("station_id", "timestamp", "label", *[r(n) for n in FLOOD_NAMES])


@query(
    "p7_validate_features",
    f"SELECT station_id, \"timestamp\", {', '.join(FLOOD_NAMES)} FROM ({W12_SQL})",
)
def validated(t):
    rows = flood_rows(t).drop("label")
    ordered = features.validate_features(rows, FLOOD_NAMES, keep=("station_id", "timestamp"))
    return ordered.select("station_id", "timestamp", *[r(n) for n in FLOOD_NAMES])


@query(
    "p6_feature_columns",
    f"WITH k AS ({W12_SQL}) " + " UNION ALL ".join(f"SELECT '{n}' AS feature, count({n}) AS filled FROM k" for n in FLOOD_NAMES),
)
def feature_list(t):
    rows = flood_rows(t)
    names = features.feature_columns(rows)
    filled = rows.agg(*[F.count(n).alias(n) for n in names])
    return filled.unpivot([], names, "feature", "filled")


@query(
    "p8_check_static",
    """SELECT 'catchment_area' AS feature, true AS present UNION ALL SELECT 'mean_hand', true
       UNION ALL SELECT 'mean_slope', true UNION ALL SELECT 'elevation', false""",
)
def static_check(t):
    wanted = [*features.TERRAIN_COLUMNS, "elevation"]
    terrain = catchments.terrain_from_outline(outlines(t))
    report = features.static_report(terrain.columns, wanted)
    counted = terrain.agg(F.count(F.lit(1)).alias("n"))
    flags = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(c in report["present"]).alias("present")) for c in wanted])
    return counted.select(F.inline(flags))


@query(
    "p9_drop_incomplete",
    f"""WITH k AS (SELECT catchment_id AS station_id, "timestamp", rainfall_mm, 24 AS step FROM rain_daily),
        l AS (SELECT station_id, "timestamp", {lag_sql("k", "rainfall_mm", LAGS)} FROM k
              WINDOW w AS (PARTITION BY station_id ORDER BY "timestamp"))
        SELECT * FROM l WHERE rainfall_mm_lag_7 IS NOT NULL AND rainfall_mm_lag_5 IS NOT NULL
          AND rainfall_mm_lag_3 IS NOT NULL AND rainfall_mm_lag_2 IS NOT NULL AND rainfall_mm_lag_1 IS NOT NULL""",
)
def complete(t):
    daily = t.rain_daily().withColumnRenamed("catchment_id", "station_id")
    out = features.drop_incomplete(features.lag_features(daily, ["rainfall_mm"], step=24.0))
    return out.select("station_id", "timestamp", *[r(f"rainfall_mm_lag_{d}") for d in LAGS])
