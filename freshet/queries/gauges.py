"""Gauge and rainfall series: checks, cleaning, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions.series import first_per_time, step_hours
from freshet.operators import quality
from freshet.operators.labels import label_floods, label_summary
from freshet.plans.flood import labelled_gauges
from freshet.queries.registry import CTES, query
from freshet.session import materialize


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


CTES.update(
    {
        "jumps": """
        SELECT *, coalesce(abs(water_level - lag(water_level) OVER w)
            / (epoch_ms("timestamp") - epoch_ms(lag("timestamp") OVER w)) * 3600000 > 3.0, false) AS is_jump
        FROM gauge WINDOW w AS (PARTITION BY station_id ORDER BY "timestamp")""",
        "steps": """
        SELECT station_id, median(h) AS step_hours FROM (
            SELECT station_id, (epoch_ms("timestamp") - epoch_ms(lag("timestamp")
                     OVER (PARTITION BY station_id ORDER BY "timestamp"))) / 3600000.0::DOUBLE AS h
            FROM jumps WHERE NOT is_jump) WHERE h IS NOT NULL GROUP BY 1""",
        "linked": """
        SELECT j.*, step_hours, lag("timestamp") OVER w AS p_ts, lag(water_level) OVER w AS p_level,
               (epoch_ms("timestamp") - epoch_ms(lag("timestamp") OVER w)) / 3600000.0::DOUBLE AS gap
        FROM jumps j LEFT JOIN steps USING (station_id) WHERE NOT is_jump
        WINDOW w AS (PARTITION BY station_id ORDER BY "timestamp")""",
        "filled_count": """
        SELECT *, CASE WHEN gap > 1.5 * step_hours AND gap <= 6 THEN trunc(gap / step_hours)::BIGINT - 1
                       ELSE 0 END AS n
        FROM linked""",
        "cleaned": """
        SELECT station_id, "timestamp", water_level, warning_level, danger_level,
               CASE WHEN gap > 1.5 * step_hours AND gap > 6 THEN 'gap' ELSE 'good' END AS quality_flag
        FROM filled_count
        UNION ALL
        SELECT station_id,
               make_timestamp(epoch_us(p_ts) + ((epoch_us("timestamp") - epoch_us(p_ts)) * (i / (n + 1)::DOUBLE))::BIGINT),
               p_level + (water_level - p_level) * (i / (n + 1)::DOUBLE), warning_level, danger_level, 'interpolated'
        FROM filled_count, unnest(range(1, greatest(n, 0) + 1)) AS t(i)""",
        "labelled": """
        SELECT *, max(CASE WHEN label = 1 THEN water_level END) OVER e AS peak_level,
               CASE WHEN label = 1 THEN (epoch_us(max("timestamp") OVER e) - epoch_us(min("timestamp") OVER e))
                    / 3.6e9::DOUBLE END AS event_duration_hours
        FROM (
          SELECT *, CASE WHEN label = 1 THEN sum(is_start) OVER (PARTITION BY station_id ORDER BY "timestamp") END::BIGINT AS event_id,
                 CASE WHEN label = 0 THEN (epoch_us(min(CASE WHEN crossing THEN "timestamp" END)
                     OVER (PARTITION BY station_id ORDER BY "timestamp" ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
                     - epoch_us("timestamp")) / 3.6e9::DOUBLE END AS lead_time_hours
          FROM (
            SELECT *, label = 1 AND lag(label) OVER w = 0 AS crossing,
                   (label = 1 AND coalesce(lag(label) OVER w, 0) = 0)::INTEGER AS is_start
            FROM (SELECT *, (coalesce(water_level >= danger_level, false))::INTEGER AS label FROM {source})
            WINDOW w AS (PARTITION BY station_id ORDER BY "timestamp")))
        WINDOW e AS (PARTITION BY station_id, label, event_id)""".replace(
            "{source}", "(SELECT * FROM cleaned WHERE quality_flag <> 'gap')"
        ),
    }
)
CTES["labelled_raw"] = CTES["labelled"].replace(
    "(SELECT * FROM cleaned WHERE quality_flag <> 'gap')", "gauge"
)

LABEL_COLUMNS = """station_id, "timestamp", round(water_level, 9) AS water_level, label,
    round(lead_time_hours, 6) AS lead_time_hours, event_id,
    round(event_duration_hours, 6) AS event_duration_hours, round(peak_level, 9) AS peak_level"""


def label_columns(df):
    return df.select(
        "station_id", "timestamp", r("water_level", 9), "label", r("lead_time_hours"), "event_id",
        r("event_duration_hours"), r("peak_level", 9),
    )


@query(
    "p2_validate_gauge",
    """
    SELECT station_id, count(*) AS rows, count(*) FILTER (water_level < 0) AS negatives,
           count(*) - count(DISTINCT "timestamp") AS duplicates,
           count(*) FILTER ("timestamp" < p) AS backward_steps,
           count(*) FILTER (water_level < 0) = 0 AND count(*) FILTER ("timestamp" < p) = 0
             AND count(*) = count(DISTINCT "timestamp") AS is_valid,
           concat_ws('; ',
             CASE WHEN count(*) FILTER (water_level < 0) > 0
                  THEN 'Found ' || count(*) FILTER (water_level < 0) || ' negative water level values' END,
             CASE WHEN count(*) FILTER ("timestamp" < p) > 0
                  THEN 'Timestamps are not monotonically increasing' END,
             CASE WHEN count(*) > count(DISTINCT "timestamp")
                  THEN 'Found ' || (count(*) - count(DISTINCT "timestamp")) || ' duplicate timestamps' END) AS errors
    FROM (SELECT *, lag("timestamp") OVER (PARTITION BY station_id ORDER BY seq) AS p FROM gauge_raw)
    GROUP BY station_id""",
)
def validate(t):
    report = quality.validate_gauge(t.gauge_raw())
    return report.withColumn("errors", F.array_join("errors", "; "))


@query(
    "w1_dedup_first",
    """SELECT station_id, "timestamp", round(arg_min(water_level, seq), 6) AS water_level, min(seq) AS seq
       FROM gauge_raw GROUP BY 1, 2""",
)
def dedup(t):
    return first_per_time(t.gauge_raw(), ["station_id"], "timestamp", "seq").select(
        "station_id", "timestamp", r("water_level"), "seq"
    )


@query(
    "a3_iqr_bounds",
    """
    WITH q AS (SELECT station_id, quantile_cont(water_level, 0.25) AS q1, quantile_cont(water_level, 0.75) AS q3
               FROM gauge GROUP BY 1)
    SELECT station_id, "timestamp", round(q1, 6) AS q1, round(q3, 6) AS q3,
           round(q1 - 0.5 * (q3 - q1), 6) AS lower_bound, round(q3 + 0.5 * (q3 - q1), 6) AS upper_bound,
           water_level < q1 - 0.5 * (q3 - q1) OR water_level > q3 + 0.5 * (q3 - q1) AS is_anomaly
    FROM gauge JOIN q USING (station_id)""",
)
def iqr(t):
    flagged = quality.detect_anomalies(t.gauge(), "water_level", method="iqr", threshold=0.5)
    return flagged.select(
        "station_id", "timestamp", r("q1"), r("q3"), r("lower_bound"), r("upper_bound"), "is_anomaly"
    )


@query(
    "a4_zscore",
    """
    SELECT station_id, "timestamp", round(abs(water_level - avg(water_level) OVER s)
             / nullif(stddev_samp(water_level) OVER s, 0), 6) AS z,
           coalesce(abs(water_level - avg(water_level) OVER s) / nullif(stddev_samp(water_level) OVER s, 0) > 2.0, false)
             AS is_anomaly
    FROM gauge WINDOW s AS (PARTITION BY station_id)""",
)
def zscore(t):
    flagged = quality.detect_anomalies(t.gauge(), "water_level", method="zscore", threshold=2.0)
    return flagged.select("station_id", "timestamp", r("z"), "is_anomaly")


@query(
    "a5_expected_interval",
    """
    SELECT station_id, round(median(h), 6) AS step_hours FROM (
        SELECT station_id, (epoch_ms("timestamp") - epoch_ms(lag("timestamp")
                 OVER (PARTITION BY station_id ORDER BY "timestamp"))) / 3600000.0::DOUBLE AS h FROM gauge)
    WHERE h IS NOT NULL GROUP BY 1""",
)
def interval(t):
    return step_hours(t.gauge(), ["station_id"], "timestamp").select("station_id", r("step_hours"))


@query("w4_jump_filter", 'SELECT station_id, "timestamp", round(water_level, 6) AS water_level, is_jump FROM jumps')
def jumps(t):
    return quality.jump_flags(t.gauge()).select("station_id", "timestamp", r("water_level"), "is_jump")


@query(
    "w5_gap_fill_even",
    """SELECT station_id, "timestamp", round(water_level, 9) AS water_level, warning_level, danger_level, quality_flag
       FROM cleaned""",
)
def clean(t):
    return quality.clean_levels(t.gauge(), arrival=None).withColumn("water_level", F.round("water_level", 9))


@query(
    "u2_clean_repaired",
    """SELECT station_id, "timestamp", round(water_level, 9) AS water_level, quality_flag FROM cleaned""",
)
def clean_repaired(t):
    return quality.clean_levels(t.gauge_raw(), repair=True).select(
        "station_id", "timestamp", r("water_level", 9), "quality_flag"
    )


@query(
    "p3_quality_filter",
    """SELECT station_id, "timestamp", round(water_level, 9) AS water_level, quality_flag FROM cleaned
       WHERE quality_flag IN ('good', 'interpolated')""",
)
def kept(t):
    return quality.keep_quality(quality.clean_levels(t.gauge(), arrival=None)).select(
        "station_id", "timestamp", r("water_level", 9), "quality_flag"
    )


@query(
    "a8_quality_summary",
    """SELECT station_id, count(*) AS rows, count(*) FILTER (quality_flag = 'good') AS good,
              count(*) FILTER (quality_flag = 'interpolated') AS interpolated,
              count(*) FILTER (quality_flag = 'gap') AS gap
       FROM cleaned GROUP BY 1""",
)
def flags(t):
    return quality.quality_summary(quality.clean_levels(t.gauge(), arrival=None))


@query("w6_flood_label", f"SELECT {LABEL_COLUMNS} FROM labelled_raw")
def labels(t):
    return label_columns(label_floods(materialize(t.gauge())))


@query(
    "w7_lead_time",
    """SELECT station_id, "timestamp", round(lead_time_hours, 6) AS lead_time_hours FROM labelled_raw WHERE label = 0""",
)
def lead(t):
    return label_floods(materialize(t.gauge())).where("label = 0").select("station_id", "timestamp", r("lead_time_hours"))


@query(
    "w8_event_islands",
    """SELECT station_id, event_id, count(*) AS rows, min("timestamp") AS started, max("timestamp") AS ended
       FROM labelled_raw WHERE event_id IS NOT NULL GROUP BY 1, 2""",
)
def islands(t):
    return (
        label_floods(materialize(t.gauge())).where("event_id IS NOT NULL").groupBy("station_id", "event_id")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"))
    )


@query(
    "a6_event_stats",
    """SELECT DISTINCT station_id, event_id, round(event_duration_hours, 6) AS event_duration_hours,
              round(peak_level, 9) AS peak_level FROM labelled_raw WHERE event_id IS NOT NULL""",
)
def event_stats(t):
    return (
        label_floods(materialize(t.gauge())).where("event_id IS NOT NULL")
        .select("station_id", "event_id", r("event_duration_hours"), r("peak_level", 9)).distinct()
    )


@query("m8_label_gauges", f"SELECT {LABEL_COLUMNS} FROM labelled")
def label_gauges(t):
    return label_columns(labelled_gauges(t.gauge(), arrival=None))


@query(
    "a7_label_summary",
    """SELECT station_id, count(*) AS total_points, sum(label)::BIGINT AS flood_points,
              round(100.0 * sum(label) / count(*), 2)::DOUBLE AS flood_percentage,
              coalesce(max(event_id), 0)::BIGINT AS num_events
       FROM labelled GROUP BY 1""",
)
def summary(t):
    return label_summary(labelled_gauges(t.gauge(), arrival=None))


CTES["rain_gaps"] = """
    SELECT *, (epoch_ms("timestamp") - epoch_ms(lag("timestamp") OVER w)) / 3600000.0::DOUBLE AS gap,
           lag("timestamp") OVER w AS p_ts, lag(rainfall_mm) OVER w AS p_rain, lag(temperature_2m) OVER w AS p_temp
    FROM rain_hourly WINDOW w AS (PARTITION BY catchment_id ORDER BY "timestamp")"""


def rain_hourly(t):
    from freshet.operators.catchments import areal_mean, catchment_rainfall

    return catchment_rainfall(areal_mean(t.rain_points(), ["precipitation", "temperature_2m"]))


@query(
    "w2_gap_flags",
    """SELECT catchment_id, "timestamp", round(gap, 6) AS gap_hours, coalesce(gap > 1.5, false) AS is_gap,
              CASE WHEN gap > 6 THEN 'gap' ELSE 'good' END AS quality_flag FROM rain_gaps""",
)
def rain_gap_flags(t):
    return quality.gap_flags(rain_hourly(t)).select(
        "catchment_id", "timestamp", r("gap_hours"), "is_gap", "quality_flag"
    )


@query(
    "w3_gap_fill_hourly",
    """
    SELECT catchment_id, "timestamp", round(rainfall_mm, 6) AS rainfall_mm, round(temperature_2m, 6) AS temperature_2m,
           CASE WHEN gap > 6 THEN 'gap' ELSE 'good' END AS quality_flag FROM rain_gaps
    UNION ALL
    SELECT catchment_id, p_ts + to_hours(i), round(p_rain + i / gap * (rainfall_mm - p_rain), 6),
           round(p_temp + i / gap * (temperature_2m - p_temp), 6), 'interpolated'
    FROM rain_gaps, unnest(range(1, greatest(floor(gap)::BIGINT - 1, 0) + 1)) AS t(i)
    WHERE gap > 1.5 AND gap <= 6""",
)
def rain_fill(t):
    return quality.sanitize_rain(rain_hourly(t)).select(
        "catchment_id", "timestamp", r("rainfall_mm"), r("temperature_2m"), "quality_flag"
    )
