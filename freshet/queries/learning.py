"""Grid labels, sampling, splits, metrics and contribution rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import evaluation, explain, features, grid, splits
from freshet.operators.labels import label_floods
from freshet.plans import landslide
from freshet.queries.gauges import r
from freshet.queries.registry import CTES, query
from freshet.session import materialize

BBOX = (91.0, 25.0, 92.0, 26.0)
CELL_KM = 10.0
START, END = "1995-01-01", "2002-12-31"
STEP = "(10.0::DOUBLE / 111.0::DOUBLE)"

CTES.update(
    {
        "grid": f"""
        SELECT ix, iy, printf('CELL_%04d_%04d', ix, iy) AS grid_id, 91.0::DOUBLE + ix * {STEP} AS min_lon,
               25.0::DOUBLE + iy * {STEP} AS min_lat
        FROM unnest(range(0, 12)) AS a(ix), unnest(range(0, 12)) AS b(iy)""",
        "placed": f"""
        SELECT *, printf('CELL_%04d_%04d', floor((lon - 91.0) / {STEP})::BIGINT, floor((lat - 25.0) / {STEP})::BIGINT) AS grid_id
        FROM slides""",
        "cell_events": "SELECT grid_id, date, count(*)::INTEGER AS num_events FROM placed GROUP BY 1, 2",
        "cell_labels": f"""
        SELECT g.grid_id, d.day::DATE AS date, coalesce(num_events, 0) AS num_events, (num_events IS NOT NULL)::INTEGER AS label
        FROM grid g, unnest(range(TIMESTAMP '{START}', TIMESTAMP '{END}' + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d(day)
        LEFT JOIN cell_events e ON e.grid_id = g.grid_id AND e.date = d.day::DATE""",
        "cell_weather": """
        SELECT printf('CELL_%04d_%04d', o_orderkey % 4, o_custkey % 3) AS grid_id, o_orderdate::DATE AS date,
               sum(o_totalprice) / 97000 AS rainfall_mm, 15 + avg(o_totalprice) / 29000 AS temperature
        FROM orders GROUP BY 1, 2""",
        "cell_terrain": """
        SELECT printf('CELL_%04d_%04d', p_partkey // 12 % 12, p_partkey % 12) AS grid_id, avg(p_retailprice) / 41 AS slope,
               avg(p_size) * 7 / 3 AS aspect, (avg(p_size) - 25) / 370 AS curvature, max(p_retailprice) AS elevation
        FROM part GROUP BY 1""",
        "cell_days": """
        SELECT l.*, slope, aspect, curvature, elevation, rainfall_mm, temperature
        FROM cell_labels l LEFT JOIN cell_terrain t ON t.grid_id = l.grid_id
        LEFT JOIN cell_weather w ON w.grid_id = l.grid_id AND w.date = l.date""",
        "cell_sampled": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || grid_id || '|' || date), grid_id, date) AS hr,
                              count(*) FILTER (label = 1) OVER () AS np FROM cell_days)
        WHERE label = 1 OR hr <= 2 * np""",
        "cell_features": """
        SELECT * FROM (
          SELECT grid_id, date, label, rainfall_mm, slope, curvature,
                 sum(rainfall_mm) OVER (w ROWS 2 PRECEDING) AS rainfall_mm_ari_3d,
                 sum(rainfall_mm) OVER (w ROWS 6 PRECEDING) AS rainfall_mm_ari_7d,
                 sum(rainfall_mm) OVER (w ROWS 13 PRECEDING) AS rainfall_mm_ari_14d,
                 sum(rainfall_mm) OVER (w ROWS 29 PRECEDING) AS rainfall_mm_ari_30d,
                 lag(rainfall_mm, 1) OVER w AS rainfall_mm_lag_1, lag(rainfall_mm, 3) OVER w AS rainfall_mm_lag_3,
                 lag(rainfall_mm, 7) OVER w AS rainfall_mm_lag_7, lag(temperature, 1) OVER w AS temperature_lag_1,
                 lag(temperature, 3) OVER w AS temperature_lag_3, lag(temperature, 7) OVER w AS temperature_lag_7
          FROM cell_days WINDOW w AS (PARTITION BY grid_id ORDER BY date))""",
    }
)


def placed(t):
    return grid.points_in_grid(t.slides(), BBOX, CELL_KM)


def cell_labels(t):
    return grid.grid_day_labels(grid.spatial_grid(t.spark, BBOX, CELL_KM), placed(t), START, END)


def weather(t):
    return (
        t.read("orders")
        .groupBy(
            grid.cell_name(F.col("o_orderkey") % 4, F.col("o_custkey") % 3).alias("grid_id"),
            F.col("o_orderdate").cast("date").alias("date"),
        )
        .agg((F.sum("o_totalprice") / 97000).alias("rainfall_mm"), (15 + F.avg("o_totalprice") / 29000).alias("temperature"))
    )


def terrain(t):
    k = F.col("p_partkey")
    return (
        t.read("part")
        .groupBy(grid.cell_name(F.floor(k / 12) % 12, k % 12).alias("grid_id"))
        .agg(
            (F.avg("p_retailprice") / 41).alias("slope"),
            (F.avg("p_size") * 7 / 3).alias("aspect"),
            ((F.avg("p_size") - 25) / 370).alias("curvature"),
            F.max("p_retailprice").alias("elevation"),
        )
    )


@query(
    "f22_grid_cells",
    f"""SELECT grid_id, ix::INTEGER AS ix, iy::INTEGER AS iy, round(min_lon, 9) AS min_lon, round(min_lat, 9) AS min_lat,
               round(min_lon + {STEP} / 2, 9) AS center_lon, count(l_orderkey) AS slides
        FROM grid LEFT JOIN placed USING (grid_id) GROUP BY ALL""",
)
def cells(t):
    counts = placed(t).groupBy("grid_id").agg(F.count(F.lit(1)).alias("slides"))
    made = grid.spatial_grid(t.spark, BBOX, CELL_KM).join(counts, "grid_id", "left")
    return made.select(
        "grid_id", "ix", "iy", r("min_lon", 9), r("min_lat", 9), r("center_lon", 9),
        F.coalesce("slides", F.lit(0)).alias("slides"),
    )


@query("j6_points_in_grid", "SELECT l_orderkey, l_linenumber, round(lat, 6) AS lat, round(lon, 6) AS lon, grid_id FROM placed")
def in_grid(t):
    return placed(t).select("l_orderkey", "l_linenumber", r("lat"), r("lon"), "grid_id")


@query("a2_events_per_cell_day", "SELECT grid_id, date, num_events FROM cell_events")
def per_day(t):
    return grid.events_per_cell_day(placed(t))


@query("a10_monthly_distribution", "SELECT month(date)::INTEGER AS month, count(*) AS events FROM slides GROUP BY 1")
def monthly(t):
    return grid.monthly_distribution(t.slides())


@query("f29_month_parts", "SELECT l_orderkey, l_linenumber, month(date)::INTEGER AS month, date FROM slides")
def months(t):
    return t.slides().select("l_orderkey", "l_linenumber", F.month("date").alias("month"), "date")


@query("j4_grid_day_labels", "SELECT grid_id, date, num_events, label FROM cell_labels")
def day_labels(t):
    return cell_labels(t).select("grid_id", "date", "num_events", "label")


@query(
    "j5_grid_features",
    """SELECT grid_id, date, label, round(slope, 6) AS slope, round(aspect, 6) AS aspect, round(curvature, 6) AS curvature, elevation
       FROM cell_labels LEFT JOIN cell_terrain USING (grid_id)""",
)
def with_terrain(t):
    return grid.grid_features(cell_labels(t), terrain(t)).select(
        "grid_id", "date", "label", r("slope"), r("aspect"), r("curvature"), "elevation"
    )


@query("t10_negative_sampling", "SELECT grid_id, date, label, num_events FROM cell_sampled")
def sampled(t):
    return grid.negative_sampling(materialize(cell_labels(t)), 2).select("grid_id", "date", "label", "num_events")


@query(
    "m2_build_landslide_dataset",
    """SELECT grid_id, date, num_events, label, round(slope, 6) AS slope, round(aspect, 6) AS aspect, round(curvature, 6) AS curvature,
              elevation, round(rainfall_mm, 6) AS rainfall_mm, round(temperature, 6) AS temperature FROM cell_sampled""",
)
def slide_dataset(t):
    made = landslide.landslide_dataset(t.slides(), terrain(t), weather(t), BBOX, START, END, CELL_KM, ratio=2)
    return made.select(
        "grid_id", "date", "num_events", "label", r("slope"), r("aspect"), r("curvature"), "elevation", r("rainfall_mm"), r("temperature")
    )


@query(
    "w11_ari",
    """SELECT grid_id, date, round(rainfall_mm_ari_3d, 6) AS rainfall_mm_ari_3d, round(rainfall_mm_ari_7d, 6) AS rainfall_mm_ari_7d,
              round(rainfall_mm_ari_14d, 6) AS rainfall_mm_ari_14d, round(rainfall_mm_ari_30d, 6) AS rainfall_mm_ari_30d
       FROM (SELECT grid_id, date, rainfall_mm, sum(rainfall_mm) OVER (w ROWS 2 PRECEDING) AS rainfall_mm_ari_3d,
                 sum(rainfall_mm) OVER (w ROWS 6 PRECEDING) AS rainfall_mm_ari_7d, sum(rainfall_mm) OVER (w ROWS 13 PRECEDING) AS rainfall_mm_ari_14d,
                 sum(rainfall_mm) OVER (w ROWS 29 PRECEDING) AS rainfall_mm_ari_30d
             FROM cell_weather WINDOW w AS (PARTITION BY grid_id ORDER BY date))""",
)
def ari(t):
    return features.antecedent_rainfall(weather(t)).select(
        "grid_id", "date", *[r(f"rainfall_mm_ari_{d}d") for d in features.ARI_DAYS]
    )


FEATURE_NAMES = [
    *[f"rainfall_mm_ari_{d}d" for d in features.ARI_DAYS],
    *[f"{c}_lag_{d}" for c in ("rainfall_mm", "temperature") for d in (1, 3, 7)],
]


@query(
    "w13_landslide_features",
    f"""SELECT grid_id, date, label, {', '.join(f'round({n}, 6) AS {n}' for n in FEATURE_NAMES)},
               round(rainfall_mm_ari_3d, 6) AS rainfall_mm_3d_sum, round(slope * rainfall_mm, 6) AS slope_rainfall_interaction,
               round(slope * rainfall_mm_ari_14d, 6) AS slope_ari14d_interaction,
               round(curvature * rainfall_mm, 6) AS curvature_rainfall_interaction
        FROM cell_features WHERE {' AND '.join(f'{n} IS NOT NULL' for n in FEATURE_NAMES)}""",
)
def slide_features(t):
    from freshet.session import materialize

    full = materialize(landslide.labelled_cell_days(t.slides(), terrain(t), weather(t), BBOX, START, END, CELL_KM))
    names = [
        *FEATURE_NAMES, "rainfall_mm_3d_sum", "slope_rainfall_interaction", "slope_ari14d_interaction",
        "curvature_rainfall_interaction",
    ]
    return features.landslide_features(full).select("grid_id", "date", "label", *[r(n) for n in names])


@query(
    "p12_physics_interactions",
    """SELECT grid_id, date, round(slope * rainfall_mm, 6) AS slope_rainfall_interaction,
              round(curvature * rainfall_mm, 6) AS curvature_rainfall_interaction FROM cell_days""",
)
def interactions(t):
    full = landslide.labelled_cell_days(t.slides(), terrain(t), weather(t), BBOX, START, END, CELL_KM)
    return features.physics_interactions(full).select(
        "grid_id", "date", r("slope_rainfall_interaction"), r("curvature_rainfall_interaction")
    )


# --- metrics ---

CONFUSION = """
    SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
           coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0)::DOUBLE, 0) AS f2
    FROM (SELECT {group} count(*) FILTER (probability >= {cut} AND label = 1) AS tp, count(*) FILTER (probability >= {cut} AND label = 0) AS fp,
                 count(*) FILTER (probability < {cut} AND label = 1) AS fn, count(*) FILTER (probability < {cut} AND label = 0) AS tn FROM {source})"""
CTES["confusion"] = CONFUSION.format(group="", cut="0.5::DOUBLE", source="scored")
CTES["sweep"] = CONFUSION.format(
    group="threshold,", cut="threshold",
    source="(SELECT 0.1::DOUBLE + ((0.1::DOUBLE + 0.05::DOUBLE) - 0.1::DOUBLE) * i AS threshold, s.* FROM scored s, unnest(range(0, 17)) AS t(i)) GROUP BY threshold",
)
CTES["ranked"] = """
    SELECT sum(pos * (cp / (cp + cn)::DOUBLE)) / max(tot_p) AS pr_auc, sum(neg * (cp - pos + pos / 2.0)) / (max(tot_p) * max(tot_n)) AS roc_auc
    FROM (SELECT *, sum(pos) OVER (ORDER BY probability DESC) AS cp, sum(neg) OVER (ORDER BY probability DESC) AS cn,
                 sum(pos) OVER () AS tot_p, sum(neg) OVER () AS tot_n
          FROM (SELECT probability, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY 1))"""


@query(
    "a12_confusion_metrics",
    """SELECT tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives, round(precision, 6) AS precision,
              round(recall, 6) AS recall, round(f1, 6) AS f1_score, round(f2, 6) AS f2_score, 0.5::DOUBLE AS threshold FROM confusion""",
)
def confusion(t):
    m = evaluation.confusion_metrics(t.scored(), 0.5)
    return m.select(
        "true_negatives", "false_positives", "false_negatives", "true_positives", r("precision"), r("recall"), r("f1_score"),
        r("f2_score"), "threshold",
    )


@query("a13_roc_pr_auc", "SELECT round(roc_auc::DOUBLE, 6) AS roc_auc, round(pr_auc::DOUBLE, 6) AS pr_auc FROM ranked")
def auc(t):
    return evaluation.ranking_metrics(t.scored()).select(r("roc_auc"), r("pr_auc"))


@query(
    "a14_threshold_sweep",
    "SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1, round(f2, 6) AS f2, round(recall, 6) AS recall FROM sweep",
)
def sweep(t):
    return evaluation.threshold_scores(t.scored()).select(r("threshold"), r("f1"), r("f2"), r("recall"))


@query(
    "a14_optimal_threshold",
    "SELECT round(threshold, 6) AS optimal_threshold, round(f2, 6) AS best_score FROM sweep ORDER BY f2 DESC, threshold LIMIT 1",
)
def best(t):
    return evaluation.optimal_threshold(t.scored()).select(r("optimal_threshold"), r("best_score"))


@query(
    "a11_class_balance",
    """WITH s AS (SELECT label, CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM scored)
       SELECT split, sum(label)::BIGINT AS positive, (count(*) - sum(label))::BIGINT AS negative, round(avg(label), 3) AS ratio FROM s GROUP BY 1""",
)
def balance(t):
    split = F.when(F.col("id") % 5 == 0, "test").otherwise("train")
    return evaluation.class_balance(t.scored().withColumn("split", split))


@query(
    "a11_scale_pos_weight",
    "SELECT round(coalesce(count(*) FILTER (label = 0) / nullif(count(*) FILTER (label = 1), 0)::DOUBLE, 1.0), 6) AS scale_pos_weight FROM scored",
)
def weight(t):
    return evaluation.scale_pos_weight(t.scored()).select(r("scale_pos_weight"))


@query(
    "a15_lead_time_stats",
    """SELECT round(avg(lead_time_hours), 6) AS mean_lead_time_hours, round(median(lead_time_hours), 6) AS median_lead_time_hours,
              round(min(lead_time_hours), 6) AS min_lead_time_hours, round(max(lead_time_hours), 6) AS max_lead_time_hours
       FROM labelled_raw WHERE water_level >= 49 AND label = 0 AND lead_time_hours IS NOT NULL""",
)
def lead_stats(t):
    warned = label_floods(materialize(t.gauge())).withColumn("prediction", (F.col("water_level") >= F.col("warning_level")).cast("int"))
    stats = evaluation.lead_time_stats(warned)
    return stats.select(*[r(c) for c in stats.columns])


@query(
    "m7_evaluate",
    """SELECT tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives, round(precision, 6) AS precision,
              round(recall, 6) AS recall, round(f1, 6) AS f1_score, round(f2, 6) AS f2_score, 0.5::DOUBLE AS threshold,
              round(roc_auc::DOUBLE, 6) AS roc_auc, round(pr_auc::DOUBLE, 6) AS pr_auc FROM confusion, ranked""",
)
def evaluated(t):
    m = evaluation.evaluate(t.scored(), 0.5)
    rounded = ["precision", "recall", "f1_score", "f2_score", "roc_auc", "pr_auc"]
    return m.select(
        "true_negatives", "false_positives", "false_negatives", "true_positives", *[r(c) for c in rounded], "threshold"
    )


# --- splits ---


@query(
    "t8_time_split",
    """
    WITH o AS (SELECT *, row_number() OVER (ORDER BY "timestamp") - 1 AS i, count(*) OVER () AS n FROM gauge),
    c AS (SELECT min("timestamp") AS cut FROM o WHERE i >= floor(n * 0.8))
    SELECT station_id, "timestamp", CASE WHEN "timestamp" < cut THEN 'train' ELSE 'test' END AS split FROM gauge, c""",
)
def by_time(t):
    return splits.time_split(t.gauge()).select("station_id", "timestamp", "split")


@query(
    "t8_positional_split",
    """SELECT station_id, "timestamp", CASE WHEN row_number() OVER (ORDER BY station_id, "timestamp") - 1 < floor(count(*) OVER () * 0.8)
              THEN 'train' ELSE 'test' END AS split FROM gauge""",
)
def by_position(t):
    return splits.time_split(t.gauge(), mode="positional").select("station_id", "timestamp", "split")


@query(
    "t9_stratified_split",
    """SELECT id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id)
              <= round(count(*) OVER (PARTITION BY label) * 0.2) THEN 'test' ELSE 'train' END AS split FROM scored""",
)
def stratified(t):
    return splits.stratified_split(t.scored(), ["id"]).select("id", "label", "split")


# --- contributions ---

CTES["ranked_drivers"] = """
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, feature) AS rank FROM contributions"""


@query(
    "t1_top_drivers",
    "SELECT row_id, "
    + ", ".join(
        f"max(feature) FILTER (rank = {i}) AS top{i}_feature, round(max(contribution) FILTER (rank = {i}), 6) AS top{i}_contribution, round(max(contribution * 3) FILTER (rank = {i}), 6) AS top{i}_value"
        for i in range(1, 6)
    )
    + " FROM ranked_drivers GROUP BY 1",
)
def drivers(t):
    wide = explain.top_drivers(t.contributions().withColumn("value", F.col("contribution") * 3))
    return wide.select(
        "row_id", *[c for i in range(1, 6) for c in (F.col(f"top{i}_feature"), r(f"top{i}_contribution"), r(f"top{i}_value"))]
    )


@query(
    "t2_driver_strings",
    """SELECT row_id, string_agg(feature || CASE WHEN contribution >= 0 THEN '+' ELSE '-' END || printf('%.3f', abs(contribution)), ' ' ORDER BY rank) AS top_drivers
       FROM ranked_drivers WHERE rank <= 5 GROUP BY 1""",
)
def strings(t):
    joined = F.transform("top_drivers", lambda d: F.concat(d["feature"], d["impact"]))
    return explain.driver_strings(t.contributions()).select("row_id", F.array_join(joined, " ").alias("top_drivers"))


@query(
    "t3_ranked_contributions",
    "SELECT row_id, feature, round(contribution, 6) AS contribution, rank::INTEGER AS rank FROM ranked_drivers",
)
def all_ranked(t):
    return explain.ranked_contributions(t.contributions()).select("row_id", "feature", r("contribution"), "rank")


@query(
    "t4_top_features",
    """SELECT feature, round(importance, 6) AS importance FROM (SELECT feature, avg(abs(contribution)) AS importance FROM contributions GROUP BY 1)
       ORDER BY importance DESC, feature LIMIT 5""",
)
def important(t):
    mean = t.contributions().groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))
    return explain.top_features(mean).select("feature", r("importance"))


@query("u3_positives_and_negatives", "SELECT label, count(*) AS rows FROM cell_sampled GROUP BY 1")
def united(t):
    return grid.negative_sampling(materialize(cell_labels(t)), 2).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
