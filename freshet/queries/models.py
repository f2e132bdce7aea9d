"""Model operators. SQL cannot fit trees; it checks what holds whatever the trees are."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import risk
from freshet.functions.clock import plus_hours
from freshet.operators import attribution, evaluation, explain, features, models, splits
from freshet.plans import landslide
from freshet.queries import learning
from freshet.queries.features import FLOOD_NAMES, W12_SQL, flood_rows
from freshet.queries.gauges import r
from freshet.queries.registry import GAUGE_USERS, query
from freshet.queries.travel import scratch
from freshet.session import materialize
from freshet.sources import datasets

FLOOD_THRESHOLD = 0.35
SLIDE_META = {*features.LANDSLIDE_META, "split"}
# Floors of the models' quality, from the reference figures.
FLOOD_AUC, FLOOD_RECALL, SLIDE_AUC = 0.5, 0.2, 0.1
_SAVED: dict[tuple, str] = {}

TEST = f"""featured AS ({W12_SQL}),
    o AS (SELECT *, row_number() OVER (ORDER BY "timestamp") - 1 AS i, count(*) OVER () AS n FROM featured),
    c AS (SELECT min("timestamp") AS cut FROM o WHERE i >= floor(n * 0.8)),
    test AS (SELECT station_id, "timestamp" FROM featured, c WHERE "timestamp" >= cut)"""
SLIDE_NAMES = learning.FEATURE_NAMES
SLIDE_ROWS = f"""complete AS (SELECT * FROM cell_features WHERE {' AND '.join(f'{n} IS NOT NULL' for n in SLIDE_NAMES)}),
    sampled AS (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || grid_id || '|' || date), grid_id, date) AS hr,
             count(*) FILTER (label = 1) OVER () AS np FROM complete) WHERE label = 1 OR hr <= 2 * np)"""


def split_rows(t):
    """Flood rows of both parts, made once per query: the model is fitted with the one, the other is scored."""
    if "flood" not in t.made:
        t.made["flood"] = materialize(splits.time_split(materialize(flood_rows(t))))
    return t.made["flood"]


def slide_rows(t):
    """The same for landslides."""
    if "landslide" not in t.made:
        rows = landslide.landslide_training_set(
            t.slides(), learning.terrain(t), learning.weather(t), learning.BBOX, learning.START, learning.END, learning.CELL_KM, ratio=2
        )
        t.made["landslide"] = materialize(splits.time_split(materialize(rows), time="date"))
    return t.made["landslide"]


def saved(t, hazard: str) -> str:
    """Folder of the model fitted with the hazard's whole profile, once per session and scale folder."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, hazard)
    if key not in _SAVED:
        if hazard == "flood":
            rows, names, profile = split_rows(t), FLOOD_NAMES, models.FLOOD
        else:
            rows, profile = slide_rows(t), models.LANDSLIDE
            names = features.feature_columns(rows, SLIDE_META)
        model = models.train(rows.where("split = 'train'").select("label", *names), names, profile)
        weights = models.importances(model)
        path = scratch(t)
        datasets.save_model_artifacts(model, path, [f for f, _ in weights], [w for _, w in weights], {"optimal_threshold": FLOOD_THRESHOLD})
        _SAVED[key] = path
    return _SAVED[key]


def loaded(t, hazard: str = "flood"):
    """(model, feature names, thresholds) from the saved folder."""
    return datasets.load_model_artifacts(t.spark, saved(t, hazard))


def test_rows(t):
    return split_rows(t).where("split = 'test'")


def in_range(p):
    return p.between(0, 1)


@query("m3_train")
def importance(t):
    model, _, _ = loaded(t)
    return t.spark.createDataFrame(models.importances(model), "feature string, importance double")


@query(
    "m3_train_facts",
    "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(FLOOD_NAMES))
    + ") AS f(position, feature), (SELECT 200 AS trees, true AS in_range, true AS sums_to_one)",
)
def importance_facts(t):
    """Feature order, number of trees and range of the saved importances; none depends on how trees split."""
    model, names, _ = loaded(t)
    listed = t.spark.read.schema("position int, feature string, importance double").json(f"{saved(t, 'flood')}/features")
    total = listed.agg(F.abs(F.sum("importance") - 1) < 1e-9)
    return listed.select(
        "position", "feature", F.lit(model.stages[-1].getNumTrees).alias("trees"), in_range(F.col("importance")).alias("in_range"),
        total.scalar().alias("sums_to_one"),
    )


@query("m4_score")
def scored(t):
    model, _, thresholds = loaded(t)
    out = models.score(model, test_rows(t), threshold=thresholds["optimal_threshold"])
    return out.select(
        "station_id", "timestamp", "hazard", "probability", "risk_level", "lead_time_hours", "confidence", "threshold_used"
    )


@query(
    "m4_score_facts",
    f"""WITH {TEST} SELECT station_id, "timestamp", true AS in_range, true AS level_fits, true AS rounded, 0.35::DOUBLE AS threshold_used
    FROM test""",
)
def score_facts(t):
    """A prediction for every test row; the risk level is that of the probability before it is rounded."""
    model, _, thresholds = loaded(t)
    rows = models.with_probability(model, test_rows(t)).withColumnRenamed("probability", "exact")
    out = models.score(model, rows, threshold=thresholds["optimal_threshold"])
    return out.select(
        "station_id", "timestamp", in_range(F.col("probability")).alias("in_range"),
        (F.col("risk_level") == risk.classify_risk(F.col("exact"))).alias("level_fits"),
        (F.col("probability") == F.round("exact", 4)).alias("rounded"), "threshold_used",
    )


@query("m4_score_evaluated")
def scored_metrics(t):
    model, _, _ = loaded(t)
    return evaluation.evaluate(models.with_probability(model, test_rows(t)), 0.5)


@query("m4_model_floors", "SELECT 'flood' AS hazard, true AS auc_floor, true AS recall_floor UNION ALL SELECT 'landslide', true, true")
def floors(t):
    """Both models on their test rows against the floors of their quality."""
    flood, _, _ = loaded(t)
    slide, _, _ = loaded(t, "landslide")
    of_flood = evaluation.evaluate(models.with_probability(flood, test_rows(t)), 0.5)
    of_slide = evaluation.evaluate(models.with_probability(slide, slide_rows(t).where("split = 'test'")), 0.5)
    return of_flood.select(
        F.lit("flood").alias("hazard"), (F.col("roc_auc") >= FLOOD_AUC).alias("auc_floor"), (F.col("recall") >= FLOOD_RECALL).alias("recall_floor")
    ).unionByName(
        of_slide.select(
            F.lit("landslide").alias("hazard"), (F.col("roc_auc") >= SLIDE_AUC).alias("auc_floor"), (F.col("recall") >= 0).alias("recall_floor")
        )
    )


@query(
    "m4_prediction_with_drivers",
    f"""WITH {TEST} SELECT station_id, "timestamp", 5 AS drivers, true AS strongest_first, true AS signed FROM test""",
)
def explained(t):
    """Every score with its five strongest drivers: as many, in order of size, each with its sign."""
    model, names, thresholds = loaded(t)
    out = attribution.predict_with_drivers(
        model, test_rows(t), names, ["station_id", "timestamp"], thresholds["optimal_threshold"], trees=trees(t)
    )
    sizes = F.transform("top_drivers", lambda d: F.abs(d["impact"].cast("double")))
    return out.select(
        "station_id", "timestamp", F.size("top_drivers").alias("drivers"), (F.sort_array(sizes, False) == sizes).alias("strongest_first"),
        F.forall("top_drivers", lambda d: d["impact"].rlike(r"^[+-]\d+\.\d{3}$")).alias("signed"),
    )


@query(
    "m2_landslide_training_set",
    f"""WITH {SLIDE_ROWS} SELECT grid_id, date, label, {', '.join(f'round({n}, 6) AS {n}' for n in SLIDE_NAMES)} FROM sampled""",
)
def slide_training(t):
    return slide_rows(t).select("grid_id", "date", "label", *[r(n) for n in SLIDE_NAMES])


@query(
    "m4_landslide_facts",
    f"""WITH {SLIDE_ROWS}, o AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM sampled),
    c AS (SELECT min(date) AS cut FROM o WHERE i >= floor(n * 0.8))
    SELECT grid_id, date, true AS in_range, true AS level_fits FROM sampled, c WHERE date >= cut""",
)
def slide_facts(t):
    """The landslide model's scores for every test row."""
    model, _, _ = loaded(t, "landslide")
    rows = models.with_probability(model, slide_rows(t).where("split = 'test'")).withColumnRenamed("probability", "exact")
    out = models.score(model, rows, hazard="landslide")
    return out.select(
        "grid_id", "date", in_range(F.col("susceptibility")).alias("in_range"),
        (F.col("risk_level") == risk.classify_risk(F.col("exact"))).alias("level_fits"),
    )


@query(
    "m5_landslide_inference_features",
    f"""WITH latest AS (SELECT grid_id, max(date) AS date, arg_max(rainfall_mm_ari_7d, date) AS ari_7d, arg_max(slope, date) AS slope
               FROM cell_features WHERE {' AND '.join(f'{n} IS NOT NULL' for n in SLIDE_NAMES)} AND date <= DATE '1998-06-15' GROUP BY 1)
    SELECT l_orderkey, l_linenumber, p.grid_id, latest.date, round(ari_7d, 6) AS rainfall_mm_ari_7d, round(slope, 6) AS slope
    FROM placed p LEFT JOIN latest USING (grid_id)""",
)
def slide_point_in_time(t):
    """Points find their grid cell and its latest features at or before a date."""
    full = materialize(landslide.labelled_cell_days(
        t.slides(), learning.terrain(t), learning.weather(t), learning.BBOX, learning.START, learning.END, learning.CELL_KM
    ))
    found = models.landslide_inference_features(
        t.slides(), features.landslide_features(full), "1998-06-15", learning.BBOX, learning.CELL_KM, key=("l_orderkey", "l_linenumber")
    )
    return found.select("l_orderkey", "l_linenumber", "grid_id", "date", r("rainfall_mm_ari_7d"), r("slope"))


@query(
    "m5_inference_features",
    """
    WITH k AS (SELECT catchment_id AS station_id, "timestamp", rainfall_mm FROM rain_daily),
    l AS (SELECT *, lag(rainfall_mm, 1) OVER w AS rainfall_mm_lag_1, lag(rainfall_mm, 7) OVER w AS rainfall_mm_lag_7,
                 sum(rainfall_mm) OVER (w ROWS 2 PRECEDING) AS rainfall_mm_3d_sum FROM k WINDOW w AS (PARTITION BY station_id ORDER BY "timestamp"))
    SELECT station_id, max("timestamp") AS "timestamp", round(arg_max(rainfall_mm, "timestamp"), 6) AS rainfall_mm,
           round(arg_max(rainfall_mm_lag_1, "timestamp"), 6) AS rainfall_mm_lag_1, round(arg_max(rainfall_mm_lag_7, "timestamp"), 6) AS rainfall_mm_lag_7,
           round(arg_max(rainfall_mm_3d_sum, "timestamp"), 6) AS rainfall_mm_3d_sum
    FROM l WHERE "timestamp" <= TIMESTAMP '1998-06-15 00:00:00' GROUP BY 1""",
)
def point_in_time(t):
    daily = t.rain_daily().withColumnRenamed("catchment_id", "station_id").select("station_id", "timestamp", "rainfall_mm")
    wide = features.windowed_features(daily, {"rainfall_mm": (1, 7)}, {"rainfall_mm": ((3,), ("sum",))}, step=24.0)
    return models.inference_features(wide, "1998-06-15 00:00:00").select(
        "station_id", "timestamp", *[r(c) for c in ("rainfall_mm", "rainfall_mm_lag_1", "rainfall_mm_lag_7", "rainfall_mm_3d_sum")]
    )


@query(
    "m5_request_features",
    """
    WITH k AS (SELECT catchment_id AS station_id, "timestamp", rainfall_mm FROM rain_hourly),
    l AS (SELECT *, lag(rainfall_mm, 1) OVER w AS rainfall_mm_lag_1, sum(rainfall_mm) OVER (w ROWS 2 PRECEDING) AS rainfall_mm_3d_sum
          FROM k WINDOW w AS (PARTITION BY station_id ORDER BY "timestamp")),
    asked AS (SELECT event_id, 'ST' || (user_id // 10) AS station_id, ts::TIMESTAMP - to_hours(event_id % 73 * 11) AS requested_at FROM events)
    SELECT event_id, asked.station_id, requested_at, "timestamp", round(rainfall_mm, 6) AS rainfall_mm,
           round(rainfall_mm_lag_1, 6) AS rainfall_mm_lag_1, round(rainfall_mm_3d_sum, 6) AS rainfall_mm_3d_sum
    FROM asked ASOF LEFT JOIN l ON asked.station_id = l.station_id AND requested_at >= "timestamp" """,
)
def at_own_time(t):
    """Every event asks for its station's features at a time of its own, up to 33 days before it."""
    hourly = t.rain_points().groupBy(F.col("catchment_id").alias("station_id"), "timestamp").agg(F.avg("precipitation").alias("rainfall_mm"))
    wide = features.windowed_features(hourly, {"rainfall_mm": (1,)}, {"rainfall_mm": ((3,), ("sum",))}, step=24.0)
    asked = t.read("events").select(
        "event_id", F.concat(F.lit("ST"), F.floor(F.col("user_id") / GAUGE_USERS)).alias("station_id"),
        plus_hours("ts", -(F.col("event_id") % 73 * 11)).alias("requested_at"),
    )
    return models.features_at(asked, wide).select(
        "event_id", "station_id", "requested_at", "timestamp", *[r(c) for c in ("rainfall_mm", "rainfall_mm_lag_1", "rainfall_mm_3d_sum")]
    )


@query(
    "m5_landslide_request_features",
    f"""WITH daily AS (SELECT * FROM cell_features WHERE {' AND '.join(f'{n} IS NOT NULL' for n in SLIDE_NAMES)}),
    asked AS (SELECT p.*, date + (l_orderkey % 40)::INTEGER AS asked_on FROM placed p)
    SELECT l_orderkey, l_linenumber, asked_on, a.grid_id, daily.date, round(daily.rainfall_mm_ari_7d, 6) AS rainfall_mm_ari_7d, round(daily.slope, 6) AS slope
    FROM asked a ASOF LEFT JOIN daily ON a.grid_id = daily.grid_id AND asked_on >= daily.date""",
)
def slide_at_own_day(t):
    """Points find the latest features of their grid cell up to a day of their own."""
    full = materialize(landslide.labelled_cell_days(
        t.slides(), learning.terrain(t), learning.weather(t), learning.BBOX, learning.START, learning.END, learning.CELL_KM
    ))
    asked = t.slides().withColumn("asked_on", F.date_add("date", (F.col("l_orderkey") % 40).cast("int"))).drop("date")
    found = models.landslide_features_at(asked, features.landslide_features(full), learning.BBOX, learning.CELL_KM, key=("l_orderkey", "l_linenumber"))
    return found.select("l_orderkey", "l_linenumber", "asked_on", "grid_id", "date", r("rainfall_mm_ari_7d"), r("slope"))


def trees(t, hazard: str = "flood"):
    return attribution.booster(attribution.booster_nodes(t.spark, f"{saved(t, hazard)}/model"))


@query("m6_attributions")
def attributed(t):
    """Exact contributions of every feature to the margin of every test row."""
    _, names, _ = loaded(t)
    made = attribution.attributions(trees(t), test_rows(t), names, ["station_id", "timestamp"])
    return made.select("station_id", "timestamp", "feature", r("contribution"), r("value"), r("base_value"), r("margin"))


def additive(model, boosted, rows, names, key):
    """Per row: number of features, number of missing values, and whether base value and contributions give the model's own margin."""
    made = attribution.attributions(boosted, rows, names, key)
    per_row = made.groupBy(*key).agg(
        F.count_distinct("feature").cast("int").alias("features"), (F.sum("contribution") + F.any_value("base_value")).alias("total"),
        F.count_if(F.col("value").isNull()).cast("int").alias("missing"),
    )
    own = models.with_margin(model, rows).select(*key, "model_margin")
    return per_row.join(own, key).withColumn("additive", F.abs(F.col("total") - F.col("model_margin")) < 1e-6)


MISSING_VALUES = " + ".join(f"({n} IS NULL)::INTEGER" for n in FLOOD_NAMES)


@query(
    "m6_additivity",
    f"""WITH {TEST.replace('SELECT station_id, "timestamp" FROM featured, c', 'SELECT featured.* FROM featured, c')}
    SELECT station_id, "timestamp", {len(FLOOD_NAMES)} AS features, {MISSING_VALUES} AS missing, true AS additive
    FROM test""",
)
def additivity(t):
    """Contributions and the base value sum to the raw margin of the model that Spark itself applies, for every test row."""
    model, names, _ = loaded(t)
    made = additive(model, trees(t), test_rows(t), names, ["station_id", "timestamp"])
    return made.select("station_id", "timestamp", "features", "missing", "additive")


@query(
    "m6_landslide_additivity",
    f"""WITH {SLIDE_ROWS}, o AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM sampled),
    c AS (SELECT min(date) AS cut FROM o WHERE i >= floor(n * 0.8))
    SELECT grid_id, date, 21 AS features, true AS additive FROM sampled, c WHERE date >= cut""",
)
def slide_additivity(t):
    """The same for the landslide model's test rows."""
    model, names, _ = loaded(t, "landslide")
    made = additive(model, trees(t, "landslide"), slide_rows(t).where("split = 'test'"), names, ["grid_id", "date"])
    return made.select("grid_id", "date", "features", "additive")


@query("m6_contributions")
def contributions(t):
    model, names, _ = loaded(t)
    return models.contributions(model, test_rows(t), names, ["station_id", "timestamp"]).select(
        "station_id", "timestamp", "feature", r("contribution"), r("value")
    )


@query(
    "m6_contribution_facts",
    f"""WITH {TEST} SELECT station_id, "timestamp", {len(FLOOD_NAMES)} AS features, true AS in_range FROM test""",
)
def contribution_facts(t):
    """Each test row has one contribution per feature, each a difference of two probabilities."""
    model, names, _ = loaded(t)
    made = models.contributions(model, test_rows(t), names, ["station_id", "timestamp"])
    return made.groupBy("station_id", "timestamp").agg(
        F.count_distinct("feature").cast("int").alias("features"), F.bool_and(F.col("contribution").between(-1, 1)).alias("in_range")
    )


@query("s12_model_artifacts")
def artifacts(t):
    model, names, thresholds = loaded(t)
    test = features.validate_features(test_rows(t).select("station_id", "timestamp", *FLOOD_NAMES), names, ("station_id", "timestamp"))
    return models.score(model, test, thresholds["optimal_threshold"]).select("station_id", "timestamp", "probability", "threshold_used")


@query(
    "s12_artifact_facts",
    f"""WITH {TEST} SELECT station_id, "timestamp", true AS same_score, 0.35::DOUBLE AS threshold_used FROM test""",
)
def artifact_facts(t):
    """A model that is saved, loaded, saved and loaded again scores every test row the same."""
    model, names, thresholds = loaded(t)
    path = scratch(t)
    weights = models.importances(model)
    datasets.save_model_artifacts(model, path, [f for f, _ in weights], [w for _, w in weights], thresholds)
    again, same_names, same_thresholds = datasets.load_model_artifacts(t.spark, path)
    if (same_names, same_thresholds) != (names, thresholds):
        raise ValueError("saved artifacts differ")
    rows = models.with_probability(model, test_rows(t)).withColumnRenamed("probability", "first")
    return models.with_probability(again, rows).select(
        "station_id", "timestamp", (F.col("first") == F.col("probability")).alias("same_score"),
        F.lit(thresholds["optimal_threshold"]).alias("threshold_used"),
    )
