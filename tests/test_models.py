"""Exact attribution against all feature subsets, and the weather store's keyed merge."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import attribution, models
from freshet.operators.zones import combined_risk
from freshet.queries import models as model_queries
from freshet.queries.registry import Tables
from freshet.session import checkpoint_root
from freshet.sources import datasets

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.range(600).select(
        "id", *[F.when(F.rand(k) > 0.05, F.rand(k + 10)).alias(n) for k, n in enumerate(NAMES)], F.rand(30).alias("noise")
    )
    rows = rows.withColumn("label", ((F.coalesce("a", F.lit(0.4)) + F.col("noise") * F.coalesce("b", F.lit(2.0))) > 0.9).cast("int")).cache()
    model = models.train(rows.drop("id"), NAMES, models.Profile(depth=4, rate=0.3, trees=6, feature_share="0.7"))
    path = f"{checkpoint_root(spark)}/model-of-tests"
    model.write().overwrite().save(path)
    return rows, model, path


def expectation(trees, row, known):
    """The margin's path-dependent expectation when only the features in `known` are known."""
    total = 0.0
    for tree in trees.values():
        def at(node):
            if node.left < 0:
                return node.prediction
            left, right = tree[node.left], tree[node.right]
            if node.feature in known:
                return at(left if row[node.feature] <= node.threshold else right)
            return (left.cover * at(left) + right.cover * at(right)) / node.cover

        total += tree[0].weight * at(tree[0])
    return total


def test_attribution_is_exact(spark, fitted):
    rows, model, path = fitted
    nodes = attribution.booster_nodes(spark, path)
    trees = {}
    for n in nodes.collect():
        trees.setdefault(n.tree, {})[n.id] = n
    made = attribution.attributions(attribution.booster(nodes), rows.limit(25), NAMES, ["id"]).collect()
    got = {(r.id, r.feature): r for r in made}
    assert len(got) == 100
    for row in rows.limit(25).collect():
        x = [models.MISSING if row[n] is None else row[n] for n in NAMES]
        for j, name in enumerate(NAMES):
            others = [k for k in range(4) if k != j]
            want = sum(
                math.factorial(s) * math.factorial(3 - s) / 24 * (expectation(trees, x, {*chosen, j}) - expectation(trees, x, set(chosen)))
                for s in range(4) for chosen in itertools.combinations(others, s)
            )
            cell = got[row.id, name]
            assert cell.contribution == pytest.approx(want, abs=1e-9)
            assert cell.value == row[name]
        assert cell.base_value == pytest.approx(expectation(trees, x, set()), abs=1e-9)
        assert cell.margin == pytest.approx(expectation(trees, x, {0, 1, 2, 3}), abs=1e-9)


def test_contributions_add_up_to_the_models_own_margin(spark, fitted):
    rows, model, path = fitted
    extreme = spark.createDataFrame(
        [(-1, None, None, None, None), (-2, float("nan"), 1e300, -1e300, 0.0), (-3, float("inf"), float("-inf"), 0.5, 0.5)],
        "id bigint, a double, b double, c double, d double",
    )
    wide = rows.select("id", *NAMES).unionByName(extreme).withColumns({"feature": F.lit("x"), "_value": F.lit(1)})
    made = attribution.attributions(attribution.booster(attribution.booster_nodes(spark, path)), wide, NAMES, ["id"])
    sums = made.groupBy("id").agg((F.sum("contribution") + F.max("base_value")).alias("total"), F.max("margin").alias("margin"))
    both = sums.join(models.with_margin(model, wide).select("id", "model_margin"), "id").toPandas()
    assert len(both) == 603
    assert np.allclose(both.total, both.model_margin, atol=1e-6) and np.allclose(both.margin, both.model_margin, atol=1e-6)


def test_drivers_of_a_prediction_are_its_largest_contributions(spark, fitted):
    rows, model, path = fitted
    out = attribution.predict_with_drivers(model, rows.limit(40).select("id", *NAMES), NAMES, ["id"], 0.5, k=2).collect()
    trees = attribution.booster_of(model, spark)
    cells = attribution.attributions(trees, rows.limit(40), NAMES, ["id"]).toPandas()
    assert len(out) == 40
    for r in out:
        mine = cells[cells.id == r.id]
        best = mine.iloc[(-mine.contribution.abs()).argsort(kind="stable")].feature.tolist()[:2]
        assert [d.feature for d in r.top_drivers] == best and r.risk_level in ("HIGH", "MEDIUM", "LOW", "NEGLIGIBLE")
    assert attribution.attributions(trees, rows.where("false"), NAMES, ["id"]).count() == 0


def test_combined_risk_carries_both_answers(spark):
    drivers = "array<struct<feature: string, impact: string>>"
    slides = spark.createDataFrame(
        [(1, "s1", 0.7, "HIGH", [("x", "+1"), ("y", "-1"), ("z", "+0"), ("w", "+0")]), (2, None, 0.1, "LOW", None), (3, "gone", None, None, [])],
        f"user_id int, station_id string, susceptibility double, risk_level string, top_drivers {drivers}",
    )
    flood = spark.createDataFrame(
        [("s1", 0.4, "MEDIUM", 18, [("r", "+2")])], f"station_id string, probability double, risk_level string, lead_time_hours int, top_drivers {drivers}"
    )
    got = {r.user_id: r for r in combined_risk(slides, flood).collect()}
    assert [d.feature for d in got[1].landslide_drivers] == ["x", "y", "z"] and [d.feature for d in got[1].flood_drivers] == ["r"]
    assert (got[1].susceptibility, got[1].flood_probability, got[1].flood_risk, got[1].lead_time_hours, got[1].overall_risk) == (0.7, 0.4, "MEDIUM", 18, "HIGH")
    assert (got[2].flood_probability, got[2].overall_risk, got[2].landslide_drivers) == (None, "LOW", None)
    assert got[3].overall_risk == "UNKNOWN" and got[3].landslide_drivers == []


def weather(spark, rows):
    made = spark.createDataFrame(rows, "catchment_id string, timestamp string, rainfall_mm double")
    return made.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def test_weather_of_several_catchments_shares_a_date(spark, tmp_path):
    path = str(tmp_path / "store")
    day = "2024-01-05"
    datasets.write_weather(weather(spark, [("A", f"{day} 01:00:00", 1.0), ("A", f"{day} 02:00:00", 2.0), ("A", "2024-01-09 00:00:00", 9.0)]), path, "historical")
    datasets.write_weather(weather(spark, [("B", f"{day} 01:00:00", 3.0), (None, f"{day} 03:00:00", 4.0)]), path, "historical")
    datasets.write_weather(weather(spark, [("A", f"{day} 01:00:00", 7.0)]), path, "forecast")
    for _ in range(2):
        datasets.write_weather(weather(spark, [("A", f"{day} 05:00:00", 5.0), (None, f"{day} 04:00:00", 6.0)]), path, "historical")
    datasets.write_weather(weather(spark, []), path, "historical")
    got = sorted((r.kind, str(r.catchment_id), str(r.timestamp), r.rainfall_mm) for r in datasets.read_weather(spark, path).collect())
    assert got == [
        ("forecast", "A", f"{day} 01:00:00", 7.0), ("historical", "A", f"{day} 05:00:00", 5.0), ("historical", "A", "2024-01-09 00:00:00", 9.0),
        ("historical", "B", f"{day} 01:00:00", 3.0), ("historical", "None", f"{day} 04:00:00", 6.0),
    ]


def test_training_deals_rows_evenly_and_keeps_no_node_ids(spark, fitted):
    assert not fitted[1].stages[-1].getCacheNodeIds()  # a second pass over every row at each level of each tree
    cores = spark.sparkContext.defaultParallelism
    powers = spark.sparkContext.parallelize(range(5), 5).flatMap(lambda k: [(i,) for i in range(10**k)])
    skewed = spark.createDataFrame(powers, "id long")
    sizes = models.balanced(skewed).rdd.glom().map(len).collect()
    assert len(sizes) == cores and sum(sizes) == 11_111 and max(sizes) - min(sizes) <= cores * 5
    assert models.balanced(skewed.coalesce(1)).rdd.getNumPartitions() == 1


def test_a_query_makes_its_rows_once(spark, monkeypatch):
    """The rows that fit a model and those it is tried on are two parts of one table."""
    made = []

    def rows(t):
        made.append(t)
        time = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(CAST(id AS INT))")
        return spark.range(10).select(F.lit("ST1").alias("station_id"), time.alias("timestamp"), F.to_date(time).alias("date"))

    monkeypatch.setattr(model_queries, "flood_rows", rows)
    monkeypatch.setattr(model_queries.landslide, "landslide_training_set", lambda *a, **k: rows(a))
    monkeypatch.setattr(Tables, "slides", lambda t: None)
    monkeypatch.setattr(model_queries.learning, "terrain", lambda t: None)
    monkeypatch.setattr(model_queries.learning, "weather", lambda t: None)
    t = Tables(spark, "nowhere")
    assert model_queries.split_rows(t).where("split = 'train'").count() == 8
    assert model_queries.test_rows(t).count() == 2
    assert len(made) == 1
    assert model_queries.slide_rows(t).count() == model_queries.slide_rows(t).count() == 10
    assert len(made) == 2
    model_queries.split_rows(Tables(spark, "nowhere"))  # another query makes its own
    assert len(made) == 3
