"""Zones, targeting, alerts, routes, metrics and splits on small tables and against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.functions.geo import circle_polygon
from freshet.operators import alerts, catchments, evaluation, explain, grid, routes, splits, targeting, zones

AS_OF = "2024-01-15 12:00:00"


def flood_prediction(spark):
    return spark.createDataFrame(
        [("GUW001", 26.5, 91.5, 0.8, "HIGH", 6)],
        "station_id string, lat double, lon double, probability double, risk_level string, lead_time_hours int",
    )


def make_zones(spark, rows):
    return spark.createDataFrame(
        rows, "zone_id string, center_lat double, center_lon double, radius_km double, severity string"
    ).withColumn("hazard_type", F.lit("flood"))


def make_users(spark, rows):
    return spark.createDataFrame(rows, "user_id string, lat double, lon double")


def test_flood_zone_and_alert(spark):
    zone = zones.flood_zones(flood_prediction(spark), AS_OF)
    row = zone.first()
    assert row.zone_id == "FLD_GUW001_202401151200" and row.radius_km == 5.0 and row.severity == "CRITICAL"
    assert (row.valid_until - row.valid_from).total_seconds() == 12 * 3600 and len(row.polygon) == 33
    alert = alerts.alerts_from_zones(zone, AS_OF).first()
    assert alert.alert_type == "FLOOD_WARNING" and alert.severity == "EXTREME"
    assert alert.headline == "FLOOD_WARNING: Flood Risk in GUW001"
    assert "Probability: 80%. Expected within 6 hours. Affected radius: 5.0km." in alert.message
    assert alert.expires_at == row.valid_until and alert.alert_id.startswith("ALT_20240115_")


def test_missing_prediction_uses_defaults_but_zero_is_kept(spark):
    rows = [("A", 26.0, 91.0, None), ("B", 26.0, 91.0, 0.0)]
    made = zones.flood_zones(spark.createDataFrame(rows, "station_id string, lat double, lon double, probability double"), AS_OF)
    got = {r.source_prediction.station_id: r for r in made.collect()}
    assert got["A"].source_prediction.probability == 0.5 and got["B"].source_prediction.probability == 0.0
    assert got["A"].source_prediction.risk_level == "MEDIUM" and got["A"].source_prediction.lead_time_hours == 12


def test_landslide_zone_truncates_and_shrinks(spark):
    df = spark.createDataFrame([(-26.459, 91.789, 0.4, "medium")], "lat double, lon double, susceptibility double, risk_level string")
    row = zones.landslide_zones(df, AS_OF).first()
    assert row.zone_id == "LND_-2645_9178_202401151200" and row.radius_km == pytest.approx(1.8) and row.severity == "HIGH"


def test_active_and_expired_split_at_the_instant(spark):
    zone = zones.flood_zones(flood_prediction(spark), AS_OF)
    assert zones.active_zones(zone, "2024-01-15 23:59:59").count() == 1
    assert zones.active_zones(zone, "2024-01-16 00:00:00").count() == 0
    clear = alerts.all_clear(zone, "2024-01-16 00:00:00").first()
    assert clear.headline.endswith("FLD_GUW001_202401151200 has been cleared") and clear.alert_id.startswith("CLR_20240116_")


def planar(lat, lon, z):
    return math.hypot((lat - z[1]) * 111.0, (lon - z[2]) * 111.0 * math.cos(math.radians(z[1])))


@pytest.mark.parametrize("lat0", [0.0, 26.0, 70.0])
def test_bucketed_join_equals_brute_force(spark, lat0):
    rng = np.random.default_rng(int(lat0))
    zs = [(f"z{i}", lat0 + float(a), 91 + float(b), float(rng.choice([0.3, 1, 5, 30])), "LOW") for i, (a, b) in enumerate(rng.random((30, 2)))]
    us = [(f"u{i}", lat0 + float(a), 91 + float(b)) for i, (a, b) in enumerate(rng.random((200, 2)) * 1.2 - 0.1)]
    # a third of all users stand on one spot
    us += [(f"h{i}", lat0 + 0.5, 91.5) for i in range(100)]
    for buffer in (0.0, 5.0):
        got = zones.near_zones(make_users(spark, us), make_zones(spark, zs), buffer)
        pairs = [(r.user_id, r.zone_id) for r in got.collect()]
        want = {(u[0], z[0]) for u in us for z in zs if planar(u[1], u[2], z) <= z[3] + buffer}
        assert set(pairs) == want and len(pairs) == len(want)
    inside = {u for u, z in {(u[0], z[0]) for u in us for z in zs if planar(u[1], u[2], z) <= z[3]}}
    clear = zones.points_in_zones(make_users(spark, us), make_zones(spark, zs), how="left_anti")
    assert {r.user_id for r in clear.collect()} == {u[0] for u in us} - inside


def test_priority_tiers(spark):
    zone = make_zones(spark, [("z", 26.5, 91.5, 5.0, "CRITICAL")])
    km = 1 / 111.0
    users = make_users(spark, [("in", 26.5, 91.5), ("p1", 26.5 + 5.9 * km, 91.5), ("p2", 26.5 + 7.9 * km, 91.5),
                               ("p3", 26.5 + 9.9 * km, 91.5), ("far", 27.5, 91.5)])
    out = {r.user_id: r for r in targeting.user_priority(users, zone).collect()}
    assert {u: r.priority for u, r in out.items()} == {"in": "P0", "p1": "P1", "p2": "P2", "p3": "P3", "far": "NONE"}
    assert out["in"].message == "EMERGENCY: You are inside a CRITICAL hazard zone. Evacuate immediately."
    assert out["p1"].message.startswith("WARNING: Hazard zone 5.9km away.")
    assert out["p3"].reason == "User within buffer zone (9.9km)" and out["far"].zones == []
    counts = {r.priority: r.users for r in targeting.priority_counts(targeting.user_priority(users, zone)).collect()}
    assert counts == dict.fromkeys(["P0", "P1", "P2", "P3", "NONE"], 1)


def test_nearest_is_by_centre_and_severity_by_rank(spark):
    zs = make_zones(spark, [("a", 26.0, 91.0, 20.0, "MEDIUM"), ("b", 26.05, 91.0, 20.0, "CRITICAL")])
    row = targeting.user_priority(make_users(spark, [("u", 26.0, 91.0)]), zs).first()
    assert row.zones == ["a", "b"] and "CRITICAL" in row.message
    lexical = targeting.user_priority(make_users(spark, [("u", 26.0, 91.0)]), zs, lexical_severity=True).first()
    assert "MEDIUM" in lexical.message


def test_no_zones_gives_none_rows(spark):
    out = targeting.user_priority(make_users(spark, [("u", 26.0, 91.0)]), make_zones(spark, []))
    assert out.first().priority == "NONE"


def test_queue_order_and_waves(spark):
    tiers = ["P2", "P0", "NONE", "P1", "P0", "P3", "P0", "P0"]
    df = spark.createDataFrame([(i, p, "m") for i, p in enumerate(tiers)], "seq int, priority string, message string")
    queue = targeting.dispatch_queue(df, ["seq"]).collect()
    assert [r.seq for r in queue] == [1, 4, 6, 7, 3, 0, 5]
    waved = {r.seq: r for r in targeting.evacuation_waves(df, ["seq"], limit=3).collect()}
    assert [waved[i].wave for i in (1, 4, 6, 7)] == [1, 2, 3, 1] and waved[4].message == "m [Evacuation Wave 2]"
    assert all(r.wave is None for r in targeting.evacuation_waves(df, ["seq"], limit=4).collect())


def test_location_status(spark):
    zs = make_zones(spark, [(f"n{i}", 26.5 + 0.01 * i, 91.5, 0.5, "LOW" if i else "HIGH") for i in range(8)] + [("c", 26.49, 91.5, 2.0, "MEDIUM")])
    points = make_users(spark, [("in", 26.49, 91.5), ("near", 26.46, 91.5), ("clear", 30.0, 90.0)])
    out = {r.user_id: r for r in zones.location_status(points, zs, buffer_km=10.0).collect()}
    assert out["in"].status == "IN_DANGER_ZONE" and out["in"].zones_inside == ["c"] and len(out["in"].zones_nearby) == 5
    assert out["near"].status == "NEAR_DANGER_ZONE" and out["near"].max_severity == "MEDIUM"
    assert out["clear"].status == "CLEAR" and out["clear"].max_severity == "NONE"


def test_circle_stays_at_radius(spark):
    ring = spark.range(1).select(circle_polygon(F.lit(26.5), F.lit(91.5), F.lit(3.0)).alias("r")).first().r
    assert ring[0] == ring[-1] and len(ring) == 33
    assert all(planar(p.lat, p.lon, ("", 26.5, 91.5)) == pytest.approx(3.0) for p in ring)


def route_rows(spark, routes_):
    rows = [(rid, i, float(a), float(b)) for rid, pts in routes_.items() for i, (a, b) in enumerate(pts)]
    return spark.createDataFrame(rows, "route_id string, pos long, lat double, lon double")


def test_routes_are_sampled_and_judged(spark):
    line = [(26 + i * 0.04, 91 + i * 0.04) for i in range(25)]
    around = [(26 + i * 0.04, 91.0) for i in range(25)]
    vertices = route_rows(spark, {"hit": line, "safe": around, "stuck": line, "lost": line})
    kept = {r.pos for r in routes.sample_vertices(vertices).where("route_id = 'hit'").collect()}
    assert kept == {0, 10, 20, 24}
    zone = make_zones(spark, [("z", 26.4, 91.4, 5.0, "HIGH")])
    hits = routes.route_zones(vertices, zone)
    assert {r.route_id for r in hits.collect()} == {"hit", "stuck", "lost"}
    detour_hits = routes.route_zones(route_rows(spark, {"hit": around, "stuck": line}), zone)
    point = "struct<lat: double, lon: double>"
    ends = ((26.0, 91.0), (26.96, 91.96))
    requests = spark.createDataFrame([(r, *ends) for r in ("hit", "safe", "stuck", "lost")], f"route_id string, origin {point}, destination {point}")
    made = [("hit", 100.0, 90), ("safe", 100.0, 90), ("stuck", 100.0, 90)]
    direct = spark.createDataFrame(made, "route_id string, distance_km double, eta_minutes int")
    detour = direct.withColumn("distance_km", F.col("distance_km") + 20)
    out = {r.route_id: r for r in routes.route_status(requests, direct, detour, hits, detour_hits).collect()}
    assert {k: v.route_status for k, v in out.items()} == {"hit": "SAFE", "safe": "SAFE", "stuck": "BLOCKED", "lost": "UNKNOWN"}
    assert out["hit"].avoided_hazards == ["z"] and out["hit"].distance_km == 120 and out["safe"].warnings == []
    assert out["stuck"].warnings[0] == "Route unavoidably passes through: z" and out["lost"].eta_minutes == int(out["lost"].distance_km / 30 * 60)
    way = {r.route_id: r for r in routes.avoidance_waypoints(requests, routes.route_hits(vertices, zone)).collect()}
    assert way["hit"].lat == pytest.approx(26.48 + (26.48 - 26.4) * 0.5)


def test_metrics_match_definitions(spark):
    rng = np.random.default_rng(11)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "probability": p}))
    m = evaluation.evaluate(df, 0.5).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap = sum((pos == s).sum() / len(pos) * (pos >= s).sum() / (p >= s).sum() for s in np.unique(p))
    assert m.roc_auc == pytest.approx(auc) and m.pr_auc == pytest.approx(ap)
    tp, fp, fn = ((p >= 0.5) & (y == 1)).sum(), ((p >= 0.5) & (y == 0)).sum(), ((p < 0.5) & (y == 1)).sum()
    assert m.f2_score == pytest.approx(5 * tp / (5 * tp + 4 * fn + fp)) and m.true_positives == tp
    best = evaluation.optimal_threshold(df, "f2").first()
    scores = []
    for t in np.arange(0.1, 0.95, 0.05):
        tp, fp, fn = ((p >= t) & (y == 1)).sum(), ((p >= t) & (y == 0)).sum(), ((p < t) & (y == 1)).sum()
        scores.append(5 * tp / (5 * tp + 4 * fn + fp))
    assert len(scores) == 17 and best.best_score == pytest.approx(max(scores))
    assert best.optimal_threshold == pytest.approx(np.arange(0.1, 0.95, 0.05)[int(np.argmax(scores))])
    one = spark.createDataFrame([(0, 0.2)], "label int, probability double")
    assert evaluation.confusion_metrics(one).first().precision == 0 and evaluation.scale_pos_weight(one).first()[0] == 1.0


def test_splits(spark):
    df = spark.createDataFrame(
        [(f"s{k}", (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), int(i % 10 == 0)) for k in range(4) for i in range(50)],
        "station_id string, timestamp timestamp_ntz, label int",
    )
    by_time = splits.time_split(df)
    assert by_time.where("split = 'test'").count() == 40
    assert by_time.where("split = 'train'").agg(F.max("timestamp")).first()[0] < by_time.where("split = 'test'").agg(F.min("timestamp")).first()[0]
    positional = splits.time_split(df, mode="positional").where("split = 'test'")
    assert positional.count() == 40 and {r.station_id for r in positional.collect()} == {"s3"}
    strat = splits.stratified_split(df, ["station_id", "timestamp"])
    got = {(r.label, r.split): r["count"] for r in strat.groupBy("label", "split").count().collect()}
    assert got == {(0, "train"): 144, (0, "test"): 36, (1, "train"): 16, (1, "test"): 4}


def test_grid_labels_and_sampling(spark):
    bbox = (91.0, 25.0, 91.1, 25.1)
    cells = grid.spatial_grid(spark, bbox, 1.0)
    assert cells.count() == 12 * 12 and cells.where("grid_id = 'CELL_0003_0011'").count() == 1
    step = 1 / 111.0
    points = spark.createDataFrame(
        [(91 + 0.5 * step, 25 + 0.5 * step, "2024-06-02"), (91 + 0.6 * step, 25 + 0.4 * step, "2024-06-02"), (90.0, 25.0, "2024-06-02"),
         (91.0, 25 + 3.5 * step, "2024-06-03")], "lon double, lat double, date string")
    placed = grid.points_in_grid(points, bbox, 1.0)
    assert [r.grid_id for r in placed.collect()] == ["CELL_0000_0000", "CELL_0000_0000", None, "CELL_0000_0003"]
    assert grid.points_in_grid(points, bbox, 1.0, drop_edges=True).where("grid_id is not null").count() == 2
    labels = grid.grid_day_labels(cells, placed, "2024-06-01", "2024-06-30")
    assert labels.count() == 144 * 30 and labels.agg(F.sum("num_events"), F.sum("label")).first()[:] == (3, 2)
    assert grid.negative_sampling(labels, 10).count() == 22
    assert grid.negative_sampling(labels, 100000).count() == 144 * 30


def test_explanations(spark):
    rows = [(1, "a", 0.5), (1, "b", -2.0), (1, "c", 0.0005), (2, "a", -0.0004), (2, "b", 0.0025), (2, "c", 0.1)]
    df = spark.createDataFrame(rows, "row_id int, feature string, contribution double")
    wide = {r.row_id: r for r in explain.top_drivers(df, 2).collect()}
    assert (wide[1].top1_feature, wide[1].top2_feature) == ("b", "a")
    text = {r.row_id: [(d.feature, d.impact) for d in r.top_drivers] for r in explain.driver_strings(df, 3).collect()}
    assert text[1][:2] == [("b", "-2.000"), ("a", "+0.500")] and text[2] == [("c", "+0.100"), ("b", "+0.002"), ("a", "-0.000")]


def test_sampling_points_by_outline_size(spark):
    def square(side):
        ring = [(91, 26), (91 + side, 26), (91 + side, 26 + side), (91, 26 + side), (91, 26)]
        return [(float(a), float(b)) for a, b in ring]

    triangle = [(91.0, 26.0), (91.4, 26.0), (91.0, 26.4), (91.0, 26.0)]
    rows = [("small", square(0.05)), ("medium", square(0.25)), ("large", square(2.0)), ("triangle", triangle)]
    df = spark.createDataFrame(rows, "catchment_id string, ring array<struct<lon: double, lat: double>>")
    counts = {r.catchment_id: r["count"] for r in catchments.sampling_points(df).groupBy("catchment_id").count().collect()}
    assert counts == {"small": 1, "medium": 5, "large": 10, "triangle": 4}
    terrain = {r.catchment_id: r for r in catchments.terrain_from_outline(df, "catchment_id").collect()}
    assert terrain["small"].catchment_area == pytest.approx(0.0025 * 111**2 * math.cos(math.radians(26.025)))


def test_request_bounds(spark):
    df = spark.createDataFrame([(91.0, 10.0, 0.5), (26.0, 91.0, 1.5), (26.0, 91.0, None)], "lat double, lon double, probability double")
    assert [r.violations for r in zones.check_bounds(df).collect()] == [["lat"], ["probability"], []]
