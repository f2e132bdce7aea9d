"""Readers, sinks, the weather store, models and streams."""

import json
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import models
from freshet.session import checkpoint_root, materialize
from freshet.sources import catalogs, datasets, payloads, rasters, sinks
from freshet.streaming import watch


def test_dates_day_before_month(spark):
    texts = ["2024-01-15", "2024/01/15", "15-01-2024", "15/01/2024", "01/15/2024", "2024-1-15 10:20:30", "03/04/2024", "2024-01-15T08:00:00", "soon", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    got = [r.d for r in df.select("i", catalogs.parse_date(F.col("t")).alias("d")).orderBy("i").collect()]
    assert [str(d)[:10] for d in got[:6]] == ["2024-01-15"] * 6 and got[5].hour == 10
    assert str(got[6])[:10] == "2024-04-03" and got[7].hour == 8 and got[8:] == [None, None]


def test_bbox(spark):
    points = [(26.1445, 91.7362), (28.6139, 77.209), (19.076, 72.8777), (51.5074, -0.1278), (40.7128, -74.006), (None, 90.0), (37.0, 98.0)]
    assert catalogs.bbox_filter(spark.createDataFrame(points, "lat double, lon double")).count() == 4


def test_catalog_files(spark, tmp_path):
    (tmp_path / "glc.csv").write_text(
        "event_date,latitude,longitude,landslide_category,location_description,fatality_count\n"
        "2024-07-01,26.1,91.7,mudslide,Here,3\n15/08/2024,27,92,debris,There,\nbad,26,91,x,y,1\n2024-07-01,60,91,x,y,1\n2024-07-01,,91,x,y,1\n"
    )
    rows = catalogs.read_landslide_catalog(spark, str(tmp_path / "glc.csv")).orderBy("timestamp").collect()
    assert [(r.event_type, r.fatalities, r.source) for r in rows] == [("mudslide", 3.0, "NASA_GLC"), ("debris", None, "NASA_GLC")]
    (tmp_path / "mine.csv").write_text("Date,Latitude,Longitude,Type,Location\n2024-07-15,26.1,91.7,landslide,A\n2024-07-20,26.2,91.8,mudslide,B\n2024-08-05,26.3,91.9,rockfall,C\n")
    names = {"Date": "timestamp", "Latitude": "lat", "Longitude": "lon", "Type": "event_type", "Location": "location_name"}
    mine = catalogs.read_custom_catalog(spark, str(tmp_path / "mine.csv"), names)
    assert mine.count() == 3 and {r.source for r in mine.collect()} == {"CUSTOM_mine"}
    assert catalogs.read_custom_catalog(spark, str(tmp_path / "mine.csv"), {"Date": "timestamp"}).count() == 0
    twice = catalogs.normalize_catalog(mine.unionByName(mine))
    assert twice.count() == 3
    with pytest.raises(Exception, match="Invalid coordinates"):
        catalogs.normalize_catalog(mine.withColumn("lat", F.lit(80.0))).collect()
    (tmp_path / "inv.csv").write_text("landslide_id,lat,lon,date,magnitude,type\nLS1,25.5,91.5,2024-06-10,3,debris\n")
    row = catalogs.read_inventory(spark, str(tmp_path / "inv.csv")).first()
    assert str(row.date) == "2024-06-10" and row.magnitude == 3
    with pytest.raises(ValueError, match="date"):
        (tmp_path / "no.csv").write_text("lat,lon\n1,2\n")
        catalogs.read_inventory(spark, str(tmp_path / "no.csv"))


def test_hourly_payload(spark):
    doc = json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "precipitation": [1.5, None], "temperature_2m": [20]}})
    out = payloads.parse_hourly_payload(spark.createDataFrame([("C", doc)], "catchment_id string, payload string"),
                                        ["precipitation", "temperature_2m"], keep=["catchment_id"]).orderBy("timestamp").collect()
    assert [(r.timestamp.hour, r.precipitation, r.temperature_2m) for r in out] == [(0, 1.5, 20.0), (1, None, None)]


def test_route_payload(spark):
    steps = [{"instruction": "go", "distance": 1500, "duration": 130}, {"distance": 500}]
    doc = {"features": [{"geometry": {"coordinates": [[91, 26], [92, 27]]},
                         "properties": {"summary": {"distance": 2000, "duration": 200}, "segments": [{"steps": steps}, {}]}}]}
    bare = {"features": [{"geometry": {"coordinates": [[91, 26]]}, "properties": {"summary": {"distance": 2, "duration": 59}}}]}
    df = spark.createDataFrame([("a", json.dumps(doc)), ("b", json.dumps(bare))], "route_id string, payload string")
    a, b = payloads.parse_route_payload(df).orderBy("route_id").collect()
    assert a.distance_km == 2.0 and a.duration_minutes == 3 and [tuple(s) for s in a.steps] == [("go", 1.5, 2), ("", 0.5, 0)]
    assert b.steps == [] and b.duration_minutes == 0
    assert payloads.parse_route_payload(df, unit=payloads.KILOMETRES).orderBy("route_id").first().distance_km == 2000.0


def test_station_files(spark, tmp_path):
    (tmp_path / "GUW001.json").write_text(json.dumps({"station_id": "GUW001", "river": "Brahmaputra", "warning_level": 49.0,
                                                      "danger_level": 50.0, "latitude": 26.1445, "longitude": 91.7362}, indent=1))
    row = payloads.read_station_dim(spark, str(tmp_path)).first()
    assert row.river == "Brahmaputra" and row.danger_level == 50.0 and row.location is None


def test_weather_store_overwrites_prunes_and_keys(spark, tmp_path):
    path = str(tmp_path / "weather")
    times = pd.date_range("2024-01-01", periods=96, freq="h")
    df = spark.createDataFrame([("C1", t.to_pydatetime(), 1.0) for t in times], "catchment_id string, timestamp timestamp_ntz, rainfall_mm double")
    datasets.write_weather(df, path, "historical")
    datasets.write_weather(df.where("timestamp >= '2024-01-04'").withColumn("rainfall_mm", F.lit(2.0)), path, "historical")
    assert datasets.read_weather(spark, path, "historical").agg(F.sum("rainfall_mm")).first()[0] == 72 + 48
    assert datasets.read_weather(spark, path, "historical", "2024-01-02", "2024-01-02").count() == 24
    assert datasets.prune_weather(spark, path, "2024-01-05", 2) == 2
    assert datasets.read_weather(spark, path).count() == 48
    assert {len(r.key) for r in datasets.read_weather(spark, path).collect()} == {16}


def test_dataset_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("S", pd.Timestamp("2024-01-01 05:00").to_pydatetime(), 1.25)], "station_id string, timestamp timestamp_ntz, level double")
    for fmt in ("csv", "parquet"):
        datasets.write_dataset(df, str(tmp_path / fmt), fmt)
        assert datasets.read_dataset(spark, str(tmp_path / fmt), df.schema, fmt).collect() == df.collect()


def test_cells_and_affine(spark, tmp_path):
    meta = spark.createDataFrame([(1, 0.1, -0.1, 91.0, 27.0, -9999.0)], "dem_id int, dx double, dy double, left double, top double, nodata double")
    spark.createDataFrame([(1, 0, 0, -9999.0), (1, 0, 1, 5.0)], rasters.CELL_SCHEMA).write.csv(str(tmp_path / "dem"), header=True)
    got = rasters.read_cells(spark, str(tmp_path / "dem"), meta, "csv").orderBy("col").collect()
    assert [r.elevation for r in got] == [None, 5.0]
    at = rasters.latlon_to_cell(spark.createDataFrame([(1, 26.95, 91.25)], "dem_id int, lat double, lon double"), meta).first()
    assert (at.row, at.col) == (0, 2)


def test_geojson_sink(spark, tmp_path):
    from freshet.operators.zones import flood_zones

    zones = flood_zones(spark.createDataFrame([("A", 26.0, 91.0, 0.9), ("B", 27.0, 92.0, 0.9)], "station_id string, lat double, lon double, probability double"), "2024-01-15 12:00:00")
    sinks.write_zone_features(zones, str(tmp_path / "z"))
    lines = spark.read.text(str(tmp_path / "z")).collect()
    feature = json.loads(lines[0].value)
    assert len(lines) == 2 and feature["geometry"]["type"] == "Polygon" and len(feature["geometry"]["coordinates"][0]) == 33
    whole = [json.loads(r.collection) for r in sinks.zone_collections(zones).collect()]
    assert sum(len(c["features"]) for c in whole) == 2


def test_checkpoint_root_comes_from_the_session(spark):
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "s3://shared/checkpoints"})
    assert checkpoint_root(named) == "s3://shared/checkpoints"
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(SimpleNamespace(conf={}, sparkContext=context))
    assert materialize(spark.range(5)).count() == 5


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.1 * rng.random(600) > 0.6).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"i": range(600), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y}))
    return models.train(df, ["a", "b", "c"], replace(models.FLOOD, trees=5)), df


def test_model_scores_and_explains(spark, fitted, tmp_path):
    model, df = fitted
    scored = models.score(model, df, 0.35)
    row = scored.first()
    assert {"probability", "risk_level", "lead_time_hours", "confidence", "threshold_used"} <= set(scored.columns) and row.confidence == "HIGH"
    assert dict(models.importances(model))["a"] > 0.5
    parts = models.contributions(model, df, ["a", "b", "c"], ["i"])
    assert parts.count() == 1800
    size = {r.feature: r.s for r in parts.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("s")).collect()}
    assert max(size, key=size.get) == "a"
    datasets.save_model_artifacts(model, str(tmp_path / "m"), ["a", "b", "c"], [0.1, 0.2, 0.7], {"optimal_threshold": 0.35})
    again, names, thresholds = datasets.load_model_artifacts(spark, str(tmp_path / "m"))
    assert names == ["a", "b", "c"] and thresholds == {"optimal_threshold": 0.35}
    assert models.score(again, df).exceptAll(models.score(model, df)).isEmpty()


def test_inference_features_take_the_latest_past_row(spark):
    rows = [("A", f"2024-01-0{d}", float(d)) for d in range(1, 6)] + [("B", "2024-01-09", 9.0)]
    df = spark.createDataFrame(rows, "station_id string, timestamp string, x double").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    assert [(r.station_id, r.x) for r in models.inference_features(df, "2024-01-03 12:00:00").collect()] == [("A", 3.0)]


def test_zone_registry_replaces_and_clears(spark, tmp_path):
    schema = "zone_id string, severity string, issued_at timestamp_ntz, valid_until timestamp_ntz"
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")

    def land(rows):
        data = [(z, s, pd.Timestamp(a).to_pydatetime(), pd.Timestamp(b).to_pydatetime()) for z, s, a, b in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        watch.append_to(watch.zone_registry(spark.readStream.schema(schema).parquet(source)), out, state).awaitTermination()
        return spark.read.parquet(out)

    land([("a", "HIGH", "2024-01-01 00:00", "2024-01-01 06:00"), ("b", "LOW", "2024-01-01 00:00", "2024-01-03 00:00")])
    run()
    land([("a", "CRITICAL", "2024-01-01 05:00", "2024-01-01 12:00")])
    assert run().where("event = 'ALL_CLEAR'").isEmpty()
    land([("c", "LOW", "2024-01-02 00:00", "2024-01-05 00:00")])
    events = run()
    clear = watch.all_clear_notices(events).collect()
    assert [(r.zone_id, r.severity, r.event_time.hour) for r in clear] == [("a", "CRITICAL", 12)]
    assert events.where("event = 'ACTIVE'").count() == 4


def _registry_of(spark, folder, rows, batches, delay):
    schema = "zone_id string, severity string, issued_at timestamp_ntz, valid_until timestamp_ntz"
    source, out, state = (str(folder / x) for x in ("in", "out", "state"))
    for k in range(batches):
        data = [(z, s, pd.Timestamp(a).to_pydatetime(), pd.Timestamp(b).to_pydatetime()) for z, s, a, b in rows[k::batches]]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
        stream = watch.zone_registry(spark.readStream.schema(schema).parquet(source), delay)
        watch.append_to(stream, out, state).awaitTermination()
    return sorted(map(str, spark.read.parquet(out).collect()))


def test_zone_registry_does_not_depend_on_batches(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")
    rows = [
        (f"z{k % 3}", f"s{k}", start + pd.Timedelta(minutes=37 * k), start + pd.Timedelta(minutes=37 * k + 20 + 61 * (k % 5)))
        for k in range(40)
    ] + [("z9", "late end", start, start + pd.Timedelta(days=9)), ("z8", "tie", start, start), ("z8", "tie", start, start)]
    whole = _registry_of(spark, tmp_path / "one", rows, 1, "3 days")
    parts = _registry_of(spark, tmp_path / "many", rows, 4, "3 days")
    assert whole == parts
    # a row after the whole span lets the watermark pass every end but the last
    end = [("z7", "end", start + pd.Timedelta(days=5), start + pd.Timedelta(days=6))]
    whole = _registry_of(spark, tmp_path / "one", end, 1, "3 days")
    assert whole == _registry_of(spark, tmp_path / "many", end, 1, "3 days")
    clears = 0
    for zone in {r[0] for r in rows}:
        mine = sorted((a, b) for z, _, a, b in rows if z == zone)
        clears += sum(b < start + pd.Timedelta(days=2) and (k + 1 == len(mine) or b <= mine[k + 1][0]) for k, (_, b) in enumerate(mine))
    assert sum("ALL_CLEAR" in x for x in whole) == clears and sum("'ACTIVE'" in x for x in whole) == len(rows) + 1


def test_zone_registry_drops_late_rows(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")
    hours = lambda n: start + pd.Timedelta(hours=n)
    _registry_of(spark, tmp_path, [("a", "x", hours(10), hours(20))], 1, "1 hour")
    late = _registry_of(spark, tmp_path, [("b", "x", hours(5), hours(6)), ("a", "y", hours(30), hours(40))], 1, "1 hour")
    assert not any("'b'" in x for x in late) and sum("ALL_CLEAR" in x for x in late) == 1


def test_position_alerts_use_the_zones_of_the_moment(spark, tmp_path):
    schema = "user_id string, lat double, lon double, ts timestamp_ntz"
    zone = "zone_id string, center_lat double, center_lon double, radius_km double, severity string, hazard_type string, valid_until timestamp_ntz"
    at = lambda h: (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime()
    known = [("Z1", 26.0, 91.0, 5.0, "HIGH", "flood", at(6))]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        users = spark.readStream.schema(schema).parquet(source)
        watch.position_alerts(users, lambda: spark.createDataFrame(known, zone), out, state).awaitTermination()
        return {r.user_id: (r.priority, r.zones) for r in spark.read.parquet(out).collect()}

    assert run([("u1", 26.0, 91.0, at(1)), ("u2", 26.0, 91.0, at(7))]) == {"u1": ("P0", ["Z1"]), "u2": ("NONE", [])}
    known.append(("Z2", 26.0, 91.0, 5.0, "LOW", "flood", at(20)))
    assert run([("u3", 26.0, 91.0, at(7))])["u3"] == ("P0", ["Z2"])


def test_gauge_watch_states(spark, tmp_path):
    times = pd.date_range("2024-01-01", periods=8, freq="30min")
    rows = [("S", t.to_pydatetime(), v, 49.0, 50.0) for t, v in zip(times, [48.0, 48.0, 49.5, 49.5, 51.0, 51.0, 40.0, 40.0])]
    schema = "station_id string, timestamp timestamp_ntz, water_level double, warning_level double, danger_level double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = watch.gauge_watch(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "0 seconds")
    watch.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("hour").collect()
    assert [r.state for r in got] == ["NORMAL", "WARNING", "DANGER"]
