"""Gauge and rain series: hand-made fixtures, and brute force over several slices and blocks."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.functions import series
from freshet.functions.ordering import global_ordinal, running_totals
from freshet.functions.quantiles import exact_percentiles
from freshet.functions.selection import first_by_hash
from freshet.operators import features, quality
from freshet.operators.labels import label_floods
from freshet.plans.flood import labelled_gauges


def gauge(spark, rows, station="S1"):
    data = [(station, pd.Timestamp(t).to_pydatetime(), None if v is None else float(v), 49.0, 50.0, i) for i, (t, v) in enumerate(rows)]
    return spark.createDataFrame(
        data, "station_id string, timestamp timestamp_ntz, water_level double, warning_level double, danger_level double, seq long"
    )


def hours(n, start="2024-01-01"):
    return list(pd.date_range(start, periods=n, freq="h"))


def report(df):
    return quality.validate_gauge(df).first()


def test_validation_accepts_clean_series(spark):
    assert report(gauge(spark, zip(hours(10), np.linspace(45, 50, 10)))).is_valid


def test_validation_reports_negative_duplicate_and_backward(spark):
    levels = list(np.linspace(45, 50, 10))
    levels[5] = -10
    row = report(gauge(spark, zip(hours(10), levels)))
    assert not row.is_valid and row.negatives == 1 and "negative" in row.errors[0]
    times = hours(10)
    row = report(gauge(spark, zip(times + times[:1], [45.0] * 11)))
    assert row.duplicates == 1 and row.backward_steps == 1 and len(row.errors) == 2


def test_cleaning_drops_spike_fills_short_gap_flags_long_gap(spark):
    times, levels = hours(100), list(np.linspace(45, 50, 100))
    levels[50] = 60.0
    keep = [i for i in range(100) if i not in (20, 21, 22) and not 70 <= i <= 78]
    out = quality.clean_levels(gauge(spark, [(times[i], levels[i]) for i in keep])).orderBy("timestamp").toPandas()
    assert (out.water_level < 60).all() and out.timestamp.is_monotonic_increasing and out.timestamp.is_unique
    # the spike removes itself and the return row; three missing rows and those two are filled
    assert (out.quality_flag == "interpolated").sum() == 5
    assert out[out.quality_flag == "gap"].timestamp.tolist() == [times[79]]
    filled = out[out.timestamp == times[21]].water_level.item()
    assert filled == pytest.approx(levels[21], abs=1e-9)


def test_rejected_station_gives_no_rows_unless_repaired(spark):
    times = hours(5)
    df = gauge(spark, zip(times + [times[2]], [45, 45.1, 45.2, 45.3, 45.4, 46]))
    assert quality.clean_levels(df).count() == 0
    repaired = quality.clean_levels(df, repair=True).orderBy("timestamp").toPandas()
    assert len(repaired) == 5 and repaired.water_level[2] == pytest.approx(45.2)


def test_hourly_fill_counts(spark):
    start = pd.Timestamp("2024-01-01")
    steps = [0, 1, 2.75, 5.75, 9.75, 20]  # 1.75 h adds none, 3 h adds two, 4 h adds three, the rest is long
    rows = [("C", (start + pd.Timedelta(hours=h)).to_pydatetime(), float(h), "x") for h in steps]
    df = spark.createDataFrame(rows, "catchment_id string, timestamp timestamp_ntz, rainfall_mm double, note string")
    out = quality.fill_hourly(df).orderBy("timestamp").toPandas()
    added = out[out.quality_flag == "interpolated"]
    assert len(added) == 5 and set(added.note) == {"x"}
    offset = (added.timestamp - start).dt.total_seconds() / 3600
    assert np.allclose(offset, added.rainfall_mm)
    assert (out.quality_flag == "gap").sum() == 1


def test_labels_by_hand(spark):
    levels = [51, 49, 48, 50, 52, 47, None, 50.5, 46]
    out = label_floods(gauge(spark, zip(hours(9), levels))).orderBy("timestamp").toPandas()
    assert out.label.tolist() == [1, 0, 0, 1, 1, 0, 0, 1, 0]
    assert out.lead_time_hours.fillna(-1).tolist() == [-1, 2, 1, -1, -1, 2, 1, -1, -1]
    assert out.event_id.fillna(0).tolist() == [1, 0, 0, 2, 2, 0, 0, 3, 0]
    assert out.event_duration_hours[3] == 1 and out.peak_level[3] == 52


def brute_labels(pdf):
    pdf = pdf.sort_values("timestamp").reset_index(drop=True)
    label = (pdf.water_level >= 50).astype(int)
    lead, event, current = [None] * len(pdf), [None] * len(pdf), 0
    upcoming = None
    for i in range(len(pdf) - 1, -1, -1):
        if label[i] == 0 and upcoming is not None:
            lead[i] = (upcoming - pdf.timestamp[i]).total_seconds() / 3600
        if label[i] == 1 and i > 0 and label[i - 1] == 0:
            upcoming = pdf.timestamp[i]
    for i in range(len(pdf)):
        if label[i] == 1:
            if i == 0 or label[i - 1] == 0:
                current += 1
            event[i] = current
    return pdf.assign(label=label, lead=lead, event=event)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_labels_across_slices_match_brute_force(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    # ten-month series with empty months, so slices are skipped and events span slice borders
    days = np.sort(rng.choice(300, 120, replace=False))
    days = days[(days < 60) | (days > 130)]
    times = [pd.Timestamp("2023-01-01") + pd.Timedelta(days=int(d)) for d in days]
    levels = np.where(rng.random(len(days)) < 0.6, 51.0, 48.0) + rng.random(len(days))
    out = label_floods(gauge(spark, zip(times, levels))).orderBy("timestamp").toPandas()
    want = brute_labels(pd.DataFrame({"timestamp": times, "water_level": levels}))
    assert out.label.tolist() == want.label.tolist()
    assert out.event_id.fillna(0).tolist() == pd.Series(want.event, dtype=float).fillna(0).tolist()
    assert np.allclose(out.lead_time_hours.fillna(-1), pd.Series(want.lead, dtype=float).fillna(-1))
    stats = want.dropna(subset=["event"]).groupby("event").agg(a=("timestamp", "min"), b=("timestamp", "max"), peak=("water_level", "max"))
    got = out.dropna(subset=["event_id"]).groupby("event_id").agg(d=("event_duration_hours", "first"), peak=("peak_level", "first"))
    assert np.allclose(got.d, (stats.b - stats.a).dt.total_seconds() / 3600) and np.allclose(got.peak, stats.peak)


def test_previous_row_skips_empty_slices_and_unkept_rows(spark):
    times = ["2024-01-01", "2024-01-02", "2024-06-01", "2024-06-02"]
    df = gauge(spark, zip(times, [1, 2, 3, 4]))
    out = series.with_previous(df, ["station_id"], "timestamp", ["water_level"], keep=F.col("water_level") != 2).orderBy("timestamp")
    assert [r["_prev"]["water_level"] if r["_prev"] else None for r in out.collect()] == [None, 1, 1, 3]


@pytest.mark.parametrize("step", [None, 1.0])
def test_window_features_match_pandas(spark, monkeypatch, step):
    monkeypatch.setattr(series, "BLOCK_ROWS", 64)
    monkeypatch.setattr(features, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(5)
    frames = []
    for name, freq, n in [("A", "1h", 500), ("B", "1h" if step else "3h", 300)]:
        v = rng.random(n)
        v[rng.random(n) < 0.1] = np.nan
        frames.append(pd.DataFrame({"station_id": name, "timestamp": pd.date_range("2024-01-01", periods=n, freq=freq), "rain": v}))
    data = pd.concat(frames)
    df = spark.createDataFrame(data).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    df = df.withColumn("rain", F.when(~F.isnan("rain"), F.col("rain")))
    out = features.windowed_features(df, {"rain": (1, 2)}, {"rain": ((1, 3), ("sum", "mean", "max"))}, step=step)
    got = out.orderBy("station_id", "timestamp").toPandas()
    for name, freq, n in [("A", 1, 500), ("B", 1 if step else 3, 300)]:
        v = data[data.station_id == name].rain.reset_index(drop=True)
        g = got[got.station_id == name].reset_index(drop=True)
        for d in (1, 2):
            want = v.shift(d * 24 // freq)
            assert np.allclose(g[f"rain_lag_{d}"].astype(float), want, equal_nan=True)
        for d in (1, 3):
            roll = v.rolling(d * 24 // freq, min_periods=1)
            for a in ("sum", "mean", "max"):
                assert np.allclose(g[f"rain_{d}d_{a}"].astype(float), getattr(roll, a)(), equal_nan=True)


def test_exact_percentiles_use_brackets(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(50, 2, 4000), np.full(3000, 49.5), [1e9, -1e9]])
    pdf = pd.DataFrame({"k": np.where(np.arange(len(values)) % 7 == 0, "b", "a"), "v": values})
    out = exact_percentiles(spark.createDataFrame(pdf), ["k"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, accuracy=100).toPandas().set_index("k")
    for k, group in pdf.groupby("k"):
        assert np.allclose(out.loc[k, ["q1", "q2", "q3"]].astype(float), group.v.quantile([0.25, 0.5, 0.75]))


def test_anomalies_find_outliers_by_both_methods(spark):
    values = list(np.random.default_rng(42).normal(50, 2, 100)) + [70, 75, 20, 15]
    df = gauge(spark, zip(hours(104), values))
    for method in ("iqr", "zscore"):
        found = quality.detect_anomalies(df, "water_level", method=method, threshold=3.0).where("is_anomaly")
        assert found.count() >= 4
    with pytest.raises(ValueError):
        quality.detect_anomalies(df, "water_level", method="median")


def test_global_ordinal_and_totals(spark):
    df = spark.range(1000).select(F.col("id"), F.xxhash64("id").alias("h"), F.lit(2).alias("n"))
    out = global_ordinal(df, ["h"], total="total").toPandas().sort_values("h")
    assert out.ordinal.tolist() == list(range(1000)) and set(out.total) == {1000}
    sums = running_totals(df, ["h"], {"n": "upto"}).toPandas().sort_values("h")
    assert sums.upto.tolist() == list(range(2, 2001, 2)) and set(sums.upto_total) == {2000}


def test_first_by_hash_is_exact_and_repeatable(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    quotas = spark.createDataFrame([(0, 1234), (1, 99999)], "label int, quota long")
    picked = first_by_hash(df, quotas, "label", ["id"])
    counts = {r.label: r["count"] for r in picked.groupBy("label").count().collect()}
    assert counts == {0: 1234, 1: 1667}
    again = first_by_hash(df.repartition(7), quotas, "label", ["id"])
    assert picked.exceptAll(again).isEmpty()


def test_label_plan_keeps_only_clean_rows(spark):
    out = labelled_gauges(gauge(spark, zip(hours(48), np.linspace(48, 52, 48))))
    assert out.count() == 48 and out.where("label = 1").count() == 24


def test_feature_checks(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert features.validate_features(df, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(ValueError, match="missing.*c.*extra.*b"):
        features.validate_features(df, ["a", "c"])


def test_step_of_a_jittered_series_is_its_exact_median(spark):
    from freshet.functions.series import step_hours

    rng = random.Random(2)
    at, rows = 1_704_067_200_000_000, []
    for _ in range(30_000):
        at += 3_600_000_000 + rng.randrange(-1_000_000_000, 1_000_000_000)
        rows.append(("S", at))
    df = spark.createDataFrame(rows, "station_id string, us bigint").select("station_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("timestamp"))
    gaps = sorted(b[1] - a[1] for a, b in zip(rows, rows[1:]))
    assert len(set(gaps)) > 29_000
    assert step_hours(df, ("station_id",), "timestamp").first().step_hours == pytest.approx(gaps[len(gaps) // 2] / 3.6e9, abs=1e-9)
