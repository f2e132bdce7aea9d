"""Features at each request's own time, and spells of contact on a stream that comes file by file."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from freshet.operators import models
from freshet.session import checkpoint_root
from freshet.streaming import watch

START = datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else START + timedelta(hours=hours)


def test_features_at_equals_a_plain_search(spark):
    known = [("A", h, float(h)) for h in (0, 5, 6, 2000, 2001, 9000)] + [("B", 100, 1.0), ("B", 101, None), (None, 3, 3.0), ("A", None, 7.0)]
    asked = [(k, s, h) for k, (s, h) in enumerate(
        [("A", h) for h in (-1, 0, 4, 5, 7, 1999, 2000, 8999, 20000, 5)] + [("B", 99), ("B", 101), ("B", 50000), ("C", 10), (None, 10), ("A", None), ("A", 4)]
    )]
    features = spark.createDataFrame([(s, at(h), v) for s, h, v in known], "station_id string, timestamp timestamp_ntz, rain double")
    requests = spark.createDataFrame([(k, s, at(h)) for k, s, h in asked], "id int, station_id string, requested_at timestamp_ntz")
    got = {r.id: (r.timestamp, r.rain) for r in models.features_at(requests, features).collect()}
    assert len(got) == len(asked)
    for k, station, hour in asked:
        before = [(h, v) for s, h, v in known if None not in (s, h, station, hour) and s == station and h <= hour]
        hour, value = max(before) if before else (None, None)
        assert got[k] == (at(hour), value), k


def test_features_at_keeps_repeated_requests_and_refuses_shared_names(spark):
    features = spark.createDataFrame([("A", at(0), 1.0)], "station_id string, timestamp timestamp_ntz, rain double")
    requests = spark.createDataFrame([("A", at(1))] * 3, "station_id string, requested_at timestamp_ntz")
    assert [r.rain for r in models.features_at(requests, features).collect()] == [1.0] * 3
    assert [r.rain for r in models.features_at(requests, features.limit(0)).collect()] == [None] * 3
    assert models.features_at(requests.limit(0), features).count() == 0
    with pytest.raises(ValueError, match="rain"):
        models.features_at(requests.withColumn("rain", F.lit(0)), features)


def test_spells_count_repeats_once_whatever_the_batches(spark, tmp_path):
    files = [
        [("A", 0, 1.0), ("A", 1, 2.0), ("B", 0, 5.0), (None, 1, 0.0), ("A", None, 0.0)],
        [("A", 1, 2.0), ("A", 3, 9.0), ("B", 3, 6.0)],  # A at 1 again; 3 is within A's gap and just at the end of B's
        [("A", 6, 4.0), ("C", 5, 1.0), ("B", 3, 6.0)],  # A was silent from 5 on
        [("Z", 40, 0.0)],
        [("Z", 41, 0.0)],
    ]
    schema = "station_id string, timestamp timestamp_ntz, water_level double"
    folder = f"{tmp_path}/readings"
    for k, rows in enumerate(files):
        spark.createDataFrame([(s, at(h), v) for s, h, v in rows], schema).coalesce(1).write.mode("append").parquet(f"{folder}/part={k}")
    stations = spark.createDataFrame([("A", "2 hours"), ("B", "3 hours"), ("C", None)], "station_id string, report_gap string")
    want = {("A", at(0), at(3), at(5), 3, 9.0), ("A", at(6), at(6), at(8), 1, 4.0), ("B", at(0), at(3), at(6), 2, 6.0), ("C", at(5), at(5), at(11), 1, 1.0)}
    for k, limit in enumerate((1, 10)):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", limit).option("recursiveFileLookup", "true").parquet(folder)
        path = f"{checkpoint_root(spark)}/spells-{tmp_path.name}-{k}"
        watch.append_to(watch.contact_spells(stream, stations, "10 hours"), path, f"{path}-log").awaitTermination()
        got = [tuple(r) for r in spark.read.parquet(path).collect()]
        assert len(got) == len(want) and set(got) == want
