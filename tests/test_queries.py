"""Registered queries against their SQL on the smallest tables (scripts/compare.py runs them all)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import compare  # noqa: E402
from freshet.queries import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "p2_validate_gauge", "w1_dedup_first", "a3_iqr_bounds", "w4_jump_filter", "w6_flood_label", "m8_label_gauges",
    "w3_gap_fill_hourly", "f23_sampling_points", "w10_rolling_features", "j13_predictions_to_zones", "f15_alerts_from_zones",
    "f18_user_priority", "a21_location_status", "j12_combined_risk", "f22_grid_cells", "a13_roc_pr_auc", "t8_time_split",
    "t2_driver_strings", "r5_flow_direction", "r6_flow_accumulation", "t5_sample_vertices", "j10_nearest_hazard",
    "s6_parse_hourly_payload", "f27_parse_date", "s5_weather_store", "st3_gauge_watch", "m2_landslide_training_set", "m5_landslide_inference_features", "m5_request_features", "st3_contact_spells", "r4_r10_conditioned_extent", "r10_outline_areas", "r3_resolve_flats", "st1_zone_registry", "st2_position_alerts",
]
WITHOUT_SQL = {
    "r10_flood_outlines", "r11_catchment_outline",
    "m3_train", "m4_score", "m4_score_evaluated", "m6_contributions", "m6_attributions", "s12_model_artifacts",
}

needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="supplied tables not present")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in compare.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL and set(ORACLES) <= set(QUERIES)


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    ok, text = compare.compare(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR)
    assert ok, text


@needs_data
def test_entry_has_rows(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
