"""Line frequency (1) and exact deduplication (8): SQL, fixtures, and what must not crash."""

import hashlib
import os
import re
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "scripts"))

import compare  # noqa: E402
import corpora  # noqa: E402
from freshet.llm import extendible, line_frequency  # noqa: E402
from freshet.llm.queries import ORACLES, QUERIES  # noqa: E402

needs_data = pytest.mark.skipif(not os.path.isdir(corpora.SF_DIR), reason="supplied tables not present")


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in compare.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{corpora.SF_DIR}/{table}.parquet'")
    ok, text = compare.compare(spark, con, name, QUERIES[name], ORACLES[name], corpora.SF_DIR)
    assert ok, text


def test_native_plans_hold_no_python(spark):
    docs = corpora.awkward(spark)
    for df in (line_frequency.line_frequency(docs), extendible.exact_groups(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_line_rules_on_awkward_rows(spark):
    docs = corpora.awkward(spark)
    got = line_frequency.line_frequency(docs, with_text=True).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    for i in (4, 5, 6):
        assert (by_id[i]["n_words"], by_id[i]["base_failed"], by_id[i]["kept"]) == (0, True, False)
    assert by_id[9]["n_repeat_words"] == 30_000 and by_id[9]["base_failed"]
    assert by_id[7]["kept"] and by_id[7]["n_repeat_words"] == 0
    assert line_frequency.line_frequency(corpora.nothing(spark)).collect() == []


def test_common_lines_go_and_depleted_documents_with_them(spark):
    own = [" ".join(f"d{d}w{k}" for k in range(60)) for d in range(40)]
    rows = [(d, f"Share THIS  page\n{own[d]}", "h") for d in range(20)]
    rows += [(d, own[d], "h") for d in range(20, 40)]
    rows += [(100 + d, "Share this page\n" * 60 + f"left {d}", "h") for d in range(20)]
    rows += [(200 + d, own[0] + "\nmore\n" + own[1], "copies") for d in range(30)]  # copies count once
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in line_frequency.line_frequency(docs, with_text=True).collect()}
    assert all(got[d]["kept"] and got[d]["removed_words"] == 3 and got[d]["clean_text"] == own[d] for d in range(20))
    assert all(got[d]["kept"] and got[d]["removed_words"] == 0 for d in range(20, 40))
    assert all(not got[100 + d]["kept"] and got[100 + d]["clean_text"] == f"left {d}" for d in range(20))
    assert all(got[200 + d]["kept"] for d in range(30))


def _expected_groups(rows):
    normal = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    out = []
    for d, t in normal:
        ids = [i for i, x in normal if x == t]
        known = [i for i in ids if i is not None]
        out.append((d, min(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_exact_groups_on_awkward_rows(spark):
    docs = corpora.awkward(spark)
    got = extendible.exact_groups(docs, capacity=2).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(
        _expected_groups(corpora.pairs(docs)), key=key
    )
    groups = {r["text_sha256"] for r in got}
    assert sorted(r["text_sha256"] for r in got if r["kept"]) == sorted(groups)  # one row of each stays
    left = extendible.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert extendible.exact_groups(corpora.nothing(spark)).collect() == []
    assert extendible.drop_copies(corpora.nothing(spark)).collect() == []


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("hash")).union(spark.range(3000).select(F.lit(7).cast("bigint").alias("hash")))
    buckets = extendible.build_directory(keys, 100).collect()
    assert all(b["n_keys"] <= 100 for b in buckets) and sum(b["n_keys"] for b in buckets) == 5001
    assert abs(sum(2.0 ** -b["depth"] for b in buckets) - 1) < 0.2  # buckets are disjoint parts of the key space
    assert len({(b["depth"], b["prefix"]) for b in buckets}) == len(buckets)


def test_texts_with_equal_keys_are_told_apart_by_their_bytes(spark, monkeypatch):
    # all digests and hashes collide, so only the bytes can tell
    monkeypatch.setattr(extendible.F, "xxhash64", lambda *c: F.lit(5).cast("bigint"))
    monkeypatch.setattr(extendible.F, "sha2", lambda *c: F.lit("ab"))
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, "bb"), (5, "cc")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in extendible.exact_groups(docs).collect()}
    assert got == {1: (1, 2, True), 2: (2, 2, True), 3: (1, 2, False), 4: (2, 2, False), 5: (5, 1, True)}
