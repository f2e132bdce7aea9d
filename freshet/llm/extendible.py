"""Exact deduplication over an extendible-hash index kept as shared files. DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.series import salted_lookup
from freshet.llm.common import checked_broadcast, once, one_blank, without
from freshet.session import checkpoint_root, materialize

DEEPEST = 40


def _prefix(depth: Column) -> Column:
    """The leading `depth` bits of the 64-bit hash; depth 0 is the one bucket of a new directory."""
    return F.when(depth == 0, F.lit(0).cast("bigint")).otherwise(F.expr("shiftrightunsigned(hash, 64 - depth)"))


def build_directory(keys: DataFrame, capacity: int) -> DataFrame:
    """Buckets (depth, prefix, n_keys) of an extendible hash over the distinct `hash` values of `keys`.

    It starts as one bucket. Every round doubles the directory: buckets over `capacity` keys split on
    the next bit, the others keep their local depth. Only the overfull buckets' keys are counted
    again. Equal hashes are one key and never split, so copies cannot overfill a bucket.
    """
    open_keys = materialize(keys.select("hash").distinct())
    leaves: list[DataFrame] = []
    depth = 0
    while True:
        placed = open_keys.withColumn("depth", F.lit(depth)).withColumn("prefix", _prefix(F.col("depth")))
        counted = materialize(placed.groupBy("depth", "prefix").agg(F.count(F.lit(1)).alias("n_keys")))
        full = counted.where(F.col("n_keys") > capacity) if depth < DEEPEST else counted.where("false")
        leaves.append(counted.where(F.col("n_keys") <= capacity) if depth < DEEPEST else counted)
        if full.isEmpty():
            break
        open_keys = materialize(placed.join(full.select("prefix"), "prefix", "left_semi").select("hash"))
        depth += 1
    out = leaves[0]
    for leaf in leaves[1:]:
        out = out.unionByName(leaf)
    return out


def write_index(docs: DataFrame, capacity: int = 20_000) -> DataFrame:
    """Index rows (row, doc_id, hash, sha, size, depth, bucket), written bucket by bucket and read back.

    The directory has a row per bucket, some keys / capacity of them. A key looks its bucket up once
    per local depth in use; AQE broadcasts the directory where its measured size allows.
    """
    text = one_blank(F.col("text"))
    keys = materialize(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("t")).select(
            "row", "doc_id", F.xxhash64("t").alias("hash"),
            F.unhex(F.sha2("t", 256)).alias("sha"), F.octet_length("t").alias("size"),
        )
    )
    directory = materialize(build_directory(keys, capacity))
    depths = [r["depth"] for r in directory.select("depth").distinct().collect()]  # at most DEEPEST + 1 numbers
    if not depths:
        return keys.withColumns({"depth": F.lit(0), "bucket": F.lit(0).cast("bigint")})
    tried = keys.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]))).withColumn(
        "prefix", _prefix(F.col("depth"))
    )
    owned = salted_lookup(tried, directory.select("depth", "prefix"), ["depth", "prefix"], ["row"], "inner")
    index = owned.withColumnRenamed("prefix", "bucket").repartition("depth", "bucket").sortWithinPartitions("depth", "bucket", "hash")
    path = f"{checkpoint_root(docs.sparkSession)}/freshet-index-{uuid.uuid4().hex}"
    index.write.parquet(path)
    return docs.sparkSession.read.schema(index.schema).parquet(path)


def exact_groups(docs: DataFrame, capacity: int = 20_000) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, text_hash.

    Texts are equal when identical after every run of blanks became one blank; null counts as empty.
    Keys (64-bit hash, SHA-256, size) go into an extendible-hash index on shared files. Rows whose
    hash is alone are done. For the others, owner tasks chain the different texts under a hash by
    comparing their bytes, so that even texts with equal hash and equal digest stay apart. Of equal
    texts, the smallest doc_id stays; a null doc_id stays only where all are null. Repeated rows are
    copies: exactly one row of a group has kept = true. An empty table gives an empty table; other
    columns are ignored.
    """
    index = write_index(docs, capacity)
    many = materialize(
        index.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    )
    # Bytes are read again only for documents whose hash is not alone.
    named = checked_broadcast(many)
    text = one_blank(F.col("text"))
    texts = docs.select("doc_id", text.alias("t")).withColumn("hash", F.xxhash64("t")).join(named, "hash", "left_semi")
    chains = materialize(
        texts.groupBy("hash", "t")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(
            "hash", F.unhex(F.sha2("t", 256)).alias("sha"), F.octet_length("t").alias("size"),
            "keep_id", "group_size", "t",
        )
    )
    key = ["hash", "sha", "size"]
    # Different texts under one key: those rows are told apart by their bytes below.
    clash = materialize(chains.groupBy(*key).agg(F.count(F.lit(1)).alias("links")).where("links > 1").select(*key))
    clear = chains.drop("t").join(clash, key, "left_anti")
    direct = salted_lookup(index.join(clash, key, "left_anti"), clear, key, ["row"], "left")
    if clash.isEmpty():
        found = direct
    else:
        byte_rows = texts.withColumns({"sha": F.unhex(F.sha2("t", 256)), "size": F.octet_length("t")}).join(
            clash, key, "left_semi"
        )
        told = byte_rows.withColumn("row", F.monotonically_increasing_id()).join(
            chains.join(clash, key, "left_semi"), [*key, "t"]
        )
        found = direct.select("row", "doc_id", "hash", "sha", "keep_id", "group_size").unionByName(
            told.select((-1 - F.col("row")).alias("row"), "doc_id", "hash", "sha", "keep_id", "group_size")
        )
    whole = found.select(
        "row", "doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.lower(F.hex("sha")).alias("text_sha256"), F.col("hash").alias("text_hash"),
    )
    first = _first_rows(whole)
    return first.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "text_hash")


def _first_rows(whole: DataFrame) -> DataFrame:
    """Exactly one kept row per group: among rows with doc_id = keep_id, the one with the smallest row."""
    is_first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    repeated = (
        whole.where(is_first)
        .groupBy(F.col("text_sha256").alias("sha_"), F.col("keep_id").alias("keep_"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("head"))
        .where("n > 1")
        .drop("n")
    )
    same = (F.col("text_sha256") == F.col("sha_")) & F.col("keep_id").eqNullSafe(F.col("keep_"))
    kept = is_first & (F.col("head").isNull() | (F.col("row") == F.col("head")))
    return whole.join(repeated, same, "left").withColumn("kept", kept)


def drop_copies(docs: DataFrame, capacity: int = 20_000) -> DataFrame:
    """`docs` with one row of every group of equal texts, all columns kept."""
    groups = exact_groups(docs, capacity)
    mark = F.xxhash64(one_blank(F.col("text")))
    gone = groups.where(~F.col("kept")).select("doc_id", "keep_id", F.col("text_hash").alias("mark"))
    gone = materialize(gone)
    other = ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    left = without(docs, gone.where(other), mark)
    return once(left, materialize(gone.where(~other).select("doc_id", "mark").distinct()), mark)


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
