"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.session import discard, materialize

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20


def words(text: Column) -> Column:
    """Runs of characters that are none of blank, tab, line feed, VT, FF, CR; null text: none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def one_blank(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, " ")


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand Python about SLICE_BYTES at a time; its own bound is far higher."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about `limit` bytes, so that a task's arrays stay small."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, min(rows, rows * limit // max(1, batch.nbytes)))
        for start in range(0, rows, step):
            yield batch.slice(start, step)
    _release()  # the worker lives on for other tasks


def together(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of some `limit` bytes (up to twice that), joined where they come smaller."""
    held, size = [], 0
    for batch in slices(batches, limit):
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _release() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_slices(function, limit: int = SLICE_BYTES):
    """An Arrow function of one column that sees about `limit` bytes at a time, whatever the batch it gets."""

    def run(column):
        rows = len(column)
        step = max(1, min(rows, rows * limit // max(1, column.nbytes)))
        return pa.concat_arrays([function(column.slice(k, step)) for k in range(0, rows, step)]) if rows else function(column)

    return run


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Whole runs of equal integer keys, from batches of a partition that is sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = np.stack([table.column(k).to_numpy().astype(np.int64) for k in keys])
        starts = np.concatenate(([0], np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1, [table.num_rows]))
        for a, b in zip(starts[:-1], starts[1:]):
            key = tuple(columns[:, a].tolist())
            if held and key != last:
                yield last, pa.concat_tables(held).combine_chunks()
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield last, pa.concat_tables(held).combine_chunks()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected group, for undirected edges (a, b).

    Every round, a node takes the smallest label among itself and its neighbours and then the label
    of that label, so that long chains shrink by half and more. Minima combine before the shuffle,
    so a node with very many neighbours is no hot group. Each round is a table in the shared folder.
    Edges with a null end are no edges.
    """
    both = materialize(
        edges.where("a is not null and b is not null")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.*")
        .distinct()
    )
    latest = labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        other = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        best = both.join(other, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        taken = labels.join(best, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = materialize(
            taken.join(far, "label", "left").select(
                "node", "old", F.least("label", F.coalesce("far", "label")).alias("label")
            )
        )
        discard(latest)
        latest, labels = moved, moved.select("node", "label")
        if moved.where("label < old").isEmpty():
            discard(both)
            return labels


def checked_broadcast(df: DataFrame, most: int = 500_000) -> DataFrame:
    """`df`, a few numbers wide, with a broadcast hint if it has at most `most` rows; else the join shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def _matched(docs: DataFrame, named: DataFrame, mark: Column, how: str) -> DataFrame:
    """`docs` joined by doc_id (null ids are equal) and `mark` to `named` (doc_id, mark), under names that no column has."""
    own_id, own_mark = f"_{uuid.uuid4().hex}", f"_{uuid.uuid4().hex}"
    side = named.select(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark)).distinct()
    return docs.join(checked_broadcast(side), F.col("doc_id").eqNullSafe(F.col(own_id)) & (mark == F.col(own_mark)), how)


def without(docs: DataFrame, dropped: DataFrame, mark: Column) -> DataFrame:
    """`docs` less the rows whose doc_id and `mark` stand in `dropped` (doc_id, mark); null ids count as equal."""
    return _matched(docs, dropped, mark, "left_anti")


def once(docs: DataFrame, repeated: DataFrame, mark: Column) -> DataFrame:
    """`docs` with one of the rows of each doc_id and `mark` that stand in `repeated` (doc_id, mark)."""
    if repeated.isEmpty():
        return docs
    name = f"_{uuid.uuid4().hex}"
    single = _matched(docs, repeated, mark, "left_semi").withColumn(name, mark).dropDuplicates(["doc_id", name]).drop(name)
    return without(docs, repeated, mark).unionByName(single)
