"""Packing documents into sequences of fixed size: bulk-synchronous best fit over size classes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from freshet.llm.common import together
from freshet.llm.word_ids import KEEP_WORDS, TEXT_BYTES, default_vocabulary, encoder
from freshet.session import materialize

_BROADCAST_FLOWS = 500_000  # five integers each: at most some 20 MB

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def _cut(vocabulary: str, end_id: int, capacity: int, with_ids: bool, keep_words: int, text_bytes: int = TEXT_BYTES):
    """Tokenise whole texts and cut only those that are longer than a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far in this task
        for batch in together(batches, text_bytes):
            flat, counts = encoder(vocabulary, keep_words).encode(batch.column("text"))
            ids = np.insert(flat, np.cumsum(counts), np.uint32(end_id)).astype("<u4")
            counts = counts + 1
            per = -(-counts // capacity)
            rows = np.repeat(np.arange(len(counts)), per)
            piece = np.arange(len(rows)) - np.repeat(np.cumsum(per) - per, per)
            length = np.minimum(capacity, counts[rows] - piece * capacity)
            stop = np.cumsum(length)
            raw = [ids[a:b] for a, b in zip(stop - length, stop)]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            nth = np.empty(len(rows), np.int64)
            nth[order] = np.arange(len(rows)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(rows)),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(piece * capacity),
                "length": pa.array(length),
                "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                "part": pa.array(np.full(len(rows), part), pa.int32()),
                "nth": pa.array(nth),
            } | ({"ids": pa.array([x.tobytes() for x in raw], pa.binary())} if with_ids else {})
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def sweep(lengths: dict[int, list[int]], gaps: dict[int, list[list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """One superstep: give every size class of documents its successors among the gaps.

    `lengths` maps a length to [first rank, documents left]; `gaps` maps a size to runs [first
    sequence, count] of sequences with that much room. From the longest down, a document takes the
    smallest gap that still holds it; among documents of a length the lower rank takes the lower
    sequence. Both maps are updated by what was matched; what a sequence has left over becomes a gap
    of the next superstep. Returns flows (length, first rank, documents, first sequence, gap).
    """
    open_gaps = sorted(gaps, reverse=True)
    stack: list[tuple[int, list[int]]] = []
    flows = []
    upcoming = 0
    for length in sorted(lengths, reverse=True):
        while upcoming < len(open_gaps) and open_gaps[upcoming] >= length:
            size = open_gaps[upcoming]
            stack.extend((size, run) for run in reversed(gaps[size]))
            upcoming += 1
        rank, left = lengths[length]
        while left and stack:
            size, run = stack[-1]
            n = min(left, run[1])
            flows.append((length, rank, n, run[0], size))
            rank, left = rank + n, left - n
            run[0], run[1] = run[0] + n, run[1] - n
            if not run[1]:
                stack.pop()
        lengths[length] = [rank, left]
    for length in [x for x, (_, left) in lengths.items() if not left]:
        del lengths[length]
    for size in list(gaps):
        gaps[size] = [run for run in gaps[size] if run[1]]
        if not gaps[size]:
            del gaps[size]
    for length, _, n, sequence, size in flows:
        if size > length:
            gaps.setdefault(size - length, []).append([sequence, n])
    return flows


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Flows (length, first rank, documents, first sequence, offset) that place all documents.

    The state of a superstep is one entry per document length and per run of equal gaps, so it is
    bounded by the sequence size, not by the corpus. Documents of over half a sequence open their
    own. When nothing fits any gap, the longest documents left open as many sequences as the tokens
    left need at the least.
    """
    lengths = {size: [0, n] for size, n in counts.items() if n}
    gaps: dict[int, list[list[int]]] = {}
    flows, sequences = [], 0

    def open_for(limit: int | None, least: int) -> None:
        nonlocal sequences
        for size in sorted(lengths, reverse=True):
            rank, left = lengths[size]
            n = left if limit is None or size > limit else min(left, least)
            if limit is not None and size <= limit and n <= 0:
                break
            flows.append((size, rank, n, sequences, 0))
            if size < capacity:
                gaps.setdefault(capacity - size, []).append([sequences, n])
            sequences += n
            lengths[size] = [rank + n, left - n]
            if limit is not None and size <= limit:
                least -= n
        for size in [x for x, (_, left) in lengths.items() if not left]:
            del lengths[size]

    open_for(capacity // 2, 0)
    while lengths:
        matched = sweep(lengths, gaps)
        flows.extend((size, rank, n, seq, capacity - gap) for size, rank, n, seq, gap in matched)
        if lengths and not matched:
            tokens = sum(size * left for size, (_, left) in lengths.items())
            open_for(capacity, max(1, -(-tokens // capacity)))
    return flows


def pack_documents(
    docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0, with_ids: bool = False,
    keep_words: int = KEEP_WORDS, text_bytes: int = TEXT_BYTES,
) -> DataFrame:
    """Place all of `docs` (doc_id, text) in sequences of `capacity` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and `ids` with
    `with_ids`). A document's tokens are its ids and then `end_id`; only longer documents are cut,
    into full pieces and a rest. Pieces are range-sorted by size as classes: each task numbers the
    pieces of every length, per-task counts turn those numbers into ranks over the corpus, and the
    supersteps of `plan` match rank ranges with sequence ranges, which each piece then looks up by
    its length and rank. Null text is the empty text (one end id), repeated rows are separate
    documents, null doc_ids stay null, `keep_words` bounds each worker's cache of words and `text_bytes` the texts it encodes together, other columns are ignored, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    schema = PIECE + (", ids binary" if with_ids else "")
    pieces = materialize(
        docs.select("doc_id", "text").mapInArrow(_cut(vocabulary, end_id, capacity, with_ids, keep_words, text_bytes), schema)
    )
    counted = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counted.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # at most `capacity` rows reach the driver
    sizes = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    flows = pd.DataFrame(plan(sizes, capacity), columns=["size", "first", "n", "sequence", "offset"], dtype="int64")
    placed = spark.createDataFrame(flows, "size bigint, first bigint, n bigint, sequence bigint, offset bigint")
    if len(flows) <= _BROADCAST_FLOWS:
        placed = F.broadcast(placed)
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    inside = (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    return ranked.join(placed, inside).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset",
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the little-endian 32-bit ids of whole sequences, from pieces that carry `ids`."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a sequence holds at most `capacity` ids
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"))
