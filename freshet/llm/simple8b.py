"""Token ids in word-aligned Simple-8b blocks: written in document order, read back by vectorised decoding."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from freshet.llm.common import slices, together
from freshet.llm.word_ids import TEXT_BYTES, default_vocabulary, encoder
from freshet.session import checkpoint_root

# Fixed values of the code: selector s packs COUNTS[s] ids of WIDTHS[s] bits into the low 60 bits.
# Selector 0 is the escape: its word stands for one id of over 60 bits, kept beside the words.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK_IDS = 1024
_TOP = np.uint64(60)
_LIMITS = np.array([1 << int(w) for w in WIDTHS[1:]], np.uint64)  # the first id too wide for a selector
_WIDTH_OF = WIDTHS[[*range(1, 16), 0]].astype(np.int8)
_SMALL = _WIDTH_OF[np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right")]


def pack(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy packing of many blocks at once: `lengths` splits `ids` (uint64) into blocks.

    Returns the 64-bit words, the words per block, the escaped ids and the escapes per block. Every
    step gives each block that is not done one word, with the selector that takes most ids.
    """
    n = len(ids)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(n)
    best = _selectors(_widths(ids), left)
    taken = COUNTS[best]
    first = np.zeros(n, bool)
    at, stop = (ends - lengths)[lengths > 0], ends[lengths > 0]
    while len(at):
        first[at] = True
        at = at + taken[at]
        more = at < stop
        if not more.all():
            at, stop = at[more], stop[more]
    picked = np.flatnonzero(first)
    selector = best[picked]
    words = selector.astype(np.uint64) << _TOP
    for s in range(1, 16):
        rows = np.flatnonzero(selector == s)
        if len(rows) and WIDTHS[s]:
            start, packed = picked[rows], words[rows]
            for k in range(COUNTS[s]):
                packed |= ids[start + k] << np.uint64(k * WIDTHS[s])
            words[rows] = packed
    block = np.repeat(np.arange(len(lengths)), lengths)[picked]
    out = selector == 0
    per = [np.bincount(b, minlength=len(lengths)) for b in (block, block[out])]
    return words, per[0], ids[picked[out]], per[1]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All ids of any number of whole blocks, whose words stand in a row and whose escapes do too."""
    selector = (words >> _TOP).astype(np.int64)
    counts = COUNTS[selector]
    ends = np.cumsum(counts)
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in range(16):
        rows = np.flatnonzero(selector == s)
        if not len(rows):
            continue
        start = ends[rows] - counts[rows]
        if s == 0:
            ids[start] = escapes
        elif WIDTHS[s]:
            mask, packed = np.uint64((1 << int(WIDTHS[s])) - 1), words[rows]
            for k in range(COUNTS[s]):
                ids[start + k] = (packed >> np.uint64(k * WIDTHS[s])) & mask
    return ids


def _widths(ids: np.ndarray) -> np.ndarray:
    """The least selector width that holds each id; 64 for the escape."""
    if len(ids) and ids.max() < len(_SMALL):
        return _SMALL[ids]
    return np.append(_WIDTH_OF[:15], np.int8(64))[np.searchsorted(_LIMITS, ids, side="right")]


def _selectors(wide: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For a word that starts at each position: the selector that packs most ids, 0 for an escape."""
    best = np.zeros(len(wide), np.int8)
    widest = wide.max() if len(wide) else 0
    fit = None  # the places of ids that the last width holds: a narrower one holds only some of them
    for s in range(15, 0, -1):  # the later assignment, with the greater count, stays
        count = int(COUNTS[s])
        if widest <= WIDTHS[s]:
            best[left >= count] = s
            continue
        fit = np.flatnonzero(wide <= WIDTHS[s]) if fit is None else fit[wide[fit] <= WIDTHS[s]]
        if len(fit) >= count:
            start = fit[: len(fit) - count + 1]
            start = start[fit[count - 1 :] - start == count - 1]
            best[start[left[start] >= count]] = s
    return best


FILE = "shard int, doc_id bigint, before bigint, n_ids bigint, word_ends array<int>, escape_ends array<int>, coded binary"


def _write_blocks(vocabulary: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0  # ids of the shard's earlier documents: a task writes one shard
        for batch in together(batches, TEXT_BYTES):
            coded, before = _coded(batch, vocabulary, end_id, block_ids, before)
            yield coded

    return run


def _coded(batch: pa.RecordBatch, vocabulary: str, end_id: int, block_ids: int, before: int) -> tuple[pa.RecordBatch, int]:
    flat, counts = encoder(vocabulary).encode(batch.column("text"))
    ids = np.insert(flat.astype(np.uint64), np.cumsum(counts), np.uint64(end_id))
    counts = counts + 1
    per = -(-counts // block_ids)  # blocks of each document
    last = np.cumsum(per)
    nth = np.arange(last[-1]) - np.repeat(last - per, per)
    lengths = np.minimum(block_ids, np.repeat(counts, per) - nth * block_ids)
    words, n_words, escaped, n_escaped = pack(ids, lengths)
    offsets = pa.array(np.concatenate(([0], last)), pa.int32())
    ends, lists = {}, {}
    for name, n in (("words", n_words), ("escapes", n_escaped)):
        whole = np.cumsum(n)
        ends[name] = whole[last - 1]
        own = whole - np.repeat(np.concatenate(([0], ends[name][:-1])), per)
        lists[name] = pa.ListArray.from_arrays(offsets, pa.array(own, pa.int32()))
    starts = {k: np.concatenate(([0], v[:-1])) for k, v in ends.items()}
    coded = [
        words[a:b].tobytes() + escaped[c:d].tobytes()
        for a, b, c, d in zip(starts["words"], ends["words"], starts["escapes"], ends["escapes"])
    ]
    place = before + np.cumsum(counts) - counts
    columns = [
        batch.column("shard"), batch.column("doc_id"), pa.array(place), pa.array(counts),
        lists["words"], lists["escapes"], pa.array(coded, pa.binary()),
    ]
    names = ["shard", "doc_id", "before", "n_ids", "word_ends", "escape_ends", "coded"]
    return pa.RecordBatch.from_arrays(columns, names=names), before + int(counts.sum())


def write_ids(
    docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, block_ids: int = BLOCK_IDS, path: str | None = None
) -> str:
    """Encode every text, append `end_id`, and write coded blocks in ascending doc_id order; returns the path.

    Documents are range-partitioned and sorted on doc_id, so shard k holds documents before those of
    shard k + 1. A file row is one document: the ids of the shard before it, its number of ids, and
    its blocks of `block_ids` ids (the last may be shorter). `word_ends` and `escape_ends` are the
    per-block offsets into `coded`, which holds the 64-bit words of all its blocks and then the
    escaped ids, little-endian; with them any block decodes alone. Null text is the empty text (its
    one id is the end id); null doc_ids come first; repeated rows are separate documents, in any
    order among equals; other columns are ignored; an empty table writes no rows.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    path = path or f"{checkpoint_root(spark)}/freshet-ids-{uuid.uuid4().hex}"
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    placed = ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    coded = placed.mapInArrow(_write_blocks(vocabulary, end_id, block_ids), FILE)
    coded.write.option("compression", "none").parquet(path)
    return path


def decode(coded: list[bytes], n_words: np.ndarray) -> np.ndarray:
    """The ids of many documents in a row, from their `coded` bytes and word counts."""
    words = np.frombuffer(b"".join([b[: 8 * n] for b, n in zip(coded, n_words)]), "<u8")
    escapes = np.frombuffer(b"".join([b[8 * n :] for b, n in zip(coded, n_words)]), "<u8")
    return unpack(words, escapes)


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ends = batch.column("word_ends")
        last = ends.offsets.to_numpy()[1:] - 1
        ids = decode(batch.column("coded").to_pylist(), ends.values.to_numpy()[last]).astype("<u4")
        stop = np.cumsum(batch.column("n_ids").to_numpy())
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(np.concatenate(([0], stop[:-1])), stop)]
        kept = [batch.column(c) for c in ("doc_id", "shard", "before", "n_ids")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(crc, pa.int64())], names=["doc_id", "shard", "before", "n_tokens", "ids_crc32"]
        )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(FILE).parquet(path)
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # a row per shard, of which there are as many as the range exchange had partitions
    earlier = F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("shard", F.coalesce(earlier, F.lit(0)).alias("base"))
    schema = "doc_id bigint, shard int, before bigint, n_tokens bigint, ids_crc32 bigint"
    decoded = files.select("doc_id", "shard", "before", "n_ids", "word_ends", "coded").mapInArrow(_read_blocks, schema)
    return decoded.join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
