"""Phrases that occur together, mined by dynamic itemset counting over cyclic scans of corpus shards."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from freshet.functions.series import salted_lookup
from freshet.llm.common import checked_broadcast, slices
from freshet.session import checkpoint_root, discard, materialize

LONGEST = 5
THRESHOLD = 100
SHARDS = 4
TOP = 2000
COVER = 100
WINDOW_BYTES = 4 << 20
MERGE_ROWS = 1 << 20
LOOKUP_ROWS = 400_000
TOP_SALTS = 64

# Bytes that end a piece (. , ; : ! ? and line feed to carriage return), and blanks inside one.
ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

TOKENS = "shard int, tokens array<bigint>, lang string, n bigint"
WORDS = "key bigint, lang string, word string"
COUNTS = "k tinyint, key bigint, prefix bigint, suffix bigint, n bigint"
_COUNTS = pa.schema([("k", pa.int8()), ("key", pa.int64()), ("prefix", pa.int64()), ("suffix", pa.int64()), ("n", pa.int64())])
_TOKENS = pa.schema([("shard", pa.int32()), ("tokens", pa.list_(pa.int64())), ("lang", pa.string()), ("n", pa.int64())])
# Hashes of words repeat within a slice, so that a dictionary larger than the writer's usual one halves them.
_STORED = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}


# ---- keys ----


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (a bijection); 0, which stands for a break, is given away."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x[x == 0] = 1
    return x


def _unmix(x: np.ndarray) -> np.ndarray:
    """The numbers that `_mix` spread."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


_SIDE = np.uint64(0x9E3779B97F4A7C15)


def _joined(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Keys of the phrases that have these subphrases (all words but the last, all but the first); 0 where either is 0."""
    made = _mix(prefix * _SIDE + suffix)
    made[(prefix == 0) | (suffix == 0)] = 0
    return made


def _suffix(key: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """The other side of `_joined`, so that tables of counts need not carry it; 0 for words, whose prefix is 0."""
    return np.where(prefix == 0, np.uint64(0), _unmix(key) - prefix * _SIDE)


def _powers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    base = (0x5851F42D4C957F2D + 8 * seed) % (1 << 64)
    up, down = np.full(WINDOW_BYTES + 1, base, np.uint64), np.full(WINDOW_BYTES + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _words(data: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased bytes: start, end, hash, and whether a piece ends between the last word and this one."""
    if seed not in _POWERS:
        _POWERS[seed] = _powers(seed)
    up, down = _POWERS[seed]
    kind = _KIND[data]
    inside = np.concatenate(([False], kind == 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    breaks = np.concatenate(([0], np.cumsum(kind == 2)))
    fresh = np.ones(len(starts), bool)
    fresh[1:] = breaks[starts[1:]] != breaks[ends[:-1]]
    hashes = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # a window of whole words, or of one word that is longer than a window
        first = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, first + WINDOW_BYTES, side="right")))
        s, e = starts[at:upto] - first, ends[at:upto] - first
        if e[-1] <= WINDOW_BYTES:
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data[first : first + e[-1]] + np.uint64(1)) * up[: e[-1]])))
            hashes[at:upto] = (sums[e] - sums[s]) * down[s]
        else:
            hashes[at] = _long(data[first : first + e[-1]], up)
        at = upto
    return starts, ends, _mix(hashes + (ends - starts).astype(np.uint64)), fresh


def _long(word: np.ndarray, up: np.ndarray) -> np.uint64:
    """The same sum for a word of several windows."""
    total, scale = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for k in range(0, len(word), WINDOW_BYTES):
        part = word[k : k + WINDOW_BYTES] + np.uint64(1)
        total += (part * up[: len(part)]).sum(dtype=np.uint64) * scale
        scale *= up[WINDOW_BYTES]
    return total[0]


def _lang_key(lang: str, seed: int) -> np.uint64:
    data = np.frombuffer(lang.encode() + b"\x00", np.uint8)
    return _mix(np.array([_long(data, _POWERS[seed][0]) + np.uint64(len(data))], np.uint64))[0]


class Slice:
    """Words of a batch (text, lang) in a row: bytes, starts, ends, keys, languages, and where pieces begin.

    A word's key covers its language, so that phrases of two languages never meet.
    """

    def __init__(self, batch: pa.RecordBatch, seed: int):
        texts = batch.column(0).fill_null("").cast(pa.large_binary())
        langs = batch.column(1).fill_null("und").dictionary_encode()
        _, offsets, values = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values is not None else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        # a line feed after every text keeps its words apart from the next one's
        self.data = np.insert(_LOWER[raw], bounds[1:], 10)
        bounds = bounds + np.arange(len(bounds))
        self.starts, self.ends, hashes, self.fresh = _words(self.data, seed)
        self.langs = langs.dictionary
        lang_keys = np.array([_lang_key(x, seed) for x in langs.dictionary.to_pylist()], np.uint64)
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[np.searchsorted(bounds, self.starts, side="right") - 1]
        self.keys = _mix(hashes ^ lang_keys[self.lang]) if len(hashes) else hashes

    def tokens(self) -> np.ndarray:
        """Keys of all words with 0 before every piece."""
        flat = np.zeros(len(self.keys) + int(self.fresh.sum()), np.uint64)
        flat[np.arange(len(self.keys)) + np.cumsum(self.fresh)] = self.keys
        return flat.view(np.int64)

    def counts(self) -> list[tuple[str, int]]:
        """Number of words of each language."""
        return list(zip(self.langs.to_pylist(), np.bincount(self.lang, minlength=len(self.langs)).tolist()))

    def spelled(self, bits: np.ndarray) -> pa.Table:
        """(key, lang, word) of the different words whose keys stand in the bitmap."""
        live = np.flatnonzero(_member(bits, self.keys))
        _, first = np.unique(self.keys[live], return_index=True)
        some = live[first]
        lengths = self.ends[some] - self.starts[some]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        letters = self.data[np.repeat(self.starts[some] - upto[:-1], lengths) + np.arange(upto[-1])]
        words = pa.LargeStringArray.from_buffers(len(some), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(letters))
        return pa.table(
            {"key": self.keys[some].view(np.int64), "lang": self.langs.take(pa.array(self.lang[some])), "word": words.cast(pa.string())}
        )


def _tokenize(seed: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        for part in slices(batches, WINDOW_BYTES):
            made = Slice(part, seed)
            rows = [(shard % shards, made.tokens(), None, None)] + [(shard % shards, None, lang, n) for lang, n in made.counts()]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _TOKENS)], schema=_TOKENS)
            shard += 1

    return run


def _spell(seed: int, bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, WINDOW_BYTES):
            yield from Slice(part, seed).spelled(bits).to_batches(max_chunksize=50_000)

    return run


# ---- one stop of the scan ----


def _member(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _ngrams(tokens: np.ndarray, lengths: list[int], bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, key, prefix, suffix) of all words, and of k-word phrases both of whose subphrases may be active."""
    words = tokens.view(np.uint64)
    if 1 in lengths:
        live = words[words != 0]
        zeros = np.zeros(len(live), np.uint64)
        yield 1, live, zeros, zeros
    shorter = words * _member(bits, words)
    for k in range(2, max(lengths) + 1):
        if len(shorter) < 2:
            return
        prefix, suffix = shorter[:-1], shorter[1:]
        longer = _joined(prefix, suffix)
        if k in lengths:
            live = np.flatnonzero(longer)
            yield k, longer[live], prefix[live], suffix[live]
        shorter = longer * _member(bits, longer)


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (key, prefix, suffix, n) with equal keys added up."""
    rows = np.concatenate(parts, axis=1)
    order = np.argsort(rows[0], kind="stable")
    rows = rows[:, order]
    first = np.ones(rows.shape[1], bool)
    first[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    heads = np.flatnonzero(first)
    out = rows[:, heads]
    out[3] = np.add.reduceat(rows[3], heads) if len(heads) else rows[3]
    return out


def _count(lengths: list[int], bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {k: [] for k in lengths}
        size: dict[int, int] = dict.fromkeys(lengths, 0)

        def flush(k: int) -> Iterator[pa.RecordBatch]:
            rows = _summed(held[k]).view(np.int64)
            held[k], size[k] = [], 0
            for at in range(0, rows.shape[1], 100_000):
                part = rows[:, at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(part.shape[1], k, np.int8)), *[pa.array(np.ascontiguousarray(c)) for c in part]], schema=_COUNTS
                )

        for batch in batches:
            for row in range(batch.num_rows):
                tokens = batch.column(0).slice(row, 1).flatten().to_numpy(zero_copy_only=False)
                for k, key, prefix, suffix in _ngrams(tokens, lengths, bits):
                    made = _summed([np.stack((key, prefix, suffix, np.ones(len(key), np.uint64)))])
                    held[k].append(made)
                    size[k] += made.shape[1]
                    if size[k] > MERGE_ROWS:
                        held[k] = [_summed(held[k])]
                        size[k] = held[k][0].shape[1]
                        if size[k] > MERGE_ROWS // 2:
                            yield from flush(k)
        for k in lengths:
            if held[k]:
                yield from flush(k)

    return run


def _with_suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, prefix = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "prefix"))
        columns = [batch.column("k"), batch.column("key"), batch.column("prefix"), pa.array(_suffix(key, prefix).view(np.int64)), batch.column("n")]
        yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)


def _bitmap(reached: DataFrame, count: int) -> np.ndarray:
    """Bits of all reached phrases' keys, 16 to 32 for each of them but never over 128 MB in all.

    It only spares work: what passes it is looked up exactly afterwards. The words of the bitmap are
    made by a grouped aggregate, so at most its own size reaches the driver.
    """
    bits = 1 << min(30, max(16, (16 * max(1, count)).bit_length()))
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = (
        reached.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, int((key & {bits - 1}L) & 63))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


class Counting:
    """Dynamic itemset counting: exact occurrences of every phrase that occurs `threshold` times or more.

    The corpus lies in shards that are scanned in a cycle, one stop at a time. A phrase is counted
    from the stop after both its subphrases (all words but the last, all but the first) have reached
    the threshold, and for one whole cycle, so lengths are counted interleaved and every count is over
    all shards. What a stop counts is one table; a phrase's cycle lies in the latest tables, one for each
    shard. Only phrases that occur threshold / shards times at some stop are added up over the
    tables, as no other can reach the threshold. A phrase's key and prefix give its suffix, which is put
    back at the end. Nothing is gathered but some numbers per length
    and the bitmap of reached keys.
    """

    def __init__(self, scanned: DataFrame, shards: int, longest: int, threshold: int):
        self.scanned, self.shards, self.longest, self.threshold = scanned, shards, longest, threshold
        spark = scanned.sparkSession
        self.tables: dict[int, DataFrame] = {}
        self.open = spark.createDataFrame([], "key bigint, start int, reach int")
        self.reached = spark.createDataFrame([], "key bigint, reach int")
        self.finished: list[DataFrame] = []
        self.last = {1: -1}  # per length, the latest start of a cycle
        self.n_reached = 0

    def run(self) -> DataFrame | None:
        """Finished phrases (k, key, prefix, suffix, n) with n >= threshold; None if there are none."""
        stop = 0
        while stop <= max(self.last.values()) + self.shards:
            self._stop(stop)
            stop += 1
        discard(*self.tables.values())
        if not self.finished:
            return None
        out = self.finished[0]
        for more in self.finished[1:]:
            out = out.unionByName(more)
        return materialize(out.mapInArrow(_with_suffix, COUNTS))

    def _stop(self, stop: int) -> None:
        lengths = [k for k, start in self.last.items() if start < stop <= start + self.shards]
        self._count(stop, lengths)
        old = self.tables.pop(stop - self.shards, None)
        cycle = list(self.tables.values())
        known = self.open.select("key", "start")
        if stop in self.tables:
            often = F.col("n") >= -(-self.threshold // self.shards)
            known = known.unionByName(self.tables[stop].where(often).select("key", "start")).distinct()
        counts = cycle[0]
        for table in cycle[1:]:
            counts = counts.unionByName(table)
        known = materialize(known)
        kept = counts.join(checked_broadcast(known, LOOKUP_ROWS), ["key", "start"], "left_semi")
        summed = kept.groupBy("k", "key", "prefix", "start").agg(F.sum("n").alias("n"))
        merged = materialize(
            summed.join(self.open, ["key", "start"], "left").withColumn(
                "reach", F.coalesce("reach", F.when(F.col("n") >= self.threshold, F.lit(stop)))
            )
        )
        if old is not None:
            discard(old)
        discard(known)
        ended = F.col("start") + self.shards <= stop
        seen = merged.groupBy("k").agg(
            F.sum(F.when(F.col("reach") == stop, 1).otherwise(0)).alias("fresh"),
            F.sum(F.when(ended & (F.col("n") >= self.threshold), 1).otherwise(0)).alias("done"),
        ).collect()  # fmt: skip — one row per length
        if any(r.done for r in seen):
            self.finished.append(merged.where(ended & (F.col("n") >= self.threshold)).select("k", "key", "prefix", "n"))
        if any(r.fresh for r in seen):
            self.n_reached += sum(r.fresh for r in seen)
            self.reached = materialize(self.reached.unionByName(merged.where(F.col("reach") == stop).select("key", "reach")))
            for r in seen:
                if r.fresh and r.k < self.longest:
                    self.last[r.k + 1] = stop
        self.open = merged.where(~ended).select("key", "start", "reach")

    def _count(self, stop: int, lengths: list[int]) -> None:
        """The table of this stop: phrases of its shard whose cycle is on."""
        if not lengths:
            return
        bits = _bitmap(self.reached, self.n_reached)
        tokens = self.scanned.where((F.col("shard") == stop % self.shards) & F.col("tokens").isNotNull()).select("tokens")
        counts = tokens.mapInArrow(_count(lengths, bits), COUNTS)
        started = self._started(counts, stop)
        self.tables[stop] = materialize(started.groupBy("k", "key", "prefix", "start").agg(F.sum("n").alias("n")))

    def _started(self, counts: DataFrame, stop: int) -> DataFrame:
        """Counts whose subphrases are both reached and whose cycle is not over; words have 0 on both sides."""
        words = self.reached.sparkSession.createDataFrame([(0, -1)], "key bigint, reach int")
        marked = self.reached.unionByName(words)
        out = counts
        for side in ("prefix", "suffix"):
            known = marked.select(F.col("key").alias(side), F.col("reach").alias(f"{side}_reach"))
            if self.n_reached <= LOOKUP_ROWS:
                out = out.join(F.broadcast(known), side)
            else:
                out = salted_lookup(out, known, [side], ["key"], "inner")
        out = out.withColumn("start", F.greatest("prefix_reach", "suffix_reach"))
        return out.where(F.col("start") + self.shards >= stop).select("k", "key", "prefix", "n", "start")


# ---- scores ----


def _spelled(finished: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """Phrases with their words, and the counts of their first and last 1, 2, … words.

    A phrase takes its words and the counts of its beginnings from its prefix, and its last word and
    the counts of its endings from its suffix, one length at a time.
    """
    named = words.select("key", "lang", F.array("word").alias("words"))
    empty = F.array().cast("array<bigint>")
    level = materialize(
        finished.where("k = 1").join(named, "key").select("key", "lang", "words", F.col("n").alias("a"), empty.alias("firsts"), empty.alias("lasts"))
    )
    levels = [level]
    for k in range(2, longest + 1):
        head = level.select(
            F.col("key").alias("prefix"), "lang", "words", F.array_append("firsts", F.col("a")).alias("firsts")
        )
        tail = level.select(
            F.col("key").alias("suffix"), F.element_at("words", -1).alias("tail"), F.array_append("lasts", F.col("a")).alias("lasts")
        )
        level = materialize(
            finished.where(F.col("k") == k).join(head, "prefix").join(tail, "suffix").select(
                "key", "lang", F.array_append("words", F.col("tail")).alias("words"), F.col("n").alias("a"), "firsts", "lasts",
                "prefix", "suffix",
            )
        )
        levels.append(level.withColumn("k", F.lit(k)))
    out = levels[1]
    for more in levels[2:]:
        out = out.unionByName(more)
    return out


def _scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """The lowest-scoring cut of each phrase: floor(1000 a n / (l r)) in decimals, ties to the earliest cut."""
    counted = phrases.join(F.broadcast(totals), "lang")  # one row per language
    n, a = F.col("n").cast("decimal(17,0)"), F.col("a").cast("decimal(15,0)")
    top = (a * n).cast("decimal(32,0)") * F.lit(1000).cast("decimal(4,0)")

    def cut(l, r, at):
        score = F.call_function("div", top, (l.cast("decimal(15,0)") * r.cast("decimal(15,0)")).cast("decimal(30,0)"))
        return F.struct(score.alias("score"), at.alias("cut"), l.alias("l"), r.alias("r"))

    cuts = F.transform("firsts", lambda l, i: cut(l, F.element_at("lasts", F.size("firsts") - i), i + 1))
    best = counted.withColumn("_cut", F.array_min(cuts))
    return best.select("*", "_cut.*").drop("_cut")


def collocations(
    docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS, cover: int = COVER, seed: int = 0
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    `docs` has text and lang. ASCII letters are lower-cased, texts split into pieces at the characters
    of ENDS and those into words at those of BLANKS. Per language (null: und), phrases of 2 to `longest` words
    with `threshold` occurrences or more are candidates, except those whose words stand in a longer
    candidate with at least `cover` per cent of their occurrences. A candidate's score is that of its
    lowest-scoring cut into l and r; the first `top` by score, occurrences and phrase are returned.

    Null and empty texts have no words; repeated rows count as often as they occur; other columns are
    ignored; an empty table gives an empty table. Words have keys of 64 bits; should two frequent words
    ever share one, the whole count is done again with other keys.
    """
    spark = docs.sparkSession
    path = f"{checkpoint_root(spark)}/freshet-phrases-{uuid.uuid4().hex}"
    texts = docs.select("text", "lang")
    texts.mapInArrow(_tokenize(seed, shards), TOKENS).write.options(**_STORED).partitionBy("shard").parquet(path)
    scanned = spark.read.schema(TOKENS).parquet(path)
    finished = Counting(scanned, shards, longest, threshold).run()
    if finished is None:
        return spark.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    frequent = finished.where("k = 1").select("key")
    count = frequent.count()
    spelled = texts.mapInArrow(_spell(seed, _bitmap(frequent, count)), WORDS)
    sure = F.broadcast(frequent) if count <= LOOKUP_ROWS else frequent
    words = materialize(spelled.join(sure, "key", "left_semi").distinct())
    if not words.groupBy("key").count().where("count > 1").isEmpty():
        return collocations(docs, threshold, longest, top, shards, cover, seed + 1)
    phrases = materialize(_spelled(finished, words, longest))
    # A longer phrase covers its own prefix and suffix; through them it covers all that it holds.
    wide = phrases.select(F.explode(F.array("prefix", "suffix")).alias("key"), (F.col("k") - 1).alias("k"), F.col("a").alias("f"))
    covered = wide.groupBy("k", "key").agg(F.max("f").alias("f"))
    free = phrases.join(covered, ["k", "key"], "left").where(F.coalesce(100 * F.col("f") < cover * F.col("a"), F.lit(True)))
    totals = scanned.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    scored = _scored(free, totals).select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "n", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS))
    some = scored.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order)))
    best = some.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return best.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM ws GROUP BY 1),
grams AS (SELECT lang, k, w[i : i + k - 1] AS p FROM ws, (SELECT unnest(range(1, {LONGEST + 1})) AS k) ks, unnest(range(1, len(w) - k + 2)) AS u(i)
          WHERE len(w) >= k),
f AS (SELECT lang, k, p, count(*)::HUGEINT AS c FROM grams GROUP BY ALL),
cand AS (SELECT lang, k, p, c FROM f WHERE k > 1 AND c >= {THRESHOLD}),
cuts AS (SELECT lang, k, p, c, j, n, l.c AS l, r.c AS r, (1000 * cand.c * n) // (l.c * r.c) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) cand JOIN total USING (lang)
  JOIN f l ON l.lang = cand.lang AND l.p = cand.p[1 : j] JOIN f r ON r.lang = cand.lang AND r.p = cand.p[j + 1 : cand.k]),
""".replace("SELECT lang, k, p, c, j, n, l.c", "SELECT cand.lang, cand.k, cand.p, cand.c, j, n, l.c") + rf"""
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
gone AS (SELECT DISTINCT a.lang, a.p FROM cand b, unnest(range(2, b.k)) AS m(m), unnest(range(1, b.k - m.m + 2)) AS s(i)
         JOIN cand a ON a.lang = b.lang AND a.p = b.p[s.i : s.i + m.m - 1] AND 100 * b.c >= {COVER} * a.c),
ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, c::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score,
  row_number() OVER (PARTITION BY lang ORDER BY score DESC, c DESC, encode(array_to_string(p, ' '))) AS rank
  FROM best ANTI JOIN gone USING (lang, p))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}
"""
