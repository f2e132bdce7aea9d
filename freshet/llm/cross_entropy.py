"""Cross-entropy difference: two matched word-bigram models over all words of the corpus score every document."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from freshet.llm.common import checked_broadcast, slices, together
from freshet.session import materialize

UNKNOWN = 16  # classes of words no model knows, by their length in bytes
_TOGETHER = 8 << 20  # bytes of text whose words and bigrams are counted together (up to twice that)
_BUCKETS, _BUCKET_BYTES = 256, 8 << 20  # ranges of keys: so many at least, and one for so many bytes of text
_WORD, _HISTORY, _PAIR = 0, 1, 2  # what a key counts, in its two lowest bits
_BEGIN = " "  # history of a text's first word; no word holds a blank
_ZSTD = pa.Codec("zstd", 1)


def _split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words, the word number at each place, and where each text begins and ends among them."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    kinds = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy(zero_copy_only=False)
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    if "" in kinds:
        full = at != kinds.index("")
        bounds = np.concatenate(([0], np.cumsum(full)))[bounds]
        at = at[full]
    return kinds, at, bounds


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 32 << 20):
        kinds, at, _ = _split(batch.column("text"))
        n = np.bincount(at, minlength=len(kinds))
        yield pa.RecordBatch.from_pydict({"word": pa.array(kinds, pa.string()), "n": pa.array(n, pa.int64())})


def vocabulary(docs: DataFrame, size: int) -> list[str]:
    """The `size` most frequent words over all documents; equal counts go by the word."""
    counted = docs.select("text").mapInArrow(_count_words, "word string, n bigint").where("n > 0")
    total = counted.groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in total.orderBy(F.desc("n"), "word").limit(size).collect()]


def _column(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name).chunks
    return pa.concat_arrays(chunks) if len(chunks) > 1 else chunks[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(x: np.ndarray, what: int) -> np.ndarray:
    return (_mixed(x) & ~np.uint64(3)) | np.uint64(what)


class Places:
    """Keys of the words, histories and bigrams of some texts, and the bigram at every place.

    A key is a hash of 62 bits and what it counts. `keys` are sorted; what is counted in the order
    words, histories, bigrams is brought into theirs by `order`.
    """

    def __init__(self, texts: pa.Array, known: frozenset[str] | None):
        kinds, at, self.bounds = _split(texts)
        if known is not None:
            kinds = [w if w in known else f" {min(UNKNOWN - 1, len(w.encode()) // 2)}" for w in kinds]
        digest = xxhash.xxh3_64_intdigest
        hashes = np.fromiter((digest(w) for w in kinds), np.uint64, len(kinds))
        hashes, same = np.unique(hashes, return_inverse=True)
        self.word = same[at]
        used = np.bincount(self.word, minlength=len(hashes)) > 0  # the empty word is none
        hashes, self.word = hashes[used], (np.cumsum(used) - 1)[self.word]
        n = self.n = len(hashes)
        history = np.concatenate(([n], self.word[:-1])) if len(self.word) else self.word
        history[self.bounds[:-1][self.bounds[:-1] < self.bounds[1:]]] = n
        pairs, self.pair = np.unique(history * np.int64(max(n, 1)) + self.word, return_inverse=True)
        self.history_of, self.word_of = np.divmod(pairs, max(n, 1))
        all_hashes = np.append(hashes, np.uint64(digest(_BEGIN)))
        both = all_hashes[self.history_of] * np.uint64(0x9E3779B97F4A7C15) + hashes[self.word_of]
        keys = np.concatenate((_key(hashes, _WORD), _key(all_hashes, _HISTORY), _key(both, _PAIR)))
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counts(self, weight: np.ndarray | None = None) -> np.ndarray:
        """How often each key stands in the texts, where every place weighs 1 or `weight`."""
        pairs = np.bincount(self.pair, weight, len(self.word_of))
        words = np.bincount(self.word_of, pairs, self.n)
        histories = np.bincount(self.history_of, pairs, self.n + 1)
        return np.concatenate((words, histories, pairs))[self.order].astype(np.int64)

    def parts(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one number a key, those of the words, histories and bigrams."""
        plain = np.empty(len(totals))
        plain[self.order] = totals
        return plain[: self.n], plain[self.n : 2 * self.n + 1], plain[2 * self.n + 1 :]


def _packed_keys(keys: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=np.uint64(0))
    return _ZSTD.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def _keys_of(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_ZSTD.decompress(packed, 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _packed(counts: np.ndarray) -> bytes:
    return _ZSTD.compress(counts.astype(np.int64).tobytes(), asbytes=True)


def _counts_of(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(packed, 8 * n, asbytes=True), np.int64)


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Buckets are equal ranges of keys: those that hold some of the sorted `keys`, and which."""
    starts = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    cuts = [0, *np.searchsorted(keys, starts).tolist(), len(keys)]
    for bucket, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            yield bucket, slice(a, b)


def _written(df: DataFrame) -> DataFrame:
    """`df`, materialized; shuffle files of the job go when it ends, as keys of the whole corpus pass through them."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return materialize(df)
    finally:
        conf.set(name, before)


_COUNTED = "bucket int, n int, keys binary, target binary, background binary"
_SUMMED = _COUNTED + ", n_words bigint, target_words bigint, background_words bigint"


_KINDS = {"bucket": pa.int32(), "slice": pa.int64(), "n": pa.int32(), "keys": pa.binary(), "target": pa.binary(), "background": pa.binary()}


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[name]) for c, name in zip(columns, names)], names=names)


def _counted(texts: pa.Array, target: list, buckets: int, known: frozenset[str] | None) -> list[tuple]:
    """Target and background counts of all keys of some texts: bucket, n, keys and both counts, a row for each bucket."""
    places = Places(texts, known)
    counts = places.counts(np.repeat(np.asarray(target, np.float64), np.diff(places.bounds))), places.counts()
    return [
        (bucket, at.stop - at.start, _packed_keys(places.keys[at]), *(_packed(c[at]) for c in counts))
        for bucket, at in _by_bucket(places.keys, buckets)
    ]


def _count(buckets: int, known: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches, _TOGETHER):
            rows = _counted(batch.column("text"), batch.column("target").to_pylist(), buckets, known)
            yield _rows(rows, ["bucket", "n", "keys", "target", "background"])

    return run


def _summed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[int]]:
    """Of the rows of a bucket: its different keys, which of them each row's keys are, both sums per key, and the rows' sizes."""
    sizes = rows.column("n").to_pylist()
    keys, which = np.unique(np.concatenate([_keys_of(p, n) for p, n in zip(rows.column("keys").to_pylist(), sizes)]), return_inverse=True)
    sums = []
    for name in ("target", "background"):
        counts = np.concatenate([_counts_of(p, n) for p, n in zip(rows.column(name).to_pylist(), sizes)])
        sums.append(np.bincount(which, counts, len(keys)).astype(np.int64))  # exact below 2**53
    return keys, which, sums, sizes


def _words_of(keys: np.ndarray, sums: list[np.ndarray]) -> tuple[int, int, int]:
    """Different words among the keys, and how often they stand in the target and in the background."""
    words = (keys & np.uint64(3)) == _WORD
    return int(words.sum()), *(int(s[words].sum()) for s in sums)


def _sum(key, rows):
    """One row for a bucket: its different keys and their counts over the whole corpus."""
    keys, _, sums, _ = _summed(rows)
    row = (key[0].as_py(), len(keys), _packed_keys(keys), *map(_packed, sums), *_words_of(keys, sums))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in _SUMMED.split(", ")]
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)


@dataclass(frozen=True)
class Models:
    """Counts of both models as a table of buckets of keys, and what smoothing needs of the whole corpus."""

    totals: DataFrame
    buckets: int
    known: frozenset[str] | None
    n_words: int  # different words and classes of unknown ones
    target_words: int
    background_words: int
    weight: float


def _bucket_count(docs: DataFrame) -> int:
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(_BUCKETS, -(-text_bytes // _BUCKET_BYTES))


def _marked(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, text, and whether the id is among those of `target`."""
    chosen = target.where("doc_id is not null").select("doc_id").distinct().withColumn("target", F.lit(True))
    marked = docs.select("doc_id", "text").join(checked_broadcast(chosen), "doc_id", "left")
    return marked.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))


def fit(docs: DataFrame, target: DataFrame, size: int | None = None, weight: float = 64.0) -> Models:
    """Bigram models of the documents whose ids are in `target` (doc_id) and of all documents.

    Counts cover every word of every document. Both models use the words of the whole corpus, one
    order and one smoothing, `weight` pseudo-counts of the add-one unigram model for a history, and
    the background's counts are scaled to the target's number of words, so that the smoothing
    weighs the same in both. Words, histories and bigrams are counted under hashes of 62 bits, once
    for some 8 MB of text, and summed by ranges of hashes, whose number follows the corpus; the
    driver gets three sums. `size` keeps only the most frequent words apart, and 16 classes of
    others by length; by default all are. Null texts have no words and null ids are no targets.
    """
    known = None if size is None else frozenset(vocabulary(docs, size))
    buckets = _bucket_count(docs)
    totals = _written(_marked(docs, target).select("text", "target").mapInArrow(_count(buckets, known), _COUNTED).groupBy("bucket").applyInArrow(_sum, _SUMMED))
    sums = totals.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "target_words", "background_words"))).first()
    different = sums[0] if known is None else len(known)
    return Models(totals.select("bucket", "n", "keys", "target", "background"), buckets, known, different + UNKNOWN, *sums[1:], weight)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as they come, one for some 8 MB of text."""
    first = TaskContext.get().partitionId() << 32
    for k, batch in enumerate(together(batches, _TOGETHER)):
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([first + k], pa.int64()), "body": pa.array([sink.getvalue()], pa.binary())})


def _texts_of(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


_SLICE = "slice bigint, body binary"
_ANSWER = "slice bigint, bucket int, n int, target binary, background binary"
_LOSSES = "doc_id bigint, n_words bigint, target_loss double, background_loss double, difference double"


def _score(known: frozenset[str] | None, weight: float, n_words: int, target_words: int, background_words: int):
    """Losses of a slice's texts from the answers of all buckets."""
    scaled = target_words > 0 and background_words > 0
    scales = (1.0, target_words / background_words if scaled else 1.0)
    sizes_of = (target_words, target_words if scaled else background_words)

    def score(key, bodies, answers):
        table = _texts_of(bodies.column("body")[0].as_py())
        places = Places(_column(table, "text"), known)
        answers = answers.sort_by("bucket")
        lengths = answers.column("n").to_pylist()
        sizes, means = np.diff(places.bounds), []
        for name, scale, total in zip(("target", "background"), scales, sizes_of):
            frames = [_counts_of(p, n) for p, n in zip(answers.column(name).to_pylist(), lengths)]
            found = np.concatenate(frames) if frames else np.zeros(len(places.keys), np.int64)
            words, histories, pairs = (scale * c for c in places.parts(found))
            single = (words + 1.0) / (total + n_words)
            logs = np.log((pairs + weight * single[places.word_of]) / (histories[places.history_of] + weight))
            upto = np.concatenate(([0.0], np.cumsum(logs[places.pair])))[places.bounds]
            means.append(-np.diff(upto) / np.maximum(sizes, 1))
        return pa.Table.from_arrays(
            [table.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(m) for m in means), pa.array(means[0] - means[1])],
            names=["doc_id", "n_words", "target_loss", "background_loss", "difference"],
        )

    return score


def losses(docs: DataFrame, models: Models) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, target_loss, background_loss and their difference, per word.

    Losses are mean negative log chances of whole texts; a lower difference is closer to the target.
    Slices of some 8 MB of text ask each bucket for the counts of their different keys, so that no
    key is asked more than once a slice, however frequent, and score their texts with the answers.
    Texts without words (null ones too) have zero losses. Repeated rows are scored each; other
    columns are ignored.
    """
    buckets, known = models.buckets, models.known

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for number, body in zip(batch.column("slice").to_pylist(), batch.column("body")):
                yield asked_of(number, body.as_py())

    def asked_of(number: int, body: bytes) -> pa.RecordBatch:
        keys = Places(_column(_texts_of(body), "text"), known).keys
        rows = [(bucket, number, at.stop - at.start, _packed_keys(keys[at])) for bucket, at in _by_bucket(keys, buckets)]
        return _rows(rows, ["bucket", "slice", "n", "keys"])

    def answer(key, asked, totals):
        held, counts = np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * 2
        if totals.num_rows:
            n = totals.column("n")[0].as_py()
            held = _keys_of(totals.column("keys")[0].as_py(), n)
            counts = [_counts_of(totals.column(c)[0].as_py(), n) for c in ("target", "background")]
        counts = [np.append(c, 0) for c in counts]
        out = []
        for number, n, packed in zip(*(asked.column(c).to_pylist() for c in ("slice", "n", "keys"))):
            keys = _keys_of(packed, n)
            at = np.searchsorted(held, keys)
            at[np.append(held, np.uint64(0))[at] != keys] = len(held)  # never counted
            out.append((number, key[0].as_py(), n, *(_packed(c[at]) for c in counts)))
        return pa.Table.from_batches([_rows(out, ["slice", "bucket", "n", "target", "background"])])

    cut = materialize(docs.select("doc_id", "text").mapInArrow(_cut, _SLICE))
    asked = cut.mapInArrow(ask, "bucket int, slice bigint, n int, keys binary")
    answers = _written(asked.groupBy("bucket").cogroup(models.totals.groupBy("bucket")).applyInArrow(answer, _ANSWER))
    score = _score(known, models.weight, models.n_words, models.target_words, models.background_words)
    return cut.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(score, _LOSSES)


def differences(docs: DataFrame, target: DataFrame, size: int | None = None, weight: float = 64.0) -> DataFrame:
    """`losses(docs, fit(docs, target, size, weight))`, with the keys of the corpus sent over the network once.

    A slice of some 8 MB of text sends each bucket its keys with their counts; the bucket sums them
    and returns the sums to the slices that sent them, so that nothing is asked a second time and no
    table of totals is kept. Nulls, ties, empty texts and other columns count as there.
    """
    known = None if size is None else frozenset(vocabulary(docs, size))
    buckets = _bucket_count(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for number, body in zip(batch.column("slice").to_pylist(), batch.column("body")):
                yield counted(number, body.as_py())

    def counted(number: int, body: bytes) -> pa.RecordBatch:
        table = _texts_of(body)
        rows = _counted(_column(table, "text"), table.column("target").to_pylist(), buckets, known)
        return _rows([(number, *row) for row in rows], ["slice", "bucket", "n", "keys", "target", "background"])

    def answer(key, rows):
        keys, which, sums, sizes = _summed(rows)
        ends = np.cumsum(sizes)
        out = [
            (number, key[0].as_py(), n, *(_packed(s[which[end - n : end]]) for s in sums))
            for number, n, end in zip(rows.column("slice").to_pylist(), sizes, ends)
        ]
        table = pa.Table.from_batches([_rows(out, ["slice", "bucket", "n", "target", "background"])])
        for name, total in zip(("n_words", "target_words", "background_words"), _words_of(keys, sums)):
            table = table.append_column(name, pa.array([total] + [0] * (len(out) - 1), pa.int64()))  # once a bucket
        return table

    cut = materialize(_marked(docs, target).mapInArrow(_cut, _SLICE))
    sent = cut.mapInArrow(count, f"slice bigint, {_COUNTED}")
    answers = _written(
        sent.groupBy("bucket").applyInArrow(answer, f"{_ANSWER}, n_words bigint, target_words bigint, background_words bigint")
    )
    sums = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "target_words", "background_words"))).first()
    different = sums[0] if known is None else len(known)
    score = _score(known, weight, different + UNKNOWN, *sums[1:])
    back = answers.select("slice", "bucket", "n", "target", "background")
    return cut.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(score, _LOSSES)
