"""Quality scores from document statistics: random Fourier features, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from freshet.llm.common import SLICE_BYTES, in_slices, slices
from freshet.session import materialize

ACCEPT = 0.3
STATISTICS = (
    "log_words", "word_bytes", "different_words", "same_as_last", "upper", "exclamations", "symbols", "bars",
    "digits", "stops", "line_ends", "above_ascii",
)
_BYTES = {
    "upper": bytes(range(65, 91)), "exclamations": b"!?", "symbols": b"#$%&*+=@^~<>{}[]\\/", "bars": b"|_",
    "digits": b"0123456789", "stops": b".,;:", "line_ends": b"\n\r", "above_ascii": bytes(range(128, 256)),
}


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text, over whole texts; null and empty texts have zeros throughout."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    out = np.zeros((n, len(STATISTICS)))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    edges = offsets - offsets[0]
    for k, name in enumerate(STATISTICS):
        if name in _BYTES:
            member = np.zeros(256, np.uint8)
            member[list(_BYTES[name])] = 1
            upto = np.concatenate(([0], np.cumsum(member[data], dtype=np.int64)))[edges]
            out[:, k] = np.diff(upto) / np.maximum(size, 1)
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = split.offsets.to_numpy()
    bounds = bounds - bounds[0]
    lengths = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[code] if len(code) else code
    word = lengths > 0
    owner = np.repeat(np.arange(n), np.diff(bounds))
    code, owner, lengths = code[word], owner[word], lengths[word]
    words = np.bincount(owner, minlength=n)
    some = np.maximum(words, 1)
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.bincount(owner, lengths, minlength=n) / some
    kinds = np.unique(owner * (code.max() + 1 if len(code) else 1) + code)
    out[:, 2] = np.bincount(kinds // (code.max() + 1 if len(code) else 1), minlength=n) / some
    same = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
    out[:, 3] = np.bincount(owner[1:][same], minlength=n) / some
    return out


def statistics_of(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = pa.array(list(statistics(batch.column("text"))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows], names=["doc_id", "statistics"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, statistics array<double>")


@dataclass(frozen=True)
class Model:
    """A fitted scorer; every part has a fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """cos(wx + b), whose inner products approximate a Gaussian kernel, and a constant."""
        z = (x - self.mean) / self.scale
        waves = np.cos(z @ self.directions + self.shifts) * np.sqrt(2 / len(self.shifts))
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def _as_rows(column) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def _sum_by_row(labelled: DataFrame, part, width: int) -> np.ndarray:
    """Sum over all partitions of the matrices that `part(x, y)` makes, one row of the matrix at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches, SLICE_BYTES // 8):
            x = _as_rows(pa.array(batch.column("statistics").to_pylist(), pa.list_(pa.float64())))
            made = part(x, batch.column("label").to_numpy(zero_copy_only=False).astype(float))
            total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int64()), pa.array([r.tobytes() for r in total], pa.binary())],
                names=["at", "line"],
            )

    def add(key, rows):
        lines = np.frombuffer(b"".join(rows.column("line").to_pylist())).reshape(rows.num_rows, -1)
        return pa.table({"at": [key[0].as_py()], "line": [lines.sum(axis=0).tobytes()]})

    lines = labelled.mapInArrow(run, "at bigint, line binary").groupBy("at").applyInArrow(add, "at bigint, line binary")
    found = {r["at"]: np.frombuffer(r["line"]) for r in lines.collect()}
    return np.array([found[k] for k in sorted(found)]).reshape(-1, width)


def isotonic(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the non-decreasing fit (pool adjacent violators) of sorted, binned scores."""
    blocks: list[list[float]] = []  # label sum, weight, first score, last score
    for s, y, w in zip(scores, labels, weights):
        blocks.append([y, w, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y2, w2, _, last = blocks.pop()
            blocks[-1][0] += y2
            blocks[-1][1] += w2
            blocks[-1][3] = last
    knots, levels = [], []
    for y, w, first, last in blocks:
        knots += [first, last]
        levels += [y / w] * 2
    return np.array(knots), np.array(levels)


def fit(
    labelled: DataFrame, n_features: int = 256, width: float = 3.0, ridge: float = 1.0, bins: int = 1000, seed: int = 7
) -> Model:
    """Fit on rows (statistics, label in 0/1). Three passes over the rows, each summed per partition.

    The driver gets moments, the (n_features + 1)-square normal equations and `bins` score bins,
    whatever the number of rows. Without labelled rows every score is 0.5; with labels of one kind
    only, every score is that label.
    """
    d = len(STATISTICS)
    moments = _sum_by_row(labelled, lambda x, y: np.vstack([x.sum(0), (x * x).sum(0), np.full(d, len(x))]), d)
    if not len(moments):
        moments = np.vstack([np.zeros((2, d)), np.ones(d)])
    mean = moments[0] / moments[2]
    spread = np.sqrt(np.maximum(moments[1] / moments[2] - mean * mean, 0))
    rng = np.random.default_rng(seed)
    model = Model(
        mean, np.where(spread > 1e-9, spread, 1.0), rng.standard_normal((d, n_features)) / width,
        rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), np.zeros(1), np.full(1, 0.5),
    )
    size = n_features + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    equations = _sum_by_row(labelled, normal, size + 1)
    if not len(equations):
        return model
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-6
    weights = np.linalg.solve(equations[:, :size] + np.diag(penalty), equations[:, size])
    model = Model(**{**model.__dict__, "weights": weights})

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = model.raw(x)
        at = np.clip(((raw + 0.5) / 2 * bins).astype(np.int64), 0, bins - 1)
        return np.vstack([np.bincount(at, v, minlength=bins) for v in (np.ones(len(x)), y, raw)])

    count, positive, total = _sum_by_row(labelled, binned, bins)
    held = count > 0
    knots, levels = isotonic(total[held] / count[held], positive[held], count[held])
    return Model(**{**model.__dict__, "knots": knots, "levels": levels})


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit_on_labels(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents of `stats` that are not held out; rows without a quality teach nothing."""
    known = labels.where("quality is not null").select("doc_id", F.col("quality").cast("double").alias("label"))
    rows = materialize(stats.where(~held_out()).join(known, "doc_id").select("statistics", "label"))
    return fit(rows)


def score_of(text: Column, model: Model) -> Column:
    scored = in_slices(lambda texts: pa.array(model.score(statistics(texts)), pa.float64()))
    return F.arrow_udf(scored, "double")(text)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = ACCEPT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score, predicted.

    The score is the calibrated chance of quality 1, from whole-text statistics alone. Held-out rows
    (crc32 of the id's text divisible by 5) never teach. Null text scores as the empty text, null ids
    are not held out and match no label; repeated rows are scored each and repeated labels count each.
    """
    stats = materialize(statistics_of(docs))
    model = fit_on_labels(stats, labels)
    scorer = F.arrow_udf(
        lambda rows: pa.array(model.score(_as_rows(pa.array(rows.to_pylist(), pa.list_(pa.float64())))), pa.float64()), "double"
    )
    return stats.select("doc_id", held_out().alias("held_out"), scorer("statistics").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
