"""Secret scan: fixed patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.llm.common import in_slices, slices

# Fixed patterns of the base scan, in the order of their kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
KEYWORD = r"password|passwd|secret|token|api_?key"
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # state 0: before the first and after the last character
MIN_CHARS = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
PART = re.compile(r"[A-Za-z0-9+]{%d,}" % MIN_CHARS)
ORDINARY, RANDOM = (0, 3), (1, 2, 4)  # labels of samples: text, identifiers; Base64, lower-case and upper-case hex
_STATE = np.zeros(256, np.int64)
_STATE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, STATES)


def base_spans(text: str, keyword: bool = True) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    found = []
    if keyword:
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transitions between characters per label; one row per label and task."""
    totals: dict[int, np.ndarray] = {}
    for batch in slices(batches):
        labels = np.asarray(batch.column("label").fill_null(-1).to_pylist(), np.int64)
        texts = batch.column("text").fill_null("")
        for label in set(labels.tolist()) - {-1}:
            mine = texts.filter(pa.array(labels == label))
            parts = mine.to_pylist()
            if label == 0:  # what the patterns call a secret is no ordinary identifier
                hits = pc.match_substring_regex(mine, KEYWORD, ignore_case=True).to_pylist()
                parts = [_blanked(t, k) for t, k in zip(parts, hits)]
            state = _STATE[np.frombuffer(("\n" + "\n".join(parts) + "\n").encode(), np.uint8)]
            pairs = np.bincount(state[:-1] * STATES + state[1:], minlength=STATES * STATES)
            totals[label] = totals.get(label, 0) + pairs
    for label, pairs in totals.items():
        pairs[0] = 0
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), label)), pa.array(at), pa.array(pairs[at])], names=["label", "pair", "n"]
        )


def _blanked(text: str, keyword: bool) -> str:
    for start, _, end in base_spans(text, keyword):
        text = text[:start] + " " * (end - start) + text[end:]
    return text


class Chances(NamedTuple):
    """Log chances of character transitions, a row for each model of random strings and of ordinary ones."""

    random: np.ndarray
    ordinary: np.ndarray


def train(samples: DataFrame, backing: float = 2.0) -> Chances:
    """Character models of random and of ordinary strings, from samples (text, label).

    Labels 0 and 3 mark text and ordinary identifiers, labels 1, 2 and 4 three kinds of random strings;
    each has a model of its own, and a label without samples has none. Other labels and null
    texts teach nothing. Transitions within runs of the alphabet are counted in the tasks and summed by Spark;
    the driver gets at most five square tables of 68 states. A transition's chance is backed by `backing`
    counts of its second character's own frequency, so that what a model has never seen counts against it.
    """
    labels = len(ORDINARY) + len(RANDOM)
    summed = (
        samples.select("text", F.col("label").cast("bigint").alias("label"))
        .where(F.col("label").isin(*ORDINARY, *RANDOM))
        .mapInArrow(_counts, "label bigint, pair bigint, n bigint")
        .groupBy("label", "pair")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    tables = np.zeros((labels, STATES * STATES))
    for row in summed:
        tables[row["label"], row["pair"]] = row["n"]
    tables = tables.reshape(labels, STATES, STATES)
    single = tables.sum(axis=1, keepdims=True) + 0.5
    single /= single.sum(axis=2, keepdims=True)
    chances = np.log((tables + backing * single) / (tables.sum(axis=2, keepdims=True) + backing)).reshape(labels, -1)
    taught = {k for k in range(labels) if tables[k].any()}
    return Chances(*(chances[[k for k in side if k in taught] or list(side[:1])] for side in (RANDOM, ORDINARY)))


def random_strings(spark: SparkSession, n: int = 20_000) -> DataFrame:
    """Labelled random strings by rule, a bounded sample of `n` each: digests in Base64 (1), lower-case (2) and upper-case hex (4)."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    kinds = F.array(
        F.struct(F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "").alias("text"), F.lit(1).alias("label")),
        F.struct(F.substring(digest, 1, 40).alias("text"), F.lit(2).alias("label")),
        F.struct(F.upper(digest).alias("text"), F.lit(4).alias("label")),
    )
    return spark.range(n).select(F.explode(kinds).alias("k")).select("k.*")


# Words of programs, a fixed list: a corpus may hold none, and its letters should not all look rare.
CODE_WORDS = """
access active adjust apply array async backup base binary block book boxed break buffer bulk bytes callback check checkpoint
chunk click clock closed connect copy crypto current database decrypt default deque dict directory display domain draw dummy
dynamic empty encrypt entry equal event exclude execute explicit export factory failed false feedback field file fixed flow
follow framework frequency function gateway global glyph graph group gzip handler height history hook host image import inject
input java job join jump junk keyboard keyword kind lambda layout lazy level library link lock lookup loop major manager mapping
mask match matrix memory method mixed model module move network nullable number object offset option output package parser
pickle pixel player plugin policy pool prefix process profile project property protocol proxy public python query queue quick
random rank raw require resize retry row schema script sequence serial server service session shared show signal size skip
socket stack style subprocess suffix symbol sync syntax system table task thread token track type unicode unzip update upload
user valid value vector verify version vertex view walk wave widget width window worker wrapper write yield zone
""".split()
CODE_SHORT = """
id url uri http https www org com api xml html json csv sql db io os ip tcp udp utf ascii rgb rgba gl ext src lib bin pkg cfg tmp
str int len ptr buf num max min idx ctx msg req res args kwargs init main test func impl util utils std sys env dev app txt log md
sha hash key val cmd dir img px kb mb gb ms v1 v2 x86 win linux
""".split()
WORD_BYTES = 12


def _marked_words(n: int):
    """The `n` words with the smallest marks among a task's words of letters; a mark is a hash of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, marks = np.zeros(0, f"S{WORD_BYTES}"), np.zeros(0, np.uint64)
        for batch in slices(batches):
            different = pc.ascii_split_whitespace(batch.column("text").fill_null("")).flatten().unique()
            new = different.filter(pc.match_substring_regex(different, "^[A-Za-z]{2,%d}$" % WORD_BYTES))
            if len(new):
                words = np.unique(np.concatenate((words, np.array(new.to_pylist(), words.dtype))))
                parts = words.view(np.uint32).reshape(-1, WORD_BYTES // 4).astype(np.uint64)
                marks = np.zeros(len(words), np.uint64)
                for part in parts.T:
                    marks = (marks ^ part) * np.uint64(0x9E3779B97F4A7C15)
                    marks ^= marks >> np.uint64(29)
                least = np.argsort(marks, kind="stable")[:n]
                words, marks = words[least], marks[least]
        yield pa.RecordBatch.from_arrays(
            [pa.array(words.astype(str), pa.string()), pa.array((marks >> np.uint64(1)).astype(np.int64))], names=["word", "mark"]
        )

    return run


def vocabulary_sample(docs: DataFrame, n: int = 5_000) -> list[str]:
    """A bounded sample of `n` of the different words of 2 to 12 Latin letters in all texts: those with the smallest hashes."""
    marked = docs.select("text").mapInArrow(_marked_words(n), "word string, mark bigint").distinct()
    return [r["word"] for r in marked.orderBy("mark", "word").limit(n).collect()]


def _identifier(number: int, words: list[str]) -> str:
    """Identifier `number` of the rule: snake, upper snake, camel, Pascal, kebab, path, acronyms, ruler, figures, in turn."""
    rng = random.Random(number)
    sources = [CODE_SHORT, CODE_WORDS, words or CODE_WORDS]
    parts = [rng.choice(rng.choices(sources, (2, 3, 5))[0]) for _ in range(rng.randrange(2, 6))]
    if rng.random() < 0.25:
        parts.insert(rng.randrange(1, len(parts) + 1), str(rng.randrange(10 ** rng.randrange(1, 5))))
    low, high = [w.lower() for w in parts], [w.capitalize() for w in parts]
    match number % 9:
        case 0:
            return "_".join(low)
        case 1:
            return "_".join(parts).upper()
        case 2:
            return "".join(high)
        case 3:
            return low[0] + "".join(high[1:])
        case 4:
            return "-".join(low)
        case 5:
            return "/".join(w if rng.random() < 0.7 else h for w, h in zip(low, high))
        case 6:
            return "".join(w.upper() if w in CODE_SHORT or rng.random() < 0.2 else h for w, h in zip(parts, high))
        case 7:
            return rng.choice("=-_+/") * rng.randrange(8, 80)
        case _:
            date = f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}"
            figures = "".join(rng.choices("0123456789", k=rng.randrange(8, 20)))
            return rng.choice([date, figures, "_".join(str(rng.randrange(200)) for _ in range(4))])


def identifiers(spark: SparkSession, words: list[str], n: int = 20_000) -> DataFrame:
    """Ordinary identifiers (label 3) by rule, a bounded sample of `n`: `words` and words of programs, put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_identifier(k, words) for k in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "label": pa.array([3] * len(texts), pa.int32())})

    return spark.range(n).mapInArrow(run, "text string, label int")


def labelled_samples(docs: DataFrame) -> DataFrame:
    """Random strings by rule against the ordinary words of all `docs` and identifiers put together of a sample of them."""
    spark = docs.sparkSession
    made = random_strings(spark).unionByName(identifiers(spark, vocabulary_sample(docs)))
    return made.unionByName(docs.select("text", F.lit(0).alias("label")))


def _beside(start: int, end: int, spans: list[tuple[int, str, int]]) -> Iterator[tuple[int, int]]:
    """The parts from `start` to `end` that no span covers."""
    for s, _, e in sorted(spans):
        if s >= end:
            break
        if s > start:
            yield start, s
        start = max(start, e)
    if start < end:
        yield start, end


def _ratios(strings: list[str], chances: Chances) -> np.ndarray:
    """Log-likelihood ratio of each string: its likeliest random model against its likeliest ordinary one."""
    state = _STATE[np.frombuffer(("\n" + "\n".join(strings) + "\n").encode(), np.uint8)]
    edges = np.flatnonzero(state == 0)
    at = state[:-1] * STATES + state[1:]
    best = []
    for side in chances:
        steps = [np.concatenate(([0], np.cumsum(model[at]))) for model in side]
        best.append(np.max([s[edges[1:]] - s[edges[:-1]] for s in steps], axis=0))
    return best[0] - best[1]


def _spans(texts: pa.Array, chances: Chances, least: float) -> list[list[tuple[int, str, int]]]:
    """All spans per text: the base spans, and candidates beside them, or parts of these, whose ratio is at least `least`."""
    hits = pc.match_substring_regex(texts, KEYWORD, ignore_case=True).to_pylist()
    found, candidates = [], []
    for row, (text, keyword) in enumerate(zip(texts.to_pylist(), hits)):
        spans = base_spans(text, keyword)
        for m in CANDIDATE.finditer(text):
            candidates += [(row, a, text[a:e]) for a, e in _beside(m.start(), m.end(), spans)]
        found.append(spans)
    while candidates:
        parts = []
        for (row, start, string), ratio in zip(candidates, _ratios([c[2] for c in candidates], chances)):
            if ratio >= least:
                found[row].append((start, "random", start + len(string)))
            else:
                parts += [(row, start + m.start(), m[0]) for m in PART.finditer(string) if m[0] != string]
        candidates = parts
    order = {kind: k for k, kind in enumerate(KINDS)}
    return [sorted(spans, key=lambda s: (s[0], order[s[1]], s[2])) for spans in found]


SCAN = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint"


def scan(docs: DataFrame, chances: Chances, least: float = 12.0) -> DataFrame:
    """One row per row of `docs` (doc_id, text): spans of secrets as kind:start:end in code points, end exclusive.

    Base kinds come from fixed patterns. Candidates are what base spans leave of runs of at least 16
    characters, each part by itself and however short; one is `random` when the log-likelihood ratio
    of its likeliest random-string model to its likeliest ordinary model is at least `least`. Of a
    candidate that is not, parts of at least 16 characters between `/`, `_`, `=` and `-` are judged
    alone, as a key may end a path. Shorter strings are not judged. Null text is empty and has no
    spans; repeated rows are scanned each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(6)]
            for spans in _spans(batch.column("text").fill_null(""), chances, least):
                text = [f"{kind}:{start}:{end}" for start, kind, end in spans]
                base = ",".join(t for t, s in zip(text, spans) if s[1] != "random")
                counts = [sum(s[1] == kind for s in spans) for kind in KINDS]
                row = [*counts[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(text), counts[3]]
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCAN)


def masked(text: Column, chances: Chances, least: float = 12.0, mask: str = "[secret]") -> Column:
    """`text` with every span replaced by `mask`, overlapping spans by one; null stays null."""

    def run(texts):
        out = []
        for text, spans in zip(texts.to_pylist(), _spans(texts.fill_null(""), chances, least)):
            if text is None or not spans:
                out.append(text)
                continue
            parts, upto = [], 0
            for start, _, end in spans:
                if start >= upto:
                    parts += [text[upto:start], mask]
                upto = max(upto, end)
            out.append("".join(parts) + text[upto:])
        return pa.array(out, pa.string())

    return F.arrow_udf(in_slices(run), "string")(text)
