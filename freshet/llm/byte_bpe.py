"""Byte-level BPE over whole texts: overlapping chunks, stitched where pre-token boundaries agree, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from freshet.llm.common import in_slices, slices
from freshet.session import materialize

CHUNK = 65_536
OVERLAP = 2_048
_LOOK_AHEAD = 4  # a boundary this close to a chunk's end may depend on characters beyond it


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


_CODERS: dict[tuple[str, str], tuple] = {}


def _coder(ranks: str, pattern: str):
    """tiktoken encoding and the bytes of every id, once per worker process."""
    if (ranks, pattern) not in _CODERS:
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        by_id = [b""] * (max(table.values()) + 1)
        for piece, rank in table.items():
            by_id[rank] = piece
        _CODERS[ranks, pattern] = encoding, by_id
    return _CODERS[ranks, pattern]


def _ids(encoding, text: str) -> bytes:
    return np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), "<u4").tobytes() if text else b""


def boundaries(text: str, pattern, first: int, last: int) -> list[int]:
    """Starts of pre-tokens of `text` within [first, last) that follow a character that is no white space.

    Cut there, both sides keep their pre-tokens: only white space looks at what comes after it.
    """
    last = min(last, len(text) - _LOOK_AHEAD)
    return [p for p in (m.start() for m in pattern.finditer(text)) if first <= p < last and p and not text[p - 1].isspace()]


def _chunks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                n = -(-len(text) // chunk)
                for k in range(n):
                    part = text[k * chunk : (k + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_pydict(
                        {"row": [row], "doc_id": [doc_id], "k": pa.array([k], pa.int32()), "last": [k == n - 1], "part": [part]}
                    )

    return run


def _edges(pattern: str, chunk: int, overlap: int):
    """Boundaries of a chunk where it overlaps its neighbours, counted from the start of the overlap."""
    compiled = regex.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            heads, tails = [], []
            for part in batch.column("part").to_pylist():
                found = boundaries(part, compiled, 0, chunk + overlap)
                heads.append([p for p in found if p < overlap])
                tails.append([p - chunk for p in found if p >= chunk])
            kind = pa.list_(pa.int32())
            columns = [batch.column("row"), batch.column("k"), pa.array(heads, kind), pa.array(tails, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "k", "head", "tail"])

    return run


def _encode_parts(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = _coder(ranks, pattern)
        for batch in slices(batches):
            texts = batch.column("part").fill_null("").to_pylist()
            kept = [batch.column(c) for c in batch.schema.names if c != "part"]
            names = [c for c in batch.schema.names if c != "part"]
            ids = pa.array([_ids(encoding, t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept, ids], names=[*names, "ids"])

    return run


def encode(
    docs: DataFrame, ranks: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, ids) per row of `docs` (doc_id, text): little-endian 32-bit ids, as tiktoken's encode_ordinary.

    Texts of up to `chunk` characters are encoded where they are read. Longer ones are cut into chunks
    that overlap by `overlap` characters and spread over the cluster; every chunk is pre-tokenised
    from its own start. Pre-tokens depend on nothing before them, so from the first boundary that a
    chunk shares with its predecessor both agree to the end. The text is divided at those points
    and the pieces are encoded in parallel, then joined per document. A text in which some overlap
    holds no shared boundary (one pre-token longer than the overlap) is encoded in one piece.
    Null text is empty and has no ids; repeated rows are encoded each; other columns are ignored.
    """
    path, split = default_ranks()
    ranks, pattern = ranks or path, pattern or split
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select("doc_id", text.alias("part"))
    short = plain.where(F.length("part") <= chunk).mapInArrow(_encode_parts(ranks, pattern), "doc_id bigint, ids binary")

    longer = docs.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = materialize(
        longer.mapInArrow(_chunks(chunk, overlap), "row bigint, doc_id bigint, k int, last boolean, part string").repartition("row", "k")
    )
    edges = materialize(parts.select("row", "k", "part").mapInArrow(
        _edges(pattern, chunk, overlap), "row bigint, k int, head array<int>, tail array<int>"
    ))
    before = edges.select("row", (F.col("k") + 1).alias("k"), F.col("tail").alias("left"))
    met = edges.where("k > 0").join(before, ["row", "k"]).select(
        "row", "k", F.array_min(F.array_intersect("head", "left")).alias("sync")
    )
    lost = met.where("sync is null").select("row").distinct()
    starts = met.select("row", "k", F.col("sync").alias("from"))
    stops = met.select("row", (F.col("k") - 1).alias("k"), F.col("sync").alias("to"))
    cut = (
        parts.join(lost, "row", "left_anti").join(starts, ["row", "k"], "left").join(stops, ["row", "k"], "left")
        .select("row", "doc_id", "k", F.expr(
            f"substring(part, coalesce(`from`, 0) + 1, if(last, length(part), {chunk} + `to`) - coalesce(`from`, 0))"
        ).alias("part"))
    )
    coded = cut.mapInArrow(_encode_parts(ranks, pattern), "row bigint, doc_id bigint, k int, ids binary")
    # the pieces of one document meet again, in order
    pieces = F.sort_array(F.collect_list(F.struct("k", "ids")))
    stitched = coded.groupBy("row", "doc_id").agg(pieces.alias("pieces")).select(
        "doc_id", F.aggregate("pieces", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )
    whole = (
        parts.join(lost, "row", "left_semi").groupBy("row", "doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("k", "last", "part"))).alias("parts"))
        .select("doc_id", F.array_join(F.transform(
            "parts", lambda x: F.when(x["last"], x["part"]).otherwise(F.substring(x["part"], F.lit(1), F.lit(chunk)))
        ), "").alias("part"))
        .mapInArrow(_encode_parts(ranks, pattern), "doc_id bigint, ids binary")
    )
    return short.unionByName(stitched).unionByName(whole)


def decoded(ids: Column, ranks: str | None = None, pattern: str | None = None) -> Column:
    """The raw bytes of a column of ids, which concatenate to the text's UTF-8."""
    path, split = default_ranks()
    ranks, pattern = ranks or path, pattern or split

    def run(column):
        _, by_id = _coder(ranks, pattern)
        lookup = by_id.__getitem__
        return pa.array(
            [None if x is None else b"".join(map(lookup, np.frombuffer(x, "<u4").tolist())) for x in column.to_pylist()],
            pa.binary(),
        )

    return F.arrow_udf(in_slices(run), "binary")(ids)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the bytes they decode to."""
    coded = encode(docs).select(
        "doc_id", "ids", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256")
    )
    return coded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(decoded(F.col("ids")), 256).alias("decoded_sha256"))
