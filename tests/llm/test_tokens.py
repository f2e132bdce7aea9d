"""Simple-8b files (2), byte-level BPE (3) and packing (9) against the tokenizer libraries themselves."""

import base64
import hashlib
import os
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpora  # noqa: E402
from freshet.llm import best_fit, byte_bpe, simple8b  # noqa: E402
from freshet.llm.queries import QUERIES  # noqa: E402
from freshet.llm.word_ids import WordEncoder, default_vocabulary  # noqa: E402

WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
_RANKS = {
    base64.b64decode(a): int(b)
    for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))  # noqa: SIM115
}
BYTES = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_RANKS, special_tokens={})
needs_data = pytest.mark.skipif(not os.path.isdir(corpora.SF_DIR), reason="supplied tables not present")


def ids_of(text, end):
    return np.array([*WORDS.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=12))
def test_word_ids_equal_the_library(texts):
    coder = WordEncoder(default_vocabulary(), keep=20)
    ids, counts = coder.encode(pa.array(texts, pa.string()))
    want = [WORDS.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**16), st.integers(0, 2**64 - 1)), max_size=600),
    st.integers(1, 100),
)
def test_simple8b_round_trip_of_every_block(values, size):
    ids = np.array(values, np.uint64)
    lengths = np.array([len(ids[k : k + size]) for k in range(0, len(ids), size)] or [0])
    words, n_words, escapes, n_escapes = simple8b.pack(ids, lengths)
    assert (simple8b.unpack(words, escapes) == ids).all()
    w = e = at = 0
    for length, a, b in zip(lengths, n_words, n_escapes):
        assert (simple8b.unpack(words[w : w + a], escapes[e : e + b]) == ids[at : at + length]).all()
        w, e, at = w + a, e + b, at + length


def test_simple8b_packs_small_ids_closely():
    words, _, escapes, _ = simple8b.pack(np.zeros(240, np.uint64), np.array([240]))
    assert len(words) == 2 and not len(escapes)
    words, _, escapes, _ = simple8b.pack(np.full(8, 2**62, np.uint64), np.array([8]))
    assert len(words) == 8 == len(escapes)


def check_id_files(got, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    want = []
    for doc_id, text in order:
        ids = ids_of(text, 2)
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    have = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got]
    assert sorted(h[1] for h in have) == sorted({h[1] for h in have})
    assert sorted((str(h[0]), *h[2:]) for h in have) == sorted((str(w[0]), *w[2:]) for w in want)
    by_start = sorted(have, key=lambda h: h[1])
    assert [h[0] for h in by_start] == [w[0] for w in want]
    assert all(b[1] == a[1] + a[2] for a, b in zip(by_start, by_start[1:])) and (not have or by_start[0][1] == 0)


def test_id_files_of_awkward_rows(spark):
    docs = corpora.awkward(spark)
    check_id_files(simple8b.read_ids(spark, simple8b.write_ids(docs, block_ids=50)).collect(), corpora.pairs(docs))
    assert simple8b.read_ids(spark, simple8b.write_ids(corpora.nothing(spark))).collect() == []


@needs_data
def test_id_files_of_the_table(spark):
    check_id_files(QUERIES["op2_simple8b_ids"](spark, corpora.SF_DIR).collect(), corpora.pairs(corpora.documents(spark)))


def check_bytes(df, rows):
    want = sorted((str(d), np.array(BYTES.encode_ordinary(t or ""), "<u4").tobytes()) for d, t in rows)
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in df.collect()) == want


@pytest.mark.parametrize("chunk,overlap", [(65_536, 2_048), (40, 16), (1_000, 100)])
def test_byte_bpe_of_awkward_rows(spark, chunk, overlap):
    docs = corpora.awkward(spark)
    check_bytes(byte_bpe.encode(docs, chunk=chunk, overlap=overlap), corpora.pairs(docs))


def test_byte_bpe_stitches_at_white_space_and_contractions(spark):
    texts = [" \n" * 300 + "b", "it's 're 'll  \n\n x" * 60, "don't   stop\t\t 12345 ½" * 50, "字" * 200 + " " * 300 + "é́" * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for chunk, overlap in ((50, 20), (64, 8), (200, 50)):
        check_bytes(byte_bpe.encode(docs, chunk=chunk, overlap=overlap), corpora.pairs(docs))


@needs_data
def test_byte_digests_of_the_table(spark):
    got = {r["doc_id"]: r for r in QUERIES["op3_byte_bpe"](spark, corpora.SF_DIR).collect()}
    rows = corpora.pairs(corpora.documents(spark))
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = np.array(BYTES.encode_ordinary(text or ""), "<u4")
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.digests(corpora.nothing(spark)).collect() == []


def check_packing(got, rows, capacity):
    want = []
    for doc_id, text in rows:
        ids = ids_of(text, 0)
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((str(doc_id), k // capacity, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    held = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == held.get(r["sequence_id"], 0)  # gapless from 0
        held[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(v <= capacity for v in held.values())
    return len(held), -(-sum(r["length"] for r in got) // capacity)


def test_packing_of_awkward_rows(spark):
    docs = corpora.awkward(spark)
    packed = best_fit.pack_documents(docs, capacity=64, with_ids=True)
    check_packing(packed.collect(), corpora.pairs(docs), 64)
    total = sum(len(r["ids"]) for r in best_fit.sequences(packed).collect())
    assert total == 4 * sum(len(ids_of(t, 0)) for _, t in corpora.pairs(docs))
    assert best_fit.pack_documents(corpora.nothing(spark)).collect() == []


@needs_data
def test_packing_of_the_table_is_tight(spark):
    got = QUERIES["op9_best_fit_packing"](spark, corpora.SF_DIR).collect()
    used, bound = check_packing(got, corpora.pairs(corpora.documents(spark)), 2048)
    assert used <= bound * 1.02 + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=200))
def test_plan_places_every_document_and_is_near_best_fit_decreasing(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    room, placed = {}, {s: 0 for s in counts}
    for size, first, n, sequence, offset in sorted(best_fit.plan(counts, 50), key=lambda f: f[4]):
        assert n > 0
        placed[size] += n
        for k in range(n):
            assert room.get(sequence + k, 0) == offset and offset + size <= 50
            room[sequence + k] = offset + size
    assert placed == counts
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if b >= s]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - s)
        else:
            bins.append(50 - s)
    assert len(room) <= 1.2 * len(bins) + 1


def test_shorter_slices_of_text_pack_the_same(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} and {k} more, " * (k % 23)) for k in range(300)], "doc_id bigint, text string")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole, short = (
        sorted(map(tuple, best_fit.pack_documents(docs, capacity=64, text_bytes=size).select(*columns).collect())) for size in (8 << 20, 500)
    )
    assert whole == short
