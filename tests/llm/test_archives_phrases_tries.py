"""WARC archives, phrase mining and conversation tries against brute force, foreign files and awkward rows."""

import base64
import collections
import hashlib
import io
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from freshet.functions.series import LOOKUP_SALTS, salted_lookup
from freshet.llm import collocations, prefix_trie, warc

PAGE = "page_id bigint, url string, html string, payload string, sha_ string, holder string, n string, record_type string"
TALK = "conv_id bigint, turn bigint, role string, text string, at string, node string, depth string, id string"


# ---- WARC ----


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", "s", "h", "n", "r") for i, u, h in rows], PAGE)


def awkward_pages():
    big, other = "<p>é漢</p>" * 200, "x" * 1000
    return [
        (1, "http://a", big), (5, "http://b", big), (3, None, big), (None, "http://n", big), (5, "http://again", big), (5, "http://b", big),
        (2, "http://c", "small"), (9, "http://d", "small"), (2, "http://c", "small"), (7, "u\r\nInjected: yes", None), (8, "http://e", ""),
        (10, "http://f", other), (11, "http://g", "x" * 999), (12, "http://h", "x" * 999), (None, "q", "y" * 2000), (None, "q", "y" * 2000),
        (20, "long", "z \r\n\r\n" * 200_000),
    ]


def expected_pages(rows):
    held = collections.defaultdict(list)
    for k, (i, _, html) in enumerate(rows):
        if len((html or "").encode()) >= 1000:
            held[html].append((i is not None, i or 0, -k, k, i))
    out = []
    for k, (i, _, html) in enumerate(rows):
        data = (html or "").encode()
        best = max(held[html]) if len(data) >= 1000 else None
        revisit = best is not None and best[3] != k
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best[4] if revisit else None))
    return sorted(map(str, out))


def test_every_page_comes_back_from_the_archives(spark, tmp_path):
    rows = awkward_pages()
    path = str(tmp_path / "archives")
    got = warc.archive_pages(pages(spark, rows).repartition(3), path).drop("target_uri").collect()
    assert sorted(str(tuple(r)) for r in got) == expected_pages(rows)
    whole = warc.read_archives(spark, path).where("record_type = 'response'").collect()
    assert sorted(bytes(r.payload).decode() for r in whole if r.payload_bytes >= 1000) == sorted({h for _, _, h in rows if h and len(h.encode()) >= 1000 and h != "x" * 999})
    assert all(r.target_uri is None or "\n" not in r.target_uri for r in whole)
    assert not any(p.name.startswith("_attempts") for p in (tmp_path / "archives").iterdir())


def test_no_pages_give_no_records(spark, tmp_path):
    empty = warc.archive_pages(pages(spark, []), str(tmp_path / "none"))
    assert empty.count() == 0 and empty.columns[:2] == ["page_id", "payload_bytes"]


def test_files_roll_over_and_each_has_a_dictionary(spark, tmp_path):
    shared = "concat_ws(' ', transform(sequence(1, 60), k -> concat('<tag class=\"value\">', md5(string(id * 61 + k)), '</tag>')))"
    rows = spark.range(3000).selectExpr("id AS page_id", "concat('http://h/', id) AS url", f"{shared} AS html").coalesce(1)
    warc.write_archives(warc.page_records(rows), str(tmp_path / "many"), file_bytes=100_000)
    files = sorted((tmp_path / "many").glob("*.warc.zst"))
    assert len(files) > 1 and all(f.read_bytes()[:4] == warc.DICTIONARY_FRAME_MAGIC for f in files)
    assert warc.read_archives(spark, str(tmp_path / "many"), payload=False).selectExpr("count(distinct source_id)", "count(payload)").first()[:] == (3000, 0)


def record(payload=b"<html>", **more):
    row = {"record_type": "response", "record_id": "0" * 8, "target_uri": "http://x", "source_id": 4, "refers_to": None,
           "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload}
    return warc.record_bytes(row | more, "2020-01-01T00:00:00Z")


def read(data, **options):
    return list(warc.read_records(pa.BufferReader(data), **options))


def test_frames_of_other_writers():
    """A plain dictionary frame, frames without size or checksum, other skippable frames, several blocks, and RLE blocks."""
    samples = [record(f"<p>{k} some words of a page {k * 7}</p>".encode() * 20) for k in range(400)]
    raw = zstandard.train_dictionary(4096, samples, k=64, d=8)
    big = record(bytes(400_000) + np.random.default_rng(1).bytes(300_000))
    out = io.BytesIO()
    out.write(warc.DICTIONARY_FRAME_MAGIC + len(raw.as_bytes()).to_bytes(4, "little") + raw.as_bytes())
    for size, check in itertools.product((True, False), repeat=2):
        coder = zstandard.ZstdCompressor(dict_data=raw, write_content_size=size, write_checksum=check)
        out.write(b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc")
        for data in (samples[3], big):
            out.write(coder.compress(data))
    got = read(out.getvalue())
    assert [r["payload_bytes"] for r in got] == [len(warc.parse_record(samples[3])["payload"]), 700_000] * 4
    plain = zstandard.ZstdCompressor().compress(record())
    assert read(plain)[0]["payload"] == b"<html>" and read(b"") == []


@pytest.mark.parametrize(
    "broken",
    [
        record().replace(b"WARC/1.1", b"WARC/9"), record().replace(b"WARC-Date", b"X-Date"), record()[:-2], record() + b"x",
        record().replace(b"<html>", b"<htmL>"), record(payload_bytes=99), re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: -1\r\n\r\nHTTP", record()),
        record(payload_digest="00" * 20), b"", b"no header at all",
    ],
)
def test_records_that_do_not_hold_are_found(broken):
    good = zstandard.ZstdCompressor().compress(record())
    data = good + zstandard.ZstdCompressor().compress(broken) + good
    with pytest.raises(warc.WarcError):
        read(data)
    assert len(read(data, strict=False)) == 2


def test_broken_frames_end_a_file():
    good = zstandard.ZstdCompressor(write_checksum=True).compress(record(b"a" * 5000))
    for bad in (good[:-3], good[:9], b"\x00\x01\x02\x03", b"\x50\x2a"):
        with pytest.raises(warc.WarcError):
            read(good + bad)
        assert len(read(good + bad, strict=False)) == 1


def test_revisits_need_their_response(spark, tmp_path):
    path = str(tmp_path / "alone")
    alone = warc.page_records(pages(spark, awkward_pages())).where("record_type = 'revisit'")
    warc.write_archives(alone, path)
    with pytest.raises(Exception, match="revisit without its response"):
        warc.resolve_revisits(warc.read_archives(spark, path, payload=False)).collect()


def test_digests_in_both_notations():
    digest = hashlib.sha1(b"x").digest()
    assert warc._hex("sha1:" + base64.b32encode(digest).decode()) == warc._hex("SHA1:" + digest.hex().upper()) == digest.hex()


# ---- phrases ----


def brute_phrases(rows, threshold, longest, top, cover):
    lists = collections.defaultdict(list)
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            lists[lang if lang is not None else "und"].append([w for w in re.split("[ \t]+", piece) if w])
    out = []
    for lang, pieces in lists.items():
        f = collections.Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, longest + 1) for i in range(len(p) - k + 1))
        n = sum(map(len, pieces))
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        gone = {q[i : i + k] for q, b in cand.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= cover * f[q[i : i + k]]}
        rows_ = []
        for p, a in cand.items():
            if p not in gone:
                score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def phrase_rows():
    rng = np.random.default_rng(7)
    vocabulary = ["New", "york", "times", "the", "of", "a", "Ünï", "漢字", "x" * 300, "don't", "new", "<|end|>", "b\x1cc", "é"]
    texts = [("".join(w + str(rng.choice([" ", "  ", "\t", ", ", ". ", "\n"], p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05])) for w in rng.choice(vocabulary, 60, p=[0.2, 0.1, 0.1] + [0.6 / 11] * 11)), lang)
             for lang in ("en", "fr", None, "und") for _ in range(40)]
    texts += [("new york times. " * 50, "en"), (None, "en"), ("", None), (" \t.,", "xx"), ("a a a a a a a a a a a", "en"), ("the of " * 3000, "zz")]
    return texts + texts[:3]


@pytest.mark.parametrize("threshold,longest,top,cover,shards", [(5, 5, 2000, 100, 4), (12, 4, 7, 60, 2), (3, 3, 50, 100, 1), (10**6, 5, 10, 100, 3)])
def test_phrases_equal_brute_force(spark, threshold, longest, top, cover, shards):
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, la, "k", 1, "p") for t, la in rows], "text string, lang string, key string, n bigint, prefix string").repartition(5)
    got = collocations.collocations(docs, threshold, longest, top, shards, cover)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, threshold, longest, top, cover)


def test_no_documents_give_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_long_texts_and_words_are_cut_at_windows(monkeypatch):
    """Keys do not depend on where the windows of the hash lie."""
    text = ("word " * 50 + "y" * 700 + " and, more " * 30).encode()
    data = np.frombuffer(text, np.uint8)
    whole = collocations._words(data, 0)
    monkeypatch.setattr(collocations, "WINDOW_BYTES", 64)
    monkeypatch.setattr(collocations, "_POWERS", {})
    parts = collocations._words(data, 0)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert len(set(whole[2].tolist())) == 4


def test_counts_beyond_64_bits(spark):
    rows = [("k", "en", ["a", "b"], 9 * 10**14, [10**15 - 1], [10**15 - 1], 10**16)]
    frame = spark.createDataFrame(rows, "key string, lang string, words array<string>, a bigint, firsts array<bigint>, lasts array<bigint>, n bigint")
    got = collocations._scored(frame.drop("n"), frame.select("lang", "n")).first()
    assert got.score == 1000 * 9 * 10**14 * 10**16 // (10**15 - 1) ** 2


# ---- tries ----


def brute_trie(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in turns.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(turns.get(c - int(np.fmod(c, 5)), [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    out = []
    for path, convs in members.items():
        inside = [p for p in members if p[: len(path)] == path]
        kids = [p for p in inside if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in inside) for p in inside)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in inside if p)
        joined = ",".join(map(str, sorted(ends[path])))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(kids), leaves, saved, hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(map(str, out))


def talks(spark, rows):
    return spark.createDataFrame([(*r, "a", "n", "d", "i") for r in rows], TALK)


def talk_rows():
    rng = np.random.default_rng(3)
    words = ["", "hi", "hello", "ünï", "x" * 500, None]
    rows = [(c, t, ["user", "assistant", None][t % 3], words[int(rng.integers(0, 6))]) for c in [*range(40), -3, -7, 10**12] for t in range(int(rng.integers(1, 12)))]
    rows += [(50, None, "user", "first"), (50, 0, "user", "second"), (50, 0, "user", "again"), (50, 0, "user", "again"), (None, 1, "user", "lost"), (52, 0, "b", "only")]
    return rows + [(c, 0, "user", "hello") for c in range(100, 160)] + [(200, t, "user", f"turn {t}") for t in range(300)]


def test_trie_equals_brute_force(spark):
    rows = talk_rows()
    got = prefix_trie.prefix_trie(talks(spark, rows).repartition(5)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_trie(rows)


def test_trie_of_chunks_and_pieces(spark, monkeypatch):
    """Runs of a few arcs, so that the list of runs is long, and digests over many pieces."""
    rows = talk_rows()
    arcs = list(range(40))
    after = np.random.default_rng(5).permutation(40)
    following = dict(zip(after[:-1].tolist(), after[1:].tolist()))
    made = spark.createDataFrame([(a, following.get(a), a, 0) for a in arcs], "arc bigint, next bigint, conv_id bigint, depth int")
    got = {r.arc: r.position for r in prefix_trie.tour_positions(made).collect()}
    assert [got[a] for a in after.tolist()] == arcs
    batches = [pa.RecordBatch.from_pydict({"node": [b"a", b"a", b"b"], "conv_id": [1, 2, 3]}), pa.RecordBatch.from_pydict({"node": [b"b", b"c"], "conv_id": [4, 5]})]
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 1)
    digests = [x for b in prefix_trie._digests(prefix_trie._joined_ids(iter(batches))) for x in b.to_pylist()]
    assert [d["ends_sha256"] for d in digests] == [hashlib.sha256(x).hexdigest() for x in (b"1,2", b"3,4", b"5")]
    assert rows


def test_no_conversations_give_no_nodes(spark):
    assert prefix_trie.prefix_trie(talks(spark, [])).count() == 0


def test_salted_rows_are_not_broadcast_unmeasured(spark, monkeypatch):
    """In a session with Spark's own bound of 10 MB, files far smaller than that hold 640 000 salted rows."""
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    seen = []

    def planned(df, small, *rest):
        found = salted_lookup(df, small, *rest)
        plan = found._jdf.queryExecution().sparkPlan().toString().split("\n")
        seen.append((small.count() * LOOKUP_SALTS, next(step for step in plan if "Join" in step)))
        return found

    monkeypatch.setattr(prefix_trie, "salted_lookup", planned)
    rows = session.range(20_000).selectExpr("id as conv_id", "0L as turn", "'user' as role", "cast(id as string) as text")
    assert prefix_trie.prefix_trie(rows).agg({"n_convs": "max"}).first()[0] == 20_000
    large = [join for n, join in seen if n > 500_000]
    assert len(large) >= 4 and not any("Broadcast" in join for join in large)


def test_suffixes_follow_from_keys_and_prefixes():
    rng = np.random.default_rng(5)
    prefix, suffix = (rng.integers(1, 1 << 63, 10_000, dtype=np.uint64) for _ in range(2))
    assert (collocations._suffix(collocations._joined(prefix, suffix), prefix) == suffix).all()
    assert not collocations._suffix(suffix, np.zeros(10_000, np.uint64)).any()  # words have no sides
    words = rng.integers(1, 5, 500, dtype=np.uint64)
    every = np.full(1 << 10, ~np.uint64(0))
    for k, key, before, after in collocations._ngrams(words.view(np.int64), [1, 2, 3, 4, 5], every):
        assert len(key) == 501 - k and (collocations._suffix(key, before) == after).all()
