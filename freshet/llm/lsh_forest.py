"""Jaccard join of documents on word n-grams: a MinHash LSH forest for candidates, exact verification after it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from freshet.functions.series import salted_lookup
from freshet.llm.common import checked_broadcast, components, once, runs, slices, without
from freshet.session import materialize

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES = 16
MAX_DEPTH = 8
RECALL = 0.999
BLOCK = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)


def matching_depth(trees: int, deepest: int, threshold: float, recall: float) -> int:
    """The longest prefix at which a pair of just `threshold` similarity meets in some tree with chance `recall`.

    The prefix shortens from the tries' full depth one label at a time.
    """
    for depth in range(deepest, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def shingles(texts: pa.Array, words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted different 64-bit hashes of the word n-grams of each text; a text of fewer words has one of them all."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    unique = coded.dictionary.to_pylist()
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in unique), np.uint64, len(unique))
    code = coded.indices.to_numpy(zero_copy_only=False)
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    filled = np.array([bool(w) for w in unique])[code] if len(code) else np.zeros(0, bool)
    ends = np.concatenate(([0], np.cumsum(filled)))[bounds]
    flat = hashed[code[filled]] if len(code) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(flat) - words + 1), np.uint64)
    for k in range(words):
        rolled = _mixed(rolled + flat[k : k + len(rolled)])
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for w in flat[a:b]:
                one = _mixed(one + w)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _class_key(found: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    return tuple(np.frombuffer(digest, np.int64).tolist())


def _signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash values, one row per set; empty sets have zeros."""
    rng = np.random.default_rng(11)
    masks = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
    factors = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(sets), n), np.uint64)
    some = [k for k, s in enumerate(sets) if len(s)]
    if some:
        flat = np.concatenate([sets[k] for k in some])
        starts = np.cumsum([0] + [len(sets[k]) for k in some[:-1]])
        for j in range(n):
            out[some, j] = np.minimum.reduceat((flat ^ masks[j]) * factors[j], starts)
    return out


def _described(words: int, trees: int, depth: int):
    """Per text: key of its shingle set, its size, its label prefix in every tree, and short MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingles(batch.column("text"), words)
            values = _signatures(sets, trees * depth)
            prefix = np.zeros((len(sets), trees), np.uint64)
            for level in range(depth):
                prefix = _mixed(prefix + values[:, level * trees : (level + 1) * trees])
            keys = [_class_key(s) for s in sets]
            short = (values >> np.uint64(48)).astype("<u2")
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "text_hash": batch.column("text_hash"),
                "c1": pa.array([k[0] for k in keys], pa.int64()),
                "c2": pa.array([k[1] for k in keys], pa.int64()),
                "size": pa.array([len(s) for s in sets], pa.int64()),
                "prefixes": pa.array(list(prefix.astype(np.int64)), pa.list_(pa.int64())),
                "values": pa.array([v.tobytes() for v in short], pa.binary()),
            })

    return run


def _stars(linked: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Edges from the first node of each connected group of a symmetric link matrix to its others."""
    left = np.ones(len(nodes), bool)
    edges = []
    for k in range(len(nodes)):
        if not left[k]:
            continue
        group = linked[k] & left
        group[k] = True
        fresh = group.copy()
        fresh[k] = False
        while fresh.any():
            near = linked[fresh].any(axis=0) & left & ~group
            group |= near
            fresh = near
        left &= ~group
        edges += [(int(nodes[k]), int(n)) for n in nodes[group] if n != nodes[k]]
    return edges


def _candidate_edges(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks of a bucket: edges that connect what the MinHash values call similar."""
    for _, rows in runs(batches, ["tree", "prefix", "lo", "hi"]):
        nodes = rows.column("rep").to_numpy()
        order = np.argsort(nodes)  # stars of one group then have one centre in every tree
        nodes = nodes[order]
        values = np.frombuffer(b"".join(rows.column("values").to_pylist()), "<u2").reshape(len(nodes), -1)[order]
        same = np.zeros((len(nodes), len(nodes)), np.uint16)
        for j in range(values.shape[1]):
            same += values[:, j][:, None] == values[:, j][None, :]
        edges = _stars(same >= least * values.shape[1], nodes)
        if edges:
            a, b = zip(*edges)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _shingled(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingles(batch.column("text"), words)
            keys = [_class_key(s) for s in sets]
            yield pa.RecordBatch.from_pydict({
                "c1": pa.array([k[0] for k in keys], pa.int64()),
                "c2": pa.array([k[1] for k in keys], pa.int64()),
                "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
            })

    return run


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Exact sizes of all pairwise intersections; hashes that one set alone holds are left out first."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    kinds, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.cumsum(held > 1) - 1
    keep = held[at] > 1
    owner, at = owner[keep], common[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    total = int(common[-1]) + 1 if len(kinds) else 0
    out = np.zeros((n, n), np.int64)
    for start in range(0, total, columns):
        lo, hi = np.searchsorted(at, [start, start + columns])
        member = np.zeros((n, min(columns, total - start)), np.float32)
        member[owner[lo:hi], at[lo:hi] - start] = 1
        out += (member @ member.T).astype(np.int64)
    return out


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks of a family: links per class, counted exactly, and edges that connect them."""
    for (_, lo, hi), rows in runs(batches, ["label", "lo", "hi"]):
        reps, first = np.unique(rows.column("rep").to_numpy(), return_index=True)
        take = rows.take(pa.array(first))
        own, copies = take.column("own").to_numpy(), take.column("copies").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in take.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        both = shared_counts(sets)
        linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(linked, False)
        edges = _stars(linked, reps)
        counted = linked if lo == hi else linked & (own[:, None] != own[None, :])
        yield pa.RecordBatch.from_pydict({
            "a": pa.array(list(reps) + [a for a, _ in edges], pa.int64()),
            "b": pa.array([None] * len(reps) + [b for _, b in edges], pa.int64()),
            "texts": pa.array(list(counted.sum(axis=1)) + [0] * len(edges), pa.int64()),
            "docs": pa.array(list(counted @ copies) + [0] * len(edges), pa.int64()),
        })


def _in_block_pairs(members: DataFrame, keys: list[str], size: str, block: int) -> DataFrame:
    """Deal the rows of a group of any size to pairs of blocks: every two rows meet in one pair at least.

    A group of n rows has n / block blocks, and a row goes to as many pairs.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("blocks", "other")
    return dealt.repartition(*keys, "lo", "hi").sortWithinPartitions(*keys, "lo", "hi")


def near_groups(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of `docs` (doc_id, text): its group of similar documents and its number of links.

    `text_hash` (xxhash64 of the text) tells rows with one doc_id apart. `class_id` is the smallest doc_id of all documents connected by links, `copy_id` that of the
    documents with the same shingles, `n_links` the number of other documents at a Jaccard similarity
    of `threshold` or more (its copies included), `n_linked_texts` that of different shingle sets.

    Documents with equal shingle sets become one class before anything is compared. Each tree sorts
    the classes by their MinHash labels into a prefix trie; matched prefixes shorten until a pair at
    the threshold is found with the target recall. Classes that share a prefix are compared by their
    short MinHash values, block against block, and connected into families; each family's
    shingle sets are then intersected exactly, again block against block, so that no task holds more
    than two blocks and nothing is emitted per pair. Texts without words form one class
    without links, null text is empty, repeated rows count as copies, other columns are ignored.
    Settings are those of `labelled_rows`.
    """
    return labelled_rows(docs, **settings).drop("label")


def labelled_rows(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = SHINGLE_WORDS,
    trees: int = TREES,
    deepest: int = MAX_DEPTH,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """What `near_groups` returns, with the `label` that the rows of a group share whatever their doc_ids are."""
    depth = matching_depth(trees, deepest, threshold, recall)
    schema = "doc_id bigint, text_hash bigint, c1 bigint, c2 bigint, size bigint, prefixes array<bigint>, values binary"
    told = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_described(words, trees, depth), schema)
    sets = materialize(told.withColumn("rep", F.monotonically_increasing_id()))
    classes = materialize(
        sets.groupBy("c1", "c2").agg(
            F.min("rep").alias("rep"), F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("copies")
        )
    )
    firsts = materialize(sets.where("size > 0").select("rep", "prefixes", "values").join(classes.select("rep"), "rep"))

    labels = firsts.select("rep", F.posexplode("prefixes").alias("tree", "prefix"))
    shared = labels.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    members = salted_lookup(labels, shared, ["tree", "prefix"], ["rep"], "inner", salts=8)
    placed = members.join(firsts.select("rep", "values"), "rep")
    loose = 0.7 * threshold  # five standard deviations of the MinHash estimate below the threshold
    near = materialize(
        _in_block_pairs(placed, ["tree", "prefix"], "held", block)
        .select("tree", "prefix", "lo", "hi", "rep", "values")
        .mapInArrow(lambda batches: _candidate_edges(batches, loose), "a bigint, b bigint")
        .distinct()
    )
    family = components(near)
    sizes = family.groupBy("label").agg(F.count(F.lit(1)).alias("held"))
    known = materialize(
        salted_lookup(family.withColumnRenamed("node", "rep"), sizes, ["label"], ["rep"], "inner", salts=8)
        .join(classes, "rep")
    )

    ids = checked_broadcast(known.select(F.col("copy_id").alias("wanted")).distinct())
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    found = texts.mapInArrow(_shingled(words), "c1 bigint, c2 bigint, shingles binary")
    checked = materialize(
        _in_block_pairs(found.join(known, ["c1", "c2"]), ["label"], "held", block)
        .select("label", "lo", "hi", "own", "rep", "copies", "shingles")
        .mapInArrow(lambda batches: _verified(batches, threshold), "a bigint, b bigint, texts bigint, docs bigint")
    )
    links = checked.where("b is null").groupBy(F.col("a").alias("rep")).agg(
        F.sum("texts").alias("texts"), F.sum("docs").alias("docs")
    )
    groups = components(checked.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    grouped = classes.join(links, "rep", "left").join(groups, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    grouped = materialize(grouped)
    heads = grouped.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    named = salted_lookup(grouped, heads, ["label"], ["rep"], "inner", salts=8)
    described = named.select(
        "c1", "c2", "label", "class_id", "copy_id",
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_linked_texts"),
    )
    return salted_lookup(sets.select("doc_id", "text_hash", "rep", "c1", "c2"), described, ["c1", "c2"], ["rep"], "inner", salts=8).select(
        "doc_id", "class_id", "n_links", "copy_id", "n_linked_texts", "text_hash", "label"
    )


def drop_near_copies(docs: DataFrame, **settings) -> DataFrame:
    """`docs` with one row of every group of similar documents, all columns kept.

    The smallest doc_id stays, a null one only where a group has no other; among rows of that doc_id the
    one with the smallest text hash stays, and of rows that repeat it, one.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    groups = materialize(labelled_rows(docs, **settings).select("doc_id", "text_hash", "label", order.alias("place")))
    firsts = groups.groupBy("label").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    told = salted_lookup(groups, firsts, ["label"], ["doc_id", "text_hash"], "inner")
    marked = materialize(told.select("doc_id", F.col("text_hash").alias("mark"), (F.col("place") == F.col("first")).alias("stays")))
    mark = F.xxhash64("text")
    repeated = marked.where("stays").groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return once(without(docs, marked.where(~F.col("stays")).drop("stays"), mark), materialize(repeated), mark)
