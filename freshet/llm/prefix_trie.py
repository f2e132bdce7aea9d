"""Trie of conversations that share their first turns; subtree sums by an Euler tour that is ranked in parallel."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.ordering import global_ordinal, running_totals
from freshet.functions.series import salted_lookup
from freshet.session import discard, materialize, measure_broadcasts

FAMILY = 5
BORROW = 9
CHUNK_ARCS = 1 << 19
PIECE_IDS = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

_CHUNKS = [f"c{k}" for k in range(5)]
_SUMS = [f"s{k}" for k in range(5)]


# ---- sequences of turns ----


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, content, bytes): the turns of every conversation numbered from 0.

    The order is turn (null first), then role and a digest of the text, so repeated turn numbers give
    one result. `content` identifies role and text; null ones are empty. Rows without conv_id are left
    out, as they name no conversation. Numbers come from a range sort of the whole table, so a
    conversation of any length is spread over tasks.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.md5(text).alias("mark"), digest.alias("content"), F.octet_length(text).cast("bigint").alias("bytes")
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("mark")]
    placed = global_ordinal(turns, order)
    first = placed.groupBy("conv_id").agg(F.min("ordinal").alias("first"))
    found = salted_lookup(placed, first, ["conv_id"], ["ordinal"], "inner")
    return found.select("conv_id", (F.col("ordinal") - F.col("first")).alias("at"), "content", "bytes")


def rebuilt(turns: DataFrame, family: int = FAMILY, borrow: int = BORROW) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with turns of their family's first: (conv_id, depth, content, bytes) and all conv_ids.

    Conversation c takes the first h turns of c - c % family, where h is crc32(c) % borrow, and then its
    own turns after its first h. It joins fewer than `borrow` rows of each base to its family.
    """
    convs = materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    c = F.col("conv_id")
    wants = convs.select("conv_id", (c - c % family).alias("base"), (F.crc32(c.cast("string")) % borrow).alias("h"))
    sizes = convs.select(F.col("conv_id").alias("base"), "n")
    plans = materialize(
        wants.join(sizes, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken"))
    )
    starts = turns.where(F.col("at") < borrow - 1).select(F.col("conv_id").alias("base"), "at", "content", "bytes")
    borrowed = plans.where("taken > 0").join(starts, "base").where("at < taken").select("conv_id", (F.col("at") + 1).alias("depth"), "content", "bytes")
    own = salted_lookup(turns, plans.select("conv_id", "h", "taken"), ["conv_id"], ["at"], "inner").where("at >= h")
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("depth"), "content", "bytes")
    return borrowed.unionByName(own), convs.select("conv_id")


# ---- nodes ----


def _node(depth: Column, sums: list[Column]) -> Column:
    """Identifier of a sequence: its length and the sums over hashes of (position, turn)."""
    return F.unhex(F.md5(F.concat_ws(".", depth, *sums)))


def sequence_nodes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, bytes, node, parent) for each turn of each conversation, and nothing for the root.

    Every turn has 120 bits of a hash of its position and content, in five numbers; a prefix is known by
    their sums. Sums run over the whole table, range by range, less what stood before the conversation.
    """
    h1, h2 = F.xxhash64("depth", "content"), F.xxhash64("content", "depth", F.lit(1))
    low = F.lit((1 << 24) - 1)
    chunks = [h.bitwiseAND(low) for h in (h1, F.shiftright(h1, 24), h2, F.shiftright(h2, 24))]
    chunks.append(F.shiftright(h1, 48).bitwiseAND(F.lit(0xFFFF)) * 256 + F.shiftright(h2, 48).bitwiseAND(F.lit(0xFF)))
    spread = rows.select("conv_id", "depth", "bytes", *[c.alias(n) for c, n in zip(chunks, _CHUNKS)])
    summed = running_totals(spread, ["conv_id", "depth"], dict(zip(_CHUNKS, _SUMS)))
    summed = materialize(summed.select("conv_id", "depth", "bytes", *_CHUNKS, *_SUMS))
    before = summed.where("depth = 1").select("conv_id", *[(F.col(s) - F.col(c)).alias(f"b{c}") for c, s in zip(_CHUNKS, _SUMS)])
    found = salted_lookup(summed, before, ["conv_id"], ["depth"], "inner")
    own = [F.col(s) - F.col(f"b{c}") for c, s in zip(_CHUNKS, _SUMS)]
    above = [s - F.col(c) for c, s in zip(_CHUNKS, own)]
    return found.select(
        "conv_id", "depth", "bytes", _node(F.col("depth"), own).alias("node"), _node(F.col("depth") - 1, above).alias("parent")
    )


def _root() -> Column:
    return _node(F.lit(0), [F.lit(0)] * 5)


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node in a sorted partition as comma-joined pieces of at most PIECE_IDS ids."""
    for batch in batches:
        nodes, ids = batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()
        out, start = [], 0
        for at in range(1, len(ids) + 1):
            if at == len(ids) or nodes[at] != nodes[start] or at - start == PIECE_IDS:
                out.append((nodes[start], ids[start], ",".join(map(str, ids[start:at]))))
                start = at
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))], ["node", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, in order; it holds one node's state at a time."""
    last, state = None, None
    for batch in batches:
        done = []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if node == last:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((last, state.hexdigest()))
            last, state = node, hashlib.sha256(ids.encode())
        if done:
            yield _digest_rows(done)
    if state is not None:
        yield _digest_rows([(last, state.hexdigest())])


def _digest_rows(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    nodes, digests = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests)], ["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the conversations (node, conv_id) that end at a node, by conv_id.

    The ids of a node that ends very many conversations are joined in many tasks; only the hashing of
    the pieces, one row for some thousand ids, is one task's work, as SHA-256 is sequential.
    """
    ranged = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ranged.mapInArrow(_joined_ids, "node binary, first bigint, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends_sha256 string")


# ---- the Euler tour ----


def tour_arcs(numbered: DataFrame) -> DataFrame:
    """(arc, next, conv_id, depth, leaf, saved): an enter arc 2 id and an exit arc 2 id + 1 for every node.

    Entering a node leads to its first child, or to its own exit; leaving it leads to its next
    sibling, or to the exit of its parent. The root's exit has no next arc.
    """
    down = F.when(F.col("n_children") > 0, 2 * F.col("first_child")).otherwise(2 * F.col("id") + 1)
    sibling = F.col("id") + 1 < F.col("parent_first") + F.col("parent_children")
    over = F.when(F.col("parent_id").isNotNull(), F.when(sibling, 2 * (F.col("id") + 1)).otherwise(2 * F.col("parent_id") + 1))
    zero = F.lit(0).cast("bigint")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint")
    enter = F.struct((2 * F.col("id")).alias("arc"), down.alias("next"), leaf.alias("leaf"), F.col("own_saved").alias("saved"))
    leave = F.struct((2 * F.col("id") + 1).alias("arc"), over.alias("next"), zero.alias("leaf"), zero.alias("saved"))
    return numbered.select("conv_id", "depth", F.explode(F.array(enter, leave)).alias("a")).select("a.*", "conv_id", "depth")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the tour inside chunks of a task's arcs: every arc gets the first arc of its run and the distance to it."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ARCS:
            yield from _runs(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield from _runs(pa.Table.from_batches(held))


def _runs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    arcs = table.column("arc").to_numpy()
    after = table.column("next").fill_null(-1).to_numpy()
    order = np.argsort(arcs, kind="stable")
    place = np.searchsorted(arcs, after, sorter=order).clip(max=len(arcs) - 1)
    local = order[place]
    inside = arcs[local] == after
    here = np.arange(len(arcs))
    head, steps = here.copy(), np.zeros(len(arcs), np.int64)
    head[local[inside]] = here[inside]
    steps[local[inside]] = 1
    while True:
        further = steps[head]
        if not further.any():
            break
        steps, head = steps + further, head[head]
    tails = np.flatnonzero(~inside)  # each run has one; it tells where the run leads and how long it is
    leads, length = np.full(len(arcs), -1, np.int64), np.zeros(len(arcs), np.int64)
    leads[head[tails]], length[head[tails]] = after[tails], steps[tails] + 1
    is_head = steps == 0
    rows = pa.table(
        {
            "arc": arcs, "head": arcs[head], "steps": steps,
            "next": pa.array(leads, mask=~is_head | (leads < 0)), "length": pa.array(length, mask=~is_head),
        }
    )
    yield from rows.to_batches(max_chunksize=100_000)


def rank_list(runs: DataFrame) -> DataFrame:
    """(head, to_end): arcs from each run's head to the end of the list, by pointer jumping over (head, next, length).

    Every round, a run takes over the distance and the target of the run it points to, so distances
    double; runs that reach the end leave the join's driving side. Each run is pointed to by at most
    one other, so joins have no hot keys.
    """
    latest = materialize(runs.select("head", "next", F.col("length").alias("to_end")))
    while not latest.where("next is not null").isEmpty():
        ahead = latest.select(F.col("head").alias("next"), F.col("next").alias("beyond"), F.col("to_end").alias("more"))
        jumped = latest.where("next is not null").join(ahead, "next").select(
            "head", F.col("beyond").alias("next"), (F.col("to_end") + F.col("more")).alias("to_end")
        )
        moved = materialize(latest.where("next is null").unionByName(jumped))
        discard(latest)
        latest = moved
    return latest.select("head", "to_end")


def tour_positions(arcs: DataFrame) -> DataFrame:
    """(arc, position) along the tour: runs inside chunks of neighbouring conversations first, then the runs' order."""
    near = arcs.select("arc", "next", "conv_id", "depth").repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    local = materialize(near.select("arc", "next").mapInArrow(_contract, "arc bigint, head bigint, steps bigint, next bigint, length bigint"))
    ranked = rank_list(local.where("steps = 0").select("head", "next", "length"))
    total = local.agg(F.count(F.lit(1)).alias("total")).first().total
    placed = salted_lookup(local.select("arc", "head", "steps"), ranked, ["head"], ["arc"], "inner")
    return placed.select("arc", (F.lit(total) - F.col("to_end") + F.col("steps")).alias("position"))


def subtree_sums(numbered: DataFrame) -> DataFrame:
    """(id, n_leaves, saved_tokens): differences of the prefix sums along the tour at a node's two arcs."""
    arcs = materialize(tour_arcs(numbered))
    placed = arcs.select("arc", "leaf", "saved").join(tour_positions(arcs), "arc")
    summed = running_totals(placed, ["position"], {"leaf": "leaves_upto", "saved": "saved_upto"})
    id_ = F.shiftright("arc", 1).alias("id")

    def between(upto: str, own: str) -> Column:
        return F.max(upto) - F.min(upto) + F.sum(own)  # sums never fall along the tour

    return summed.groupBy(id_).agg(between("leaves_upto", "leaf").alias("n_leaves"), between("saved_upto", "saved").alias("saved_tokens"))


def numbered_nodes(nodes: DataFrame) -> DataFrame:
    """`nodes` with ids by which the children of a node are consecutive, and with what the tour asks of a node and its parent."""
    ids = global_ordinal(nodes, [F.asc_nulls_first("parent"), F.asc("conv_id"), F.asc("node")], "id")
    ids = materialize(ids)
    kids = ids.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.min("id").alias("first_child"), F.count(F.lit(1)).alias("n_children")
    )
    own = materialize(ids.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))))
    parents = own.where("n_children > 0").select(
        F.col("node").alias("parent"), F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"),
        F.col("first_child").alias("parent_first"), F.col("n_children").alias("parent_children"),
    )
    return salted_lookup(own, parents, ["parent"], ["id"])


def prefix_trie(conversations: DataFrame, family: int = FAMILY, borrow: int = BORROW) -> DataFrame:
    """A row per distinct sequence of first turns: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Conversations (conv_id, turn, role, text) are rebuilt with shared beginnings first (`rebuilt`). Null
    roles and texts are empty, rows with a null conv_id are left out, turns of one number are ordered
    by role and text, repeated rows are turns of their own, other columns are ignored, and an
    empty table gives an empty table. In the session it is given, joins broadcast only measured sides
    from then on.
    """
    measure_broadcasts(conversations.sparkSession)  # sizes of files tell nothing of salted rows: 10 MB can be GBs
    rows, convs = rebuilt(materialize(ordered_turns(conversations)), family, borrow)
    turns = materialize(sequence_nodes(rows))
    key = ["node", "parent", "depth", "bytes"]
    made = turns.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero, nothing = F.lit(0).cast("bigint"), F.lit(None).cast("binary")
    root = root.select(_root().alias("node"), nothing.alias("parent"), zero.alias("depth"), zero.alias("bytes"), "conv_id", "n_convs")
    nodes = made.select(*root.columns).unionByName(root).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("bytes"))
    numbered = materialize(numbered_nodes(nodes))
    depths = turns.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    last = salted_lookup(turns.select("conv_id", "depth", "node"), depths, ["conv_id", "depth"], ["node"], "inner").select("node", "conv_id")
    turnless = convs.join(depths, "conv_id", "left_anti").select(_root().alias("node"), "conv_id")
    ends = materialize(end_digests(last.unionByName(turnless)))
    return (
        numbered.join(subtree_sums(numbered), "id")
        .join(ends, "node", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
        )
    )


# CRC-32 is a fold over the bytes with the table of its fixed polynomial.
ORACLE = f"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
               lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) AS r(i)),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS ord
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
        lambda a, b: xor(a // 256, tab.t[(xor(a % 256, b) % 256 + 1)::BIGINT]))) % {BORROW} AS h FROM t, tab GROUP BY conv_id, tab.t),
p AS (SELECT c.conv_id, h, least(h, coalesce(b.n, 0)) AS taken, c.conv_id - c.conv_id % {FAMILY} AS base
      FROM c LEFT JOIN (SELECT conv_id AS base, n FROM c) b ON b.base = c.conv_id - c.conv_id % {FAMILY}),
r AS (SELECT p.conv_id, ord AS pos, role, text FROM p JOIN t ON t.conv_id = base AND ord < taken
      UNION ALL SELECT p.conv_id, ord - h + taken, role, text FROM p JOIN t USING (conv_id) WHERE ord >= h),
seq AS (SELECT p.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS s
        FROM p LEFT JOIN r USING (conv_id) GROUP BY 1),
mem AS (SELECT conv_id, d, s[1 : d] AS path, len(s) = d AS ends FROM seq, unnest(range(0, len(s) + 1)) AS u(d)),
node AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
           CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(path[d].text) END AS own FROM mem GROUP BY path, d),
kids AS (SELECT path[1 : d - 1] AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (path)),
sub AS (SELECT path[1 : u.e] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens
        FROM full_, unnest(range(0, d + 1)) AS u(e) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, sub.n_leaves, sub.saved_tokens, f.ends_sha256
FROM full_ f JOIN sub USING (path) LEFT JOIN node q ON f.d > 0 AND q.path = f.path[1 : f.d - 1]
"""
