"""Interval labels of forests: the nodes under a node are those whose number lies inside its interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.functions.ordering import global_ordinal
from freshet.functions.series import salted_lookup
from freshet.session import discard, materialize


def cut_cycles(links: DataFrame) -> DataFrame:
    """(tree, node, parent, head) of pointers (tree, node, parent) that may run in circles.

    Pointers double each round, so a node either meets the end or, after as many steps as there are
    nodes, lands on a circle. The members of a circle become children of its smallest member, their
    `head`, which becomes a root; everywhere else `head` is the node itself. A parent that is no node
    counts as none.
    """
    known = links.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_on"))
    sure = materialize(
        links.select("tree", "node", "parent").join(known, ["tree", "parent"], "left")
        .select("tree", "node", F.when(F.col("_on"), F.col("parent")).alias("parent"))
    )
    live = materialize(sure.where("parent is not null").select("tree", "node", F.col("parent").alias("to"), F.least("node", "parent").alias("low")))
    steps, limit = 1, sure.count()
    while steps <= limit and not live.isEmpty():
        ahead = live.select("tree", F.col("node").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        moved = materialize(
            live.join(ahead, ["tree", "to"]).select("tree", "node", F.col("_to").alias("to"), F.least("low", "_low").alias("low"))
        )
        discard(live)
        live, steps = moved, 2 * steps
    on_circle = live.select("tree", F.col("to").alias("node")).distinct()
    heads = live.join(on_circle, ["tree", "node"], "left_semi").select("tree", "node", F.col("low").alias("head"))
    marked = sure.join(heads, ["tree", "node"], "left")
    inside = F.col("head").isNotNull()
    parent = F.when(inside & (F.col("head") == F.col("node")), F.lit(None)).when(inside, F.col("head")).otherwise(F.col("parent"))
    return marked.select("tree", "node", parent.alias("parent"), F.coalesce("head", "node").alias("head"))


def rank_chain(links: DataFrame) -> DataFrame:
    """(id, to_end): the number of links to the end of a list (id, next) without circles, by pointer jumping.

    Every id is pointed to at most once, so joins have no hot keys; ids that reached the end only
    answer. About log2 of the list's length rounds, each a table in the shared folder.
    """
    latest = materialize(links.select("id", "next", F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("bigint").alias("to_end")))
    while not latest.where("next is not null").isEmpty():
        ahead = latest.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("to_end").alias("_more"))
        jumped = latest.where("next is not null").join(ahead, "next").select(
            "id", F.col("_next").alias("next"), (F.col("to_end") + F.col("_more")).alias("to_end")
        )
        moved = materialize(latest.where("next is null").unionByName(jumped))
        discard(latest)
        latest = moved
    return latest.select("id", "to_end")


def forest_intervals(links: DataFrame) -> DataFrame:
    """(tree, node, enter, leave) of a forest (tree, node, parent): its Euler tour's positions.

    Node b lies at or under node a exactly if a.enter <= b.enter <= a.leave; positions are unique over
    all trees. Nodes of one parent have consecutive ids after one global sort, so the tour's links need no
    window over the children of a node, however many it has.
    """
    order = [F.col("parent").isNotNull(), F.col("tree"), F.col("parent"), F.col("node")]
    ids = materialize(global_ordinal(links.select("tree", "node", "parent"), order, "id"))
    kids = ids.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(
        F.min("id").alias("child"), F.count(F.lit(1)).alias("children")
    )
    own = materialize(ids.join(kids, ["tree", "node"], "left"))
    above = own.where("child is not null").select(
        "tree", F.col("node").alias("parent"), F.col("id").alias("parent_id"), (F.col("child") + F.col("children")).alias("beyond")
    )
    roots = own.where("parent is null").count()
    known = salted_lookup(own, above, ["tree", "parent"], ["id"]).withColumn("beyond", F.coalesce("beyond", F.lit(roots)))
    down = F.coalesce(2 * F.col("child"), 2 * F.col("id") + 1)
    over = F.when(F.col("id") + 1 < F.col("beyond"), 2 * (F.col("id") + 1)).otherwise(2 * F.col("parent_id") + 1)
    arcs = known.select(
        F.explode(F.array(
            F.struct((2 * F.col("id")).alias("id"), down.alias("next")), F.struct((2 * F.col("id") + 1).alias("id"), over.alias("next"))
        )).alias("a")
    ).select("a.*")
    ranked = rank_chain(arcs)
    last = 2 * ids.count() - 1
    spots = ranked.groupBy(F.shiftright("id", 1).alias("id")).agg(
        (F.lit(last) - F.max("to_end")).alias("enter"), (F.lit(last) - F.min("to_end")).alias("leave")
    )
    return own.select("id", "tree", "node").join(spots, "id").drop("id")


def pairs_under(intervals: DataFrame, block: int = 4096) -> DataFrame:
    """(tree, node, under): every node with each node at or under it, as positions unrolled from the intervals."""
    size = F.col("leave") - F.col("enter") + 1
    blocks = F.sequence(F.lit(0).cast("bigint"), F.ceil(size / block) - 1)
    start = F.col("enter") + F.col("_b") * block
    spots = F.sequence(start, F.least(start + block - 1, F.col("leave")))
    laid = intervals.select("tree", "node", "enter", "leave", F.explode(blocks).alias("_b")).select("tree", "node", F.explode(spots).alias("enter"))
    return laid.join(intervals.select("enter", F.col("node").alias("under")), "enter").drop("enter")

