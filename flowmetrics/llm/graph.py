"""Connected components of an edge table, and of candidate buckets whose links are yet to be verified."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .store import materialize

HUBS_GROW = 8
LINKS_ENOUGH = 5


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (a, b); component is the smallest node of a chain of contractions.

    Each round every node points to its smallest neighbour (a minimum, so a
    node of any degree combines before the shuffle), pointers are followed
    once more, and edges are redrawn between what they point to; loops and
    repeats go.  A round at least halves the nodes that still have edges.
    """
    edges = materialize(edges.select("a", "b").where("a != b").distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    labels = materialize(labels, "labels")
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        to = materialize(ends.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")), "pointers")
        beyond = to.select(F.col("u").alias("mid"), F.col("to").alias("root"))
        roots = materialize(to.join(beyond, F.col("to") == F.col("mid")).select("u", "root"), "roots")
        labels = materialize(labels.join(roots, F.col("component") == F.col("u"), "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        first = edges.join(roots, F.col("a") == F.col("u")).select(F.col("root").alias("x"), "b")
        both = first.join(roots, F.col("b") == F.col("u")).select(F.least("x", "root").alias("a"), F.greatest("x", "root").alias("b"))
        edges = materialize(both.where("a != b").distinct(), "edges")
    return labels


def link_buckets(members: DataFrame, verify: Callable[[DataFrame], DataFrame], possible: Callable[..., Column] | None = None) -> DataFrame:
    """(node, component) of the nodes that verified links connect; members: (key, node) rows of buckets, with a column ``fact`` about the node if ``possible`` is given.

    ``verify`` takes candidate pairs (a, b) and returns those that are links;
    ``possible(fact, hub_fact)`` is false only for pairs that cannot be
    links, which then count as compared.
    First every node is compared with one node, the smallest hub of all its
    buckets, which joins most of a large group by one comparison a member.
    Then, in buckets that still hold several components, members are
    compared with hubs: one of the largest component first, another one as long
    as a fifth of the comparisons are links, then about eight, 64, ... outside it.  A hub is compared with all members of other components
    and retires.  When no bucket holds two components, every pair in a
    bucket has been compared or is connected, so the components are those
    of all links; n near copies take about n comparisons.
    """
    if possible is None:
        members = members.select("key", "node", F.lit(0).alias("fact"))
        possible = lambda *_: F.lit(True)
    hubs = members.groupBy(F.col("key").alias("k")).agg(F.min(F.struct("node", "fact")).alias("h")).select("k", F.col("h.node").alias("hub"), F.col("h.fact").alias("hub_fact"))
    can_link = possible(F.col("fact"), F.col("hub_fact"))
    nearest = members.join(hubs, (F.col("key") == F.col("k")) & can_link).groupBy("node").agg(F.min("hub").alias("hub"))
    checked = materialize(nearest.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")), "pairs")
    labels = components(verify(checked))
    several = 1
    while True:
        named = labels.select(F.col("node").alias("named"), "component")
        now = members.join(named, F.col("node") == F.col("named"), "left").select("key", "node", "fact", F.coalesce("component", "node").alias("component"))
        now = materialize(now, "named")
        sizes = now.groupBy("key", "component").agg(F.count("*").alias("count"), F.min("node").alias("least"))
        # a bucket whose members are all in one component is done
        open_ = sizes.groupBy(F.col("key").alias("k")).agg(F.max_by(F.struct("component", "least"), F.struct("count", "component")).alias("top"), F.sum("count").alias("all"), F.max("count").alias("most"), F.count("*").alias("parts")).where("parts > 1")
        open_ = open_.select("k", F.col("top.component").alias("largest"), F.col("top.least").alias("inner"), F.ceil((F.col("all") - F.col("most")) / several).alias("every"))
        # every outside member is a hub once ``several`` reaches their number
        is_hub = F.col("node") == F.col("inner") if several == 1 else (F.col("component") != F.col("largest")) & (F.pmod(F.xxhash64("node", "key"), F.col("every")) == 0)
        now = now.join(open_, F.col("key") == F.col("k")).select("key", "node", "fact", "component", is_hub.alias("is_hub"))
        now = materialize(now, "members")
        if now.isEmpty():
            return labels
        picked = now.where("is_hub").select(F.col("key").alias("k"), F.col("node").alias("hub"), F.col("component").alias("hub_component"), F.col("fact").alias("hub_fact"))
        meets = now.join(picked, (F.col("key") == F.col("k")) & (F.col("component") != F.col("hub_component")) & can_link).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
        fresh = materialize(meets.join(checked, ["a", "b"], "left_anti"), "pairs")
        checked = checked.unionAll(fresh)
        found = verify(fresh)
        labels = components(found.unionAll(labels.select(F.col("component").alias("a"), F.col("node").alias("b"))))
        members = now.where("not is_hub").select("key", "node", "fact")
        # while one hub a bucket still links many, more hubs would compare what is soon connected
        if several > 1 or LINKS_ENOUGH * found.count() < fresh.count():
            several *= HUBS_GROW
