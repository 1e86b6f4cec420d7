"""Connected components of links that are found group by group, without all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, discard, stage

#: Gives a column of one of two members by its name.
Pick = Callable[[str], Column]
#: Keeps those (a, b) pairs that are links.
Verify = Callable[[DataFrame], DataFrame]

#: Rounds in which one member of each group is compared with the others, before what is left is compared pair by pair.
HUB_ROUNDS = 3
#: Groups of so many members at most are compared pair by pair at once.
SMALL_GROUP = 12
#: Parts, by one member, in which pairs meet what their members carry.
PAIR_PARTS = 2


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for (a, b) edges: component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a shuffle by node, until the
    edges stay the same.  Every step is checkpointed in the shared folder.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    by_node = Window.partitionBy("u")
    last = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.withColumn("m", F.least(F.min("v").over(by_node), F.col("u"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = low.withColumn("m", F.min("v").over(by_node))
        edges = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct().checkpoint()
        state = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if state == last or not state[0]:
            break
        last = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def grouped_components(members: DataFrame, prepare: Callable[[DataFrame], Verify], carry: tuple[str, ...] = (), feasible: Callable[[Pick, Pick], Column] | None = None, small: int = SMALL_GROUP, central: str | None = None) -> DataFrame:
    """(node, component) for (group, node, carry...) rows; nodes without a link are absent.

    Two members of a group are linked if they are feasible by what they carry and are kept by the function
    that ``prepare`` makes of the nodes which may be asked for.  Rows must be distinct.  Groups of ``small`` members at most
    are compared pair by pair (``central`` names a carried column that is largest for members likely to have
    many links).  In larger ones, in each of the first rounds, one member (the hub) is
    compared with those that are not yet in its component; it then leaves the group, as nothing of it is
    open.  Groups whose members all lie in one component are done, so a group of n near copies costs about
    n comparisons.  After ``HUB_ROUNDS`` every feasible pair that is still open is compared: no link
    between components is lost.
    """
    spark = members.sparkSession
    of_group = Window.partitionBy("group")
    feasible = feasible or (lambda one, other: F.lit(True))
    shared = members.select("group", "node", *carry).withColumn("size", F.count("*").over(of_group)).filter("size > 1").checkpoint()

    def pairs_of(rows: DataFrame, apart: Column) -> DataFrame:
        other = rows.withColumnsRenamed({x: f"{x}_2" for x in rows.columns if x != "group"})
        meets = (F.col("node") < F.col("node_2")) & apart & feasible(F.col, lambda name: F.col(f"{name}_2"))
        return rows.join(other, (rows["group"] == other["group"]) & meets).select(F.col("node").alias("a"), F.col("node_2").alias("b")).distinct()

    few = pairs_of(shared.filter(F.col("size") <= small).drop("size"), F.lit(True)).checkpoint()
    left = shared.filter(F.col("size") > small).drop("size")
    asked = few.select(F.explode(F.array("a", "b")).alias("node")).unionByName(left.select("node")).distinct().checkpoint()
    verify = prepare(asked)
    links = verify(few).select("a", "b").checkpoint()
    labels = connected_components(links)
    if left.isEmpty():
        return labels
    for turn in range(HUB_ROUNDS + 1):
        known = left.join(labels.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
        open_ = known.withColumn("lo", F.min("c").over(of_group)).withColumn("hi", F.max("c").over(of_group)).filter("lo < hi").drop("lo", "hi")
        if turn < HUB_ROUNDS:
            # The hub is the member of the largest component; among equals the most central one, then by hash.
            open_ = open_.withColumn("k", F.count("*").over(Window.partitionBy("group", "c")))
            open_ = open_.withColumn("hub", F.max(F.struct("k", F.col(central or "k").alias("p"), F.xxhash64("node", F.lit(turn)).alias("x"), "node", "c", *carry)).over(of_group)).drop("k").checkpoint()
            pairs = open_.filter("c <> hub.c").filter(feasible(F.col, lambda name: F.col(f"hub.{name}")))
            pairs = pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
            left = open_.filter("node <> hub.node").select("group", "node", *carry)
        else:
            pairs = pairs_of(open_, F.col("c") != F.col("c_2"))
        found = verify(pairs).select("a", "b").checkpoint()
        labels = joined_by(labels, found)
    return labels


def starred_components(members: Sequence[DataFrame], verify: Verify, traits: tuple[DataFrame, DataFrame], feasible: Callable[[Pick, Pick], Column], small: int = SMALL_GROUP) -> DataFrame:
    """(node, component) for tables of (group, node, ...) rows; nodes without a link are absent.

    Two members of a group are linked if ``verify`` keeps them; by their ``traits`` (node, ..., as ``bucketed`` gives
    them) a pair must be ``feasible`` to be linked.  For groups that are mostly pure: each member is compared with the least of its
    group, so a group of n near copies costs n comparisons at most.  What is left open
    (groups whose members lie in several components) is compared with one hub after another if it has more than ``small``
    members, and at last pair by pair, so no link between components is lost.  A group's rows stream through one task
    once, without being sorted; all later steps aggregate by group and join.

    Each of ``members`` has groups of its own.  They are dealt, and pairs meet their traits, one part after another, so that
    the disk holds the shuffles of one part; what no step reads any more is deleted.
    """
    placed, plain = traits

    def possible(pairs: DataFrame, parts: int) -> list[DataFrame]:
        """Feasible pairs (a, b), staged in parts by a, of pairs that may be repeated."""
        found = []
        for part in range(parts):

            def own(name: str) -> Column:
                return F.pmod(F.xxhash64(name), F.lit(parts)) == part  # noqa: B023, used at once

            named = [t.withColumnsRenamed({x: side if x == "node" else f"{side}_{x}" for x in t.columns}) for t, side in ((placed, "b"), (plain.filter(own("node")), "a"))]
            met = pairs.filter(own("a")).repartition(buckets_for(pairs.sparkSession), "b").distinct()
            for table, side in zip(named, "ba"):
                met = met.join(table, side)
            found.append(stage(met.filter(feasible(lambda x: F.col(f"b_{x}"), lambda x: F.col(f"a_{x}"))).select("a", "b"), "pairs"))
        return found

    def linked(parts: list[DataFrame]) -> DataFrame:
        asked = stage(reduce(DataFrame.unionByName, parts).distinct(), "pairs")
        links = verify(asked).select("a", "b").checkpoint()
        for part in (asked, *parts):
            discard(part)
        return links

    shared, pairs = [], []
    for rows in members:
        dealt = rows.select("group", "node").repartition("group")
        ends = dealt.groupBy("group").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).filter("low < high").drop("high")
        shared.append(stage(dealt.join(ends.hint("shuffle_hash"), "group").distinct(), "shared"))
        pairs += possible(shared[-1].filter("low < node").select(F.col("low").alias("a"), F.col("node").alias("b")), PAIR_PARTS)
    labels = connected_components(linked(pairs))
    # Nothing of the least member is open any more: it has been compared with all others, and so nothing is in groups of two.
    open_rows = [x.filter("low <> node and size > 2") for x in shared]
    few = [x.filter(F.col("size") <= small).select("group", "node") for x in open_rows]
    left = [x.filter(F.col("size") > small).select("group", "node") for x in open_rows]
    older: list[DataFrame] = []
    for turn in range(HUB_ROUNDS + 1):
        if turn == HUB_ROUNDS:
            left = [one.unionByName(other) for one, other in zip(left, few)]
        hub = F.max(F.struct(F.xxhash64("node", F.lit(turn)).alias("x"), F.col("node").alias("hub"), F.col("c").alias("hub_c")))
        rows = []
        for own in left:
            known = own.join(labels.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node")).repartition("group")
            open_ = known.groupBy("group").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), hub.alias("h")).filter("lo < hi").select("group", "h.hub", "h.hub_c")
            rows.append(stage(known.join(open_.hint("shuffle_hash"), "group"), "open"))
        for x in older:
            discard(x)
        older = rows
        pairs = []
        if turn < HUB_ROUNDS:
            left = [x.filter("node <> hub").select("group", "node") for x in rows]
            far = reduce(DataFrame.unionByName, rows).filter("c <> hub_c")
            if not far.isEmpty():
                pairs = possible(far.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")), 1)  # a pair a row at most
        else:
            for own, part in product(rows, range(PAIR_PARTS)):
                here = own.filter(F.pmod(F.xxhash64("group"), F.lit(PAIR_PARTS)) == part).select("group", "node", "c")
                if not here.isEmpty():
                    one = here.join(placed, "node").repartition("group")  # dealt once, read by both sides
                    other = one.withColumnsRenamed({x: f"{x}_2" for x in one.columns if x != "group"})
                    meets = (F.col("node") < F.col("node_2")) & (F.col("c") != F.col("c_2")) & feasible(F.col, lambda name: F.col(f"{name}_2"))
                    pairs.append(stage(one.join(other, (one["group"] == other["group"]) & meets).select(F.col("node").alias("a"), F.col("node_2").alias("b")).distinct(), "pairs"))
        if pairs:
            labels = joined_by(labels, linked(pairs))
    for x in [*older, *shared]:
        discard(x)
    return labels


def joined_by(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) with the components that ``links`` (a, b) connect made one."""
    if links.isEmpty():
        return labels
    old = labels.withColumnRenamed("component", "c")
    named = links.join(old.withColumnsRenamed({"node": "a", "c": "ca"}), "a", "left").join(old.withColumnsRenamed({"node": "b", "c": "cb"}), "b", "left")
    named = named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = connected_components(named).withColumnsRenamed({"node": "c", "component": "to"})
    moved = old.join(joined, "c", "left").select("node", F.coalesce("to", "c").alias("component"))
    return moved.unionByName(joined.select(F.col("c").alias("node"), F.col("to").alias("component"))).distinct().checkpoint()
