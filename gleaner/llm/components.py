"""Connected components of a graph whose edges stay in Spark."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.store import stored

GROUP_ROWS = 50_000
"""Members up to which lists that touch each other are compared as one group."""
BLOCK_ROWS = 512
BLOCK_VALUES = 200_000
"""Members and set values of a block, about."""
_COLUMNS = 4096


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of an edge can reach.

    ``edges`` has columns ``a`` and ``b`` of one type with an order; the result has ``node`` and
    ``component``, one row for each node. Self-loops and repeated edges are
    fine, nulls are dropped, no edges give no rows.

    Large-star and small-star steps by turns (Kiveris et al., 2014): each hangs
    a node's neighbours on the smallest of them, found by an aggregation that
    sums up before the shuffle, so a hub's edges need not meet in one task. The
    joins are inner sort-merge joins that Spark can split. Every step is
    written down, and the loop ends when an edge list repeats itself.
    """
    now = stored(edges.where("a is not null and b is not null and a <> b")
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = stored(_small_star(_large_star(now)))
        fresh = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if fresh == mark:
            break
        mark = fresh
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node hangs on the node's smallest neighbour, itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, hang on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(kept).where("a <> b").distinct()


def jaccard_links(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets (``id, full``) have a similarity of ``similar`` per cent or more."""
    side = lambda c, name: sets.select(F.col("id").alias(c), F.col("full").alias(name))
    both = pairs.join(side("a", "fa"), "a").join(side("b", "fb"), "b")
    shared = F.size(F.array_intersect("fa", "fb"))
    judged = both.select("a", "b", shared.alias("i"), (F.size("fa") + F.size("fb") - shared).alias("u"))
    return judged.where(f"100 * i >= {similar} * u").select("a", "b").distinct()


def parts_by_hubs(keys: DataFrame, verified: Callable[[DataFrame], DataFrame], sets: DataFrame, similar: int, rounds: int = 2) -> DataFrame:
    """Components over the linked pairs among rows that share a key.

    ``keys`` has a key ``v``, an ``id`` and the size ``n`` of its set;
    ``verified`` returns those of some pairs ``a, b`` that are linked, and
    ``sets`` has ``id, full``. Returns ``node, component``, a row for each linked id.

    Each id is compared with one hub of its list, and what verifies is one
    component. Lists that still touch several get other hubs, ``rounds`` in all.
    Then the members of different components are compared on their full sets, in
    blocks of bounded size. So no link between components is missed, and pairs
    are never rows of a table unless they are compared with a hub or linked.
    """
    found = keys.sparkSession.createDataFrame([], keys.select(F.col("id").alias("node"), F.col("id").alias("component")).schema)
    left = keys.withColumn("part", F.col("id"))
    for turn in range(rounds + 1):
        if turn < rounds:
            draw = F.col("id") if turn == 0 else F.xxhash64(F.lit(turn), "id")
            first = F.min(F.struct(draw.alias("draw"), F.col("id").alias("hub"), F.col("part").alias("hub_part")))
            hubs = left.groupBy("v").agg(first.alias("h")).select("v", "h.hub", "h.hub_part")
            pairs = left.join(hubs, "v").where("part <> hub_part").select(
                F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
            fresh = stored(verified(pairs.distinct()))
        else:
            fresh = stored(_across(left, sets, similar))
        if fresh.isEmpty():
            continue
        found = components(fresh.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        if turn == rounds:
            break
        tagged = (left.drop("part").join(found, F.col("id") == F.col("node"), "left")
                  .select("v", "id", "n", F.coalesce("component", "id").alias("part")))
        split = tagged.groupBy("v").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("v")
        left = stored(tagged.join(split, "v"))
        if left.isEmpty():
            break
    return found


def _across(left: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Links between members of a list that belong to different parts.

    Lists that share members are taken as one group, so that a pair with many
    common keys is compared once; where such a group grows beyond ``GROUP_ROWS``,
    its lists stay apart. A group is cut into blocks, and each two blocks of it
    meet in a task of their own.
    """
    hubs = left.groupBy("v").agg(F.min("id").alias("hub"))
    chained = components(left.join(hubs, "v").select(F.col("id").alias("a"), F.col("hub").alias("b")))
    sizes = chained.groupBy("component").agg(F.count(F.lit(1)).alias("rows")).where(f"rows <= {GROUP_ROWS}")
    small = chained.join(sizes, "component").select(F.col("node").alias("id"), F.col("component").cast("string").alias("group"))
    members = stored(left.join(small, "id", "left").select(
        F.coalesce(F.concat(F.lit("g"), "group"), F.concat(F.lit("v"), F.col("v").cast("string"))).alias("g"), "id", "n", "part").distinct())
    blocks = members.groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_VALUES)).cast("int").alias("blocks"))
    placed = members.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "g", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "part")
    kind = dict(sets.dtypes)["id"]
    linked = met.join(sets, "id").select("g", "lo", "hi", "block", "id", "part", "full").groupBy("g", "lo", "hi").applyInArrow(
        _compared(similar), f"a {kind}, b {kind}")
    return linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _compared(similar: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table["full"].chunk(0) if table.num_rows else None
        sizes = np.diff(lists.offsets.to_numpy())
        part = table["part"].chunk(0).dictionary_encode().indices.to_numpy()
        block, lo, hi = table["block"].to_numpy(), table["lo"][0].as_py(), table["hi"][0].as_py()
        one, two = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        row = np.repeat(np.arange(len(sizes)), sizes)
        _, column, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        seen = count[column] > 1  # others are in no intersection
        kept, column = np.unique(column[seen], return_inverse=True)
        row = row[seen]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(one), len(two)), np.float32)
        for at in range(0, len(kept), _COLUMNS):
            a, b = np.searchsorted(column, [at, at + _COLUMNS])
            holds = np.zeros((len(sizes), min(_COLUMNS, len(kept) - at)), np.float32)
            holds[row[a:b], column[a:b] - at] = 1
            common += holds[one] @ holds[two].T
        union = sizes[one][:, None] + sizes[two][None, :] - common
        linked = (100 * common >= similar * union) & (part[one][:, None] != part[two][None, :])
        x, y = np.nonzero(linked)
        ids = table["id"].chunk(0)
        return pa.table({"a": ids.take(pa.array(one[x])), "b": ids.take(pa.array(two[y]))})
    return run
