"""Rooted forests: parents by list ranking of Euler tours, ancestors and path minima by binary lifting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import numbered
from graphloom.plans import fixpoint
from graphloom.plans.fixpoint import Rounds, cut


def rooted(forest: DataFrame) -> DataFrame:
    """(id, parent, w): for each node of the forest's edges (src, dst, w) but the least of each tree, its parent and the weight of the edge to it.

    Each edge becomes two arcs, numbered by (src, dst). After the arc u -> v the tour takes the arc out of v that follows v -> u in
    that order, from the last one back to the first; it starts with the first arc of the tree's root. Arcs find their distance from
    the tour's end by pointer jumping, in rounds that grow with the logarithm of the forest's size however deep it is. Of the two arcs
    of an edge the one farther from the end leads down. No arc has more than one follower, so no key is hot.
    """
    loop = Rounds(forest.sparkSession, "rooted")
    e = forest.select("src", "dst", "w")
    arcs = loop.put("arcs", numbered(e.union(e.select("dst", "src", "w")), ["src", "dst"], "n"))
    first = arcs.groupBy("src").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    # the arc after n around its start
    turn = arcs.join(first, "src").select("src", "dst", F.when(F.col("n") == F.col("last"), F.col("first")).otherwise(F.col("n") + 1).alias("turn"))
    follow = arcs.join(turn.select(F.col("src").alias("dst"), F.col("dst").alias("src"), "turn"), ["src", "dst"]).select("n", F.col("turn").alias("next"))
    roots = fixpoint.components(e).where("id = component").select(F.col("id").alias("src"))
    starts = first.join(roots, "src", "left_semi").select(F.col("first").alias("next"), F.lit(True).alias("start"))
    state = loop.put("rank", follow.join(starts, "next", "left").select("n", F.when(F.col("start").isNull(), F.col("next")).alias("next"), F.when(F.col("start").isNull(), 1).otherwise(0).cast("long").alias("to_end")))
    while not state.where("next is not null").isEmpty():
        ahead = state.select(F.col("n").alias("next"), F.col("next").alias("far"), F.col("to_end").alias("more"))
        state = loop.put("rank", state.join(ahead, "next", "left").select("n", F.col("far").alias("next"), (F.col("to_end") + F.coalesce("more", F.lit(0))).alias("to_end")))
    placed = arcs.join(state.select("n", "to_end"), "n")
    back = placed.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("to_end").alias("back"))
    out = cut(placed.join(back, ["src", "dst"]).where("to_end > back").select(F.col("dst").alias("id"), F.col("src").alias("parent"), "w"))
    loop.close()
    return out


def path_minima(forest: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, low): for each pair (src, dst) within a tree of forest (src, dst, w), the least weight on the path between them; pairs of different trees have no row, a node and itself have null.

    Tables of the 2^k-th ancestor and the least weight on the way there answer all pairs together: the deeper end is lifted to
    the other's depth by the bits of the gap, then both rise as long as their ancestors differ.
    """
    up = rooted(forest)
    loop = Rounds(forest.sparkSession, "lifting")
    nodes = forest.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    jump = loop.put("up0", nodes.join(up, "id", "left").select("id", F.col("parent").alias("a"), F.col("w").alias("low"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("long").alias("d")))
    tables, depth = [jump], jump
    while not tables[-1].where("a is not null").isEmpty():
        last = tables[-1]
        ahead = last.select(F.col("id").alias("a"), F.col("a").alias("b"), F.col("low").alias("more"), F.col("d").alias("e"))
        joined = last.join(ahead, "a", "left")
        tables.append(loop.put(f"up{len(tables)}", joined.select("id", F.col("b").alias("a"), F.least("low", "more").alias("low"), (F.col("d") + F.coalesce("e", F.lit(0))).alias("d"))))
        depth = tables[-1]
    depths, trees = depth.select("id", "d"), fixpoint.components(forest)
    ask = pairs.select("src", "dst").distinct()
    for c in ("src", "dst"):
        ask = ask.join(depths.select(F.col("id").alias(c), F.col("d").alias(f"d_{c}")), c).join(trees.select(F.col("id").alias(c), F.col("component").alias(f"t_{c}")), c)
    deep = F.col("d_src") >= F.col("d_dst")
    gap = F.abs(F.col("d_src") - F.col("d_dst"))
    state = loop.put("ask", ask.where("t_src = t_dst").select("src", "dst", F.when(deep, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(deep, F.col("dst")).otherwise(F.col("src")).alias("y"), gap.alias("gap"), F.lit(None).cast("double").alias("low")))
    for k, t in enumerate(tables[:-1]):
        lift = t.select(F.col("id").alias("x"), F.col("a").alias("xa"), F.col("low").alias("xl"))
        bit = F.expr(f"gap >> {k} & 1") == 1
        state = loop.put("ask", state.join(lift, "x", "left").select("src", "dst", F.when(bit, F.col("xa")).otherwise(F.col("x")).alias("x"), "y", "gap", F.when(bit, F.least("low", "xl")).otherwise(F.col("low")).alias("low")))
    for k in range(len(tables) - 2, -1, -1):
        state = _rise(loop, state, tables[k], (F.col("xa") != F.col("ya")))
    state = _rise(loop, state, tables[0], (F.col("x") != F.col("y")))
    out = cut(state.select("src", "dst", "low"))
    loop.close()
    return out


def _rise(loop: Rounds, state: DataFrame, table: DataFrame, when) -> DataFrame:
    """Both ends move to their ancestors of this table where the condition holds."""
    a, b = (table.select(F.col("id").alias(c), F.col("a").alias(f"{c}a"), F.col("low").alias(f"{c}l")) for c in ("x", "y"))
    go = F.coalesce(when, F.lit(False))
    new = {c: F.when(go, F.col(f"{c}a")).otherwise(F.col(c)).alias(c) for c in ("x", "y")}
    return loop.put("ask", state.join(a, "x", "left").join(b, "y", "left").select("src", "dst", new["x"], new["y"], "gap", F.when(go, F.least("low", "xl", "yl")).otherwise(F.col("low")).alias("low")))
