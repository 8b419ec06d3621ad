"""Colourings by priority rounds, and the sweeps that they put in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.hashrand import uniform
from graphloom.graph import Graph
from graphloom.plans.fixpoint import Rounds, cut


def greedy_coloring(g: Graph, salt: int = 0) -> DataFrame:
    """(id, color): a proper colouring with colours from 0. Each round colours the nodes whose draw is the greatest among their uncoloured neighbours, with the least colour that no neighbour has; so no node has a colour above its degree, and rounds grow with the logarithm of n."""
    loop = Rounds(g.nodes.sparkSession, "coloring")
    arcs = loop.put("arcs", g.without_loops().both().select("src", "dst").distinct())
    draw = F.struct(uniform(f"coloring{salt}", "id").alias("u"), F.col("id").alias("i"))
    x = loop.put("x", g.nodes.select("id", F.lit(None).cast("int").alias("color")))
    while True:
        open_ = x.where("color is null").select("id", draw.alias("r"))
        if open_.isEmpty():
            break
        near = open_.withColumnsRenamed({"id": "src", "r": "mine"}).join(arcs, "src").join(x.select(F.col("id").alias("dst"), "color", F.when(F.col("color").isNull(), draw).alias("q")), "dst")
        top = near.groupBy(F.col("src").alias("id")).agg(F.max("q").alias("q"), F.array_sort(F.collect_set("color")).alias("used"))
        won = open_.join(top, "id", "left").where("q is null or r > q")
        # colours in use from 0 without a gap, then the first that is free
        free = F.coalesce(F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used")), F.lit(0))
        new = won.select("id", free.alias("new"))
        x = loop.put("x", x.join(new, "id", "left").select("id", F.coalesce("color", "new").cast("int").alias("color")))
    out = cut(x)
    loop.close()
    return out


def gauss_seidel(m: DataFrame, rhs: DataFrame, x: DataFrame, sweeps: int = 10, colors: DataFrame | None = None) -> DataFrame:
    """(i, v): x after sweeps of Gauss-Seidel relaxation of m x = rhs, m symmetric in its pattern and with a full diagonal.

    Rows go by colour class: rows of a class do not depend on each other, so a class is one plan, and the sweep equals one that takes the
    rows one after another in the order of their colours. Rows that depend on no other are solved at once and take no part in sweeps. No round
    sends a table to all tasks, whatever its size, as rounds are many.
    """
    loop = Rounds(m.sparkSession, "seidel")
    m = loop.put("m", m.select("i", "j", "v"))
    off = m.where("i <> j and v <> 0")
    start = m.where("i = j").select("i", F.col("v").alias("d")).join(rhs.select("i", F.col("v").alias("b")), "i", "left").join(x.select("i", F.col("v").alias("x")), "i", "left")
    start = loop.put("start", start.select("i", "d", F.coalesce("b", F.lit(0.0)).alias("b"), F.coalesce("x", F.lit(0.0)).alias("x")))
    if colors is None:
        colors = greedy_coloring(Graph.from_edges(off.select(F.col("i").alias("src"), F.col("j").alias("dst"))))
    else:
        start = start.join(colors.select(F.col("id").alias("i")), "i", "left_semi")
    colors = loop.put("colors", off.select("i").distinct().join(colors.select(F.col("id").alias("i"), "color"), "i"))
    alone = start.join(colors, "i", "left_anti").select("i", (F.col("b") / F.col("d") if sweeps else F.col("x")).alias("v"))
    state = loop.put("x", start.join(colors, "i"))
    off = loop.put("off", off.join(colors, "i"))
    classes = [r.color for r in state.select("color").distinct().orderBy("color").collect()]  # at most the greatest degree, one more
    for _ in range(sweeps):
        for c in classes:
            got = off.where(F.col("color") == c).hint("merge").join(state.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("s"))
            new = F.when(F.col("color") == c, (F.col("b") - F.coalesce("s", F.lit(0.0))) / F.col("d")).otherwise(F.col("x"))
            state = loop.put("x", state.hint("merge").join(got, "i", "left").select("i", "d", "b", "color", new.alias("x")))
    out = cut(state.select("i", F.col("x").alias("v")).union(alone))
    loop.close()
    return out
