"""Components and spanning forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.hashrand import uniform
from graphloom.graph import Graph
from graphloom.operators.rooted import path_minima
from graphloom.plans import fixpoint
from graphloom.plans.fixpoint import Rounds, cut


def connected_components(g: Graph) -> DataFrame:
    """(id, component): the smallest id of the node's component; direction is ignored."""
    found = fixpoint.components(g.edges)
    return g.nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(g: Graph) -> DataFrame:
    return connected_components(g).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def largest_component(g: Graph) -> Graph:
    """The subgraph of the largest component; of equally large ones, that with the smallest id."""
    c = cut(connected_components(g))
    top = c.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return g.subgraph(c.join(top, "component", "left_semi").select("id"))


def largest_components(g: Graph) -> Graph:
    """The subgraph of all components that no other exceeds in size."""
    c = cut(connected_components(g))
    sizes = cut(c.groupBy("component").count())
    top = sizes.join(F.broadcast(sizes.agg(F.max("count").alias("count"))), "count")  # one row
    return g.subgraph(c.join(top, "component", "left_semi").select("id"))


def strong_components(g: Graph) -> DataFrame:
    """(id, component): least id of those that reach the node and are reached by it, by forward-backward colouring.

    Each round colours every open node with the least id that reaches it; what a colour's own node
    is reached by, within the colour, is its component and leaves.
    """
    open_nodes, arcs, out = cut(g.nodes), cut(g.edges.select("src", "dst").where("src <> dst").distinct()), None
    while not open_nodes.isEmpty():
        ins = arcs.select(F.col("dst").alias("id")).distinct()
        outs = arcs.select(F.col("src").alias("id")).distinct()
        alive = ins.join(outs, "id", "left_semi")
        done = cut(open_nodes.join(alive, "id", "left_anti").select("id", F.col("id").alias("component")))
        if not done.isEmpty():
            new = done
        else:
            color = _spread(open_nodes, arcs)
            same = arcs.join(color.select(F.col("id").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("b")), "dst").where("a = b").select("src", "dst", F.col("a").alias("color"))
            same = cut(same)
            reached = cut(color.where("id = color"))
            front = reached
            while True:
                front = cut(front.select(F.col("id").alias("dst"), "color").join(same, ["dst", "color"]).select(F.col("src").alias("id"), "color").distinct().join(reached, "id", "left_anti"))
                if front.isEmpty():
                    break
                reached = cut(reached.union(front))
            new = reached.select("id", F.col("color").alias("component"))
        out = new if out is None else cut(out.union(new))
        open_nodes = cut(open_nodes.join(new, "id", "left_anti"))
        arcs = cut(arcs.join(open_nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(open_nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    return out if out is not None else g.nodes.select("id", F.col("id").alias("component"))


def _spread(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    color = cut(nodes.select("id", F.col("id").alias("color")))
    while True:
        best = color.select(F.col("id").alias("src"), "color").join(arcs, "src").groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("c"))
        new = cut(color.join(best, "id", "left").select("id", F.least("color", F.coalesce("c", "color")).alias("color"), (F.col("c") < F.col("color")).alias("fell")))
        color = new.select("id", "color")
        if new.where("fell").limit(1).count() == 0:
            return color


def maximum_forest(g: Graph, jitter: int | None = None) -> DataFrame:
    """Edges (src, dst, w) of a maximum-weight spanning forest by Borůvka rounds; equal weights by (src, dst), or by a salt."""
    tie = F.struct(F.col("src"), F.col("dst")) if jitter is None else F.struct(uniform(f"forest{jitter}", "src", "dst").alias("u"), F.col("src"), F.col("dst"))
    edges = cut(g.edges.where("src <> dst").groupBy("src", "dst").agg(F.max("w").alias("w")).withColumn("rank", F.struct(F.col("w"), tie.alias("tie"))))
    live = edges.select("src", "dst", "w", "rank", F.col("src").alias("a"), F.col("dst").alias("b"))
    chosen = None
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("c"), "src", "dst", "w", "rank", "a", "b").union(live.select("b", "src", "dst", "w", "rank", "a", "b"))
        picked = cut(ends.groupBy("c").agg(F.max_by(F.struct("src", "dst", "w", "a", "b"), "rank").alias("e")).select("e.*").distinct())
        chosen = picked.select("src", "dst", "w") if chosen is None else chosen.union(picked.select("src", "dst", "w"))
        # only what is left of the graph is joined: each tree that still has edges out picked one
        comp = fixpoint.components(picked, "a", "b")
        live = live.join(comp.select(F.col("id").alias("a"), F.col("component").alias("na")), "a").join(comp.select(F.col("id").alias("b"), F.col("component").alias("nb")), "b")
        live = cut(live.where("na <> nb").select("src", "dst", "w", "rank", F.col("na").alias("a"), F.col("nb").alias("b")))
    return chosen if chosen is not None else g.edges.where("false")


def union_maximum_forest(g: Graph) -> DataFrame:
    """Edges that some maximum-weight forest has: those whose ends no heavier edges connect. Weights may be any numbers.

    An edge belongs iff it is as heavy as the lightest edge on its path in one maximum forest.
    """
    forest = cut(maximum_forest(g))
    low = path_minima(forest, g.edges.where("src <> dst"))
    return g.edges.where("src <> dst").join(low, ["src", "dst"]).where("w >= low").select("src", "dst", "w")


def pseudo_random_forest(g: Graph, salt: int = 0, jitter: float = 1e-6) -> DataFrame:
    """A maximum-weight spanning forest after each weight has moved by up to jitter, so that ties are drawn and near ties may be."""
    e = g.edges.select("src", "dst", (F.col("w") + jitter * (1 - 2 * uniform(f"jitter{salt}", "src", "dst"))).alias("w"))
    return maximum_forest(Graph(g.nodes, e, g.directed)).select("src", "dst").join(g.edges, ["src", "dst"])


def random_forest(g: Graph, salt: int = 0) -> DataFrame:
    """A spanning forest drawn by random edge weights."""
    e = g.edges.select("src", "dst", uniform(f"tree{salt}", "src", "dst").alias("w"))
    f = maximum_forest(Graph(g.nodes, e, g.directed))
    return f.select("src", "dst").join(g.edges, ["src", "dst"])


def uniform_forest(g: Graph, salt: int = 0) -> DataFrame:
    """(src, dst, w): a spanning forest drawn uniformly among all (with weights, in proportion to the product of a forest's weights).

    Each component's least node is its root. Every other node points at a neighbour by a draw; nodes on cycles of these
    pointers draw again, all cycles at once, until none is left. In whatever order cycles go, what remains is a uniform tree. Where
    a node's pointers lead to in 2^k steps comes by doubling: with 2^k past the number of open nodes, it is the root or a place on a
    cycle, and all places of a cycle are found so. Nodes that lead to a root are done and leave.
    """
    loop = Rounds(g.nodes.sparkSession, "uniform")
    e = g.without_loops().edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    arcs = loop.put("arcs", e.union(e.select("dst", "src", "w")))
    roots = fixpoint.components(e).where("id = component").select("id")
    open_ = loop.put("open", arcs.select(F.col("src").alias("id")).distinct().join(roots, "id", "left_anti").select("id", F.lit(0).alias("turn")))
    arrows, done = loop.put("arrows", _arrows(open_, arcs, salt)), None
    while not open_.isEmpty():
        n = open_.count()
        far = arrows.select("id", "to")
        for _ in range(max(1, n.bit_length())):
            ahead = far.select(F.col("id").alias("to"), F.col("to").alias("next"))
            far = loop.put("far", far.join(ahead, "to", "left").select("id", F.coalesce("next", "to").alias("to")))
        # nodes that are not open lead on to a root
        stuck = loop.put("stuck", far.join(open_.select(F.col("id").alias("to")), "to", "left_semi"))
        ended = loop.put("ended", arrows.join(stuck.select("id"), "id", "left_anti").select("id", "to"))
        done = loop.put("done", ended if done is None else done.union(ended))
        cycle = stuck.select(F.col("to").alias("id")).distinct().withColumn("again", F.lit(1))
        open_ = loop.put("open", open_.join(stuck.select("id"), "id", "left_semi").join(cycle, "id", "left").select("id", (F.col("turn") + F.coalesce("again", F.lit(0))).alias("turn"), F.col("again").isNotNull().alias("again")))
        fresh = _arrows(open_.where("again").select("id", "turn"), arcs, salt)
        arrows = loop.put("arrows", arrows.select("id", "to").join(open_.where("not again").select("id"), "id", "left_semi").union(fresh.select("id", "to")))
        open_ = open_.select("id", "turn")
    out = g.edges.where("false").select("src", "dst", "w") if done is None else done.select(F.least("id", "to").alias("src"), F.greatest("id", "to").alias("dst")).join(e, ["src", "dst"])
    out = cut(out.select("src", "dst", "w"))
    loop.close()
    return out


def _arrows(nodes: DataFrame, arcs: DataFrame, salt: int) -> DataFrame:
    """(id, to): a neighbour of each node, drawn by weight with the node's turn."""
    options = nodes.join(arcs.withColumnRenamed("src", "id"), "id")
    key = F.log(F.greatest(uniform(f"arrow{salt}", "id", "dst", "turn"), F.lit(1e-12))) / F.col("w")
    return options.groupBy("id").agg(F.max_by("dst", F.struct(key.alias("k"), "dst")).alias("to"))


def bfs_forest(g: Graph) -> DataFrame:
    """A breadth-first forest from each component's smallest id."""
    from graphloom.operators.traversal import bfs_tree

    roots = connected_components(g).select(F.col("component").alias("id")).distinct()
    t = bfs_tree(g, roots).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return t.join(g.edges, ["src", "dst"])
