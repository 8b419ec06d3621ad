"""Matchings, independent sets, and the kernels for cliques, flows and path growing on small graphs.

The kernels are sequential by nature: they take a graph of at most KERNEL_EDGES edges in one task and
refuse larger ones.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.hashrand import uniform
from graphloom.graph import Graph
from graphloom.plans.fixpoint import cut

KERNEL_EDGES = 2_000_000


def local_max(g: Graph) -> DataFrame:
    """(src, dst): a matching by rounds of edges that are heaviest at both ends; equal weights by (src, dst)."""
    live = cut(g.edges.where("src <> dst").select("src", "dst", "w"))
    chosen = None
    while not live.isEmpty():
        rank = F.struct("w", (-F.col("src")).alias("a"), (-F.col("dst")).alias("b"))
        ends = live.select(F.col("src").alias("id"), rank.alias("r")).union(live.select("dst", rank.alias("r")))
        top = ends.groupBy("id").agg(F.max("r").alias("t"))
        a, b = top.select(F.col("id").alias("src"), F.col("t").alias("ta")), top.select(F.col("id").alias("dst"), F.col("t").alias("tb"))
        won = cut(live.join(a, "src").join(b, "dst").where("ta = tb").select("src", "dst"))
        chosen = won if chosen is None else cut(chosen.union(won))
        used = won.select(F.explode(F.array("src", "dst")).alias("id"))
        live = cut(live.join(used.withColumnRenamed("id", "src"), "src", "left_anti").join(used.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "w"))
    return chosen if chosen is not None else g.edges.where("false").select("src", "dst")


def is_matching(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count().agg((F.coalesce(F.max("count"), F.lit(0)) <= 1).alias("proper"))


def matching_partition(g: Graph, pairs: DataFrame) -> DataFrame:
    """(id, subset): pairs as subsets, named by their smaller end."""
    s = pairs.select(F.col("dst").alias("id"), F.col("src").alias("s"))
    return g.nodes.join(s, "id", "left").select("id", F.coalesce("s", "id").alias("subset"))


def matching_coarsening(g: Graph, pairs: DataFrame, loops: bool = True) -> Graph:
    c = g.contract(matching_partition(g, pairs))
    return c if loops else c.without_loops()


def project(coarse: DataFrame, mapping: DataFrame) -> DataFrame:
    """A partition of a coarse graph on the fine nodes of mapping (id, subset: the coarse node)."""
    return mapping.join(coarse.select(F.col("id").alias("subset"), F.col("subset").alias("s")), "subset").select("id", F.col("s").alias("subset"))


def luby(g: Graph, salt: int = 0) -> DataFrame:
    """(id): a maximal independent set; a node joins when its draw of the round is below all live neighbours'."""
    arcs = cut(g.both().where("src <> dst").select("src", "dst"))
    live, chosen, i = cut(g.nodes), None, 0
    while not live.isEmpty():
        i += 1
        draw = cut(live.select("id", F.struct(uniform(f"luby{salt}:{i}", "id").alias("u"), F.col("id").alias("i")).alias("r")))
        near = arcs.join(draw.select(F.col("id").alias("dst"), F.col("r").alias("q")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("q").alias("q"))
        won = cut(draw.join(near, "id", "left").where("q is null or r < q").select("id"))
        chosen = won if chosen is None else cut(chosen.union(won))
        gone = won.union(arcs.join(won.withColumnRenamed("id", "src"), "src", "left_semi").select("dst")).distinct()
        live = cut(live.join(gone, "id", "left_anti"))
        arcs = cut(arcs.join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    return chosen if chosen is not None else g.nodes


def kernel(g: Graph, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run over all edges (src, dst, w) in one task; refuses graphs beyond KERNEL_EDGES."""
    if g.edges.limit(KERNEL_EDGES + 1).count() > KERNEL_EDGES:
        raise ValueError(f"this kernel takes at most {KERNEL_EDGES} edges")
    return g.edges.select("src", "dst", "w").withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(lambda pdf: run(pdf.drop(columns="__one").sort_values(["src", "dst"])), schema)


def _adjacency(pdf: pd.DataFrame) -> dict[int, dict[int, float]]:
    adj: dict[int, dict[int, float]] = defaultdict(dict)
    for s, d, w in zip(pdf["src"], pdf["dst"], pdf["w"], strict=True):
        if s != d:
            adj[s][d] = adj[d][s] = w
    return adj


def path_growing(g: Graph) -> DataFrame:
    """(src, dst): the better of two alternating matchings along greedily grown heaviest paths."""

    def run(pdf):
        adj = _adjacency(pdf)
        sides: list[list] = [[], []]
        for start in sorted(adj):
            u, turn = start, 0
            while adj[u]:
                v = max(adj[u], key=lambda x: (adj[u][x], -x))
                sides[turn].append((min(u, v), max(u, v), adj[u][v]))
                turn ^= 1
                for x in list(adj[u]):
                    del adj[x][u]
                adj[u].clear()
                u = v
        best = max(sides, key=lambda s: sum(w for _, _, w in s))
        used: set[int] = set()
        out = []
        for s, d, _ in best:
            if s not in used and d not in used:
                used |= {s, d}
                out.append((s, d))
        return pd.DataFrame(out, columns=["src", "dst"]).astype("int64")

    return kernel(g, run, "src long, dst long")
