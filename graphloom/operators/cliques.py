"""Largest cliques, one small search for each node's later neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.centrality import core_numbers
from graphloom.plans.fixpoint import cut


def _largest(pairs: list[tuple[int, int]], least: int) -> list[int]:
    """A largest clique of the graph of these edges if it has more than `least` nodes, else nothing; bit sets, with greedy colours as the bound."""
    ids = sorted({v for p in pairs for v in p})
    at = {v: i for i, v in enumerate(ids)}
    near = [0] * len(ids)
    for a, b in pairs:
        near[at[a]] |= 1 << at[b]
        near[at[b]] |= 1 << at[a]
    best: list[int] = []
    stack = [([], (1 << len(ids)) - 1)]
    while stack:
        held, open_ = stack.pop()
        order, left, color = [], open_, 0
        while left:
            color += 1
            free = left
            while free:
                v = (free & -free).bit_length() - 1
                order.append((color, v))
                left &= ~(1 << v)
                free &= ~(1 << v) & ~near[v]
        if len(held) > max(least, len(best)):
            best = held
        later = []
        for color, v in reversed(order):
            if len(held) + color <= max(least, len(best)):
                break
            later.append(([*held, v], open_ & near[v]))
            open_ &= ~(1 << v)
        stack += reversed(later)
    return [ids[v] for v in best]


def max_clique(g: Graph, first: int = 64, grow: int = 16) -> DataFrame:
    """(id): a largest clique.

    Nodes are ordered by core number, then id, so that each has few later neighbours; a clique lies in its first node and that
    one's later neighbours. Each such set with the edges inside it (triangles) is one small task. Nodes go in waves by falling core
    number, each `grow` times as large as the one before, and those whose core number allows no clique larger than the best of
    earlier waves are never made into tasks. To the driver comes that best clique.
    """
    core = cut(core_numbers(g).select("id", F.col("core").cast("long").alias("core")))
    e = g.without_loops().edges.select("src", "dst").distinct()
    a, b = (core.select(F.col("id").alias(c), F.col("core").alias(f"k{c}")) for c in ("src", "dst"))
    up = F.struct("ksrc", "src") < F.struct("kdst", "dst")
    arcs = cut(e.join(a, "src").join(b, "dst").select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v")))
    spark, best = g.nodes.sparkSession, []
    lone = g.nodes.agg(F.min("id")).first()[0]
    edge = arcs.limit(1).collect()
    best = [edge[0].u, edge[0].v] if edge else [lone] if lone is not None else []
    out = arcs.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    todo, take = cut(core.join(out.withColumnRenamed("u", "id"), "id").select("id", F.least(F.col("core") + 1, F.col("n") + 1).alias("most"))), first
    while True:
        todo = todo.where(F.col("most") > len(best))
        wave = cut(todo.orderBy(F.desc("most"), "id").limit(take).select(F.col("id").alias("u")))
        if wave.isEmpty():
            break
        of = arcs.join(wave, "u", "left_semi")
        inside = of.join(arcs.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").join(of.select("u", F.col("v").alias("w")), ["u", "w"]).select("u", "v", "w")
        least = len(best) - 1

        def search(pdf: pd.DataFrame) -> pd.DataFrame:
            found = _largest(list(zip(pdf["v"].tolist(), pdf["w"].tolist(), strict=True)), least)
            return pd.DataFrame({"clique": [[int(pdf["u"].iloc[0]), *found]]}) if found else pd.DataFrame({"clique": pd.Series([], dtype=object)})

        got = inside.groupBy("u").applyInPandas(search, "clique array<long>").orderBy(F.desc(F.size("clique")), "clique").limit(1).collect()  # one clique
        best = got[0].clique if got else best
        todo = cut(todo.join(wave.select(F.col("u").alias("id")), "id", "left_anti"))
        take *= grow
    return spark.createDataFrame([(v,) for v in sorted(best)], "id long")
