"""Breadth-first search and shortest paths as frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.fixpoint import Rounds, cut


def bfs(g: Graph, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(source, id, dist, paths): hops from each source of sources (id) and the number of shortest paths. Unreached nodes have no row."""
    arcs = cut(g.both().select("src", "dst").distinct())
    front = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).cast("long").alias("dist"), F.lit(1.0).alias("paths")).distinct())
    seen, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(arcs.withColumnRenamed("src", "id"), "id").groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        front = cut(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(depth).cast("long").alias("dist"), "paths"))
        if front.isEmpty():
            break
        seen = cut(seen.union(front)) if depth % 8 == 0 else seen.union(front)
    return seen


def dijkstra(g: Graph, sources: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(source, id, dist): least total weight, weights not negative; only nodes whose distance fell send on."""
    arcs = cut(g.both().groupBy("src", "dst").agg(F.min("w").alias("w")))
    best = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist")).distinct())
    front = best
    for _ in range(rounds):
        found = front.join(arcs.withColumnRenamed("src", "id"), "id").groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("n"))
        both = cut(best.join(found, ["source", "id"], "full").select("source", "id", F.least("dist", "n").alias("dist"), (F.col("dist").isNull() | (F.col("n") < F.col("dist"))).alias("fell")))
        best, front = both.select("source", "id", "dist"), both.where("fell").select("source", "id", "dist")
        if front.isEmpty():
            return best
    raise RuntimeError("distances still fall; is a weight negative?")


class NearestNodes:
    """Nodes of one set of sources in the order of their distance, released on demand by buckets of width `delta`.

    A bucket is settled by relaxing its light arcs (no heavier than delta) until nothing in it changes; heavy arcs are
    relaxed once, when it is done, as they lead to later buckets only. Arcs of nodes in later buckets are not read until their
    bucket's turn. Weights are not negative; without delta the mean weight is taken.
    """

    def __init__(self, g: Graph, sources: DataFrame, delta: float | None = None):
        self.loop = Rounds(g.nodes.sparkSession, "nearest")
        self.arcs = self.loop.put("arcs", g.both().where("src <> dst").groupBy(F.col("src").alias("id"), "dst").agg(F.min("w").alias("w")))
        mean, least = self.arcs.agg(F.avg("w"), F.min("w")).first()
        if least is not None and least < 0:
            raise ValueError("weights are not negative")
        self.delta = delta or mean or 1.0
        self.tent = self.loop.put("tent", sources.select("id", F.lit(0.0).alias("dist"), F.lit(False).alias("done")).distinct())
        self.settled = 0

    def next_bucket(self, within: float | None = None) -> DataFrame | None:
        """(id, dist) of the nearest bucket not yet released, settled; none when all reachable nodes (nearer than within) are out."""
        low = self.tent.where("not done").agg(F.min("dist")).first()[0]
        if low is None or (within is not None and low >= within):
            return None
        end = (low // self.delta + 1) * self.delta
        inside = (F.col("dist") < end) & ~F.col("done")
        active = self.tent.where(inside).select("id", "dist")
        while True:
            moved = self._relax(active, self.arcs.where(F.col("w") <= self.delta))
            active = moved.where(F.col("fell") & (F.col("dist") < end)).select("id", "dist")
            if active.isEmpty():
                break
        bucket = self.tent.where(inside).select("id", "dist")
        self._relax(bucket, self.arcs.where(F.col("w") > self.delta))
        bucket = cut(self.tent.where(inside).select("id", "dist"))
        self.settled += bucket.count()
        self.tent = self.loop.put("tent", self.tent.select("id", "dist", (F.col("done") | (F.col("dist") < end)).alias("done")))
        return bucket

    def _relax(self, active: DataFrame, arcs: DataFrame) -> DataFrame:
        found = active.join(arcs, "id").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("n"))
        both = self.tent.join(found, "id", "full")
        new = self.loop.put("tent", both.select("id", F.least("dist", "n").alias("dist"), F.coalesce("done", F.lit(False)).alias("done"), F.coalesce(F.col("n") < F.col("dist"), F.col("dist").isNull()).alias("fell")))
        self.tent = new.drop("fell")
        return new

    def close(self) -> None:
        self.loop.close()


def nearest(g: Graph, sources: DataFrame, k: int, delta: float | None = None, within: float | None = None) -> DataFrame:
    """(id, dist): the first k nodes by (distance, id), only those nearer than within if that is given; buckets beyond them are never opened."""
    search, found = NearestNodes(g, sources, delta), None
    while search.settled < k and (bucket := search.next_bucket(within)) is not None:
        found = bucket if found is None else found.union(bucket)
    search.close()
    found = found if found is not None else sources.select("id", F.lit(0.0).alias("dist")).where("false")
    return (found if within is None else found.where(F.col("dist") < within)).orderBy("dist", "id").limit(k)


def predecessors(g: Graph, dist: DataFrame) -> DataFrame:
    """(source, id, pred): every neighbour that is last on some shortest path of dist."""
    a = dist.select("source", F.col("id").alias("src"), F.col("dist").alias("d"))
    b = dist.select("source", F.col("id").alias("dst"), F.col("dist").alias("e"))
    return a.join(g.both(), "src").join(b, ["source", "dst"]).where("abs(d + w - e) < 1e-9 and src <> dst").select("source", F.col("dst").alias("id"), F.col("src").alias("pred"))


def apsp(g: Graph) -> DataFrame:
    return dijkstra(g, g.nodes)


def bfs_tree(g: Graph, sources: DataFrame) -> DataFrame:
    """(source, src, dst): a tree edge to each reached node, from its least predecessor."""
    p = predecessors(g.unweighted(), bfs(g, sources))
    return p.groupBy("source", "id").agg(F.min("pred").alias("src")).select("source", "src", F.col("id").alias("dst"))


def bfs_sample(g: Graph, source: int, k: int) -> Graph:
    """The subgraph of the k nodes nearest to source, by (distance, id)."""
    start = g.nodes.where(F.col("id") == source)
    near = bfs(g, start).orderBy("dist", "id").limit(k)
    return g.subgraph(near.select("id"))


def relax_insertions(g: Graph, dist: DataFrame, added: DataFrame) -> DataFrame:
    """dist after the edges of added joined g (insertions and falls of weight only): only what they improve moves."""
    whole = Graph(g.nodes, g.edges.unionByName(Graph.from_edges(added, directed=g.directed).edges), g.directed)
    arcs = cut(whole.both().groupBy("src", "dst").agg(F.min("w").alias("w")))
    touched = added.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    best, front = cut(dist.select("source", "id", "dist")), dist.join(touched, "id", "left_semi").select("source", "id", "dist")
    while True:
        found = front.join(arcs.withColumnRenamed("src", "id"), "id").groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("n"))
        both = cut(best.join(found, ["source", "id"], "full").select("source", "id", F.least("dist", "n").alias("dist"), (F.col("dist").isNull() | (F.col("n") < F.col("dist"))).alias("fell")))
        best, front = both.select("source", "id", "dist"), both.where("fell").select("source", "id", "dist")
        if front.isEmpty():
            return best
