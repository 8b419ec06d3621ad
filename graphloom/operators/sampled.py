"""Betweenness from sampled shortest paths, with bounds on its error, and its update after insertions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.hashrand import uniform
from graphloom.graph import Graph, numbered
from graphloom.operators import tiled
from graphloom.operators.components import connected_components
from graphloom.operators.traversal import bfs
from graphloom.plans.fixpoint import cut


def vertex_diameter(g: Graph) -> int:
    """At most this many nodes lie on any shortest path: twice the greatest distance from the least node of a component, plus one, and never more than the component."""
    roots = connected_components(g).select(F.col("component").alias("id")).distinct()
    far = bfs(g.unweighted(), roots).groupBy("source").agg(F.max("dist").alias("d"), F.count(F.lit(1)).alias("n"))
    return int(far.agg(F.coalesce(F.max(F.least(2 * F.col("d") + 1, F.col("n"))), F.lit(1))).first()[0])


def sample_size(diameter: int, epsilon: float, delta: float, constant: float = 0.5) -> int:
    """Paths that bring every node within epsilon with probability 1 - delta, by the VC dimension of shortest paths."""
    return math.ceil(constant / epsilon**2 * (math.floor(math.log2(max(2, diameter - 2))) + 1 + math.log(1 / delta)))


def draw_pairs(g: Graph, samples: int, salt: int = 0) -> DataFrame:
    """(sample, u, v): independent pairs of different nodes; drawn by their places in the order of ids."""
    n = g.nodes.count()
    if n < 2:
        return g.nodes.select(F.lit(0).cast("long").alias("sample"), F.col("id").alias("u"), F.col("id").alias("v")).where("false")
    draws = g.nodes.sparkSession.range(samples).select(F.col("id").alias("sample"))
    draws = draws.withColumn("a", F.floor(uniform(f"from{salt}", "sample") * n).cast("long")).withColumn("b", F.floor(uniform(f"to{salt}", "sample") * (n - 1)).cast("long"))
    draws = draws.withColumn("b", F.col("b") + (F.col("b") >= F.col("a")).cast("long"))
    places = cut(numbered(g.nodes, ["id"], "at"))
    u, v = places.select(F.col("at").alias("a"), F.col("id").alias("u")), places.select(F.col("at").alias("b"), F.col("id").alias("v"))
    return draws.join(u, "a").join(v, "b").select("sample", "u", "v")


def draw_paths(g: Graph, pairs: DataFrame, salt: int = 0) -> DataFrame:
    """(sample, u, v, dist, inner): for each pair one of its shortest paths, all equally likely; inner nodes from v's side. dist is null where v is out of reach.

    One breadth-first search with path counts for each different u; then all samples walk back together, a step to each
    predecessor as likely as its share of the paths. A step's draw depends on the sample and the place alone.
    """
    reach = tiled.bfs(g, pairs.select(F.col("u").alias("id")).distinct())
    ends = pairs.join(reach.select(F.col("source").alias("u"), F.col("id").alias("v"), "dist"), ["u", "v"], "left")
    whole = cut(ends.select("sample", "u", "v", "dist", F.array().cast("array<bigint>").alias("inner")))
    arcs = cut(g.both().where("src <> dst").select(F.col("src").alias("z"), F.col("dst").alias("at")).distinct())
    walking = whole.where("dist > 1").select("sample", "u", "v", "dist", "inner", F.col("v").alias("at"), (F.col("dist") - 1).alias("d"))
    done = [whole.where("dist is null or dist <= 1")]
    while not walking.isEmpty():
        last = reach.select(F.col("source").alias("u"), F.col("id").alias("z"), F.col("dist").alias("d"), "paths")
        options = walking.join(arcs, "at").join(last, ["u", "z", "d"])
        # the greatest of log(U) / weight falls on each with a chance in proportion to its weight
        key = F.log(F.greatest(uniform(f"back{salt}", "sample", "at", "z"), F.lit(1e-12))) / F.col("paths")
        picked = options.groupBy("sample").agg(F.max_by(F.struct("u", "v", "dist", "inner", "z", "d"), F.struct(key.alias("k"), "z")).alias("p"))
        step = cut(picked.select("sample", "p.u", "p.v", "p.dist", F.concat("p.inner", F.array("p.z")).alias("inner"), F.col("p.z").alias("at"), (F.col("p.d") - 1).alias("d")))
        done.append(step.where("d = 0").select("sample", "u", "v", "dist", "inner"))
        walking = step.where("d > 0")
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return cut(out)


def scores(g: Graph, paths: DataFrame, samples: int) -> DataFrame:
    """(id, score): the share of the sampled paths that pass through each node, an estimate of betweenness over n (n - 1)."""
    hit = paths.select(F.explode("inner").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    return g.nodes.join(hit, "id", "left").select("id", (F.coalesce("c", F.lit(0)) / F.lit(float(samples))).alias("score"))


def approx_betweenness(g: Graph, epsilon: float = 0.05, delta: float = 0.1, salt: int = 0) -> DataFrame:
    """(id, score): with probability 1 - delta every score is within epsilon of the true one, betweenness over n (n - 1). The number of searches depends on epsilon, delta and the diameter, not on n."""
    k = sample_size(vertex_diameter(g), epsilon, delta)
    return scores(g, draw_paths(g, draw_pairs(g, k, salt), salt), k)


class DynamicBetweenness:
    """Sampled paths kept as state (sample, u, v, dist, inner), so that insertions redraw only what they touch.

    A pair's shortest paths change iff some inserted edge (a, b) lies on one that is no longer than before: searches
    from the inserted edges' ends, or from the pairs' ends where these are fewer, tell which, and only those pairs are searched and drawn again. The
    others would be drawn as they are. The sample size stays, as insertions don't make the diameter of a component grow
    unless they join components; where they do, `grow` draws the samples that the new diameter asks for.
    """

    def __init__(self, g: Graph, epsilon: float = 0.05, delta: float = 0.1, salt: int = 0):
        self.g, self.epsilon, self.delta, self.salt = g, epsilon, delta, salt
        self.samples = sample_size(vertex_diameter(g), epsilon, delta)
        self.paths = draw_paths(g, draw_pairs(g, self.samples, salt), salt)
        self.redrawn = 0

    def insert(self, added: DataFrame) -> None:
        """Edges (src, dst) between nodes of the graph; edges that it has already change nothing."""
        new = Graph.from_edges(added.select("src", "dst"), self.g.nodes).edges.where("src <> dst").distinct()
        new = cut(new.join(self.g.edges.select("src", "dst"), ["src", "dst"], "left_anti"))
        self.g = Graph(self.g.nodes, self.g.edges.select("src", "dst", "w").unionByName(new)).cut()
        # hops from the inserted edges' ends or, where these are more, from the pairs' ends: they are the same either way
        ends = cut(new.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
        mine = cut(self.paths.select(F.explode(F.array("u", "v")).alias("id")).distinct())
        here, there = ("source", "id") if ends.count() <= mine.count() else ("id", "source")
        near = tiled.bfs(self.g, ends if here == "source" else mine).select("source", "id", "dist")
        near = cut(near.select(F.col(here).alias("end"), F.col(there).alias("id"), "dist").join(ends.withColumnRenamed("id", "end"), "end", "left_semi"))
        # least way from each kept u to the inserted edges' ends, and on from the other end to v
        arcs = new.select("src", "dst").union(new.select("dst", "src"))
        pairs = self.paths.select("sample", "u", "v", F.col("dist").alias("was"))
        to = near.select(F.col("end").alias("src"), F.col("id").alias("u"), F.col("dist").alias("du"))
        on = near.select(F.col("end").alias("dst"), F.col("id").alias("v"), F.col("dist").alias("dv"))
        through = pairs.join(to, "u").join(arcs, "src").join(on, ["dst", "v"])
        touched = cut(through.where("was is null or du + 1 + dv <= was").select("sample", "u", "v").distinct())
        self.redrawn = touched.count()
        again = draw_paths(self.g, touched, self.salt)
        self.paths = cut(self.paths.join(touched.select("sample"), "sample", "left_anti").unionByName(again))

    def grow(self) -> None:
        """More samples where the diameter has grown."""
        k = sample_size(vertex_diameter(self.g), self.epsilon, self.delta)
        if k > self.samples:
            more = draw_pairs(self.g, k, self.salt).where(F.col("sample") >= self.samples)
            self.paths, self.samples = cut(self.paths.unionByName(draw_paths(self.g, more, self.salt))), k

    def scores(self) -> DataFrame:
        return scores(self.g, self.paths, self.samples)
