"""Edge scores for sparsification, and the sparsifiers made of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.hashrand import uniform
from graphloom.graph import Graph, cumulated, numbered
from graphloom.plans.fixpoint import cut
from graphloom.operators import triangles as tri


def threshold(g: Graph, scores: DataFrame, at: float, above: bool = True) -> Graph:
    """The edges that score at least (or at most) at; all nodes stay."""
    kept = scores.where(F.col("score") >= at if above else F.col("score") <= at)
    return Graph(g.nodes, g.edges.join(kept.select("src", "dst"), ["src", "dst"], "left_semi"), g.directed)


def to_size(g: Graph, scores: DataFrame, ratio: float, above: bool = True) -> Graph:
    """The ratio of the edges that score highest (or lowest), ties by (src, dst)."""
    k = round(scores.count() * ratio)
    kept = numbered(scores.select("src", "dst", "score"), [F.desc("score") if above else F.asc("score"), "src", "dst"], "at").where(F.col("at") < k)
    return Graph(g.nodes, g.edges.join(kept.select("src", "dst"), ["src", "dst"], "left_semi"), g.directed)


def _best_of_ends(sided: DataFrame) -> DataFrame:
    return sided.groupBy(F.least("ego", "alter").alias("src"), F.greatest("ego", "alter").alias("dst")).agg(F.max("value").alias("score"))


def _log_rank(rank: Column, degree: Column) -> Column:
    return F.when(degree == 1, 1.0).otherwise(1 - F.log(rank) / F.log(degree))


def local_filter(g: Graph, scores: DataFrame, logarithmic: bool = True) -> DataFrame:
    """Rank of each neighbour by score on a scale of 1 to 0, the better end counts; equal scores share a rank."""
    w = Window.partitionBy("ego")
    r = tri.sided(scores).select("ego", "alter", F.rank().over(w.orderBy(F.desc("score"))).alias("r"), F.count(F.lit(1)).over(w).alias("d"))
    value = _log_rank(F.col("r"), F.col("d")) if logarithmic else F.when(F.col("d") == 1, 1.0).otherwise(1 - (F.col("r") - 1) / (F.col("d") - 1))
    return _best_of_ends(r.select("ego", "alter", value.alias("value")))


def local_degree(g: Graph) -> DataFrame:
    """Like local_filter, each neighbour ranked by its degree."""
    d = g.degrees().select(F.col("id").alias("alter"), "deg")
    both = g.both().where("src <> dst").select(F.col("src").alias("ego"), F.col("dst").alias("alter")).join(d, "alter")
    w = Window.partitionBy("ego")
    r = both.select("ego", "alter", F.rank().over(w.orderBy(F.desc("deg"))).alias("r"), F.count(F.lit(1)).over(w).alias("d"))
    return _best_of_ends(r.select("ego", "alter", _log_rank(F.col("r"), F.col("d")).alias("value")))


def local_similarity(g: Graph) -> DataFrame:
    """Neighbours ranked by t / (du + dv - t), each with a rank of its own (ties by id)."""
    sim = tri.with_degrees(g, tri.triangle_scores(g)).select("src", "dst", (F.col("t") / (F.col("du") + F.col("dv") - F.col("t"))).alias("score"))
    w = Window.partitionBy("ego")
    r = tri.sided(sim).select("ego", "alter", F.row_number().over(w.orderBy(F.desc("score"), "alter")).alias("r"), F.count(F.lit(1)).over(w).alias("d"))
    return _best_of_ends(r.select("ego", "alter", _log_rank(F.col("r"), F.col("d")).alias("value")))


def multiscale(g: Graph) -> DataFrame:
    """The disparity filter: 1 - (1 - w / s)^(d - 1), the better end counts."""
    e = tri.with_degrees(g, g.edges)

    def side(s, d):
        return 1 - F.pow(1 - F.col("w") / F.col(s), F.col(d) - 1)

    return e.select("src", "dst", F.greatest(side("su", "du"), side("sv", "dv")).alias("score"))


def simmelian_overlap(g: Graph, scores: DataFrame, max_rank: int = 10) -> DataFrame:
    """How many of the ends' max_rank best neighbours they share."""
    top = tri.ranked_neighborhoods(g, scores).where(F.col("place") <= max_rank).select("ego", "alter")
    shared = g.edges.select("src", "dst").join(top.select(F.col("ego").alias("src"), "alter"), "src").join(top.select(F.col("ego").alias("dst"), "alter"), ["dst", "alter"])
    n = shared.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return g.edges.select("src", "dst").join(n, ["src", "dst"], "left").select("src", "dst", F.coalesce("n", F.lit(0)).cast("double").alias("score"))


def random_score(g: Graph, salt: int = 0) -> DataFrame:
    return g.edges.select("src", "dst", uniform(f"edge{salt}", "src", "dst").alias("score"))


def random_node_edge(g: Graph, ratio: float = 0.8, salt: int = 0) -> DataFrame:
    """Order of removal: with the ratio's chance by a draw for the edge, else by a draw for one of its ends."""
    end = F.when(uniform(f"end{salt}", "src", "dst") < 0.5, F.col("src")).otherwise(F.col("dst"))
    return g.edges.select("src", "dst", F.when(uniform(f"kind{salt}", "src", "dst") < ratio, uniform(f"edge{salt}", "src", "dst")).otherwise(uniform(f"node{salt}", end)).alias("score"))


def forest_fire(g: Graph, p: float = 0.4, burnt_ratio: float = 5.0, fires: int = 256, salt: int = 0) -> DataFrame:
    """How often each edge burns, scaled to a largest of 1. Fires start at drawn nodes and spread over each arc with chance p until they die; they count by waves of `fires`, up to the first wave by which burnt_ratio times m edges have burnt.

    Waves burn side by side: as many as the rate of those before asks for. What a wave burns depends on its fires' numbers alone, and
    waves past the last one that counts are left out, so the result is that of one wave after another.
    """
    arcs = cut(g.both().where("src <> dst").select("src", "dst"))
    m = arcs.count() / 2
    zero = g.edges.select("src", "dst", F.lit(0.0).alias("score"))
    if not m or p <= 0:
        return zero
    places, wave, total, hits = cut(numbered(arcs.select(F.col("src").alias("id")).distinct(), ["id"], "at")), 0, 0, None
    n, goal = places.count(), burnt_ratio * m
    while total < goal:
        more = max(1, math.ceil(wave * (goal - total) / total)) if total else max(1, wave)
        draws = g.nodes.sparkSession.range(wave * fires, (wave + more) * fires).select(F.col("id").alias("fire")).withColumn("at", F.floor(uniform(f"start{salt}", "fire") * n).cast("long"))
        front = cut(draws.join(places, "at").select("fire", "id"))
        burnt, edges = front, None
        while not front.isEmpty():
            lit = cut(front.join(arcs.withColumnRenamed("src", "id"), "id").where(uniform(f"burn{salt}", "fire", "id", "dst") < p).select("fire", F.col("id").alias("src"), "dst"))
            edges = lit if edges is None else edges.union(lit)
            front = cut(lit.select("fire", F.col("dst").alias("id")).distinct().join(burnt, ["fire", "id"], "left_anti"))
            burnt = cut(burnt.union(front))
        once = cut(edges.select("fire", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("wave", F.floor(F.col("fire") / fires)))
        upto = cut(cumulated(once.groupBy("wave").agg(F.count(F.lit(1)).alias("c")), ["wave"], "c", "upto"))
        last = upto.where(F.col("upto") + total >= goal).agg(F.min("wave")).first()[0]
        ends = (once if last is None else once.where(F.col("wave") <= last)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("count"))
        hits = cut(ends if hits is None else hits.union(ends).groupBy("src", "dst").agg(F.sum("count").alias("count")))
        total, wave = hits.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0], wave + more
    top = hits.agg(F.max("count").alias("top"))
    share = hits.join(F.broadcast(top)).select("src", "dst", (F.col("count") / F.col("top")).alias("score"))  # one row
    return zero.select("src", "dst").join(share, ["src", "dst"], "left").select("src", "dst", F.coalesce("score", F.lit(0.0)).alias("score"))


def _t(g: Graph) -> DataFrame:
    return tri.triangle_scores(g).select("src", "dst", F.col("t").cast("double").alias("score"))


def simmelian(g: Graph, at: float) -> Graph:
    return threshold(g, tri.prefix_jaccard(g, _t(g)), at)


def simmelian_parametric(g: Graph, max_rank: int, least: int) -> Graph:
    return threshold(g, simmelian_overlap(g, _t(g), max_rank), least)


def quadrilateral_simmelian(g: Graph, at: float) -> Graph:
    q = tri.quadrangle_scores(g).select("src", "dst", F.col("q").cast("double").alias("score"))
    return threshold(g, tri.prefix_jaccard(g, tri.geometric_mean(g, q)), at)


def simmelian_multiscale(g: Graph, at: float) -> Graph:
    weighted = tri.as_weight(g, cut(_t(g)))  # read for degrees and for edges
    return threshold(g, multiscale(weighted), at)


def degree_multiscale(g: Graph, at: float) -> Graph:
    """The disparity filter over the larger degree of the ends as weight."""
    d = tri.with_degrees(g, g.edges.select("src", "dst")).select("src", "dst", F.greatest("du", "dv").cast("double").alias("w"))
    return threshold(g, multiscale(Graph(g.nodes, d)), at)


def multiscale_sparsifier(g: Graph, at: float) -> Graph:
    return threshold(g, multiscale(g), at)


def local_similarity_sparsifier(g: Graph, at: float) -> Graph:
    return threshold(g, local_similarity(g), at)


def local_degree_sparsifier(g: Graph, at: float) -> Graph:
    return threshold(g, local_degree(g), at)


def scan_sparsifier(g: Graph, at: float) -> Graph:
    return threshold(g, tri.scan_similarity(g), at)


def jaccard_sparsifier(g: Graph, at: float) -> Graph:
    return threshold(g, tri.jaccard_distance(g), at, above=False)


def triangle_sparsifier(g: Graph, at: float) -> Graph:
    return threshold(g, _t(g), at)


def random_sparsifier(g: Graph, ratio: float, salt: int = 0) -> Graph:
    return threshold(g, random_score(g, salt), ratio)


def parameter_for(g: Graph, scores: DataFrame, ratio: float, above: bool = True) -> DataFrame:
    """One row: the threshold that keeps at least a share ratio of the edges and as few as possible, and how many it keeps.

    The threshold is a score itself, found by its exact rank: sizes fall with the threshold, so no search by trial is
    needed, and equal scores stay together. An edge without a score is never kept.
    """
    s = g.edges.select("src", "dst").join(scores, ["src", "dst"]).where("score is not null").select((F.col("score") * (-1 if above else 1)).alias("k"))
    m = g.edges.count()
    wanted = max(1, math.ceil(ratio * m - 1e-9))
    place = numbered(s, ["k"], "at").where(F.col("at") == wanted - 1).select("k")
    kept = s.join(F.broadcast(place.withColumnRenamed("k", "t"))).where("k <= t")  # one row
    return kept.agg((F.first("t") * (-1 if above else 1)).alias("parameter"), F.count(F.lit(1)).alias("edges"))
