"""Link prediction: indices of node pairs, selections and evaluation curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.hashrand import uniform
from graphloom.graph import Graph
from graphloom.plans.fixpoint import cut


def missing_links(g: Graph, k: int = 2) -> DataFrame:
    """(u, v), u < v: pairs at exactly distance k."""
    from graphloom.operators.traversal import bfs

    if k == 2:  # one join: neighbours of neighbours that are not adjacent
        o = g.both().where("src <> dst").select("src", "dst")
        two = o.select(F.col("src").alias("m"), F.col("dst").alias("u")).join(o.select(F.col("src").alias("m"), F.col("dst").alias("v")), "m").where("u < v").select("u", "v").distinct()
        return two.join(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_anti")
    return bfs(g, g.nodes, k).where((F.col("dist") == k) & (F.col("source") < F.col("id"))).select(F.col("source").alias("u"), F.col("id").alias("v"))


def _common(g: Graph, pairs: DataFrame) -> DataFrame:
    """(u, v, m): common neighbours of the pairs, from the shorter of the two ways round."""
    o = g.both().where("src <> dst").select("src", "dst")
    return pairs.select("u", "v").join(o.select(F.col("src").alias("u"), F.col("dst").alias("m")), "u").join(o.select(F.col("src").alias("v"), F.col("dst").alias("m")), ["v", "m"])


def features(g: Graph, pairs: DataFrame) -> DataFrame:
    """(u, v, du, dv, common, aa, ra): what the neighbourhood indices are made of, in one pass."""
    d = g.degrees().select("id", "deg")
    c = _common(g, pairs).join(d.select(F.col("id").alias("m"), F.col("deg").alias("dm")), "m").groupBy("u", "v").agg(F.count(F.lit(1)).alias("common"), F.sum(1 / F.log("dm")).alias("aa"), F.sum(1 / F.col("dm")).alias("ra"))
    p = pairs.select("u", "v").join(d.select(F.col("id").alias("u"), F.col("deg").alias("du")), "u").join(d.select(F.col("id").alias("v"), F.col("deg").alias("dv")), "v")
    zero = F.lit(0)
    return p.join(c, ["u", "v"], "left").select("u", "v", "du", "dv", F.coalesce("common", zero).alias("common"), F.coalesce("aa", F.lit(0.0)).alias("aa"), F.coalesce("ra", F.lit(0.0)).alias("ra"))


#: Index name -> SQL over the columns of features.
INDICES = {
    "common_neighbors": "cast(common as double)",
    "adamic_adar": "aa",
    "resource_allocation": "ra",
    "jaccard": "if(du + dv - common = 0, 0D, common / (du + dv - common))",
    "preferential_attachment": "cast(du * dv as double)",
    "neighborhood_distance": "if(du * dv = 0, null, common / sqrt(du * dv))",
    "total_neighbors": "cast(du + dv - common as double)",
    "u_degree": "cast(du as double)",
    "v_degree": "cast(dv as double)",
}


def predict(g: Graph, pairs: DataFrame, index: str) -> DataFrame:
    """(u, v, score)."""
    return features(g, pairs).select("u", "v", F.expr(INDICES[index]).alias("score"))


def neighbors_measure(g: Graph, pairs: DataFrame) -> DataFrame:
    """Pairs (x, y) of a neighbour of either that are one node or adjacent."""
    o = cut(g.both().where("src <> dst").select("src", "dst"))
    reach = o.union(g.nodes.select("id", F.col("id")))
    xs = pairs.select("u", "v").join(o.select(F.col("src").alias("u"), F.col("dst").alias("x")), "u")
    ys = xs.join(reach.select(F.col("src").alias("x"), F.col("dst").alias("y")), "x").join(o.select(F.col("src").alias("v"), F.col("dst").alias("y")), ["v", "y"])
    n = ys.groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return pairs.select("u", "v").join(n, ["u", "v"], "left").select("u", "v", F.coalesce("n", F.lit(0.0)).alias("score"))


def adjusted_rand(g: Graph, pairs: DataFrame) -> DataFrame:
    """2 (ad - bc) / ((a + b)(b + d) + (a + c)(c + d)) with a common neighbours, b = c = the size of the union, d the rest; both differences are taken as unions."""
    n = g.nodes.count()
    f = features(g, pairs).select("u", "v", F.col("common").cast("double").alias("a"), (F.col("du") + F.col("dv") - F.col("common")).cast("double").alias("b"))
    d = n - F.col("a") - 2 * F.col("b")
    a, b = F.col("a"), F.col("b")
    den = (a + b) * (b + d) + (a + b) * (b + d)
    return f.select("u", "v", F.when(den == 0, 0.0).otherwise(2 * (a * d - b * b) / den).alias("score"))


def katz_index(g: Graph, pairs: DataFrame, longest: int = 5, damping: float = 0.005) -> DataFrame:
    """Sum over lengths l of damping^l times the hits of v in the l-th frontier from the end of lower degree; a frontier holds every node once."""
    d = g.degrees().select("id", "deg")
    o = cut(g.both().where("src <> dst").select("src", "dst"))
    p = pairs.select("u", "v").join(d.select(F.col("id").alias("u"), F.col("deg").alias("du")), "u").join(d.select(F.col("id").alias("v"), F.col("deg").alias("dv")), "v")
    p = cut(p.select("u", "v", F.when(F.col("du") <= F.col("dv"), F.col("u")).otherwise(F.col("v")).alias("s"), F.when(F.col("du") <= F.col("dv"), F.col("v")).otherwise(F.col("u")).alias("t")))
    front = p.select("s", F.col("s").alias("at")).distinct()
    total = p.select("u", "v", F.lit(0.0).alias("score"))
    for length in range(1, longest + 1):
        hits = front.join(o.withColumnRenamed("src", "at"), "at").groupBy("s", F.col("dst").alias("at")).agg(F.count(F.lit(1)).alias("k"))
        hits = cut(hits)
        got = p.join(hits.withColumnRenamed("at", "t"), ["s", "t"]).select("u", "v", (F.col("k") * damping**length).alias("score"))
        total = total.union(got)
        front = hits.select("s", "at")
    return total.groupBy("u", "v").agg(F.sum("score").alias("score"))


def same_community(g: Graph, pairs: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    from graphloom.operators.community import louvain

    c = louvain(g) if parts is None else parts
    return pairs.select("u", "v").join(c.select(F.col("id").alias("u"), F.col("subset").alias("a")), "u").join(c.select(F.col("id").alias("v"), F.col("subset").alias("b")), "v").select("u", "v", F.expr("cast(a = b as double)").alias("score"))


def algebraic_index(g: Graph, pairs: DataFrame, **how) -> DataFrame:
    from graphloom.operators.distance import algebraic_distance

    return algebraic_distance(g, pairs=pairs.select(F.col("u").alias("src"), F.col("v").alias("dst")), **how).select(F.col("src").alias("u"), F.col("dst").alias("v"), "score")


# -- selections of predictions (u, v, score)


def by_score(p: DataFrame, least: float) -> DataFrame:
    return p.where(F.col("score") >= least).select("u", "v")


def by_count(p: DataFrame, n: int) -> DataFrame:
    return p.orderBy(F.desc("score"), "u", "v").limit(n).select("u", "v")


def by_percentage(p: DataFrame, share: float) -> DataFrame:
    return by_count(p, int(p.count() * share))


def training_graph(g: Graph, share: float, salt: int = 0) -> Graph:
    """The share of the edges that a draw puts first."""
    return Graph(g.nodes, g.random_edges(int(g.edges.count() * share), salt), g.directed)


# -- evaluation


def _grid(p: DataFrame, truth: DataFrame, points: int) -> DataFrame:
    """(i, tp, fp, pos, neg): at points thresholds over the predictions by falling score, ties by pair."""
    from graphloom.graph import numbered

    hit = truth.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).alias("hit"))
    ranked = numbered(p.join(hit, ["u", "v"], "left").select((-F.col("score")).alias("down"), "u", "v", F.coalesce("hit", F.lit(0)).alias("hit")), ["down", "u", "v"], "r")
    size = ranked.count()
    # a prediction belongs to every threshold past its rank: count it at its first one, then add up
    cuts = [-(-size * i // (points - 1)) for i in range(points)]
    first = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("r")))
    per = ranked.groupBy(first.alias("i")).agg(F.sum("hit").alias("h"), F.count(F.lit(1)).alias("k"))
    grid = p.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    w = Window.orderBy("i")  # a row for each threshold
    run = grid.join(per, "i", "left").select("i", F.sum(F.coalesce("h", F.lit(0))).over(w).alias("tp"), F.sum(F.coalesce("k", F.lit(0))).over(w).alias("k"))
    total = ranked.agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    return run.join(F.broadcast(total)).select("i", "tp", (F.col("k") - F.col("tp")).alias("fp"), "pos", "neg")  # one row


def _share(part: str, whole: str) -> Column:
    """NaN where there is nothing to share, like 0 / 0 of doubles."""
    return F.when(F.col(whole) == 0, F.lit(float("nan"))).otherwise(F.col(part) / F.col(whole))


def roc(p: DataFrame, truth: DataFrame, points: int = 1000) -> DataFrame:
    """(x, y): false against true positive rate; the last y of equal x."""
    g = _grid(p, truth, points).select("i", _share("fp", "neg").alias("x"), _share("tp", "pos").alias("y"))
    return g.groupBy("x").agg(F.max_by("y", "i").alias("y"))


def precision_recall(p: DataFrame, truth: DataFrame, points: int = 1000) -> DataFrame:
    """(x, y): recall against precision (1 without predictions); the last y of equal x."""
    n = F.col("tp") + F.col("fp")
    g = _grid(p, truth, points).select("i", _share("tp", "pos").alias("x"), F.when(n == 0, 1.0).otherwise(F.col("tp") / n).alias("y"))
    return g.groupBy("x").agg(F.max_by("y", "i").alias("y"))


def area(curve: DataFrame) -> DataFrame:
    """One row: the area under the curve by trapezoids."""
    w = Window.orderBy("x")  # a row for each point
    s = curve.select(((F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2).alias("a"))
    return s.agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("auc"))


def random_links(g: Graph, n: int, salt: int = 0) -> DataFrame:
    """n pairs of nodes without an edge, by draws of both ends."""
    from graphloom.graph import numbered

    ids = cut(numbered(g.nodes, ["id"], "r"))
    size = ids.count()
    draws = g.nodes.sparkSession.range(4 * n).select("id", F.floor(uniform(f"a{salt}", "id") * size).alias("a"), F.floor(uniform(f"b{salt}", "id") * size).alias("b"))
    ends = draws.join(ids.select(F.col("r").alias("a"), F.col("id").alias("p")), "a").join(ids.select(F.col("r").alias("b"), F.col("id").alias("q")), "b").where("p <> q")
    pairs = ends.groupBy(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).agg(F.min("id").alias("o"))
    return pairs.join(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_anti").orderBy("o").limit(n).select("u", "v")
