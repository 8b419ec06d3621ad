"""Community detection, partitions and covers, their quality and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.hashrand import uniform
from graphloom.graph import Graph
from graphloom.plans import fixpoint
from graphloom.plans.fixpoint import Rounds, cut

# -- detection


def label_propagation(g: Graph, rounds: int = 200, theta: float = 0.0, weighted: bool = True) -> DataFrame:
    """(id, subset): every node takes the heaviest label around it, the smallest of equals; half of the nodes, by a draw, move in a round. It ends when no more than a share theta of the nodes would move: by default none."""
    arcs = cut(g.both().where("src <> dst").select("src", "dst", F.col("w") if weighted else F.lit(1.0).alias("w")))
    x = cut(g.nodes.select("id", F.col("id").alias("subset")))
    least = theta * g.nodes.count()
    for i in range(rounds):
        heard = arcs.join(x.select(F.col("id").alias("dst"), "subset"), "dst").groupBy("src", "subset").agg(F.sum("w").alias("s"))
        best = heard.groupBy(F.col("src").alias("id")).agg(F.max_by("subset", F.struct("s", -F.col("subset"))).alias("b"), F.max("s").alias("top"))
        own = heard.select(F.col("src").alias("id"), "subset", F.col("s").alias("own"))
        moves = (F.col("b") != F.col("subset")) & (F.col("top") > F.coalesce("own", F.lit(0.0))) & (uniform(f"lp{i}", "id") < 0.5)
        new = cut(x.join(best, "id", "left").join(own, ["id", "subset"], "left").select("id", F.when(moves, F.col("b")).otherwise(F.col("subset")).alias("subset"), F.coalesce(moves, F.lit(False)).alias("moved"), F.coalesce((F.col("b") != F.col("subset")) & (F.col("top") > F.coalesce("own", F.lit(0.0))), F.lit(False)).alias("wants")))
        x = new.select("id", "subset")
        if new.where("wants").limit(int(least) + 1).count() <= least:
            return x
    raise RuntimeError(f"labels still move after {rounds} rounds")


def degree_ordered_propagation(g: Graph, least: float = 1e-5) -> DataFrame:
    """(id, subset): label propagation where nodes move one after another by rising degree.

    Nodes of one degree class (powers of two) and one colour of a proper colouring don't see each other, so they move in one plan, and the
    classes go in order: each node takes the commonest label around it, as the nodes before it have left it; the smallest of
    equals, its own first. Since a move makes more edges agree, it ends by itself: when at most a share `least` of the nodes moved.
    """
    from graphloom.operators.coloring import greedy_coloring

    loop = Rounds(g.nodes.sparkSession, "ordered")
    arcs = loop.put("arcs", g.without_loops().both().select("src", "dst").distinct())
    deg = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    order = deg.join(greedy_coloring(g), "id").select("id", F.floor(F.log2("deg")).cast("int").alias("class"), "color")
    x = loop.put("x", g.nodes.select("id", F.col("id").alias("subset")).join(order, "id", "left"))
    turns = [(r["class"], r.color) for r in x.where("class is not null").select("class", "color").distinct().orderBy("class", "color").collect()]  # classes times colours
    n = g.nodes.count()
    while True:
        moved = 0
        for c, k in turns:
            mine = x.where((F.col("class") == c) & (F.col("color") == k)).select(F.col("id").alias("src"), F.col("subset").alias("own"))
            heard = mine.join(arcs, "src").join(x.select(F.col("id").alias("dst"), "subset"), "dst").groupBy("src", "own", "subset").agg(F.count(F.lit(1)).alias("s"))
            best = heard.groupBy(F.col("src").alias("id")).agg(F.max_by("subset", F.struct("s", (F.col("subset") == F.col("own")).cast("int"), -F.col("subset"))).alias("b"))
            new = loop.put("x", x.join(best, "id", "left").select("id", F.coalesce("b", "subset").alias("subset"), "class", "color", (F.col("b") != F.col("subset")).alias("moved")))
            moved += new.where("moved").count()
            x = new.drop("moved")
        if moved <= least * n:
            break
    out = cut(x.select("id", "subset"))
    loop.close()
    return out


#: Rounds in a row without a rise after which a level of Louvain gives up.
PATIENCE = 32


def louvain(g: Graph, gamma: float = 1.0, least: float = 0.002, history: list | None = None) -> DataFrame:
    """(id, subset): moves by modularity gain, then contraction, until a level no longer raises modularity.

    All nodes choose at once, and a draw lets half of those that want to move do so. A level that has raised modularity ends when
    no more than a share `least` of its nodes want to move, or when twice in a row a round raised it by less than `least`; it hands
    on the best partition that it saw. A level that has not raised it yet goes on while any node wants to move, at most PATIENCE
    tired rounds with draws that let ever fewer move, since two that trade places gain nothing. So modularity never falls from
    level to level (history receives its values), and the last level leaves no node that would gain. Subsets are named by their
    smallest node.

    Each round is one plan: the arcs, their ends' subsets, and the subsets' volumes. Only sums come to the driver.
    """
    total = g.edges.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return g.nodes.select("id", F.col("id").alias("subset"))
    loop = Rounds(g.nodes.sparkSession, "louvain")
    edges = loop.put("edges", g.edges.groupBy("src", "dst").agg(F.sum("w").alias("w")))
    nodes = g.nodes
    members = loop.put("members", g.nodes.select("id", F.col("id").alias("subset")))
    best_q, at = None, 0
    while True:
        level = Graph(nodes, edges)
        inner = edges.where("src = dst").select(F.col("src").alias("id"), F.col("w").alias("loop"))
        vol = level.degrees().select("id", "vol").join(inner, "id", "left").select("id", "vol", F.coalesce("loop", F.lit(0.0)).alias("loop"))
        arcs = loop.put("arcs", level.both().where("src <> dst"))
        x, x_at = loop.put("x0", vol.select("id", F.col("id").alias("subset"), "vol", "loop")), "x0"
        start_q, x_q, x_best, best_at, tired, i = None, None, x, x_at, 0, 0
        while True:
            sums = x.groupBy("subset").agg(F.sum("vol").alias("sv"))
            # rounds are many, so no table goes to all tasks
            seen = x.hint("merge").join(sums, "subset")
            aff = arcs.hint("merge").join(seen.select(F.col("id").alias("dst"), "subset", "sv"), "dst").groupBy(F.col("src").alias("id"), "subset").agg(F.sum("w").alias("a"), F.first("sv").alias("sv"))
            cand = seen.withColumnsRenamed({"subset": "own", "sv": "own_sv"}).hint("merge").join(aff, "id", "left")
            # the own subset without the node itself
            mine = F.col("subset") == F.col("own")
            gain = F.col("a") / total - gamma * (F.col("sv") - F.when(mine, F.col("vol")).otherwise(0.0)) * F.col("vol") / (2 * total * total)
            choice = cand.withColumn("g", gain).groupBy("id", "own", "own_sv", "vol", "loop").agg(F.max_by("subset", F.struct("g", -F.col("subset"))).alias("b"), F.max("g").alias("g"), F.max(F.when(mine, F.col("g"))).alias("stay"), F.coalesce(F.sum(F.when(mine, F.col("a"))), F.lit(0.0)).alias("held"))
            stay = F.coalesce("stay", -gamma * (F.col("own_sv") - F.col("vol")) * F.col("vol") / (2 * total * total))
            wants = F.coalesce((F.col("b") != F.col("own")) & (F.col("g") > stay + 1e-12), F.lit(False))
            chance = 0.5 if tired < 2 else 0.5 ** (1 + tired % 8)
            moves = wants & (uniform(f"louvain{at}:{i}", "id") < chance)
            # a node's share of the modularity of the partition that the round began with
            part = (F.col("held") / 2 + F.col("loop")) / total - gamma * F.col("vol") * F.col("own_sv") / (4 * total * total)
            new = loop.put(f"x{i + 1}", choice.select("id", F.when(moves, F.col("b")).otherwise(F.col("own")).alias("subset"), "vol", "loop", wants.alias("wants"), part.alias("part")))
            n, wanting, q = new.agg(F.count(F.lit(1)), F.count_if("wants"), F.sum("part")).first()
            if start_q is None:
                start_q = q
            tired = 0 if x_q is None or q > x_q + least else tired + 1
            if x_q is None or q > x_q:
                x_q, x_best, best_at = q, x, x_at
            risen = x_q > (start_q if best_q is None else best_q) + 1e-9
            if not wanting or tired == PATIENCE or (risen and (tired >= 2 or (i and wanting <= least * n))):
                break
            if x_at != best_at:
                loop.drop(x_at)
            x, x_at, i = new.select("id", "subset", "vol", "loop"), f"x{i + 1}", i + 1
        best_q = start_q if best_q is None else best_q
        if history is not None and not history:
            history.append(start_q)
        if x_q <= best_q + 1e-9:
            break
        best_q = x_q
        if history is not None:
            history.append(best_q)
        named = x_best.groupBy("subset").agg(F.min("id").alias("name"))
        parts = loop.put("parts", x_best.join(named, "subset").select("id", F.col("name").alias("subset")))
        members = loop.put("members", members.join(parts.select(F.col("id").alias("subset"), F.col("subset").alias("s")), "subset").select("id", F.col("s").alias("subset")))
        edges = loop.put("edges", level.contract(parts).edges)
        loop.drop(*[name for name in loop.versions if name.startswith("x")])
        nodes = loop.put("nodes", parts.select(F.col("subset").alias("id")).distinct())
        at += 1
    members = cut(members)
    loop.close()
    return members


def agglomerate(g: Graph, least: float = 5e-3) -> DataFrame:
    """Communities by repeated contraction of a matching on the edges whose merger gains modularity most."""
    from graphloom.operators.matching import local_max

    total = g.edges.agg(F.sum("w")).first()[0] or 0.0
    level = Graph(g.nodes, g.edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))).cut()
    members = cut(g.nodes.select("id", F.col("id").alias("subset")))
    while True:
        n = level.nodes.count()
        v = level.degrees().select("id", "vol")
        s = level.without_loops().edges.join(v.select(F.col("id").alias("src"), F.col("vol").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("vol").alias("b")), "dst")
        s = s.select("src", "dst", (F.col("w") / total - F.col("a") * F.col("b") / (2 * total * total)).alias("w")).where("w > 0")
        pairs = local_max(Graph(level.nodes, s))
        parts = level.nodes.join(pairs.select(F.col("dst").alias("id"), F.col("src").alias("s")), "id", "left").select("id", F.coalesce("s", "id").alias("subset"))
        parts = cut(parts)
        level = level.contract(parts).cut()
        members = cut(members.join(parts.select(F.col("id").alias("subset"), F.col("subset").alias("s")), "subset").select("id", F.col("s").alias("subset")))
        if n - level.nodes.count() < least * n or level.nodes.count() < 2:
            break
    return members


def kcore_communities(g: Graph, k: int) -> DataFrame:
    """Louvain on the k-core; other nodes have a null subset."""
    from graphloom.operators.centrality import core_numbers

    core = core_numbers(g).where(F.col("core") >= k).select("id")
    return g.nodes.join(louvain(g.subgraph(core)), "id", "left")


# -- partitions


def singletons(g: Graph) -> DataFrame:
    return g.nodes.select("id", F.col("id").alias("subset"))


def one(g: Graph) -> DataFrame:
    return g.nodes.select("id", F.lit(0).cast("long").alias("subset"))


def random_partition(g: Graph, k: int, salt: int = 0) -> DataFrame:
    return g.nodes.select("id", F.floor(uniform(f"part{salt}", "id") * k).alias("subset"))


def balanced(g: Graph, k: int) -> DataFrame:
    """k runs of consecutive ids of equal size, up to one node."""
    from graphloom.graph import numbered

    n = g.nodes.count()
    return numbered(g.nodes, ["id"], "r").select("id", F.floor(F.col("r") * k / n).alias("subset"))


def canonical(parts: DataFrame) -> DataFrame:
    """Subsets named by their smallest node."""
    names = parts.where("subset is not null").groupBy("subset").agg(F.min("id").alias("name"))
    return parts.join(names, "subset", "left").select("id", F.col("name").alias("subset"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """The coarsest common refinement, subsets named by their smallest node."""
    both = a.join(b.withColumnRenamed("subset", "other"), "id")
    names = both.groupBy("subset", "other").agg(F.min("id").alias("name"))
    return both.join(names, ["subset", "other"]).select("id", F.col("name").alias("subset"))


def merge_subsets(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Subsets that pairs (a, b) connect become one, named by the least of them."""
    c = fixpoint.components(pairs, "a", "b")
    return parts.join(c.select(F.col("id").alias("subset"), "component"), "subset", "left").select("id", F.coalesce("component", "subset").alias("subset"))


def subset_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("subset").agg(F.count(F.lit(1)).alias("size"))


def imbalance(parts: DataFrame) -> DataFrame:
    """One row: the largest subset over the mean size rounded up."""
    s = subset_sizes(parts)
    return s.agg((F.max("size") / F.ceil(F.sum("size") / F.count(F.lit(1)))).alias("imbalance"))


# -- quality


def _labelled(g: Graph, parts: DataFrame) -> DataFrame:
    a, b = (parts.select(F.col("id").alias(c), F.col("subset").alias(v)) for c, v in (("src", "p"), ("dst", "q")))
    return g.edges.join(a, "src").join(b, "dst").select("src", "dst", "w", "p", "q")


def modularity(g: Graph, parts: DataFrame, gamma: float = 1.0) -> DataFrame:
    e = _labelled(g, parts)
    inner = e.agg(F.sum(F.when(F.col("p") == F.col("q"), F.col("w")).otherwise(0.0)).alias("i"), F.sum("w").alias("total"))
    vol = e.select(F.explode(F.array("p", "q")).alias("s"), "w").groupBy("s").agg(F.sum("w").alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("vv"))
    return inner.join(vol).select((F.col("i") / F.col("total") - gamma * F.col("vv") / (4 * F.col("total") * F.col("total"))).alias("modularity"))


def coverage(g: Graph, parts: DataFrame) -> DataFrame:
    return _labelled(g, parts).agg((F.sum(F.when(F.col("p") == F.col("q"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("coverage"))


def edge_cut(g: Graph, parts: DataFrame) -> DataFrame:
    return _labelled(g, parts).agg(F.coalesce(F.sum(F.when(F.col("p") != F.col("q"), F.col("w"))), F.lit(0.0)).alias("cut"))


def subset_stats(g: Graph, parts: DataFrame) -> DataFrame:
    """(subset, size, inner, inner_edges, cut, vol): counts that the local measures share."""
    e = _labelled(g, parts)
    side = e.select(F.explode(F.array(F.struct(F.col("p").alias("subset"), F.col("q").alias("other")), F.struct(F.col("q").alias("subset"), F.col("p").alias("other")))).alias("s"), "w").select("s.*", "w")
    s = side.groupBy("subset").agg((F.sum(F.when(F.col("subset") == F.col("other"), F.col("w")).otherwise(0.0)) / 2).alias("inner"), (F.sum(F.when(F.col("subset") == F.col("other"), 1).otherwise(0)) / 2).cast("long").alias("inner_edges"), F.sum(F.when(F.col("subset") != F.col("other"), F.col("w")).otherwise(0.0)).alias("cut"), F.sum("w").alias("vol"))
    zero = F.lit(0)
    return subset_sizes(parts).join(s, "subset", "left").select("subset", "size", *[F.coalesce(c, zero).alias(c) for c in ("inner", "inner_edges", "cut", "vol")])


def isolated_conductance(g: Graph, parts: DataFrame) -> DataFrame:
    """(subset, size, value): cut over the smaller of the volume and the rest's."""
    total = g.edges.agg((2 * F.sum("w")).alias("total"))
    low = F.least(F.col("vol"), F.col("total") - F.col("vol"))
    return subset_stats(g, parts).join(F.broadcast(total)).select("subset", "size", F.when(low > 0, F.col("cut") / low).otherwise(0.0).alias("value"))  # one row


def conductance(g: Graph, parts: DataFrame) -> DataFrame:
    """One row, for two subsets: cut over the smaller volume."""
    s = subset_stats(g, parts)
    return s.agg(F.max("cut").alias("c"), F.min("vol").alias("v")).select((F.col("c") / F.col("v")).alias("conductance"))


def isolated_expansion(g: Graph, parts: DataFrame) -> DataFrame:
    n = g.nodes.agg(F.count(F.lit(1)).alias("n"))
    low = F.least(F.col("size"), F.col("n") - F.col("size"))
    return subset_stats(g, parts).join(F.broadcast(n)).select("subset", "size", F.when(low > 0, F.col("cut") / low).otherwise(0.0).alias("value"))  # one row


def density(g: Graph, parts: DataFrame) -> DataFrame:
    """(subset, size, value): inner edges over possible ones; 1 without pairs."""
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return subset_stats(g, parts).select("subset", "size", F.when(pairs > 0, F.col("inner_edges") / pairs).otherwise(1.0).alias("value"))


def hub_dominance(g: Graph, parts: DataFrame) -> DataFrame:
    """(subset, size, value): largest inner degree over size - 1; 1 for single nodes."""
    e = _labelled(g, parts).where("p = q and src <> dst").select("p", F.explode(F.array("src", "dst")).alias("id"))
    top = e.groupBy("p", "id").agg(F.count(F.lit(1)).alias("k")).groupBy(F.col("p").alias("subset")).agg(F.max("k").alias("k"))
    return subset_sizes(parts).join(top, "subset", "left").select("subset", "size", F.when(F.col("size") > 1, F.coalesce("k", F.lit(0)) / (F.col("size") - 1)).otherwise(1.0).alias("value"))


def cover_hub_dominance(g: Graph, cover: DataFrame) -> DataFrame:
    """The same over a cover, whose subsets may overlap."""
    a, b = cover.select(F.col("id").alias("src"), "subset"), cover.select(F.col("id").alias("dst"), "subset")
    e = g.edges.where("src <> dst").join(a, "src").join(b, ["dst", "subset"]).select("subset", F.explode(F.array("src", "dst")).alias("id"))
    top = e.groupBy("subset", "id").agg(F.count(F.lit(1)).alias("k")).groupBy("subset").agg(F.max("k").alias("k"))
    return subset_sizes(cover).join(top, "subset", "left").select("subset", "size", F.when(F.col("size") > 1, F.coalesce("k", F.lit(0)) / (F.col("size") - 1)).otherwise(1.0).alias("value"))


def fragmentation(g: Graph, parts: DataFrame) -> DataFrame:
    """(subset, size, value): 1 - the largest piece's share, pieces being the subset's cuts by components of the whole graph."""
    from graphloom.operators.components import connected_components

    pieces = parts.join(connected_components(g), "id").groupBy("subset", "component").agg(F.count(F.lit(1)).alias("k"))
    return pieces.groupBy("subset").agg(F.sum("k").alias("size"), (1 - F.max("k") / F.sum("k")).alias("value"))


def stable_nodes(g: Graph, parts: DataFrame) -> DataFrame:
    """(id, stable): whether the own subset's weight, in whole numbers, is strictly the greatest; isolated nodes are."""
    e = g.both().where("src <> dst").join(parts.select(F.col("id").alias("src"), F.col("subset").alias("p")), "src").join(parts.select(F.col("id").alias("dst"), F.col("subset").alias("q")), "dst")
    per = e.groupBy("src", "p", "q").agg(F.sum(F.floor("w")).alias("s"))
    own = per.groupBy(F.col("src").alias("id")).agg(F.max(F.when(F.col("p") == F.col("q"), F.col("s")).otherwise(0)).alias("a"), F.max(F.when(F.col("p") != F.col("q"), F.col("s")).otherwise(0)).alias("b"))
    return g.nodes.join(own, "id", "left").select("id", F.coalesce(F.col("a") > F.col("b"), F.lit(True)).alias("stable"))


def averaged(local: DataFrame) -> DataFrame:
    """One row: weighted and unweighted mean, least and greatest of a local measure."""
    return local.agg((F.sum(F.col("value") * F.col("size")) / F.sum("size")).alias("weighted"), F.avg("value").alias("unweighted"), F.min("value").alias("least"), F.max("value").alias("greatest"))


# -- comparison


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n and the pairs together in a, in b, in both."""
    both = cut(a.join(b.withColumnRenamed("subset", "other"), "id").groupBy("subset", "other").agg(F.count(F.lit(1)).alias("k")))

    def choose(df):
        return df.agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0.0)).alias("s"))

    sa = choose(both.groupBy("subset").agg(F.sum("k").alias("k"))).withColumnRenamed("s", "sa")
    sb = choose(both.groupBy("other").agg(F.sum("k").alias("k"))).withColumnRenamed("s", "sb")
    s11 = choose(both).withColumnRenamed("s", "s11")
    return both.agg(F.sum("k").alias("n")).join(sa).join(sb).join(s11).withColumn("c", F.col("n") * (F.col("n") - 1) / 2)  # one row each


def rand_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    agree = F.col("c") + 2 * F.col("s11") - F.col("sa") - F.col("sb")
    return _pairs(a, b).select((1 - agree / F.col("c")).alias("distance"))


def jaccard_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    s00 = F.col("c") + F.col("s11") - F.col("sa") - F.col("sb")
    return _pairs(a, b).select((1 - F.when(F.col("c") > s00, F.col("s11") / (F.col("c") - s00)).otherwise(1.0)).alias("distance"))


def adjusted_rand_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """1 - ARI, with the expectation rounded down to whole pairs; 0 where the largest value is the expected one."""
    expected = F.floor(F.col("sa") * F.col("sb") / F.col("c"))
    top = (F.col("sa") + F.col("sb")) / 2
    return _pairs(a, b).select(F.when(top == expected, 0.0).otherwise(1 - (F.col("s11") - expected) / (top - expected)).alias("distance"))


def sampled_node_rand(g: Graph, a: DataFrame, b: DataFrame, samples: int, salt: int = 0) -> DataFrame:
    """One row: the Rand distance over drawn pairs of nodes instead of all."""
    from graphloom.operators.sampled import draw_pairs

    return _agreement(draw_pairs(g, samples, salt), a, b)


def sampled_graph_rand(g: Graph, a: DataFrame, b: DataFrame, samples: int, salt: int = 0) -> DataFrame:
    """One row: the Rand distance over drawn edges: a node that has any, then one of its neighbours, all equally likely."""
    from graphloom.graph import numbered

    arcs = cut(g.without_loops().both().select("src", "dst").distinct())
    ids = cut(numbered(arcs.select(F.col("src").alias("u")).distinct(), ["u"], "at"))
    draws = g.nodes.sparkSession.range(samples).select(F.col("id").alias("sample"), F.floor(uniform(f"edge-node{salt}", "id") * ids.count()).cast("long").alias("at"))
    drawn = draws.join(ids, "at").join(arcs.withColumnsRenamed({"src": "u", "dst": "v"}), "u")
    return _agreement(drawn.groupBy("sample", "u").agg(F.min_by("v", F.struct(uniform(f"edge-end{salt}", "sample", "v").alias("k"), "v")).alias("v")), a, b)


def _agreement(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("id", "subset").join(b.select("id", F.col("subset").alias("other")), "id")
    for c in ("u", "v"):
        pairs = pairs.join(both.select(F.col("id").alias(c), F.col("subset").alias(f"a{c}"), F.col("other").alias(f"b{c}")), c)
    agree = (F.col("au") == F.col("av")) == (F.col("bu") == F.col("bv"))
    return pairs.agg((1 - F.count_if(agree) / F.count(F.lit(1))).alias("distance"))


def graph_rand_distance(g: Graph, a: DataFrame, b: DataFrame, ratio: float = 1.0, salt: int = 0) -> DataFrame:
    """Share of adjacent pairs that the partitions treat differently; of a drawn share of the edges if ratio is below 1."""
    edges = g.edges.where("src <> dst").where(uniform(f"pair{salt}", "src", "dst") < ratio) if ratio < 1 else g.edges.where("src <> dst")
    e = _labelled(Graph(g.nodes, edges), a).select("src", "dst", (F.col("p") == F.col("q")).alias("x"))
    f = _labelled(Graph(g.nodes, edges), b).select("src", "dst", (F.col("p") == F.col("q")).alias("y"))
    return e.join(f, ["src", "dst"]).agg(F.avg(F.expr("cast(x <> y as int)")).alias("distance"))


def nmi_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """1 - 2 MI / (H1 + H2) over the nodes of both; 0 without entropy."""
    both = cut(a.join(b.withColumnRenamed("subset", "other"), "id").groupBy("subset", "other").agg(F.count(F.lit(1)).alias("k")))
    n = both.agg(F.sum("k").alias("n"))

    def entropy(df, name):
        return df.join(F.broadcast(n)).agg((-F.sum(F.col("k") / F.col("n") * F.log2(F.col("k") / F.col("n")))).alias(name))  # one row

    h = entropy(both.groupBy("subset").agg(F.sum("k").alias("k")), "ha").join(entropy(both.groupBy("other").agg(F.sum("k").alias("k")), "hb")).join(entropy(both, "hab"))
    mi = F.col("ha") + F.col("hb") - F.col("hab")
    return h.select(F.when(F.col("ha") + F.col("hb") == 0, 0.0).otherwise(1 - 2 * mi / (F.col("ha") + F.col("hb"))).alias("distance"))


def equal_on_edges(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    return graph_rand_distance(g, a, b).select((F.col("distance") == 0).alias("equal"))


# -- communities of seeds


def push_pagerank(g: Graph, seeds: DataFrame, alpha: float = 0.1, eps: float = 1e-4, rounds: int = 10_000) -> DataFrame:
    """(seed, id, pr): approximate personalised PageRank; all nodes whose residue is at least eps per degree push in a round."""
    d = g.degrees().select("id", "deg")
    arcs = cut(g.both().where("src <> dst").select("src", "dst"))
    x = cut(seeds.select(F.col("id").alias("seed"), "id", F.lit(0.0).alias("pr"), F.lit(1.0).alias("r")))
    for _ in range(rounds):
        y = x.join(d, "id").withColumn("push", (F.col("deg") > 0) & (F.col("r") >= eps * F.col("deg")))
        y = cut(y)
        if y.where("push").limit(1).count() == 0:
            return x.where("pr > 0").select("seed", "id", "pr")
        sent = y.where("push").select("seed", F.col("id").alias("src"), ((1 - alpha) / 2 * F.col("r") / F.col("deg")).alias("m")).join(arcs, "src").groupBy("seed", F.col("dst").alias("id")).agg(F.sum("m").alias("m"))
        kept = y.select("seed", "id", F.when(F.col("push"), F.col("pr") + alpha * F.col("r")).otherwise(F.col("pr")).alias("pr"), F.when(F.col("push"), (1 - alpha) / 2 * F.col("r")).otherwise(F.col("r")).alias("r"))
        x = cut(kept.join(sent, ["seed", "id"], "full").select("seed", "id", F.coalesce("pr", F.lit(0.0)).alias("pr"), (F.coalesce("r", F.lit(0.0)) + F.coalesce("m", F.lit(0.0))).alias("r")))
    raise RuntimeError(f"residues are still pushed after {rounds} rounds")


def sweep(g: Graph, pr: DataFrame) -> DataFrame:
    """(seed, id): the prefix of least conductance in the order of pr over degree, for each seed."""
    d = g.degrees().select("id", "deg", "vol")
    order = Window.partitionBy("seed").orderBy(F.desc("q"), "id")
    ranked = cut(pr.join(d, "id").where("deg > 0").select("seed", "id", "vol", (F.col("pr") / F.col("deg")).alias("q")).select("seed", "id", "vol", F.row_number().over(order).alias("r")))
    a, b = (ranked.select("seed", F.col("id").alias(c), F.col("r").alias(v)) for c, v in (("src", "ra"), ("dst", "rb")))
    inner = g.edges.where("src <> dst").join(a, "src").join(b, ["seed", "dst"]).groupBy("seed", F.greatest("ra", "rb").alias("r")).agg(F.sum("w").alias("i"))
    w = Window.partitionBy("seed").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    total = g.edges.agg((2 * F.sum("w")).alias("total"))
    run = ranked.join(inner, ["seed", "r"], "left").select("seed", "id", "r", F.sum("vol").over(w).alias("v"), F.sum(F.coalesce("i", F.lit(0.0))).over(w).alias("i")).join(F.broadcast(total))  # one row
    low = F.least(F.col("v"), F.col("total") - F.col("v"))
    cond = run.select("seed", "id", "r", F.when(low > 0, (F.col("v") - 2 * F.col("i")) / low).otherwise(1.0).alias("c"))
    best = cond.groupBy("seed").agg(F.min_by("r", F.struct("c", "r")).alias("k"))
    return cond.join(best, "seed").where("r <= k").select("seed", "id")


def pagerank_nibble(g: Graph, seeds: DataFrame, alpha: float = 0.1, eps: float = 1e-4) -> DataFrame:
    return sweep(g, push_pagerank(g, seeds, alpha, eps))


def greedy_expansion(g: Graph, seeds: DataFrame) -> DataFrame:
    """(seed, id): each seed's set takes, a round at a time, the neighbour that raises inner over outer links most, while any does not lower it."""
    arcs = cut(g.both().where("src <> dst").select("src", "dst"))
    d = cut(g.degrees().select("id", "deg"))
    sets = cut(seeds.select(F.col("id").alias("seed"), "id"))
    live = sets.select("seed").distinct()
    while True:
        m = sets.join(live, "seed", "left_semi")
        out = m.select("seed", F.col("id").alias("src")).join(arcs, "src")
        tag = out.join(m.select("seed", F.col("id").alias("dst"), F.lit(1).alias("in")), ["seed", "dst"], "left")
        tot = tag.groupBy("seed").agg((F.sum(F.coalesce("in", F.lit(0))) / 2).alias("int"), F.sum(F.expr("cast(in is null as int)")).alias("ext"))
        cand = tag.where("in is null").groupBy("seed", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("din")).join(d, "id").join(tot, "seed")
        new = F.try_divide(F.col("int") + F.col("din"), F.col("ext") - F.col("din") + F.col("deg") - F.col("din"))  # null where nothing is left outside
        best = cand.select("seed", "id", F.coalesce(new, F.lit(1e18)).alias("q"), F.when(F.col("ext") > 0, F.col("int") / F.col("ext")).otherwise(0.0).alias("was")).groupBy("seed").agg(F.max_by(F.struct("id", "q", "was"), F.struct("q", -F.col("id"))).alias("b"))
        take = cut(best.where("b.q >= b.was").select("seed", F.col("b.id").alias("id")))
        if take.isEmpty():
            return sets
        sets, live = cut(sets.union(take)), take.select("seed")
