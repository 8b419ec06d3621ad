"""Triangles, quadrangles, clustering and scores of edges."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.hashrand import uniform
from graphloom.graph import Graph, cumulated, numbered
from graphloom.plans.fixpoint import cut


def _ranked(g: Graph) -> DataFrame:
    """(src, dst, rs, rd): each edge with its ends' ranks (degree, id)."""
    d = g.degrees().select("id", "deg")
    e = g.edges.where("src <> dst").select("src", "dst").join(d.select(F.col("id").alias("src"), F.col("deg").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("deg").alias("dd")), "dst")
    return e.select("src", "dst", F.struct(F.col("ds").alias("d"), F.col("src").alias("id")).alias("rs"), F.struct(F.col("dd").alias("d"), F.col("dst").alias("id")).alias("rd"))


#: Edges that one task holds at most, about; 16 bytes each and as much again while they are sorted.
TILE = 12_000_000
#: Wedges that a task looks up at once.
WEDGES = 1_000_000


#: Edges that are packed together before they are sent.
PACK = 1_000_000


def _planes(ids: np.ndarray) -> bytes:
    """Longs with their first bytes together, then their second bytes, and so on: what the shuffle's compression makes small."""
    return np.ascontiguousarray(ids.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _longs(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _packs(batches):
    """(x, y, src, dst): edges of two colours x <= y in packs sorted by (src, dst), src as steps from one to the next."""
    held, n = [], 0

    def packed():
        x, y, src, dst = (np.concatenate(c) for c in zip(*held))
        x, y = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((dst, src, y, x))
        x, y, src, dst = x[order], y[order], src[order], dst[order]
        starts = np.flatnonzero(np.diff(x, prepend=-1) | np.diff(y, prepend=-1))
        parts = [slice(i, j) for i, j in zip(starts, [*starts[1:], len(x)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x[starts]), pa.array(y[starts]), pa.array([_planes(np.diff(src[p], prepend=0)) for p in parts], pa.binary()), pa.array([_planes(dst[p]) for p in parts], pa.binary())], names=["x", "y", "src", "dst"])

    for b in batches:
        if b.num_rows:
            held.append(tuple(b.column(c).to_numpy() for c in ("x", "y", "src", "dst")))
            n += b.num_rows
        if n >= PACK:
            yield packed()
            held, n = [], 0
    if held:
        yield packed()


def _tiles(g: Graph, tile: int) -> tuple[DataFrame, int]:
    """(tile, src, dst, same, single), packs of edges dealt so that each partition is one tile, and the number of tiles.

    Nodes have one of k colours by a hash; a tile is three colours, equal ones included. An edge goes to the k tiles that hold its
    ends' colours, so a triangle lies in the tile of its corners' colours. A tile holds at most 6 / k^2 of the edges.
    """
    m = g.edges.count()
    k = max(3, math.ceil(math.sqrt(6 * m / tile))) if m > 1000 else 1
    colour = lambda c: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    packs = g.edges.where("src <> dst").select(colour("src").alias("x"), colour("dst").alias("y"), "src", "dst").mapInArrow(_packs, "x int, y int, src binary, dst binary")
    e = packs.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    lo, hi = F.least("x", "y", "z"), F.greatest("x", "y", "z")
    mid = F.col("x") + F.col("y") + F.col("z") - lo - hi
    # colours lo <= mid <= hi, numbered without holes
    number = F.expr("hi * (hi + 1) * (hi + 2) div 6 + mid * (mid + 1) div 2 + lo").cast("int")
    dealt = e.select("src", "dst", (F.col("x") == F.col("y")).alias("same"), lo.alias("lo"), mid.alias("mid"), hi.alias("hi")).select(number.alias("tile"), "src", "dst", "same", (F.col("lo") == F.col("hi")).alias("single"))
    n = k * (k + 1) * (k + 2) // 6
    return dealt.repartitionById(n, "tile"), n


def _closed(batches, wedges: int):
    """Triangles of the edges in batches: first ids, each edge's ends as places in ids, then arrays of places in the edges, three to a triangle.

    Edges leave their end of lesser (degree, id) and are sorted, so the closing edge of two of a node's is found by bisection. In a tile of
    several colours those of one colour are passed over: their own tile has them.
    """
    raw, small, ids, single = [], [], np.empty(0, np.int64), True
    for b in batches:
        for row in b.select(["src", "dst", "same", "single"]).to_pylist():
            dst = _longs(row["dst"])
            small.append((np.cumsum(_longs(row["src"])), dst, np.full(len(dst), row["same"])))
            single = row["single"]
        if len(small) >= 64:
            raw.append(tuple(np.concatenate(c) for c in zip(*small)))
            small = []
    if small:
        raw.append(tuple(np.concatenate(c) for c in zip(*small)))
    if not raw:
        return
    for src, dst, _ in raw:
        ids = np.union1d(ids, np.concatenate([src, dst]))
    n = len(ids)
    ends, deg = [], np.zeros(n, np.int64)
    raw.reverse()
    while raw:
        src, dst, same = raw.pop()
        s, d = np.searchsorted(ids, src).astype(np.int32), np.searchsorted(ids, dst).astype(np.int32)
        deg += np.bincount(s, minlength=n) + np.bincount(d, minlength=n)
        ends.append((s, d, same))
    by_rank = np.lexsort((ids, deg))
    rank = np.empty(n, np.int64)
    rank[by_rank] = np.arange(n)
    ids = ids[by_rank]
    key = np.empty(sum(len(e[0]) for e in ends), np.int64)
    at = 0
    while ends:
        s, d, same = ends.pop()
        s, d = rank[s], rank[d]
        key[at : at + len(s)] = (np.minimum(s, d) * n + np.maximum(s, d)) * 2 + same
        at += len(s)
    key.sort()
    same = (key & 1).astype(bool)
    key >>= 1
    a, b = (key // n).astype(np.int32), (key % n).astype(np.int32)
    yield ids, a, b
    several = bool((key[1:] == key[:-1]).any())
    last = np.cumsum(np.bincount(a, minlength=n))
    more = last[a] - 1 - np.arange(len(a))
    upto = np.cumsum(more)
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + wedges, "right")))
        own = more[at:end]
        one = np.repeat(np.arange(at, end), own)
        two = np.arange(len(one)) - np.repeat(np.cumsum(own) - own, own) + one + 1
        want = b[one].astype(np.int64) * n + b[two]
        third = np.searchsorted(key, want)
        hit = key[np.minimum(third, len(key) - 1)] == want
        if not single:
            hit &= ~(same[one] & same[two])
        one, two, third, want = one[hit], two[hit], third[hit], want[hit]
        if several and len(want):  # parallel edges close as many triangles
            times = np.searchsorted(key, want, "right") - third
            one, two, start = np.repeat(one, times), np.repeat(two, times), np.repeat(third, times)
            third = start + np.arange(len(start)) - np.repeat(np.cumsum(times) - times, times)
        yield one, two, third
        at = end


def triangles(g: Graph, tile: int = TILE, wedges: int = WEDGES) -> DataFrame:
    """(a, b, c), b < c: every triangle once. Edges are dealt to tiles, so no wedge is ever sent."""

    def rows(batches):
        found = _closed(batches, wedges)
        ids, a, b = next(found, (None, None, None))
        for one, two, _ in found:
            u, v = ids[b[one]], ids[b[two]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[one]]), pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b", "c"])

    return _tiles(g, tile)[0].mapInArrow(rows, "a long, b long, c long")


def node_triangles(g: Graph, tile: int = TILE, wedges: int = WEDGES) -> DataFrame:
    """(id, t): triangles at every node that has any, counted in the tiles first."""

    def rows(batches):
        found = _closed(batches, wedges)
        ids, a, b = next(found, (None, None, None))
        if ids is None:
            return
        t = np.zeros(len(ids), np.int64)
        for one, two, _ in found:
            for corner in (a[one], b[one], b[two]):
                np.add.at(t, corner, 1)
        for part in np.array_split(np.flatnonzero(t), 1 + len(t) // 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(t[part])], names=["id", "t"])

    return _tiles(g, tile)[0].mapInArrow(rows, "id long, t long").groupBy("id").agg(F.sum("t").alias("t"))


def edge_triangles(g: Graph, tile: int = TILE, wedges: int = WEDGES) -> DataFrame:
    """(src, dst, t): triangles at every edge that has any, counted in the tiles first."""

    def rows(batches):
        found = _closed(batches, wedges)
        ids, a, b = next(found, (None, None, None))
        if ids is None:
            return
        t = np.zeros(len(a), np.int64)
        for three in found:
            for edge in three:
                np.add.at(t, edge, 1)
        for part in np.array_split(np.flatnonzero(t), 1 + len(t) // 100_000):
            u, v = ids[a[part]], ids[b[part]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(t[part])], names=["src", "dst", "t"])

    return _tiles(g, tile)[0].mapInArrow(rows, "src long, dst long, t long").groupBy("src", "dst").agg(F.sum("t").alias("t"))


def local_clustering(g: Graph) -> DataFrame:
    """(id, lcc): triangles over pairs of neighbours, 0 for fewer than two. Loops are refused by the caller's data."""
    d = g.degrees().select("id", "deg")
    t = node_triangles(g)
    return d.join(t, "id", "left").select("id", F.when(F.col("deg") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("deg") * (F.col("deg") - 1))).otherwise(0.0).alias("lcc"))


def global_clustering(g: Graph) -> DataFrame:
    """One row: closed share of all wedges, and the mean of the local values over nodes of degree 2 or more."""
    d = g.degrees().select("id", "deg").join(node_triangles(g), "id", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    many = F.col("deg") > 1
    return d.agg((F.sum(2 * F.col("t")) / F.sum(F.col("deg") * (F.col("deg") - 1))).alias("closed"), F.avg(F.when(many, 2 * F.col("t") / (F.col("deg") * (F.col("deg") - 1)))).alias("mean_local"))


def sampled_clustering(g: Graph, k: int, salt: int = 0) -> DataFrame:
    """One row: the closed share of k drawn wedges, all equally likely.

    A centre is drawn by its number of wedges: the draw falls into the running sum over nodes, found by its range first and then
    inside it. Two different neighbours follow by draws of their own, so only the arcs of drawn centres are read.
    """
    arcs = cut(g.both().where("src <> dst").select("src", "dst").distinct())
    deg = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    upto = cut(cumulated(deg.select("id", "d", (F.col("d") * (F.col("d") - 1)).alias("pairs")), ["id"], "pairs", "upto"))
    total = upto.agg(F.max("upto")).first()[0]
    if not total:
        return g.nodes.agg(F.lit(None).cast("double").alias("closed"))
    # ranges of equal width: a node belongs to all that its stretch touches, but long stretches to few nodes
    width = max(1, -(-total // (4 * k)))
    places = upto.select("id", "d", "pairs", (F.col("upto") - F.col("pairs")).alias("low"), "upto").withColumn("bin", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(upto - 1) div {width}"))))
    draws = g.nodes.sparkSession.range(k).select(F.col("id").alias("draw"), F.floor(uniform(f"wedge{salt}", "id") * total).cast("long").alias("at")).withColumn("bin", F.expr(f"at div {width}"))
    # (draw, centre, the places of two different neighbours in the order of ids)
    drawn = draws.join(places, "bin").where("at >= low and at < upto").select("draw", "id", ((F.col("at") - F.col("low")) % F.col("d")).alias("a"), F.expr("(at - low) div d").alias("b"))
    drawn = cut(drawn.withColumn("b", F.col("b") + (F.col("b") >= F.col("a")).cast("long")))
    near = cut(numbered(arcs.join(drawn.select(F.col("id").alias("src")).distinct(), "src", "left_semi"), ["src", "dst"], "n"))
    near = near.join(near.groupBy("src").agg(F.min("n").alias("first")), "src").select(F.col("src").alias("id"), "dst", (F.col("n") - F.col("first")).alias("r"))
    x, y = near.select("id", F.col("r").alias("a"), F.col("dst").alias("u")), near.select("id", F.col("r").alias("b"), F.col("dst").alias("v"))
    wedge = drawn.join(x, ["id", "a"]).join(y, ["id", "b"]).select("draw", F.col("u").alias("src"), F.col("v").alias("dst"))
    return wedge.join(arcs.withColumn("hit", F.lit(1)), ["src", "dst"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("closed"))


def triangle_scores(g: Graph) -> DataFrame:
    """(src, dst, t) for every edge."""
    n = edge_triangles(g)
    return g.edges.select("src", "dst").join(n, ["src", "dst"], "left").select("src", "dst", F.coalesce("t", F.lit(0)).cast("long").alias("t"))


def quadrangle_scores(g: Graph) -> DataFrame:
    """(src, dst, q): four-cycles through every edge.

    A cycle is met at its corner of greatest rank (degree, id) and the one across: where c paths of two edges join such a pair through corners
    of lesser rank, each path lies in c - 1 cycles, and so do its edges for that pair. A node passes each of its few arcs to nodes of
    greater rank on to its neighbours, so paths grow with m times the root of m, and a hub sends few.
    """
    e = cut(_ranked(g))
    arcs = e.select(F.col("src").alias("m"), F.col("dst").alias("y"), F.col("rd").alias("r"), "rs").union(e.select("dst", "src", "rs", "rd")).withColumnRenamed("rs", "rm")
    up = arcs.where("r > rm").select("m", F.col("y").alias("x"), F.col("r").alias("top"))
    wedge = cut(up.join(arcs.select("m", "y", "r"), "m").where("r < top").select("m", "x", "y"))
    common = wedge.groupBy("x", "y").agg((F.count(F.lit(1)) - 1).alias("more")).where("more > 0")
    hits = wedge.join(common, ["x", "y"]).select(F.explode(F.array(F.struct(F.least("x", "m").alias("src"), F.greatest("x", "m").alias("dst")), F.struct(F.least("y", "m").alias("src"), F.greatest("y", "m").alias("dst")))).alias("e"), "more")
    q = hits.groupBy("e.src", "e.dst").agg(F.sum("more").cast("long").alias("q"))
    return g.edges.select("src", "dst").join(q, ["src", "dst"], "left").select("src", "dst", F.coalesce("q", F.lit(0)).cast("long").alias("q"))


def with_degrees(g: Graph, scores: DataFrame) -> DataFrame:
    d = g.degrees()
    return scores.join(d.select(F.col("id").alias("src"), F.col("deg").alias("du"), F.col("wdeg").alias("su")), "src").join(d.select(F.col("id").alias("dst"), F.col("deg").alias("dv"), F.col("wdeg").alias("sv")), "dst")


def _of_triangles(g: Graph, value: Column) -> DataFrame:
    return with_degrees(g, triangle_scores(g)).select("src", "dst", value.alias("score"))


def scan_similarity(g: Graph) -> DataFrame:
    return _of_triangles(g, (F.col("t") + 1) / F.sqrt((F.col("du") + 1.0) * (F.col("dv") + 1.0)))


def jaccard_distance(g: Graph) -> DataFrame:
    return _of_triangles(g, 1 - F.col("t") / (F.col("du") + F.col("dv") - F.col("t")))


def chance_corrected(g: Graph) -> DataFrame:
    n = g.nodes.count()
    t, du, dv = F.col("t"), F.col("du"), F.col("dv")
    return _of_triangles(g, F.when(t > 0, t * (n - 2) / ((du - 1.0) * (dv - 1.0))).when((du == 1) | (dv == 1), 1.0).otherwise(0.0))


def adamic_adar_distance(g: Graph) -> DataFrame:
    """(src, dst, score): 1 / sum of 1 / ln(degree) over common neighbours; null without any."""
    d = g.degrees().select("id", "deg")
    t = triangles(g)
    pairs = t.select(F.explode(F.array(*[F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"), F.col(z).alias("id")) for x, y, z in (("a", "b", "c"), ("a", "c", "b"), ("b", "c", "a"))])).alias("e")).select("e.*")
    s = pairs.join(d, "id").groupBy("src", "dst").agg(F.sum(1 / F.log("deg")).alias("s"))
    return g.edges.select("src", "dst").join(s, ["src", "dst"], "left").select("src", "dst", (1 / F.col("s")).alias("score"))


# -- transforms of a score (src, dst, score)
def geometric_mean(g: Graph, scores: DataFrame) -> DataFrame:
    s = Graph(g.nodes, scores.select("src", "dst", F.col("score").alias("w"))).both().groupBy("src").agg(F.sum("w").alias("s"))
    e = scores.join(s.withColumnRenamed("s", "a"), "src").join(s.select(F.col("src").alias("dst"), F.col("s").alias("b")), "dst")
    return e.select("src", "dst", F.when(F.col("score") == 0, 0.0).otherwise(F.col("score") / F.sqrt(F.col("a") * F.col("b"))).alias("score"))


def normalized(scores: DataFrame, lower: float = 0.0, upper: float = 1.0, invert: bool = False) -> DataFrame:
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    share = (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    share = 1 - share if invert else share
    return scores.join(F.broadcast(ends)).select("src", "dst", (lower + share * (upper - lower)).alias("score"))  # one row


def linearized(scores: DataFrame, inverse: bool = False) -> DataFrame:
    """Rank over m - 1, equal scores in the order of (src, dst); 0.5 for a single edge."""
    from graphloom.graph import numbered

    m = scores.count()
    if m == 1:
        return scores.select("src", "dst", F.lit(0.5).alias("score"))
    r = numbered(scores.select("score", "src", "dst"), ["score", "src", "dst"], "r")
    share = F.col("r") / (m - 1)
    return r.select("src", "dst", (1 - share if inverse else share).alias("score"))


def blended(first: DataFrame, second: DataFrame, chosen: DataFrame) -> DataFrame:
    """second's score on the chosen edges (src, dst), else first's."""
    b = second.withColumnRenamed("score", "b").join(chosen.select("src", "dst"), ["src", "dst"], "left_semi")
    return first.join(b, ["src", "dst"], "left").select("src", "dst", F.coalesce("b", "score").alias("score"))


def as_weight(g: Graph, scores: DataFrame, offset: float = 0.0, factor: float = 1.0, squared: bool = False) -> Graph:
    s = F.col("score") * F.col("score") if squared else F.col("score")
    return Graph(g.nodes, scores.select("src", "dst", (offset + factor * s).alias("w")), g.directed)


def sided(scores: DataFrame) -> DataFrame:
    """(ego, alter, score) from either end, in one pass, so that the scores are made once."""
    ends = F.array(F.struct(F.col("src").alias("ego"), F.col("dst").alias("alter")), F.struct(F.col("dst").alias("ego"), F.col("src").alias("alter")))
    return scores.select(F.explode(ends).alias("e"), "score").select("e.ego", "e.alter", "score")


def ranked_neighborhoods(g: Graph, scores: DataFrame) -> DataFrame:
    """(ego, alter, score, rank): neighbours by score, the highest first; rank counts distinct higher scores, ties by larger id."""
    both = sided(scores)
    w = Window.partitionBy("ego")
    return both.select("ego", "alter", "score", (F.dense_rank().over(w.orderBy(F.desc("score"))) - 1).alias("rank"), F.row_number().over(w.orderBy(F.desc("score"), F.desc("alter"))).alias("place"))


def prefix_jaccard(g: Graph, scores: DataFrame) -> DataFrame:
    """(src, dst, score): the largest Jaccard index over prefixes, by rank, of the ends' neighbourhoods; the ends themselves are left out."""
    r = ranked_neighborhoods(g, scores).select("ego", "alter", "rank")
    e = g.edges.select("src", "dst")
    left = e.join(r.select(F.col("ego").alias("src"), "alter", F.col("rank").alias("ra")), "src").where("alter <> dst")
    right = e.join(r.select(F.col("ego").alias("dst"), "alter", F.col("rank").alias("rb")), "dst").where("alter <> src")
    both = left.join(right, ["src", "dst", "alter"], "full").select("src", "dst", "ra", "rb")
    # at prefix k: common = max(ra, rb) <= k, sides = ra <= k and rb <= k
    steps = both.select("src", "dst", F.explode(F.array(F.struct(F.col("ra").alias("k"), F.lit(1).alias("side"), F.lit(0).alias("shared")), F.struct(F.col("rb").alias("k"), F.lit(1).alias("side"), F.lit(0).alias("shared")), F.struct(F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), F.greatest("ra", "rb")).alias("k"), F.lit(0).alias("side"), F.lit(1).alias("shared")))).alias("s")).select("src", "dst", "s.*").where("k is not null")
    sums = steps.groupBy("src", "dst", "k").agg(F.sum("side").alias("side"), F.sum("shared").alias("shared"))
    w = Window.partitionBy("src", "dst").orderBy("k")
    at = sums.select("src", "dst", (F.sum("shared").over(w) / (F.sum("side").over(w) - F.sum("shared").over(w))).alias("j"))
    best = at.groupBy("src", "dst").agg(F.max("j").alias("j"))
    return e.join(best, ["src", "dst"], "left").select("src", "dst", F.coalesce("j", F.lit(0.0)).alias("score"))


def constant(g: Graph, score: float = 1.0) -> DataFrame:
    return g.edges.select("src", "dst", F.lit(float(score)).alias("score"))


def same_subset(g: Graph, parts: DataFrame) -> DataFrame:
    """(src, dst, score): 1 where a partition has both ends in one subset, else 0."""
    a, b = (parts.select(F.col("id").alias(c), F.col("subset").alias(f"s_{c}")) for c in ("src", "dst"))
    return g.edges.join(a, "src").join(b, "dst").select("src", "dst", (F.col("s_src") == F.col("s_dst")).cast("double").alias("score"))


def modularity_partition(g: Graph) -> DataFrame:
    """(src, dst, score): 1 inside the communities that Louvain finds, else 0."""
    from graphloom.operators.community import louvain

    return same_subset(g, louvain(g))
