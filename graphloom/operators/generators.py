"""Random and regular graphs whose every draw comes from ids and a salt, so any partitioning gives the same graph."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.hashrand import ONE_TURN, PairsBelow, below, uniform
from graphloom.graph import Graph
from graphloom.plans.fixpoint import Rounds, cut

#: Drawn edges that a task holds at once, about.
PIECE = 500_000
#: Drawn edges of a task, about.
DRAWN = 4_000_000
#: Tasks that all pairs of nodes are dealt to.
PAIR_TASKS = 192
#: Pairs of a node that are hashed at once, at most.
WIDTH = 16_384
#: Halvings of the cells of points, at most; fewer are right as well, only slower.
LEVELS = 24
#: Points of a cell that a task compares at once, at most.
CELL = 4096


def _nodes(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def ring_lattice(spark: SparkSession, n: int, k: int) -> Graph:
    """Each node to the next k on a ring."""
    e = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("o")).select("src", F.pmod(F.col("src") + F.col("o"), F.lit(n)).alias("dst"))
    return Graph.from_edges(Graph.from_edges(e).edges.select("src", "dst").distinct(), _nodes(spark, n))


def watts_strogatz(spark: SparkSession, n: int, k: int, p: float, salt: int = 0) -> Graph:
    """The ring lattice with each far end redrawn with chance p; loops and repeats go."""
    e = ring_lattice(spark, n, k).edges
    to = F.when(uniform(f"re{salt}", "src", "dst") < p, F.floor(uniform(f"to{salt}", "src", "dst") * n)).otherwise(F.col("dst"))
    new = e.select("src", to.alias("dst")).where("src <> dst")
    return Graph.from_edges(Graph.from_edges(new).edges.select("src", "dst").distinct(), _nodes(spark, n))


def erdos_renyi(spark: SparkSession, n: int, p: float, salt: int = 0) -> Graph:
    """G(n, p) by geometric skips: each node draws its own gaps to the partners before it, so work follows the edges."""

    def rows(batches):
        for batch in batches:
            src, dst, held = [], [], 0
            for u in batch.column(0).to_pylist():
                rng = np.random.default_rng([salt, u])
                if p >= 1:
                    got = np.arange(u)
                elif p <= 0:
                    got = np.empty(0, int)
                else:
                    got = np.empty(0, int)
                    last = -1
                    while last < u:
                        gaps = rng.geometric(p, max(16, int(1.2 * u * p)))
                        more = last + np.cumsum(gaps)
                        got, last = np.r_[got, more], int(more[-1])
                    got = got[got < u]
                src.append(np.full(len(got), u))
                dst.append(got)
                held += len(got)
                if held > PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(dst)), pa.array(np.concatenate(src))], names=["src", "dst"])
                    src, dst, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(dst)), pa.array(np.concatenate(src))], names=["src", "dst"])

    # later nodes have more partners before them, so nodes are dealt finely
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(max(0.0, min(1.0, p)) * n * n / 2 / DRAWN))
    return Graph.from_edges(spark.range(0, n, 1, tasks).mapInArrow(rows, "src long, dst long"), _nodes(spark, n))


def runs_by_end(batches):
    """(dst, n, fell, wrong): for each run of rows (src, dst) of one dst their number, how often src does not rise, and how often it is not below dst."""
    names, last = ["dst", "n", "fell", "wrong"], None
    for batch in batches:
        src, dst = (batch.column(i).to_numpy() for i in range(2))
        if not len(dst):
            continue
        starts = np.r_[0, 1 + np.flatnonzero(np.diff(dst))]
        stay = np.r_[False, (np.diff(dst) == 0) & (np.diff(src) <= 0)]
        rows = [dst[starts], np.diff(np.r_[starts, len(dst)]), *(np.add.reduceat(x.astype(np.int64), starts) for x in (stay, src >= dst))]
        if last is not None and last[0] == dst[0]:
            for c, v in zip(rows[1:], (last[1], last[2] + (src[0] <= last[4]), last[3]), strict=True):
                c[0] += v
        elif last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in last[:4]], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1]) for c in rows], names=names)
        last = (*(int(c[-1]) for c in rows), int(src[-1]))
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in last[:4]], names=names)


def pairwise(spark: SparkSession, n: int, chance, salt: int = 0, extra: DataFrame | None = None) -> DataFrame:
    """Edges of a small graph from a chance for each pair (a column over u, v and extra's columns of either, as ux and vx).

    Where the chance is a number, pairs of chunks of nodes are a task's work each, which hashes a node's pairs as one array.
    """
    ids = spark.range(n) if extra is None else extra
    if isinstance(chance, float):
        least, span = math.ceil(chance * 4294967296.0), ids.agg(F.count("id").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
        if 0 < least < 1 << 32 and span.n and span.low >= 0 and 2 * len(str(span.high)) + 2 + len(str(salt).encode()) <= ONE_TURN:
            return _hashed_pairs(ids, int(span.n), least, salt)
    a, b = ids.select(*[F.col(c).alias("u" if c == "id" else "u" + c) for c in ids.columns]), ids.select(*[F.col(c).alias("v" if c == "id" else "v" + c) for c in ids.columns])
    # one file of nodes would be one task's pairs; rows are dealt by a hash, so that tasks get small and large ids alike
    a = a.repartition(PAIR_TASKS, "u")
    drawn = below(salt, chance, "u", "v") if isinstance(chance, float) else uniform(salt, "u", "v") < chance
    return a.join(b, F.col("u") < F.col("v")).where(drawn).select(F.col("u").alias("src"), F.col("v").alias("dst"))


def _hashed_pairs(ids: DataFrame, n: int, least: int, salt: int | str) -> DataFrame:
    """(src, dst): pairs of ids whose hash is below least. A task gets a chunk of lesser ids and one of at most WIDTH greater ids."""
    from graphloom.graph import numbered

    high, wide = min(32_768, max(250, n // 48)), WIDTH
    rows_of, columns = -(-n // high), -(-n // wide)

    def rows(batches):
        mine: dict[int, list] = {0: [], 1: []}
        for batch in batches:
            which, got = batch.column("end").to_numpy(), batch.column("id").to_numpy()
            for c in mine:
                mine[c].append(got[which == c])
        u, v = (np.sort(np.concatenate(m)) if m else np.empty(0, np.int64) for m in mine.values())
        if not len(u) or not len(v):
            return
        drawn, src, dst, held = PairsBelow(salt, least, v), [], [], 0
        for x in u[u < v[-1]].tolist():
            got = drawn.among(x, int(np.searchsorted(v, x, "right")))
            src.append(np.full(len(got), x))
            dst.append(got)
            held += len(got)
            if held > PIECE:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])
                src, dst, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    placed = cut(numbered(ids.select(F.col("id").cast("long").alias("id")), ["id"], "pos"))
    # chunks whose lesser ids all come after the greater ones have no pairs
    lesser = placed.withColumn("i", F.expr(f"pos div {high}")).select(F.lit(0).alias("end"), "id", "i", F.explode(F.sequence(F.expr(f"i * {high} div {wide}"), F.lit(columns - 1).cast("long"))).alias("j"))
    greater = placed.withColumn("j", F.expr(f"pos div {wide}")).select(F.lit(1).alias("end"), "id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"least({rows_of - 1}L, ((j + 1) * {wide} - 1) div {high})"))).alias("i"), "j")
    dealt = lesser.unionByName(greater).select(F.expr(f"cast(i * {columns} + j as int)").alias("tile"), "end", "id")
    return dealt.repartitionById(rows_of * columns, "tile").select("end", "id").mapInArrow(rows, "src long, dst long")


def chung_lu(spark: SparkSession, weights: DataFrame, salt: int = 0) -> Graph:
    """Edges with chance w_u w_v / sum(w), from (id, wt): by doublings of weight, so that pairs of light nodes are skipped over, not tried.

    Nodes are put in classes by powers of two of their weight. Each node draws, for each class, gaps of a
    geometric law at the class's greatest chance, and keeps a hit with its own chance over that one.
    """
    from graphloom.graph import numbered

    total = weights.agg(F.sum("wt")).first()[0] or 1.0
    w = weights.where("wt > 0").withColumn("class", F.floor(F.log2("wt")).cast("int"))
    sizes = {r["class"]: r["n"] for r in w.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each power of two
    placed = numbered(w, ["class", "id"], "pos")
    first, at = {}, 0
    for c in sorted(sizes):
        first[c], at = at, at + sizes[c]

    def rows(it):
        for pdf in it:
            out = []
            for u, wt, pos in zip(pdf["id"], pdf["wt"], pdf["pos"], strict=True):
                for c, n in sizes.items():
                    top = min(1.0, wt * 2.0 ** (c + 1) / total)
                    rng = np.random.default_rng([salt, int(pos), c + 2000])
                    lo, hi = first[c], min(first[c] + n, int(pos))
                    if hi <= lo:
                        continue
                    k = lo - 1
                    while True:
                        k += int(rng.geometric(top)) if top < 1 else 1
                        if k >= hi:
                            break
                        out.append((u, wt, k, rng.random() * top))
            yield pd.DataFrame(out, columns=["u", "wu", "pos", "x"]).astype({"u": "int64", "wu": "float64", "pos": "int64", "x": "float64"})

    hits = placed.select("id", F.col("wt").cast("double").alias("wt"), "pos").mapInPandas(rows, "u long, wu double, pos long, x double")
    e = hits.join(placed.select("pos", F.col("id").alias("v"), F.col("wt").alias("wv")), "pos").where(F.col("x") < F.least(F.lit(1.0), F.col("wu") * F.col("wv") / total))
    return Graph.from_edges(e.select(F.col("u").alias("src"), F.col("v").alias("dst")), weights.select("id"))


def _hits(rng: np.random.Generator, p: float, cells: int):
    """The cells that a chance p each draws, rising, in pieces."""
    last = -1
    while p > 0 and last < cells - 1:
        left = cells - 1 - last
        got = last + np.cumsum(rng.geometric(min(1.0, p), min(PIECE, 16 + int(1.1 * p * left))))
        last = int(got[-1])
        yield got[got < cells]


def stochastic_block(spark: SparkSession, blocks: DataFrame, affinity: list[list[float]], salt: int = 0, chunk: int | None = None) -> Graph:
    """Edges with the chance of the ends' blocks, from (id, block); pairs are skipped over.

    Blocks are cut into chunks of nodes. Each pair of chunks is one task's work: it gets both chunks' ids, walks their pairs by geometric
    gaps and passes edges on in pieces, so a task holds two chunks and a piece however many edges there are, and no edge is shuffled.
    """
    from graphloom.graph import numbered

    sizes = {int(r["block"]): r["n"] for r in blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each block
    each = chunk or min(32_768, max(500, sum(sizes.values()) // 60))
    starts, of = [], []  # each block's number, first place and first chunk; each chunk's block
    at = 0
    for c in sorted(sizes):
        starts.append((c, at, len(of)))
        of += [c] * -(-sizes[c] // each)
        at += sizes[c]
    if not of:
        return Graph.from_edges(blocks.select(F.col("id").alias("src"), F.col("id").alias("dst")), blocks.select("id"))

    def rows(batches):
        mine: dict[int, list] = {}
        for batch in batches:
            which, ids = batch.column("chunk").to_numpy(), batch.column("id").to_numpy()
            for c in np.unique(which):
                mine.setdefault(int(c), []).append(ids[which == c])
        if not mine:
            return
        x, y = min(mine), max(mine)
        a, b = np.sort(np.concatenate(mine[x])), np.sort(np.concatenate(mine[y]))
        cells = len(a) * len(b) if x < y else len(a) * (len(a) - 1) // 2
        for got in _hits(np.random.default_rng([salt, x, y]), affinity[of[y]][of[x]], cells):
            if x < y:
                i, j = got // len(b), got % len(b)
            else:  # cells 0, then 1 and 2, and so on are the pairs of nodes 1, 2, ... with those before
                j = ((1 + np.sqrt(1 + 8.0 * got)) / 2).astype(np.int64)
                j -= j * (j - 1) // 2 > got
                j += j * (j + 1) // 2 <= got
                i = got - j * (j - 1) // 2
            yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[j])], names=["src", "dst"])

    start = spark.createDataFrame(starts, "block long, first long, base long")  # a row for each block
    own = (F.col("base") + F.expr(f"(pos - first) div {each}")).cast("int")
    placed = numbered(blocks.select("id", F.col("block").cast("long").alias("block")), ["block", "id"], "pos").join(F.broadcast(start), "block").select("id", own.alias("chunk"))
    dealt = placed.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(len(of) - 1)))).select(F.expr("greatest(chunk, z) * (greatest(chunk, z) + 1) div 2 + least(chunk, z)").cast("int").alias("tile"), "chunk", F.col("id").cast("long").alias("id"))
    e = dealt.repartitionById(len(of) * (len(of) + 1) // 2, "tile").select("chunk", "id").mapInArrow(rows, "src long, dst long")
    return Graph.from_edges(e, blocks.select("id"))


def clustered(spark: SparkSession, n: int, k: int, p_in: float, p_out: float, salt: int = 0) -> tuple[Graph, DataFrame]:
    parts = spark.range(n).select("id", F.floor(uniform(f"block{salt}", "id") * k).alias("block"))
    g = stochastic_block(spark, parts, [[p_in if i == j else p_out for j in range(k)] for i in range(k)], salt)
    return g, parts.select("id", F.col("block").alias("subset"))


def barabasi_albert(spark: SparkSession, n: int, k: int, salt: int = 0) -> Graph:
    """Preferential attachment: end number i of the edge list copies a drawn earlier end; copies are resolved by pointer jumping."""
    m = n * k
    # slot 2e is edge e's own node, slot 2e + 1 points at a drawn earlier slot
    e = spark.range(m).select(F.col("id").alias("e"), F.floor(F.col("id") / k).alias("src"), F.floor(uniform(f"ba{salt}", "id") * (2 * F.col("id") + 1)).alias("to"))
    from graphloom.plans.fixpoint import cut

    x = cut(e)
    while True:
        # an even slot is a node; an odd one is the target of its edge
        open_edges = x.where("to % 2 = 1")
        if open_edges.isEmpty():
            break
        nxt = x.select(F.expr("2 * e + 1").alias("to"), F.col("to").alias("on"))
        x = cut(x.join(nxt, "to", "left").select("e", "src", F.coalesce("on", "to").alias("to")))
    done = x.select("src", F.floor(F.col("to") / 2 / k).alias("dst")).where("src <> dst")
    return Graph.from_edges(Graph.from_edges(done).edges.select("src", "dst").distinct(), spark.range(n))


def dorogovtsev_mendes(spark: SparkSession, n: int, salt: int = 0) -> Graph:
    """A triangle; each new node links to both ends of a drawn earlier edge.

    Edges 0 to 2 are the triangle; node u adds edges 2u - 3 and 2u - 2 to the first and the second end of
    the edge that it drew. A second end is the younger node of its edge; first ends are resolved by
    pointer jumping.
    """
    from graphloom.plans.fixpoint import cut

    drawn = spark.range(3, max(n, 3)).select(F.col("id").alias("u"), F.floor(uniform(f"dm{salt}", "id") * (2 * F.col("id") - 3)).alias("r"))
    younger = F.when(F.col("r") < 3, F.greatest(F.lit(1).cast("long"), F.least(F.col("r") + 1, F.lit(2).cast("long")))).otherwise(F.floor((F.col("r") + 3) / 2))
    second = drawn.select("u", younger.alias("end"))
    x = cut(drawn.select((2 * F.col("u") - 3).alias("e"), "u", F.col("r").alias("to")))
    # the triangle's first ends are known; second-end edges point no further
    known = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "e long, end long").union(second.select((2 * F.col("u") - 2).alias("e"), "end"))
    found = None
    while True:
        met = cut(x.join(known.withColumnRenamed("e", "to"), "to", "left").select("e", "u", "to", "end"))
        done = met.where("end is not null").select("u", "end")
        found = done if found is None else found.union(done)
        x = met.where("end is null").select("e", "u", "to")
        if x.isEmpty():
            break
        # an open edge whose target is open as well jumps to that one's target; resolved targets become known
        known = cut(known.union(met.where("end is not null").select("e", "end")))
        onward = x.select(F.col("e").alias("to"), F.col("to").alias("on"))
        x = cut(x.join(onward, "to", "left").select("e", "u", F.coalesce("on", "to").alias("to")))
    e = found.union(second).select(F.col("end").alias("src"), F.col("u").alias("dst"))
    base = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "src long, dst long")
    return Graph.from_edges(base.union(e), _nodes(spark, n))


def rmat(spark: SparkSession, scale: int, factor: int, a: float, b: float, c: float, d: float, salt: int = 0) -> Graph:
    """factor * 2^scale draws down the quadrants of the matrix; repeats add weight."""
    e = spark.range(factor << scale)
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i in range(scale):
        u = uniform(f"rmat{salt}:{i}", "id")
        src = src * 2 + F.when(u >= a + b, 1).otherwise(0)
        dst = dst * 2 + F.when((u >= a) & (u < a + b) | (u >= a + b + c), 1).otherwise(0)
    e = e.select(src.alias("src"), dst.alias("dst"))
    g = Graph.from_edges(e, spark.range(1 << scale))
    return Graph(g.nodes, g.edges.groupBy("src", "dst").agg(F.sum("w").alias("w")))


def powerlaw_shares(low: int, high: int, gamma: float) -> list[float]:
    """The share of degrees up to each, from low to high."""
    w = np.arange(low, high + 1, dtype=float) ** gamma
    return (np.cumsum(w) / w.sum()).tolist()


def powerlaw_degrees(spark: SparkSession, n: int, low: int, high: int, gamma: float, salt: int = 0) -> DataFrame:
    """(id, deg) with chances proportional to deg^gamma, gamma below 0."""
    cdf = powerlaw_shares(low, high, gamma)
    return spark.range(n).select("id", (low + F.size(F.filter(F.array(*map(F.lit, cdf)), lambda c: c < uniform(f"deg{salt}", "id")))).cast("long").alias("deg"))


def fit_gamma(low: int, high: int, mean: float) -> float:
    """The exponent at which the mean degree is the wanted one, by bisection."""
    k = np.arange(low, high + 1, dtype=float)
    a, b = -10.0, 5.0
    for _ in range(100):
        g = (a + b) / 2
        w = k**g
        a, b = (g, b) if (k * w).sum() / w.sum() < mean else (a, g)
    return a


def realizable(degrees: DataFrame) -> DataFrame:
    """One row: whether (id, deg) is the degree sequence of a simple graph (Erdős-Gallai), from counts per degree."""
    c = degrees.groupBy("deg").agg(F.count(F.lit(1)).alias("n"))
    # rows are distinct degrees, at most about the root of twice the edges
    down = Window.orderBy(F.desc("deg")).rowsBetween(Window.unboundedPreceding, 0)
    p = c.select("deg", "n", F.sum("n").over(down).alias("k"), F.sum(F.col("deg") * F.col("n")).over(down).alias("s"))
    q = c.select(F.col("deg").alias("e"), F.col("n").alias("m"))
    rest = p.join(q, F.col("e") < F.col("deg")).groupBy("deg").agg(F.sum(F.least("e", "k") * F.col("m")).alias("r"))
    t = p.join(rest, "deg", "left").select((F.col("s") <= F.col("k") * (F.col("k") - 1) + F.coalesce("r", F.lit(0))).alias("ok"))
    even = degrees.agg(F.coalesce(F.sum("deg") % 2 == 0, F.lit(True)).alias("even"))
    return t.agg(F.coalesce(F.min("ok"), F.lit(True)).alias("ok")).join(even).select((F.col("ok") & F.col("even")).alias("realizable"))


def havel_hakimi(spark: SparkSession, degrees: list[int]) -> Graph:
    """A simple graph with the given degrees, the largest first to the next largest; in one task."""

    def build(it):
        for pdf in it:
            for _ in pdf["id"]:
                left = sorted(((d, -i) for i, d in enumerate(degrees)), reverse=True)
                out = []
                while left and left[0][0] > 0:
                    d, u = left.pop(0)
                    if d > len(left) or left[d - 1][0] <= 0:
                        raise ValueError("no simple graph has these degrees")
                    for i in range(d):
                        out.append((-u, -left[i][1]))
                        left[i] = (left[i][0] - 1, left[i][1])
                    left.sort(reverse=True)
                yield pd.DataFrame(out, columns=["src", "dst"]).astype("int64")

    return Graph.from_edges(spark.range(1).mapInPandas(build, "src long, dst long"), _nodes(spark, len(degrees)))


def edge_switching(g: Graph, rounds: int = 10, salt: int = 0) -> Graph:
    """Degree-preserving switches: in a round edges are paired by draws and swap ends where that makes no loop or repeat."""
    from graphloom.graph import numbered
    from graphloom.plans.fixpoint import cut

    e = cut(g.edges.select("src", "dst"))
    for i in range(rounds):
        n = numbered(e.withColumn("u", uniform(f"sw{salt}:{i}", "src", "dst")), ["u", "src", "dst"], "r")
        half = n.groupBy(F.floor(F.col("r") / 2).alias("p")).agg(F.min_by(F.struct("src", "dst"), "r").alias("x"), F.max_by(F.struct("src", "dst"), "r").alias("y"), F.count(F.lit(1)).alias("k")).where("k = 2")
        new = half.select("p", "x", "y", F.struct(F.least("x.src", "y.dst").alias("src"), F.greatest("x.src", "y.dst").alias("dst")).alias("a"), F.struct(F.least("y.src", "x.dst").alias("src"), F.greatest("y.src", "x.dst").alias("dst")).alias("b")).where("a.src <> a.dst and b.src <> b.dst and a <> b")
        new = cut(new)
        flat = new.select("p", F.explode(F.array("a", "b")).alias("e")).select("p", "e.src", "e.dst")
        clash = flat.join(e, ["src", "dst"], "left_semi").select("p").union(flat.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"), F.collect_set("p").alias("ps")).where("k > 1").select(F.explode("ps"))).distinct()
        ok = cut(new.join(clash, "p", "left_anti"))
        out = ok.select(F.explode(F.array("x", "y")).alias("e")).select("e.src", "e.dst")
        into = ok.select(F.explode(F.array("a", "b")).alias("e")).select("e.src", "e.dst")
        e = cut(e.join(out, ["src", "dst"], "left_anti").union(into))
    return Graph.from_edges(e, g.nodes)


def lfr(spark: SparkSession, n: int, low: int, high: int, gamma: float, smallest: int, largest: int, mixing: float, salt: int = 0) -> tuple[Graph, DataFrame]:
    """A benchmark graph with communities: power-law degrees and community sizes, a share mixing of each node's links going out."""
    deg = powerlaw_degrees(spark, n, low, high, gamma, salt)
    rng = np.random.default_rng(salt)
    sizes: list[int] = []
    while sum(sizes) < n:
        sizes.append(int(rng.integers(smallest, largest + 1)))
    starts = np.cumsum([0, *sizes[:-1]]).tolist()
    blocks = spark.createDataFrame(list(zip(range(len(sizes)), starts, sizes, strict=True)), "subset long, start long, size long")
    of = blocks.select("subset", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("id"))
    parts = deg.select("id", "deg").join(of, "id").select("id", "deg", "subset")
    inner = parts.select("id", F.col("subset").alias("block"), (F.col("deg") * (1 - mixing)).alias("wt"))
    # inside a community of size s a node of inner degree d links with chance about d / s
    mean = inner.groupBy("block").agg(F.sum("wt").alias("total"))
    a = inner.join(mean, "block")
    p = a.select(F.col("id").alias("u"), "block", F.col("wt").alias("wu"), "total").join(a.select(F.col("id").alias("v"), "block", F.col("wt").alias("wv")), "block").where("u < v")
    e_in = p.where(uniform(f"lfr{salt}", "u", "v") < F.col("wu") * F.col("wv") / F.col("total")).select(F.col("u").alias("src"), F.col("v").alias("dst"))
    out = chung_lu(spark, parts.select("id", (F.col("deg") * mixing).alias("wt")), salt + 1)
    label = parts.select("id", "subset")
    e_out = out.edges.join(label.select(F.col("id").alias("src"), F.col("subset").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("subset").alias("b")), "dst").where("a <> b").select("src", "dst")
    return Graph.from_edges(Graph.from_edges(e_in.union(e_out)).edges.select("src", "dst").distinct(), deg.select("id")), label


def scattered_points(ids: DataFrame, centers: int, spread: float, salt: int = 0) -> DataFrame:
    """(id, x, y): each id a point of the unit torus, evenly over angle and distance within spread of a drawn centre or, as one more choice, anywhere."""
    c = F.floor(uniform(f"c{salt}", "id") * (centers + 1))
    turn, far = uniform(f"t{salt}", "id") * 2 * math.pi, uniform(f"g{salt}", "id") * spread
    frac = lambda x: x - F.floor(x)
    near = c < centers
    x = F.when(near, frac(uniform(f"cx{salt}", c) + far * F.cos(turn))).otherwise(uniform(f"x{salt}", "id"))
    y = F.when(near, frac(uniform(f"cy{salt}", c) + far * F.sin(turn))).otherwise(uniform(f"y{salt}", "id"))
    return ids.select("id", x.alias("x"), y.alias("y"))


def _cells(df: DataFrame, k) -> DataFrame:
    """df with the cell (cx, cy) of (x, y) where k cells make a side of the torus."""
    k = F.lit(k).cast("long") if isinstance(k, int) else k
    return df.withColumns({"cx": F.pmod(F.floor(F.col("x") * k), k), "cy": F.pmod(F.floor(F.col("y") * k), k)})


def _leveled(pts: DataFrame, first: int, most: int, loop) -> DataFrame:
    """pts with level: the finest one, of those with first * 2^level cells a side, whose cell of the point holds over most points; -1 where none does."""
    live, done = pts, None
    for level in range(LEVELS):
        cell = _cells(live, first << level)
        dense = cell.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), ((F.min("x") < F.max("x")) | (F.min("y") < F.max("y"))).alias("go")).where(F.col("n") > most)
        met = loop.put(f"met{level}", cell.join(dense.drop("n"), ["cx", "cy"], "left").select("id", "x", "y", "go"))
        ended = met.where("go is null or not go").select("id", "x", "y", F.when(F.col("go").isNull(), F.lit(level - 1)).otherwise(F.lit(level)).alias("level"))
        done, live = ended if done is None else done.union(ended), met.where("go").select("id", "x", "y")
        if live.isEmpty():
            return done
    return done.union(live.select("id", "x", "y", F.lit(LEVELS - 1).alias("level")))


def _asks(pts: DataFrame, radius: float, most: int, loop) -> tuple[DataFrame, DataFrame]:
    """((m, cx, cy, z, id, x, y, d2), (m, cx, cy, z, id, x, y)): the cells where each point looks for its nearest, no further than the root of d2; and their points.

    A cell that holds over most points has that many others within its diagonal, so a point looks no further, in cells of twice that
    side. Cells of more than CELL points are cut into numbers z.
    """
    first = max(1, int(1 / radius))
    at = loop.put("leveled", _leveled(pts, first, most, loop).withColumn("m", F.greatest(F.col("level") - 1, F.lit(0))))
    k = F.expr(f"shiftleft({first}L, cast(m as int))")
    diagonal = 2.0 / F.pow(F.lit(float(first)) * F.pow(F.lit(2.0), F.col("level")), F.lit(2)) * (1 + 1e-9)
    own = _cells(at.withColumn("d2", F.when(F.col("level") >= 0, F.least(F.lit(radius * radius), diagonal)).otherwise(F.lit(radius * radius))), k)
    gap = {c: {-1: F.pmod(F.col(c) * k, F.lit(1.0)) / k, 0: F.lit(0.0), 1: (1 - F.pmod(F.col(c) * k, F.lit(1.0))) / k} for c in ("x", "y")}
    sides = [F.struct(F.pmod(F.col("cx") + i, k).alias("cx"), F.pmod(F.col("cy") + j, k).alias("cy"), (F.pow(gap["x"][i], F.lit(2)) + F.pow(gap["y"][j], F.lit(2)) <= F.col("d2") * (1 + 1e-6) + 1e-15).alias("near")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    near = F.array_distinct(F.transform(F.filter(F.array(*sides), lambda c: c["near"]), lambda c: F.struct(c["cx"].alias("cx"), c["cy"].alias("cy"))))
    asks = loop.put("asks", own.select("m", "id", "x", "y", "d2", F.explode(near).alias("t")).select("m", "t.cx", "t.cy", "id", "x", "y", "d2"))
    levels = [r.m for r in asks.select("m").distinct().collect()]  # a row for each level
    every = pts.select("id", "x", "y", F.explode(F.array(*[F.lit(m) for m in levels] or [F.lit(0)])).alias("m"))
    every = _cells(every, k).join(asks.select("m", "cx", "cy").distinct(), ["m", "cx", "cy"], "left_semi")
    every = loop.put("every", every.select("m", "cx", "cy", "id", "x", "y"))
    sizes = loop.put("sizes", every.groupBy("m", "cx", "cy").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("zs")))
    asks = asks.join(sizes, ["m", "cx", "cy"]).select("m", "cx", "cy", F.explode(F.sequence(F.lit(0), F.col("zs") - 1)).alias("z"), "id", "x", "y", "d2")
    return asks, every.join(sizes, ["m", "cx", "cy"]).select("m", "cx", "cy", F.pmod(F.xxhash64("id"), F.col("zs")).cast("int").alias("z"), "id", "x", "y")


def _nearest(most: int):
    """For rows in the order of cells, points with a null d2, others asking: the most nearest (a, b, d2) of each that asks."""

    def found(ids, x, y, d2) -> pa.RecordBatch | None:
        asks, here = np.flatnonzero(~np.isnan(d2)), np.flatnonzero(np.isnan(d2))
        out = []
        step = max(1, 1_000_000 // max(1, len(here)))
        for k in range(0, len(asks) if len(here) else 0, step):
            mine = asks[k : k + step]
            gaps = [np.abs(v[mine][:, None] - v[here]) for v in (x, y)]
            gx, gy = (np.minimum(g, 1 - g) for g in gaps)
            far = gx * gx + gy * gy
            far[(far > d2[mine][:, None]) | (ids[mine][:, None] == ids[here])] = np.inf
            if len(here) > most:
                far[far > np.partition(far, most - 1, axis=1)[:, most - 1 : most]] = np.inf
            i, j = np.nonzero(far < np.inf)
            d, b = far[i, j], ids[here[j]]
            order = np.lexsort((b, d, i))
            i, d, b = i[order], d[order], b[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < most
            out.append((ids[mine[i[keep]]], b[keep], d[keep]))
        if out:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b", "d2"])
        return None

    def run(batches):
        held = None
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
            rows = rows if held is None else [np.r_[h, r] for h, r in zip(held, rows, strict=True)]
            n = len(rows[0])
            if not n:
                continue
            new = np.any([np.diff(c) != 0 for c in rows[:4]], axis=0)
            starts = np.r_[0, 1 + np.flatnonzero(new)]
            for i, j in zip(starts, starts[1:]):
                if (got := found(*(c[i:j] for c in rows[4:]))) is not None:
                    yield got
            held = [c[starts[-1] :].copy() for c in rows]
        if held is not None and (got := found(*held[4:])) is not None:
            yield got

    return run


def near_links(pts: DataFrame, radius: float, most: int) -> DataFrame:
    """(src, dst, w): points (id, x, y) of the unit torus of which each is among the other's most nearest within radius. Weight is 0.01 over the squared distance.

    Cells follow the density, so a point meets about as many others however many there are. Of the points at one place only the first by id, one
    more than most, can be among the nearest of any other, so only these can have a link.
    """
    loop = Rounds(pts.sparkSession, "near")
    same = Window.partitionBy("x", "y").orderBy("id")
    first = pts.select("id", "x", "y").where(~F.isnan("x") & ~F.isnan("y")).withColumn("r", F.row_number().over(same)).where(F.col("r") <= most + 1)
    asks, points = _asks(loop.put("points", first.select("id", "x", "y")), radius, most, loop)
    rows = asks.unionByName(points, allowMissingColumns=True).select("m", "cx", "cy", "z", "id", "x", "y", "d2")
    dealt = rows.repartition("m", "cx", "cy", "z").sortWithinPartitions("m", "cx", "cy", "z")
    near = dealt.mapInArrow(_nearest(most), "a long, b long, d2 double")
    w = Window.partitionBy("a").orderBy("d2", "b")
    top = loop.put("top", near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("a", "b", "d2"))
    mutual = top.where("a < b").join(top.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])
    out = cut(mutual.select(F.col("a").alias("src"), F.col("b").alias("dst"), (0.01 / F.greatest("d2", F.lit(1e-12))).alias("w")))
    loop.close()
    return out


def pub_web(spark: SparkSession, n: int, centers: int, radius: float, most: int, salt: int = 0) -> tuple[Graph, DataFrame]:
    """Points around centres on the unit torus; two are linked when each is among the other's most nearest within radius. Weight is 0.01 over the squared distance."""
    c = F.floor(uniform(f"c{salt}", "id") * centers)
    spread = F.sqrt(-2 * F.log(F.greatest(uniform(f"g{salt}", "id"), F.lit(1e-12)))) * radius
    turn = uniform(f"t{salt}", "id") * 2 * math.pi
    frac = lambda x: x - F.floor(x)
    pts = spark.range(n).select("id", frac(uniform(f"cx{salt}", c) + spread * F.cos(turn)).alias("x"), frac(uniform(f"cy{salt}", c) + spread * F.sin(turn)).alias("y"))
    return Graph.from_edges(near_links(pts, radius, most), pts.select("id")), pts
