"""A multilevel solver for graph Laplacians and other symmetric matrices with non-positive entries off the diagonal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.hashrand import uniform
from graphloom.graph import Graph
from graphloom.operators.matching import luby
from graphloom.plans.fixpoint import Rounds, cut


@dataclass
class Level:
    """A matrix and the way to the next coarser one.

    kind "eliminate": rows (f, c, p) give each eliminated row f as a combination of its neighbours c; what they add to it is
    exact. kind "aggregate": rows (i, c) give each row's aggregate.
    """

    kind: str
    matrix: DataFrame  # (i, j, v)
    diagonal: DataFrame  # (i, d), 1 / the diagonal, 0 where that is 0
    coarse: DataFrame
    rows: int


class Hierarchy:
    """Levels made once for a matrix; cycle() is one V-cycle, solve() conjugate gradients with V-cycles before them.

    Rows of few neighbours, no two of them adjacent, are eliminated exactly as long as that takes a share `worth` of a level; else
    rows join the neighbouring centre (a maximal independent set) to which random vectors, smoothed a few times, tie them most
    (their affinity), and each aggregate becomes one row. The coarsest matrix has at most `coarsest` rows and is solved on the
    driver; that bound holds for any input, since every level is smaller than the one before.
    """

    def __init__(self, m: DataFrame, coarsest: int = 200, few: int = 4, worth: float = 0.2, vectors: int = 4, omega: float = 0.66):
        self.loop = Rounds(m.sparkSession, "multigrid")
        self.coarsest, self.few, self.worth, self.vectors, self.omega = coarsest, few, worth, vectors, omega
        self.levels: list[Level] = []
        now = self.loop.put("m0", m.groupBy("i", "j").agg(F.sum(F.col("v").cast("double")).alias("v")))
        n = now.select("i").distinct().count()
        while n > coarsest:
            level = self._eliminated(now, n) or self._aggregated(now, n)
            if level is None:
                break
            self.levels.append(level)
            now = self._coarser(level)
            n = now.select("i").distinct().count()
        self.last, self.rows = now, n
        self.inverse = None
        if n <= coarsest:
            found = now.collect()  # at most coarsest ** 2 entries
            self.ids = sorted({r.i for r in found})
            at = {k: c for c, k in enumerate(self.ids)}
            a = np.zeros((n, n))
            for r in found:
                a[at[r.i], at[r.j]] = r.v
            self.inverse = np.linalg.pinv(a, rcond=1e-12, hermitian=True)

    def _diagonal(self, m: DataFrame) -> DataFrame:
        return self.loop.put(f"d{len(self.levels)}", m.groupBy("i").agg(F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))), F.lit(0.0)).alias("d")).select("i", F.when(F.abs("d") > 1e-12, 1 / F.col("d")).otherwise(0.0).alias("d")))

    def _eliminated(self, m: DataFrame, n: int) -> Level | None:
        at = len(self.levels)
        off = m.where("i <> j and v <> 0")
        rows = m.select("i").distinct().join(off.groupBy("i").agg(F.count(F.lit(1)).alias("n")), "i", "left").fillna(0, ["n"])
        low = self.loop.put(f"low{at}", rows.where(F.col("n") <= self.few).select("i", F.struct(uniform(f"low{at}", "i").alias("u"), "i").alias("r")))
        rival = off.join(low.select("i"), "i", "left_semi").join(low.select(F.col("i").alias("j"), F.col("r").alias("q")), "j").groupBy("i").agg(F.min("q").alias("q"))
        gone = self.loop.put(f"gone{at}", low.join(rival, "i", "left").where("q is null or r < q").select("i"))
        if gone.count() < self.worth * n:
            return None
        d = self._diagonal(m)
        p = off.join(gone, "i", "left_semi").join(d, "i").select(F.col("i").alias("f"), F.col("j").alias("c"), (-F.col("v") * F.col("d")).alias("p"))
        return Level("eliminate", m, d, self.loop.put(f"p{at}", gone.withColumnRenamed("i", "f").join(p, "f", "left")), n)

    def _aggregated(self, m: DataFrame, n: int) -> Level | None:
        at, k = len(self.levels), range(self.vectors)
        d = self._diagonal(m)
        off = m.where("i <> j and v <> 0")
        x = d.select("i", "d", *[(uniform(f"grid{at}:{c}", "i") - 0.5).alias(f"x{c}") for c in k])
        for _ in range(3):
            got = off.join(x.select(F.col("i").alias("j"), *[f"x{c}" for c in k]), "j").groupBy("i").agg(*[F.sum(F.col("v") * F.col(f"x{c}")).alias(f"s{c}") for c in k])
            x = self.loop.put(f"x{at}", x.join(got, "i", "left").select("i", "d", *[(0.4 * F.col(f"x{c}") - 0.6 * F.col("d") * F.coalesce(f"s{c}", F.lit(0.0))).alias(f"x{c}") for c in k]))
        nodes = m.select(F.col("i").alias("id")).distinct()
        edges = off.where("i < j").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1.0).alias("w"))
        centres = luby(Graph(nodes, edges), at).select(F.col("id").alias("c"))
        a = x.select("i", F.array(*[f"x{c}" for c in k]).alias("a"))
        dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
        ties = off.join(centres, off.j == centres.c).join(a, "i").join(a.select(F.col("i").alias("c"), F.col("a").alias("b")), "c")
        affinity = F.pow(dot("a", "b"), F.lit(2)) / (dot("a", "a") * dot("b", "b") + 1e-300)
        joined = ties.groupBy("i").agg(F.max_by("c", F.struct(affinity.alias("t"), -F.col("v"), -F.col("c"))).alias("c"))
        p = self.loop.put(f"p{at}", joined.join(centres.select(F.col("c").alias("i")), "i", "left_anti").union(centres.select("c", F.col("c").alias("c2"))))
        if p.select("c").distinct().count() > 0.95 * n:
            return None
        return Level("aggregate", m, d, p, n)

    def _coarser(self, level: Level) -> DataFrame:
        m, p = level.matrix, level.coarse
        if level.kind == "aggregate":
            rows, cols = p.select("i", F.col("c").alias("a")), p.select(F.col("i").alias("j"), F.col("c").alias("b"))
            coarse = m.join(rows, "i").join(cols, "j").groupBy(F.col("a").alias("i"), F.col("b").alias("j")).agg(F.sum("v").alias("v"))
        else:
            gone = p.select(F.col("f").alias("i")).distinct()
            kept = m.join(gone, "i", "left_anti").join(gone.withColumnRenamed("i", "j"), "j", "left_anti").select("i", "j", "v")
            ways = p.where("c is not null")
            through = ways.select("f", F.col("c").alias("i"), F.col("p").alias("q")).join(m.select(F.col("i").alias("f"), "j", "v").where("f <> j"), "f").select("i", "j", (F.col("q") * F.col("v")).alias("v"))
            coarse = kept.union(through).groupBy("i", "j").agg(F.sum("v").alias("v"))
        return self.loop.put(f"m{len(self.levels)}", coarse)

    def cycle(self, b: DataFrame, at: int = 0) -> DataFrame:
        """(i, v): one V-cycle for the right side b (i, v), from a start of zero."""
        if at == len(self.levels):
            return self._solved(b)
        level = self.levels[at]
        d, p = level.diagonal, level.coarse
        if level.kind == "eliminate":
            down = b.join(p.where("c is not null").withColumnRenamed("f", "i"), "i").select(F.col("c").alias("i"), (F.col("v") * F.col("p")).alias("v"))
            gone = p.select(F.col("f").alias("i")).distinct()
            rest = b.join(gone, "i", "left_anti").select("i", "v").union(down).groupBy("i").agg(F.sum("v").alias("v"))
            x = self.cycle(self.loop.put(f"b{at + 1}", rest), at + 1)
            back = p.where("c is not null").join(x.select(F.col("i").alias("c"), "v"), "c").select(F.col("f").alias("i"), (F.col("p") * F.col("v")).alias("v"))
            own = b.join(gone, "i", "left_semi").join(d, "i").select("i", (F.col("v") * F.col("d")).alias("v"))
            return self.loop.put(f"y{at}", x.select("i", "v").union(back.union(own).groupBy("i").agg(F.sum("v").alias("v"))))
        x = b.join(d, "i").select("i", F.col("v").alias("b"), "d", (self.omega * F.col("d") * F.col("v")).alias("x"))
        state = self.loop.put(f"s{at}", self._residual(level, x))
        down = state.join(p, "i").groupBy(F.col("c").alias("i")).agg(F.sum("r").alias("v"))
        y = self.cycle(self.loop.put(f"b{at + 1}", down), at + 1)
        up = p.join(y.select(F.col("i").alias("c"), "v"), "c", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("up"))
        x = state.join(up, "i").select("i", "b", "d", (F.col("x") + F.col("up")).alias("x"))
        x = self.loop.put(f"z{at}", x)
        return self.loop.put(f"y{at}", self._residual(level, x).select("i", (F.col("x") + self.omega * F.col("d") * F.col("r")).alias("v")))

    def _residual(self, level: Level, x: DataFrame) -> DataFrame:
        got = level.matrix.join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("ax"))
        return x.join(got, "i", "left").select("i", "b", "d", "x", (F.col("b") - F.coalesce("ax", F.lit(0.0))).alias("r"))

    def _solved(self, b: DataFrame) -> DataFrame:
        if self.inverse is None:
            from graphloom.operators.algebra import conjugate_gradient

            return conjugate_gradient(self.last, b, tol=1e-10, rounds=5000)
        right = {r.i: r.v for r in b.collect()}  # at most coarsest rows
        x = self.inverse @ np.array([right.get(i, 0.0) for i in self.ids])
        return b.sparkSession.createDataFrame([(i, float(v)) for i, v in zip(self.ids, x, strict=True)], "i long, v double")

    def solve(self, rhs: DataFrame, tol: float = 1e-8, rounds: int = 100) -> tuple[DataFrame, int]:
        """The solution (i, v) and the number of rounds; raises if the residual does not fall to tol of the right side within `rounds`. For a Laplacian the right side sums to zero in each component."""
        m = self.levels[0].matrix if self.levels else self.last
        ids = m.select("i").distinct()
        state = self.loop.put("cg", ids.join(rhs.select("i", F.col("v").cast("double").alias("r")), "i", "left").fillna(0.0, ["r"]).select("i", F.lit(0.0).alias("x"), "r", F.lit(0.0).alias("p")))
        goal, last = tol * (state.agg(F.sqrt(F.sum(F.col("r") * F.col("r")))).first()[0] or 0.0), None
        for turn in range(rounds):
            z = self.cycle(state.select("i", F.col("r").alias("v")))
            with_z = self.loop.put("cgz", state.join(z.withColumnRenamed("v", "z"), "i", "left").fillna(0.0, ["z"]))
            rz = with_z.agg(F.sum(F.col("r") * F.col("z"))).first()[0] or 0.0
            beta = 0.0 if last is None or last == 0 else rz / last
            state = with_z.select("i", "x", "r", (F.col("z") + beta * F.col("p")).alias("p"))
            q = m.join(state.select(F.col("i").alias("j"), "p"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("p")).alias("q"))
            state = self.loop.put("cgq", state.join(q, "i", "left").fillna(0.0, ["q"]))
            pq = state.agg(F.sum(F.col("p") * F.col("q"))).first()[0] or 0.0
            step = rz / pq if pq > 0 else 0.0
            state = self.loop.put("cg", state.select("i", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("q")).alias("r"), "p"))
            left = state.agg(F.sqrt(F.sum(F.col("r") * F.col("r")))).first()[0] or 0.0
            last = rz
            if left <= goal or not step:
                if left > max(goal, 1e-300):
                    break
                return cut(state.select("i", F.col("x").alias("v"))), turn + 1
        raise RuntimeError(f"no solution within {rounds} rounds")

    def close(self) -> None:
        self.loop.close()


def solve(m: DataFrame, rhs: DataFrame, tol: float = 1e-8) -> DataFrame:
    """(i, v): the solution of m x = rhs by a hierarchy of its own."""
    h = Hierarchy(m)
    x, _ = h.solve(rhs, tol)
    h.close()
    return x
