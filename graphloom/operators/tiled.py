"""Searches from many sources at once, as products of a graph's tiles with blocks of vectors.

Nodes are numbered by (component, id) and cut into blocks of SIDE; the arcs between two blocks are a tile. A search's state is a row for
each block of nodes and block of sources that meet: matrices of distances and path counts, ten bytes a pair. A round joins tiles with the
rows that hold the last level, multiplies, and adds up what comes to the same row, so a task holds a few matrices however large the
graph is, and arcs are sent once for a block of sources, not once for each. Laplacian systems of many sources are solved in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, numbered
from graphloom.plans import fixpoint
from graphloom.plans.fixpoint import Rounds, cut

#: Nodes of a block.
SIDE = 256
#: Sources of a block, at most.
WIDE = 128
#: Bytes of matrices to a partition, about.
ROOM = 24_000_000
#: Arcs to a partition while they are packed to tiles, about.
PACKED = 1_000_000

_STATE = "b long, s long, dist binary, paths binary, dep binary"
_PART = "b long, s long, m binary"
_SOLVING = "b long, s long, deg binary, x binary, r binary, p binary, q binary, w binary, dots binary"


def _block(c: str, side: int) -> Column:
    return F.floor(F.col(c) / side).cast("long")


def _inner(c: str, side: int) -> Column:
    return F.pmod(F.col(c), F.lit(side)).cast("int")


class Tiled:
    """Places of nodes, numbers of sources and the tiles of arcs (src, dst, w) between blocks."""

    def __init__(self, g: Graph, sources: DataFrame, arcs: DataFrame):
        side = self.side = SIDE
        spark = g.nodes.sparkSession
        self.loop = Rounds(spark, "tiled")
        arcs = self.arcs = self.loop.put("arcs", arcs)
        comp = fixpoint.components(arcs)
        ids = g.nodes.select("id").union(sources.select("id")).distinct().join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        self.places = self.loop.put("places", numbered(ids, ["component", "id"], "at"))
        self.sources = self.loop.put("sources", numbered(sources.select("id").distinct().join(self.places, "id"), ["at"], "no").select(F.col("id").alias("source"), "at", "no"))
        self.n = self.sources.count()
        self.wide = max(1, min(WIDE, self.n))
        a, b = (self.places.select(F.col("id").alias(c), F.col("at").alias(f"at_{c}")) for c in ("src", "dst"))
        cell = _inner("at_dst", side) * side + _inner("at_src", side)
        placed = arcs.join(a, "src").join(b, "dst").select(_block("at_dst", side).alias("to"), _block("at_src", side).alias("from"), cell.alias("cell"), "w")
        self.least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = placed.repartition(max(self.least, math.ceil(arcs.count() / PACKED)), "to", "from").sortWithinPartitions("to", "from")
        self.tiles = self.loop.put("tiles", dealt.mapInArrow(_packed, "to long, from long, cells binary, ws binary"))

    def _parts(self) -> int:
        """Partitions for the state's rows: they grow with it, so what a task holds does not."""
        return max(self.least, math.ceil(self.state.count() * self.side * self.wide * self.bytes / ROOM))

    def _multiplied(self, front: DataFrame, back: bool = False) -> DataFrame:
        """(b, s, m): the product of each tile with the blocks (b, s, m) of vectors that it meets; back: from heads to tails."""
        side, wide = self.side, self.wide

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for to, s, cells, ws, m in zip(*(batch.column(i) for i in range(5)), strict=True):
                    tile = np.zeros(side * side)
                    tile[np.frombuffer(cells.as_buffer(), np.int32)] = np.frombuffer(ws.as_buffer())
                    tile = tile.reshape(side, side)
                    out = (tile.T if back else tile) @ np.frombuffer(m.as_buffer()).reshape(side, wide)
                    yield pa.RecordBatch.from_arrays([pa.array([to.as_py()]), pa.array([s.as_py()]), pa.array([out.tobytes()], pa.binary())], names=["b", "s", "m"])

        to, from_ = ("from", "to") if back else ("to", "from")
        # matrices pack well in files, so their sizes there must not make Spark broadcast them; what a merge holds of a block is its arcs, not its vectors
        met = front.repartition(self._parts(), "b").hint("merge").join(self.tiles.select(F.col(to).alias("to"), F.col(from_).alias("b"), "cells", "ws"), "b")
        return met.select("to", "s", "cells", "ws", "m").mapInArrow(multiply, _PART)

    def close(self) -> None:
        self.loop.close()


class Searches(Tiled):
    """Breadth-first searches from all sources (id); nodes that no arc leaves or enters are only reached from themselves."""

    #: Of a pair of node and source.
    bytes = 18

    def __init__(self, g: Graph, sources: DataFrame):
        super().__init__(g, sources, g.both().where("src <> dst").select("src", "dst", F.lit(1.0).alias("w")).distinct())
        self.depth = 0
        self.state = self._start()
        self._forward()

    def _start(self) -> DataFrame:
        side, wide = self.side, self.wide
        rows = self.sources.select(_block("at", side).alias("b"), _block("no", wide).alias("s"), (_inner("at", side) * wide + _inner("no", wide)).alias("cell"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, s, cells in zip(*(batch.column(i) for i in range(3)), strict=True):
                    dist, paths = np.full(side * wide, -1, np.int16), np.zeros(side * wide)
                    at = cells.values.to_numpy()
                    dist[at], paths[at] = 0, 1
                    yield _row(b.as_py(), s.as_py(), dist, paths, np.zeros(side * wide))

        return self.loop.put("state", rows.groupBy("b", "s").agg(F.collect_list("cell").alias("cells")).mapInArrow(run, _STATE))

    def _product(self, made: Callable, back: bool) -> DataFrame:
        """(b, s, m): for each tile the matrix of sums over its arcs of what made(dist, paths, dep) gives at their other ends; back: from heads to tails."""
        side, wide = self.side, self.wide

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, s, *m in zip(*(batch.column(i) for i in range(5)), strict=True):
                    v = made(*_matrices(m, side, wide))
                    if v.any():
                        yield pa.RecordBatch.from_arrays([pa.array([b.as_py()]), pa.array([s.as_py()]), pa.array([v.tobytes()], pa.binary())], names=["b", "s", "m"])

        return self._multiplied(self.loop.put("front", self.state.mapInArrow(vectors, _PART)), back)

    def _step(self, product: DataFrame, new: Callable) -> None:
        """new(dist, paths, dep, sums) changes a row's matrices in place; rows without a state begin with nothing reached."""
        side, wide = self.side, self.wide

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, mats, sums = None, None, None

            def done():
                m = mats if mats is not None else [np.full((side, wide), -1, np.int16), np.zeros((side, wide)), np.zeros((side, wide))]
                if sums is not None:
                    new(*m, sums)
                return _row(*key, *m)

            for batch in batches:
                for b, s, *m, part in zip(*(batch.column(i) for i in range(6)), strict=True):
                    at = (b.as_py(), s.as_py())
                    if at != key:
                        if key is not None:
                            yield done()
                        key, mats, sums = at, None, None
                    if part.is_valid:
                        v = np.frombuffer(part.as_buffer()).reshape(side, wide)
                        sums = v.copy() if sums is None else np.add(sums, v, out=sums)
                    else:
                        mats = [x.copy() for x in _matrices(m, side, wide)]
            if key is not None:
                yield done()

        both = self.state.withColumn("m", F.lit(None).cast("binary")).unionByName(product, allowMissingColumns=True)
        dealt = both.repartition(self._parts(), "b", "s").sortWithinPartitions("b", "s")
        self.state = self.loop.put("state", dealt.select("b", "s", "dist", "paths", "dep", "m").mapInArrow(run, _STATE))

    def _forward(self) -> None:
        while True:
            level = self.depth
            product = self.loop.put("product", self._product(lambda dist, paths, dep: np.where(dist == level, paths, 0.0), False))
            if product.isEmpty():
                return

            def reach(dist, paths, dep, sums):
                fresh = (sums > 0) & (dist < 0)
                dist[fresh] = level + 1
                paths[fresh] = sums[fresh]

            self._step(product, reach)
            self.depth += 1

    def reached(self) -> DataFrame:
        """(source, id, dist, paths)."""
        side, wide = self.side, self.wide

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, s, *m in zip(*(batch.column(i) for i in range(5)), strict=True):
                    dist, paths, _ = _matrices(m, side, wide)
                    i, j = np.nonzero(dist >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(b.as_py() * side + i), pa.array(s.as_py() * wide + j), pa.array(dist[i, j].astype(np.int64)), pa.array(paths[i, j])], names=["at", "no", "dist", "paths"])

        rows = self.state.mapInArrow(run, "at long, no long, dist long, paths double")
        return rows.join(self.sources.select("source", "no"), "no").join(self.places.select("id", "at"), "at").select("source", "id", "dist", "paths")

    def dependencies(self) -> DataFrame:
        """(id, score): the sum over sources of their dependencies on each node (Brandes), passed back one level a round."""
        side, wide = self.side, self.wide
        for level in range(self.depth, 1, -1):

            def pass_on(dist, paths, dep, level=level):
                return np.where(dist == level, (1 + dep) / np.where(dist == level, paths, 1.0), 0.0)

            def take(dist, paths, dep, sums, level=level):
                here = dist == level - 1
                dep[here] = paths[here] * sums[here]

            self._step(self._product(pass_on, True), take)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, dep in zip(batch.column(0), batch.column(4), strict=True):
                    sums = np.frombuffer(dep.as_buffer()).reshape(side, wide).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(b.as_py() * side + np.arange(side)), pa.array(sums)], names=["at", "score"])

        rows = self.state.mapInArrow(run, "at long, score double").groupBy("at").agg(F.sum("score").alias("score"))
        return self.places.join(rows, "at", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


class Solves(Tiled):
    """Columns of the Laplacian's pseudo-inverse for all sources (id), by conjugate gradients with the degrees as preconditioner.

    A row for each block of nodes and block of sources that have a component in common holds solution, residual, direction, its image and
    the residual's image. A round is one product and one sum for each column (Chronopoulos and Gear); columns whose residual is no
    longer than tol stay as they are. Raises if one is left after `rounds`.
    """

    #: Of a pair of node and source.
    bytes = 48

    def __init__(self, g: Graph, sources: DataFrame, tol: float = 1e-8, rounds: int = 2000):
        super().__init__(g, sources, g.both().where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w")))
        self.state = self._start()
        scalars = None
        for _ in range(rounds + 1):
            scalars = self._scalars(scalars, tol)
            if not scalars.where("open > 0").limit(1).count():
                return
            self._round(scalars)
        raise RuntimeError(f"no solution within {rounds} rounds")

    def _start(self) -> DataFrame:
        """x = 0 and the residual of each source: one at its place, less a share of its component."""
        side, wide = self.side, self.wide
        degrees = self.arcs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg"))
        sizes = self.places.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        nodes = self.places.join(degrees, "id", "left").select("component", _block("at", side).alias("b"), F.struct(_inner("at", side).alias("i"), F.coalesce("deg", F.lit(0.0)).alias("deg"), "component").alias("r"))
        sources = self.sources.join(self.places, "at").join(sizes, "component").select("component", _block("no", wide).alias("s"), F.struct(_inner("no", wide).alias("j"), "at", "size", "component").alias("r"))
        pairs = nodes.select("component", "b").distinct().join(sources.select("component", "s").distinct(), "component").select("b", "s").distinct()
        rows = nodes.groupBy("b").agg(F.collect_list("r").alias("n")).join(pairs, "b").join(sources.groupBy("s").agg(F.collect_list("r").alias("q")), "s")
        columns = [F.col(f"{a}.{c}").alias(f"{a}_{c}") for a, cs in (("n", ("i", "deg", "component")), ("q", ("j", "at", "size", "component"))) for c in cs]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, s, *lists in zip(*(batch.column(k) for k in range(9)), strict=True):
                    i, deg, own, j, at, size, of = (x.values.to_numpy() for x in lists)
                    d, r, zero = np.zeros((side, 1)), np.zeros((side, wide)), np.zeros((side, wide))
                    d[i, 0] = deg
                    r[np.ix_(i, j)] = (b.as_py() * side + i[:, None] == at) - (own[:, None] == of) / size
                    yield _solving(b.as_py(), s.as_py(), d, zero, r, zero, zero, zero)

        return self.loop.put("state", rows.select("b", "s", *columns).mapInArrow(run, _SOLVING))

    def _scalars(self, before: DataFrame | None, tol: float) -> DataFrame:
        """(s, alpha, beta, gamma, open): the next step of each column, and how many are not done."""
        wide = self.wide
        rows = self.state.select("s", "dots", F.lit(None).cast("binary").alias("alpha"))
        if before is not None:
            rows = rows.unionByName(before.select("s", F.col("gamma").alias("dots"), "alpha"))

        def run(pdf):
            import pandas as pd

            old = pdf[pdf["alpha"].notna()]
            rr, gamma, delta = sum(np.frombuffer(d).reshape(3, wide) for d in pdf.loc[pdf["alpha"].isna(), "dots"])
            # a column that stood still begins anew
            was, step = (np.frombuffer(old[c].iloc[0]) if len(old) else np.zeros(wide) for c in ("dots", "alpha"))
            going = (rr > tol * tol) & (gamma > 0)
            beta = np.where(going & (step > 0), gamma / np.where(was > 0, was, 1.0), 0.0)
            below = delta - np.where(step > 0, beta * gamma / np.where(step > 0, step, 1.0), 0.0)
            alpha = np.where(going & (below > 0), gamma / np.where(below > 0, below, 1.0), 0.0)
            return pd.DataFrame({"s": [int(pdf["s"].iloc[0])], "alpha": [alpha.tobytes()], "beta": [beta.tobytes()], "gamma": [gamma.tobytes()], "open": [int(going.sum())]})

        return self.loop.put("scalars", rows.groupBy("s").applyInPandas(run, "s long, alpha binary, beta binary, gamma binary, open long"))

    def _round(self, scalars: DataFrame) -> None:
        side, wide = self.side, self.wide

        def moved(deg, x, r, p, q, w, alpha, beta):
            # columns that stand still keep everything but the images, which are made anew
            p = _scaled(r, deg) + beta * p
            q = w + beta * q
            return x + alpha * p, r - alpha * q, p, q

        def front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, s, deg, *m in _solved(batches, side, wide):
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([s]), pa.array([_scaled(moved(deg, *m)[1], deg).tobytes()], pa.binary())], names=["b", "s", "m"])

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, s, deg, *m in _solved(batches, side, wide):
                yield _solving(b, s, deg, *moved(deg, *m), np.zeros((side, wide)))

        def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, mats, sums = None, None, None

            def done():
                deg, x, r, p, q, _ = mats
                return _solving(*key, deg, x, r, p, q, deg * _scaled(r, deg) - (0 if sums is None else sums))

            for batch in batches:
                for b, s, *m, part in zip(*(batch.column(i) for i in range(9)), strict=True):
                    at = (b.as_py(), s.as_py())
                    if at != key:
                        if mats is not None:
                            yield done()
                        key, mats, sums = at, None, None
                    if part.is_valid:
                        v = np.frombuffer(part.as_buffer()).reshape(side, wide)
                        sums = v.copy() if sums is None else np.add(sums, v, out=sums)
                    else:
                        mats = [np.frombuffer(v.as_buffer()).reshape(side, -1).copy() for v in m]
            if mats is not None:
                yield done()

        matrices = ["deg", "x", "r", "p", "q", "w"]
        going = self.state.select("b", "s", *matrices).join(scalars.select("s", "alpha", "beta"), "s").select("b", "s", *matrices, "alpha", "beta")
        product = self._multiplied(self.loop.put("front", going.mapInArrow(front, _PART)))
        both = going.mapInArrow(step, _SOLVING).drop("dots").withColumn("m", F.lit(None).cast("binary")).unionByName(product, allowMissingColumns=True)
        dealt = both.repartition(self._parts(), "b", "s").sortWithinPartitions("b", "s")
        self.state = self.loop.put("state", dealt.select("b", "s", *matrices, "m").mapInArrow(images, _SOLVING))

    def entries(self, cells: DataFrame) -> DataFrame:
        """(at, no, v): the solution at these places (at, no) of nodes and numbers of sources."""
        side, wide = self.side, self.wide
        asked = cells.select("at", "no").distinct().groupBy(_block("at", side).alias("b"), _block("no", wide).alias("s")).agg(F.collect_list(_inner("at", side) * wide + _inner("no", wide)).alias("cells"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, s, x, cells in zip(*(batch.column(i) for i in range(4)), strict=True):
                    c = cells.values.to_numpy().astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(b.as_py() * side + c // wide), pa.array(s.as_py() * wide + c % wide), pa.array(np.frombuffer(x.as_buffer())[c])], names=["at", "no", "v"])

        return self.state.select("b", "s", "x").hint("merge").join(asked, ["b", "s"]).select("b", "s", "x", "cells").mapInArrow(run, "at long, no long, v double")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arcs (to, from, cell, w) in the order of their tiles as a row for each tile."""
    key, cells, ws = None, [], []

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([np.concatenate(cells).tobytes()], pa.binary()), pa.array([np.concatenate(ws).tobytes()], pa.binary())], names=["to", "from", "cells", "ws"])

    for batch in batches:
        to, from_, cell, w = (batch.column(i).to_numpy() for i in range(4))
        if not len(to):
            continue
        starts = np.r_[0, 1 + np.flatnonzero((np.diff(to) != 0) | (np.diff(from_) != 0))]
        for i, j in zip(starts, [*starts[1:], len(to)], strict=True):
            at = (int(to[i]), int(from_[i]))
            if at != key:
                if key is not None:
                    yield done()
                key, cells, ws = at, [], []
            cells.append(cell[i:j].copy())
            ws.append(w[i:j].copy())
    if key is not None:
        yield done()


def _scaled(r: np.ndarray, deg: np.ndarray) -> np.ndarray:
    return r / np.where(deg > 0, deg, 1.0) * (deg > 0)


def _solved(batches: Iterator[pa.RecordBatch], side: int, wide: int) -> Iterator[tuple]:
    for batch in batches:
        for b, s, *m in zip(*(batch.column(i) for i in range(10)), strict=True):
            yield (b.as_py(), s.as_py(), *(np.frombuffer(v.as_buffer()).reshape(side, -1) for v in m[:6]), *(np.frombuffer(v.as_buffer()) for v in m[6:]))


def _solving(b: int, s: int, deg: np.ndarray, x: np.ndarray, r: np.ndarray, p: np.ndarray, q: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    u = _scaled(r, deg)
    dots = np.stack([(r * r).sum(0), (r * u).sum(0), (w * u).sum(0)])
    return pa.RecordBatch.from_arrays([pa.array([b]), pa.array([s]), *(pa.array([v.tobytes()], pa.binary()) for v in (deg, x, r, p, q, w, dots))], names=["b", "s", "deg", "x", "r", "p", "q", "w", "dots"])


def _matrices(m: list, side: int, wide: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), t).reshape(side, wide) for x, t in zip(m, (np.int16, np.float64, np.float64), strict=True)]


def _row(b: int, s: int, *m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b]), pa.array([s]), *(pa.array([x.tobytes()], pa.binary()) for x in m)], names=["b", "s", "dist", "paths", "dep"])


def bfs(g: Graph, sources: DataFrame) -> DataFrame:
    """(source, id, dist, paths), as traversal.bfs finds them, for sources that are many."""
    search = Searches(g, sources)
    out = cut(search.reached())
    search.close()
    return out


def betweenness(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(id, score): Brandes with both directions counted, from all nodes or the given sources."""
    search = Searches(g, g.nodes if sources is None else sources)
    found = cut(search.dependencies())
    search.close()
    return g.nodes.join(found, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def resistances(g: Graph, pairs: DataFrame, tol: float = 1e-8, rounds: int = 2000) -> DataFrame:
    """(src, dst, r): effective resistances, infinite between components, from one solve for each node of pairs."""
    p = cut(pairs.select("src", "dst").distinct())
    solves = Solves(g, p.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), tol, rounds)
    known = solves.sources.join(solves.places.select("at", "component"), "at")
    a, b = (known.select(F.col("source").alias(c), F.col("at").alias(f"at_{c}"), F.col("no").alias(f"no_{c}"), F.col("component").alias(f"in_{c}")) for c in ("src", "dst"))
    placed = cut(p.join(a, "src").join(b, "dst"))
    inside = placed.where("in_src = in_dst")
    cells = F.explode(F.array(*(F.struct(F.col(f"at_{x}").alias("at"), F.col(f"no_{y}").alias("no"), F.lit(1.0 if x == y else -1.0).alias("sign")) for x in ("src", "dst") for y in ("src", "dst"))))
    asked = cut(inside.select("src", "dst", cells.alias("c")).select("src", "dst", "c.*"))
    found = asked.join(solves.entries(asked), ["at", "no"]).groupBy("src", "dst").agg(F.sum(F.col("sign") * F.col("v")).alias("r"))
    out = cut(found.union(placed.where("in_src <> in_dst").select("src", "dst", F.lit(float("inf")))))
    solves.close()
    return out
