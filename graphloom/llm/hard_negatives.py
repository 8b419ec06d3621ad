"""Operator 13: hard negatives by inner product, sought through a pivot table.

With M the greatest length of a vector, x becomes (x, sqrt(M^2 - |x|^2)) and an anchor q becomes (q, 0). Then
|q' - x'|^2 = M^2 + |q|^2 - 2 q.x, so a greater inner product is a smaller distance. Each vector is stored with its
distances to `pivots` augmented vectors, and belongs to the cell of its nearest pivot. From |d(q,p) - d(x,p)| <=
d(q,x) <= d(q,p) + d(x,p) over all pivots p follows a bracket of the score: first for a whole cell, from the least
and the greatest distance that its members have to each pivot, then for each vector. Only what the brackets
leave open is checked by the exact inner product.

An anchor looks into one cell first, that of the greatest possible score; its k-th best score there rules out
most of the other cells and vectors. Work is dealt by (cell, block of vectors, group of anchors), both sides
bounded by `block_bytes`, so that a cell of a third of all vectors is many tasks' work, and each task
returns at most k rows for each anchor and list. The pivots come from a bounded sample of the vectors; they
decide about speed only, since brackets hold for any pivots. To the driver come the pivots and, for each pair of
pivot and cell, two distances.

Defined cases: vectors that are null, or hold null or non-finite components, or are of a null label or of
a null id take no part, nor do those whose length is not the table's most common one (of equally common ones the
least); rows that repeat an id are one, the least by label and content; equal scores go by the smaller
id; an anchor without another row of its label has no positives and no rows; other columns are unread; an
empty table gives no rows. Scores are exact where they and the squares of lengths are integers below 2^53.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.plans.fixpoint import cut, remove, shared_dir

#: Share of the squared lengths by which brackets are widened against rounding.
SLACK = 1e-6
#: Bracket cells (anchors x vectors) held at once in a task.
CELLS = 1 << 20
STEP = 256


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)


class Pivots:
    """Augmented vectors and the distances to them."""

    def __init__(self, sample: np.ndarray, most: float, k: int):
        """k pivots of the sample, each farthest from those before; the first is the longest vector."""
        self.most = most
        tail = np.sqrt(np.maximum(most - (sample**2).sum(1), 0))
        full = np.c_[sample, tail]
        chosen = [int((sample**2).sum(1).argmax())] if len(sample) else []
        near = np.full(len(full), np.inf)
        while chosen and len(chosen) < min(k, len(full)):
            near = np.minimum(near, ((full - full[chosen[-1]]) ** 2).sum(1))
            if near.max() <= 0:
                break
            chosen.append(int(near.argmax()))
        self.points = full[np.array(chosen, np.int64)]

    def distances(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        square = (x**2).sum(1)
        tail = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.most - square, 0))
        p = self.points
        d = (square + tail**2)[:, None] + (p**2).sum(1) - 2 * (x @ p[:, :-1].T + tail[:, None] * p[:, -1])
        return np.sqrt(np.maximum(d, 0))

    def scores(self, distance: np.ndarray, square: np.ndarray) -> np.ndarray:
        return (self.most + square - distance**2) / 2

    def slack(self, square: np.ndarray) -> np.ndarray:
        return SLACK * (self.most + square) + SLACK


def usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, x) of the rows that take part; ids may still repeat."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x")).where("id is not null and label is not null and x is not null")
    v = v.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    common = v.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return v.join(F.broadcast(common.select("d")), F.size("x") == F.col("d")).drop("d")  # one row


class Search:
    """The pivot table of all vectors, written to the shared folder, and top-k searches of anchors in it."""

    def __init__(self, vectors: DataFrame, pivots: int = 16, sample: int = 4096, block_bytes: int = 32 << 20):
        spark = vectors.sparkSession
        most = vectors.agg(F.coalesce(F.max(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)), F.lit(0.0))).first()[0]
        some = vectors.orderBy(F.xxhash64("id"), "id", "label", "x").limit(sample).select("x").collect()  # bounded by sample
        self.pivots = table_of = Pivots(np.array([r.x for r in some]) if some else np.zeros((0, 1)), most, pivots)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    far = table_of.distances(_matrix(b.column(2), b.num_rows))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, far.shape[1]), pa.int32()), pa.array(far.ravel()))
                    yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(far.argmin(1), pa.int32())], names=["id", "label", "x", "far", "cell"])

        one = vectors.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x")
        self.path = f"{shared_dir(spark).rstrip('/')}/pivots-{uuid.uuid4().hex}"
        one.mapInArrow(run, "id long, label long, x array<double>, far array<double>, cell int").write.parquet(self.path)
        self.table = spark.read.parquet(self.path)
        k = len(self.pivots.points)
        found = self.table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(F.col("far")[j]).alias(f"{name}{j}") for j in range(k) for name, f in (("lo", F.min), ("hi", F.max))]).collect()  # a row for each pivot
        self.cells = np.array([r.cell for r in found], np.int64)
        self.low = np.array([[r[f"lo{j}"] for j in range(k)] for r in found]).reshape(len(found), k)
        self.high = np.array([[r[f"hi{j}"] for j in range(k)] for r in found]).reshape(len(found), k)
        self.rows = max(64, block_bytes // (8 * (self.pivots.points.shape[1] + k)))
        self.blocks = {int(r.cell): -(-r.n // self.rows) for r in found}

    def close(self) -> None:
        """Delete the table; results of searches don't read it."""
        remove(self.table.sparkSession, self.path)

    def visits(self, anchors: DataFrame, first: bool, scale: float) -> DataFrame:
        """anchors with the cells to look into: the likeliest one, or all others that the brackets leave open."""
        pivots, cells, low, high = self.pivots, self.cells, self.low, self.high

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not len(cells):
                    continue
                x = _matrix(b.column("x"), b.num_rows)
                at, square = pivots.distances(x, anchors=True), (x**2).sum(1)[:, None]
                near = np.maximum(low - at[:, None], at[:, None] - high).max(2).clip(0)
                far = (high + at[:, None]).min(2)
                best, worst = scale * (pivots.scores(near, square) + pivots.slack(square)), scale * (pivots.scores(far, square) - pivots.slack(square))
                most = np.array([max(t) for t in b.column("most").to_pylist()])[:, None]
                least = np.array([min(t) for t in b.column("least").to_pylist()])[:, None]
                open_ = (best >= least) & (worst <= most)
                home = np.where(worst <= most, best, -np.inf).argmax(1)
                go = np.zeros_like(open_)
                go[np.arange(len(go)), home] = True
                go = open_ & (go if first else ~go)
                i, c = np.nonzero(go)
                if len(i):
                    yield pa.RecordBatch.from_arrays([*(col.take(pa.array(i)) for col in b.columns), pa.array(cells[c], pa.int32())], names=[*b.schema.names, "cell"])

        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema) + ", cell int"
        return anchors.mapInArrow(run, kind)

    def _look(self, visiting: DataFrame, groups: int, k: int, same_label: bool, scale: float) -> DataFrame:
        """(anchor, list, id, score): for each visit the k best of every block for each list."""
        pivots = self.pivots
        blocks = F.element_at(F.create_map(*[F.lit(x) for item in self.blocks.items() for x in item]), F.col("cell")) if self.blocks else F.lit(1)
        grp = F.pmod(F.xxhash64("id"), F.lit(groups))
        rows = self.table.select("id", "label", "x", "far", "cell", F.pmod(F.xxhash64("id"), blocks).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"))
        asks = cut(visiting).withColumn("grp", grp).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))))
        rows = rows.join(asks.select("cell", "grp").distinct(), ["cell", "grp"], "left_semi")

        def check(a: pa.Table, r: pa.Table) -> pa.Table:
            out: list[tuple[np.ndarray, ...]] = []
            if a.num_rows and r.num_rows:
                ids, labels, y, far = r["id"].to_numpy(), r["label"].to_numpy(), _matrix(r["x"], r.num_rows), _matrix(r["far"], r.num_rows)
                anchors, own, x = a["id"].to_numpy(), a["label"].to_numpy(), _matrix(a["x"], a.num_rows)
                leasts, mosts, lists = a["least"].to_pylist(), a["most"].to_pylist(), a["list"].to_pylist()
                square = (x**2).sum(1)
                at = pivots.distances(x, anchors=True)
                step = max(1, CELLS // len(ids))
                for lo in range(0, len(x), step):
                    part = slice(lo, lo + step)
                    near, distant = np.zeros((len(x[part]), len(ids))), np.full((len(x[part]), len(ids)), np.inf)
                    for j in range(far.shape[1]):
                        np.maximum(near, np.abs(at[part, j, None] - far[:, j]), out=near)
                        np.minimum(distant, at[part, j, None] + far[:, j], out=distant)
                    q, slack = square[part, None], pivots.slack(square[part, None])
                    best, worst = scale * (pivots.scores(near, q) + slack), scale * (pivots.scores(distant, q) - slack)
                    for i in range(len(best)):
                        me = lo + i
                        least, most = np.array(leasts[me]), np.array(mosts[me])
                        fits = (best[i] >= least.min()) & (worst[i] <= most.max()) & (ids != anchors[me]) & ((labels == own[me]) == same_label)
                        open_ = np.flatnonzero(fits)
                        open_ = open_[np.argsort(-best[i, open_], kind="stable")]
                        out += _best(open_, best[i], y, x[me], ids, least, most, lists[me], anchors[me], k, scale)
            cols = [np.concatenate(c) if out else np.zeros(0) for c in (zip(*out, strict=True) if out else [()] * 4)]
            return pa.table({n: pa.array(c.astype(t)) for n, c, t in zip(("anchor", "list", "id", "score"), cols, ("int64", "int64", "int64", "float64"), strict=True)})

        return asks.groupBy("cell", "block", "grp").cogroup(rows.groupBy("cell", "block", "grp")).applyInArrow(check, "anchor long, list long, id long, score double")

    def top(self, anchors: DataFrame, k: int, same_label: bool, scale: float = 1.0) -> DataFrame:
        """(anchor, list, id, score, rank): of each anchor's lists the k rows of greatest score, of the anchor's label or of others.

        anchors are (id, label, x, list, least, most): numbers of the lists, and the least and the greatest scale * score that each takes.
        """
        anchors = cut(anchors)
        groups = max(1, -(-anchors.count() // self.rows))
        best = Window.partitionBy("anchor", "list").orderBy(F.desc("score"), "id")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        some = cut(ranked(self._look(self.visits(anchors, True, scale), groups, k, same_label, scale)))
        floors = some.where(F.col("rank") == k).groupBy(F.col("anchor").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("list", F.col("score") * scale))).alias("floor"))  # at most a score for each list
        raised = F.transform("list", lambda n, i: F.greatest(F.get(F.col("least"), i), F.coalesce(F.try_element_at(F.col("floor"), n), F.lit(float("-inf")))))
        # the first cell follows from `most` alone, so the second look leaves out the same one
        rest = anchors.join(floors, "id", "left").withColumn("least", raised).drop("floor")
        more = self._look(self.visits(rest, False, scale), groups, k, same_label, scale)
        return cut(ranked(some.drop("rank").union(more)))


def _best(open_: np.ndarray, bound: np.ndarray, y: np.ndarray, q: np.ndarray, ids: np.ndarray, least: np.ndarray, most: np.ndarray, lists: list, anchor: int, k: int, scale: float) -> list:
    """Exact scores of the open rows, the likeliest first, until no list can gain; the k best of each list."""
    scores, at, size = [], 0, STEP
    while at < len(open_):
        scores.append(y[open_[at : at + size]] @ q)
        at, size = at + size, 2 * size
        if at < len(open_):
            known = scale * np.concatenate(scores)
            within = [known[(known >= a) & (known <= b)] for a, b in zip(least, most, strict=True)]
            floors = [max(a, np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else a for a, s in zip(least, within, strict=True)]
            if bound[open_[at]] < min(floors):
                break
    if not scores:
        return []
    known = np.concatenate(scores)
    mine, out = ids[open_[: len(known)]], []
    for n, a, b in zip(lists, least, most, strict=True):
        ok = np.flatnonzero((scale * known >= a) & (scale * known <= b))
        ok = ok[np.lexsort((mine[ok], -known[ok]))[:k]]
        if len(ok):
            out.append((np.full(len(ok), anchor), np.full(len(ok), n), mine[ok], known[ok]))
    return out


def mine(vectors: DataFrame, anchor: Column, id_col: str = "id", label_col: str = "label", vector_col: str = "x", positives: int = 5, negatives: int = 10, low: float = 30, high: float = 90, of: float = 100, **settings) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which `anchor`, over the column id, holds. An anchor's positives are the rows of its label
    with the greatest scores; for each, the negatives are the rows of other labels with the greatest scores s for
    which low * p <= of * s <= high * p, p being the positive's score.
    """
    search = Search(usable(vectors, id_col, label_col, vector_col), **settings)
    anchors = search.table.where(anchor).select("id", "label", "x")
    everything = [F.array(F.lit(0).cast("long")).alias("list"), F.array(F.lit(float("-inf"))).alias("least"), F.array(F.lit(float("inf"))).alias("most")]
    good = search.top(anchors.select("id", "label", "x", *everything), positives, True).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("p"), F.col("rank").cast("long").alias("list"))
    bands = good.withColumn("band", F.struct("list", (F.col("p") * float(low)).alias("least"), (F.col("p") * float(high)).alias("most"))).where("band.least <= band.most")
    bands = bands.groupBy(F.col("anchor").alias("id")).agg(F.array_sort(F.collect_list("band")).alias("band"))  # at most `positives` entries
    asks = anchors.join(bands, "id").select("id", "label", "x", "band.list", "band.least", "band.most")
    bad = search.top(asks, negatives, False, float(of)).select("anchor", "list", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("n"))
    search.close()
    out = good.join(bad, ["anchor", "list"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", F.col("p").cast("long").alias("positive_score"), F.col("n").cast("long").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * 256).cast("double"))
    finite = ~F.exists("embedding", lambda c: F.isnan(c) | (F.abs(c) == float("inf")))
    v = e.where(finite | F.col("embedding").isNull()).select(F.col("vec_id").alias("id"), label.alias("label"), whole.alias("x"))
    return mine(v, F.col("id") % 100 == 0)


ORACLE = """
with v as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: floor(256 * c::double)) as x
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select a.id as anchor, b.id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score from v a join v b on a.id % 100 = 0 and a.id <> b.id),
p as (select anchor, id, score from s where same qualify row_number() over (partition by anchor order by score desc, id) <= 5)
select p.anchor as anchor_id, p.id as positive_id, row_number() over (partition by p.anchor, p.id order by s.score desc, s.id)::int as rank, s.id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on s.anchor = p.anchor and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score qualify rank <= 10
"""
