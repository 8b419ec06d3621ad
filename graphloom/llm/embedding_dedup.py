"""Operator 4: near-duplicate embeddings through an inverted multi-index.

Vectors are scaled to length one. Each half has a codebook of its own, and the two codebooks span a
product grid whose cells hold the vectors by label. Every vector visits cells in the order of their
distance from it (the multi-sequence over the two sorted lists of centroid distances) until what it
has passed makes the target recall sure: the slack that a partner at the threshold can add to the
sum of squared centroid distances, taken from partners made for a sample of vectors at the
threshold itself and from true pairs of the sample. Whatever shares a visited cell and label
is verified by cosine in double precision.

Work is dealt by (label, tile), a tile being a few left centroids that lie close together and a few right ones. A vector
goes to each tile once, with the list of the tile's cells that it visits, and meets only what lies in those. A tile with many
members or visitors is split into blocks on both sides, each pair of blocks one task group: a matrix product that returns
counts per vector and a star for each connected part of its links, never the pairs. A link that both ends could find is counted by
the rule that the member is credited only if it would not visit the visitor's cell itself.

The codebooks grow with the root of the number of vectors, so a cell holds about as many at every size. Codebooks and slack are
fitted on bounded samples: max_sample vectors for the codebooks, fit_sample of them for the slack, and of the true pairs at most
fit_pairs from every 512 of those. The index holds every vector.

Equal vectors of a label are collapsed to one with a multiplicity first, so copies cost nothing.

Defined cases: vectors that are null, zero, or hold null or non-finite components, vectors of a null
label, and vectors whose length is not the table's most common one link with nothing and are their own
component; rows that repeat a vec_id count as one vector (the least of them by label and content);
a null vec_id gives one row with no links that is not kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import components, cut

BLOCK = 1024
TILE = 4  # centroids of a half that a tile spans on average


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((c * c).sum(1) - 2 * x[at : at + BLOCK] @ c.T, 1) for at in range(0, len(x), BLOCK)])


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Grid:
    """Codebooks of the two halves, and how far a search goes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, slack: float = 0.0):
        self.left, self.right, self.slack = left, right, slack
        groups = [_nearest(c, kmeans(c, -(-len(c) // TILE))) for c in (left, right)]
        self.left_tile, self.right_tile = groups[0] * (int(groups[1].max()) + 1), groups[1]

    def tiles(self, cells: np.ndarray) -> np.ndarray:
        return self.left_tile[cells // len(self.right)] + self.right_tile[cells % len(self.right)]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        return tuple(((p * p).sum(1)[:, None] - 2 * p @ c.T + (c * c).sum(1)) for p, c in ((x[:, :h], self.left), (x[:, h:], self.right)))

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def excess(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How much farther each given cell is from x (row by row) than its own."""
        a, b = self.distances(x)
        i, j = cells // len(self.right), cells % len(self.right)
        r = np.arange(len(x))
        return a[r, i] - a.min(1) + b[r, j] - b.min(1)

    def visits(self, x: np.ndarray) -> list[np.ndarray]:
        """Cells in the order of the multi-sequence, up to the slack, of each row."""
        a, b = self.distances(x)
        a, b = a - a.min(1, keepdims=True), b - b.min(1, keepdims=True)
        out = []
        for p, q in zip(a, b, strict=True):
            i, j = np.flatnonzero(p <= self.slack), np.flatnonzero(q <= self.slack)
            total = p[i][:, None] + q[j]
            u, v = np.nonzero(total <= self.slack)
            order = np.argsort(total[u, v], kind="stable")
            out.append((i[u] * len(self.right) + j[v])[order])
        return out

    def visited_tiles(self, x: np.ndarray) -> tuple[list[list[int]], list[list[list[int]]]]:
        """The tiles that each row's search touches, and the cells that it visits in each."""
        tiles, cells = [], []
        for seen in self.visits(x):
            t = self.tiles(seen)
            order = np.argsort(t, kind="stable")
            which, first = np.unique(t[order], return_index=True)
            tiles.append(which.tolist())
            cells.append([c.tolist() for c in np.split(seen[order], first[1:])])
        return tiles, cells

    def visiting(self, y: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Rows of y by cells: whether y's search reaches the cell."""
        a, b = self.distances(y)
        a, b = a - a.min(1, keepdims=True), b - b.min(1, keepdims=True)
        return a[:, cells // len(self.right)] + b[:, cells % len(self.right)] <= self.slack


def fit(sample: np.ndarray, labels: np.ndarray, n: int, threshold: float, recall: float = 0.995, occupancy: int = 64, seed: int = 5, fit_sample: int = 4096, fit_pairs: int = 20_000) -> Grid:
    """Codebooks from unit vectors; their size follows n, the number of vectors to index, up to one centroid for each vector of the sample."""
    k = int(np.clip(round((n / occupancy) ** 0.5), 1, len(sample)))
    h = sample.shape[1] // 2
    grid = Grid(kmeans(sample[:, :h], k, seed=seed), kmeans(sample[:, h:], k, seed=seed + 1))
    rng = np.random.default_rng(seed)
    x = sample[rng.permutation(len(sample))[:fit_sample]]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    partner = threshold * x + (1 - threshold**2) ** 0.5 * noise
    apart = lambda of, to: np.concatenate([grid.excess(of[at : at + BLOCK], grid.cells(to[at : at + BLOCK])) for at in range(0, len(of), BLOCK)])
    slack = [np.quantile(apart(x, partner), recall)]
    found = []
    few, names = sample[:fit_sample], labels[:fit_sample]
    for at in range(0, len(few), 512):
        i, j = np.nonzero((few[at : at + 512] @ few.T >= threshold) & (names[at : at + 512, None] == names[None, :]))
        keep = np.flatnonzero(i + at != j)[:fit_pairs]
        if len(keep):
            found.append(apart(few[at + i[keep]], few[j[keep]]))
    if found:
        slack.append(np.quantile(np.concatenate(found), recall))
    grid.slack = float(max(slack)) + 1e-9
    return grid


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(col, dtype=float) -> np.ndarray:
    return np.stack([np.asarray(v, dtype) for v in col]) if len(col) else np.zeros((0, 0))


def _clusters(m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each connected part of a boolean matrix that has any."""
    done = ~m.any(1)
    for start in range(len(m)):
        if done[start]:
            continue
        rows, cols, front = np.zeros(len(m), bool), np.zeros(m.shape[1], bool), np.array([start])
        rows[start] = True
        while len(front):
            fresh = m[front].any(0) & ~cols
            cols |= fresh
            met = m[:, fresh].any(1) & ~rows
            rows |= met
            front = np.flatnonzero(met)
        done |= rows
        yield np.flatnonzero(rows), np.flatnonzero(cols)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = 0.995, max_sample: int = 20_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector. The index is fitted on max_sample vectors and holds all."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    v = v.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("v")).select("vec_id", "v.label", "v.x")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("x", lambda e: e != 0)
    v = cut(v.select("vec_id", "label", "x", F.coalesce(sound, F.lit(False)).alias("sound"), F.md5(F.array_join(F.transform("x", lambda e: e.cast("string")), ",").cast("binary")).alias("same")))
    good = v.where("sound")
    alone = v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    width = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if width is None:
        return alone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    good = good.where(F.size("x") == width.d)
    reps = cut(good.groupBy("label", "same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("x").alias("x")))
    n = reps.count()
    # a bounded sample of vectors to fit on
    pdf = reps.orderBy(F.xxhash64("rep"), "rep").limit(max_sample).select("rep", "label", "x").toPandas().sort_values("rep", kind="stable")
    grid = fit(unit(_matrix(pdf["x"])), pdf["label"].to_numpy(), n, threshold, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = unit(_matrix(batch.column(3).to_pylist()))
                home, (tiles, cells) = grid.cells(x), grid.visited_tiles(x)
                cols = [pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(home, pa.int64()), pa.array(grid.tiles(home), pa.int64()), pa.array(tiles, pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["rep", "label", "mult", "x", "home", "tile", "tiles", "cells"])

    placed = cut(reps.select("rep", "label", "mult", "x").mapInArrow(place, "rep long, label string, mult long, x array<double>, home long, tile long, tiles array<long>, cells array<array<long>>"))
    # blocks per tile, for either side, from counts alone
    held = placed.groupBy("label", "tile").agg(F.count(F.lit(1)).alias("members"))
    seen = placed.select("label", F.explode("tiles").alias("tile")).groupBy("label", "tile").agg(F.count(F.lit(1)).alias("visitors"))
    blocks = held.join(seen, ["label", "tile"]).where("visitors > 1").select("label", "tile", F.ceil(F.col("members") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("visitors") / BLOCK).cast("int").alias("vb"))
    blocks = cut(blocks)

    def block(of, count):
        return F.pmod(F.xxhash64("rep", F.lit(of)), F.col(count)).cast("int")

    def spread(count):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    members = placed.select("rep", "label", "mult", "x", "home", "tile").join(blocks, ["label", "tile"]).select("label", "tile", block("m", "mb").alias("m"), spread("vb").alias("v"), "rep", "mult", "x", "home", F.lit(None).cast("array<long>").alias("cells"))
    asks = placed.select("rep", "label", "mult", "x", "home", F.explode(F.arrays_zip("tiles", "cells")).alias("ask")).select("rep", "label", "mult", "x", "home", F.col("ask.tiles").alias("tile"), F.col("ask.cells").alias("cells"))
    visitors = asks.join(blocks, ["label", "tile"]).select("label", "tile", spread("mb").alias("m"), block("v", "vb").alias("v"), "rep", "mult", "x", "home", "cells")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        side = pdf["cells"].isna().to_numpy()
        a, b = pdf[~side], pdf[side]
        if len(a) and len(b):
            xa, xb = _matrix(a["x"]), _matrix(b["x"])
            ra, rb = a["rep"].to_numpy(), b["rep"].to_numpy()
            held, cell = np.unique(b["home"].to_numpy(), return_inverse=True)
            sees = np.stack([np.isin(held, c) for c in a["cells"]])
            m = (xa @ xb.T >= threshold) & sees[:, cell] & (ra[:, None] != rb)
            if m.any():
                ca = m @ b["mult"].to_numpy()
                homes, which = np.unique(a["home"].to_numpy(), return_inverse=True)
                reach = grid.visiting(xb, homes)
                cb = sum((~reach[:, h]) * (a["mult"].to_numpy()[which == h] @ m[which == h]) for h in range(len(homes)))
                tied = [(int(ids[0]), int(i)) for rows, cols in _clusters(m) for ids in [np.unique(np.r_[ra[rows], rb[cols]])] for i in ids[1:]]
                counts = pd.DataFrame({"rep": np.r_[ra, rb], "n": np.r_[ca, cb]})
                out = [counts[counts["n"] > 0].assign(other=None), pd.DataFrame({"rep": [p for p, _ in tied], "n": 0, "other": [q for _, q in tied]})]
        return pd.concat([o for o in out if len(o)]).astype({"other": "Int64"}) if any(map(len, out)) else pd.DataFrame({"rep": [], "n": [], "other": []}).astype({"rep": "int64", "n": "int64", "other": "Int64"})

    found = cut(members.unionByName(visitors).groupBy("label", "tile", "m", "v").applyInPandas(verify, "rep long, n long, other long"))
    counts = found.where("n > 0").groupBy("rep").agg(F.sum("n").alias("n"))
    tied = components(found.where("other is not null").select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    whole = cut(reps.select("label", "same", "rep", "mult").join(counts, "rep", "left").join(tied.withColumnRenamed("id", "rep"), "rep", "left").select("label", "same", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "rep").alias("least")))
    out = v.select("vec_id", "label", "same", (F.col("sound") & (F.size("x") == width.d)).alias("in")).join(whole, ["label", "same"], "left")
    out = out.select("vec_id", F.when(F.col("in"), F.col("links")).otherwise(0).cast("long").alias("n_links"), F.when(F.col("in"), F.col("least")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda e: e::double) as x from embeddings),
ok as (select vec_id, label, x from v where label is not null and len(list_filter(x, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(x, lambda e: e <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.x, b.x) >= 0.93),
r(id, reached) as (select vec_id, vec_id from v union select r.id, l.b from r join l on l.a = r.reached),
c as (select id, min(reached) as component_id from r group by id),
n as (select a, count(*) as n_links from l group by a)
select v.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, v.vec_id = component_id as kept
from v join c on c.id = v.vec_id left join n on n.a = v.vec_id
"""
