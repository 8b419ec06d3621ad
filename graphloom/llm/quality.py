"""Operator 2: a quality classifier, a generalised additive model with pairwise interactions.

Every feature has a lookup table over its quantile bins. Training visits the features in turn, and
each visit fits a tree of few leaves to the gradient's histogram and adds it, scaled down, to the
table; then the pairs with most left to explain get two-dimensional tables in the same way. A score
is the logistic of the sum of a document's table entries.

The model is fitted on the driver from the features of at most max_rows labelled documents (never
their texts); every document is then scored where it lies.

Defined cases: null and empty texts are scored alike, as texts of no words; documents with a null id
are scored and are in the held-out fold of none (held_out false); without labelled rows, or with one
class, the score is the smoothed share of label 1 for all. Other columns are unread, and the filter
passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.labelled import fetch, fold, sample

FEATURES = "log_bytes log_words word_bytes upper digits marks rare_marks bars blanks high distinct_words twin_words lines line_bytes distinct_lines ended short_words long_words entropy".split()
_LETTER, _UPPER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = _DIGIT[48:58] = True
_HIGH = np.arange(256) >= 128
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_MARK = ~(_LETTER | _DIGIT | _HIGH | _BLANK)
_RARE = _MARK & ~np.isin(np.arange(256), list(b".,;:'\"?!-()"))


def features(text: str | None) -> list[float]:
    data = (text or "").encode()
    n = max(1, len(data))
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, int)
    words = data.split()
    k = max(1, len(words))
    rows = [x for x in data.split(b"\n") if x]
    r = max(1, len(rows))
    p = seen[seen > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return [
        np.log1p(len(data)), np.log1p(len(words)), float(lengths.sum()) / k,
        seen[_UPPER].sum() / max(1, seen[_LETTER].sum()), seen[_DIGIT].sum() / n, seen[_MARK].sum() / n, seen[_RARE].sum() / n, seen[124] / n, seen[_BLANK].sum() / n, seen[_HIGH].sum() / n,
        len(set(words)) / k, sum(map(eq, words, words[1:])) / k,
        np.log1p(len(rows)), len(data) / r, len(set(rows)) / r, sum(x[-1:] in b".!?" for x in rows) / r,
        float((lengths <= 2).sum()) / k, float((lengths > 14).sum()) / k, float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (i, j), g in zip(self.pairs, self.grids, strict=True):
            out += g[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _split(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram in two; place 0 if there is none."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    ra, rb = g.sum() - a, h.sum() - b
    gain = np.where((b > least) & (rb > least), a * a / (b + 1) + ra * ra / (rb + 1), -1) - g.sum() ** 2 / (h.sum() + 1)
    at = int(gain.argmax())
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Leaf values over the bins of a shallow tree that is grown best cut first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_split(g[a:b], h[a:b], least), a, b) for a, b in parts]
        gain, at, a, b = max(found)
        if not at:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a grid into four."""
    sg, sh = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)

    def four(s):
        a = s[:-1, :-1]
        b, c = s[:-1, -1:] - a, s[-1:, :-1] - a
        return np.stack([a, b, c, s[-1, -1] - a - b - c])

    qg, qh = four(sg), four(sh)
    gain = (qg * qg / (qh + 1)).sum(0) - sg[-1, -1] ** 2 / (sh[-1, -1] + 1)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    value = np.where(qh[:, i, j] > least, qg[:, i, j] / (qh[:, i, j] + 1), 0)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 250, rate: float = 0.1, bins: int = 48, leaves: int = 3, pairs: int = 8, pair_rounds: int = 80, grid: int = 12, least: float = 3.0) -> Model:
    y = y.astype(float)
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    model = Model(base)
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    raw = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, s in enumerate(sizes):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, s), np.bincount(b[:, j], h, s), leaves, least)
            model.tables[j] += step
            raw += step[b[:, j]]
    model.coarse = [np.arange(s) * grid // max(s, 1) for s in sizes]
    c = [model.coarse[j][b[:, j]] for j in range(len(sizes))]
    g, h = slopes()

    def histogram(i, j, v):
        return np.bincount(c[i] * grid + c[j], v, grid * grid).reshape(grid, grid)

    ranked = sorted(combinations(range(len(sizes)), 2), key=lambda p: -_quadrants(histogram(*p, g), histogram(*p, h), least)[0])
    model.pairs = ranked[:pairs]
    model.grids = [np.zeros((grid, grid)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * _quadrants(histogram(i, j, g), histogram(i, j, h), least)[1]
            model.grids[k] += step
            raw += step[c[i], c[j]]
    return model


def feature_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and x, the features of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t.as_py()) for t in batch.column(len(keep))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], x], names=[*keep, "x"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", x array<double>")


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, max_rows: int = 20_000) -> Model:
    rows = fetch(feature_rows(sample(docs, labels, "quality", folds, held_out, max_rows), "doc_id", "y"))
    return fit(np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES)), rows["y"].to_numpy())


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t.as_py()) for t in batch.column(1)], float)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents whose text scores at least threshold, all columns as they are."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in text], float).reshape(len(text), len(FEATURES))))

    return docs.where(score(F.col("text")) >= threshold)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scores(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
