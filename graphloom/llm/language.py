"""Operator 9: language identification by a small convolutional network over bytes.

Bytes have learned vectors; filters of several widths slide over a window of fixed length, each
filter's largest response passes through a rectifier, and a softmax gives the languages. Everything is numpy:
a window batch's convolution is one matrix product per width. A document's prediction is the mean
of its windows' log-probabilities, over all of its text.

The network is trained on the driver from at most max_rows documents and per_doc windows of each.

Defined cases: a null text, or one without a letter, is `und` with score 0; a null id is never held
out; without a learned language everything is `und`; with one, that one is predicted. Other columns are
unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.labelled import fetch, fold
from graphloom.plans.fixpoint import cut

WINDOW = 128
WIDTHS = (2, 3, 4)
#: Windows in one matrix product; bounds the memory of a batch.
BATCH = 256
UNKNOWN = "und"


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """All of the bytes in rows of size, the last padded with zeros."""
    n = max(1, -(-len(data) // size))
    return np.frombuffer(data.ljust(n * size, b"\0"), np.uint8).reshape(n, size)


@dataclass
class Network:
    names: list[str]
    vectors: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, w: np.ndarray) -> tuple[np.ndarray, list]:
        """Responses after pooling and rectifier, and what the gradient needs."""
        x = self.vectors[w]
        n, size, d = x.shape
        parts, kept = [], []
        for f, b, k in zip(self.filters, self.biases, WIDTHS, strict=True):
            # rows of k neighbouring vectors, without copying them
            rows = np.lib.stride_tricks.as_strided(x, (n, size - k + 1, k * d), (x.strides[0], x.strides[1], x.strides[2]), writeable=False)
            r = np.matmul(rows, f)
            at = r.argmax(1) if kept is not None and self.training else None
            top = r.max(1) + b
            parts.append(np.maximum(top, 0))
            kept.append((rows, at, top))
        return np.concatenate(parts, 1), kept

    training = False

    def log_probabilities(self, w: np.ndarray) -> np.ndarray:
        z = self.pooled(w)[0] @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and probability of each text, a bounded number of windows at a time."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.names:
            return out
        sums, counts = np.zeros((len(texts), len(self.names))), np.zeros(len(texts))
        held, owner, waiting = [], [], 0

        def flush():
            if held:
                w, o = np.concatenate(held), np.concatenate(owner)
                for i in range(0, len(w), BATCH):
                    np.add.at(sums, o[i : i + BATCH], self.log_probabilities(w[i : i + BATCH]))
                np.add.at(counts, o, 1)
                held.clear()
                owner.clear()

        for i, t in enumerate(texts):
            if t and any(map(str.isalpha, t)):
                rows = windows(t.lower().encode())
                held.append(rows)
                owner.append(np.full(len(rows), i))
                waiting += len(rows)
                if waiting >= 16 * BATCH:
                    flush()
                    waiting = 0
        flush()
        for i in np.flatnonzero(counts):
            p = np.exp(sums[i] / counts[i] - (sums[i] / counts[i]).max())
            out[i] = (self.names[int(p.argmax())], float(p.max() / p.sum()))
        return out


def fit(w: np.ndarray, y: np.ndarray, names: list[str], dims: int = 6, filters: int = 12, epochs: int = 6, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the cross entropy of single windows."""
    rng = np.random.default_rng(seed)
    n_out = len(WIDTHS) * filters
    p = [rng.normal(0, 0.5, (256, dims)), *(rng.normal(0, (2 / (k * dims)) ** 0.5, (k * dims, filters)) for k in WIDTHS), *(np.zeros(filters) for _ in WIDTHS), rng.normal(0, n_out**-0.5, (n_out, len(names))), np.zeros(len(names))]
    p = [a.astype(np.float32) for a in p]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    k = len(WIDTHS)

    def network():
        return Network(names, p[0], p[1 : 1 + k], p[1 + k : 1 + 2 * k], p[-2], p[-1])

    t = 0
    for epoch in range(epochs if len(names) > 1 else 0):
        order = rng.permutation(len(w))
        for i in range(0, len(w), 64):
            rows = order[i : i + 64]
            net = network()
            net.training = True
            b, target = w[rows], y[rows]
            h, kept = net.pooled(b)
            z = h @ net.out + net.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(b)), target] -= 1
            z /= len(b)
            grads = [np.zeros_like(a) for a in p]
            grads[-2], grads[-1] = h.T @ z, z.sum(0)
            back = z @ net.out.T
            for j, (x, at, top) in enumerate(kept):
                g = back[:, j * filters : (j + 1) * filters] * (top > 0)
                grads[1 + k + j] = g.sum(0)
                picked = x[np.arange(len(b))[:, None], at]  # window, filter, width x dims
                grads[1 + j] = np.einsum("nfd,nf->df", picked, g)
                dx = g[:, :, None] * net.filters[j].T[None]
                place = at[:, :, None] + np.arange(WIDTHS[j])
                np.add.at(grads[0], b[np.arange(len(b))[:, None, None], place].ravel(), dx.reshape(-1, dims))
            t += 1
            step = rate * (0.5 ** epoch) * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
            for a, g, mm, vv in zip(p, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                a -= (step * mm / (np.sqrt(vv) + 1e-8)).astype(np.float32)
    return network()


def train(docs: DataFrame, folds: int = 4, held_out: int = 2, max_rows: int = 4000, per_doc: int = 4, longest: int = 1 << 20) -> Network:
    """From at most max_rows documents of at most `longest` bytes, the first by a hash of their id in each language in turn."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", folds) != held_out) & (F.octet_length("text").between(1, longest)))
    known = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), F.shiftright(F.xxhash64("doc_id"), 48).alias("part"))
    # the share of the hashes that holds a language's first max_rows documents: no task sorts a whole language
    known = cut(known)
    so_far = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = known.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    last = parts.where(F.col("before") < max_rows).groupBy("lang").agg(F.max("part").alias("last"))
    # a row for each language
    few = known.join(F.broadcast(last), "lang").where("part <= last")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = few.select("doc_id", "lang", "h", turn.alias("turn")).orderBy("turn", "h", "doc_id").limit(max_rows)
    # at most max_rows ids
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").where("lang is not null and text is not null")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = windows(text.lower().encode())
                for i in sorted({len(w) * j // per_doc for j in range(per_doc)}):
                    out.append((doc, i, w[i].tobytes(), lang))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["doc_id", "i", "w", "lang"])

    pdf = fetch(rows.mapInArrow(cut_up, "doc_id long, i long, w binary, lang string")).sort_values(["doc_id", "i", "w"], kind="stable")
    names = sorted(set(pdf["lang"]))
    if not names:
        return Network([], *(np.zeros((0, 0)),), [], [], np.zeros((0, 0)), np.zeros(0))
    w = np.stack([np.frombuffer(x, np.uint8) for x in pdf["w"]])
    return fit(w, pdf["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(), names)


def predictions(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = network.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = train(docs)
    out = predictions(docs, network)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
