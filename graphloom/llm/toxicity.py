"""Operator 7: toxicity by compression distance under two zstandard dictionaries.

The ordinary dictionary is trained by zstandard on windows of ordinary text. The toxic one is trained on
the stretches that toxic text has significantly more often (every occurrence of runs of byte n-grams whose
document frequencies differ; all its windows where nothing tells) and ends with the ordinary one, for toxic
text is ordinary text with something added: a window without telling stretches compresses to the same
length under either.
Documents are cut into overlapping windows short enough that literals stay uncoded; a window's distance
is its length under the ordinary dictionary less that under the toxic one. How many windows reach each
of a few distances, and how densely, gives the score through a logistic curve. It is calibrated by
cross-fitting: the evidence of each fold of the training rows comes from dictionaries of the others.

The model is fitted on the driver from at most max_rows labelled documents; every document is scored in
whole, where it lies.

Defined cases: null and empty texts have no windows and score as such; a null id is never held out;
without labelled rows, or with one class in a fold's complement, the score is the smoothed share of
label 1 for all. Other columns are unread, and the filter passes them through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.labelled import fetch, fold, sample

WINDOW, STRIDE = 60, 44
#: Widths of the byte n-grams that training compares.
GRAMS = (5, 8)
LEVELS = (1, 2, 3, 4, 5, 6, 8)


def plain(text: str | None) -> bytes:
    return (text or "").lower().encode()


def windows(data: bytes) -> list[bytes]:
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - (WINDOW - STRIDE)), STRIDE)] if data else []


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    how = zstd.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=4, target_length=32, strategy=zstd.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    words = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=how)
    return zstd.ZstdCompressor(dict_data=words, compression_params=how)


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] = field(default_factory=list)
    base: float = 0.0

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def distances(self, data: bytes) -> np.ndarray:
        """Per window: length under the ordinary dictionary less that under the toxic one."""
        if self._pair is None:
            self._pair = _compressor(self.ordinary), _compressor(self.toxic)
        a, b = (c.compress for c in self._pair)
        return np.array([len(a(w)) - len(b(w)) for w in windows(data)], np.int64)

    def evidence(self, data: bytes) -> list[float]:
        d = self.distances(data)
        reach = [int((d >= k).sum()) for k in LEVELS]
        return [f(r) for r in reach for f in (np.log1p, lambda r: np.sqrt(1e3 * r / (len(data) + 200)))]

    def score(self, text: str | None) -> float:
        z = self.base
        if self.weights:
            z += float(np.dot(self.weights, self.evidence(plain(text))))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _grams(data: bytes, width: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(a) < width:
        return np.zeros(0, np.uint64)
    v = np.zeros(len(a) - width + 1, np.uint64)
    for i in range(width):
        v = (v << np.uint64(8)) | a[i : len(a) - width + 1 + i]
    return v


def _unique(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    s = np.sort(values)
    return s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s


def _held(values: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Positions in sorted values of those that are in g, sorted and distinct."""
    if not len(values):
        return np.zeros(0, int)
    at = np.minimum(np.searchsorted(values, g), len(values) - 1)
    return at[values[at] == g]


def _trained(samples: list[bytes], size: int, k: int, d: int = 6) -> bytes:
    """A dictionary of at most size bytes that zstandard trains from samples; their own last bytes where they are too few for it."""
    if sum(map(len, samples)) < 8:
        return b"".join(samples)
    try:
        return zstd.train_dictionary(size, samples, k=k, d=d).as_bytes()[-size:]
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


class Telling:
    """Byte n-grams that toxic texts have oftener than ordinary ones, for any choice of folds."""

    def __init__(self, texts: list[bytes], y: np.ndarray, folds: np.ndarray):
        self.texts, self.y, self.folds = texts, y, folds
        self.values, self.counts = {}, {}
        for width in GRAMS:
            said = np.concatenate([_unique(_grams(texts[i], width)) for i in np.flatnonzero(y)])
            values, n = np.unique(said, return_counts=True)
            values = values[n > 2]
            counts = np.zeros((int(folds.max()) + 1, 2, len(values)), np.int32)
            for t, c, f in zip(texts, y, folds, strict=True):
                counts[f, c, _held(values, _unique(_grams(t, width)))] += 1
            self.values[width], self.counts[width] = values, counts

    def stretches(self, without: int | None, z: float, times: float) -> list[bytes]:
        """Every occurrence of runs of telling n-grams in toxic texts, fold `without` left out."""
        used = self.folds != without
        n0, n1 = int((used & (self.y == 0)).sum()), int((used & (self.y == 1)).sum())
        chosen = {}
        for width, counts in self.counts.items():
            b, a = (counts[[f for f in range(len(counts)) if f != without]].sum(0)).astype(float)
            p, q, mean = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1), (a + b + 1) / (n0 + n1 + 2)
            gap = (p - q) / np.sqrt(mean * (1 - mean) * (1 / (n0 + 1) + 1 / (n1 + 1)))
            chosen[width] = self.values[width][(gap > z) & (p > times * q) & (a > 2)]
        return [s for i in np.flatnonzero(used & (self.y == 1)) for s in self._runs(self.texts[i], chosen)]

    @staticmethod
    def _runs(text: bytes, chosen: dict[int, np.ndarray]) -> list[bytes]:
        edge = np.zeros(len(text) + 1, np.int32)
        for width, values in chosen.items():
            if len(values) and len(text) >= width:
                g = _grams(text, width)
                at = np.minimum(np.searchsorted(values, g), len(values) - 1)
                hit = np.flatnonzero(values[at] == g)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + width, -1)
        inside = np.r_[0, (np.cumsum(edge) > 0).astype(np.int8)]
        step = np.diff(inside)
        return [text[i:j] for i, j in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]


def dictionaries(telling: Telling, without: int | None = None, z: float = 6.0, times: float = 4.0, own: int = 6000, common: int = 8000, most: int = 8_000_000) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary, from all folds but one; the latter from at most `most` bytes of windows, evenly drawn."""
    of = [[telling.texts[i] for i in np.flatnonzero((telling.folds != without) & (telling.y == c))] for c in (0, 1)]
    every = max(1, -(-sum(map(len, of[0])) * WINDOW // (STRIDE * most)))
    ordinary = _trained([w for t in of[0] for w in windows(t)[zlib.crc32(t) % every :: every]], common, 48)
    # a small sample may tell nothing: then all windows of the class stand in
    toxic = _trained(telling.stretches(without, z, times) or [w for t in of[1] for w in windows(t)], own, 24)
    # the toxic part in front: what is ordinary lies at the same distance from a window under both
    return toxic + ordinary, b"\0" * len(toxic) + ordinary


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    x1 = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x1.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + keep, x1.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def distinct(texts: list[bytes], width: int = 8, kept: int = 24) -> list[int]:
    """Positions of the texts that share under half of their least hashes with any one before: copies would pass for evidence."""
    at: dict[int, list[int]] = {}  # hash to the kept texts that it or their copies hold
    out = []
    for i, t in enumerate(texts):
        g = _grams(t, width)
        least = _unique(g * np.uint64(0x9E3779B97F4A7C15))[:kept].tolist() if len(g) else [zlib.crc32(t)]
        shared = Counter(j for h in least for j in at.get(h, ()))
        like, n = shared.most_common(1)[0] if shared else (i, 0)
        if 2 * n < len(least):
            like = i
            out.append(i)
        for h in least:
            held = at.setdefault(h, [])
            if like not in held:
                held.append(like)
    return out


def fit(texts: list[bytes], y: np.ndarray, folds: int = 4) -> Model:
    """Dictionaries from all rows; the curve from evidence that each fold's rows give under dictionaries of the other folds."""
    y = np.asarray(y, int)
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    alone = distinct(texts)
    texts, y = [texts[i] for i in alone], y[alone]
    fold = np.array([(zlib.crc32(t) >> 7) % folds for t in texts], int)
    if not len(y) or any(len(set(y[fold != f])) < 2 for f in range(folds)):
        return Model(base=base)
    telling = Telling(texts, y, fold)
    evidence = np.zeros((len(y), 2 * len(LEVELS)))
    for f in range(folds):
        model = Model(*dictionaries(telling, f))
        for i in np.flatnonzero(fold == f):
            evidence[i] = model.evidence(texts[i])
    w, b = _logistic(evidence, y)
    return Model(*dictionaries(telling), w.tolist(), b)


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, max_rows: int = 8000, max_text: int = 500_000) -> Model:
    """From at most max_rows labelled rows, drawn by a hash; a text over max_text bytes is not learned from."""
    pdf = fetch(sample(docs.where(F.octet_length("text") <= max_text), labels, "toxic", folds, held_out, max_rows))
    return fit([plain(t) for t in pdf["text"]], pdf["y"].to_numpy())


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_ordinary(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents whose text scores under threshold, all columns as they are."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in text], dtype=float)

    return docs.where(score(F.col("text")) < threshold)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scores(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
