"""Operator 11: runs of words that repeat with a period.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words that no
neighbouring word extends. It holds max(6, 4 q) - q matches (a word equal to the one q further), so a lag
with fewer matches in the whole text has no run. Matches are counted for all lags at once: words that
are frequent in the text by the autocorrelation of where they stand, one FFT a word and one inverse FFT of
the summed spectra, rounded to integers (exact, since counts are far below the precision of a double); rare
words by the differences of all pairs of their positions. Lags go in ascending order. What is found with
period q is subtracted from the counts of q's multiples, so a text of one word is one scan and not one
scan for each lag. A lag with enough matches left gets an island scan: since a run spans three multiples of
its period, only places where the words at three multiples in a row match are looked at word by word.

Everything happens inside a document, so documents are dealt as the scan deals them and nothing is
shuffled. Time grows about as n log n for a text of n words, and as n**1.5 where words repeat a lot.

Defined cases: a null or empty text, or one of blanks only, has no words, no runs and an empty collapsed
text; texts of under six words have no runs; a null id stays null; repeated rows give a row each; other
columns are unread; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of positions made at once.
PAIRS = 1 << 21
#: Bytes of text after which a batch of results goes out.
BYTES = 8 << 20
#: Places of a lag that are looked at one by one; with more of them the whole text is.
SEEDS = 12
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def need(lags: np.ndarray | int):
    """Matches that a run of this period holds."""
    return np.maximum(6, 4 * lags) - lags


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """How many words equal the word p further, for p = 0..most (0 is not counted)."""
    n = len(ids)
    size = 1 << int(n + most).bit_length()
    held = np.bincount(ids)
    heavy = np.flatnonzero(held.astype(np.float64) ** 2 > 12.0 * size)
    counts = np.zeros(most + 1, np.int64)
    if len(heavy):
        power = 0.0
        for word in heavy:
            at = np.fft.rfft(ids == word, size)
            power = power + (at.real**2 + at.imag**2)
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    light = np.ones(len(held), bool)
    light[heavy] = False
    light &= held > 1
    where = np.flatnonzero(light[ids])
    order = where[np.argsort(ids[where], kind="stable")]
    group = held[ids[order]]
    starts = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    later = group - 1 - (np.arange(len(order)) - np.repeat(starts, group[starts]))  # members of the group after this one
    upto = np.cumsum(later)
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        k = later[at:end]
        first = np.repeat(np.arange(at, end), k)
        step = np.arange(len(first)) - np.repeat(np.cumsum(k) - k, k) + 1
        gap = order[first + step] - order[first]
        counts += np.bincount(gap[gap <= most], minlength=most + 1)
        at = end
    counts[0] = 0
    return counts


def _stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(from, to) of the maximal stretches of trues with at least `least` of them."""
    edge = np.flatnonzero(np.diff(np.r_[False, equal, False].astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    keep = b - a >= least
    return list(zip(a[keep].tolist(), b[keep].tolist(), strict=True))


def islands(ids: np.ndarray, p: int) -> list[tuple[int, int]]:
    """(start, length) of the maximal stretches with period p, smallest or not, of max(6, 4 p) words or more."""
    n, least = len(ids), int(need(p))
    marks = ids[::p]
    same = marks[1:] == marks[:-1]
    k = least // p
    hit = same[: max(0, len(same) - k + 1)].copy()
    for i in range(1, k):
        hit &= same[i : i + len(hit)]
    seeds = _stretches(hit, 1)
    if len(seeds) > SEEDS:
        seeds = [(0, len(marks))]
    found = []
    for a, b in seeds:
        lo, hi = max(0, (a - 1) * p + 1), min(n - p, (b + k - 1) * p)
        found += [(lo + s, e - s + p) for s, e in _stretches(ids[lo:hi] == ids[lo + p : hi + p], least)]
    return found


def runs(ids: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) by start, then period."""
    n = len(ids)
    most = n // 4
    if n < 6:
        return np.zeros((0, 3), np.int64)
    counts = lag_counts(ids, most)
    wanted = need(np.arange(most + 1))
    found, spans = [], set()
    for p in np.flatnonzero(counts >= wanted).tolist():
        if counts[p] < wanted[p]:
            continue
        for start, length in islands(ids, p):
            if (start, length) in spans:  # its smallest period divides p
                continue
            spans.add((start, length))
            found.append((start, length, p))
            times = np.arange(2 * p, min(length, most + 1), p)
            counts[times] -= length - times
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def collapse(n: int, found: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: those after the first period of a run go."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return np.cumsum(depth[:n]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): runs by start, then period, with starts counted in words from 0; collapsed is the text's words without repeats, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            flat = np.concatenate([r[2] for r in rows])
            fields = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r[2]) for r in rows])], pa.int32()), fields)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), lists, pa.array([r[3] for r in rows], pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()  # of bytes: blanks \x20 \x09-\x0d
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                found = runs(ids)
                kept = [w for w, stays in zip(words, collapse(len(words), found).tolist(), strict=True) if stays] if len(found) else words
                joined = b" ".join(kept)
                rows.append((doc.as_py(), len(words), found, joined))
                held += len(joined)
                if held > BYTES:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def greatest_exponent(found: str = "runs"):
    """The run with the greatest length / period, compared exactly; of equals the first; null where there is none."""
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    return F.aggregate(F.col(found), F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one document in ten by the crc32 of its id repeats a few of its words from some place to its end, as the query's contract plants them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    d = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, split).alias("ws"))
    d = d.withColumn("n", F.size("ws").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0L, n - 1), i -> ws[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return d.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(with_planted_periods(docs)).withColumn("best", greatest_exponent())
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
