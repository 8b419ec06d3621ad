"""Operator 1: near-duplicates by SimHash and pigeonhole blocks.

A fingerprint is cut into `blocks` blocks. Two fingerprints that differ in at most `bits` bits agree
in all but `bits` of them, so they share at least one key made of blocks - bits blocks. Only distinct
fingerprints are keyed, so copies cost one row. Keys held by few fingerprints are joined with
themselves and each pair is verified. In keys held by many, no pairs are formed: each fingerprint
goes to the values one bit away from it and to itself, where any two that meet differ in at most
two bits and any two that differ in at most two bits meet; all at one value are tied to the least.
A value has at most 65 such neighbours, so no group can grow. Both ways find exactly the links.

Defined cases: a null or empty text, or one of blanks only, has fingerprint zero, which links like
any other; a null doc_id gets a fingerprint and belongs to a group, but is never its smallest id, so
a group of null ids only has a null component; repeated rows are copies; other columns are unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.jaccard import groups
from graphloom.plans.fixpoint import components, cut

#: Keys with more fingerprints than this go by single-bit neighbours instead of pairs.
DENSE = 32
#: Shingles counted at once.
STEP = 1 << 16


def simhash(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint, as a signed integer."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and blanks \x20 \x09-\x0d
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = list(map(len, words))
    ends = [e + i for i, e in enumerate(accumulate(lengths))]
    width = min(width, len(words))
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    ends = ends[width - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for i in range(0, len(ends), STEP):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[i : i + STEP], ends[i : i + STEP], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(ends)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [simhash(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(bits: int, blocks: int) -> list[int]:
    """Signed masks of every choice of blocks - bits blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    one = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    all_masks = [sum(c) for c in combinations(one, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in all_masks]


def links(distinct: DataFrame, bits: int = 2, blocks: int = 5) -> DataFrame:
    """(src, dst): fingerprints within bits of each other; those in dense keys by a chain through their least."""
    if bits != 2:
        raise ValueError("single-bit neighbours answer for two bits")
    keys = [F.struct(F.lit(i).alias("no"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(bits, blocks))]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.no", "k.key")
    held = keyed.groupBy("no", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(keyed.join(held, ["no", "key"]))
    sparse = shared.where(F.col("n") <= DENSE).select("no", "key", "fp")
    pairs = sparse.join(sparse.withColumnRenamed("fp", "other"), ["no", "key"]).where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= bits)).select(F.col("fp").alias("src"), F.col("other").alias("dst"))
    dense = shared.where(F.col("n") > DENSE).select("fp").distinct()
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i)) for i in range(64)]
    near = dense.select("fp", F.explode(F.array(*flips)).alias("at"))
    met = near.groupBy("at").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    tied = met.select(F.array_min("all").alias("src"), F.explode("all").alias("dst")).where("src <> dst")
    return pairs.union(tied).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 2, blocks: int = 5) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row."""
    fps = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct.select("fp"), bits, blocks))
    linked = distinct.join(found.withColumnRenamed("id", "fp"), "fp")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    joined = linked.join(least, "component").select("fp", "least")
    grouped = cut(distinct.join(joined, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return fps.join(grouped, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs with one row of each group of texts whose shingles are similar by num / den or more: that with the group's least (id, hash of the text), once if it repeats; null ids come after all others."""
    found = groups(docs, id_col, text_col, width, num, den)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    kept = found.groupBy("component").agg(F.min(row).alias("r")).select(F.col("r.doc_id").alias("__id"), F.col("r.t").alias("__t"))
    of_row = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.col("__t_of") == F.col("__t"))
    return docs.withColumn("__t_of", F.xxhash64(text_col)).join(kept, of_row, "left_semi").dropDuplicates([id_col, "__t_of"]).drop("__t_of")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
