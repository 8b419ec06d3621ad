"""Labelled training rows for the classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled documents outside the held-out fold, the first by a hash of their id.

    Only documents at hand use up the number. Rows with a null id or label are passed over; of repeated
    labels of a document the largest counts, of rows that repeat an id the text of the least hash.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold("doc_id", folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    said = docs.select("doc_id", F.xxhash64("text").alias("t"))
    known = said.join(known, "doc_id").groupBy("doc_id").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most `most` rows of three numbers
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).join(F.broadcast(known), ["doc_id", "t"])
    return rows.groupBy("doc_id").agg(F.first("text").alias("text"), F.first("y").alias("y"))


def fetch(df: DataFrame) -> pd.DataFrame:
    """Bounded rows to the driver, by a hash of their id, which does not depend on partitions."""
    pdf = df.toPandas()
    return pdf.iloc[np.argsort(pd.util.hash_array(pdf["doc_id"].to_numpy("int64")), kind="stable")].reset_index(drop=True)
