"""Operator 3: packing token sequences by best-fit decreasing.

Documents are tokenised once. Those longer than a window are first cut into full windows, which are
sequences by themselves; what remains of each goes, longest first, into the open window with the
least room that still holds it, found by a segment tree over remaining capacities. Pieces are dealt
to groups by hash, a group is packed by one task, and a group holds about group_size pieces however
large the corpus is. Only piece lengths and checksums are shuffled, never ids.

Words repeat, so ids are looked up by the stretch between blanks: this vocabulary drops white space
and never merges across it, and a stretch is encoded by the tokenizer itself when first seen.

Defined cases: null and empty texts are the end token alone; documents of any length are read in
segments; repeated rows and equal ids are packed as separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, END = 4096, 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Little-endian uint32 ids of a text, by a tokenizers file that drops white space; equal to encoding it whole."""

    #: A word and trailing marks: the tokenizer's pattern always parts them, so each is encoded once. Latin letters that
    #: neither composition nor lower case (İ) turns into a letter and a mark.
    PARTS = re.compile("([0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,!?;:$#%&*|]+)")
    MOST = 1 << 20
    #: One for each vocabulary in a Python worker, so tasks after the first start with what it knows.
    made: dict[str, WordEncoder] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def learn(self, fresh: set[str]) -> None:
        if len(self.known) > self.MOST:  # the memo is bounded; dropping it costs only time
            self.known.clear()
        parts = {c: m.groups() for c in fresh if (m := self.PARTS.fullmatch(c))}
        words = [*(fresh - parts.keys()), *{p for pair in parts.values() for p in pair if p not in self.known}]
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.known[w] = struct.pack(f"<{len(i)}I", *i) if (i := e.ids) else b""
        for c, (a, b) in parts.items():
            self.known[c] = self.known[a] + self.known[b]

    def encode(self, text: str) -> bytes:
        stretches = text.replace("\n", " ").split(" ")
        known = self.known
        fresh = {s for s in stretches if s not in known}
        if fresh:
            self.learn(fresh)
            if again := {s for s in stretches if s not in known}:  # the memo was dropped in between
                self.learn(again)
        return b"".join(map(known.__getitem__, stretches))


def segments(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in parts that end at a blank, about size long where blanks allow."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def cut_pieces(ids: bytes, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each full window and of the rest."""
    step = 4 * window
    return [(at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step])) for at in range(0, len(ids), step)]


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = b"".join(map(encoder.encode, segments(text.as_py() or ""))) + last
                rows += [(doc, *p, len(ids) // 4) for p in cut_pieces(ids, window)]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


class Rooms:
    """Open windows by remaining capacity: a segment tree of counts finds the tightest that fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, which: int) -> None:
        self.open[room].append(which)
        at = room + self.size
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) with the least room of at least need, taken out."""
        at = need + self.size
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.tree[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window number and offset of each length (none over window), in the order given: pass them longest first."""
    rooms, which, offset, n = Rooms(window), [], [], 0
    for length in lengths:
        found = rooms.take(length) if length < window else None
        if found is None:
            found = (window, n)
            n += 1
        room, w = found
        which.append(w)
        offset.append(window - room)
        if room > length:
            rooms.add(room - length, w)
    return which, offset


def pack(pieces: DataFrame, n_docs: int, window: int = WINDOW, group_size: int = 4000) -> DataFrame:
    """pieces with sequence_id and offset. A sequence's id is its group's number and its own within it."""
    groups = max(1, ceil(n_docs / group_size))
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "length"), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        which, offset = best_fit(pdf["length"].tolist(), window)
        group = int(pdf["__group"].iloc[0])
        return pdf.drop(columns="__group").assign(sequence_id=np.array(which, "int64") + (group << 32), offset=np.array(offset, "int64"))

    return dealt.groupBy("__group").applyInPandas(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group_size: int = 4000) -> DataFrame:
    return pack(tokenised(docs, path, id_col, text_col, window), docs.count(), window, group_size)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, vocabulary())
