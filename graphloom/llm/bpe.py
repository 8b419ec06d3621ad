"""Operator 6: byte-level BPE by prefix dynamic programming.

Of all tokens that can end a prefix of a piece, exactly one ends its encoding: the one that is its
own encoding and whose join with the last token of the prefix before it encodes to these two. So a
table with each prefix's last token, filled from left to right, holds the encodings of all prefixes
at once: appending bytes only adds entries, and after an edit the entries before it still hold.

Text is first cut by the public pattern; a piece that is itself a token is that token. Pieces
never reach across a single blank between two other characters, so stretches between such blanks are
looked up in a bounded memo before the pattern is applied.

Defined cases: null and empty texts have no ids (0 tokens, digests of the empty string); repeated
rows are encoded each; other columns are unread.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 1 << 19


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: join the adjacent pair of least rank, the leftmost first, while any joins."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Prefixes:
    """The prefix table of one byte string under a vocabulary; append and replace re-use what still holds."""

    def __init__(self, bpe: BytePairs, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """data[start:end] becomes new; entries up to start are kept, and those after the edit are too once they meet the old ones."""
        tail, old = self.data[end:], self.last[end:]
        self.data = self.data[:start] + new
        del self.last[start + 1 :]
        self.bpe.extend(self.data, self.last)
        reach, same = self.bpe.longest, 0
        at = len(self.data)
        self.data += tail
        for i in range(1, len(tail) + 1):
            self.bpe.extend(self.data[: at + i], self.last)
            # a token only depends on the entries that the longest token can reach back to
            same = same + 1 if self.last[-1] == old[i] else 0
            if same > reach:
                self.last += old[i + 1 :]
                return

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first end bytes (of all, if None)."""
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at])
            at -= len(self.bpe.bytes_of[self.last[at]])
        return out[::-1]


class BytePairs:
    #: One for each vocabulary in a Python worker, so tasks after the first start with what it knows.
    made: dict[tuple[str, str], BytePairs] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> BytePairs:
        if (path, pattern) not in cls.made:
            cls.made[path, pattern] = cls(load_ranks(path), pattern)
        return cls.made[path, pattern]

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.bytes_of = ranks, {v: k for k, v in ranks.items()}
        # the pattern's blanks are those with the property White_Space
        self.find = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.split = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])(?= [^\s\x1c-\x1f\x85])").split
        self.longest = max(map(len, ranks))
        self.reach: dict[bytes, int] = {}
        for t in ranks:
            if len(t) > 2:
                self.reach[t[-3:]] = max(len(t), self.reach.get(t[-3:], 2))
        self.alone: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, str] = {}
        self.inner: dict[str, str | None] = {}
        self.names = {v: str(v) for v in ranks.values()}

    def fits(self, before: int, token: int) -> bool:
        """Whether token can follow the token before (-1: nothing) in an encoding."""
        if before < 0:
            ok = self.alone.get(token)
            if ok is None:
                ok = self.alone[token] = merge(self.bytes_of[token], self.ranks) == [token]
            return ok
        key = before << 32 | token
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 2 * MOST:
                self.pairs.clear()
            ok = self.pairs[key] = self.fits(-1, token) and merge(self.bytes_of[before] + self.bytes_of[token], self.ranks) == [before, token]
        return ok

    def extend(self, data: bytes, last: list[int]) -> None:
        """Add the entries of last (entry i: the last token of the first i bytes) that data still lacks."""
        get, fits, known, reach = self.ranks.get, self.fits, self.pairs.get, self.reach.get
        for end in range(len(last), len(data) + 1):
            # no token with these last three bytes is longer
            far = reach(data[end - 3 : end], 2) if end > 2 else end
            for start in range(max(0, end - far), end):
                token = get(data[start:end])
                if token is not None:
                    before = last[start]
                    ok = known(before << 32 | token)
                    if ok or ok is None and fits(before, token):
                        last.append(token)
                        break
            else:
                raise ValueError(f"no token ends at byte {end}")

    def last_of(self, data: bytes, end: int, last: dict[int, int]) -> int:
        """The last token of the first end bytes; only the shorter prefixes that it asks about are entered."""
        get, known = self.ranks.get, self.pairs.get
        far = self.reach.get(data[end - 3 : end], 2) if end > 2 else end
        for start in range(max(0, end - far), end):
            token = get(data[start:end])
            if token is not None:
                before = last[start] if start in last else self.last_of(data, start, last)
                ok = known(before << 32 | token)
                if ok or ok is None and self.fits(before, token):
                    last[end] = token
                    return token
        raise ValueError(f"no token ends at byte {end}")

    def ids_of(self, data: bytes) -> list[int]:
        """The encoding of a piece: the table from its end backwards, or from its start if it is long."""
        if len(data) > 300:
            return Prefixes(self, data).ids()
        last, at, out = {0: -1}, len(data), []
        while at:
            token = last[at] if at in last else self.last_of(data, at, last)
            out.append(token)
            at -= len(self.bytes_of[token])
        return out[::-1]

    def piece(self, piece: str) -> str:
        """Decimal ids of one match of the pattern, joined by commas."""
        got = self.pieces.get(piece)
        if got is None:
            data = piece.encode()
            whole = self.ranks.get(data)
            got = str(whole) if whole is not None else ",".join(map(self.names.__getitem__, self.ids_of(data)))
            if len(self.pieces) > MOST:
                self.pieces.clear()
            if len(piece) < 64:
                self.pieces[piece] = got
        return got

    def joined(self, text: str) -> str:
        return ",".join(map(self.piece, self.find(text)))

    def encode_joined(self, text: str) -> str:
        """Decimal ids of a text, joined by commas."""
        if not text:
            return ""
        first, *rest = text.split(" ")
        if not rest:
            return self.joined(text)
        inner = self.inner
        fresh = {s for s in rest if s not in inner}
        if fresh:
            if len(inner) > MOST:
                inner.clear()
                fresh = set(rest)
            for s in fresh:
                inner[s] = None if not s or s[0].isspace() or s[-1].isspace() else self.joined(" " + s)
        if not first or first[-1].isspace() or None in (out := list(map(inner.__getitem__, rest))):
            return ",".join(x for x in map(self.joined, self.split(text)) if x)
        return ",".join([self.joined(first), *out])

    def encode(self, text: str) -> list[int]:
        got = self.encode_joined(text)
        return list(map(int, got.split(","))) if got else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


COLUMNS = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
TYPES = {"n_tokens": "long", "ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, path: str, pattern: str, columns: tuple[str, ...] = ("n_tokens", "ids"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the asked-for columns: ids, decoded (their bytes), n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BytePairs.of(path, pattern)
        schema = pa.schema([("doc_id", pa.int64()), *((c, COLUMNS[c]) for c in columns)])
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in columns}
            for text in batch.column(1):
                joined = bpe.encode_joined(text.as_py() or "")
                ids = list(map(int, joined.split(","))) if joined else []
                got = {"n_tokens": len(ids), "ids": ids}
                if "decoded" in rows or "decoded_sha256" in rows:
                    got["decoded"] = bpe.decode(ids)
                for c in columns:
                    rows[c].append(got[c] if c in got else hashlib.sha256(joined.encode() if c == "ids_sha256" else got["decoded"]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[c], COLUMNS[c]) for c in columns)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {TYPES[c]}" for c in columns))


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, vocabulary(), PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))
