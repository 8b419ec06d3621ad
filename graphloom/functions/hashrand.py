"""Uniform numbers from ids and salts that any SQL engine can reproduce, and hyperbolic geometry as columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(salt: int | str, *ids: Column | str) -> Column:
    """In [0, 1), from the first 32 bits of the md5 of the ids and the salt, joined by colons."""
    cols = [F.col(c) if isinstance(c, str) else c for c in ids]
    text = F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(salt)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def below(salt: int | str, chance: float, *ids: Column | str) -> Column:
    """uniform(salt, *ids) < chance, told by the digits of the md5 alone, without making numbers of them."""
    least = math.ceil(chance * 4294967296.0)  # the first 32 bits that are not below
    if least <= 0 or least >= 1 << 32:
        return F.lit(least > 0)
    cols = [F.col(c) if isinstance(c, str) else c for c in ids]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(salt))).cast("binary")) < F.lit(f"{least:08x}")


_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * 4294967296) for i in range(64)]
#: Bytes of a text that the md5 takes in one turn.
ONE_TURN = 55


class PairsBelow:
    """Those of the ids v (rising, not negative) for which below(salt, chance, u, v) holds, for one u after another.

    The texts "u:v:salt" of all v of so many digits are hashed at once, a word at a time; they must not be longer than ONE_TURN. Only the first
    32 bits count, so the last three of the 64 steps are left out.
    """

    def __init__(self, salt: int | str, least: int, v: np.ndarray):
        self.least, self.v, self.tail = np.uint32(least), v, f":{salt}".encode()
        digits = np.array([len(str(int(x))) for x in v]) if len(v) < 2 else np.searchsorted(np.array([10**k for k in range(1, 19)]), v, "right") + 1
        cuts = np.flatnonzero(np.diff(digits)) + 1
        self.runs = [(int(i), int(j), int(digits[i])) for i, j in zip([0, *cuts], [*cuts, len(v)], strict=True)] if len(v) else []
        self.words: dict[tuple[int, int], np.ndarray] = {}
        self.room = np.empty((6, len(v)), np.uint32)

    def _tails(self, run: int, lead: int) -> np.ndarray:
        """Words of "v:salt" and the end mark, begun `lead` bytes into a word."""
        if (run, lead) not in self.words:
            i, j, d = self.runs[run]
            n = lead + d + len(self.tail) + 1
            text = np.zeros((j - i, -(-n // 4) * 4), np.uint8)
            rest = self.v[i:j].copy()
            for k in range(d - 1, -1, -1):
                text[:, lead + k] = 48 + rest % 10
                rest //= 10
            text[:, lead + d : n] = np.frombuffer(self.tail + b"\x80", np.uint8)
            self.words[run, lead] = np.ascontiguousarray(text.view("<u4").T)
        return self.words[run, lead]

    def among(self, u: int, first: int = 0) -> np.ndarray:
        """The ids v from place `first` on that are drawn with u."""
        head = f"{u}:".encode()
        lead, out = len(head) % 4, []
        fixed = np.frombuffer(head + bytes(-len(head) % 4), "<u4")
        for run, (i, j, d) in enumerate(self.runs):
            skip = max(0, first - i)
            if skip >= j - i:
                continue
            varied = self._tails(run, lead)[:, skip:]
            m: list = [0] * 16
            for k, w in enumerate(fixed.tolist()):
                m[k] = w
            for k, w in enumerate(varied, len(head) // 4):
                m[k] = w | np.uint32(m[k]) if m[k] else w
            m[14] = 8 * (len(head) + d + len(self.tail))
            digest = self._digest(m, self.room[:, : j - i - skip])
            out.append(self.v[i + skip + np.flatnonzero(digest.byteswap() < self.least)])
        return np.concatenate(out) if out else self.v[:0]

    @staticmethod
    def _digest(m: list, room: np.ndarray) -> np.ndarray:
        """The first 32 bits of the md5 of blocks of 16 words, numbers or arrays; room: six arrays to work in."""
        a, b, c, d, f, t = room
        for x, v in ((a, 0x67452301), (b, 0xEFCDAB89), (c, 0x98BADCFE), (d, 0x10325476)):
            x[:] = v
        for i in range(61):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
                g = i
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
                g = (5 * i + 1) % 16
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
                g = (3 * i + 5) % 16
            else:
                np.bitwise_not(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
                g = 7 * i % 16
            np.add(f, a, out=f)
            if isinstance(m[g], np.ndarray):
                np.add(f, m[g], out=f)
                np.add(f, np.uint32(_SINES[i]), out=f)
            else:
                np.add(f, np.uint32((_SINES[i] + m[g]) & 0xFFFFFFFF), out=f)
            np.left_shift(f, np.uint32(_TURNS[i]), out=t)
            np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f)
            np.bitwise_or(f, t, out=f)
            np.add(f, b, out=f)
            a, b, c, d, f = d, f, b, c, a
        return b + np.uint32(0x67452301)


def uniform_sql(salt: int | str, *ids: str) -> str:
    return f"(('0x' || substr(md5({' || '.join(f'{i} || chr(58)' for i in ids)} || '{salt}'), 1, 8))::bigint / 4294967296.0)"


def acosh_radius(u: Column, alpha: float, R: float) -> Column:
    """The radius at which a share u of the points of a disk of radius R lies further in."""
    import math

    return F.acosh(F.lit(1.0) + u * F.lit(math.cosh(alpha * R) - 1)) / F.lit(alpha)


def angle_between(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    import math

    return F.least(d, F.lit(2 * math.pi) - d)
