"""Seeded hash draws: reproducible in any engine, independent of row order."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def sha_hex(text: Column) -> Column:
    return F.sha2(text.cast("string"), 256)


def hex_uint(hex_text: Column, start: int = 1, digits: int = 8) -> Column:
    return F.conv(F.substring(hex_text, start, digits), 16, 10).cast("bigint")


def stable_seed(base: int, label: Column) -> Column:
    """First four digest bytes of ``base:label``, big-endian."""
    return hex_uint(sha_hex(F.concat(F.lit(f"{base}:"), label.cast("string"))))


def stable_seed_le(base: int, image: Column, condition: Column) -> Column:
    """Little-endian variant over ``base NUL image NUL condition``."""
    h = sha_hex(F.concat_ws("\u0000", F.lit(str(base)), image.cast("string"), condition.cast("string")))
    flipped = F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)])
    return hex_uint(flipped)


def order_key(seed: int, stage: Column, value: Column) -> Column:
    """Hex digest of ``seed NUL stage NUL value``; sort by it for a stable shuffle."""
    return sha_hex(F.concat_ws("\u0000", F.lit(str(seed)), stage, value.cast("string")))


def draw(*parts: Column) -> Column:
    """32-bit integer from the md5 of colon-joined parts."""
    return hex_uint(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])))


def uniform(*parts: Column) -> Column:
    """Uniform double in (0, 1)."""
    return (draw(*parts) + F.lit(0.5)) / F.lit(4294967296.0)


# MD5 (RFC 1321): rotations, sine constants, first state and the word that a step takes
_TURNS = [r for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for r in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_ONE_BLOCK = 55  # bytes of a text that MD5 takes in one step
_TOGETHER = 8192  # texts hashed in one array, which stays in the cache


def _md5_begin(words: list, n: int) -> np.ndarray:
    """First four digest bytes, as a big-endian number, of ``n`` one-block texts; a word of the block is an array or the same int for all."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _STATE)
    f, shifted = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:
            np.bitwise_or(np.bitwise_not(d, out=f), b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        word = words[_WORD[i]]
        if isinstance(word, int):
            f += np.uint32((word + _SINES[i]) & 0xFFFFFFFF)
        else:
            f += np.uint32(_SINES[i])
            f += word
        np.left_shift(f, np.uint32(_TURNS[i]), out=shifted)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f)
        np.bitwise_or(f, shifted, out=f)
        f += b
        a, d, c, b, f = d, c, b, f, a
    return (a + np.uint32(_STATE[0])).byteswap()


class Draws:
    """``draw(head..., number, tail)`` of the numbers from ``start`` to below ``count`` for one tail after the other, in numpy inside a task."""

    def __init__(self, *head: object, count: int, start: int = 0):
        self.head, self.count, self.start, self.widths = ":".join(map(str, [*head, ""])).encode(), count, start, []
        low = start
        while low < count:  # numbers of equal width have their tail at the same place
            width = len(str(low))
            high = min(count, 10**width)
            if (at := len(self.head) + width) <= _ONE_BLOCK:
                block = np.zeros((high - low, 64), np.uint8)
                block[:, : len(self.head)] = np.frombuffer(self.head, np.uint8)
                block[:, len(self.head) : at] = np.arange(low, high)[:, None] // 10 ** np.arange(width)[::-1] % 10 + ord("0")
                words = [int(w[0]) if (w == w[0]).all() else np.ascontiguousarray(w) for w in block.view("<u4").T]
                self.widths.append((low, high, at, words))
            low = high

    def __call__(self, tails: list[str | None]) -> np.ndarray:
        """(tails, replicates): a 32-bit number each; as in ``concat_ws``, a missing tail leaves out its colon."""
        ends = [b"" if t is None else b":" + t.encode() for t in tails]
        out = np.empty((len(ends), self.count - self.start), np.uint32)
        for size in set(map(len, ends)):
            alike = np.array([i for i, e in enumerate(ends) if len(e) == size])
            done = self.start
            for low, high, at, words in self.widths:
                if at + size > _ONE_BLOCK:
                    break
                close = b"\x80" + bytes(_ONE_BLOCK - at - size) + (8 * (at + size)).to_bytes(8, "little")
                step = max(1, _TOGETHER // (high - low))
                for few in (alike[i : i + step] for i in range(0, len(alike), step)):
                    rest = np.frombuffer(b"".join(bytes(at) + ends[i] + close for i in few), "<u4").reshape(len(few), 16)
                    texts = [self._word(w, r, high - low) for w, r in zip(words, rest.T, strict=True)]
                    out[few, low - self.start : high - self.start] = _md5_begin(texts, len(few) * (high - low)).reshape(len(few), -1)
                done = high
            for i in alike if done < self.count else ():
                out[i, done - self.start :] = [int.from_bytes(hashlib.md5(self.head + str(k).encode() + ends[i]).digest()[:4], "big") for k in range(done, self.count)]
        return out

    @staticmethod
    def _word(number, rest: np.ndarray, n: int):
        """One word of the texts of some tails, one after the other, of the share of the ``n`` numbers and that of the tails."""
        if isinstance(number, int):
            return number | int(rest[0]) if (rest == rest[0]).all() else np.repeat(rest | np.uint32(number), n)
        return (rest[:, None] | number).ravel()
