"""Vectorised hashing of whole texts: bytes, words and windows of words, one batch at a time.

Words are hashed eight bytes at a time through a bijection of 64 bits, windows of words by joining the
hashes of their halves; two seeds together make 128 bits. Spans of bytes take a polynomial hash modulo 2^64
over table-mapped bytes, which comes from one running sum, so any span costs two look-ups; structured strings of
many hundred bytes can agree in it, so it serves short spans only.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
U64 = np.uint64


@cache
def _base(seed: int) -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(7919 + seed)
    table = rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
    p = int(rng.integers(2**40, 2**62)) * 4 + 3
    return table, p, pow(p, -1, 2**64)


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(seed: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the base (or its inverse) modulo 2^64."""
    have = _POWERS.get((seed, inverse))
    if have is None or len(have) < n:
        _, p, q = _base(seed)
        step = np.full(max(n, 1024), q if inverse else p, np.uint64)
        step[0] = 1
        have = _POWERS[seed, inverse] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def running(values: np.ndarray, seed: int) -> np.ndarray:
    """Running sums of ``values[i] * p^i``, one more than there are values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(seed, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts, ends, seed: int) -> np.ndarray:
    """Hash of each span ``[start, end)`` from running sums; equal spans have equal hashes."""
    return mix((sums[ends] - sums[starts]) * powers(seed, len(sums), True)[starts])


def byte_running(data: np.ndarray, seed: int) -> np.ndarray:
    """Running sums over bytes, for ``span_hash``."""
    return running(_base(seed)[0][data], seed)


class Words:
    """The words of a batch of texts: ``start`` and ``end`` bytes in ``buf``, ``doc`` index, and
    ``first[d]:first[d + 1]``, the range of words of document ``d``. A null text has no words."""

    def __init__(self, texts: list, lower: bool = False):
        raw = [t if isinstance(t, bytes) else (t or "").encode() for t in texts]
        self.buf = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        space = np.ones(len(self.buf) + 1, bool)
        space[1:] = _IS_SPACE[self.buf]
        turn = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = turn[::2], turn[1::2]
        begin = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=begin[1:])
        self.first = np.searchsorted(self.start, begin)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(raw)), self.count)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return word_hash(self.buf, self.start, self.end, seed)

    def windows(self, size: int) -> np.ndarray:
        """Words at which a window of ``size`` words of one document starts."""
        last = self.first[1:] - size
        at = np.arange(len(self.start))
        return at[at <= last[self.doc]]


def batches(texts, limit: int = 4_000_000):
    """Ranges of consecutive texts of about ``limit`` bytes; a longer text is a range by itself."""
    start = used = 0
    for i, t in enumerate(texts):
        size = len(t) if t is not None else 0
        if used and used + size > limit:
            yield start, i
            start, used = i, 0
        used += size
    if start < len(texts):
        yield start, len(texts)


#: Words above this many bytes are hashed one by one.
LONG_WORD = 128
_ODD = U64(0x9E3779B97F4A7C15)


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two things in a row from theirs; for either one given, a bijection of the other."""
    return mix((left ^ (left >> U64(32))) * _ODD + right)


def word_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each span of bytes ``[start, end)``; words of up to eight bytes never share one with each other."""
    size = (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) + U64((seed + 1) * 0xD1B54A32D192ED03 % 2**64))
    padded = np.append(buf, np.zeros(8, np.uint8))
    lanes = np.ndarray(len(buf) + 1, "<u8", padded.data, strides=(1,))
    at, todo = start.astype(np.int64), np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(todo):
        left = size[todo] - done
        lane = lanes[at[todo] + done] & (U64(2**64 - 1) >> (U64(64) - U64(8) * np.clip(left, 1, 8).astype(np.uint64)))
        out[todo] = join_hash(out[todo], np.where(left > 0, lane, U64(0)))
        done += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(buf[start[i]:end[i]].tobytes(), seed + 1)
    return out


def window_hash(word_hashes: np.ndarray, at: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``size`` words from each of ``at``, out of hashes of 1, 2, 4 ... words."""
    at = np.asarray(at, np.int64)
    level, out, done, have = word_hashes, None, 0, 1
    while True:
        if size & have:
            part = level[at + done]
            out = part if out is None else join_hash(out, part)
            done += have
        have *= 2
        if have > size:
            return mix(out + U64(seed + size))
        level = join_hash(level[:-(have // 2)], level[have // 2:]) if len(level) > have // 2 else level[:0]
