"""Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

A text is read as ``step`` strings, one per residue: the string of residue r has the symbols
``text[r:r + step]``, ``text[r + step:r + 2 * step]`` and so on, each followed by its own end mark.
Symbols are ordered by their hash; only equality matters here, not the order of bytes.

The transform of a shard lists, in the order of its suffixes, the symbol before each suffix. Shards
are merged without sorting a suffix again: starting from shard after shard, each round deals the
rows out by the symbol before them, and that orders all suffixes by one symbol more. Two
neighbours that part in round k have k - 1 symbols in common; rows that never part are a repeat.
"""

from __future__ import annotations

import numpy as np

from turnwatch.llm.hashing import byte_running, span_hash

_LOW = np.uint64(0xFFFFFFFF)


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Positions in the order of small non-negative keys, ties by position."""
    packed = (keys.astype(np.uint64) << np.uint64(32)) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    return (packed & _LOW).astype(np.int64)


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, int]:
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, int(new.sum())


class Shard:
    """Suffix order and transform of some texts: ``place[i]`` is the byte at which suffix i starts
    (-1 for a bare end mark), ``before[i]`` the symbol before it (0 for an end mark)."""

    def __init__(self, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, step: int):
        """``symbols`` holds the symbol (1 and up) of each byte at which a whole one starts; texts lie at ``begin``."""
        # Node ids: bytes with a whole symbol, then one end mark per string.
        whole = np.maximum(length - step + 1, 0)
        base = np.repeat(begin - np.append(0, np.cumsum(whole)[:-1]), whole)
        byte = base + np.arange(whole.sum())
        n = len(byte)
        text = np.repeat(np.arange(len(begin)), whole)
        offset = byte - begin[text]
        strings = np.minimum(step, whole)          # strings of each text that have a symbol at all
        first_mark = n + np.append(0, np.cumsum(strings)[:-1])
        marks = int(strings.sum())
        node = np.full(int((begin + length).max(initial=0)) + 1, -1, np.int64)
        node[byte] = np.arange(n)
        has_next = offset + step < whole[text]
        following = np.where(has_next, node[np.where(has_next, byte + step, byte)], first_mark[text] + offset % step)
        after = np.concatenate([following, np.arange(n, n + marks)])
        # Order by one symbol, then by twice as many as before; end marks come first, each unlike any other.
        rank = np.concatenate([symbols[byte] + marks, np.arange(marks)])
        rank, kinds = _ranks(rank)
        while kinds < len(rank):
            rank, kinds = _ranks(rank * len(rank) + rank[after])
            after = after[after]
        order = np.empty(len(rank), np.int64)
        order[rank] = np.arange(len(rank))
        previous = np.zeros(n + marks, np.int64)   # an end mark before the first symbol of a string
        previous[following] = symbols[byte]
        self.before = previous[order]
        self.place = np.where(order < n, byte[np.minimum(order, max(0, n - 1))] if n else -1, -1)
        self.marks = marks


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards by ``depth`` symbols and, for each row, how many symbols it has in
    common with the row above (``depth`` or more counts as ``depth``)."""
    source = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(s.before) for s in shards])
    before = np.concatenate([s.before for s in shards])
    marks = np.repeat(np.arange(len(shards), dtype=np.uint16), [s.marks for s in shards])
    block = np.zeros(len(source), np.int64)
    common = np.full(len(source), depth, np.int64)
    common[:1] = 0
    for done in range(depth):
        row = np.argsort(source, kind="stable")    # the rows of shard 0 in order, then of shard 1, ...
        symbol = np.empty_like(before)
        symbol[row] = before
        order = stable_order(symbol)
        symbol, came = symbol[order], block[order]
        source = source[order]
        source[:len(marks)] = marks                # end marks keep the order of their strings
        parted = np.ones(len(order), bool)
        parted[1:] = (symbol[1:] != symbol[:-1]) | (came[1:] != came[:-1]) | (symbol[1:] == 0)
        common[parted & (common == depth)] = done
        block = np.cumsum(parted)
    return source, common


def repeated_places(texts: list[bytes], size: int, step: int, shard_bytes: int) -> np.ndarray:
    """For the texts laid end to end: at which bytes a string of ``size`` bytes of one text starts
    that starts at another byte as well."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    length = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(length) - length
    found = np.zeros(len(data), bool)
    if len(data) < size:
        return found
    sums = byte_running(data, 0)
    at = np.arange(len(data) - step + 1)
    symbols, _ = _ranks(span_hash(sums, at, at + step, 0))
    symbols = np.concatenate([symbols + 1, np.zeros(step - 1, np.int64)])
    # Neighbouring texts go to different shards.
    n = max(1, -(-len(data) // shard_bytes))
    shards = [Shard(symbols, begin[i::n], length[i::n], step) for i in range(min(n, len(texts)))]
    source, common = merge(shards, size // step)
    same = common >= size // step
    repeat = same.copy()
    repeat[:-1] |= same[1:]
    by_shard = repeat[np.argsort(source, kind="stable")]
    place = np.concatenate([s.place for s in shards])
    found[place[by_shard & (place >= 0)]] = True
    return found
