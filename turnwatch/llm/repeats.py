"""Which hashed keys occur more than once in a corpus, found without moving a row per occurrence.

Documents are dealt to parts by a hash of their id and text. A part sums up its keys, so that a key crosses
the shuffle once per part at most, however often it occurs; keys travel as sorted arrays, dealt to
buckets by their high bits. A bucket tells each part which of its keys occur anywhere else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwatch.llm.rows import arrow_schema, part_of, tidy

KEYS_DDL = "bucket int, part int, keys binary, many binary"
FOUND_DDL, HOT_DDL = "part int, keys binary", "part int, keys binary, hot binary"
NO_ID = -2**63
#: Occurrences of a key in a part are counted up to here.
MOST = 4095


def parted(docs: DataFrame, id_col: str, text_col: str, parts: int, by_id: bool = False) -> DataFrame:
    """``(part, id, text)``. A part is chosen by id and text, so that rows of one id (or none) do not meet
    in one; ``by_id`` chooses by the id alone. Ids are integers; every step groups this frame by ``part``, so the planner shuffles the texts once and reuses that exchange."""
    return docs.select(part_of([id_col] if by_id else [id_col, text_col], parts).alias("part"), F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).alias("text"))


def part_rows(table: pa.Table) -> tuple[list, np.ndarray, list[bytes]]:
    """Ids as given, ids as numbers (a null one before all others) and texts as bytes (a null one
    empty) of a part, by id and text: the same order whenever the part is read."""
    tidy()
    rows = sorted(zip(table["id"].to_pylist(), table["text"].cast(pa.binary()).to_pylist()),
                  key=lambda r: (NO_ID if r[0] is None else r[0], r[1] or b""))
    ids = [r[0] for r in rows]
    return ids, np.array([NO_ID if i is None else i for i in ids], np.int64), [r[1] or b"" for r in rows]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def slices(keys: np.ndarray, buckets: int):
    """``(bucket, start, end)`` of the non-empty buckets of sorted keys."""
    at = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(at)):
        yield int(b), int(at[b]), int(at[b + 1])


def rank_of(hashes: np.ndarray) -> np.ndarray:
    """Trailing zeros of hashes, 15 at most: the greatest rank of d different hashes is about log2(d), whatever their copies."""
    return np.minimum(np.bitwise_count((hashes & (~hashes + np.uint64(1))) - np.uint64(1)), 15).astype(np.uint16)


def key_rows(part: int, occurrences: np.ndarray, buckets: int, ranks: np.ndarray | None = None) -> pa.Table:
    """The distinct keys of a part; for each, in 16 bits, how often it occurs in it (4,095 stands for that and more)
    and the greatest of its ``ranks``."""
    keys, n = np.unique(occurrences, return_counts=True)
    many = np.minimum(n, MOST).astype(np.uint16) << np.uint16(4)
    if ranks is not None and len(keys):
        many |= np.maximum.reduceat(ranks[np.argsort(occurrences, kind="stable")], np.cumsum(n) - n)
    cut = list(slices(keys, buckets))
    return pa.table({
        "bucket": [b for b, _, _ in cut], "part": [part] * len(cut),
        "keys": [keys[s:e].tobytes() for _, s, e in cut],
        "many": [many[s:e].tobytes() for _, s, e in cut]}, schema=arrow_schema(KEYS_DDL))


def repeated_keys(keys: DataFrame, hot: int | None = None) -> DataFrame:
    """From rows of ``key_rows``: ``(part, keys)``, the keys of each part that occur twice or more
    in all parts together, sorted. With ``hot`` (below 4,095) also ``hot``: for each key, whether it occurs more often than that
    with about as many different surroundings, as the ranks tell."""
    ddl = FOUND_DDL if hot is None else HOT_DDL

    def find(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
        every = np.concatenate(lists)
        packed = np.frombuffer(b"".join(table["many"].to_pylist()), np.uint16)
        n, ranks = (packed >> np.uint16(4)).astype(np.int64), packed & np.uint16(15)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        again = np.zeros(len(ranked), bool)
        same = ranked[1:] == ranked[:-1]
        again[1:] |= same
        again[:-1] |= same
        flag = n > 1
        flag[order] |= again
        if hot is not None:
            first = np.flatnonzero(np.append(True, ~same))
            often = (np.add.reduceat(n[order], first) > hot) & (np.maximum.reduceat(ranks[order], first) >= hot.bit_length() - 1)
            hottest = np.zeros(len(every), bool)
            hottest[order] = np.repeat(often, np.diff(np.append(first, len(order))))
        out: dict[int, list] = {}
        ends = np.cumsum([len(x) for x in lists])
        for part, found, end in zip(table["part"].to_pylist(), lists, ends):
            out.setdefault(part, []).append(np.flatnonzero(flag[end - len(found):end]) + end - len(found))
        rows = [(p, np.concatenate(x)) for p, x in out.items()]
        rows = [(p, every[x].tobytes(), x) for p, x in rows if len(x)]
        columns = {"part": [r[0] for r in rows], "keys": [r[1] for r in rows]}
        if hot is not None:
            columns["hot"] = [hottest[r[2]].tobytes() for r in rows]
        return pa.table(columns, schema=arrow_schema(ddl))

    return keys.groupBy("bucket").applyInArrow(find, ddl)


def known(table: pa.Table) -> np.ndarray:
    """The repeated keys that reached a part, sorted."""
    lists = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
    return np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)


def known_hot(table: pa.Table) -> np.ndarray:
    """Those of the repeated keys that are hot, sorted."""
    lists = [np.frombuffer(k, np.uint64)[np.frombuffer(h, bool)] for k, h in zip(table["keys"].to_pylist(), table["hot"].to_pylist())]
    return np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)


def member(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones."""
    if not len(ranked):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ranked, values)
    at[at == len(ranked)] = 0
    return ranked[at] == values


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """The least (or greatest) of every ``width`` values in a row; ``width - 1`` fewer than there are."""
    out, have = values, 1
    if len(values) < width:
        return values[:0]
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[:len(values) - width + 1], out[width - have:]) if have < width else out


def anchors(inner: np.ndarray, starts: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows at ``starts``: the least inner hash of each (``reach`` inner windows lie in one),
    and the positions of all inner windows that are least in some window."""
    least = sliding(inner, reach)[starts]
    chosen = np.zeros(len(inner) + reach, np.uint64)
    chosen[starts + reach - 1] = least
    top = sliding(chosen, reach, np.maximum)[:len(inner)]
    return least, np.flatnonzero((top == inner) & (top > 0))
