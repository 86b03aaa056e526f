"""Substring dedup over words by level-wise doubling (operator 10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnwatch.llm.hashing import Words, batches, window_hash
from turnwatch.llm.repeats import (
    KEYS_DDL, anchors, key_rows, known, member, part_rows, parted, repeated_keys, slices)
from turnwatch.llm.rows import arrow_schema, parts_of

SIZE = 20
SEED = 5
#: Bytes of texts hashed together.
BATCH_BYTES = 1_000_000
WINDOWS_DDL = "bucket int, part int, own boolean, h1 binary, h2 binary, doc binary, at binary, row binary"
GONE_DDL = "part int, row binary, at binary"


def lengths(seed: int, size: int) -> list[int]:
    """Window lengths of the levels: ``seed``, doubled up to ``size``."""
    out = [seed]
    while out[-1] < size:
        out.append(2 * out[-1])
    if out[-1] != size or seed < 1:
        raise ValueError(f"size {size} is not seed {seed} doubled")
    return out


class Level:
    """The words of some texts and, at each length, the shorter window that stands for a full one.

    Two equal windows hold the same shorter windows at the same places, so the one with the least
    hash stands for the full window: if that one occurs once in the corpus, so does the full window."""

    def __init__(self, texts: list[bytes], size: int):
        self.words, self.size = Words(texts), size
        self.hashes = self.words.hashes()
        self.starts = self.words.windows(size)

    def _inner(self, length: int) -> np.ndarray:
        every = np.arange(max(0, len(self.hashes) - length + 1))
        return window_hash(self.hashes, every, length)

    def keep(self, length: int, repeated: np.ndarray) -> None:
        """Only full windows whose representative of this length repeats are extended further."""
        least, _ = anchors(self._inner(length), self.starts, self.size - length + 1)
        self.starts = self.starts[member(least, repeated)]

    def keys(self, length: int) -> np.ndarray:
        inner = self._inner(length)
        return inner[anchors(inner, self.starts, self.size - length + 1)[1]]

    def full(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of every full window that is left."""
        return (window_hash(self.hashes, self.starts, self.size),
                window_hash(self.words.hashes(1), self.starts, self.size, 1))


def _first_of(h1, h2, doc, at) -> tuple[np.ndarray, np.ndarray]:
    """The order of windows by hashes, document and place, and in that order whether an equal
    window stands at an earlier place."""
    order = np.lexsort((at, doc, h2, h1))
    h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
    head = np.ones(len(order), bool)
    head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(order) else order
    return order, (doc != doc[lead]) | (at != at[lead])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = SIZE, seed: int = SEED, parts: int | None = None) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``, one row per row of ``docs``: every word is removed
    that a window of ``size`` words covers whose words also start at a smaller (id, place). ``kept``
    has the other words, joined by one space. Words are runs without ASCII white space; windows are judged on the input.

    Windows of ``seed`` words are counted first; only those that occur twice or more are extended to
    twice the length, and so on up to ``size`` or until none is left. Equality at full length is by 128 bits of hash.

    A text that is null, empty or shorter than a window loses nothing. A null id stands before all
    others. Rows that repeat an id and a text stand at the same places: neither comes later. Ids are
    integers; other columns of ``docs`` are not read."""
    parts = parts or parts_of(docs, text_col)
    source = parted(docs, id_col, text_col, parts)
    levels = lengths(seed, size)
    steps = levels[:-1]

    def levels_of(texts: list[bytes], shorter: int | None, repeated):
        """Each batch of a part, its first text's place and the windows that the shorter length leaves."""
        for a, b in batches(texts, BATCH_BYTES):
            state = Level(texts[a:b], size)
            if shorter is not None:
                state.keep(shorter, repeated)
            yield a, state

    def keys_of(key, table, length: int, shorter: int | None, repeated):
        found = [state.keys(length) for _, state in levels_of(part_rows(table)[2], shorter, repeated)]
        return key_rows(key[0].as_py(), np.concatenate([np.zeros(0, np.uint64), *found]), parts)

    def first_level(length: int):
        def count(key, table):
            return keys_of(key, table, length, None, None)
        return source.groupBy("part").applyInArrow(count, KEYS_DDL)

    def next_level(length: int, shorter: int, found: DataFrame):
        def extend(key, table, repeated):
            return keys_of(key, table, length, shorter, known(repeated))
        return source.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(extend, KEYS_DDL)

    found = None
    for step, length in enumerate(steps):
        keys = next_level(length, steps[step - 1], found) if step else first_level(length)
        found = repeated_keys(keys)

    schema = arrow_schema(WINDOWS_DDL)

    def windows(key, table, repeated):
        """A row per bucket with the first window of each kind in this part, and one with the
        places of the later ones (``own``), which need no comparison with other parts."""
        if not len(table):
            return schema.empty_table()
        part = key[0].as_py()
        _, ids, texts = part_rows(table)
        found = [(np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int32),) * 2]
        for a, state in levels_of(texts, steps[-1] if steps else None, known(repeated) if steps else None):
            doc = state.words.doc[state.starts]
            found.append((*state.full(), (a + doc).astype(np.int32), (state.starts - state.words.first[doc]).astype(np.int32)))
        h1, h2, row, at = (np.concatenate(c) for c in zip(*found))
        order, later = _first_of(h1, h2, ids[row], at)
        h1, h2, row, at = h1[order], h2[order], row[order], at[order]
        out = {name: [] for name in schema.names}

        def put(bucket, own, pick):
            for name, value in zip(schema.names, (bucket, part, own, h1[pick], h2[pick], ids[row[pick]], at[pick], row[pick])):
                out[name].append(value.tobytes() if isinstance(value, np.ndarray) and not own or name in ("at", "row")
                                 else b"" if isinstance(value, np.ndarray) else value)

        if later.any():
            put(part, True, later)
        sent = np.flatnonzero(~later)
        for b, s, e in slices(h1[sent], parts):
            put(b, False, sent[s:e])
        return pa.table(out, schema=schema)

    gone_schema = arrow_schema(GONE_DDL)

    def later_ones(table: pa.Table) -> pa.Table:
        """By part, the places of windows that are not the first of their kind."""
        own = table["own"].to_pylist()
        part = table["part"].to_pylist()
        cols = {c: table[c].to_pylist() for c in ("h1", "h2", "doc", "at", "row")}
        out = [(p, r, a) for p, o, r, a in zip(part, own, cols["row"], cols["at"]) if o]
        sent = [i for i, o in enumerate(own) if not o]
        if sent:
            h1, h2 = (np.frombuffer(b"".join(cols[c][i] for i in sent), np.uint64) for c in ("h1", "h2"))
            doc = np.frombuffer(b"".join(cols["doc"][i] for i in sent), np.int64)
            at, row = (np.frombuffer(b"".join(cols[c][i] for i in sent), np.int32) for c in ("at", "row"))
            where = np.repeat([part[i] for i in sent], [len(cols["at"][i]) // 4 for i in sent])
            order, later = _first_of(h1, h2, doc, at)
            hit = order[later]
            hit = hit[np.argsort(where[hit], kind="stable")]
            cut = np.flatnonzero(np.append(True, where[hit][1:] != where[hit][:-1])) if len(hit) else []
            for s, e in zip(cut, [*cut[1:], len(hit)]):
                out.append((int(where[hit[s]]), row[hit[s:e]].tobytes(), at[hit[s:e]].tobytes()))
        return pa.table({"part": [o[0] for o in out], "row": [o[1] for o in out], "at": [o[2] for o in out]},
                        schema=gone_schema)

    if steps:
        sent = source.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(windows, WINDOWS_DDL)
    else:
        sent = source.groupBy("part").applyInArrow(lambda key, table: windows(key, table, None), WINDOWS_DDL)
    gone = sent.groupBy("bucket").applyInArrow(later_ones, GONE_DDL)

    out_ddl = "doc_id long, n_words long, n_removed long, kept string"
    out_schema = arrow_schema(out_ddl)

    def cut(key, table, places):
        if not len(table):
            return out_schema.empty_table()
        given, _, texts = part_rows(table)
        row = np.frombuffer(b"".join(places["row"].to_pylist()), np.int32)
        at = np.frombuffer(b"".join(places["at"].to_pylist()), np.int32)
        order = np.argsort(row, kind="stable")
        row, at = row[order], at[order]
        begin = np.searchsorted(row, np.arange(len(texts) + 1))
        total, removed, kept = [], [], []
        for i, text in enumerate(texts):
            words = text.split()
            total.append(len(words))
            starts = at[begin[i]:begin[i + 1]]
            n = 0
            if len(starts):
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + size, -1)
                stay = np.cumsum(edge[:-1]) == 0
                n = len(words) - int(stay.sum())
                words = [words[j] for j in np.flatnonzero(stay)]
            removed.append(n)
            kept.append(b" ".join(words))
        return pa.table({"doc_id": given, "n_words": total, "n_removed": removed,
                         "kept": pa.array(kept, pa.binary()).cast(pa.string())}, schema=out_schema)

    return source.groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(cut, out_ddl)
