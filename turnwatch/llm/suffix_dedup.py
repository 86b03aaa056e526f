"""Suffix-array dedup of bytes by merged Burrows-Wheeler transforms (operator 1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from turnwatch.llm.bwt import repeated_places
from turnwatch.llm.hashing import batches, byte_running, span_hash
from turnwatch.llm.repeats import (
    KEYS_DDL, anchors, bucket_of, key_rows, known, known_hot, member, part_rows, parted, rank_of, repeated_keys,
    slices)
from turnwatch.llm.rows import arrow_schema, parts_of

SIZE, GRAM, STEP = 200, 128, 25
#: Bytes of a shard, of the texts merged together, and of texts hashed together.
SHARD_BYTES, MERGE_BYTES, BATCH_BYTES = 125_000, 500_000, 400_000
CONTEXTS_DDL = "bucket int, part int, ids binary, keys binary, many binary, lengths binary, data binary"
FLAGS_DDL = "part int, ids binary, flags binary"
#: A key that occurs more often, in about as many different surroundings, is hot. Around each occurrence lie fewer than
#: ``2 * SIZE - GRAM`` bytes; that d different surroundings are taken for few has a chance of about exp(-d / 1024).
HOT = MERGE_BYTES // (2 * SIZE - GRAM)


class Bytes:
    """A batch of texts laid end to end, with the places where a string of ``size`` bytes starts."""

    def __init__(self, texts: list[bytes], size: int, gram: int):
        self.data = b"".join(texts)
        length = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(length) - length
        whole = np.maximum(length - size + 1, 0)
        self.starts = np.repeat(self.begin - (np.cumsum(whole) - whole), whole) + np.arange(whole.sum())
        self.sums = byte_running(np.frombuffer(self.data, np.uint8), 0)
        at = np.arange(max(0, len(self.data) - gram + 1))
        self.inner = span_hash(self.sums, at, at + gram, 0)
        self.least, self.chosen = anchors(self.inner, self.starts, size - gram + 1)

    def keys(self) -> np.ndarray:
        return self.inner[self.chosen]

    def ranks(self, size: int, gram: int) -> np.ndarray:
        """Of each key, the rank of the bytes around it that strings of ``size`` bytes reach."""
        text = np.searchsorted(self.begin, self.chosen, "right") - 1
        end = np.append(self.begin[1:], len(self.data))[text]
        around = span_hash(self.sums, np.maximum(self.chosen - (size - gram), self.begin[text]), np.minimum(self.chosen + size, end), 0)
        return rank_of(around)

    def windows(self, hot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the strings of hot keys, and 128 bits of hash of each whole string."""
        starts = self.starts[member(self.least, hot)]
        if not len(starts):
            return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        second = byte_running(np.frombuffer(self.data, np.uint8), 1)
        return starts, span_hash(self.sums, starts, starts + size, 0), span_hash(second, starts, starts + size, 1)

    def contexts(self, repeated: np.ndarray, hot: np.ndarray, size: int):
        """``(first start, last start, key)`` of runs of strings that may repeat and share a key that is not hot."""
        maybe = member(self.least, repeated) & ~member(self.least, hot)
        starts, key = self.starts[maybe], self.least[maybe]
        new = np.ones(len(starts), bool)
        new[1:] = (key[1:] != key[:-1]) | (np.diff(starts) != 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1 if len(first) else first
        return starts[first], starts[last], key[first]


def _folded(first: np.ndarray, second: np.ndarray, many: np.ndarray):
    """Distinct pairs of hashes, in order, and whether each occurs twice or is marked already."""
    order = np.lexsort((second, first))
    first, second, many = first[order], second[order], many[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(first)))
    marked = np.logical_or.reduceat(many, at) if len(at) else many
    return first[at], second[at], (count > 1) | marked


def _local(texts: list[bytes], repeated: np.ndarray, hot: np.ndarray, size: int, gram: int, see):
    """Distinct contexts of a part, ``{bytes: [local id, key, many]}``, and where each stands:
    ``(batch start, start in the batch, local id)``. ``see`` gets the strings of hot keys of each batch: its start,
    their starts and hashes."""
    found: dict[bytes, list] = {}
    places = []
    for a, b in batches(texts, BATCH_BYTES):
        batch = Bytes(texts[a:b], size, gram)
        if len(hot):
            see(a, *batch.windows(hot, size))
        for s, e, key in zip(*batch.contexts(repeated, hot, size)):
            text = batch.data[s:e + size]
            entry = found.get(text)
            if entry is None:
                entry = found[text] = [len(found), key, False]
            else:
                entry[2] = True
            places.append((a, int(s), entry[0]))
    return found, places


def _settle(contexts: list[tuple[int, bytes, bool]], size: int, step: int) -> list[np.ndarray]:
    """For each ``(key, text, twice)``: at which of its bytes a repeated string starts. Keys are
    settled in groups of bounded size; a key of which every text is a copy already needs no merge."""
    out: list = [None] * len(contexts)
    order = sorted(range(len(contexts)), key=lambda i: contexts[i][0])
    group: list[int] = []
    used = 0

    def settle():
        flags = repeated_places([contexts[i][1] for i in group], size, step, SHARD_BYTES)
        at = 0
        for i in group:
            n = len(contexts[i][1])
            out[i] = flags[at:at + n]
            at += n

    start = 0
    while start < len(order):
        end = start
        while end < len(order) and contexts[order[end]][0] == contexts[order[start]][0]:
            end += 1
        same = order[start:end]
        start = end
        if all(contexts[i][2] for i in same):
            continue
        n = sum(len(contexts[i][1]) for i in same)
        if group and used + n > MERGE_BYTES:
            settle()
            group, used = [], 0
        group += same
        used += n
    if group:
        settle()
    for i, (_, text, twice) in enumerate(contexts):
        if twice:
            out[i] = np.ones(len(text), bool)
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                 gram: int = GRAM, step: int = STEP, parts: int | None = None, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``, one row per row of ``docs``: every byte is
    removed that a string of ``size`` bytes covers which starts anywhere else too, in the same
    document or another; ``n_spans`` counts the runs removed, ``kept`` has the bytes left. Strings never cross documents.

    Of the ``gram``-byte strings inside a string of ``size`` bytes the one of least hash is its key.
    Strings whose key occurs once in the corpus cannot repeat. The others go, in runs that share a key, to the
    task of that key; exact copies of a run are one entry. There they are dealt to shards, and the
    shards' Burrows-Wheeler transforms (symbols of ``step`` bytes) are merged: strings that have ``size`` bytes
    in common stand in one interval. Strings of a key that occurs more than ``hot`` times in different surroundings are dealt further, each by a hash of
    all its bytes (128 bits), so that no group grows with the number of texts around one passage: a
    part sends each of them once, and a hash that comes twice is a repeat.

    A null text has no bytes. Texts shorter than ``size`` lose nothing. Rows that repeat an id are
    documents of their own, so a repeated row of ``size`` bytes or more is removed. Ids are integers; other columns are not read."""
    if size % step or not 0 < gram <= size:
        raise ValueError("size must be a multiple of step and no less than gram")
    parts = parts or parts_of(docs, text_col)
    source = parted(docs, id_col, text_col, parts)

    def count(key, table):
        texts = part_rows(table)[2]
        keys, ranks = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
        for a, b in batches(texts, BATCH_BYTES):
            batch = Bytes(texts[a:b], size, gram)
            keys.append(batch.keys())
            ranks.append(batch.ranks(size, gram))
        return key_rows(key[0].as_py(), np.concatenate(keys), parts, np.concatenate(ranks))

    found = repeated_keys(source.groupBy("part").applyInArrow(count, KEYS_DDL), hot)
    contexts_schema = arrow_schema(CONTEXTS_DDL)

    def contexts(key, table, repeated):
        seen = []
        local, _ = _local(part_rows(table)[2], known(repeated), known_hot(repeated), size, gram,
                          lambda _, starts, x, y: seen.append(_folded(x, y, np.zeros(len(x), bool)))) if len(table) else ({}, [])
        out = {name: [] for name in contexts_schema.names}
        if seen:
            # A row without ids holds the strings of hot keys: first hash, second hash, whether it came twice.
            x, y, twice = _folded(*(np.concatenate(c) for c in zip(*seen)))
            for b, s, e in slices(x, parts):
                row = (b, key[0].as_py(), None, x[s:e].tobytes(), twice[s:e].tobytes(), None, y[s:e].tobytes())
                for name, value in zip(contexts_schema.names, row):
                    out[name].append(value)
        if local:
            texts = list(local)
            ids, keys, many = (np.array([v[i] for v in local.values()], t) for i, t in enumerate((np.int32, np.uint64, bool)))
            bucket = bucket_of(keys, parts)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
            for s, e in zip(cut, [*cut[1:], len(order)]):
                pick = order[s:e]
                row = (int(bucket[pick[0]]), key[0].as_py(), ids[pick].tobytes(), keys[pick].tobytes(), many[pick].tobytes(),
                       np.array([len(texts[i]) for i in pick], np.int32).tobytes(), b"".join(texts[i] for i in pick))
                for name, value in zip(contexts_schema.names, row):
                    out[name].append(value)
        return pa.table(out, schema=contexts_schema)

    flags_schema = arrow_schema(FLAGS_DDL)

    def settle(table: pa.Table) -> pa.Table:
        entries: dict[bytes, list] = {}
        sent, hashed = [], []
        for r in table.to_pylist():
            if r["ids"] is None:
                hashed.append((r["part"], np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["data"], np.uint64),
                               np.frombuffer(r["many"], bool)))
                continue
            at = 0
            data = r["data"]
            mine = []
            for k, m, n in zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["many"], bool).tolist(),
                               np.frombuffer(r["lengths"], np.int32).tolist()):
                text = data[at:at + n]
                at += n
                entry = entries.get(text)
                if entry is None:
                    entry = entries[text] = [len(entries), k, m]
                else:
                    entry[2] = True
                mine.append(entry[0])
            sent.append((r["part"], r["ids"], mine))
        flags = _settle([(k, text, twice) for text, (_, k, twice) in entries.items()], size, step)
        packed = [np.packbits(np.concatenate([flags[i][:len(flags[i]) - size + 1] for i in mine])).tobytes()
                  for _, _, mine in sent]
        out = {"part": [s[0] for s in sent], "ids": [s[1] for s in sent], "flags": packed}
        if hashed:
            x, y, twice = _folded(*(np.concatenate([h[i] for h in hashed]) for i in (1, 2, 3)))
            x, y = np.sort(x[twice]), np.sort(y[twice])
            for part, mine, second, _ in hashed:
                again = member(mine, x) & member(second, y)
                # A row without ids again: the hashes of the part's strings that repeat.
                out["part"].append(part)
                out["ids"].append(None)
                out["flags"].append(np.concatenate([mine[again], second[again]]).tobytes())
        return pa.table(out, schema=flags_schema)

    sent = source.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(contexts, CONTEXTS_DDL)
    flags = sent.groupBy("bucket").applyInArrow(settle, FLAGS_DDL)
    out_ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    out_schema = arrow_schema(out_ddl)

    def cut(key, table, repeated, hot_keys, answers):
        given, _, texts = part_rows(table)
        length = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(length) - length
        total = int(length.sum())
        edge = np.zeros(total + 1, np.int32)
        pairs = [np.frombuffer(r, np.uint64).reshape(2, -1) for r in answers.filter(answers["ids"].is_null())["flags"].to_pylist()]
        firsts, seconds = (np.sort(np.concatenate([np.zeros(0, np.uint64), *(p[i] for p in pairs)])) for i in (0, 1))

        def see(a, starts, first, second):
            hit = begin[a] + starts[member(first, firsts) & member(second, seconds)]
            edge[hit] += 1
            edge[hit + size] -= 1

        local, places = _local(texts, repeated, hot_keys, size, gram, see)
        answers = answers.filter(answers["ids"].is_valid())
        width = np.array([len(t) - size + 1 for t in local], np.int64)
        by_id: list = [None] * len(local)
        for r in answers.to_pylist():
            ids = np.frombuffer(r["ids"], np.int32)
            bits = np.unpackbits(np.frombuffer(r["flags"], np.uint8))
            end = np.cumsum(width[ids])
            for i, s, e in zip(ids, end - width[ids], end):
                by_id[i] = bits[s:e]
        for first, s, i in places:
            at = begin[first] + s
            hit = np.flatnonzero(by_id[i])
            edge[at + hit] += 1
            edge[at + hit + size] -= 1
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        removed, spans, kept = [], [], []
        for text, s, n in zip(texts, begin, length):
            g = gone[s:s + n]
            r = int(g.sum())
            removed.append(r)
            spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if r else 0)
            kept.append(np.frombuffer(text, np.uint8)[~g].tobytes() if r else text)
        return pa.table({"doc_id": given, "n_bytes": length, "n_removed": removed, "n_spans": spans, "kept": kept},
                        schema=out_schema)

    # One frame of answers for a part: its repeated keys and the flags of its contexts.
    answers = found.selectExpr("part", "keys", "hot", "cast(null as binary) ids", "cast(null as binary) flags").unionByName(
        flags.selectExpr("part", "cast(null as binary) keys", "cast(null as binary) hot", "ids", "flags"))

    def finish(key, table, mixed):
        if not len(table):
            return out_schema.empty_table()
        is_key = mixed["keys"].is_valid()
        keys = mixed.filter(is_key)
        return cut(key, table, known(keys), known_hot(keys), mixed.filter(pa.compute.invert(is_key)))

    return source.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(finish, out_ddl)
