"""Exact similarity search without pair tables.

A task holds a block of messages against a block of anchors, multiplies the two
matrices and hands on only the best ``k`` per message. An anchor side whose size
was checked is broadcast and the messages never move; a larger one is cut into
blocks and the partial answers are merged. Similarities carry nine decimals so
that equal vectors tie exactly wherever they are computed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache, cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwatch.session import broadcast_if_small

SCALE = 1e9
BROADCAST_VALUES = 16_000_000   # anchors x dimensions allowed in a broadcast
CELLS = 4_000_000               # similarity cells a task holds at a time
DENSE = 1024                    # anchors up to here are compared in one exact matrix
STRIP, STRIP_ROWS = 512, 512    # anchors and views that are scanned together beyond that
STRIPS_AHEAD = 8                # strips scanned before their finds raise the bounds
PENDING = 128                   # finds of a message that may wait for their exact second look
LISTS = 10_000_000              # entries of the short lists that are kept beside each other
SCORED = 2_000_000              # vector values an exact second look holds at a time
BLOCK_ROWS = 4096
BLOCK_VALUES = 24_000_000       # values of the different anchors of a block pair
MESSAGE_VALUES = 8_000_000      # values of its messages
BLOCK_LISTS = 4_000_000         # entries of the short lists it hands on
PAIR_CELLS = 30_000_000_000     # views x anchors that meet in it
FEW_CELLS = 100_000_000         # and what is worth a task of its own while cores are idle
MOST_TASKS = 10_000

_FOUND = ("top_sim array<double>, top_pos array<boolean>, top_id array<long>, "
          "top_key array<long>, max_pos double, max_neg double, best_view int, pool long")


def units(matrix: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def _vectors(column: pa.Array) -> np.ndarray:
    """A list column as one matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count or pc.count_distinct(pc.list_value_length(column)).as_py() > 1:
        raise ValueError("vectors must be there and of one length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Anchors:
    """Anchors of one proposition: positives first, then by position in the library."""
    ids: np.ndarray
    positive: np.ndarray
    keys: np.ndarray
    idx: np.ndarray
    vectors: np.ndarray

    @classmethod
    def from_arrow(cls, table: pa.Table) -> "Anchors":
        column = {n: table[n].to_numpy() for n in ("anchor_id", "is_positive", "voter_key", "idx")}
        order = np.lexsort((column["voter_key"], column["anchor_id"], column["idx"], ~column["is_positive"].astype(bool)))
        return cls(column["anchor_id"].astype(np.int64)[order], column["is_positive"].astype(bool)[order],
                   column["voter_key"].astype(np.int64)[order], column["idx"].astype(np.int64)[order],
                   _vectors(table["embedding"])[order])

    @cached_property
    def matrix(self) -> np.ndarray:
        return units(self.vectors.astype(np.float64))

    @cached_property
    def finite(self) -> bool:
        return bool(np.isfinite(self.vectors).all())

    def classes(self) -> list[tuple[int, slice]]:
        """0 for the positives, 1 for the negatives, and where they are."""
        n = int(self.positive.sum())
        return [(side, at) for side, at in ((0, slice(0, n)), (1, slice(n, len(self.ids)))) if at.start < at.stop]

    def __getstate__(self):
        return {n: getattr(self, n) for n in ("ids", "positive", "keys", "idx", "vectors")}  # the rest is made again where it is used


def by_proposition(table: pa.Table) -> dict:
    """The anchors of each proposition; rows without one are nobody's."""
    props = table["prop"].combine_chunks()
    return {p.as_py(): Anchors.from_arrow(table.filter(pc.equal(props, p)))
            for p in props.unique().drop_null().sort()}


@dataclass
class Section:
    """The anchors of a class in vote order, with the lists they may enter: (proposition, class, place of the first). Classes of
    several propositions that hold the same anchors are one section, which is compared once."""
    ids: np.ndarray
    vectors: np.ndarray
    users: list[tuple[int, int, int]]

    def holds(self, ids: np.ndarray, vectors: np.ndarray) -> bool:
        return np.array_equal(self.ids, ids) and np.array_equal(self.vectors, vectors)

    @cached_property
    def size(self) -> np.ndarray:
        """The lengths of the vectors; endless for zero vectors, so that divided by it they stay zero."""
        size = np.concatenate([np.linalg.norm(part.astype(np.float64), axis=1) for part in self._parts()])
        return np.where(size > 0, size, np.inf)

    @cached_property
    def rough(self) -> np.ndarray:
        """The unit vectors in single precision."""
        return np.concatenate([units(part.astype(np.float64)).astype(np.float32) for part in self._parts()])

    def _parts(self) -> list[np.ndarray]:
        step = max(1, SCORED // max(1, self.vectors.shape[1]))
        return [self.vectors[i:i + step] for i in range(0, len(self.vectors), step)]

    def exact(self, at: np.ndarray) -> np.ndarray:
        """Unit vectors in double precision."""
        return self.vectors[at].astype(np.float64) / self.size[at][:, None]

    def copies(self, msg_ids: np.ndarray) -> np.ndarray:
        """How many anchors carry the id of each message."""
        return np.searchsorted(self._sorted, msg_ids, "right") - np.searchsorted(self._sorted, msg_ids, "left")

    @cached_property
    def _sorted(self) -> np.ndarray:
        return np.sort(self.ids)


def sections(table: list[Anchors]) -> list[Section]:
    """The classes of the propositions, each set of anchors once."""
    found: list[Section] = []
    known: dict[tuple, list[Section]] = {}
    for number, anchors in enumerate(table):
        for side, at in anchors.classes():
            ids, vectors = anchors.ids[at], anchors.vectors[at]
            alike = known.setdefault((len(ids), ids[0], ids[-1]), [])
            same = next((s for s in alike if s.holds(ids, vectors)), None)
            if same is None:
                same = Section(ids, vectors, [])
                alike.append(same)
                found.append(same)
            same.users.append((number, side, at.start))
    return found


class Library:
    """The anchors of several propositions."""

    def __init__(self, props: dict):
        self.props = props
        self._groups: dict[int, list] = {}

    def __getstate__(self):
        return {"props": self.props, "_groups": {}}

    def only(self, prop) -> "Library":
        return Library({prop: self.props[prop]} if prop in self.props else {})

    def groups(self, k: int) -> list[tuple[list, list[Anchors], list[Section]]]:
        """Propositions with many anchors whose lists fit beside each other, with their sections."""
        if k not in self._groups:
            many = [p for p, a in self.props.items() if k < len(a.ids) and len(a.ids) > DENSE and a.finite]
            step = max(1, LISTS // (STRIP_ROWS * k))
            names = [many[i:i + step] for i in range(0, len(many), step)]
            self._groups[k] = [(group, table, sections(table)) for group in names for table in [[self.props[p] for p in group]]]
        return self._groups[k]


def best_lists(msg_ids, view_rows, starts, library: Library, k: int, floor: bool, skip_same: bool):
    """Top-k of each message over the best of its views, for every proposition. Yields a proposition with per-message results."""
    groups = library.groups(k) if np.isfinite(view_rows).all() else []
    many = {p for names, _, _ in groups for p in names}
    for prop, anchors in library.props.items():
        if prop not in many:
            for found in _best_at_once(msg_ids, view_rows, starts, anchors, k, floor, skip_same):
                yield prop, found
    for names, table, parts in groups:
        for number, found in _best_by_sections(msg_ids, view_rows, starts, table, parts, k, floor, skip_same):
            yield names[number], found


def best_k(msg_ids, view_rows, starts, anchors: Anchors, k: int, floor: bool, skip_same: bool):
    """The same for the anchors of one proposition."""
    for _, found in best_lists(msg_ids, view_rows, starts, Library({None: anchors}), k, floor, skip_same):
        yield found


def _places(mask: np.ndarray) -> np.ndarray:
    """Where a sparse mask is set, eight cells at a time."""
    if mask.size % 8:
        return np.flatnonzero(mask)
    some = np.flatnonzero(mask.ravel().view(np.uint64))
    return (some[:, None] * 8 + np.arange(8))[mask.reshape(-1, 8)[some]]


def _second_look(rows, begins, counts, section: Section, owner, at):
    """Exact similarity of each pair (message, anchor) over the message's views, and the first view that has it."""
    sims, views = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    ends = np.cumsum(counts[owner])
    step, lo = max(1, SCORED // rows.shape[1]), 0
    while lo < len(owner):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + step, "right")))
        n = counts[owner[lo:hi]]
        first = np.cumsum(n) - n
        view = np.arange(n.sum()) - np.repeat(first, n)
        each = np.rint(np.einsum("ij,ij->i", rows[np.repeat(begins[owner[lo:hi]], n) + view],
                                 section.exact(at[lo:hi]) if len(view) == hi - lo else
                                 np.repeat(section.exact(at[lo:hi]), n, axis=0)) * SCALE).astype(np.int64)
        sims[lo:hi] = np.maximum.reduceat(each, first)
        views[lo:hi] = np.minimum.reduceat(np.where(each == np.repeat(sims[lo:hi], n), view, len(each)), first)
        lo = hi
    return sims, views


def _own_anchors(ids, anchors: Anchors | Section, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells (message, anchor of a strip) that carry the same id."""
    order = np.argsort(anchors.ids[begin:end], kind="stable")
    known = anchors.ids[begin:end][order]
    first, last = np.searchsorted(known, ids, "left"), np.searchsorted(known, ids, "right")
    n = last - first
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return np.repeat(np.arange(len(ids)), n), order[at]


class _Lists:
    """What a proposition has found so far for some messages: lists, the best of either class, and the view closest to a positive. The
    rough values of all finds bound what may still enter."""

    def __init__(self, total: int, k: int, messages: int, floor: bool, lowest: int, most: int, slack: float):
        self.total, self.floor, self.lowest, self.most, self.slack = total, floor, lowest, most, slack
        self.top = np.full((messages, k), lowest * total)     # similarity and place in vote order as one number
        self.sizes = [np.zeros(messages, np.int64), np.zeros(messages, np.int64)]
        self.side_max = [np.full(messages, lowest), np.full(messages, lowest)]
        self.closest = np.full(messages, lowest * most)       # best similarity to a positive, and its view
        self.rough = np.full((messages, k), -2.0, np.float32)  # the best rough values, the least of them first
        self.near = [np.full(messages, -2.0, np.float32), np.full(messages, -2.0, np.float32)]
        self.done = [False, False]

    def open(self, side: int, size: np.ndarray) -> None:
        self.sizes[side] = size
        self.side_max[side] = np.where((size > 0) & self.floor, 0, self.lowest)

    def bound(self, side: int, later: bool = False) -> np.ndarray:
        """The rough value below which an anchor of the class is of no use; ``later``: one that comes after all finds."""
        kth, near = self.rough[:, 0].astype(np.float64), self.near[side]
        if self.floor:  # what is below zero counts as zero, the earliest first
            in_order = later and not (side == 0 and self.done[1])
            kth = np.where(kth > self.slack, kth, np.where((kth > -1.5) & in_order, 0.0, -2.0))
            near = np.maximum(near, 0)
        return np.minimum(kth, near) - 2 * self.slack

    def _raise(self, who, values) -> None:
        k = self.rough.shape[1]
        values = np.concatenate([self.rough[who], values], axis=1)
        self.rough[who] = np.partition(values, values.shape[1] - k, axis=1)[:, -k:]

    def first_strip(self, side: int, seen: np.ndarray, best: np.ndarray) -> None:
        who = slice(0, len(seen))
        self._raise(who, seen)
        self.near[side][who] = np.maximum(self.near[side][who], best)

    def next_strips(self, side: int, owner, values, first) -> None:
        """Rough values sorted by message, and where each message begins."""
        self.near[side][owner[first]] = np.maximum(self.near[side][owner[first]], np.maximum.reduceat(values, first))
        better = values > self.rough[owner, 0]
        if better.any():
            self._raise(*_padded(owner[better], values[better], len(self.top), np.float32(-2.0)))

    def add(self, side: int, base: int, owner, at, sims, views) -> None:
        """Take in exact similarities, sorted by message."""
        first = np.flatnonzero(np.append(True, np.diff(owner) > 0))
        who = owner[first]
        if side == 0:
            code = np.maximum.reduceat(sims * self.most + (self.most - 1 - views), first)
            self.closest[who] = np.maximum(self.closest[who], code)
        if self.floor:
            sims = np.maximum(sims, 0)
        self.side_max[side][who] = np.maximum(self.side_max[side][who], np.maximum.reduceat(sims, first))
        entry = sims * self.total + (self.total - 1 - base - at)
        better = entry > self.top[owner, -1]
        if better.any():
            who, more = _padded(owner[better], entry[better], len(self.top), self.lowest * self.total)
            self.top[who] = -np.sort(-np.concatenate([self.top[who], more], axis=1), axis=1)[:, :self.top.shape[1]]

    def result(self, lo: int, hi: int, back: np.ndarray) -> tuple:
        top, closest = self.top[back], self.closest[back]
        sim, pick = top // self.total, self.total - 1 - top % self.total
        near, view = closest // self.most, self.most - 1 - closest % self.most
        return (lo, hi, sim / SCALE, pick, sim > self.lowest,
                *[np.where(n > 0, m / SCALE, np.nan)[back] for n, m in zip(self.sizes, self.side_max)],
                np.where(near > 0, view, 0).astype(np.int32), (self.sizes[0] + self.sizes[1])[back], np.where(near > 0, near / SCALE, 0.0))


def _padded(owner, values, messages: int, filler) -> tuple[np.ndarray, np.ndarray]:
    """The messages that have values, which are sorted by message, and their values, a row each."""
    n = np.bincount(owner, minlength=messages)
    who = np.flatnonzero(n)
    rows = np.full((len(who), n.max()), filler, values.dtype)
    rows[np.repeat(np.arange(len(who)), n[who]), np.arange(len(owner)) - np.repeat(np.cumsum(n[who]) - n[who], n[who])] = values
    return who, rows


def _best_by_strips(msg_ids, view_rows, starts, anchors: Anchors, k: int, floor: bool, skip_same: bool):
    """The lists of ``best_k`` for many anchors."""
    for _, found in _best_by_sections(msg_ids, view_rows, starts, [anchors], sections([anchors]), k, floor, skip_same):
        yield found


def _best_by_sections(msg_ids, view_rows, starts, table: list[Anchors], parts: list[Section], k: int, floor: bool, skip_same: bool):
    """The lists of several propositions with many anchors. A strip of anchors is compared in single precision, whose error has a
    known bound, once for all propositions that hold it. What may still enter a message's list, or be the best of its class, is
    kept with its rough value; at the end of a section what is still good enough gets an exact second look."""
    bounds = np.append(starts, len(view_rows))
    slack = (view_rows.shape[1] + 8) * 1.2e-7  # bounds the rounding of products and sums of unit vectors, twice over
    lowest = -int(2 * SCALE)
    most = int(np.diff(bounds).max(initial=0)) + 1
    cells = np.empty((max(STRIP_ROWS, most), STRIP), np.float32)
    mask = np.empty(cells.shape, bool)
    lo = 0
    while lo < len(msg_ids):
        hi = int(min(max(lo + 1, np.searchsorted(bounds, bounds[lo] + STRIP_ROWS, "right") - 1), len(msg_ids)))
        order = np.argsort(-np.diff(bounds[lo:hi + 1]), kind="stable")  # messages with more views first
        back = np.argsort(order)
        ids, counts = msg_ids[lo:hi][order], np.diff(bounds[lo:hi + 1])[order]
        rows, begins, some = view_rows[bounds[lo]:bounds[hi]], (bounds[lo:hi] - bounds[lo])[order], counts > 0
        have = [int((counts > v).sum()) for v in range(counts[0])]      # messages that have a first, second ... view
        rough = rows[np.concatenate([begins[:n] + v for v, n in enumerate(have)])].astype(np.float32) if have else None
        lists = [_Lists(len(a.ids), k, hi - lo, floor, lowest, most, slack) for a in table]
        for section in parts:
            size = np.where(some, len(section.ids) - (section.copies(ids) if skip_same else 0), 0)
            users = [(lists[number], side, base) for number, side, base in section.users]
            for user, side, _ in users:
                user.open(side, size)

            def look(finds: list) -> None:
                """The exact second look at what is still good enough."""
                owner, at, values = (np.concatenate(x) for x in zip(*finds))
                good = np.flatnonzero(values >= np.min([user.bound(side) for user, side, _ in users], axis=0).astype(np.float32)[owner])
                good = good[np.argsort(owner[good], kind="stable")]
                owner, at = owner[good], at[good]
                if len(owner):
                    sims, views = _second_look(rows, begins, counts, section, owner, at)
                    for user, side, base in users:
                        user.add(side, base, owner, at, sims, views)

            finds, used, waiting, need = [], 0, 0, None
            for begin in range(0, len(section.ids), STRIP) if have else []:
                end = min(begin + STRIP, len(section.ids))
                whole = end - begin == STRIP
                found = np.matmul(rough, section.rough[begin:end].T, out=cells[:len(rough)] if whole else None)
                row = have[0]
                for n in have[1:]:
                    np.maximum(found[:n], found[row:row + n], out=found[:n])
                    row += n
                seen = found[:have[0]]
                if begin == 0:
                    if skip_same:
                        seen[_own_anchors(ids[:len(seen)], section, begin, end)] = -2.0
                    best = seen.max(axis=1)
                    tops = np.partition(seen, end - k, axis=1)[:, -k:] if end > k else seen
                    for user, side, _ in users:
                        user.first_strip(side, tops, best)
                if need is None:
                    need = np.min([user.bound(side, begin > 0) for user, side, _ in users], axis=0).astype(np.float32)[:len(seen), None]
                hits = _places(np.greater_equal(seen, need, out=mask[:len(seen)] if whole else None))
                if len(hits):
                    owner, at, values = hits // (end - begin), begin + hits % (end - begin), seen.ravel()[hits]
                    if skip_same:
                        other = ids[owner] != section.ids[at]
                        owner, at, values = owner[other], at[other], values[other]
                    finds.append((owner.astype(np.uint16) if len(seen) < 2**16 else owner, at, values))
                    waiting += len(owner)
                if begin == 0:  # its values are known
                    used, need = len(finds), None
                elif len(finds) - used >= min(STRIPS_AHEAD, begin // STRIP // 2) or waiting > PENDING * len(ids):
                    owner, values = (np.concatenate([x[i] for x in finds[used:]] or [np.zeros(0, np.int64)]) for i in (0, 2))
                    by = np.argsort(owner, kind="stable")
                    if len(by):
                        owner, values = owner[by], values[by]
                        first = np.flatnonzero(np.append(True, np.diff(owner) > 0))
                        for user, side, _ in users:
                            user.next_strips(side, owner, values, first)
                    used, need = len(finds), None
                if waiting > PENDING * len(ids):
                    look(finds)
                    finds, used, waiting = [], 0, 0
            if finds:
                look(finds)
            for user, side, _ in users:
                user.done[side] = True
        for number, user in enumerate(lists):
            yield number, user.result(lo, hi, back)
        lo = hi


def _best_at_once(msg_ids, view_rows, starts, anchors: Anchors, k: int, floor: bool, skip_same: bool):
    """The lists of ``best_k`` from whole rows of similarities."""
    step = max(1, CELLS // max(1, len(anchors.ids)))
    bounds = np.append(starts, len(view_rows))
    order_code = np.arange(len(anchors.ids))[::-1]
    for lo in range(0, len(msg_ids), step):
        hi = min(lo + step, len(msg_ids))
        v0, v1 = bounds[lo], bounds[hi]
        lowest = -int(2 * SCALE)
        some = bounds[lo:hi] < bounds[lo + 1:hi + 1]   # a message without views has an empty pool
        per_view = np.zeros((0, len(anchors.ids)), np.int64)
        sims = np.full((hi - lo, len(anchors.ids)), lowest)
        if some.any():
            per_view = np.rint(view_rows[v0:v1] @ anchors.matrix.T * SCALE).astype(np.int64)
            sims[some] = np.maximum.reduceat(per_view, bounds[lo:hi][some] - v0, axis=0)
        if floor:
            sims = np.maximum(sims, 0)
        live = np.repeat(some[:, None], sims.shape[1], axis=1)
        if skip_same:
            live &= msg_ids[lo:hi, None] != anchors.ids[None, :]
        key = np.where(live, sims, lowest) * len(anchors.ids) + order_code
        n = min(k, sims.shape[1])
        if n < sims.shape[1]:
            pick = np.argpartition(-key, n - 1, axis=1)[:, :n]
        else:
            pick = np.tile(np.arange(n), (hi - lo, 1))
        pick = np.take_along_axis(
            pick, np.argsort(-np.take_along_axis(key, pick, 1), axis=1), 1)
        kept = np.take_along_axis(live, pick, 1)
        side = {}
        for name, mask in (("max_pos", anchors.positive), ("max_neg", ~anchors.positive)):
            part = np.where(live, sims, lowest)[:, mask]
            side[name] = part.max(axis=1) / SCALE if mask.any() else np.full(hi - lo, np.nan)
            side[name] = np.where(side[name] <= -1.5, np.nan, side[name])
        seen = np.repeat(live[:, anchors.positive], np.diff(bounds[lo:hi + 1]), axis=0)
        view_best = np.where(seen, per_view[:, anchors.positive], lowest).max(axis=1) \
            if anchors.positive.any() else np.zeros(v1 - v0)
        best_view, view_sim = np.zeros(hi - lo, np.int32), np.zeros(hi - lo)
        for m in np.flatnonzero(some):
            mine = view_best[bounds[lo + m] - v0:bounds[lo + m + 1] - v0]
            if mine.max() > 0:
                best_view[m], view_sim[m] = mine.argmax(), mine.max() / SCALE
        yield (lo, hi, np.take_along_axis(sims, pick, 1) / SCALE, pick, kept, side["max_pos"], side["max_neg"], best_view,
               live.sum(axis=1), view_sim)


def _ragged(values: np.ndarray, kept: np.ndarray, kind) -> pa.ListArray:
    ends = np.append(0, np.cumsum(kept.sum(axis=1))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[kept], kind))


def _found_columns(found, anchors: Anchors) -> list[pa.Array]:
    _, _, sim, pick, kept, max_pos, max_neg, best_view, pool, _ = found
    return [_ragged(sim, kept, pa.float64()), _ragged(anchors.positive[pick], kept, pa.bool_()),
            _ragged(anchors.ids[pick], kept, pa.int64()),
            _ragged(anchors.keys[pick], kept, pa.int64()),
            pa.array(max_pos, pa.float64(), from_pandas=True),
            pa.array(max_neg, pa.float64(), from_pandas=True),
            pa.array(best_view, pa.int32()), pa.array(pool.astype(np.int64))]


def _unpack_views(column: pa.ListArray):
    counts = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return units(values.reshape(len(flat), len(values) // max(1, len(flat)))), np.append(0, np.cumsum(counts))[:-1]


def search(messages: DataFrame, library: DataFrame, k: int, floor: bool = True,
           skip_same: bool = False, broadcast_values: int = BROADCAST_VALUES,
           block_rows: int | None = None, keep: list[str] | tuple = ()) -> DataFrame:
    """Nearest anchors of every message for every proposition of the library.

    ``messages(msg_id, views array<array<float>>)``, ``library(prop, is_positive, idx,
    anchor_id long, embedding)``. Gives one row per (message, proposition): the best ``k``
    in vote order (similarity, positives first, position), the best similarity of either
    class, the view closest to a positive, and the pool size. ``skip_same`` leaves out the
    anchor that carries the message's own id. An optional ``voter_key`` column of the library
    is handed through as ``top_key`` (default: the anchor id). Messages with a ``prop`` column
    meet only the anchors of that proposition. ``k`` 0 keeps every anchor. A message without views has an empty pool.
    ``keep`` names further columns of the messages that are handed through; beside a library that does not fit a broadcast they
    are joined to the result, so ids (with ``prop``, where messages have it) must be told apart then."""
    k = k or np.iinfo(np.int32).max
    if "voter_key" not in library.columns:
        library = library.withColumn("voter_key", F.col("anchor_id"))
    own = ["prop"] if "prop" in messages.columns else []
    whole = messages.schema["msg_id"].dataType.simpleString() in ("tinyint", "smallint", "int")
    messages = messages.select((F.col("msg_id").cast("long") if whole else F.col("msg_id")).alias("msg_id"), "views", *own, *keep)
    library = library.select("prop", "is_positive", F.col("idx").cast("long").alias("idx"),
                             F.col("anchor_id").cast("long").alias("anchor_id"), "voter_key", "embedding")
    prop_type = library.schema["prop"].dataType.simpleString()
    rows, width = library.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    width = max(1, width or 1)
    if rows * width <= broadcast_values:
        if rows > BLOCK_ROWS and not messages.isStreaming:  # below that reading the messages costs more than comparing them
            messages = _dealt(messages, rows)
        return _search_broadcast(messages, library, k, floor, skip_same, prop_type, own, keep)
    block_rows = block_rows or max(1024, BLOCK_VALUES // width)
    if messages.isStreaming:
        raise ValueError("a stream needs a library that fits a broadcast: use ground_to_sink, which searches a large one in blocks")
    found = _search_blocks(messages.drop(*keep), library, k, floor, skip_same, prop_type, width, block_rows, own)
    return found.join(messages.select("msg_id", *own, *keep), ["msg_id", *own]) if keep else found


def _wanted_tasks(cells: float, cores: int) -> float:
    """Tasks for so many cells: by the time one may take, and so that there is work for every core."""
    return max(cells / PAIR_CELLS, min(2 * cores, cells / FEW_CELLS))


def _dealt(messages: DataFrame, n_anchors: int) -> DataFrame:
    """The messages dealt evenly over tasks by the cells they make. Partitions say little about that: a file of one row group
    is cut into many by its bytes, and all of its rows are in one of them."""
    n_messages, n_views = messages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("views")), F.lit(0))).first()
    wanted = math.ceil(_wanted_tasks(n_views * n_anchors, messages.sparkSession.sparkContext.defaultParallelism))
    return messages.repartition(max(1, min(wanted, n_messages, MOST_TASKS)))


def _search_broadcast(messages, library, k, floor, skip_same, prop_type, own, keep) -> DataFrame:
    table = Library(by_proposition(library.toArrow()))  # size checked by the caller
    shared = messages.sparkSession.sparkContext.broadcast(table)

    def scan(batches):
        alone = cache(lambda prop: shared.value.only(prop))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            parts = [(batch, shared.value)]
            if own:
                parts = [(batch.filter(pc.equal(batch.column(2), pa.scalar(prop, batch.schema.field(2).type))), alone(prop))
                         for prop in shared.value.props]
            for part, anchors in parts:
                if part.num_rows == 0:
                    continue
                ids = part.column(0)
                view_rows, starts = _unpack_views(part.column(1))
                for prop, found in best_lists(ids.to_numpy(zero_copy_only=False), view_rows, starts, anchors, k, floor, skip_same):
                    rows = ids.slice(found[0], found[1] - found[0])
                    props = pa.array([prop] * len(rows), {"int": pa.int32(), "bigint": pa.int64()}.get(
                        prop_type, pa.string()))
                    yield pa.RecordBatch.from_arrays(
                        [rows, props, *_found_columns(found, anchors.props[prop]),
                         *[part.column(name).slice(found[0], len(rows)) for name in keep]], names=[*_NAMES, *keep])

    more = f", {messages.select(*keep)._jdf.schema().toDDL()}" if keep else ""
    return messages.mapInArrow(scan, f"msg_id {messages.schema['msg_id'].dataType.simpleString()}, prop {prop_type}, {_FOUND}{more}")


_NAMES = ["msg_id", "prop", "top_sim", "top_pos", "top_id", "top_key", "max_pos", "max_neg",
          "best_view", "pool"]


def _homes(sizes: list, block_rows: int, classes: dict | None = None) -> tuple[list, int, int]:
    """``(prop, first block, blocks)`` of every proposition, the number of blocks, and the most propositions in one. A block
    holds whole small propositions; one with more rows than a block is dealt over blocks of its own. ``classes`` tells of
    each proposition ``{what its classes hold: rows}``: those that share one come together while their different rows fit a block
    and all their rows two."""
    classes = classes or {}
    homes, blocks, most = [], 0, 1
    room = places = alone = 0
    held: set = set()
    sharing: dict = {}
    for prop, n in sizes:
        for part in classes.get(prop, ()) if n <= block_rows else ():
            sharing.setdefault(part, []).append(prop)
    left = dict(sizes)
    near: list = []

    def propositions():
        for prop, _ in sizes:
            near.append(prop)
            while near:  # those beside the last come first
                one = near.pop()
                if one in left:
                    yield one, left.pop(one)

    for prop, n in propositions():
        if n > block_rows:
            homes.append((prop, blocks, -(-n // block_rows)))
            blocks += homes[-1][2]
            room = places = 0
            continue
        parts = classes.get(prop, {prop: n})
        new = sum(rows for part, rows in parts.items() if part not in held)
        if new > room or n > places or not alone:
            blocks, room, places, alone, held = blocks + 1, block_rows, 2 * block_rows, 0, set()
            new = n
        room, places, alone = room - new, places - n, alone + 1
        held |= parts.keys()
        most = max(most, alone)
        homes.append((prop, blocks - 1, 1))
        for part in parts:
            near.extend(sharing.pop(part, []))
    return homes, blocks, most


def _message_blocks(n_messages: int, n_views: int, n_anchors: int, width: int, lists: int, block_rows: int, anchor_blocks: int,
                    apart: int, cores: int) -> int:
    """Into how many blocks messages are cut: by the values and lists a task may hold, by the time a pair may take, and so that there
    is a pair for every core. ``apart`` is in how many parts messages and anchors fall that do not meet."""
    by_size = max(n_views * width / MESSAGE_VALUES, n_messages / block_rows, n_messages * lists / BLOCK_LISTS)
    cells = n_views * n_anchors / max(1, apart)
    wanted = _wanted_tasks(cells, cores)
    return max(1, min(n_messages, math.ceil(max(by_size, wanted / max(1, anchor_blocks)))))


def _class_sizes(library: DataFrame, alike: bool) -> tuple[list, dict]:
    """``(prop, rows)`` of every proposition in order, and what its classes hold: two classes with the same sums over their
    anchors most likely hold the same ones. That only decides which propositions come together."""
    parts = [F.xxhash64("idx", "anchor_id", "embedding"), F.xxhash64("embedding", "anchor_id", "idx")] if alike else []
    sums = [F.sum(F.pmod(x, F.lit(2**31))).alias(f"sum{i}") for i, x in enumerate(parts)]
    rows = library.filter("prop is not null").groupBy("prop", "is_positive").agg(
        F.count(F.lit(1)).alias("n"), *sums).orderBy("prop", "is_positive").collect()  # two per proposition
    sizes: dict = {}
    classes: dict = {}
    for r in rows:
        sizes[r["prop"]] = sizes.get(r["prop"], 0) + r["n"]
        if alike:
            classes.setdefault(r["prop"], {})[r["n"], r["sum0"], r["sum1"]] = r["n"]
    return list(sizes.items()), classes


def _search_blocks(messages, library, k, floor, skip_same, prop_type, width, block_rows, own) -> DataFrame:
    """Both sides in blocks: a message block meets every anchor block that holds a proposition of its messages, and only the
    best k of a message and proposition leave the pair. The lists of a proposition dealt over several blocks are merged
    per message; the others are whole as they are."""
    spark = messages.sparkSession
    sizes, classes = _class_sizes(library, not own)
    placed, anchor_blocks, together = _homes(sizes, block_rows, classes)
    lists = min(k, block_rows, max((n for _, n in sizes), default=1)) * (1 if own else together)
    n_messages, n_views = messages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("views")), F.lit(0))).first()
    message_blocks = _message_blocks(n_messages, n_views, sum(n for _, n in sizes), width, lists, block_rows, anchor_blocks,
                                     len(sizes) if own else 1, spark.sparkContext.defaultParallelism)
    pairs = max(1, anchor_blocks * message_blocks)  # a pair is work for a task of its own, however few bytes it has
    homes = spark.createDataFrame(placed, f"prop {prop_type}, first int, blocks int")
    left = messages.withColumn("mb", F.pmod(F.xxhash64("msg_id"), F.lit(message_blocks)).cast("int"))
    if own:
        left = left.join(broadcast_if_small(homes), "prop").withColumn(
            "ab", F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1))).drop("first", "blocks")
    else:
        left = left.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(max(0, anchor_blocks - 1)))))
    right = (library.join(broadcast_if_small(homes), "prop")
             .withColumn("ab", (F.col("first") + F.pmod(F.xxhash64("anchor_id", "is_positive"), F.col("blocks"))).cast("int"))
             .drop("first", "blocks").withColumn("mb", F.explode(F.sequence(F.lit(0), F.lit(message_blocks - 1)))))
    pair = (F.col("ab") * message_blocks + F.col("mb")).cast("int")  # numbers the tasks, so that no task gets two by chance
    left, right = (side.withColumn("pair", pair).drop("ab", "mb").repartitionById(min(pairs, MOST_TASKS), "pair") for side in (left, right))

    def meet(m: pa.Table, a: pa.Table) -> pa.Table:
        out = []
        if m.num_rows and a.num_rows:
            whole = Library(by_proposition(a))
            for mine, anchors in [(m.filter(pc.equal(m["prop"], pa.scalar(prop, m.schema.field("prop").type))), whole.only(prop))
                                  for prop in whole.props] if own else [(m, whole)]:
                if not mine.num_rows:
                    continue
                ids = mine["msg_id"].combine_chunks()
                view_rows, starts = _unpack_views(mine["views"].combine_chunks())
                for prop, found in best_lists(ids.to_numpy(zero_copy_only=False), view_rows, starts, anchors, k, floor, skip_same):
                    n, its = found[1] - found[0], anchors.props[prop]
                    out.append(pa.RecordBatch.from_arrays(
                        [ids.slice(found[0], n), pa.array([prop] * n, prop_arrow), *_found_columns(found, its),
                         _ragged(its.idx[found[3]], found[4], pa.int64()), pa.array(found[-1], pa.float64())],
                        names=[*_NAMES, "top_idx", "view_sim"]))
        return pa.Table.from_batches(out) if out else pa.Table.from_pylist([], pa.schema([m.schema.field("msg_id"), *rest]))

    prop_arrow = {"int": pa.int32(), "bigint": pa.int64()}.get(prop_type, pa.string())
    rest = [pa.field(name, kind) for name, kind in (
        ("prop", prop_arrow), ("top_sim", pa.list_(pa.float64())),
        ("top_pos", pa.list_(pa.bool_())), ("top_id", pa.list_(pa.int64())), ("top_key", pa.list_(pa.int64())),
        ("max_pos", pa.float64()), ("max_neg", pa.float64()), ("best_view", pa.int32()),
        ("pool", pa.int64()), ("top_idx", pa.list_(pa.int64())), ("view_sim", pa.float64()))]
    msg_type = messages.schema["msg_id"].dataType.simpleString()
    parts = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInArrow(
        meet, f"msg_id {msg_type}, prop {prop_type}, {_FOUND}, top_idx array<long>, view_sim double")
    if all(blocks == 1 for _, _, blocks in placed):
        return parts.select(*_NAMES)
    entries = F.transform(
        F.arrays_zip("top_sim", "top_pos", "top_idx", "top_id", "top_key"),
        lambda x: F.struct((-x["top_sim"]).alias("s"), (~x["top_pos"]).alias("n"),
                           x["top_idx"].alias("i"), x["top_id"].alias("a"),
                           x["top_key"].alias("v")))
    merged = parts.groupBy("msg_id", "prop").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list(entries))), 1, k).alias("t"),
        F.max("max_pos").alias("max_pos"), F.max("max_neg").alias("max_neg"),
        F.max_by("best_view", F.struct("view_sim", -F.col("best_view"))).alias("best_view"),
        F.sum("pool").alias("pool"))
    return merged.select(
        "msg_id", "prop", F.transform("t", lambda x: -x["s"]).alias("top_sim"),
        F.transform("t", lambda x: ~x["n"]).alias("top_pos"),
        F.transform("t", lambda x: x["a"]).alias("top_id"),
        F.transform("t", lambda x: x["v"]).alias("top_key"),
        "max_pos", "max_neg", "best_view", "pool")


def nearest(queries: DataFrame, refs: DataFrame, k: int = 1, floor: bool = False,
            skip_same: bool = False, **kw) -> DataFrame:
    """Best ``k`` of ``refs(id, embedding)`` for each of ``queries(id, embedding)``:
    ``(id, top_sim, top_id)``."""
    found = search(
        queries.select(F.col("id").alias("msg_id"), F.array("embedding").alias("views")),
        refs.select(F.lit("all").alias("prop"), F.lit(True).alias("is_positive"),
                    F.col("id").alias("idx"), F.col("id").alias("anchor_id"), "embedding"),
        k, floor, skip_same, **kw)
    return found.select(F.col("msg_id").alias("id"), "top_sim", "top_id")


def view_scores(messages: DataFrame, refs: DataFrame,
                broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """Add ``view_max``: for each view of a message its best similarity to any of
    ``refs(id, embedding)``, in view order."""
    rows, width = refs.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if rows * max(1, width or 1) > broadcast_values:
        views = messages.select("msg_id", F.posexplode("views").alias("v", "embedding"))
        best = nearest(views.select(F.struct("msg_id", "v").alias("id"), "embedding"), refs).groupBy("id.msg_id").agg(
            F.array_sort(F.collect_list(F.struct("id.v", F.col("top_sim")[0].alias("s")))).alias("l"))
        none = F.when(F.col("views").isNotNull(), F.array().cast("array<double>"))
        return messages.join(best.select("msg_id", F.transform("l", lambda x: x["s"]).alias("view_max")), "msg_id", "left") \
            .select(*messages.columns, F.coalesce("view_max", none).alias("view_max"))
    vectors = refs.select("embedding").toArrow()["embedding"].combine_chunks()  # size checked above
    matrix = units(np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1))
    shared = messages.sparkSession.sparkContext.broadcast(matrix)
    at = messages.columns.index("views")

    def scan(batches):
        for batch in batches:
            views = batch.column(at)
            view_rows, _ = _unpack_views(views)
            step = max(1, CELLS // len(shared.value))
            best = np.concatenate([np.zeros(0)] + [
                (np.rint(view_rows[i:i + step] @ shared.value.T * SCALE) / SCALE).max(axis=1)
                for i in range(0, len(view_rows), step)])
            offsets = pa.array(views.offsets.to_numpy() - views.offsets[0].as_py(), pa.int32())
            scores = pa.ListArray.from_arrays(offsets, pa.array(best, pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores],
                                             names=[*batch.schema.names, "view_max"])

    return messages.mapInArrow(scan, f"{messages._jdf.schema().toDDL()}, view_max array<double>")


def view_scores_by(messages: DataFrame, refs: DataFrame, group: str = "prop",
                   broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """``view_scores`` against each group of ``refs(<group>, id, embedding)`` by itself: a row per message and group."""
    names = refs.select(group).distinct().orderBy(group).toArrow()[group]  # one per proposition
    kind = refs.schema[group].dataType.simpleString()
    rows, width = refs.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not rows or rows * max(1, width or 1) > broadcast_values:
        parts = [view_scores(messages, refs.filter(F.col(group) == F.lit(n.as_py())), broadcast_values)
                 .withColumn(group, F.lit(n.as_py()).cast(kind)) for n in names]
        empty = messages.limit(0).withColumns({"view_max": F.lit(None).cast("array<double>"), group: F.lit(None).cast(kind)})
        return reduce(DataFrame.unionByName, parts, empty)
    table = refs.select(group, "embedding").toArrow().combine_chunks()  # size checked above
    matrices = []
    for name in names:
        vectors = table.filter(pc.equal(table[group], name))["embedding"].combine_chunks()
        matrices.append((name, units(np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1))))
    shared = messages.sparkSession.sparkContext.broadcast(matrices)
    at = messages.columns.index("views")

    def scan(batches):
        for batch in batches:
            views = batch.column(at)
            view_rows, _ = _unpack_views(views)
            offsets = pa.array(views.offsets.to_numpy() - views.offsets[0].as_py(), pa.int32())
            for name, matrix in shared.value:
                step = max(1, CELLS // len(matrix))
                best = np.concatenate([np.zeros(0)] + [(np.rint(view_rows[i:i + step] @ matrix.T * SCALE) / SCALE).max(axis=1)
                                                       for i in range(0, len(view_rows), step)])
                scores = pa.ListArray.from_arrays(offsets, pa.array(best, pa.float64()))
                own = pa.array([name.as_py()] * batch.num_rows, name.type)
                yield pa.RecordBatch.from_arrays([*batch.columns, scores, own], names=[*batch.schema.names, "view_max", group])

    return messages.mapInArrow(scan, f"{messages._jdf.schema().toDDL()}, view_max array<double>, {group} {kind}")


# -- comparisons inside a group -------------------------------------------------------

class Block:
    """Rows of one block with their unit vectors."""

    def __init__(self, pdf):
        self.pdf = pdf
        self.vec = units(np.stack(pdf["vec"].to_list()).astype(np.float64)) if len(pdf) else None
        self.pos = pdf["pos"].to_numpy()

    def __getitem__(self, name):
        return self.pdf[name].to_numpy()

    def similarity(self, other: "Block") -> np.ndarray:
        return np.rint(self.vec @ other.vec.T * SCALE) / SCALE


def tiles(items: DataFrame, group: list[str], block_rows: int) -> DataFrame:
    """Send every row to the block pairs it takes part in. A group of n rows makes
    ceil(n / block_rows) blocks, so no task sees more than two blocks of any group."""
    sizes = items.groupBy(*group).agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("__blocks"))
    rows = items.join(broadcast_if_small(sizes), group).withColumn(
        "__b", F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int"))
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return rows.select(*items.columns, "__b", F.least("__b", "__o").alias("__lo"),
                       F.greatest("__b", "__o").alias("__hi"))


def compare(items: DataFrame, group: list[str], look, out: str, block_rows: int = BLOCK_ROWS):
    """Run ``look(rows, others, similarity) -> pandas`` over every ordered pair of blocks
    of a group. ``items`` has ``id, pos, vec``; ``look`` returns per-row or per-block
    results, never pairs."""
    import pandas as pd

    def run(pdf):
        lo, hi = int(pdf["__lo"].iloc[0]), int(pdf["__hi"].iloc[0])
        a = Block(pdf[pdf["__b"] == lo].reset_index(drop=True))
        if lo == hi:
            return look(a, a, a.similarity(a))
        b = Block(pdf[pdf["__b"] == hi].reset_index(drop=True))
        if a.vec is None or b.vec is None:  # a block no row was hashed to
            full = b if a.vec is None else a
            return look(full, full, full.similarity(full)).iloc[:0]
        sims = a.similarity(b)
        return pd.concat([look(a, b, sims), look(b, a, sims.T)], ignore_index=True)

    return tiles(items, group, block_rows).groupBy(*group, "__lo", "__hi").applyInPandas(run, out)
