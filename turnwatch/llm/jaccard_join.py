"""N-gram Jaccard join by rare-first prefix filtering (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwatch.llm.components import components, stars
from turnwatch.llm.hashing import Words, batches, mix, window_hash
from turnwatch.llm.repeats import KEYS_DDL, key_rows, known, member, part_rows, parted, repeated_keys
from turnwatch.llm.rows import arrow_batch, arrow_schema, part_of, parts_of, written
from turnwatch.session import broadcast_if_small, cut_lineage

WORDS, PERCENT = 4, 85
#: Cells of the frequency table that orders shingles from rare to frequent, whatever the corpus.
CELLS, SLICE = 1 << 20, 1 << 16
#: Ranges of a set that the suffix filter compares, entries of a shingle compared in one task,
#: and rounds that link each document to its likeliest partner before all pairs left are verified.
RANGES, BLOCK, ROUNDS = 32, 2048, 2
#: Bits that tell whether an even or odd number of shingles fell on each of as many places.
PARITIES = 512
BATCH_BYTES = 1_000_000


def shingle_sets(texts: list, size: int) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text."""
    out: list[np.ndarray] = []
    for a, b in batches(texts, BATCH_BYTES):
        words = Words(texts[a:b], lower=True)
        hashes = words.hashes()
        at = words.windows(size)
        shingles = window_hash(hashes, at, size)
        cut = np.searchsorted(at, words.first)
        for i in range(b - a):
            n = int(words.count[i])
            if 0 < n < size:
                out.append(window_hash(hashes, words.first[i:i + 1], n))
            else:
                out.append(np.unique(shingles[cut[i]:cut[i + 1]]))
    return out


def rare_first(shingles: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The order of shingles by the frequency of their cell, ties by hash: one order for all sets."""
    return np.lexsort((shingles, table[(shingles & np.uint64(CELLS - 1)).astype(np.int64)]))


def prefix_length(n: int, percent: int) -> int:
    """Two sets of at least ``percent`` similarity share a shingle among this many of the rarest of each."""
    return n - (percent * n + 99) // 100 + 1


def needed(n, m, percent: int):
    """Common shingles that sets of n and m shingles need."""
    return -(-percent * (n + m) // (100 + percent))


def spread_of(shingles: np.ndarray, ranges: int = RANGES) -> bytes:
    """How many shingles lie in each of 2^k ranges of hashes, 255 at most. The differences of two
    such rows sum up to no more than the shingles that only one of the two sets has."""
    counts = np.bincount((shingles >> np.uint64(65 - ranges.bit_length())).astype(np.int64), minlength=ranges)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def parity_of(shingles: np.ndarray) -> bytes:
    """For each place, whether an odd number of shingles fall on it. Two such rows differ in no more
    places than there are shingles that only one set has; for small sets in nearly as many."""
    counts = np.bincount((shingles & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def fine_ranges(n: int) -> int:
    """Ranges for a closer look at a set of n shingles: about thirty shingles in each."""
    return min(1 << 16, max(RANGES, 1 << (n // 30).bit_length()))


def finely_apart(x: bytes, y: bytes) -> int:
    """The bound of the suffix filter from two rows of fine ranges."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a.reshape(len(b), -1).sum(axis=1)
        # What was cut off at 255 may be missing in either.
        a, b = np.minimum(a, 255), np.minimum(b, 255)
    return int(np.abs(a - b).sum())


def summaries(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Two kinds of rows from one scan: each document's set size and 128-bit digest of its set, and
    each task's share of the frequency table (``slice``, ``counts``)."""
    ddl = "doc long, n long, h1 long, h2 long, slice int, counts binary"
    schema = arrow_schema(ddl)

    def run(batches_):
        table = np.zeros(CELLS, np.int64)
        for batch in batches_:
            sets = shingle_sets(batch.column(1).to_pylist(), size)
            n = np.array([len(s) for s in sets], np.int64)
            every = np.concatenate([np.zeros(0, np.uint64), *sets])
            table += np.bincount((every & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
            end = np.cumsum(n)
            digests = []
            for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                sums = np.zeros(len(every) + 1, np.uint64)
                np.cumsum(mix(every ^ np.uint64(salt)), out=sums[1:])
                digests.append((sums[end] - sums[end - n]).view(np.int64))
            yield arrow_batch({"doc": batch.column(0), "n": n, "h1": digests[0], "h2": digests[1],
                               "slice": [None] * len(n), "counts": [None] * len(n)}, schema)
        rows = CELLS // SLICE
        none = [None] * rows
        yield arrow_batch({"doc": none, "n": none, "h1": none, "h2": none, "slice": list(range(rows)),
                           "counts": [x.astype(np.int32).tobytes() for x in table.reshape(rows, SLICE)]}, schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ddl)


def frequency_table(rows: DataFrame) -> np.ndarray:
    """The summed table: ``CELLS`` counts, a few MB for any corpus."""
    ddl = "slice int, counts binary"
    schema = arrow_schema(ddl)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for c in table["counts"].to_pylist():
            total += np.frombuffer(c, np.int32)
        return pa.table({"slice": table["slice"][:1], "counts": [total.tobytes()]}, schema=schema)

    out = np.zeros(CELLS, np.int64)
    for r in rows.filter("slice IS NOT NULL").select("slice", "counts").groupBy("slice").applyInArrow(add, ddl).collect():
        out[r["slice"] * SLICE:(r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
    return out


def entries(docs: DataFrame, id_col: str, text_col: str, representatives: DataFrame, table: np.ndarray, size: int,
            percent: int, parts: int) -> DataFrame:
    """``(token, doc, n, pos, ranges)`` of the representatives: each prefix shingle that another
    prefix has too, with its place in the set's rare-first order; and, without a token, a row with the fine ranges of
    each set that has such a shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    source = parted(docs, id_col, text_col, parts, by_id=True)
    chosen = representatives.select(part_of(["doc"], parts).alias("part"), "doc")

    def sets_of(rows, wanted):
        _, ids, texts = part_rows(rows)
        keep = np.flatnonzero(np.isin(ids, wanted))
        return ids[keep], shingle_sets([texts[i] for i in keep], size)

    def prefixes(key, rows, wanted):
        out = [np.zeros(0, np.uint64)]
        if len(rows):
            for s in sets_of(rows, np.asarray(wanted["doc"], np.int64))[1]:
                if len(s):
                    out.append(s[rare_first(s, shared.value)[:prefix_length(len(s), percent)]])
        return key_rows(key[0].as_py(), np.concatenate(out), parts)

    found = repeated_keys(source.groupBy("part").cogroup(chosen.groupBy("part")).applyInArrow(prefixes, KEYS_DDL))
    both = chosen.selectExpr("part", "doc", "cast(null as binary) keys").unionByName(
        found.selectExpr("part", "cast(null as long) doc", "keys"))
    ddl = "token long, doc long, n int, pos int, ranges binary"
    schema = arrow_schema(ddl)

    def emit(key, rows, mixed):
        out = {c: [] for c in schema.names}
        if len(rows):
            is_key = mixed["keys"].is_valid()
            repeated = known(mixed.filter(is_key))
            for doc, s in zip(*sets_of(rows, np.asarray(mixed.filter(pa.compute.invert(is_key))["doc"], np.int64))):
                if not len(s):
                    continue
                prefix = s[rare_first(s, shared.value)[:prefix_length(len(s), percent)]]
                pos = np.flatnonzero(member(prefix, repeated))
                if not len(pos):
                    continue
                rows_ = len(pos) + 1
                out["token"] += [*prefix[pos].view(np.int64).tolist(), None]
                out["pos"] += [*pos.tolist(), None]
                out["doc"] += [doc] * rows_
                out["n"] += [len(s)] * rows_
                out["ranges"] += [spread_of(s) + parity_of(s)] * len(pos) + [spread_of(s, fine_ranges(len(s)))]
        return pa.table(out, schema=schema)

    return source.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(emit, ddl)


def _survivors(e: dict, i: np.ndarray, j: np.ndarray, percent: int):
    """Pairs ``(i, j, excess)`` of entries of one shingle that pass the length, positional and suffix
    filters and belong to different components; ``excess`` is a bound on what only one set has."""
    n, pos, ranges = e["n"], e["pos"], e["ranges"]
    ok = e["comp"][i] != e["comp"][j]
    # Two blocks of one shingle are compared with each other here, each with itself elsewhere.
    ok &= (e["low"][i] == e["high"][i]) | (e["mine"][i] != e["mine"][j])
    ok &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    i, j = i[ok], j[ok]
    most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
    ok = most >= needed(n[i], n[j], percent)
    i, j = i[ok], j[ok]
    excess = np.abs(ranges[i] - ranges[j]).sum(axis=1, dtype=np.int64)
    odd = np.bitwise_count(e["parity"][i] ^ e["parity"][j]).sum(axis=1, dtype=np.int64)
    excess = np.maximum(excess, odd)
    ok = (n[i] + n[j] - excess) // 2 >= needed(n[i], n[j], percent)
    return i[ok], j[ok], excess[ok]


def proposals(rows: DataFrame, nearest: bool, percent: int, parts: int, block: int = BLOCK) -> DataFrame:
    """Distinct ``(a, b)``, a < b, from rows of ``(token, doc, n, pos, ranges, comp)``: all pairs that
    share a shingle, pass the filters and lie in different components, or only the ``nearest`` of each document by
    the suffix filter's bound. A task takes many shingles; one with many entries is cut into blocks, and each pair of its
    blocks is a shingle of its own."""
    counts = rows.groupBy("token").agg(F.count("*").alias("m"), F.min("comp").alias("c"), F.max("comp").alias("d")).filter("c < d")
    cut = rows.join(counts.select("token", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "token")
    cut = (cut.withColumn("mine", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
           .withColumn("bucket", F.pmod(F.xxhash64("token", "low", "high"), F.lit(parts))))
    schema = arrow_schema("a long, b long")

    def compare(table: pa.Table) -> pa.Table:
        e = {c: np.asarray(table[c], np.int64) for c in ("token", "low", "high", "mine", "doc", "comp", "n", "pos")}
        marks = np.frombuffer(b"".join(table["ranges"].to_pylist()), np.uint8).reshape(-1, RANGES + PARITIES // 8)
        e["ranges"], e["parity"] = marks[:, :RANGES].astype(np.int16), marks[:, RANGES:].copy().view(np.uint64)
        order = np.lexsort((e["doc"], e["high"], e["low"], e["token"]))
        e = {c: v[order] for c, v in e.items()}
        new = np.ones(len(order), bool)
        for c in ("token", "low", "high"):
            new[1:] &= e[c][1:] == e[c][:-1]
        new[1:] = ~new[1:]
        run = np.cumsum(new)
        found = [(np.zeros(0, np.int64),) * 3]
        i, step = np.arange(len(run)), 1
        while True:  # every entry with the one ``step`` places on, while that is of the same shingle
            i = i[i + step < len(run)]
            i = i[run[i + step] == run[i]]
            if not len(i):
                break
            for s in range(0, len(i), 100_000):
                found.append(_survivors(e, i[s:s + 100_000], i[s:s + 100_000] + step, percent))
            step += 1
        i, j, x = (np.concatenate(f) for f in zip(*found))
        a, b = e["doc"][i], e["doc"][j]
        if nearest and len(a):
            me, you, gap = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([x, x]) / np.tile(e["n"][i] + e["n"][j], 2)
            order = np.lexsort((you, gap, me))
            head = np.append(True, me[order][1:] != me[order][:-1])
            a, b = me[order][head], you[order][head]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}, schema=schema)

    return cut.groupBy("bucket").applyInArrow(compare, "a long, b long").distinct()


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, words: int) -> DataFrame:
    """``(doc, shingles)`` of the documents in ``wanted``."""
    schema = arrow_schema("doc long, shingles binary")

    def run(batches_):
        for batch in batches_:
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            yield arrow_batch({"doc": batch.column(0), "shingles": [s.tobytes() for s in sets]}, schema)

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return texts.join(broadcast_if_small(wanted), "doc", "left_semi").mapInArrow(run, "doc long, shingles binary")


def _filtered(pairs: DataFrame, rows: DataFrame, keep) -> DataFrame:
    """The pairs whose two rows of ``(doc, value)`` pass ``keep(value of a, value of b)``."""
    schema = arrow_schema("a long, b long")

    def run(batches_):
        for batch in batches_:
            good = pa.array([k for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))) if keep(x.as_py(), y.as_py())], pa.int64())
            yield arrow_batch({"a": batch.column(0).take(good), "b": batch.column(1).take(good)}, schema)

    both = pairs.join(rows.toDF("a", "value_a"), "a").join(rows.toDF("b", "value_b"), "b")
    return both.select("a", "b", "value_a", "value_b").mapInArrow(run, "a long, b long").distinct()


def _similar(x: bytes, y: bytes, percent: int) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    common = int(member(a, b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


class Join:
    """The join of the documents' shingle sets. Documents with equal sets are one class, which its
    smallest id represents; ``links`` and ``components`` speak of representatives."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                 percent: int = PERCENT, parts: int | None = None, block: int = BLOCK):
        self.docs, self.id_col, self.text_col, self.words = docs, id_col, text_col, words
        self.percent, self.block, self.parts = percent, block, parts or parts_of(docs, text_col)
        rows = written(summaries(docs, id_col, text_col, words), "summaries")
        self.sizes = rows.filter("slice IS NULL").select("doc", "n", "h1", "h2")
        full = self.sizes.filter("n > 0 AND doc IS NOT NULL")
        self.classes = full.groupBy("n", "h1", "h2").agg(F.min("doc").alias("representative"))
        chosen = self.classes.select(F.col("representative").alias("doc")).distinct()
        every = written(entries(docs, id_col, text_col, chosen, frequency_table(rows), words, percent, self.parts), "entries")
        self.fine = every.filter("token IS NULL").select("doc", F.struct("n", "ranges").alias("value"))
        every = every.filter("token IS NOT NULL")
        self.first = cut_lineage(self._proposals(every.withColumn("comp", F.col("doc")), True))
        # Who passes the filters with no one needs no further look.
        partners = self.first.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        self.entries = written(every.join(broadcast_if_small(partners), "doc", "left_semi"), "partners")

    def _proposals(self, rows: DataFrame, nearest: bool) -> DataFrame:
        return proposals(rows, nearest, self.percent, self.parts, self.block)

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sets are similar enough, counted on the whole sets; a closer suffix filter goes first."""
        percent = self.percent

        def near(x, y):
            total = x["n"] + y["n"]
            return (total - finely_apart(x["ranges"], y["ranges"])) // 2 >= needed(x["n"], y["n"], percent)

        close = cut_lineage(_filtered(pairs, self.fine, near))
        wanted = close.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        sets = written(_sets(self.docs, self.id_col, self.text_col, wanted, self.words), "sets")
        return _filtered(close, sets, lambda x, y: _similar(x, y, percent))

    def links(self) -> DataFrame:
        """All linked pairs ``(a, b)`` of representatives."""
        return self._verified(self._proposals(self.entries.withColumn("comp", F.col("doc")), False))

    def components(self, rounds: int = ROUNDS) -> DataFrame:
        """``(doc, component)`` of linked representatives. A few rounds verify each document's likeliest
        partner outside its component; then every pair left between two components is verified. Pairs inside a component
        cannot change it, so a large group of near copies costs no pair of its own for each two of them."""
        tried = self.first
        links = self._verified(tried).toDF("u", "v")
        for step in range(1, rounds + 1):
            # Two documents of one label are connected; that two others are may show only at the end.
            links = stars(links, 2)
            labels = links.groupBy(F.col("u").alias("doc")).agg(F.min("v").alias("label"))
            marked = self.entries.join(labels, "doc", "left").withColumn("comp", F.coalesce("label", "doc"))
            pairs = self._proposals(marked.drop("label"), step < rounds)
            pairs = cut_lineage(pairs.join(tried, ["a", "b"], "left_anti"))
            tried = tried.union(pairs)
            links = links.union(self._verified(pairs))
        return components(links)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       percent: int = PERCENT, parts: int | None = None, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``: the size of its set of
    ``words``-word shingles and the smallest id that links reach. Two documents are linked when
    100 * common >= ``percent`` * union. Words are runs without ASCII white space, A-Z in lower case; a shorter text
    is one shingle.

    A text without words has no shingles and is its own component. A null id is linked with nothing and
    has a null component. Rows that repeat an id are one document with the links of each. Ids are integers; other columns
    are not read. Sets hold 64-bit hashes, compared within a pair only."""
    join = Join(docs, id_col, text_col, words, percent, parts, block)
    labels = join.components(rounds)
    classes = join.sizes.join(join.classes, ["n", "h1", "h2"], "left")
    found = classes.join(labels.withColumnRenamed("doc", "representative"), "representative", "left")
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                        F.when(F.col("doc").isNotNull(), F.coalesce("component", "representative", "doc")).alias("component_id"))
