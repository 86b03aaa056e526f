"""Phrase collocations by prefix-free parsing (operator 12).

The words of a document are cut where the content says so: a chunk starts at a window of three words whose
hash is a multiple of ``EVERY``, and ends with the window at which the next chunk starts. So every phrase of
up to four words lies whole in the chunk in which its first word stands before the overlap, and is counted there once.
Equal passages give equal chunks. Chunks form a dictionary with parse frequencies, and phrases are counted in the
distinct chunks only, each weighted by its frequency.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwatch.llm.hashing import join_hash, mix, word_hash
from turnwatch.llm.repeats import slices
from turnwatch.llm.rows import arrow_schema, written

LONGEST, OVERLAP, EVERY = 4, 3, 12
LEAST, CONTAINED, FIRST = 30, 80, 2000
#: Bits of a filter of frequent phrases: 8 MB for any corpus. A wrong yes costs work, never a result.
FILTER_BITS = 26
BATCH_BYTES, BUCKET_BYTES = 4_000_000, 16_000_000
CHUNKS_DDL = "lang string, chunk binary, final boolean, n long"
COUNTS_DDL = "k int, bucket int, once binary, keys binary, counts binary"
PHRASES_DDL = "lang string, phrase string, k int, n long"
# Breaks become line feeds, tabs spaces, A-Z lower case.
_PLAIN = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_TABLE = np.frombuffer(_PLAIN, np.uint8)
U64 = np.uint64


class Parse:
    """Words of texts that were joined by NUL-free borders: ``first[t]:first[t + 1]`` are those of text ``t``.
    ``run`` tells how many words from each word on belong to the same piece, up to ``LONGEST``. Between two words
    ``buf`` has one line feed or space, whatever stood there, and a line feed behind each text."""

    def __init__(self, buf: np.ndarray, end: np.ndarray, first: np.ndarray):
        self.buf, self.end, self.first = buf, end, first
        self.start = np.append(0, end[:-1] + 1) if len(end) else end
        broken = buf[end] == 10
        self.run = np.ones(len(end), np.int8)
        same = np.ones(len(end), bool)
        for k in range(1, LONGEST):
            same = same[:-1] & ~broken[k - 1:-1]
            self.run[:len(same)][same] = k + 1
        self.hash = word_hash(buf, self.start, end)

    @classmethod
    def of_texts(cls, raw: list[bytes]) -> Parse:
        """The words of raw texts in UTF-8."""
        buf = _TABLE[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
        ends = np.cumsum([len(r) + 1 for r in raw])
        gap = np.ones(len(buf) + 1, bool)
        gap[1:] = (buf == 10) | (buf == 32)
        turn = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = turn[::2], turn[1::2]
        first = np.searchsorted(start, np.append(0, ends))
        piece = np.append(0, np.cumsum(buf == 10))[start]
        keep = ~gap[1:]
        keep[end] = True
        buf[end] = np.where(np.diff(piece, append=-1) != 0, 10, 32)
        return cls(buf[keep], (np.cumsum(keep) - 1)[end], first)

    @classmethod
    def of_chunks(cls, data: np.ndarray, offsets: np.ndarray) -> Parse:
        """The words of chunks that lie one behind the other, as ``dictionary`` cut them."""
        end = np.flatnonzero((data == 10) | (data == 32))
        return cls(data, end, np.searchsorted(end, offsets))

    def grams(self, seed: np.ndarray, longest: int = LONGEST) -> list[np.ndarray]:
        """Hashes of the phrases of 1 to ``longest`` words from each word on (meaningless beyond its run)."""
        one = join_hash(seed, self.hash)
        out = [one]
        for k in range(1, longest):
            nxt = np.zeros(len(one), np.uint64)
            nxt[:len(one) - k] = join_hash(out[-1][:len(one) - k], self.hash[k:])
            out.append(nxt)
        return out

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The ``k`` words from each of ``at``, joined by one space."""
        first, size = self.start[at], self.end[at + k - 1] - self.start[at]
        ends = np.append(0, np.cumsum(size))
        data = self.buf[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def border(parse: Parse, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(begin, end, final)`` of the chunks of all texts, as places of words (end excluded). The borders depend on
    the words of a window alone, so the same words are cut in the same way wherever they stand."""
    h, n = parse.hash, len(parse.hash)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool)
    last = np.repeat(parse.first[1:], np.diff(parse.first))
    trigger = np.zeros(n, bool)
    if n >= OVERLAP:
        window = mix(join_hash(join_hash(h[:-2], h[1:-1]), h[2:]))
        trigger[:n - 2] = window % U64(every) == 0
    trigger &= np.arange(n) + OVERLAP < last  # the last words open no chunk of their own
    trigger[parse.first[:-1][np.diff(parse.first) > 0]] = True
    begin = np.flatnonzero(trigger)
    upper = last[begin]
    end = np.append(begin[1:], n) + OVERLAP
    final = np.append(begin[1:], n) >= upper
    return begin, np.where(final, upper, np.minimum(end, upper)), final


def groups(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the place of one of each and the sum of its weights."""
    if not len(values):
        return values, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(values)
    ranked = values[order]
    head = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    return ranked[head], order[head], np.add.reduceat(weights[order], head)


def lang_seeds(names: list[str]) -> np.ndarray:
    """A hash of each language."""
    raw = [x.encode() for x in names]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    buf = np.frombuffer(b"".join(raw) or b"\0", np.uint8)
    return word_hash(buf, ends - np.array([len(r) for r in raw], np.int64), ends, 5)


def _cut(sizes: list[int]):
    start = used = 0
    for i, size in enumerate(sizes):
        if used and used + size > BATCH_BYTES:
            yield start, i
            start, used = i, 0
        used += size
    if start < len(sizes):
        yield start, len(sizes)


def dictionary(docs: DataFrame, lang: Column, text_col: str, every: int = EVERY) -> DataFrame:
    """``(lang, chunk, final, n)``: the distinct chunks of each language and how often each was parsed. ``final`` chunks
    end a document and have no overlap."""
    schema = arrow_schema(CHUNKS_DDL)

    def run(batches):
        for batch in batches:
            texts, langs = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], batch.column(0).to_pylist()
            for a, b in _cut([len(t) for t in texts]):
                parse = Parse.of_texts(texts[a:b])
                begin, end, final = border(parse, every)
                left, right = parse.start[begin], parse.end[end - 1]
                text = np.searchsorted(parse.first, begin, side="right") - 1
                found: dict = {}
                data = parse.buf.tobytes()
                for t, s, e, f in zip(text.tolist(), left.tolist(), right.tolist(), final.tolist()):
                    key = (langs[a + t], data[s:e] + b"\n", f)
                    found[key] = found.get(key, 0) + 1
                if found:
                    names, chunks, ends = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(chunks, pa.binary()), pa.array(ends),
                                                      pa.array(list(found.values()), pa.int64())], schema=schema)

    rows = docs.select(lang.alias("lang"), F.col(text_col)).mapInArrow(run, CHUNKS_DDL)
    return rows.groupBy("lang", "chunk", "final").agg(F.sum("n").alias("n"))


def _joined(batches):
    """Batches of chunks put together to about ``BATCH_BYTES``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BATCH_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _parsed(batch):
    """Parses of the chunks of a batch: the parse, names and places of languages, weight and chunk of each
    word, and the words that start phrases (those before the overlap)."""
    chunks, langs = batch.column("chunk"), batch.column("lang").dictionary_encode()
    final, n = batch.column("final").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
    names, place = langs.dictionary.to_pylist(), langs.indices.to_numpy()
    seeds = lang_seeds(names)
    offsets = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset:chunks.offset + len(chunks) + 1].astype(np.int64)
    data = np.frombuffer(chunks.buffers()[2], np.uint8)
    for a, b in _cut(np.diff(offsets).tolist()):
        parse = Parse.of_chunks(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        count = np.diff(parse.first)
        stop = np.where(final[a:b], parse.first[1:], parse.first[1:] - OVERLAP)
        opens = np.arange(len(parse.start)) < np.repeat(stop, count)
        where = np.repeat(place[a:b], count)
        yield parse, names, where, seeds[where], np.repeat(n[a:b], count), opens


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in a filter."""
    at = hashes >> U64(64 - FILTER_BITS)
    return (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1


def hopeful(parse: Parse, grams: list[np.ndarray], opens: np.ndarray, filters: list, k: int) -> np.ndarray:
    """Words at which a phrase of ``k`` words starts whose shorter phrases may all be frequent: those of ``k - 1`` words,
    or of the longest length that has a filter."""
    at = np.flatnonzero(opens & (parse.run >= k))
    known = min(k - 1, len(filters))
    # The hash of a phrase starts from its language, so each part is hashed from its own first word.
    for i in range(k - known + 1 if known else 0):
        at = at[has(filters[known - 1], grams[known - 1][at + i])]
    return at


def frequent(chunks: DataFrame, filters: list, lengths: list[int], least: int, buckets: int) -> list[np.ndarray]:
    """A filter for each of ``lengths`` of the phrases of so many words that occur ``least`` times or more: a bit for each, by
    64-bit hashes. Counts are summed up per batch, travel as sorted arrays and meet in a bucket of their own."""
    schema = arrow_schema(COUNTS_DDL)
    held = len(filters)
    shared = chunks.sparkSession.sparkContext.broadcast(filters[-1:])

    def count(batches):
        known = [None] * (held - 1) + shared.value if held else []
        for batch in _joined(batches):
            for parse, _, _, seeds, weight, opens in _parsed(batch):
                grams = parse.grams(seeds, lengths[-1])
                rows = [[], [], [], [], []]
                for k in lengths:
                    at = hopeful(parse, grams, opens, known, k)
                    keys, _, n = groups(grams[k - 1][at], weight[at])
                    for b, s, e in slices(keys, buckets):
                        one = n[s:e] == 1
                        for column, value in zip(rows, (k, b, keys[s:e][one].tobytes(), keys[s:e][~one].tobytes(), n[s:e][~one].tobytes())):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    slots = "k int, slot int, word long"
    slot_schema = arrow_schema(slots)

    def add(table: pa.Table) -> pa.Table:
        once, keys, n = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in
                         (("once", np.uint64), ("keys", np.uint64), ("counts", np.int64)))
        every, _, total = groups(np.concatenate([once, keys]), np.concatenate([np.ones(len(once), np.int64), n]))
        at = np.unique(every[total >= least] >> U64(64 - FILTER_BITS))
        slot, place, _ = groups(at >> U64(6), np.ones(len(at), np.int64))
        bits = U64(1) << (at & U64(63))
        words = np.bitwise_or.reduceat(bits, place) if len(place) else bits
        k = np.full(len(slot), table["k"][0].as_py(), np.int32)
        return pa.table({"k": k, "slot": slot.astype(np.int32), "word": words.view(np.int64)}, schema=slot_schema)

    counted = chunks.mapInArrow(count, COUNTS_DDL).groupBy("k", "bucket").applyInArrow(add, slots)
    found = counted.groupBy("k", "slot").agg(F.bit_or("word").alias("word")).toArrow()
    length, slot, word = (found[c].to_numpy() for c in ("k", "slot", "word"))
    out = []
    for k in lengths:
        bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
        bits[slot[length == k]] = word[length == k].view(np.uint64)
        out.append(bits)
    return out


def phrase_counts(chunks: DataFrame, filters: list, least: int) -> DataFrame:
    """``(lang, phrase, k, n)``: the exact count of every phrase that occurs ``least`` times or more, and for ``k = 0`` the
    words of each language."""
    schema = arrow_schema(PHRASES_DDL)
    shared = chunks.sparkSession.sparkContext.broadcast(filters)

    def count(batches):
        known = shared.value
        for batch in _joined(batches):
            for parse, names, place, seeds, weight, opens in _parsed(batch):
                langs = pa.array(names, pa.string())
                words = np.zeros(len(names), np.int64)
                np.add.at(words, place[opens], weight[opens])
                none = pa.array([""] * len(names), pa.string())
                yield pa.RecordBatch.from_arrays([langs, none, pa.array(np.zeros(len(names), np.int32)), pa.array(words)], schema=schema)
                second = word_hash(parse.buf, parse.start, parse.end, 1)
                grams = parse.grams(seeds)
                for k in range(1, LONGEST + 1):
                    at = hopeful(parse, grams, opens, known, k)
                    at = at[has(known[k - 1], grams[k - 1][at])]
                    if not len(at):
                        continue
                    # Phrases of a batch are told apart by 128 bits.
                    more = second[at]
                    for j in range(1, k):
                        more = join_hash(more, second[at + j])
                    order = np.lexsort((more, grams[k - 1][at]))
                    first, then = grams[k - 1][at][order], more[order]
                    head = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (then[1:] != then[:-1])))
                    total = np.add.reduceat(weight[at][order], head)
                    pick = at[order[head]]
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(place[pick])), parse.phrases(pick, k),
                                                      pa.array(np.full(len(pick), k, np.int32)), pa.array(total)], schema=schema)

    return (chunks.mapInArrow(count, PHRASES_DDL).groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n"))
            .filter((F.col("n") >= least) | (F.col("k") == 0)))


def _first(rows: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """The first rows of each language: first those of salted shares, then of fewer, so that no task sorts all of a language."""
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while salts > 1:
        share = F.pmod(F.xxhash64("phrase"), F.lit(salts))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).filter(F.col("rank") <= limit)
        salts = math.isqrt(salts)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= limit)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, contained: int = CONTAINED,
                 first: int = FIRST, every: int = EVERY) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``first`` phrases of 2 to 4 words of each language by score.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` how often the two sides of its lowest-scoring cut do (ties: the
    shorter left side), ``n`` the words of the language, ``score`` floor(2000000 a / (l + r)). A phrase needs ``least`` occurrences
    and goes if it lies inside a longer one that occurs ``contained`` percent as often. Phrases do not cross ``.,;:!?`` or ends of lines.
    A null language is ``und``, a null or empty text has no words, repeated rows count each time. Only the two columns are read.
    A chunk without a border inside is as long as its document."""
    chunks = written(dictionary(docs, F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")), f"`{text_col}`", every), "chunks")
    size = chunks.agg(F.coalesce(F.sum(F.length("chunk")), F.lit(0))).first()[0]
    buckets = max(16, math.ceil(size / BUCKET_BYTES))
    filters: list[np.ndarray] = []
    # Few phrases are left once their pairs of words are known, so the longer ones take one pass together.
    for lengths in ([1], [2], list(range(3, LONGEST + 1))):
        filters += frequent(chunks, filters, lengths, least, buckets)
    counts = written(phrase_counts(chunks, filters, least), "phrases")

    found = counts.filter("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    side = lambda lo, hi: F.array_join(F.slice("words", lo, hi), " ")
    cuts = (found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
            .withColumn("left", side(F.lit(1), F.col("cut"))).withColumn("right", side(F.col("cut") + 1, F.col("k") - F.col("cut"))))
    part = counts.filter("k between 1 and 3").select("lang", "phrase", "n")
    cuts = (cuts.join(part.toDF("lang", "left", "l"), ["lang", "left"]).join(part.toDF("lang", "right", "r"), ["lang", "right"]))
    cuts = cuts.withColumn("score", F.expr(
        "cast((cast(a as decimal(19,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)"))
    low = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("m"))

    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    longer = (found.filter("k > 2").select("lang", "a", F.explode(F.array_distinct(inside)).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    kept = (low.select("lang", "phrase", "m.*").join(longer, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * contained)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = _first(kept.select("lang", "phrase", "a", "l", "r", "score"), first, order)
    words = counts.filter("k = 0").select("lang", "n")
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
