"""Training-order materialisation of token sequences (operator 9)."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwatch.llm.hashing import mix
from turnwatch.llm.rows import arrow_batch, arrow_schema

#: Tokens of a sequence, and sequences of a shard.
LENGTH, PER_SHARD = 512, 8192
#: With byte tokens: the end of a document, and what fills its last sequence. UTF-8 never has this byte.
END = 0xFF


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of 0 .. size - 1: a Feistel network on the next even number of bits, walked along
    its cycle until it lands inside the range."""

    size: int
    key: int
    rounds: int = 6

    @property
    def half(self) -> int:
        return max(1, ((max(self.size, 2) - 1).bit_length() + 1) // 2)

    def _keys(self) -> list[np.uint64]:
        return list(mix(np.arange(1, self.rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.key % 2**64)))

    def _walk(self, at: np.ndarray, keys: list, forward: bool) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)

        def once(x):
            left, right = x >> bits, x & mask
            for k in keys:
                if forward:
                    left, right = right, left ^ (mix(right ^ k) & mask)
                else:
                    left, right = right ^ (mix(left ^ k) & mask), left
            return (left << bits) | right

        out = once(np.asarray(at).astype(np.uint64))
        while (outside := out >= np.uint64(self.size)).any():
            out[outside] = once(out[outside])
        return out.astype(np.int64)

    def slots(self, index) -> np.ndarray:
        return self._walk(index, self._keys(), True)

    def indexes(self, slot) -> np.ndarray:
        return self._walk(slot, self._keys()[::-1], False)


def byte_tokens(text_col: str) -> Column:
    """A text as UTF-8 byte tokens with an end mark; a null text is the end mark alone."""
    return F.concat(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), F.lit(bytes([END])))


def materialise(docs: DataFrame, tokens: Column, folder: str, key: int, id_col: str = "doc_id", length: int = LENGTH,
                width: int = 1, pad: bytes = bytes([END]), per_shard: int = PER_SHARD) -> DataFrame:
    """Write every document's token sequences in training order and return
    ``(slot, shard, at, doc_id, k, n_tokens, sha256)``, one row per sequence.

    ``tokens`` is a binary column of ids of ``width`` bytes each. A document is cut into sequences of ``length`` ids;
    the last is filled with ``pad``. Sequences are numbered, and the keyed permutation gives each number a slot. Shard ``slot // per_shard``
    has its sequences in slot order at a fixed stride, ``at`` bytes from its start, so a reader continues at any slot.

    Sequences are numbered by counting them per partition first, so ``docs`` must be a deterministic read, such as a table;
    a partition that does not hold what was counted fails the job. A shard is written under a name of its own attempt and
    then renamed, so a task that runs again does no harm. No tokens, no sequence. Rows that repeat an id, null ids and
    other columns of ``docs`` are of no consequence; an empty table writes nothing."""
    stride = length * width
    if len(pad) != width:
        raise ValueError("pad must be one id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), tokens.alias("ids"))
    count = F.ceil(F.length("ids") / F.lit(stride)).cast("long")
    counted = (rows.select(count.alias("n")).groupBy(F.spark_partition_id().alias("part")).agg(F.sum("n").alias("n"))
               .orderBy("part").collect())  # a row per partition
    first, total = {}, 0
    for r in counted:
        first[r["part"]] = (total, r["n"] or 0)
        total += r["n"] or 0
    order = Permutation(total, key)
    ddl = "shard long, slot array<long>, doc_id array<long>, k array<int>, n_tokens array<int>, ids binary"
    schema = pa.schema([("shard", pa.int64()), ("slot", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())),
                        ("k", pa.list_(pa.int32())), ("n_tokens", pa.list_(pa.int32())), ("ids", pa.binary())])

    def cut(batches):
        start, expected = first.get(TaskContext.get().partitionId(), (0, 0))
        done = 0
        for batch in batches:
            doc, k, n, ids = [], [], [], []
            for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at in range(0, len(raw or b""), stride):
                    piece = raw[at:at + stride]
                    doc.append(d)
                    k.append(at // stride)
                    n.append(len(piece) // width)
                    ids.append(piece + pad * (length - n[-1]))
            if done + len(doc) > expected:
                break
            slot = order.slots(np.arange(start + done, start + done + len(doc))) if doc else np.zeros(0, np.int64)
            done += len(doc)
            # Sequences for one shard travel together, compressed.
            by_shard = np.argsort(slot, kind="stable")
            shards = slot[by_shard] // per_shard
            edges = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if doc else []
            out = {name: [] for name in schema.names}
            for s, e in zip(edges, [*edges[1:], len(doc)]):
                pick = by_shard[s:e]
                out["shard"].append(int(shards[s]))
                out["slot"].append(slot[pick])
                for name, values in (("doc_id", doc), ("k", k), ("n_tokens", n)):
                    out[name].append([values[i] for i in pick])
                out["ids"].append(zstandard.compress(b"".join(ids[i] for i in pick)))
            yield arrow_batch(out, schema)
        else:
            if done == expected:
                return
        raise RuntimeError("the input changed between counting and writing")

    out_ddl = "slot long, shard long, at long, doc_id long, k int, n_tokens int, sha256 string"
    out_schema = arrow_schema(out_ddl)

    def write(key_, table):
        shard = key_[0].as_py()
        begin = shard * per_shard
        slots, doc, k, n = (np.asarray(table[c].combine_chunks().flatten().to_pylist(), object) for c in ("slot", "doc_id", "k", "n_tokens"))
        data = b"".join(zstandard.decompress(x) for x in table["ids"].to_pylist())
        pick = np.argsort(slots.astype(np.int64), kind="stable")
        if not np.array_equal(slots[pick].astype(np.int64), np.arange(begin, min(begin + per_shard, total))):
            raise RuntimeError(f"shard {shard} is not complete")
        ids = [data[i * stride:(i + 1) * stride] for i in pick]
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        own = f"{path}/.shard-{shard:08d}-{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(own) as out:
            out.write(b"".join(ids))
        fs.move(own, shard_path(path, shard))
        at = np.arange(len(ids)) * stride
        return pa.table({"slot": begin + np.arange(len(ids)), "shard": [shard] * len(ids), "at": at, "doc_id": doc[pick].tolist(),
                         "k": k[pick].tolist(), "n_tokens": n[pick].tolist(), "sha256": [hashlib.sha256(p).hexdigest() for p in ids]},
                        schema=out_schema)

    return rows.mapInArrow(cut, ddl).groupBy("shard").applyInArrow(write, out_ddl)


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def read_slots(folder: str, slot: int, count: int, length: int = LENGTH, width: int = 1, per_shard: int = PER_SHARD):
    """The sequences from ``slot`` on, ``count`` of them or as many as there are."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    stride = length * width
    while count > 0:
        shard, row = divmod(slot, per_shard)
        if fs.get_file_info(shard_path(path, shard)).type == pyarrow.fs.FileType.NotFound:
            return
        with fs.open_input_file(shard_path(path, shard)) as data:
            data.seek(row * stride)
            block = data.read(min(count, per_shard - row) * stride)
        for at in range(0, len(block), stride):
            yield block[at:at + stride]
        got = len(block) // stride
        if row + got < per_shard and got < count:
            return
        slot, count = slot + got, count - got
