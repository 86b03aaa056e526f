"""Policies over a stream, turn by turn, on state variables: early turns wait, late, repeated and missing ones are told.

Per conversation the state holds the next turn with one bit per temporal sub-formula, a map of the turns that
came early, and the gaps that were given up. A micro-batch is advanced with array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from turnwatch.operators.monitor import Policy, check_policies, user_turn
from turnwatch.plans.formula import weak_yesterday
from turnwatch.streaming.monitor import Advance, stream_ground

OK, LATE, REPEATED, SKIPPED = "ok", "late", "repeated", "skipped"
VERDICT = "turn long, until long, status string, passed boolean, failed array<string>, onsets array<string>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """State variables need the RocksDB store; a query takes the setting when it starts."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class OrderedTurns(StatefulProcessor):
    """One conversation; ``key`` columns come first in every output row."""

    def __init__(self, policies: list[Policy], names: list[str], key: list[str], wait_ms: int | None,
                 max_early: int | None, ttl_ms: int | None):
        self.formulas = {p.policy_id: p.formula for p in policies}
        self.names, self.key = names, key
        self.wait_ms, self.max_early, self.ttl_ms = wait_ms, max_early, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.advance = Advance(self.formulas)
        self.fresh = self.advance.start()
        # The label under which a saved state holds each bit.
        was = {f"was {k}": weak_yesterday(f).label for k, f in self.formulas.items()}
        self.saved = {k: was.get(k, k) for k in self.fresh}
        self.head = handle.getValueState("head", "next_turn long, carry binary", self.ttl_ms)
        self.early = handle.getMapState("early", "turn long", "bits binary", self.ttl_ms)
        self.gaps = handle.getMapState("gaps", "first long", "last long", self.ttl_ms)
        self.due = handle.getValueState("due", "at long", self.ttl_ms)

    def close(self) -> None:
        pass

    def _pack(self, carry: dict[str, bool]) -> bytes:
        return np.packbits([carry[k] for k in self.fresh]).tobytes()

    def _unpack(self, raw: bytes) -> dict[str, bool]:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8))
        return {k: bool(b) for k, b in zip(self.fresh, bits)}

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        held = dict(row["carry"])
        self.head.update((int(row["turn"]) + 1, self._pack({k: held.get(self.saved[k], v) for k, v in self.fresh.items()})))

    def _rows(self, key, turn, status, until=None, passed=None, failed=None, onsets=None) -> pd.DataFrame:
        n = len(turn)
        return pd.DataFrame({**{k: [v] * n for k, v in zip(self.key, key)}, "turn": turn, "until": until if until is not None else [None] * n,
                             "status": [status] * n, "passed": passed if passed is not None else [None] * n,
                             "failed": failed if failed is not None else [None] * n, "onsets": onsets if onsets is not None else [None] * n})

    def _step(self, key, turn: int, carry: dict, waiting: dict[int, bytes]):
        """Judge the turns from ``turn`` on that stand without a gap."""
        n = 0
        while turn + n in waiting:
            n += 1
        if not n:
            return turn, carry, []
        bits = np.array([np.frombuffer(waiting.pop(turn + i), np.uint8) for i in range(n)], bool).reshape(n, len(self.names))
        ok, was, carry = self.advance({m: bits[:, i] for i, m in enumerate(self.names)}, n, carry)
        ids = list(self.formulas)
        return turn + n, carry, [self._rows(
            key, [turn + i for i in range(n)], OK, passed=[all(bool(ok[p][i]) for p in ids) for i in range(n)],
            failed=[[p for p in ids if not ok[p][i]] for i in range(n)],
            onsets=[[p for p in ids if not ok[p][i] and was[p][i]] for i in range(n)])]

    def _skip(self, key, turn: int, carry: dict, waiting: dict[int, bytes]):
        """Give up on the turns before the first that waits, and judge on."""
        first = min(waiting)
        self.gaps.updateValue((turn,), (first - 1,))
        told = self._rows(key, [turn], SKIPPED, until=[first - 1])
        turn, carry, out = self._step(key, first, carry, waiting)
        return turn, carry, [told, *out]

    def _load(self) -> tuple:
        head = self.head.get() if self.head.exists() else None
        waiting = {int(k[0]): bytes(v[0]) for k, v in self.early.iterator()}
        return head, waiting

    def _store(self, turn: int, carry: dict, before: dict, waiting: dict, now: int | None) -> None:
        self.head.update((turn, self._pack(carry)))
        for t in before.keys() - waiting.keys():
            self.early.removeKey((t,))
        for t in waiting.keys() - before.keys():
            self.early.updateValue((t,), (waiting[t],))
        if self.wait_ms is None:
            return
        if not waiting:
            self.due.clear()
        elif not self.due.exists():
            self.due.update((now + self.wait_ms,))
            self.handle.registerTimer(now + self.wait_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        todo = pd.concat(list(rows))
        head, waiting = self._load()
        turn, carry = (head[0], self._unpack(head[1])) if head else (int(todo["first_turn"].min()), dict(self.fresh))
        before, opened = dict(waiting), turn
        gone = [(int(a[0]), int(b[0])) for a, b in self.gaps.iterator()]
        late, again = [], []
        for t, bits in zip(todo["turn"].tolist(), todo[[f"p_{m}" for m in self.names]].to_numpy(np.uint8) if self.names else [np.zeros(0, np.uint8)] * len(todo)):
            if t < turn:
                (late if any(a <= t <= b for a, b in gone) else again).append(t)
            elif t in waiting:
                again.append(t)
            else:
                waiting[t] = bits.tobytes()
        out = [self._rows(key, ts, status) for ts, status in ((late, LATE), (again, REPEATED)) if ts]
        turn, carry, told = self._step(key, turn, carry, waiting)
        out += told
        while self.max_early is not None and len(waiting) > self.max_early:
            turn, carry, told = self._skip(key, turn, carry, waiting)
            out += told
        if self.wait_ms is not None and turn != opened:
            self.due.clear()  # the gap that was waited for is closed
        self._store(turn, carry, before, waiting, timerValues.getCurrentProcessingTimeInMs() if self.wait_ms else None)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        head, waiting = self._load()
        if not head or not waiting or not self.due.exists() or self.due.get()[0] > expiredTimerInfo.getExpiryTimeInMs():
            return
        before = dict(waiting)
        turn, carry, out = self._skip(key, head[0], self._unpack(head[1]), waiting)
        self.due.clear()
        self._store(turn, carry, before, waiting, timerValues.getCurrentProcessingTimeInMs())
        yield from out


def ordered_monitor(labelled: DataFrame, policies: list[Policy], key: list[str] = ("version", "conv_id"), wait_ms: int | None = None,
                    max_early: int | None = None, ttl_ms: int | None = None, state: DataFrame | None = None) -> DataFrame:
    """What becomes of every turn of a stream ``(<key>, turn, role, <proposition columns>)``; keys of any type.

    ``status`` is ``ok`` for a judged turn, ``repeated`` for one that came before, ``skipped`` for the missing turns ``turn`` to
    ``until`` that were given up, and ``late`` for one of those that comes after all (it has no verdict). Early turns wait.
    A gap is given up when more than ``max_early`` turns of the conversation wait (this also bounds the state), or, in a query
    that keeps running, ``wait_ms`` after it opened. ``ttl_ms`` frees the state of a conversation that long after its last
    change. ``state`` is a table ``(<key>, turn, carry)`` as ``resume.judge_from`` gives it: conversations go on from there.
    Start the query within ``state_store``."""
    check_policies(policies)
    key = list(key)
    names = sorted({n for p in policies for n in p.formula.propositions})
    first = F.col("first_turn") if "first_turn" in labelled.columns else F.lit(0)
    cols = [F.coalesce(user_turn() if n == "user_turn" else (F.col(n) if n in labelled.columns else F.lit(False)), F.lit(False)).alias(f"p_{n}")
            for n in names]
    rows = labelled.select(*key, F.col("turn").cast("long"), first.cast("long").alias("first_turn"), *cols)
    kinds = ", ".join(f"`{k}` {labelled.schema[k].dataType.simpleString()}" for k in key)
    processor = OrderedTurns(policies, names, key, wait_ms, max_early, ttl_ms)
    start = state.select(*key, F.col("turn").cast("long"), "carry").groupBy(*key) if state is not None else None
    return rows.groupBy(*key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"{kinds}, {VERDICT}", outputMode="Append",
        timeMode="ProcessingTime" if wait_ms or ttl_ms else "None", initialState=start)


# -- a sink of several outputs ------------------------------------------------------------------


def write_batch(outputs: dict[str, DataFrame], batch_id: int, path: str) -> None:
    """Each output of a micro-batch as a folder of its own, then the batch's commit. A batch that runs again replaces
    what it wrote before; what has no commit is not read."""
    for name, df in outputs.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
    spark = next(iter(outputs.values())).sparkSession
    spark.range(batch_id, batch_id + 1).toDF("n").write.mode("overwrite").parquet(f"{path}/commits/batch={batch_id}")


def read_committed(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    """All rows of an output whose batches were committed."""
    done = spark.read.schema("n long, batch long").parquet(f"{path}/commits").select("batch").distinct()
    rows = spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    return rows.join(F.broadcast(done), "batch", "left_semi")


def run_to_sink(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain a stream of ``ordered_monitor`` into two outputs of ``path``, each row once: ``turns``, and ``alerts`` with a row per
    policy that turns false."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        alerts = batch.withColumn("policy_id", F.explode("onsets")).drop("onsets", "failed", "passed", "status", "until")
        write_batch({"turns": batch, "alerts": alerts}, batch_id, path)
        batch.unpersist()

    with state_store(stream.sparkSession):
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ground_to_sink(messages: DataFrame, library: DataFrame, path: str, checkpoint: str, k: int = 20) -> None:
    """Drain a stream ``(msg_id, views)`` into the output ``votes`` of ``path``, each message's votes once. A micro-batch is a table, so a
    library that does not fit a broadcast is searched in blocks."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch({"votes": stream_ground(batch, library, k)}, batch_id, path)

    query = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
