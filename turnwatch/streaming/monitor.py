"""Policies over a stream of messages: one small state per conversation.

The state holds one bit per temporal sub-formula, the next turn and the turns that
arrived early. A micro-batch of a conversation is advanced with array operations,
so its cost is linear and no row is stepped on its own.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from turnwatch.operators.grounding import knn_vote
from turnwatch.operators.monitor import Policy, check_policies, user_turn
from turnwatch.plans.formula import Formula, before_first
from turnwatch.plans.layout import snapshot_nodes
from turnwatch.plans.similarity import search
from turnwatch.session import broadcast_if_small

STATE = "next_turn long, carry string, waiting string"


class Advance:
    """Carry temporal sub-formulas over a block of consecutive steps."""

    def __init__(self, formulas: dict[str, Formula]):
        self.formulas = formulas
        self.nodes = snapshot_nodes(formulas)

    def start(self) -> dict[str, bool]:
        return {n.label: before_first(n) if n.op == "Y" else n.op == "H"
                for n in self.nodes if n.op in "YPHS"} | {f"was {k}": True for k in self.formulas}

    def __call__(self, props: dict[str, np.ndarray], n: int, carry: dict[str, bool]):
        value: dict[str, np.ndarray] = {}
        after = dict(carry)
        for node in self.nodes:
            args = [value[p.label] for p in node.parts]
            key = node.label
            if node.op == "atom":
                got = np.full(n, node.name == "true") if node.name in ("true", "false") else \
                    props.get(node.name, np.zeros(n, bool))
            elif node.op == "!":
                got = ~args[0]
            elif node.op == "&":
                got = args[0] & args[1]
            elif node.op in ("|", "->"):
                got = (args[0] if node.op == "|" else ~args[0]) | args[1]
            elif node.op == "Y":
                got = np.append(carry[key], args[0][:-1])
                after[key] = bool(args[0][-1])
            else:
                got = self._running(node.op, args, carry[key])
                after[key] = bool(got[-1])
            value[key] = got.astype(bool)
        out = {k: value[f.label] for k, f in self.formulas.items()}
        was = {k: np.append(carry[f"was {k}"], v[:-1]).astype(bool) for k, v in out.items()}
        for k, v in out.items():
            after[f"was {k}"] = bool(v[-1])
        return out, was, after

    @staticmethod
    def _running(op: str, args: list[np.ndarray], carried: bool) -> np.ndarray:
        if op == "P":
            return np.logical_or.accumulate(args[0]) | carried
        if op == "H":
            return np.logical_and.accumulate(args[0]) & carried
        hold, start = args
        mark = np.where(start | ~hold, np.arange(len(hold)), -1)
        last = np.maximum.accumulate(mark)
        return np.where(last >= 0, start[last], carried)


def stream_monitor(labelled: DataFrame, policies: list[Policy], wait_ms: int | None = None) -> DataFrame:
    """Verdicts of a stream with ``(version, conv_id, turn, role, <proposition columns>)``.

    Turns of a conversation are taken in order: early ones wait, seen ones are dropped.
    ``wait_ms`` gives up on a missing turn after that time; it is for queries that keep
    running, as a drained run (available now) would wait for its timers for ever. ``version`` is part of the
    key, so a new policy set starts with fresh state; an optional ``first_turn`` column
    tells where a conversation enters that version (default 0)."""
    check_policies(policies)
    advance = Advance({p.policy_id: p.formula for p in policies})
    names = sorted({n for p in policies for n in p.formula.propositions})
    ids = [p.policy_id for p in policies]
    first = F.col("first_turn") if "first_turn" in labelled.columns else F.lit(0)
    cols = [F.coalesce(user_turn() if n == "user_turn" else
                       (F.col(n) if n in labelled.columns else F.lit(False)), F.lit(False)).alias(f"p_{n}")
            for n in names]
    rows = labelled.select("version", "conv_id", "turn", first.cast("long").alias("first_turn"), *cols)

    def run(key, frames, state):
        if state.exists:
            turn, carry, waiting = state.get
            carry, waiting = json.loads(carry), json.loads(waiting)
        else:
            turn, carry, waiting = None, advance.start(), []
        fresh = []
        if state.hasTimedOut:
            turn = min(w[0] for w in waiting) if waiting else turn
        else:
            for pdf in frames:
                if turn is None:
                    turn = int(pdf["first_turn"].iloc[0])
                fresh.append(pdf)
        old = pd.DataFrame([[w[0], *w[1]] for w in waiting], columns=["turn", *[f"p_{n}" for n in names]])
        todo = pd.concat([old, *[f.drop(columns=["first_turn"]) for f in fresh]])[old.columns]
        todo = todo[todo["turn"] >= turn].drop_duplicates("turn").sort_values("turn")
        turns = todo["turn"].to_numpy(np.int64)
        n = int((turns == turn + np.arange(len(turns))).cumprod().sum())
        ready, later = todo.iloc[:n], todo.iloc[n:]
        if n:
            props = {m: ready[f"p_{m}"].to_numpy(bool) for m in names}
            ok, was, carry = advance(props, n, carry)
            yield pd.DataFrame({
                "version": key[0], "conv_id": key[1], "turn": turns[:n],
                "passed": np.logical_and.reduce([ok[i] for i in ids]) if ids else True,
                "failed": [[i for i in ids if not ok[i][j]] for j in range(n)],
                "onsets": [[i for i in ids if not ok[i][j] and was[i][j]] for j in range(n)]})
        waiting = [[int(r[0]), [bool(x) for x in r[1:]]] for r in later.itertuples(index=False)]
        state.update((turn + n, json.dumps(carry), json.dumps(waiting)))
        if wait_ms and waiting:
            state.setTimeoutDuration(wait_ms)

    out = ("version string, conv_id long, turn long, passed boolean, failed array<string>, "
           "onsets array<string>")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("version", "conv_id").applyInPandasWithState(run, out, STATE, "append", timeout)


def stream_violations(verdicts: DataFrame) -> DataFrame:
    """Only fresh violations: one alert per policy that turns false."""
    return verdicts.select("version", "conv_id", "turn", F.explode("onsets").alias("policy_id"))


def stream_pairs(messages: DataFrame, propositions: DataFrame) -> DataFrame:
    """Stream-static join on role: the grounding work list of a stream."""
    return messages.join(broadcast_if_small(propositions), "role")


def stream_ground(messages: DataFrame, library: DataFrame, k: int = 20) -> DataFrame:
    """Nearest-anchor vote for every message of a stream ``(msg_id, views)``. A library too large for a broadcast needs
    ``ordered.ground_to_sink``, which votes on a micro-batch at a time."""
    return knn_vote(search(messages, library, k), k)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what is available into a Parquet table."""
    query = (stream.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
