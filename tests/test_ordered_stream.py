"""Turns in order, late, repeated and missing; states that go on; outputs written once."""

import random
import time

import pytest
from pyspark.sql import functions as F

from turnwatch.operators import monitor as M
from turnwatch.operators.resume import carried_nodes, judge_from
from turnwatch.plans.layout import TraceLayout
from turnwatch.session import new_folder
from turnwatch.streaming import monitor as S
from turnwatch.streaming import ordered as O

POLICIES = [M.Policy("x", "x", "H(P(p) -> !q)"), M.Policy("y", "y", "q -> (!p S user_turn)"),
            M.Policy("z", "z", "Y(H(p)) | P(Y(q) & (p S q))")]
SCHEMA = "conv string, turn long, role string, p boolean, q boolean"


def messages(rng, n=8):
    return [(f"c{c}", t, "user" if t % 2 == 0 else "assistant", rng.random() < .3, rng.random() < .3)
            for c in range(n) for t in range(rng.randint(1, 12))]


def judged(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = M.monitor(df, POLICIES, TraceLayout.of(df, "conv", "turn"), history=True).collect()
    return {(r.conv, r.turn): (r.passed, [p.policy_id for p in POLICIES if not r[f"ok_{p.policy_id}"]],
                               [p.policy_id for p in POLICIES if not r[f"ok_{p.policy_id}"] and not r[f"was_{p.policy_id}"]]) for r in out}


def stream(spark, batches, **options):
    src, out, state = (new_folder(spark, n) for n in ("src", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        read = spark.readStream.schema(SCHEMA).parquet(src)
        turns = O.ordered_monitor(read, POLICIES, key=["conv"], **options)
        with O.state_store(spark):
            S.run_to_table(turns, out, state)
    return spark.read.schema(turns.schema).parquet(out).collect()


def test_shuffled_and_repeated_turns(spark):
    rng = random.Random(4)
    rows = messages(rng)
    again = rng.sample(rows, 10)
    arrivals = rows + again
    rng.shuffle(arrivals)
    got = stream(spark, [arrivals[0::2], arrivals[1::2]])
    want = judged(spark, rows)
    assert {(r.conv, r.turn): (r.passed, r.failed, r.onsets) for r in got if r.status == O.OK} == want
    assert sorted((r.conv, r.turn) for r in got if r.status == O.REPEATED) == sorted((r[0], r[1]) for r in again)
    assert len(got) == len(arrivals)


def test_missing_and_late_turns(spark):
    rows = [("a", t, "user", t % 2 == 0, t == 6) for t in range(8)]
    first = [r for r in rows if r[1] not in (2, 3, 5)]
    got = stream(spark, [first, [rows[3], rows[0], rows[2]], [("b", 0, "user", True, True)]], max_early=0)
    want = judged(spark, first)
    assert {(r.conv, r.turn): (r.passed, r.failed, r.onsets) for r in got if r.status == O.OK and r.conv == "a"} == want
    assert sorted((r.status, r.turn, r.until) for r in got if r.status != O.OK) == [
        (O.LATE, 2, None), (O.LATE, 3, None), (O.REPEATED, 0, None), (O.SKIPPED, 2, 3), (O.SKIPPED, 5, 5)]
    waits = stream(spark, [first], max_early=2)
    assert sorted((r.status, r.turn) for r in waits) == [(O.OK, 0), (O.OK, 1), (O.OK, 4), (O.SKIPPED, 2)]


def test_a_timer_gives_up_on_a_gap(spark):
    src, out, state = (new_folder(spark, n) for n in ("src", "out", "state"))
    rows = [("a", t, "user", False, False) for t in (0, 1, 3, 4)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(src)
    turns = O.ordered_monitor(spark.readStream.schema(SCHEMA).parquet(src), POLICIES, key=["conv"], wait_ms=1000, ttl_ms=600_000)
    with O.state_store(spark):
        query = (turns.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
                 .trigger(processingTime="500 milliseconds").start())
    try:
        end = time.time() + 90
        got = []
        while len(got) < 5 and time.time() < end:
            time.sleep(1)
            got = spark.read.schema(turns.schema).parquet(out).collect()
    finally:
        query.stop()
    assert sorted((r.turn, r.status) for r in got) == [(0, O.OK), (1, O.OK), (2, O.SKIPPED), (3, O.OK), (4, O.OK)]


@pytest.mark.parametrize("segment_rows", [None, 3])
def test_any_cut_equals_one_run(spark, segment_rows):
    rng = random.Random(6)
    rows = messages(rng, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    want = judged(spark, rows)
    for cuts in ([3], [1, 2, 7]):
        state, got = None, {}
        for upto in [*cuts, 99]:
            verdicts, state = judge_from(df.filter(F.col("turn") < upto), POLICIES, "conv", "turn", state, segment_rows)
            folder = new_folder(spark, "bits")
            state.write.parquet(folder)
            state = spark.read.parquet(folder)
            for r in verdicts.collect():
                assert (r.conv, r.turn) not in got
                failed = [p.policy_id for p in POLICIES if not r[f"ok_{p.policy_id}"]]
                got[r.conv, r.turn] = (r.passed, failed, [i for i in failed if not r[f"was_{i}"]])
        assert got == want
        last = {r.conv: r.turn for r in state.collect()}
        assert last == {c: max(t for k, t in want if k == c) for c, _ in want}
        assert all(set(r.carry) == {n.label for n in carried_nodes(POLICIES)} for r in state.collect())


def test_stream_goes_on_from_a_batch(spark):
    rows = messages(random.Random(8))
    df = spark.createDataFrame(rows, SCHEMA)
    _, state = judge_from(df.filter("turn < 4"), POLICIES, "conv", "turn")
    got = stream(spark, [[r for r in rows if r[1] >= 4]], state=state)
    want = {k: v for k, v in judged(spark, rows).items() if k[1] >= 4}
    assert {(r.conv, r.turn): (r.passed, r.failed, r.onsets) for r in got} == want


def test_a_batch_that_runs_twice_is_written_once(spark):
    path = new_folder(spark, "sink")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "n long, s string")
    O.write_batch({"turns": one, "alerts": one.limit(1)}, 0, path)
    O.write_batch({"turns": one, "alerts": one.limit(1)}, 0, path)
    one.write.parquet(f"{path}/turns/batch=1")  # died before its commit
    read = lambda name: sorted((r.n, r.batch) for r in O.read_committed(spark, path, name, "n long, s string, batch long").collect())
    assert read("turns") == [(1, 0), (2, 0)] and read("alerts") == [(1, 0)]
    O.write_batch({"turns": one, "alerts": one}, 1, path)
    assert len(read("turns")) == 4 and len(read("alerts")) == 3
