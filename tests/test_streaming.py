"""A stream with late, early and repeated turns gives the batch verdicts."""

import random
import time

from turnwatch.operators import monitor as M
from turnwatch.plans.layout import TraceLayout
from turnwatch.session import new_folder
from turnwatch.streaming import monitor as S

POLICIES = [M.Policy("x", "x", "H(P(p) -> !q)"), M.Policy("y", "y", "q -> (!p S user_turn)"),
            M.Policy("z", "z", "Y(H(p)) | P(Y(q) & (p S q))")]
SCHEMA = "version string, conv_id long, turn long, role string, p boolean, q boolean"


def messages(rng):
    return [("v1", c, t, "user" if t % 2 == 0 else "assistant", rng.random() < .3, rng.random() < .3)
            for c in range(12) for t in range(rng.randint(1, 25))]


def run(spark, batches, wait_ms=None):
    src, out = new_folder(spark, "src"), new_folder(spark, "out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    S.run_to_table(S.stream_monitor(stream, POLICIES, wait_ms), out, new_folder(spark, "state"))
    return spark.read.parquet(out).collect()


def test_shuffled_stream_equals_batch(spark):
    rng = random.Random(9)
    rows = messages(rng)
    df = spark.createDataFrame(rows, SCHEMA)
    layout = TraceLayout.of(df, "conv_id", "turn")
    batch = {(r.conv_id, r.turn): r for r in M.monitor(df, POLICIES, layout, history=True).collect()}
    arrivals = rows + rng.sample(rows, 30)        # some arrive twice
    rng.shuffle(arrivals)
    got = run(spark, [arrivals[i::4] for i in range(4)])
    assert len(got) == len(rows)
    for r in got:
        want = batch[r.conv_id, r.turn]
        failed = [p.policy_id for p in POLICIES if not want[f"ok_{p.policy_id}"]]
        assert r.failed == failed and r.passed == want.passed
        assert r.onsets == [i for i in failed if not want[f"was_{i}"]]


def test_a_gap_holds_later_turns_back(spark):
    rows = [("v1", 1, t, "user", False, False) for t in (0, 1, 3, 4)]
    assert sorted(r.turn for r in run(spark, [rows])) == [0, 1]


def test_versions_do_not_share_state(spark):
    rows = [("v1", 1, 0, "user", True, False), ("v1", 1, 1, "assistant", False, True),
            ("v2", 1, 0, "assistant", False, True)]
    got = {(r.version, r.turn): "x" in r.failed for r in run(spark, [rows])}
    assert got == {("v1", 0): False, ("v1", 1): True, ("v2", 0): False}
