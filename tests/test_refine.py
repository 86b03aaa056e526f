"""Refinement with its parameters in a table against the plain computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_refine as P
from turnwatch.operators import curate as C

ANCHOR = "anchor_id long, is_positive boolean, embedding array<double>"


def data(seed=3, n=60, width=4, count=16):
    rng = np.random.default_rng(seed)
    anchors = rng.normal(size=(count, width))
    labels = (np.arange(count) < count // 2).astype(float)
    centre = np.ones(width) * (np.arange(width) < 2)
    y = np.arange(n) % 2
    q = np.where(y[:, None] == 1, 1, -1) * centre + rng.normal(scale=.8, size=(n, width))
    return anchors, labels, q, y


def frames(spark, anchors, labels, q, y):
    a = spark.createDataFrame([(i, bool(p), v.tolist()) for i, (p, v) in enumerate(zip(labels, anchors))], ANCHOR)
    x = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(q, y))], "id long, vec array<double>, label int")
    return a.repartition(3), x.repartition(4)


@pytest.mark.parametrize("limits", [{}, {"broadcast_values": 0, "block_rows": 11}])
def test_same_result_as_in_one_place(spark, limits):
    anchors, labels, q, y = data()
    a, x = frames(spark, anchors, labels, q, y)
    fold = {r["id"]: r["fold"] for r in C.stratified_folds(x, 3, 42).collect()}
    want, epochs = P.refine(anchors, labels, q, y, [fold[i] for i in range(len(q))], 4, 3, 0.05, 0.01, 0.3, 6, 0.85, 2,
                            C._pull_back)
    got = C.anchor_refine(a, x, epochs=4, folds=3, rate=0.05, temperature=0.3, k=6, patience=2, **limits).collect()
    assert {r["epochs"] for r in got} == {epochs} and len(got) == len(anchors)
    for r in got:
        assert np.allclose(r["embedding"], want[r["anchor_id"]], atol=1e-6) and r["is_positive"] == (labels[r["anchor_id"]] == 1)


def test_sums_of_each_run(spark, monkeypatch):
    """Small parts inside a task, three runs at once: gradients and counts of every run."""
    monkeypatch.setattr(C, "CELLS", 64)
    anchors, labels, q, y = data(seed=8)
    a, x = frames(spark, anchors, labels, q, y)
    x = x.select(F.col("id").alias("key"), "vec", "label", (F.col("id") % 3).cast("int").alias("fold"))
    state = a.select(F.explode(F.array(*[F.lit(r) for r in (-1, 0, 2)])).alias("run"), F.col("anchor_id").alias("key"),
                     "is_positive", F.col("anchor_id").alias("idx"), "embedding")
    sums = C.soft_vote_sums(x, state, 5, 0.2).cache()
    grads = {(r["run"], r["key"]): np.array(r["gradient"]) for r in C.loss_gradient(state, sums).collect()}
    tally = {r["run"]: r["v"] for r in sums.filter("key = -1").collect()}
    for run in (-1, 0, 2):
        grad, counts = P.one_pass(q, y, np.arange(len(q)) % 3, anchors, labels, run, 5, 0.2)
        assert np.allclose([grads[run, i] for i in range(len(anchors))], grad, atol=1e-5)
        assert np.allclose(tally[run], counts, atol=1e-5)


def test_odd_rows(spark):
    """Repeated anchor ids stay apart, examples without vector or label take no part, empty tables are allowed."""
    anchors, labels, q, y = data(seed=5, n=20, count=6)
    a, x = frames(spark, anchors, labels, q, y)
    doubled = a.withColumn("anchor_id", F.col("anchor_id") % 3)
    odd = x.unionByName(spark.createDataFrame([(90, None, 1), (91, [1.0] * 4, None)], x.schema))
    opts = dict(epochs=2, folds=2, rate=0.05, temperature=0.3, k=4)
    got = C.anchor_refine(doubled, odd, **opts).collect()
    plain = C.anchor_refine(a, x, **opts).collect()
    assert len(got) == len(plain) == 6
    assert sorted(r["anchor_id"] for r in got) == [0, 0, 1, 1, 2, 2]
    still = {r["anchor_id"]: r["embedding"] for r in C.anchor_refine(a, x.limit(0), **opts).collect()}
    assert all(np.allclose(still[i], anchors[i]) for i in range(6))
    assert C.anchor_refine(a.limit(0), x, **opts).count() == 0


def test_equal_starts_are_searched_once(spark, monkeypatch):
    """All runs start from the same anchors, so the first look searches one copy of them; later ones only the runs that train."""
    anchors, labels, q, y = data(seed=9, n=30, count=8)
    a, x = frames(spark, anchors, labels, q, y)
    seen, plain = [], C.search
    monkeypatch.setattr(C, "search", lambda messages, library, *args, **kw: (
        seen.append(library.select("prop").distinct().count()), plain(messages, library, *args, **kw))[1])
    C.anchor_refine(a, x, epochs=2, folds=3, rate=0.05, temperature=0.3, k=4)
    assert seen[0] == 1 and seen[1:3] == [3, 3] and set(seen[3:]) <= {1} and len(seen) <= 4
