"""Curation: small-group and large-group ways against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain_refine import one_pass
from turnwatch.operators import curate as C
from turnwatch.plans.similarity import SCALE, units

ROWS = 120


@pytest.fixture(scope="module")
def pool(spark):
    rng = np.random.default_rng(11)
    vec = rng.normal(size=(ROWS, 4)).round(2)
    vec[::3] = vec[0]                      # a third of all rows are copies of one vector
    vec[5] = 0.0
    rows = [(i, i, "ab"[i % 5 == 0], vec[i].tolist()) for i in range(ROWS)]
    return vec, spark.createDataFrame(rows, "id long, pos long, g string, vec array<double>").repartition(4)


def sims_of(vec):
    u = units(vec.copy())
    return np.rint(u @ u.T * SCALE) / SCALE


def groups():
    return {"a": [i for i in range(ROWS) if i % 5], "b": [i for i in range(ROWS) if i % 5 == 0]}


@pytest.mark.parametrize("block", [4096, 13])
@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_dedup_and_leaders(pool, threshold, block):
    vec, items = pool
    s = sims_of(vec)
    keep, lead = set(), {}
    for members in groups().values():
        kept, seeds = [], []
        for i in members:
            if not any(s[i, j] > threshold for j in kept):
                kept.append(i)
            first = next((j for j in seeds if s[i, j] >= threshold), None)
            if first is None:
                seeds.append(i)
            lead[i] = i if first is None else first
        keep |= set(kept)
    got = C.greedy_dedup(items, ["g"], threshold, block_rows=block).collect()
    assert sorted(r.id for r in got) == sorted(keep)
    got = C.leader_clusters(items, ["g"], threshold, block_rows=block).collect()
    assert {r.id: r.leader for r in got} == lead and len(got) == ROWS
    dropped = C.drop_if_earlier_similar(items, ["g"], threshold, block_rows=block).collect()
    want = [i for m in groups().values() for i in m if not any(s[i, j] > threshold for j in m if j < i)]
    assert sorted(r.id for r in dropped) == sorted(want)


def plain_mmr(members, rel, s, quota, base, cluster, cap):
    if len(members) <= quota:
        return list(members)
    left, picked, used = list(members), [], {}
    for step in range(quota):
        if not picked:
            at = max(left, key=lambda i: rel[i])
        else:
            lam = base if quota <= 2 else min(.8, base + .3) + (max(.2, base - .3) - min(.8, base + .3)) * (step - 1) / (quota - 2)
            open_ = [i for i in left if cap is None or used.get(cluster[i], 0) < cap]
            at = max(open_, key=lambda i: lam * rel[i] - (1 - lam) * max(s[i, j] for j in picked)) if open_ else left[0]
        picked.append(at)
        left.remove(at)
        used[cluster[at]] = used.get(cluster[at], 0) + 1
    return picked


@pytest.mark.parametrize("task_rows", [4096, 10])
@pytest.mark.parametrize("cap", [None, 2])
def test_diverse_picks(pool, cap, task_rows):
    vec, items = pool
    s = sims_of(vec)
    target = np.array([1.0, 0.2, 0.0, 0.4])
    rel = np.round(units(vec.copy()) @ (target / np.linalg.norm(target)), 9)
    cluster = {i: i % 3 for i in range(ROWS)}
    rows = items.withColumn("cluster", F.col("id") % 3).withColumn("quota", F.when(F.col("g") == "a", 8).otherwise(5)) \
        .withColumn("relevance", C.cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in target])))
    got = C.diverse_picks(rows, ["g"], cap=cap, task_rows=task_rows).collect()
    for g, members in groups().items():
        mine = [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r.pick)]
        assert mine == plain_mmr(members, rel, s, 8 if g == "a" else 5, 0.5, cluster, cap)


def test_quotas(spark):
    sizes = {"a": 2, "b": 10, "c": 30, "d": 10}
    rows = [("p", c, i) for i, c in enumerate(c for c, n in sizes.items() for _ in range(n))]
    got = C.balanced_quotas(spark.createDataFrame(rows, "prop string, category string, pos long"), 22).collect()
    # base 5: a is whole (2), 20 left over three: 6 each, the two largest get one more
    assert {r.category: r.quota for r in got} == {"a": 2, "b": 7, "c": 7, "d": 6}


def test_percentile_of_margins_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(loc=i % 2, size=3).tolist(), i % 2) for i in range(203)]
    items = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    every = {r.id: r.margin for r in C.low_margin(items, share=1.0).collect()}
    assert len(every) == 203
    cut = np.percentile(list(every.values()), 25)
    want = sorted(i for i, m in every.items() if m <= cut)
    for segment in (1_000_000, 20):
        assert sorted(r.id for r in C.low_margin(items, segment_rows=segment).collect()) == want
    assert C.low_margin(items.filter("id < 12")).count() == 0


def test_classes_are_balanced_whatever_the_layout(spark):
    items = spark.range(300).selectExpr("id as idx", "if(id % 3 = 0, 1, 0) as label")
    a = sorted(r.idx for r in C.balance_classes(items).collect())
    b = sorted(r.idx for r in C.balance_classes(items, segment_rows=30).collect())
    assert a == b and len(a) == 200


def test_folds_are_stratified(spark):
    items = spark.range(103).selectExpr("id", "if(id % 4 = 0, 1, 0) as label")
    sizes = C.stratified_folds(items, 5).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        n = [r["count"] for r in sizes if r.label == label]
        assert len(n) == 5 and max(n) - min(n) <= 1


def test_refinement_fits_and_stays_in_its_cone(spark):
    rng = np.random.default_rng(2)
    anchors = spark.createDataFrame(
        [(i, i < 8, rng.normal(size=4).tolist()) for i in range(16)],
        "anchor_id long, is_positive boolean, embedding array<double>")
    centre = np.array([1.0, 1.0, 0.0, 0.0])
    examples = spark.createDataFrame(
        [(i, ((1 if i % 2 else -1) * centre + rng.normal(scale=.6, size=4)).tolist(), i % 2) for i in range(60)],
        "id long, vec array<double>, label int")
    seen = sorted(examples.collect())
    old = {r.anchor_id: np.array(r.embedding) for r in anchors.collect()}
    out = C.anchor_refine(anchors, examples, epochs=6, folds=3, rate=0.05, k=8, min_similarity=0.85).collect()
    new = {r.anchor_id: np.array(r.embedding) for r in out}
    order = sorted(old)
    labels = np.array([float(i < 8) for i in order])
    cos = [new[i] @ old[i] / np.linalg.norm(new[i]) / np.linalg.norm(old[i]) for i in order]
    assert min(cos) >= 0.85 - 1e-6

    def loss(table):
        _, tally = one_pass(np.array([r.vec for r in seen]), [r.label for r in seen], [0] * len(seen),
                            np.stack([table[i] for i in order]), labels, -1, 8, 0.05)
        return tally[2] / tally[0]
    assert loss(new) < loss(old)


def test_gradient_matches_differences(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(6, 3))
    examples = spark.createDataFrame([(i, rng.normal(size=3).tolist(), i % 2, 0) for i in range(12)],
                                     "key long, vec array<double>, label int, fold int")

    def sums(x):
        rows = spark.createDataFrame([(-1, i, i < 3, i, v.tolist()) for i, v in enumerate(x)],
                                     "run int, key long, is_positive boolean, idx long, embedding array<double>")
        return rows, C.soft_vote_sums(examples, rows, 6, 0.5)
    grads = {r["key"]: r["gradient"] for r in C.loss_gradient(*sums(a)).collect()}
    for i, j in [(0, 0), (3, 2)]:
        up, down = a.copy(), a.copy()
        up[i, j] += 1e-4
        down[i, j] -= 1e-4
        lo = [sums(x)[1].filter("key = -1").first()["v"][2] for x in (down, up)]
        assert abs((lo[1] - lo[0]) / 2e-4 - grads[i][j]) < 1e-4


def test_few_shot_sample_takes_leaders_first(spark):
    items = spark.range(40).withColumn("vec", F.array(F.lit(1.0)))
    clusters = spark.createDataFrame([(i, i // 10 * 10, 10 if i < 30 else 1) for i in range(40)], "id long, leader long, cluster_size long")
    got = C.few_shot_sample(items, clusters, n=8).collect()
    assert {r["id"] for r in got if r["is_leader"]} == {0, 10, 20}
    assert len(got) == len({r["id"] for r in got}) == 8
    assert sorted(got) == sorted(C.few_shot_sample(items, clusters, n=8).collect())
    assert sorted(r["id"] for r in C.few_shot_sample(items, clusters, n=8, seed=1).collect()) != sorted(r["id"] for r in got)
    whole = C.few_shot_sample(items, clusters, n=40).collect()
    assert len(whole) == 40 and not any(r["is_leader"] for r in whole)


def test_cluster_capped_selection(spark, pool):
    vec, df = pool
    items = df.withColumn("category", F.col("g"))
    picks = C.mmr_cluster(items, vec[1].tolist(), 12, cap=2).collect()
    assert sorted(r["pick"] for r in picks) == list(range(12)) and len({r["id"] for r in picks}) == 12
    small = C.mmr_cluster(items.filter("id < 5"), vec[1].tolist(), 12).collect()
    assert sorted((r["id"], r["pick"]) for r in small) == [(i, i) for i in range(5)]


def test_both_ways_use_one_unit_length(spark):
    """Short vectors that point the same way are as similar in the large-group way as in a task."""
    tiny = [5e-4, 0.0]
    rows = [(i, i, 0, tiny if i < 3 else [0.0, 1.0 + i], 1.0 - i / 10, 3, 0) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, pos long, g int, vec array<double>, relevance double, quota int, cluster int")
    one, many = (sorted(map(tuple, C.diverse_picks(df, ["g"], task_rows=n).collect())) for n in (1000, 1))
    assert one == many


def plain_kmeans(ids, v, k, rounds):
    seeds = [min(ids)]
    while len(seeds) < k:
        near = {i: min(round(sum((a - b) ** 2 for a, b in zip(v[i], v[j])), 9) for j in seeds) for i in ids}
        far = max(ids, key=lambda i: (near[i], -i))
        if near[far] == 0:
            break
        seeds.append(far)
    centres = [np.array(v[i], float) for i in seeds]
    for step in range(rounds + 1):
        own = {i: min(range(len(centres)), key=lambda c: (round(float(((v[i] - centres[c]) ** 2).sum()), 9), c)) for i in ids}
        if step < rounds:
            centres = [np.mean([v[i] for i in ids if own[i] == c], axis=0) if c in own.values() else old
                       for c, old in enumerate(centres)]
    return own


def test_kmeans_steps_of_large_groups(pool, monkeypatch):
    """Many steps of large groups take one job each; joined centres, for groups beyond counting, give the same."""
    vec, items = pool
    rows = items.withColumn("k", F.when(F.col("g") == "a", 4).otherwise(3))
    want = {}
    for g, k in (("a", 4), ("b", 3)):
        want |= plain_kmeans(groups()[g], vec, k, 6)
    steps = []
    shared = C._adder
    monkeypatch.setattr(C, "_adder", lambda now: steps.append(len(now)) or shared(now))
    for values in (C.CENTRE_VALUES, 0):
        monkeypatch.setattr(C, "CENTRE_VALUES", values)
        got = C.grouped_kmeans(rows, ["g"], 6, 5).collect()
        assert {r["id"]: r["cluster"] for r in got} == want
    assert 1 <= len(steps) <= 6 and set(steps) == {2}


@pytest.mark.parametrize("task_rows", [4096, 5])
def test_grouped_kmeans(pool, task_rows):
    """Two groups with their own k, a third of the rows copies of one vector, a row without a vector."""
    vec, items = pool
    want = {}
    for g, k in (("a", 4), ("b", 3)):
        want |= plain_kmeans(groups()[g], vec, k, 3)
    rows = items.withColumn("k", F.when(F.col("g") == "a", 4).otherwise(3))
    empty = rows.limit(1).withColumns({"id": F.lit(999).cast("long"), "vec": F.lit(None).cast("array<double>")})
    got = C.grouped_kmeans(rows.unionByName(empty), ["g"], 3, task_rows).collect()
    assert {r["id"]: r["cluster"] for r in got} == want and len(got) == ROWS
    copies = rows.filter("id % 3 = 0 and id < 40")  # one vector only
    assert {r["cluster"] for r in C.grouped_kmeans(copies, ["g"], 3, task_rows).collect()} == {0}
    assert C.grouped_kmeans(rows.limit(0), ["g"], 3, task_rows).count() == 0


def test_selection_for_many_propositions(spark, pool):
    """The large-group way picks what tasks pick, and caps hold for each proposition's clusters."""
    vec, items = pool
    rows = items.select(F.col("g").alias("prop"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("category"), "id", "pos", "vec")
    props = spark.createDataFrame([("a", vec[1].tolist()), ("b", vec[2].tolist())], "prop string, prop_vec array<double>")
    one, many = (sorted(map(tuple, C.mmr_clusters(rows, props, 8, cap=2, rounds=2, task_rows=n).collect())) for n in (4096, 5))
    assert one == many and len(one) == 16
    shaped = C.grouped_kmeans(rows.withColumn("k", F.lit(4)), ["prop"], 2).select("prop", "id", "cluster").collect()
    cluster = {r["id"]: r["cluster"] for r in shaped}
    for p in "ab":
        used = [cluster[i] for q, i, _ in one if q == p]
        sizes = [cluster[i] for i in groups()[p]]
        room = sum(min(2, sizes.count(c)) for c in set(sizes))  # picks that the caps allow
        assert sum(max(0, used.count(c) - 2) for c in set(used)) == max(0, 8 - room)


def test_weak_zones_of_two_blobs(spark):
    """Two far apart blobs of low-margin items; one holds negatives only, the other more positives."""
    blobs = [(i, int(i >= 6 and i != 11), [float(i % 3), 0.0] if i < 6 else [50.0 + i % 2, 50.0], 0.1) for i in range(12)]
    low = spark.createDataFrame(blobs, "id long, label int, vec array<float>, margin double")
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(12)], "id long, text string")
    got = sorted((r["size"], r["n_pos"], r["n_neg"], r["add"], tuple(r["texts"])) for r in C.weak_zones(low, texts, 3).collect())
    assert got == [(6, 0, 3, "positive", ("t0", "t1", "t2")), (6, 3, 0, "negative", ("t6", "t7", "t8"))]
    assert C.weak_zones(low.limit(0), texts).count() == 0


@pytest.mark.parametrize("inclusive", [True, False])
def test_least_hit_is_where_rounding_hits(inclusive):
    hit = np.greater_equal if inclusive else np.greater
    for threshold in (0.995, 0.6, 0.0, -0.25):
        least = C._least_hit(threshold, inclusive)
        assert hit(np.rint(least * SCALE) / SCALE, threshold)
        assert not hit(np.rint(np.nextafter(least, -3) * SCALE) / SCALE, threshold)


def test_large_groups_meet_seeds_only(spark, monkeypatch):
    """No round compares all pairs of a large group, and vectors that share an id are told apart as in a small one."""
    rng = np.random.default_rng(4)
    vec = rng.normal(size=(60, 3)).round(2)
    items = spark.createDataFrame([(i // 2, i // 2, "a", v.tolist()) for i, v in enumerate(vec)], "id long, pos long, g string, vec array<double>")
    want = sorted((r.id, r.leader) for r in C.leader_clusters(items.repartition(1), ["g"], 0.8).collect())
    monkeypatch.setattr(C, "compare", None)
    got = C.leader_clusters(items, ["g"], 0.8, block_rows=16).collect()
    assert len(got) == len(want) and {r.id for r in got} == {i for i, _ in want}
    u = units(vec.copy())
    seeds = {r.leader for r in got}
    assert all(max(u[2 * r.id + j] @ u[2 * r.leader + i] for i in (0, 1) for j in (0, 1)) >= 0.8 - 1e-9 for r in got)
    assert {r.id for r in C.greedy_dedup(items, ["g"], 0.8, inclusive=True, block_rows=16).collect()} == seeds


def test_rounds_keep_the_size_of_their_plan(spark, monkeypatch):
    """Every round joins what the last one left; the size that the optimizer sees must not grow with the rounds."""
    items = spark.range(300).select(F.lit(1).alias("g"), "id", F.col("id").alias("pos"), F.transform(
        F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.col("id") * i * 1.7).cast("float")).alias("vec"))
    sizes, plain = [], C._next_turns
    monkeypatch.setattr(C, "_next_turns", lambda open_, *args: (
        sizes.append(open_._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()), plain(open_, *args))[1])
    assert C.greedy_dedup(items, ["g"], 0.9999, block_rows=48).count() > 100
    assert len(sizes) >= 4 and max(sizes) < 64
