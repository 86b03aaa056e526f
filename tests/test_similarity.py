"""Search: both ways against brute force, ties included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwatch.functions.vectors import cosine
from turnwatch.operators import evaluate as E
from turnwatch.operators import grounding as G
from turnwatch.plans import similarity as S
from turnwatch.plans.similarity import nearest, search, view_scores


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    anchors = rng.normal(size=(90, 6)).round(2)
    anchors[10:25] = anchors[3]          # a run of equal vectors
    anchors[40] = 0.0
    queries = rng.normal(size=(50, 2, 6)).round(2)
    queries[7, 0] = anchors[3]
    lib = [("xy"[i % 2], bool(i % 3), i, i, anchors[i].tolist()) for i in range(90)]
    library = spark.createDataFrame(lib, "prop string, is_positive boolean, idx long, anchor_id long, embedding array<double>")
    messages = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)],
                                     "msg_id long, views array<array<double>>")
    return anchors, queries, lib, library, messages


def unit(x):
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def brute(anchors, queries, lib, k, floor, skip):
    out = {}
    for q, views in enumerate(queries):
        for prop in "xy":
            pool = []
            for (p, pos, idx, aid, _) in lib:
                if p == prop and not (skip and aid == q):
                    s = max(round(float(unit(v) @ unit(anchors[aid])), 9) for v in views)
                    pool.append((-(max(s, 0.0) if floor else s), not pos, idx))
            pool.sort()
            out[q, prop] = [i for _, _, i in pool[:k]]
    return out


@pytest.mark.parametrize("floor,skip", [(True, False), (False, True), (True, True)])
def test_search_matches_brute_force(spark, data, floor, skip):
    anchors, queries, lib, library, messages = data
    want = brute(anchors, queries, lib, 12, floor, skip)
    for kw in ({}, {"broadcast_values": 10, "block_rows": 17}):
        got = search(messages, library, 12, floor, skip, **kw).collect()
        assert {(r.msg_id, r.prop): r.top_id for r in got} == want


def test_own_proposition_only(spark, data):
    _, _, _, library, messages = data
    own = messages.withColumn("prop", F.when(F.col("msg_id") < 20, "x").otherwise("y"))
    full = {(r.msg_id, r.prop): r.top_id for r in search(messages, library, 5).collect()}
    for kw in ({}, {"broadcast_values": 10, "block_rows": 17}):
        got = search(own, library, 5, **kw).collect()
        assert len(got) == 50
        assert all(full[r.msg_id, r.prop] == r.top_id for r in got)


def test_nearest_and_view_scores_agree(spark, data):
    _, _, _, library, messages = data
    refs = library.select(F.col("anchor_id").alias("id"), "embedding")
    a = {r.msg_id: r.view_max for r in view_scores(messages, refs).collect()}
    b = {r.msg_id: r.view_max for r in view_scores(messages, refs, broadcast_values=10).collect()}
    assert a == b
    flat = messages.select(F.col("msg_id").alias("id"), F.col("views")[0].alias("embedding"))
    for r in nearest(flat, refs).collect():
        assert r.top_sim[0] == a[r.id][0]


def test_column_cosine_equals_matrix_cosine(spark, data):
    _, _, _, library, messages = data
    refs = library.select(F.col("anchor_id").alias("id"), "embedding")
    flat = messages.select(F.col("msg_id").alias("id"), F.col("views")[0].alias("embedding"))
    best = nearest(flat, refs).select("id", F.col("top_sim")[0].alias("s"), F.col("top_id")[0].alias("a"))
    pairs = best.join(flat, "id").join(refs.select(F.col("id").alias("a"), F.col("embedding").alias("v")), "a")
    worst = pairs.select(F.max(F.abs(cosine(F.col("embedding"), F.col("v")) - F.col("s")))).first()[0]
    assert worst < 1e-6


def test_block_sizes_do_not_change_statistics(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i > 60], rng.normal(size=5).tolist(), i % 4 == 0) for i in range(100)]
    items = spark.createDataFrame(rows, "id long, g string, vec array<double>, is_pos boolean")
    one = E.neighbour_stats(items, ["g"], 0.5).orderBy("id").collect()
    many = E.neighbour_stats(items, ["g"], 0.5, block_rows=9).orderBy("id").collect()
    assert one == many
    h1, s1 = E.class_similarity_histogram(items)
    h2, s2 = E.class_similarity_histogram(items, block_rows=9)
    assert h1.orderBy("kind", "bin").collect() == h2.orderBy("kind", "bin").collect()
    assert np.allclose(list(s1.first()), list(s2.first()))
    vec = unit(np.array([r[2] for r in rows[:61]]))
    sims = vec @ vec.T
    np.fill_diagonal(sims, 0)
    got = E.mean_similarity(items, ["g"]).filter("g = 'a'").first()
    assert abs(got.mean_sim - sims.mean()) < 1e-9


def test_verdict_bounds(spark):
    df = spark.createDataFrame([(0.55,), (0.56,), (0.45,), (0.46,), (0.0,)], "s double")
    got = df.select(G.verdict(F.col("s")), G.verdict(F.col("s"), inclusive=True)).collect()
    assert [tuple(r) for r in got] == [("WARNING", "MATCH"), ("MATCH", "MATCH"), ("NO MATCH", "WARNING"),
                                      ("WARNING", "WARNING"), ("NO MATCH", "NO MATCH")]


@pytest.mark.parametrize("values", [10**9, 0])
def test_messages_without_views_and_ids_of_any_kind(spark, values):
    """An empty view list is an empty pool, and text ids pass through, in one block and in many."""
    library = spark.createDataFrame(
        [("p", True, 0, 1, [1.0, 0.0]), ("p", False, 1, 2, [0.0, 1.0])],
        "prop string, is_positive boolean, idx long, anchor_id long, embedding array<double>")
    messages = spark.createDataFrame(
        [("session-1", [[1.0, 0.0]]), ("none", []), ("session-2", [[0.0, 2.0], [3.0, 0.0]]), ("last", [])],
        "msg_id string, views array<array<double>>").coalesce(1)
    got = {r["msg_id"]: r for r in search(messages, library, 2, broadcast_values=values, block_rows=1).collect()}
    assert set(got) == {"session-1", "none", "session-2", "last"}
    assert got["none"]["pool"] == got["last"]["pool"] == 0 and not got["last"]["top_id"]
    assert list(got["session-1"]["top_id"]) == [1, 2] and got["session-2"]["best_view"] == 1
    views = view_scores(messages, library.select(F.col("anchor_id").alias("id"), "embedding"), broadcast_values=values)
    best = {r["msg_id"]: r["view_max"] for r in views.collect()}
    assert list(best["none"]) == [] and list(best["session-2"]) == [1.0, 1.0]


def test_thousands_of_small_propositions(spark):
    library = spark.range(12_000).select(
        F.col("id").cast("string").alias("prop"), (F.col("id") % 2 == 0).alias("is_positive"), F.lit(0).alias("idx"),
        F.col("id").alias("anchor_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    messages = spark.createDataFrame([(2**44, [[1.0, 0.0]]), (7, [[0.0, 1.0]])], "msg_id long, views array<array<double>>")
    many = search(messages, library, 1, broadcast_values=0, block_rows=4000)
    one = search(messages, library, 1)
    key = ["msg_id", "prop", "top_sim", "top_id", "pool"]
    assert many.count() == 24_000 and many.select(key).exceptAll(one.select(key)).count() == 0


def test_strips_give_what_whole_rows_of_similarities_give():
    rng = np.random.default_rng(3)
    for floor, skip, positives, views in ((True, True, 1500, 2), (False, True, 3000, 1), (True, False, 2, 3), (False, False, 0, 1)):
        n, m = 3000, 90
        vectors = rng.normal(size=(n, 8)).astype(np.float32)
        vectors[1000:1400] = vectors[:400]                       # exact ties
        ids = rng.integers(0, 60, n)
        anchors = S.Anchors(ids, np.arange(n) < positives, ids, np.arange(n), vectors)
        counts = np.where(np.arange(m) % 7 == 3, 0, views)       # some messages without a view
        rows = S.units(np.vstack([vectors[:20], rng.normal(size=(counts.sum() - 20, 8))]).astype(float))
        args = (np.arange(m), rows, np.cumsum(counts) - counts, anchors, 9, floor, skip)
        whole, strips = ([np.concatenate([np.asarray(part[i]) for part in way(*args)]) for i in range(2, 10)]
                         for way in (S._best_at_once, S._best_by_strips))
        for i, (a, b) in enumerate(zip(whole, strips)):
            if i < 2:
                a, b = np.where(whole[2], a, 0), np.where(strips[2], b, 0)
            assert np.array_equal(a, b, equal_nan=a.dtype.kind == "f"), i


def test_many_anchors_never_become_whole_rows(monkeypatch):
    monkeypatch.setattr(S, "_best_at_once", None)
    vectors = np.eye(4, dtype=np.float32)[np.arange(2000) % 4]
    anchors = S.Anchors(np.arange(2000), np.ones(2000, bool), np.arange(2000), np.arange(2000), vectors)
    found = list(S.best_k(np.array([7]), np.eye(4)[:1], np.array([0]), anchors, 3, True, False))
    assert [x.tolist() for x in (found[0][2][0], found[0][3][0])] == [[1.0, 1.0, 1.0], [0, 4, 8]]


def test_blocks_hold_whole_propositions():
    placed, blocks, together = S._homes([(p, n) for p, n in enumerate((40, 30, 50, 250, 20, 20))], 100)
    assert placed == [(0, 0, 1), (1, 0, 1), (2, 1, 1), (3, 2, 3), (4, 5, 1), (5, 5, 1)] and blocks == 6 and together == 2


def test_own_propositions_in_blocks_without_a_merge(spark):
    rng = np.random.default_rng(5)
    library = spark.createDataFrame([(i % 4, i % 3 > 0, i, i, rng.normal(size=6).tolist()) for i in range(200)],
                                    "prop int, is_positive boolean, idx long, anchor_id long, embedding array<float>")
    messages = spark.createDataFrame([(i, [rng.normal(size=6).tolist()], i % 5) for i in range(60)],
                                     "msg_id long, views array<array<float>>, prop int")
    for frame in (messages, messages.drop("prop")):
        plain = sorted(map(str, S.search(frame, library, 4, skip_same=True).collect()))
        for rows in (60, 20):  # whole propositions, and propositions over three blocks
            got = S.search(frame, library, 4, skip_same=True, broadcast_values=0, block_rows=rows).collect()
            assert sorted(map(str, got)) == plain


def test_block_pairs_fill_the_cores():
    """Few anchor blocks still make work for every core, and a pair stays bounded however many messages there are."""
    blocks = S._message_blocks(100_000, 100_000, 300_000, 64, 20, 187_500, 3, 1, 12)
    assert blocks * 3 >= 24
    for n in (600_000, 6_000_000):
        blocks = S._message_blocks(n, 2 * n, 2 * n, 64, 20, 187_500, 12 * n // 600_000, 1, 12)
        assert 2 * n * 2 * n / (blocks * (12 * n // 600_000)) <= S.PAIR_CELLS * 1.01
    assert S._message_blocks(40, 40, 40, 8, 3, 1000, 1, 1, 12) == 1


def test_own_anchors_in_a_strip():
    ids = np.array([5, 7, 5, 9, 2, 5])
    anchors = S.Anchors(ids, ids > 0, ids, ids, np.ones((6, 2)))
    rows, cols = S._own_anchors(np.array([5, 1, 9]), anchors, 1, 6)
    assert sorted(zip(rows.tolist(), cols.tolist())) == [(0, 1), (0, 4), (2, 2)]


def test_messages_of_one_partition_are_dealt_over_tasks(spark, monkeypatch):
    """A table in one row group is one task's work unless the search deals it; the rows stay the same."""
    rng = np.random.default_rng(8)
    library = spark.createDataFrame([(i % 2, i % 3 > 0, i, i, rng.normal(size=5).tolist()) for i in range(120)],
                                    "prop int, is_positive boolean, idx long, anchor_id long, embedding array<float>")
    messages = spark.createDataFrame([(i, [rng.normal(size=5).tolist()] * (i % 3)) for i in range(90)],
                                     "msg_id long, views array<array<float>>").coalesce(1)
    plain = S.search(messages, library, 4, skip_same=True)
    assert plain.rdd.getNumPartitions() == 1  # a small library is not worth it
    monkeypatch.setattr(S, "BLOCK_ROWS", 100)
    monkeypatch.setattr(S, "PAIR_CELLS", 1000)
    dealt = S.search(messages, library, 4, skip_same=True)
    assert dealt.rdd.getNumPartitions() == 11
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
    assert S.search(messages.limit(0), library, 4).count() == 0


def test_votes_work_out_each_list_of_voters_once(spark):
    """The lists of a message are columns; looking a voter up does not make them again."""
    entry = "array<struct<order_by:double,rank:int,sim:double,is_positive:boolean,anchor_id:long,voter_key:long>>"
    voters = spark.createDataFrame(
        [(1, "x", [0.9, 0.8], [True, False], [4, 5], [4, 5], [(-0.5, 1, 0.8, False, 5, 5), (-0.4, 0, 0.9, True, 4, 7)])],
        f"msg_id long, prop string, top_sim array<double>, top_pos array<boolean>, top_id array<long>, top_key array<long>, nli_top {entry}")
    for frame in (G.voter_overlap(voters), G.score_all_modes(voters), G.hybrid_vote(voters)):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(") == 4
    assert sorted(tuple(r)[2:] for r in G.voter_overlap(voters).collect()) == [
        (4, True, True, False, False), (5, False, True, True, True), (7, True, False, True, False)]


def ring(spark, n, props, seed=11, width=8):
    """Every vector is a positive of one proposition and a negative of the next."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, width)).astype(np.float32)
    vectors[n // 2:n // 2 + 200] = vectors[:200]  # exact ties
    rows = [((i + s) % props, s == 0, i, i, vectors[i].tolist()) for i in range(n) for s in (0, 1)]
    return vectors, spark.createDataFrame(rows, "prop int, is_positive boolean, idx long, anchor_id long, embedding array<float>")


def test_classes_with_the_same_anchors_are_compared_once(spark):
    """One product for both propositions that hold a set of anchors, and the lists of plain rows of similarities."""
    vectors, library = ring(spark, 4000, 4)
    table = S.by_proposition(library.withColumn("voter_key", F.col("anchor_id")).toArrow())
    parts = S.sections(list(table.values()))
    assert len(parts) == 4 and sorted(len(p.users) for p in parts) == [2, 2, 2, 2]
    m = 70
    for floor, views in ((True, 2), (False, 1), (True, 3)):
        counts = np.where(np.arange(m) % 9 == 4, 0, 1 + np.arange(m) % views)  # ragged, some without a view
        rows = S.units(np.vstack([vectors[:30], np.random.default_rng(2).normal(size=(counts.sum() - 30, 8))]).astype(float))
        args = np.arange(m), rows, np.cumsum(counts) - counts
        got = {}
        for prop, part in S.best_lists(*args, S.Library(table), 9, floor, True):
            got.setdefault(prop, []).append(part)
        for prop, anchors in table.items():
            whole, shared = ([np.concatenate([np.asarray(part[i]) for part in way]) for i in range(2, 10)]
                             for way in (list(S._best_at_once(*args, anchors, 9, floor, True)), got[prop]))
            for i, (a, b) in enumerate(zip(whole, shared)):
                if i < 2:
                    a, b = np.where(whole[2], a, 0), np.where(shared[2], b, 0)
                assert np.array_equal(a, b, equal_nan=a.dtype.kind == "f"), (prop, i)


def test_what_counts_as_zero_keeps_its_order_in_shared_classes(spark):
    """A positive that is met after the negatives still comes first where both count as zero."""
    rows = [((c + s) % 3, s == 0, 2000 * c + i, 2000 * c + i, [-1.0, float(i % 7 == 3)]) for c in range(3) for i in range(1500) for s in (0, 1)]
    library = spark.createDataFrame(rows, "prop int, is_positive boolean, idx long, anchor_id long, embedding array<float>")
    table = S.by_proposition(library.withColumn("voter_key", F.col("anchor_id")).toArrow())
    args = np.array([7, 8]), np.array([[1.0, 0.0], [0.0, 0.0]]), np.array([0, 1])
    for prop, found in S.best_lists(*args, S.Library(table), 5, True, False):
        plain = next(S._best_at_once(*args, table[prop], 5, True, False))
        assert np.array_equal(found[3], plain[3]) and np.array_equal(found[2], plain[2])


def test_propositions_that_share_anchors_come_in_one_block(spark):
    """They are told by sums over their anchors; the lists do not depend on it."""
    vectors, library = ring(spark, 3000, 6)
    sizes, classes = S._class_sizes(library, True)
    assert sizes == [(p, 1000) for p in range(6)] and all(len(c) == 2 for c in classes.values())
    placed, blocks, together = S._homes(sizes, 2000, classes)
    assert blocks == 2 and together == 3   # four classes of 500 hold three propositions
    assert S._homes(sizes, 2000)[1] == 3
    messages = spark.createDataFrame([(i, [v.tolist(), v[::-1].tolist()]) for i, v in enumerate(vectors[:40])],
                                     "msg_id long, views array<array<float>>")
    plain = sorted(map(str, S.search(messages, library, 6, skip_same=True).collect()))
    got = S.search(messages, library, 6, skip_same=True, broadcast_values=0, block_rows=2000).collect()
    assert sorted(map(str, got)) == plain


def test_adversarial_rank_searches_once(spark):
    """The ranking reads its rows several times; the search behind them runs once."""
    from turnwatch.operators import curate as C
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    kind = "msg_id long, prop int, top_pos array<boolean>, max_pos double, max_neg double"
    found = spark.createDataFrame([(i, i % 2, [True, i % 3 == 0], 0.5, 0.1) for i in range(50)], kind).mapInArrow(count, kind)
    ranks = C.adversarial_rank(found).collect()
    assert seen.value == 50 and sorted(r["rank"] for r in ranks) == sorted(2 * list(range(25)))
