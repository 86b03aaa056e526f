"""Repeated query ids, stages with clashing columns, parts by bytes, raking in one place."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnwatch.llm import jaccard_join, mixing, rows, substring_dedup, topk_search, vptree

EVEN = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
ODD = EVEN.translate(str.maketrans("ab", "ba"))


def test_words_that_a_polynomial_hash_cannot_tell_apart(spark):
    docs = [(1, EVEN), (2, ODD), (3, "w " * 19 + EVEN), (4, "v " * 19 + ODD), (5, "w " * 19 + ODD)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(table).collect()}
    assert got == {r[0]: r[2] for r in brute.jaccard(docs, 4, 85)[0]}
    cut = sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.substring_dedup(table).collect())
    assert cut == [(r[0], r[2]) for r in brute.substring_dedup(docs, 20)]


@pytest.mark.parametrize("method", ["topk", "nearest"])
def test_queries_of_one_id_have_answers_of_their_own(spark, method):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.random(4).tolist()) for i in range(30)]
    items = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (0, [0.0, 0.0, 0.0, 1.0])], items.schema)
    if method == "topk":
        run = lambda q: topk_search.topk_search(topk_search.quantised(q, "vec_id", "embedding"),
                                                topk_search.quantised(items, "vec_id", "embedding"), 3, item_block=7)
    else:
        run = lambda q: vptree.nearest(vptree.usable(q, "vec_id", "embedding"),
                                       vptree.usable(items, "vec_id", "embedding"), 3, factor=1.0, shard=7)
    apart = [tuple(r) for v in queries.collect() for r in run(spark.createDataFrame([v], items.schema)).collect()]
    assert sorted(tuple(r) for r in run(queries).collect()) == sorted(apart) and len(apart) == 6


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_with_clashing_columns(spark, small, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    messy = docs.select("doc_id", F.lit("x").alias("lang_pred"), "text", *[F.lit(i).alias(c) for i, c in enumerate(
        ("score", "n_removed", "n_lines", "sampled", "tokens", "probability", "found", "part"))], "lang", "source", "n_chars")
    plain, out = stage(spark, docs, small), stage(spark, messy, small)
    key = plain.columns
    if name != "bpe":
        assert out.columns == messy.columns and out.filter("lang_pred = 'x' AND sampled = 3").count() == out.count()
    assert sorted(map(str, out.select(*key).collect())) == sorted(map(str, plain.collect()))


def test_parts_follow_the_bytes(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    least = rows.parts_of(docs)
    more = docs.withColumn("n", F.explode(F.array([F.lit(i) for i in range(10)])))
    assert rows.parts_of(docs, part_bytes=100) > least and rows.parts_of(docs.limit(0)) == least
    assert rows.parts_of(more, part_bytes=100) >= 9.9 * rows.parts_of(docs, part_bytes=100)


@pytest.mark.parametrize("bounded", [False, True])
def test_raking_in_one_place_equals_raking_in_spark(spark, bounded, monkeypatch):
    rows_ = [(f"s{i % 5}", f"l{i * i % 4}", float(10 + i * 7 % 90)) for i in range(60)]
    cells = spark.createDataFrame(rows_, "source string, lang string, tokens double").groupBy("source", "lang").agg(F.sum("tokens").alias("tokens"))
    targets = {"source": 0.5, "lang": {"l0": 0.5, "l1": 0.5}}
    here = mixing.fit_small_bounded(cells.toPandas(), targets, 0.4) if bounded else mixing.fit_small(cells.toPandas(), targets, 0.4)
    there = (mixing.rake_bounded(cells, targets, 0.4, max_values=0)[0] if bounded else mixing.calibrate(mixing.rake(cells, targets), 0.4)).toPandas()
    both = here.merge(there, on=["source", "lang"])
    assert len(both) == len(here) and np.allclose(both["probability_x"], both["probability_y"], atol=1e-4 if bounded else 1e-9)
    if bounded:
        kept = here.assign(k=here.tokens * here.probability).groupby("source").k.sum()
        goal = here.groupby("source").tokens.sum() ** 0.5
        assert np.allclose(kept / kept.sum(), goal / goal.sum(), atol=1e-4)
