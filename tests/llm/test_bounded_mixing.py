"""Raking under the bound that no cell gives more tokens than it has."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from turnwatch.llm import mixing
from turnwatch.llm.queries import mix_dims


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(f"s{a}", f"l{b}", f"t{c}", float((1 + a * 7 + b * 3) * (1 if c else 90))) for a in range(4) for b in range(3) for c in range(2)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")


TARGETS = {"source": 0.5, "lang": 0.5, "topic": 0.0}


def test_the_sample_meets_what_the_targets_allow(cells):
    total = cells.agg(F.sum("tokens")).first()[0]
    fitted, goals = mixing.rake_bounded(cells, TARGETS, 0.5)
    in_spark, _ = mixing.rake_bounded(cells, TARGETS, 0.5, tolerance=1e-3, max_values=0)
    for dim, goal in goals.items():
        want = {r[dim]: r["goal"] for r in goal.collect()}
        for found, off in ((fitted, 2e-5), (in_spark, 2e-3)):
            got = {r[0]: r[1] for r in found.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("probability"))).collect()}
            assert all(abs(got[k] - want[k]) <= off * total for k in want)
        assert abs(sum(want.values()) - 0.5 * total) < 1e-6 * total
    # The rare topic is kept whole; the other dimensions meet their targets all the same.
    have = fitted.filter("topic = 't1'").agg(F.sum("tokens")).first()[0]
    assert {r["topic"]: r["goal"] for r in goals["topic"].collect()}["t1"] == pytest.approx(have)
    shares = {(r[0], r[1]): r[2:] for r in mixing.expected_shares(fitted, TARGETS).collect()}
    assert all(abs(t - e) < 1e-4 for (dim, _), (t, e) in shares.items() if dim != "topic")
    assert shares["topic", "t1"][0] == pytest.approx(0.5) and shares["topic", "t1"][1] < 0.03
    capped = mixing.expected_shares(mixing.calibrate(mixing.rake(cells, TARGETS), 0.5), TARGETS).filter("dim != 'topic'")
    assert capped.agg(F.max(F.abs(F.col("target") - F.col("expected")))).first()[0] > 1e-3


def test_targets_that_fit_are_met(cells):
    fitted, _ = mixing.rake_bounded(cells, TARGETS, 0.01)
    assert mixing.expected_shares(fitted, TARGETS).filter("abs(target - expected) > 2e-3").count() == 0


def test_the_pipeline_samples_under_the_bound(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ids = sorted(r[0] for r in corpus_pipeline.mixture(spark, docs, small).select("doc_id").collect())
    cells = mixing.cell_table(docs, mix_dims(), mixing.word_count("text"))
    fitted, _ = mixing.rake_bounded(cells, corpus_pipeline.TARGETS, corpus_pipeline.KEEP)
    chance = {tuple(r)[:3]: r["probability"] for r in fitted.collect()}
    rows = docs.select("doc_id", *[mixing.category(c).alias(d) for d, c in mix_dims().items()], mixing.draw("doc_id", 0).alias("u")).collect()
    assert ids == sorted(r[0] for r in rows if r["u"] < chance.get(tuple(r)[1:4], 1.0))


def test_no_rows(spark, nothing):
    docs = nothing.withColumn("source", F.lit("a"))
    assert mixing.mix(docs, mix_dims(), TARGETS, mixing.word_count("text"), 0.5, bounded=True).count() == 0
