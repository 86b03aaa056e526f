"""Operators on texts against their plain versions, on messy and on empty input."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwatch.llm import jaccard_join, language_id, line_dedup, substring_dedup, suffix_dedup
from turnwatch.llm.bwt import repeated_places
from turnwatch.llm.components import components
from turnwatch.llm.hashing import Words
from turnwatch.llm.repeats import sliding


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_words_match_plain_split(texts):
    w = Words([t for _, t in texts])
    for i, (_, t) in enumerate(texts):
        mine = [bytes(w.buf[s:e]) for s, e in zip(w.start[w.first[i]:w.first[i + 1]], w.end[w.first[i]:w.first[i + 1]])]
        assert mine == brute.words(t)


def test_sliding():
    x = np.random.default_rng(0).integers(0, 99, 50)
    for width in (1, 2, 3, 7, 50):
        assert sliding(x, width).tolist() == [min(x[i:i + width]) for i in range(51 - width)]
    assert len(sliding(x, 51)) == 0


def test_merged_transforms_find_every_repeat():
    rng = random.Random(1)
    for trial in range(150):
        size, step = rng.choice([(4, 2), (6, 3), (4, 1), (8, 4), (4, 4)])
        texts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcd") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
        if trial % 7 == 0:
            texts.append(b"a" * 60)
        seen = Counter(t[p:p + size] for t in texts for p in range(len(t) - size + 1))
        want = [p + size <= len(t) and seen[t[p:p + size]] > 1 for t in texts for p in range(len(t))]
        for shard in (10, 40, 1000):
            assert repeated_places(texts, size, step, shard).tolist() == want


@pytest.mark.parametrize("size, gram, step", [(200, 128, 25), (40, 10, 8), (40, 40, 40)])
def test_suffix_dedup(messy, size, gram, step):
    got = suffix_dedup.suffix_dedup(messy, size=size, gram=gram, step=step, parts=5).collect()
    given = rows(messy)
    want = [(i, *w) for (i, _), w in zip(given, brute.suffix_dedup([t for _, t in given], size))]
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == Counter(want)


def test_suffix_dedup_refuses_uneven_steps(messy):
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(messy, size=200, step=7)


@pytest.mark.parametrize("size, seed", [(20, 10), (20, 5), (8, 8), (8, 1)])
def test_substring_dedup(messy, size, seed):
    got = substring_dedup.substring_dedup(messy, size=size, seed=seed, parts=5).collect()
    assert Counter(map(tuple, got)) == Counter(brute.substring_dedup(rows(messy), size))


def test_substring_dedup_of_one_text_under_one_id_twice(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d x y"), (0, "a b c d")], "doc_id long, text string")
    got = substring_dedup.substring_dedup(docs, size=4, seed=2, parts=3).collect()
    assert Counter(map(tuple, got)) == Counter(brute.substring_dedup(rows(docs), 4))


@pytest.mark.parametrize("block, rounds", [(2048, 2), (8, 1)])
def test_jaccard_components(messy, block, rounds):
    got = jaccard_join.jaccard_components(messy, parts=5, block=block, rounds=rounds).collect()
    given = rows(messy)
    want, _ = brute.jaccard([r for r in given if r[0] is not None], 4, 85)
    want += [(None, len(brute.shingles(t, 4)), None) for i, t in given if i is None]
    assert Counter(map(tuple, got)) == Counter(want)


def test_jaccard_links(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {tuple(r) for r in jaccard_join.Join(docs, parts=5, block=8).links().collect()}
    _, pairs = brute.jaccard(texts, 4, 85)
    sets = [brute.shingles(t, 4) for _, t in texts]
    first = {frozenset(s): min(i for (i, _), x in zip(texts, sets) if x == s) for s in sets}
    named = ({first[frozenset(sets[a])], first[frozenset(sets[b])]} for a, b in pairs if sets[a] != sets[b])
    assert got == {(min(p), max(p)) for p in named}


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    df = spark.createDataFrame(chain + star + [(7, 7), (9, 8), (8, 9)], "u long, v long")
    got = {r["doc"]: r["component"] for r in components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 560)}, 8: 8, 9: 8}


def test_line_dedup(messy):
    with_id = messy.filter("doc_id IS NOT NULL")
    got = line_dedup.line_dedup(messy)
    assert got.columns == messy.columns + ["n_lines", "n_removed"]
    found = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect())
    want = Counter(brute.line_dedup(rows(with_id)))
    assert Counter({k: v for k, v in found.items() if k[0] is not None}) == want
    assert sorted(k[2:] for k in found if k[0] is None) == [(0, 0), (1, 0)]


def test_empty_tables(nothing):
    assert suffix_dedup.suffix_dedup(nothing, parts=3).count() == 0
    assert substring_dedup.substring_dedup(nothing, parts=3).count() == 0
    assert jaccard_join.jaccard_components(nothing, parts=3).count() == 0
    assert line_dedup.line_dedup(nothing).count() == 0
    assert language_id.predict(nothing, language_id.fit(nothing)).count() == 0


def test_language_of_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = language_id.predict(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right >= 0.95


def test_language_of_odd_texts(spark, messy):
    model = language_id.Model(["en", "de"])
    model.learn(0, ["en", "de"], ["house", "haus"], [9, 9]).learn(2, ["de", "en"], ["ha", "ho"], [5, 5]).learn(1, ["en"], ["a"], [1])
    scorer = language_id.Scorer(model)
    assert scorer.predict("Haus") [0] == "de" and scorer.predict("HOUSE, house!")[0] == "en"
    assert scorer.predict("hotel")[0] == "en"           # by its letters
    assert scorer.predict("щ") == ("de", 0.5)           # a letter that says nothing: first by name
    for text in (None, "", "123 _ ²", "\n"):
        assert scorer.predict(text) == ("und", 0.0)
    assert language_id.words_of("a²b c_d e1f") == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1}
    few = language_id.Scorer(model, keep=1)             # rows that were dropped come back the same
    assert [few.predict(t) for t in ("haus haus", "house hotel", "haus haus")] == [
        scorer.predict(t) for t in ("haus haus", "house hotel", "haus haus")]
    out = language_id.predict(messy, model)
    assert out.count() == messy.count() and out.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert out.filter("doc_id IS NULL AND NOT held_out").count() == 0


def test_language_learns_from_a_bounded_sample(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.fit(docs, fit_rows=40, max_words=50, max_grams=30)
    assert len(model.tables[0][0]) <= 50 and all(len(model.tables[n][0]) <= 30 for n in language_id.LENGTHS)
