"""The registered queries of the operators, and the pipeline, on the smallest tables."""

import brute
import numpy as np
import oracle
import public_tokenizers
import pytest

import corpus_pipeline
from turnwatch.llm import bpe, language_id
from turnwatch.llm.queries import ORACLES, QUERIES


def by_id(df):
    rows = [tuple(r) for r in df.collect()]
    return {r[0]: r[1:] for r in rows}, len(rows)


@pytest.fixture(scope="module")
def docs(spark, small):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, small, name):
    assert oracle.difference(spark, small, QUERIES[name], ORACLES[name], oracle.connect(small)) is None


def test_op1(spark, small, docs):
    got, n = by_id(QUERIES["op1_suffix_dedup"](spark, small))
    want = {i: (*w[:3], brute.digest(w[3])) for (i, _), w in zip(docs, brute.suffix_dedup([t for _, t in docs], 200))}
    assert got == want and n == len(docs)


def test_op2(spark, small, docs):
    got, n = by_id(QUERIES["op2_jaccard_join"](spark, small))
    assert got == {r[0]: r[1:] for r in brute.jaccard(docs, 4, 85)[0]} and n == len(docs)


def test_op5(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").toPandas().sort_values("vec_id")
    want = brute.nearest(table.vec_id.to_numpy(), np.array(table.embedding.tolist(), float), 10, 100)
    rows = QUERIES["op5_nearest"](spark, small).collect()
    found = {(r["query_id"], r["vec_id"]) for r in rows}
    assert len(found & {(q, i) for q, h in want.items() for i, _ in h}) >= 0.9 * sum(map(len, want.values()))
    exact = {(q, i): d for q, h in want.items() for i, d in h}
    assert all(abs(exact[k] - r["score"]) < 1e-9 for r in rows if (k := (r["query_id"], r["vec_id"])) in exact)


def test_op6(spark, small):
    out = QUERIES["op6_language_id"](spark, small)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == 200


def test_op7(spark, small, docs):
    got, n = by_id(QUERIES["op7_bpe"](spark, small))
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for i, text in docs:
        ids = np.array(enc.encode_ordinary(text or ""), "<u4")
        assert got[i] == (len(ids), brute.digest(ids.tobytes()), brute.digest((text or "").encode()))
    assert n == len(docs)


def test_op9(spark, small, docs):
    rows = QUERIES["op9_token_order"](spark, small).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert sum(r["n_tokens"] for r in rows) == sum(len((t or "").encode()) + 1 for _, t in docs)


def test_op10(spark, small, docs):
    got, n = by_id(QUERIES["op10_substring_dedup"](spark, small))
    assert got == {r[0]: (r[1], r[2], brute.digest(r[3].encode())) for r in brute.substring_dedup(docs, 20)} and n == len(docs)


def test_pipeline_stages(spark, small, docs, tmp_path):
    """Each stage against a plain version on what the stage before it kept."""
    table = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = table.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, small)
        out.write.parquet(f"{tmp_path}/{name}")
        given, table = table, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (sorted((r["doc_id"], r["text"]) for r in given.collect()),
                      sorted(tuple(r) for r in table.collect()))
        if name != "bpe":
            assert table.columns == columns
    given, out = kept["language_id"]
    scorer = language_id.Scorer(language_id.fit(spark.read.parquet(f"{small}/documents.parquet")))
    want = [i for i, t in given if (p := scorer.predict(t))[0] != "und" and p[1] >= corpus_pipeline.MIN_SCORE]
    assert [r[0] for r in out] == want
    given, out = kept["line_dedup"]
    want = [(i, t) for i, t, n, gone in brute.line_dedup(given) if not gone or gone < n]
    assert [(r[0], r[1]) for r in out] == want and all(r[4] == len(r[1]) for r in out)
    given, out = kept["jaccard_join"]
    assert [r[0] for r in out] == [i for i, _, first in brute.jaccard(given, 5, 80)[0] if i == first]
    given, out = kept["mixing"]
    assert {(r[0], r[1]) for r in out} <= set(given) and len(out) >= 0.85 * len(given)
    given, out = kept["bpe"]
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert [(r[0], r[1], bytes(r[2]), r[3]) for r in out] == [
        (i, len(ids), np.array(ids, "<u4").tobytes(), brute.digest(t.encode())) for i, t in given for ids in [enc.encode_ordinary(t)]]


def test_registered():
    assert sorted(q.split("_")[0] for q in QUERIES if q != "pipeline") == sorted(f"op{n}" for n in range(1, 14))
    assert corpus_pipeline.QUERIES["pipeline"] is corpus_pipeline.run and 4 <= len(corpus_pipeline.STAGES) <= 5
