"""Searches, token output, mixing and byte-pair encoding."""

import brute
import hashlib
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from turnwatch.llm import bpe, mixing, token_order, topk_search, vptree
from turnwatch.session import new_folder

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 8)).round(3)
    points[10] = points[20] = points[100]
    points[rng.random(points.shape) < 0.3] = 0
    rows = [(i, [float(x) for x in p], "x") for i, p in enumerate(points)]
    odd = [(1000, None, "x"), (1001, [1.0, None], "x"), (1002, [float("nan")] * 8, "x"), (1003, [float("inf")] * 8, "x"),
           (1004, [0.0] * 8, "x"), (1005, [], "x"), (None, [1.0] * 8, "x"), (1006, [1.0, 2.0], "x")]
    return points, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, ib string").repartition(3)


def test_topk(vectors):
    points, df = vectors
    rows = topk_search.quantised(df, "vec_id", "embedding")
    got = topk_search.topk_search(rows.filter("id % 50 = 0"), rows, 5, item_block=64, query_block=2).collect()
    w = np.floor(256 * points).astype(np.int64)
    ids = np.append(np.arange(300), [1004, 1005, 1006])
    w = np.vstack([w, np.zeros((2, 8), np.int64), [[256, 512, 0, 0, 0, 0, 0, 0]]])
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        score = w @ w[q]
        order = [i for i in np.lexsort((ids, -score)) if i != q][:5]
        want |= {(int(ids[q]), r + 1, int(ids[i]), int(score[i])) for r, i in enumerate(order)}
    assert {tuple(r) for r in got} == want


def test_topk_of_few_and_none(vectors):
    rows = topk_search.quantised(vectors[1], "vec_id", "embedding")
    few = topk_search.topk_search(rows.filter("id = 0"), rows.filter("id < 3"), 5)
    assert few.count() == 2
    assert topk_search.topk_search(rows.limit(0), rows, 5).count() == 0
    assert topk_search.topk_search(rows, rows.limit(0), 5).count() == 0


def test_exact_neighbours(vectors):
    points, df = vectors
    rows = vptree.usable(df, "vec_id", "embedding")
    got = vptree.nearest(rows.filter("id % 20 = 0"), rows, 10, factor=1, shard=100, query_block=5, leaf=8).collect()
    keep = np.flatnonzero((points != 0).any(axis=1))
    want = brute.nearest(keep, points[keep], 10, 20)
    for q, hits in want.items():
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["item_id"] for r in mine] == [i for i, _ in hits]
        assert np.allclose([r["score"] for r in mine], [d for _, d in hits], rtol=1e-12)
    assert {r["query_id"] for r in got} == set(want)


def test_relaxed_neighbours_are_nearly_all_found(spark, small):
    rows = vptree.usable(spark.read.parquet(f"{small}/embeddings.parquet"), "vec_id", "embedding")
    table = rows.toPandas().sort_values("id")
    want = brute.nearest(table.id.to_numpy(), np.array(table.vec.tolist()), 10, 20)
    got = vptree.nearest(rows.filter("id % 20 = 0"), rows, 10, shard=200, leaf=16).collect()
    found = {(r["query_id"], r["item_id"]) for r in got}
    right = {(q, i) for q, hits in want.items() for i, _ in hits}
    assert len(found & right) / len(right) >= 0.9
    with pytest.raises(ValueError):
        vptree.nearest(rows, rows, 10, factor=0.5)
    assert vptree.nearest(rows.limit(0), rows, 10).count() == 0


def plain_encoding():
    return bpe.encoding(RANKS, PATTERN)


TEXTS = [None, "", "it's we'll  two  spaces\n\n tab\t1234abc", "x" * 5000, " " * 30000 + "end", "a" + "\n" * 25000,
         "é漢字🙂 " * 900, "ab1" * 3000, "word " * 4000, "?!" * 4000, " " * 12000 + " q", "<|endoftext|>"]


def test_long_texts_are_cut_without_changing_ids():
    enc = plain_encoding()
    for text in TEXTS[1:]:
        assert bpe.encode(enc, text, size=97) == enc.encode_ordinary(text)
        assert enc.decode_bytes(bpe.encode(enc, text)) == text.encode()
    # Longer white space than the library takes in one call.
    ids = bpe.encode(enc, "start" + " " * 1_500_000 + "end")
    assert enc.decode_bytes(ids) == b"start" + b" " * 1_500_000 + b"end"


def test_encode_and_decode(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "a", 1), (1, "", 1)],
                                 "doc_id long, text string, n_tokens int")
    coded = bpe.encode_texts(docs, RANKS, PATTERN)
    enc = plain_encoding()
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode_ids(coded, RANKS, PATTERN).collect()}
    for r in coded.collect():
        text = (TEXTS[r["doc_id"]] if r["doc_id"] is not None else "a") or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(text)
        assert r["n_tokens"] == len(r["ids"]) // 4 and bytes(r["decoded"]) == back[r["doc_id"]] == text.encode()
    digests = {r["doc_id"]: r for r in bpe.encode_texts(docs, RANKS, PATTERN, digests=True).collect()}
    assert digests[2]["decoded_sha256"] == hashlib.sha256(TEXTS[2].encode()).hexdigest()
    assert coded.count() == docs.count() and bpe.encode_texts(docs.limit(0), RANKS, PATTERN).count() == 0


def test_ranks_are_those_of_the_library():
    assert isinstance(plain_encoding(), tiktoken.Encoding) and plain_encoding().n_vocab == 50256


def test_permutation_is_a_bijection():
    for size in (1, 2, 3, 5, 64, 1000, 4097):
        order = token_order.Permutation(size, key=11)
        slots = order.slots(np.arange(size))
        assert sorted(slots) == list(range(size)) and order.indexes(slots).tolist() == list(range(size))
    big = token_order.Permutation(10**12 + 7, key=5)
    at = np.array([0, 1, 10**12])
    assert big.indexes(big.slots(at)).tolist() == at.tolist() and (big.slots(at) != token_order.Permutation(10**12 + 7, key=6).slots(at)).any()


def test_shards_hold_every_token_in_order(spark, texts, tmp_path):
    folder = f"{tmp_path}/in"
    spark.createDataFrame(texts + [(None, "no id"), texts[0]], "doc_id long, text string").repartition(3).write.parquet(folder)
    docs = spark.read.parquet(folder)
    out = f"file://{tmp_path}/shards"
    rows = token_order.materialise(docs, token_order.byte_tokens("text"), out, key=3, length=16, per_shard=50).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    stored = list(token_order.read_slots(out, 0, 10**9, length=16, per_shard=50))
    assert [hashlib.sha256(s).hexdigest() for s in stored] == [r["sha256"] for r in rows]
    assert list(token_order.read_slots(out, 73, 40, length=16, per_shard=50)) == stored[73:113]
    assert all(r["at"] == (r["slot"] - 50 * r["shard"]) * 16 for r in rows)
    pieces = {}
    for r, s in zip(rows, stored):
        pieces.setdefault((r["doc_id"], r["k"]), []).append(s[:r["n_tokens"]])
    for i, t in texts:
        raw, k, found = (t or "").encode() + b"\xff", 0, b""
        while len(found) < len(raw):
            found += pieces[i, k][0]
            k += 1
        assert found == raw and (i, k) not in pieces
    assert token_order.materialise(docs.limit(0), token_order.byte_tokens("text"), f"{out}-none", key=3).count() == 0


def test_raking_meets_the_targets(spark):
    rows = [(f"s{a}", f"l{b}", f"t{c}", float(1 + a * 7 + b * 3 + c)) for a in range(4) for b in range(3) for c in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    targets = {"source": 0.0, "lang": {"l0": 0.5, "l1": 0.25, "l2": 0.25}, "topic": 0.5}
    fitted = mixing.rake(cells, targets, rounds=4)
    total = sum(r[3] for r in rows)
    share = {r[0]: r[1] / total for d in ("source", "lang") for r in fitted.groupBy(d).agg(F.sum("weight")).collect()}
    assert all(abs(share[f"s{a}"] - 0.25) < 2e-3 for a in range(4)) and abs(share["l0"] - 0.5) < 2e-3
    for keep in (0.1, 0.99, 1.0):
        kept = mixing.calibrate(fitted, keep).agg(F.sum(F.col("tokens") * F.col("probability")), F.max("probability")).first()
        assert abs(kept[0] - keep * total) < 1e-6 * total and kept[1] <= 1


def test_mix_of_messy_rows(spark, messy, nothing):
    docs = messy.withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise("a")).withColumn("tokens", F.lit(1)).drop("tokens")
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.form("text")}
    mixed = mixing.mix(docs, dims, {"source": 0.5, "lang": 1.0, "topic": 1.0}, mixing.word_count("text"), 0.5, rounds=1).cache()
    got = mixed.collect()
    assert len(got) == docs.count() and mixed.columns[:len(docs.columns)] == docs.columns
    assert all(0 <= r["probability"] <= 1 for r in got) and all(r["probability"] == 1 for r in got if r["tokens"] == 0)
    expected = sum(r["tokens"] * r["probability"] for r in got)
    assert abs(expected - 0.5 * sum(r["tokens"] for r in got)) < 1
    again = {(r["doc_id"], r["text"]): r["sampled"] for r in mixed.collect()}
    assert all(again[r["doc_id"], r["text"]] == r["sampled"] for r in got)
    empty = mixing.mix(nothing.withColumn("source", F.lit("a")), dims, {"source": 0.5}, mixing.word_count("text"), 0.5, rounds=1)
    assert empty.count() == 0
