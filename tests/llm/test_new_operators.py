"""Alignment, collocations and quality rules against plain versions."""

import brute
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnwatch.llm import alignment, collocations, quality_rules
from turnwatch.llm.hashing import Words, window_hash
from turnwatch.llm.queries import QUERIES

FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def aligned(docs):
    """By the tokenizers' own libraries, on whole texts."""
    one = Tokenizer.from_file(FILES[0])
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    pair = alignment.tokenizers(*FILES)
    return brute.alignment(docs, lambda t: one.encode(" " + t, add_special_tokens=False).ids, two.encode,
                           pair.bytes_a.__getitem__, pair.bytes_b.__getitem__)


def test_op11(spark, small):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    assert plain(QUERIES["op11_alignment"](spark, small).collect()) == plain(aligned(docs))


ODD = ["", " ", "\n", "  two  spaces \n\t tabs", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁", "naïve 日本語 \U0001f600", " x　y",
       "ﬁ ½ Å", "é", "x" * 400, "'s 't don't", "12345 6 7\r\n8"]


def test_alignment_of_odd_texts(spark, messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    got = alignment.align(messy, *FILES, parts=7)
    assert got.columns[0] == "doc_id" and plain(got.collect()) == plain(aligned(rows))
    assert alignment.align(nothing, *FILES).count() == 0
    odd = list(enumerate(ODD))
    assert plain(alignment.align(spark.createDataFrame(odd, "doc_id long, text string"), *FILES, parts=3).collect()) == plain(aligned(odd))


def test_long_text_is_cut_where_no_token_crosses(monkeypatch):
    pair = alignment.tokenizers(*FILES)
    text = ("Some words, 12 of them;  two spaces \n and ▁ x " + "y" * 50 + " ") * 40
    whole = pair.tokens(text.replace("▁", "")), pair._pieces(text)
    monkeypatch.setattr(alignment, "PIECE_CHARS", 60)
    short = pair.tokens(text.replace("▁", "")), pair._pieces(text)
    assert [x.tolist() for x in whole[0]] == [x.tolist() for x in short[0]] and whole[1] == short[1] and len(whole[0][0])


@pytest.mark.parametrize("every", [1, 3, 10**9])
def test_collocations(spark, messy, nothing, every):
    docs = messy.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "und"))
    docs = docs.withColumn("text", F.regexp_replace("text", "7 ", "7, "))
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    got = collocations.collocations(docs, least=4, first=60, every=every)
    assert plain(got.collect()) == plain(brute.collocations(rows, 4, 80, 60))
    assert collocations.collocations(nothing).count() == 0


def test_chunks_count_each_phrase_once():
    """Phrases that start before the overlap of their chunk are those of the text, whatever the borders."""
    text = ("a b c d a b c d e f, " * 30 + "g " * 50).encode()
    whole = collocations.Parse.of_texts([text])
    for every in (1, 2, 5, 50):
        begin, end, final = collocations.border(whole, every)
        seen = []
        for b, e, f in zip(begin, end, final):
            seen += list(range(b, e if f else e - collocations.OVERLAP))
            assert f or all(i + int(whole.run[i]) <= e for i in range(b, e - collocations.OVERLAP))
        assert seen == list(range(len(whole.start)))


def test_full_filter_changes_nothing(spark, messy, monkeypatch):
    """A filter that says yes to everything costs work only."""
    docs = messy.select("lang", "text")
    want = plain(collocations.collocations(docs, least=3, first=50).collect())
    monkeypatch.setattr(collocations, "frequent", lambda chunks, filters, lengths, *a: [np.full(1 << collocations.FILTER_BITS - 6, 2**64 - 1, np.uint64)] * len(lengths))
    assert want and plain(collocations.collocations(docs, least=3, first=50).collect()) == want


def test_quality_measures(spark, messy, nothing):
    docs = messy.withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(0))
    out = quality_rules.quality(docs, costs=[(1.0, 0.1)] * len(quality_rules.RULES))
    rows = out.collect()
    got = [(r["text"], r["n_words_"], *[r[m] for m in quality_rules.MEASURES[1:]], r["base_failed"]) for r in rows]
    assert plain(got) == plain((r["text"], *brute.quality(r["text"])) for r in messy.collect())
    assert all(r["n_words"] == "mine" and r["kept"] == 0 and r["kept_"] == (r["rejected_by"] is None) for r in rows)
    assert quality_rules.quality(nothing).count() == 0


TEXTS = {"plain": "The quick brown fox jumps over the lazy dog near the old river bank today.",
         "word_length": "a b c d e f g h i j k l m n o p", "symbols": "x#### yy ##### zz #### word and more words to make ten $$$ ###",
         "repeated_lines": "\n".join(["aa bb cc"] * 9 + ["one two three four five six seven eight nine ten eleven"] + ["aa bb cc"]),
         "bullets": "\n".join(f"- item number{i} is here" for i in range(6)), "ellipses": "\n".join(f"line{i} with words ..." for i in range(6)),
         "few_letters": "12 34 56 78 910 11 12x 13 14 15 16 17", "shouting": "THIS TEXT IS WRITTEN IN CAPITAL LETTERS FROM FRONT TO BACK NOW"}


def test_rules(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "name string, text string")
    want = {n: n != "plain" for n in TEXTS}
    for order in (quality_rules.RULES, quality_rules.RULES[::-1]):
        measured = quality_rules.with_measures(docs)
        got = {r["row"]["name"]: (r["rejected_by"], r["kept"]) for r in quality_rules.judged(measured, order).collect()}
        assert {n: not k for n, (_, k) in got.items()} == want
    first = {r["name"]: r["rejected_by"] for r in quality_rules.quality(docs, costs=[(1.0, 1 - i / 10) for i in range(7)]).collect()}
    assert first == {n: None if n == "plain" else "base" if n == "repeated_lines" else n for n in TEXTS}


def test_cascade_order(spark, small):
    rules = quality_rules.RULES[:3]
    assert [r.name for r in quality_rules.cascade(rules, [(2.0, 0.1), (1.0, 0.1), (1.0, 0.5)])] == [rules[2].name, rules[1].name, rules[0].name]
    costs = quality_rules.sample_costs(spark.read.parquet(f"{small}/documents.parquet"), rules, rows=100, runs=1)
    assert len(costs) == 3 and all(s > 0 and 0 <= r <= 1 for s, r in costs)


def test_hashes_of_structured_words():
    even = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    odd = even.translate(str.maketrans("ab", "ba"))
    for seed in (0, 1):
        words = Words([even, odd, f"{even} {odd}", "x" * 128 + " " + "x" * 129]).hashes(seed)
        assert words[0] == words[2] and words[1] == words[3] and len(set(words.tolist())) == 4
    seq = Words([" ".join(even), " ".join(odd)])
    ends = window_hash(seq.hashes(), seq.first[:2], 1024)
    assert ends[0] != ends[1]
