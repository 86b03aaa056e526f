"""Text columns against plain Python, judge answers, labelled text, datasets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from turnwatch.functions import prompts as P
from turnwatch.functions import text as T
from turnwatch.operators import grounding as G
from turnwatch.operators import monitor as M
from turnwatch.operators.extraction import letters
from turnwatch.plans.layout import TraceLayout
from turnwatch.session import new_folder
from turnwatch.sources import readers, sinks

# Each text with the sentences a reader would mark in it.
MARKED = [
    ("", []), ("   ", []), ("ok", ["ok"]),
    ("The train was late today. We took the bus instead.", ["The train was late today.", "We took the bus instead."]),
    ("No capital follows. so this is one sentence", ["No capital follows. so this is one sentence"]),
    ("Did it rain all day? It did not rain.", ["Did it rain all day?", "It did not rain."]),
    ("first we measure twice; then we cut once; never otherwise again",
     ["first we measure twice", "then we cut once", "never otherwise again"]),
    ("We tested the pump. Moreover, the valve was replaced.", ["We tested the pump.", "Moreover, the valve was replaced."]),
    ("Such a long day! Yes. Home we went at last.", ["Such a long day! Yes.", "Home we went at last."]),
    ("Hm. Then the story began slowly.", ["Hm.", "Then the story began slowly."]),
    ("Lines break here.\nNext comes another line.", ["Lines break here.", "Next comes another line."]),
]


@pytest.mark.parametrize("text, sentences", MARKED)
def test_sentences(spark, text, sentences):
    got = spark.createDataFrame([(text,)], "t string").select(
        T.sentences(F.col("t")).alias("s"), T.word_count(F.col("t")).alias("n")).first()
    assert got.s == sentences and got.n == len(text.split())


def test_sentences_lose_no_words_and_leave_no_fragments(spark):
    rng = random.Random(11)
    words = ["Rain", "wind", "falls", "Over", "hills", "so;", "then.", "why?", "stop!", "x", "Und", "weiter"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.sentences(F.col("t")).alias("s")).collect():
        assert re.sub(r"[;\s]", "", "".join(r.s)) == re.sub(r"[;\s]", "", r.t)
        assert all(len(x.split()) >= 3 for x in r.s[1:])


@pytest.mark.parametrize("answer,match,confidence", [
    ('{"match": true, "confidence": 0.9, "reasoning": "x"}', True, 0.9),
    ('```json\n{"match": true}\n```', True, 1.0), ('so: {"match": true} ok', True, 1.0),
    ('{"match": "true"}', False, 0.0), ('{"match": 1}', False, 0.0), ("", False, 0.0), ('{"match": tr', False, 0.0),
    ('{"confidence": 1}', False, 0.0), ("[1]", False, 0.0), ('{"match": true, "confidence": true}', True, 1.0),
    ('{"match": false}', False, 0.0), ('{"match": true, "confidence": "high"}', True, 1.0)])
def test_judge_answers(spark, answer, match, confidence):
    df = spark.createDataFrame([(answer,)], "t string")
    f = P.judge_fields(F.col("t"))
    got = df.select(f["match"].alias("m"), f["confidence"].alias("c")).first()
    assert (got.m, got.c) == (match, confidence)


def test_failing_judge_is_no_match(spark):
    def judge(prompt):
        if "bad" in prompt:
            raise RuntimeError
        return '{"match": true}'
    df = spark.createDataFrame([("good",), ("bad",)], "prompt string")
    got = {r.prompt: (r.match, r.confidence) for r in G.batch_judge(df, judge).collect()}
    assert got == {"good": (True, 1.0), "bad": (False, 0.0)}


def test_prompt_slots_are_not_filled_twice(spark):
    df = spark.createDataFrame([("{message}", "hi {examples}")], "d string, m string")
    text = df.select(P.fill("<{description}|{message}|{examples}>", {
        "description": F.col("d"), "message": F.col("m"), "examples": F.lit("NONE")})).first()[0]
    assert text == "<{message}|hi {examples}|NONE>"


LABELLED = [("one ### MATCH ### two\n### NO MATCH\nthree ###", [("one", "MATCH"), ("two", "NO MATCH"), ("three", None)]),
            ("a ### clean ### match ### b ### Warning", [("a", "NO MATCH"), ("b", "MATCH")]),
            ("### MATCH ### late ### x y", [("late", None), ("x y", None)]), ("only", [("only", None)])]


@pytest.mark.parametrize("segment", [1_000_000, 2])
def test_labelled_text(spark, segment):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LABELLED)], "file long, content string")
    got = readers.labelled_messages(readers.split_labelled(df), segment).collect()
    for i, (_, want) in enumerate(LABELLED):
        mine = sorted((r.msg_idx, r.text, r.label) for r in got if r.file == i)
        assert [(t, lab) for _, t, lab in mine] == want
        assert [n for n, _, _ in mine] == list(range(len(want)))


def test_labelled_files(spark, tmp_path):
    (tmp_path / "m.txt").write_text(LABELLED[0][0])
    got = readers.read_labelled_text(spark, str(tmp_path / "m.txt")).orderBy("msg_idx").collect()
    assert [(r.text, r.label) for r in got] == LABELLED[0][1]


def test_dataset_headers(spark):
    raw = spark.createDataFrame([(" p1 ", "user", "d", "positive", "p1_pos_1", " t ")],
                                ["﻿Proposition_ID", " Role", "proposition", "EXAMPLE_TYPE", "example_id", "text"])
    row = readers.normalise_dataset(raw).first()
    assert (row.proposition_id, row.text) == ("p1", "t")
    with pytest.raises(ValueError, match="text"):
        readers.normalise_dataset(raw.drop("text"))


def test_library_round_trip(spark):
    rows = [("p", "desc", "user", True, 0, "polite", 0, "a"), ("p", "desc", "user", True, 0, "polite", 1, "b"),
            ("p", "desc", "user", True, 1, "rude", 0, "c"), ("p", "desc", "user", False, 0, "near", 0, "d"),
            ("p", "desc", "user", None, 0, "NEUTRAL", 0, "e")]
    df = spark.createDataFrame(rows, "name string, proposition string, role string, is_positive boolean, "
                                     "category_idx int, category string, idx int, text string")
    path = new_folder(spark, "lib")
    sinks.write_anchor_library(df, path)
    back = readers.read_anchor_library(spark, path, multi_line=False).select(df.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    doc = sinks.library_documents(df).first()
    assert doc.metadata.total_anchors == 3 and doc.metadata.total_neutral_anchors == 1


# -- monitor over message tables -----------------------------------------------------------

def judged(spark, judgments, roles="ua"):
    names = {"u": "user", "a": "assistant", "s": "system"}
    msgs = spark.createDataFrame([(1, t, names[r], f"m{t}") for t, r in enumerate(roles)],
                                 "conv_id long, turn long, role string, text string")
    rows = spark.createDataFrame([(1, *j) for j in judgments],
                                 "conv_id long, turn long, prop_id string, match boolean")
    return M.label_matrix(msgs, rows, ["p", "q"]), TraceLayout.of(msgs, "conv_id", "turn")


def test_system_turn_advances_time(spark):
    labelled, layout = judged(spark, [(0, "p", True)], "usa")
    out = M.monitor(labelled, [M.Policy("y", "y", "Y(p)"), M.Policy("u", "u", "user_turn")], layout)
    got = [(r.ok_y, r.ok_u) for r in out.orderBy("turn").collect()]
    assert got == [(False, True), (True, False), (False, False)]


def test_missing_and_null_judgments_are_false(spark):
    labelled, layout = judged(spark, [(0, "p", None), (1, "q", True)])
    out = M.monitor(labelled, [M.Policy("h", "h", "H(!p)"), M.Policy("n", "n", "H(!nowhere)")], layout)
    assert all(r.passed for r in out.collect())


def test_violations_say_how_they_were_grounded(spark):
    labelled, layout = judged(spark, [(0, "p", True), (1, "q", True)], "uau")
    policies = [M.Policy("x", "guard", "H(P(p) -> !q)")]
    rows = [(1, 0, "p", True, 0.9, "asks", "llm"), (1, 1, "q", False, 0.8, "vague", "nli"), (1, 1, "q", True, 0.6, "clear", "nli"),
            (1, 1, "q", True, 0.7, None, "cosine"), (1, 1, "p", None, None, "no answer", "llm"), (1, 1, "other", True, 1.0, "", "llm")]
    judgments = spark.createDataFrame(rows, "conv_id long, turn long, prop_id string, match boolean, confidence double, "
                                            "reasoning string, method string")
    out = M.monitor(labelled, policies, layout, history=True)
    got = M.violations(out, policies, layout, ["p", "q"], judgments).orderBy("turn").collect()
    at_one = [("p", False, None, "no answer", "llm"), ("q", True, 0.7, None, "cosine")]
    assert [tuple(d) for d in got[0].grounding_details] == at_one and not got[0].was_already_violated
    assert [(d.prop_id, d.method) for d in got[1].grounding_details] == [("_violation_history", "monitor_note")]
    kept = M.message_records(out, policies, layout, ["p", "q"], judgments).orderBy("turn").collect()
    assert [r.blocked for r in kept] == [False, True, True]
    assert kept[0].violation_info is None and [tuple(v) for v in kept[1].violation_info] == [("x", "guard", "H(P(p) -> !q)")]
    assert [r.grounding_details and len(r.grounding_details) for r in kept] == [1, 2, None]
    none = M.violations(out, policies, layout, ["p", "q"], judgments.limit(0)).orderBy("turn").collect()
    assert [len(r.grounding_details) for r in none] == [0, 1]


def test_violation_is_noted_as_carried(spark):
    labelled, layout = judged(spark, [(0, "p", True), (1, "q", True)], "uauu")
    policies = [M.Policy("x", "guard", "H(P(p) -> !q)")]
    out = M.monitor(labelled, policies, layout, history=True)
    rows = M.violations(out, policies, layout, ["p", "q"]).orderBy("turn").collect()
    assert [(r.turn, r.was_already_violated) for r in rows] == [(1, False), (2, True), (3, True)]
    assert M.monitor(labelled, [], layout).filter("passed").count() == 4


def test_bad_policy_sets_are_refused(spark):
    labelled, layout = judged(spark, [])
    with pytest.raises(ValueError):
        M.monitor(labelled, [M.Policy(str(i), "n", "p") for i in range(51)], layout)
    with pytest.raises(ValueError):
        M.monitor(labelled, [M.Policy("a", "n", "p & " * 300 + "p")], layout)


def test_letters_of_arrays_are_counted_as_one_text_at_a_time(spark, monkeypatch):
    from turnwatch.functions import vectors as V
    monkeypatch.setattr(V, "_COUNTED", 7)
    rows = [(0, ["Abc a\u0130K\u212a", None, "", "zz top"]), (1, None), (2, []), (3, ["\u00e9 xyz" * 5]), (4, [None])]
    texts = spark.createDataFrame(rows, "i int, t array<string>")
    got = texts.select("i", F.transform("t", V.letter_histogram).alias("a"), V.letter_histograms(F.col("t")).alias("b")).collect()
    assert len(got) == 5 and all(r["a"] == r["b"] for r in got)
    plan = texts.select(letters(F.col("t")))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan
