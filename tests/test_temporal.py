"""Golden traces, a random differential test and the long-trace layout."""

import random

import pytest
from pyspark.sql import functions as F

from turnwatch.plans.formula import FormulaError, read_formula
from turnwatch.plans.layout import TraceLayout, ranked

# (formula, proposition bits, expected bits): one character per turn from turn 0, worked out by hand.
GOLDEN = [
    ("Y(a)", {"a": "11010"}, "01101"),
    ("Y(Y(a))", {"a": "100110"}, "001001"),
    ("P(a)", {"a": "00010100"}, "00011111"),
    ("H(a)", {"a": "1110111"}, "1110000"),
    ("a S b", {"a": "01101110", "b": "10000100"}, "11100110"),
    ("b S a", {"a": "00000", "b": "11111"}, "00000"),
    ("P(a & b)", {"a": "0110", "b": "0011"}, "0011"),
    ("H(a -> P(b))", {"a": "00101", "b": "01000"}, "11111"),
    ("H(a -> P(b))", {"a": "01001", "b": "00100"}, "10000"),
    ("H(Y(a) -> b)", {"a": "01000", "b": "00110"}, "11111"),
    ("!Y(a) | b", {"a": "1100", "b": "0010"}, "1011"),
    ("P(Y(a))", {"a": "0100"}, "0011"),
    ("H(!(a & b)) & P(a)", {"a": "0101", "b": "1001"}, "0110"),
    ("Y(a S b)", {"a": "0111", "b": "1000"}, "0111"),
    ("a -> (a S b)", {"a": "10110", "b": "01000"}, "01111"),
    ("H(P(a) -> !b)", {"a": "001000", "b": "110010"}, "111100"),
    ("Y(H(a))", {"a": "011"}, "100"),
    ("Y(true)", {"a": "000"}, "011"),
]
NAMES = sorted({n for _, bits, _ in GOLDEN for n in bits})


def recurrence(f, rows):
    """Step-by-step oracle: one dict of values per step."""
    nodes = list(f.walk())
    prev = {id(n): n.op == "H" for n in nodes}
    out = []
    for row in rows:
        now = {}
        for n in nodes:
            v = [now[id(p)] for p in n.parts]
            now[id(n)] = {
                "atom": lambda: n.name == "true" or (n.name != "false" and row.get(n.name, False)),
                "!": lambda: not v[0], "&": lambda: v[0] and v[1], "|": lambda: v[0] or v[1],
                "->": lambda: not v[0] or v[1], "Y": lambda: prev[id(n.parts[0])],
                "P": lambda: v[0] or prev[id(n)], "H": lambda: v[0] and prev[id(n)],
                "S": lambda: v[1] or (v[0] and prev[id(n)])}[n.op]()
        out.append(now[id(f)])
        prev = now
    return out


@pytest.mark.parametrize("segment", [1_000_000, 3])
def test_golden_traces(spark, segment):
    rows = [(i, t, *[bits.get(n, "0" * len(want))[t] == "1" for n in NAMES])
            for i, (_, bits, want) in enumerate(GOLDEN) for t in range(len(want))]
    schema = "trace long, turn long, " + ", ".join(f"{n} boolean" for n in NAMES)
    df = spark.createDataFrame(rows, schema)
    layout = TraceLayout.of(df, "trace", "turn", segment)
    formulas = {f"f{i}": read_formula(text) for i, (text, _, _) in enumerate(GOLDEN)}
    got = layout.evaluate(df, formulas, {n: F.col(n) for n in NAMES}).collect()
    for i, (text, _, want) in enumerate(GOLDEN):
        mine = sorted((r["turn"], r[f"f{i}"]) for r in got if r["trace"] == i)
        assert "".join("01"[v] for _, v in mine) == want, text


def test_names_made_of_operator_letters(spark):
    """Names that hold the letters of operators, or characters that unify, are names as written."""
    df = spark.createDataFrame([(0, 0, True, False), (0, 1, False, True)], "trace long, turn long, YP boolean, `ﬁx` boolean")
    formulas = {"f": read_formula("YP -> ﬁx"), "g": read_formula("Y(YP) & ﬁx")}
    layout = TraceLayout.of(df, "trace", "turn")
    got = sorted(layout.evaluate(df, formulas, {"YP": F.col("YP"), "ﬁx": F.col("`ﬁx`")}).select("turn", "f", "g").collect())
    assert [tuple(r) for r in got] == [(0, False, False), (1, True, True)]
    for text in ("PH(a)", "YPH(a)", "YP(a)"):
        with pytest.raises(FormulaError):
            read_formula(text)


def random_formula(rng, depth):
    if depth == 0 or rng.random() < 0.15:
        return rng.choice(["a", "b", "c", "true", "missing"])
    kind = rng.choice("YPHS!&|>")
    x = random_formula(rng, depth - 1)
    if kind in "YPH":
        return f"{kind}({x})"
    if kind == "!":
        return f"!({x})"
    y = random_formula(rng, depth - 1)
    return f"({x}) {'->' if kind == '>' else kind} ({y})"


@pytest.mark.parametrize("segment", [1_000_000, 7])
def test_random_formulas_agree_with_recurrence(spark, segment):
    rng = random.Random(5)
    texts = [random_formula(rng, 4) for _ in range(12)]
    traces = {i: [{n: rng.random() < p for n in "abc"} for _ in range(length)]
              for i, (length, p) in enumerate([(1, .5), (6, .3), (40, .5), (90, .8), (25, .1)])}
    df = spark.createDataFrame(
        [(i, t, r["a"], r["b"], r["c"]) for i, rows in traces.items() for t, r in enumerate(rows)],
        "trace long, turn long, a boolean, b boolean, c boolean").repartition(4)
    layout = TraceLayout.of(df, "trace", "turn", segment)
    formulas = {f"f{i}": read_formula(t) for i, t in enumerate(texts)}
    got = {(r["trace"], r["turn"]): r for r in layout.evaluate(
        df, formulas, {n: F.col(n) for n in "abc"}).collect()}
    assert len(got) == df.count()
    for i, text in enumerate(texts):
        for trace, rows in traces.items():
            assert [got[trace, t][f"f{i}"] for t in range(len(rows))] == \
                recurrence(read_formula(text), rows), text


@pytest.mark.parametrize("text", ["", " ", "a |", "& a", "a ! b", "a -> ", "((a)", "a)", "Y()", "Y a", "Y", "H | a", "S",
                                  "a S", "a b", "a(b)", "2a", "a ~ b", "a - b", "a > b", "(a)(b)", "a, b", "a -> -> b"])
def test_rejected_formulas(text):
    with pytest.raises(FormulaError):
        read_formula(text)


@pytest.mark.parametrize("text,label", [
    ("p -> q -> r", "(p -> (q -> r))"), ("p S q S r", "((p S q) S r)"),
    ("!p & q | r -> s S t", "((((!(p) & q) | r) -> s) S t)"), ("!!p", "!(!(p))"),
    ("not_a & or_b", "(not_a & or_b)"), ("and | is", "(and | is)"), ("H(p S q)", "H((p S q))")])
def test_precedence(text, label):
    assert read_formula(text).label == label


def test_one_shuffle_for_ordinary_traces(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    layout = TraceLayout.of(df, "conv_id", "turn")
    f = {"v": read_formula("H(P(p) -> !q) & H(Y(P(p)) -> (q S p))")}
    out = layout.evaluate(df, f, {"p": F.col("role") == "user", "q": F.length("text") > 80})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_positions_do_not_depend_on_layout(spark):
    df = spark.range(500).selectExpr("id % 3 = 0 as hot", "id", "hash(id) as h")
    small = {(r.hot, r.id): r.position for r in ranked(df, ["hot"], ["h", "id"]).collect()}
    cut = {(r.hot, r.id): r.position
           for r in ranked(df, ["hot"], ["h", "id"], segment_rows=50).collect()}
    assert small == cut and len(cut) == 500
