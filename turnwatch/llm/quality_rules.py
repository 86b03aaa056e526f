"""Quality rules as a short-circuit cascade ordered by rejection per cost (operator 13).

Everything here is columns: no code of a Python worker, no driver-side rows but one summary per rule.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwatch.llm.rows import fresh, written

SPACE = r"[\x20\x09-\x0D]+"
INK = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: Rows on which costs and rejection rates of rules are measured, and how often each rule is timed.
SAMPLE_ROWS, RUNS = 4000, 2
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """``fails`` takes a function from a name to a column: ``text``, ``words``, ``lines`` (those with
    a word) or a measure."""
    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: Thresholds of the rules.
RULES = [
    Rule("word_length", lambda c: (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
    Rule("symbols", lambda c: c("n_symbols") > c("n_words")),
    Rule("repeated_lines", lambda c: 100 * c("n_dup_lines") > 60 * F.size(c("lines"))),
    Rule("bullets", lambda c: 100 * F.size(F.filter(c("lines"), lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))) > 90 * F.size(c("lines"))),
    Rule("ellipses", lambda c: 100 * F.size(F.filter(c("lines"), lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))) > 30 * F.size(c("lines"))),
    Rule("few_letters", lambda c: 100 * F.size(F.filter(c("words"), lambda x: x.rlike(r"\p{L}"))) < 50 * c("n_words")),
    Rule("shouting", lambda c: 100 * F.regexp_count(c("text"), F.lit(r"[A-Z]")) > 60 * c("word_chars")),
]


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), ``text``, ``words``, ``lines`` and the measures."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    out = out.select(
        "*", F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(INK)).alias("lines"))
    # Neighbours stand beside each other in zipped arrays: a lambda that looks outside itself would be worked out per element.
    n = F.size("words")
    beside = F.arrays_zip(F.col("words").alias("w1"), *[F.slice("words", k, n).alias(f"w{k}") for k in range(2, WINDOW + 1)])
    hashes = F.transform(beside, lambda z: F.xxhash64(*[z[f"w{k}"] for k in range(1, WINDOW + 1)]))
    out = out.select("*", F.slice(hashes, F.lit(1), F.greatest(n - WINDOW + 1, F.lit(0))).alias("hashes"))
    # Only a text in which some window comes twice has its windows put in order.
    again = F.size(F.array_distinct("hashes")) < F.size("hashes")
    out = out.withColumn("ranked", F.when(again, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    shifted = lambda c: F.concat(F.array(F.lit(None)), F.col(c)).alias("before")
    around = F.arrays_zip(F.col("ranked").alias("own"), F.slice("ranked", 2, F.size("ranked")).alias("next"), shifted("ranked"))
    twin = lambda z: (z["own"]["h"] == z["next"]["h"]) | (z["own"]["h"] == z["before"]["h"])
    out = out.withColumn("starts", F.sort_array(F.transform(F.filter(around, twin), lambda z: z["own"]["i"])))
    # A window adds the words that the one before it does not cover.
    steps = F.filter(F.arrays_zip(F.col("starts").alias("own"), shifted("starts")), lambda z: z["own"].isNotNull())
    gains = F.transform(steps, lambda z: F.least(F.lit(WINDOW), z["own"] - z["before"]))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        "row", "text", "words", "lines", F.size("words").cast("long").alias("n_words"),
        total(F.transform("words", lambda w: F.length(w))).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(total(gains), F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def sample_costs(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS, runs: int = RUNS,
                 text_col: str = "text") -> list[tuple[float, float]]:
    """Seconds and share of rejected rows of each rule over a sample of about ``rows`` of the rows that pass the base
    rules. The seconds are those above a scan of the same columns."""
    share = min(1.0, rows / max(1, docs.count()))
    measured = with_measures(docs.sample(share, 17), text_col)
    sample = written(measured.select("text", "words", "lines", *MEASURES), "rule-sample").filter(~base_failed())
    scan = [F.sum(F.length("text")), F.sum(F.size("words")), F.sum(F.size("lines")), *[F.sum(m) for m in MEASURES]]

    def timed(*more: Column) -> tuple[float, list]:
        best, row = float("inf"), None
        for _ in range(runs):
            begun = time.perf_counter()
            row = sample.agg(F.count(F.lit(1)), *scan, *more).first()
            best = min(best, time.perf_counter() - begun)
        return best, row

    plain, _ = timed()
    out = []
    for rule in rules:
        seconds, row = timed(F.count_if(F.coalesce(rule.fails(F.col), F.lit(False))))
        out.append((max(seconds - plain, 1e-4), row[-1] / max(1, row[0])))
    return out


def cascade(rules: list[Rule], costs: list[tuple[float, float]]) -> list[Rule]:
    """Rules by rejected share per second, the best first; ties as given."""
    order = sorted(range(len(rules)), key=lambda i: -costs[i][1] / costs[i][0])
    return [rules[i] for i in order]


def judged(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """``base_failed``, ``rejected_by`` (``base``, or the first rule in this order that fails) and ``kept``. A rule
    is worked out only for rows that passed all before it."""
    verdict = F.when(base_failed(), "base")
    for rule in rules:
        verdict = verdict.when(rule.fails(F.col), rule.name)
    return (measured.withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict)
            .withColumn("kept", F.col("rejected_by").isNull()))


def quality(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES, costs: list[tuple[float, float]] | None = None) -> DataFrame:
    """``docs`` with measures, ``base_failed``, ``kept`` and ``rejected_by`` for every row.

    The order of the rules comes from ``costs`` (measured on a sample if not given) and changes the work and ``rejected_by``,
    never ``kept``. A null or empty text has no words and fails the base rules. Repeated rows and null ids are rows like
    others. A new column whose name ``docs`` already has gets an underscore. Windows of words are compared within a text by
    64 bits of hash; arrays of a text are held in one row, so a task's memory follows its longest text."""
    measured = with_measures(docs, text_col)
    if costs is None:
        costs = sample_costs(docs, rules, text_col=text_col) if len(rules) > 1 else [(1.0, 1.0)] * len(rules)
    out, names = judged(measured, cascade(rules, costs)), [*MEASURES, "base_failed", "kept", "rejected_by"]
    return out.select("row.*", *[F.col(n).alias(fresh(docs, n)) for n in names])
