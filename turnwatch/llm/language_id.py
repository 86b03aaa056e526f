"""Language identification: known words first, shorter and shorter character n-grams for the rest (operator 6)."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwatch.llm.rows import arrow_batch, arrow_schema, fresh, tidy

#: The model is fitted on about this many labelled rows, chosen by a hash of their id.
FIT_ROWS = 20_000
#: Entries the model may hold: the most frequent words and n-grams of each length.
MAX_WORDS, MAX_GRAMS = 100_000, 50_000
LENGTHS = (5, 4, 3, 2, 1)
#: Added to every count, so that no language is ruled out by one word.
SMOOTH = 0.5
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    """Lower-case words and their counts. A word is a run of letters."""
    found = Counter(_WORD.findall(text.lower()))
    for w in [w for w in found if not w.isalpha()]:
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its edges marked; for ``n`` 1 its letters."""
    padded = f"^{word}$" if n > 1 else word
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def held_out(id_col: str) -> Column:
    """One row in five by a checksum of the id; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


class Model:
    """Log frequencies per language of known words and n-grams: per length (0 for words) the place
    of each entry and a matrix with a row per entry and a column per language."""

    def __init__(self, langs: list[str]):
        self.langs = sorted(langs)
        self.tables: dict[int, tuple[dict[str, int], np.ndarray]] = {}

    def learn(self, n: int, langs: list[str], entries: list[str], counts: list[int]) -> "Model":
        """Take over the counts of one length."""
        column = {lang: i for i, lang in enumerate(self.langs)}
        place: dict[str, int] = {}
        rows = [place.setdefault(e, len(place)) for e in entries]
        matrix = np.full((len(place), len(column)), SMOOTH)
        np.add.at(matrix, (rows, [column[x] for x in langs]), counts)
        self.tables[n] = place, np.log(matrix / matrix.sum(axis=0))
        return self

    def backoff(self, word: str) -> np.ndarray | None:
        """Mean log frequency of the word's longest n-grams that are known; null if none is."""
        for n in LENGTHS:
            place, logs = self.tables.get(n, ({}, None))
            rows = [place[g] for g in grams(word, n) if g in place]
            if rows:
                return logs[rows].mean(axis=0)
        return None


class Scorer:
    """Predicts with a model, keeping the rows of words it has met."""

    def __init__(self, model: Model, keep: int = 200_000):
        self.model, self.keep = model, keep
        self._start()

    def _start(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.langs)))
        self.known, self.logs = self.model.tables.get(0, ({}, None))
        self.used = 1  # row 0: a word that says nothing

    def _add(self, word: str) -> int:
        known = self.known.get(word)
        row = self.model.backoff(word) if known is None else self.logs[known]
        at = 0
        if row is not None:
            if self.used == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            at, self.used = self.used, self.used + 1
            self.rows[at] = row
        self.index[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language (ties: first by name) and its share among all, from mean log
        frequencies of the words; ``und`` and 0 if there is no letter or no language."""
        found = words_of(text) if text else None
        if not found or not self.model.langs:
            return UNKNOWN, 0.0
        if len(self.index) > self.keep:
            self._start()
        get = self.index.get
        at = np.array([i if (i := get(w)) is not None else self._add(w) for w in found])
        n = np.fromiter(found.values(), float, len(found))
        mean = n @ self.rows[at] / max(1.0, n[at > 0].sum())
        share = np.exp(mean - mean.max())
        best = int(share.argmax())
        return self.model.langs[best], float(share[best] / share.sum())


def _counts(sample: DataFrame) -> DataFrame:
    """``(lang, n, entry, count)`` of words (n = 0) and n-grams, summed per task before the shuffle."""
    ddl = "lang string, n int, entry string, count long"
    schema = arrow_schema(ddl)

    def flush(found: dict[str, Counter]):
        for lang, words in found.items():
            tables = {0: words}
            for n in LENGTHS:
                tables[n] = Counter()
                for w, c in words.items():
                    for g in grams(w, n):
                        tables[n][g] += c
            for n, table in tables.items():
                yield arrow_batch({"lang": [lang] * len(table), "n": [n] * len(table), "entry": list(table),
                                   "count": list(table.values())}, schema)

    def run(batches):
        found: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                found[lang.as_py()].update(words_of(text.as_py()))
                if len(found[lang.as_py()]) > 300_000:
                    yield from flush(found)
                    found = defaultdict(Counter)
        yield from flush(found)

    return sample.mapInArrow(run, ddl).groupBy("lang", "n", "entry").agg(F.sum("count").alias("count"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        fit_rows: int = FIT_ROWS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Learn from rows with a language and a text that are not held out: all of them, or about
    ``fit_rows`` chosen by a hash of the id. The model keeps the most frequent entries, so its size is bounded."""
    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull())
    share = fit_rows / max(1, rows.count())
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col)), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = rows.filter(F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col))
    counts = _counts(sample)
    total = (counts.groupBy("n", "entry").agg(F.sum("count").alias("total"), F.collect_list(F.struct("lang", "count")).alias("by"))
             .filter("total > 1 or n > 0").persist())
    model = Model([r["lang"] for r in total.select(F.explode("by.lang").alias("lang")).distinct().collect()])
    for n in (0, *LENGTHS):
        kept = (total.filter(F.col("n") == n).orderBy(F.desc("total"), "entry").limit(max_words if n == 0 else max_grams)
                .select("entry", F.explode("by").alias("b")).select("b.lang", "entry", "b.count").toArrow())
        model.learn(n, *(kept[c].to_pylist() for c in ("lang", "entry", "count")))
    total.unpersist()
    return model


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``. Only the text decides; a null text and one without
    letters are ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = fresh(docs, "found")

    @F.pandas_udf("lang string, score double")
    def find(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in series:
            yield pd.DataFrame([scorer.predict(t) for t in texts], columns=["lang", "score"])
        del scorer
        tidy()

    found = docs.withColumn(out, find(F.col(text_col)))
    return found.select(*docs.columns, F.col(out)["lang"].alias("lang_pred"), F.col(out)["score"].alias("score"))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per row of ``docs``, whatever repeats in it."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return identified(rows, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
