"""Mixing sources to target weights by iterative proportional fitting (operator 8)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwatch.llm.rows import fresh
from turnwatch.session import cut_lineage

#: Passes over all marginals.
ROUNDS = 6
#: How a missing category is named.
MISSING = "<null>"
Target = float | dict[str, float]
#: Bounded raking ends when no category is off its goal by more than this share of all tokens, or after so many passes.
TOLERANCE, BOUNDED_ROUNDS = 1e-5, 1000
#: Rows times columns of a cell table that the driver may hold.
MAX_VALUES = 1_000_000


def category(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(MISSING))


def cell_table(docs: DataFrame, dims: dict[str, Column], tokens: Column) -> DataFrame:
    """``(*dims, tokens)``: tokens of every combination of categories that occurs."""
    return (docs.select(*[category(c).alias(d) for d, c in dims.items()], tokens.cast("double").alias("tokens"))
            .groupBy(*dims).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"))


def _shares(cells: DataFrame, dim: str, target: Target) -> DataFrame:
    """``(dim, goal)``: the tokens a category should have. A number is the exponent that flattens the
    present shares (1 keeps them, 0 makes them equal); a dictionary gives shares, and categories it does not name get none."""
    have = cells.groupBy(dim).agg(F.sum("tokens").alias("t"))
    if isinstance(target, dict):
        pairs = [x for k, v in target.items() for x in (F.lit(k), F.lit(float(v)))]
        raw = have.withColumn("r", F.coalesce(F.create_map(*pairs)[F.col(dim)], F.lit(0.0)))
    else:
        raw = have.withColumn("r", F.pow("t", F.lit(float(target))))
    all_r, all_t = raw.agg(F.sum("r"), F.sum("t")).first()
    return raw.select(dim, (F.col("r") / F.lit(all_r or 1.0) * F.lit(all_t or 0.0)).alias("goal"))


def rake(cells: DataFrame, targets: dict[str, Target], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with ``weight``: tokens scaled so that their sums meet the target of every
    dimension in turn, ``rounds`` times over. Sums are combined before the shuffle, so no category is gathered in a task."""
    cells = cut_lineage(cells)
    goals = {dim: cut_lineage(_shares(cells, dim, target)) for dim, target in targets.items()}
    fitted = cells.withColumn("weight", F.col("tokens"))
    for _ in range(rounds):
        for dim, goal in goals.items():
            sums = fitted.groupBy(dim).agg(F.sum("weight").alias("have")).join(goal, dim)
            factor = F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0)
            fitted = (fitted.join(sums.select(dim, factor.alias("factor")), dim)
                      .withColumn("weight", F.col("weight") * F.col("factor")).drop("factor"))
        fitted = cut_lineage(fitted)
    return fitted


def _goals_here(cells: pd.DataFrame, dim: str, target: Target) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_shares`` for a small table: the code of each cell, the tokens of each category and its goal."""
    code, names = pd.factorize(cells[dim])
    have = np.bincount(code, cells["tokens"], len(names))
    raw = np.array([float(target.get(n, 0.0)) for n in names]) if isinstance(target, dict) else have ** float(target)
    return code, have, raw / (raw.sum() or 1.0) * have.sum()


def _calibrated_here(tokens: np.ndarray, weight: np.ndarray, keep: float) -> np.ndarray:
    """``calibrate`` for a small table."""
    rate, scale, full = weight / tokens, 0.0, -1
    while True:
        capped = (rate * scale >= 1) & (rate > 0)
        fixed, free = tokens[capped].sum(), weight[~capped].sum()
        if capped.sum() == full or not free:
            break
        full, scale = capped.sum(), (keep * tokens.sum() - fixed) / free
    return np.where(rate > 0, np.minimum(1.0, rate * scale) if free else 1.0, 0.0)


def fit_small(cells: pd.DataFrame, targets: dict[str, Target], keep: float, rounds: int = ROUNDS) -> pd.DataFrame:
    """``calibrate(rake(...))`` for a table that was checked to be small: no job but the one that made it."""
    steps = [_goals_here(cells, dim, target) for dim, target in targets.items()]
    tokens = cells["tokens"].to_numpy(float)
    weight = tokens.copy()
    for _ in range(rounds):
        for code, _, goal in steps:
            have = np.bincount(code, weight, len(goal))
            weight = weight * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[code]
    return cells.assign(weight=weight, probability=_calibrated_here(tokens, weight, keep))


def fit_small_bounded(cells: pd.DataFrame, targets: dict[str, Target], keep: float) -> pd.DataFrame:
    """``rake_bounded`` for a table that was checked to be small."""
    goals = {}
    for dim, target in targets.items():
        code, have, goal = _goals_here(cells, dim, target)
        names = pd.factorize(cells[dim])[1]
        goals[dim] = pd.DataFrame({dim: names, "goal": have * _calibrated_here(have, goal, keep)})
    weight = _rake_here(cells, goals, TOLERANCE, BOUNDED_ROUNDS)
    return cells.assign(weight=weight, probability=np.minimum(1.0, weight / cells["tokens"].to_numpy(float)))


def calibrate(fitted: DataFrame, keep: float) -> DataFrame:
    """``fitted`` with ``probability``: proportional to weight per token, 1 at most, such that the
    share ``keep`` of all tokens is expected to stay (or less, where cells of no weight leave less)."""
    rate = F.col("weight") / F.col("tokens")
    total = fitted.agg(F.sum("tokens")).first()[0] or 0.0
    scale, full = 0.0, -1
    while True:
        capped = (rate * F.lit(scale) >= 1) & (rate > 0)
        n, fixed, free = fitted.agg(F.count_if(capped), F.sum(F.when(capped, F.col("tokens")).otherwise(0.0)),
                                    F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if n == full or not free:
            break
        full, scale = n, (keep * total - fixed) / free
    # Raising the scale only adds capped cells, so the loop ends; with none free all that weigh anything are kept.
    if free == 0:
        scale = float("inf")
    p = F.when(rate > 0, F.least(F.lit(1.0), rate * F.lit(scale))).otherwise(0.0)
    return fitted.withColumn("probability", p)


def _allowed(cells: DataFrame, dim: str, target: Target, keep: float) -> DataFrame:
    """``(dim, target, goal)``: the share a category should have, and the tokens of it to keep. A category with fewer tokens
    than its share of the sample is kept whole, and the others of the dimension share what is left as their targets stand."""
    have = cells.groupBy(dim).agg(F.sum("tokens").alias("tokens"))
    rows = cut_lineage(have.join(_shares(cells, dim, target), dim).withColumnRenamed("goal", "weight"))
    total = rows.agg(F.sum("tokens")).first()[0] or 1.0
    return calibrate(rows, keep).select(dim, (F.col("weight") / F.lit(total)).alias("target"),
                                        (F.col("tokens") * F.col("probability")).alias("goal"))


def _rake_here(cells: pd.DataFrame, goals: dict[str, pd.DataFrame], tolerance: float, rounds: int) -> np.ndarray:
    """The weights of bounded raking, for a table that was checked to be small."""
    tokens = cells["tokens"].to_numpy(float)
    weight, steps = tokens.copy(), []
    for dim, goal in goals.items():
        code, names = pd.factorize(cells[dim])
        steps.append((code, goal.set_index(dim)["goal"].reindex(names).to_numpy(float)))
    for _ in range(rounds):
        for code, goal in steps:
            have = np.bincount(code, np.minimum(tokens, weight), len(goal))
            factor = np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)
            weight = np.minimum(weight * factor[code], tokens * 1e100)
        kept = np.minimum(tokens, weight)
        if max(np.abs(np.bincount(code, kept, len(goal)) - goal).max(initial=0) for code, goal in steps) <= tolerance * tokens.sum():
            break
    return weight


def rake_bounded(cells: DataFrame, targets: dict[str, Target], keep: float, tolerance: float = TOLERANCE,
                 rounds: int = BOUNDED_ROUNDS, max_values: int = MAX_VALUES) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``cells`` with ``weight`` and ``probability``, raked under the bound that no cell gives more tokens than it has, so that
    the expected sample itself, the share ``keep`` of all tokens, meets the goals; and the goals, ``(dim, target, goal)`` by dimension.

    Where a category is too rare for its target at this ``keep``, its goal is all it has (see ``_allowed``). A pass scales the weights of
    each category by what its capped cells leave to be met. Goals of single dimensions that no sample meets together stay off after
    ``rounds`` passes: ``expected_shares`` tells. A table of many cells is raked in Spark, a small one on the driver, alike."""
    cells = cut_lineage(cells)
    goals = {dim: cut_lineage(_allowed(cells, dim, target, keep)) for dim, target in targets.items()}
    chance = F.least(F.lit(1.0), F.col("weight") / F.col("tokens")).alias("probability")
    if targets and 0 < cells.count() * len(cells.columns) <= max_values:
        here = cells.toPandas()
        here["weight"] = _rake_here(here, {dim: goal.toPandas() for dim, goal in goals.items()}, tolerance, rounds)
        return cells.sparkSession.createDataFrame(here).select("*", chance), goals
    fitted = cells.withColumn("weight", F.col("tokens"))
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    kept = F.sum(F.least("tokens", "weight")).alias("have")
    for _ in range(rounds if total else 0):
        for dim, goal in goals.items():
            sums = fitted.groupBy(dim).agg(kept).join(goal, dim)
            factor = F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0)
            fitted = (fitted.join(sums.select(dim, factor.alias("factor")), dim)
                      .withColumn("weight", F.least(F.col("weight") * F.col("factor"), F.col("tokens") * 1e100)).drop("factor"))
        fitted = cut_lineage(fitted)
        off = [fitted.groupBy(dim).agg(kept).join(goal, dim).agg(F.max(F.abs(F.col("have") - F.col("goal")))).first()[0]
               for dim, goal in goals.items()]
        if max(off, default=0.0) <= tolerance * total:
            break
    return fitted.select(*cells.columns, "weight", chance), goals


def expected_shares(fitted: DataFrame, targets: dict[str, Target]) -> DataFrame:
    """``(dim, category, target, expected)``: the share of the sample's tokens that each category should have and the
    one it is expected to have, from cells with ``tokens`` and ``probability``."""
    out = None
    kept = F.sum(F.col("tokens") * F.col("probability"))
    total = fitted.agg(F.sum("tokens"), kept).first()
    for dim, target in targets.items():
        rows = fitted.groupBy(dim).agg(kept.alias("kept")).join(_shares(fitted, dim, target), dim).select(
            F.lit(dim).alias("dim"), F.col(dim).alias("category"), (F.col("goal") / F.lit(total[0] or 1.0)).alias("target"),
            (F.col("kept") / F.lit(total[1] or 1.0)).alias("expected"))
        out = rows if out is None else out.unionByName(rows)
    return out


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) that only the id and the seed decide."""
    digest = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, dims: dict[str, Column], targets: dict[str, Target], tokens: Column, keep: float,
        id_col: str = "doc_id", seed: int = 0, rounds: int = ROUNDS, bounded: bool = False) -> DataFrame:
    """``docs`` with ``tokens``, ``probability`` and ``sampled``: every row, and whether it is in the sample.

    ``dims`` names the categories (source, language, topic) as expressions over ``docs``; their tokens are raked
    to ``targets`` and each row is drawn with its cell's probability by a hash of its id, so rows that repeat
    an id fare alike and a null id is drawn like any other. A null category is one of its own. Rows without tokens have probability 1: they weigh
    nothing in any sum. Of an empty table nothing is drawn.

    The raked weights meet the targets, but where a cell would have to give more than it has, its chance is 1 and the sample misses
    them. With ``bounded`` the sample is raked itself (``rake_bounded``); ``rounds`` is for the other way."""
    names = {d: fresh(docs, f"cell_{d}") for d in dims}
    count, prob = fresh(docs, "tokens"), fresh(docs, "probability")
    cells = cell_table(docs, dims, tokens)
    cells = cut_lineage(cells)
    if targets and 0 < cells.count() * len(cells.columns) <= MAX_VALUES:
        here = cells.toPandas()
        here = fit_small_bounded(here, targets, keep) if bounded else fit_small(here, targets, keep, rounds)
        fitted = cells.sparkSession.createDataFrame(here)
    else:
        fitted = cut_lineage(rake_bounded(cells, targets, keep)[0] if bounded else calibrate(rake(cells, targets, rounds), keep))
    rates = fitted.select(*[F.col(d).alias(names[d]) for d in dims], F.col("probability").alias(prob))
    marked = docs.withColumns({names[d]: category(c) for d, c in dims.items()} | {count: tokens.cast("long")})
    chance = F.when(F.coalesce(count, F.lit(0)) == 0, 1.0).otherwise(F.coalesce(prob, F.lit(1.0)))
    out = marked.join(_small(rates), list(names.values()), "left")
    return out.select(*docs.columns, F.coalesce(count, F.lit(0)).alias("tokens"), chance.alias("probability"),
                      (draw(id_col, seed) < chance).alias("sampled"))


def _small(rates: DataFrame, max_values: int = MAX_VALUES) -> DataFrame:
    """Broadcast the cells where they are few: rows times columns are counted first."""
    return F.broadcast(rates) if rates.count() * len(rates.columns) <= max_values else rates


def word_count(text_col: str) -> Column:
    """Runs of characters other than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def form(text_col: str) -> Column:
    """The topic used by the registered query: tables, long pieces, or other prose."""
    text = F.col(text_col)
    return F.when(text.contains("|"), "table").when(F.length(text) >= 2000, "long").otherwise("prose")
