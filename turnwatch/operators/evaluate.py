"""Evaluation of grounders and statistics of anchor sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwatch.functions.vectors import cosine, unit
from turnwatch.operators.grounding import verdict
from turnwatch.plans.similarity import compare, search
from turnwatch.session import cut_lineage

VERDICTS = ("MATCH", "WARNING", "NO MATCH", "ERROR")


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


# -- verdict tables -------------------------------------------------------------------

def verdict_counts(verdicts: DataFrame) -> DataFrame:
    names = [v.lower().replace(" ", "_") for v in VERDICTS]
    return verdicts.groupBy("mode").agg(
        *[F.count_if(F.col("verdict") == v).alias(n) for v, n in zip(VERDICTS, names)])


def confusion_metrics(verdicts: DataFrame) -> DataFrame:
    """Per mode from ``(mode, verdict, label)``; WARNING counts as positive, rows without a
    label are left out."""
    hit, want = F.col("verdict").isin("MATCH", "WARNING"), F.col("label") == "MATCH"
    c = verdicts.filter(F.col("label").isNotNull()).groupBy("mode").agg(
        F.count_if(hit & want).alias("tp"), F.count_if(hit & ~want).alias("fp"),
        F.count_if(~hit & ~want).alias("tn"), F.count_if(~hit & want).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    p, r = _share(tp, tp + fp), _share(tp, tp + fn)
    return c.withColumn("precision", p).withColumn("recall", r).withColumn(
        "f1", _share(2 * p * r, p + r)).withColumn("accuracy", _share(tp + tn, tp + fp + tn + fn))


def mode_agreement(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Number of messages on which every mode gives the same verdict."""
    per = verdicts.groupBy(*keys).agg((F.min("verdict") == F.max("verdict")).alias("same"))
    return per.agg(F.count(F.lit(1)).alias("total"), F.count_if("same").alias("agree"))


def verdict_grid(verdicts: DataFrame, keys: list[str], modes: list[str]) -> DataFrame:
    """One row per message, one column per mode, with a flag for any wrong verdict."""
    grid = verdicts.groupBy(*keys).agg(
        F.max("label").alias("label"),
        *[F.max(F.when(F.col("mode") == m, F.col("verdict"))).alias(m) for m in modes])
    wrong = F.lit(False)
    for m in modes:
        wrong = wrong | F.coalesce(
            F.col(m).isin("MATCH", "WARNING") != (F.col("label") == "MATCH"), F.lit(False))
    return grid.withColumn("any_wrong", wrong)


def threshold_grid() -> list[tuple[int, int, float, float]]:
    """The scanned thresholds in scan order: match 0.40.. below 0.95, warning 0.30.. below
    match, step 0.05."""
    return [(i, j, float(m), float(w))
            for i, m in enumerate(np.arange(0.40, 0.95, 0.05))
            for j, w in enumerate(np.arange(0.30, m, 0.05))]


def calibrate_thresholds(scores: DataFrame, min_rows: int = 10, min_class: int = 3) -> DataFrame:
    """Thresholds with the best F1 per proposition from ``(prop, score, label 0/1)``. Scores
    are counted first; only the few distinct scores meet the grid. The first grid point that
    reaches the best F1 wins; too little data gives no row."""
    # A handful of rows used twice: kept so that the scoring behind it runs once.
    counts = cut_lineage(scores.groupBy("prop", "score", "label").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("prop").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"))
    totals = totals.filter((F.col("rows") >= min_rows) & (F.col("pos") >= min_class)
                           & (F.col("rows") - F.col("pos") >= min_class))
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(m).alias("match"),
                              F.lit(w).alias("warning")) for i, j, m, w in threshold_grid()])
    over, pos = F.col("score") > F.col("g.warning"), F.col("label") == 1

    def count(cond):
        return F.sum(F.when(cond, F.col("n")).otherwise(0))
    points = (counts.withColumn("g", F.explode(grid)).groupBy("prop", "g").agg(
        count(over & pos).alias("tp"), count(over & ~pos).alias("fp"),
        count(~over & pos).alias("fn"), count(~over & ~pos).alias("tn")))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p, r = tp / F.greatest(F.lit(1), tp + fp), tp / F.greatest(F.lit(1), tp + fn)
    points = points.withColumn("f1", 2 * p * r / F.greatest(F.lit(1e-10), p + r)) \
        .withColumn("acc", (tp + tn) / (tp + fp + fn + tn))
    best = points.groupBy("prop").agg(F.max_by(
        F.struct("g.match", "g.warning", "f1", "acc"),
        F.struct("f1", -F.col("g.i"), -F.col("g.j"))).alias("b"))
    # With no positive F1 the scan keeps its starting thresholds.
    found = F.col("b.f1") > 0
    return totals.join(best, "prop").select(
        "prop", "rows", "pos", F.when(found, F.col("b.match")).otherwise(0.70).alias("match"),
        F.when(found, F.col("b.warning")).otherwise(0.50).alias("warning"),
        F.col("b.f1").alias("f1"), F.col("b.acc").alias("accuracy"))


def score_distribution(scores: DataFrame) -> DataFrame:
    """Per proposition: score range of either class and the gap between them."""
    pos, neg = F.when(F.col("label") == 1, F.col("score")), F.when(F.col("label") == 0, F.col("score"))
    out = scores.groupBy("prop").agg(
        F.min(pos).alias("pos_min"), F.avg(pos).alias("pos_mean"), F.max(pos).alias("pos_max"),
        F.min(neg).alias("neg_min"), F.avg(neg).alias("neg_mean"), F.max(neg).alias("neg_max"))
    return out.withColumn("gap", F.col("pos_min") - F.col("neg_max"))


def file_summary(scores: DataFrame, match: float, warning: float) -> DataFrame:
    """Totals of one mode with inclusive thresholds, and accuracy on labelled rows."""
    v = verdict(F.col("score"), match, warning, inclusive=True)
    right = (F.col("score") >= warning) == (F.col("label") == "MATCH")
    return scores.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(v == "MATCH").alias("matches"),
        F.count_if(v == "WARNING").alias("warnings"), F.count_if(v == "NO MATCH").alias("clean"),
        F.count("label").alias("labelled"), F.count_if(right).alias("correct"))


def dataset_profile(rows: DataFrame) -> DataFrame:
    """Each proposition must have one role and one wording; examples are counted."""
    return rows.groupBy("proposition_id").agg(
        F.min("role").alias("role"), F.min("proposition").alias("proposition"),
        F.count_if(F.col("example_type") == "positive").alias("positives"),
        F.count_if(F.col("example_type") == "negative").alias("negatives"),
        ((F.min("role") == F.max("role")) & (F.min("proposition") == F.max("proposition")))
        .alias("consistent"))


# -- similarity statistics without pairs -------------------------------------------------

def mean_similarity(items: DataFrame, group: list[str]) -> DataFrame:
    """Mean pairwise cosine per group with a zero diagonal over n squared cells. The sum of
    all pairs is the squared length of the summed unit vectors, so one pass suffices."""
    dims = (items.select(*group, F.posexplode(unit(F.col("vec"))).alias("d", "x"))
            .groupBy(*group, "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("s2"),
                                      F.count(F.lit(1)).alias("n")))
    sums = dims.groupBy(*group).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("total"),
                                    F.sum("s2").alias("diag"))
    return sums.select(
        *group, "n", ((F.col("total") - F.col("diag")) / (F.col("n") * F.col("n"))).alias("mean_sim"))


def neighbour_stats(items: DataFrame, group: list[str], threshold: float, **kw) -> DataFrame:
    """For every item of a group: nearest other item, its similarity, and how many others
    reach the threshold. Block pairs are compared; pairs are never written out."""
    def look(rows, others, sims):
        same = rows["id"][:, None] == others["id"][None, :]
        sims = np.where(same, -2.0, sims)
        # lowest id among the equally near
        order = np.argsort(others["id"], kind="stable")
        best = order[sims[:, order].argmax(axis=1)]
        take = np.arange(len(sims))
        return pd.DataFrame({
            **{g: rows[g] for g in group}, "id": rows["id"], "nn": others["id"][best],
            "s": sims[take, best], "close": (sims >= threshold).sum(axis=1)})

    fields = ", ".join(f"{g} {items.schema[g].dataType.simpleString()}" for g in group)
    parts = compare(items.withColumn("pos", F.lit(0)), group, look,
                    f"{fields}, id long, nn long, s double, close long", **kw)
    parts = parts.filter(F.col("s") > -1.5)
    return parts.groupBy(*group, "id").agg(
        F.max_by("nn", F.struct("s", -F.col("nn"))).alias("nearest_id"),
        F.max("s").alias("nearest_sim"), F.sum("close").alias("n_close"))


def similarity_stats(items: DataFrame, group: list[str], **kw) -> DataFrame:
    """Mean (n squared) and maximum pairwise similarity per group."""
    top = neighbour_stats(items, group, 2.0, **kw).groupBy(*group).agg(
        F.max("nearest_sim").alias("max_sim"))
    return mean_similarity(items, group).join(top, group, "left").withColumn(
        "max_sim", F.greatest(F.lit(0.0), F.coalesce("max_sim", F.lit(0.0))))


def diversity_gain(pool_mean: Column, selected_mean: Column) -> Column:
    """Percentage by which a selection is less similar than its pool."""
    return (1 - selected_mean / (pool_mean + F.lit(1e-10))) * 100


def category_variance(items: DataFrame, group: list[str], low: float = 0.15) -> DataFrame:
    """1 - mean similarity per category of at least three items."""
    out = mean_similarity(items, group).filter(F.col("n") >= 3)
    v = 1 - F.col("mean_sim")
    return out.select(*group, "n", v.alias("variance"), (v < low).alias("low_variance"))


def directional_spread(items: DataFrame, group: list[str], origin: str = "prop_vec") -> DataFrame:
    """Mean pairwise cosine of the directions from the proposition to its anchors."""
    away = F.zip_with("vec", origin, lambda a, b: a.cast("double") - b.cast("double"))
    return mean_similarity(items.select(*group, away.alias("vec")), group)


def proposition_proximity(items: DataFrame, group: list[str]) -> DataFrame:
    c = cosine(F.col("vec"), F.col("prop_vec"))
    return items.groupBy(*group).agg(F.min(c).alias("min_sim"), F.avg(c).alias("avg_sim"),
                                     F.max(c).alias("max_sim"))


def class_similarity_histogram(items: DataFrame, bins: int = 40, **kw) -> tuple[DataFrame, DataFrame]:
    """Histograms of positive-positive, positive-negative and negative-negative similarity
    over [-1, 1], and their means with the class overlap: the share of positive-negative
    pairs above (mean - one deviation) of the positive-positive ones. Each block pair gives
    at most three rows per bin. ``items(id, vec, is_pos)``."""
    width = 2.0 / bins
    flat = items.select("id", "vec", "is_pos", F.lit(0).alias("g"), F.col("id").alias("pos"))

    def of(kind, rows, others, sims):
        """The similarities of a kind's pairs; only those are looked at."""
        x, y = (side["is_pos"].astype(bool) == (want == "p") for side, want in zip((rows, others), kind))
        part = sims[np.ix_(x, y)]
        return part.ravel() if kind == "pn" else part[rows["id"][x][:, None] < others["id"][y][None, :]]

    def look(rows, others, sims):
        out = []
        for kind in ("pp", "pn", "nn"):
            s = of(kind, rows, others, sims)
            b = np.clip(np.floor((s + 1) / width).astype(int), 0, bins - 1)
            n = np.bincount(b, minlength=bins)
            part = pd.DataFrame({"kind": kind, "bin": np.arange(bins), "n": n,
                                 "s": np.bincount(b, s, bins), "s2": np.bincount(b, s * s, bins)})
            out.append(part[part["n"] > 0])
        return pd.concat(out)

    cells = compare(flat, ["g"], look, "kind string, bin int, n long, s double, s2 double", **kw)
    hist = cut_lineage(cells.groupBy("kind", "bin").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2")))
    stats = {r["kind"]: r for r in hist.groupBy("kind").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2")).collect()}
    pp = stats.get("pp")
    mean = pp["s"] / pp["n"] if pp else 0.0
    edge = mean - max(0.0, pp["s2"] / pp["n"] - mean * mean) ** 0.5 if pp else 0.0

    def above(rows, others, sims):
        s = of("pn", rows, others, sims)
        return pd.DataFrame({"n": [len(s)], "hit": [int((s > edge).sum())]})

    share = compare(flat, ["g"], above, "n long, hit long", **kw).agg(
        (F.sum("hit") / F.sum("n")).alias("overlap"))
    summary = hist.agg(*[
        (F.sum(F.when(F.col("kind") == k, F.col("s"))) / F.sum(F.when(F.col("kind") == k, F.col("n"))))
        .alias(f"{k}_mean") for k in ("pp", "pn", "nn")])
    summary = summary.withColumn("pp_std", F.lit(mean - edge))
    # one row each
    return hist.select("kind", "bin", "n"), summary.withColumn("one", F.lit(1)).join(
        share.withColumn("one", F.lit(1)), "one").drop("one")


# -- coverage -------------------------------------------------------------------------------

def nearest_subtopic(texts: DataFrame, subtopics: DataFrame) -> DataFrame:
    """Nearest subtopic of every text: ``texts(msg_id, views[, prop])``, ``subtopics(prop,
    subtopic_idx, embedding)``; the lowest index wins a tie."""
    library = subtopics.select("prop", F.lit(True).alias("is_positive"),
                               F.col("subtopic_idx").alias("idx"),
                               F.col("subtopic_idx").alias("anchor_id"), "embedding")
    found = search(texts, library, 1, floor=False)
    return found.select("msg_id", "prop", F.col("top_id")[0].alias("subtopic_idx"))


def forced_assignment(assigned: DataFrame, forced: DataFrame) -> DataFrame:
    """A forced subtopic (by text) replaces the nearest one."""
    pins = forced.select("text", F.col("subtopic_idx").alias("forced_idx"))
    return assigned.join(pins, "text", "left").withColumn(
        "subtopic_idx", F.coalesce("forced_idx", "subtopic_idx")).drop("forced_idx")


def subtopic_coverage(assigned: DataFrame, subtopics: DataFrame) -> DataFrame:
    """Counts per subtopic including the empty ones, with their status."""
    counts = assigned.groupBy("prop", "subtopic_idx").agg(F.count(F.lit(1)).alias("n"))
    every = subtopics.select("prop", "subtopic_idx").join(counts, ["prop", "subtopic_idx"], "left") \
        .withColumn("n", F.coalesce("n", F.lit(0)))
    own = Window.partitionBy("prop")  # one row per subtopic here
    total = F.sum("n").over(own)
    equal = total / F.count(F.lit(1)).over(own)
    status = F.when(F.col("n") < equal * 0.6, "UNDERREPRESENTED").when(
        F.col("n") < equal * 0.9, "LOW").otherwise("OK")
    return every.select("prop", "subtopic_idx", "n", _share(F.col("n"), total).alias("share"),
                        status.alias("status"))


def subtopic_shortfall(coverage: DataFrame, target_n: int, floor: int) -> DataFrame:
    """Missing examples up to the fixed target max(floor, target_n // subtopics)."""
    k = F.count(F.lit(1)).over(Window.partitionBy("prop"))
    target = F.greatest(F.lit(floor), F.floor(F.lit(target_n) / k).cast("int"))
    return coverage.select("prop", "subtopic_idx", "n", target.alias("target")).withColumn(
        "shortfall", F.greatest(F.lit(0), F.col("target") - F.col("n")))


def boundary_quality(hard_pos: DataFrame, hard_neg: DataFrame, std_neg: DataFrame) -> DataFrame:
    """How many hard positives lie within 0.05 of the negatives and how many hard negatives
    are closer to the positives than standard negatives are on average. All three inputs
    are results of ``search`` against the anchors."""
    a = hard_pos.groupBy("prop").agg(
        F.count(F.lit(1)).alias("hard_pos"),
        F.count_if(F.col("max_neg") >= F.col("max_pos") - 0.05).alias("boundary_pos"))
    level = std_neg.groupBy("prop").agg(F.avg("max_pos").alias("level"))
    b = hard_neg.join(level, "prop").groupBy("prop").agg(
        F.count(F.lit(1)).alias("hard_neg"),
        F.count_if(F.col("max_pos") > F.col("level")).alias("boundary_neg"))
    return a.join(b, "prop", "full_outer")


def category_allocation(pool: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    a = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("pool_n"))
    b = selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("selected_n"))
    return a.join(b, keys, "left").withColumn("selected_n", F.coalesce("selected_n", F.lit(0)))


def drift_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Average drift of either class and the anchor that moved most:
    ``(anchor_id, is_positive, embedding)``."""
    old = before.select("anchor_id", "is_positive", F.col("embedding").alias("old"))
    new = after.select("anchor_id", F.col("embedding").alias("new"))
    c = old.join(new, "anchor_id").select(
        "anchor_id", "is_positive", F.round(cosine(F.col("old"), F.col("new")), 9).alias("c"))
    return c.agg(
        (1 - F.avg(F.when(F.col("is_positive"), F.col("c")))).alias("pos_drift"),
        (1 - F.avg(F.when(~F.col("is_positive"), F.col("c")))).alias("neg_drift"),
        F.min("c").alias("min_cos"),
        F.min_by("anchor_id", F.struct("c", "anchor_id")).alias("min_anchor"))


def soft_knn_eval(scores: DataFrame) -> DataFrame:
    """Accuracy at 0.5 and mean log loss from ``(prop, score, label 0/1)``."""
    s, y = F.col("score"), F.col("label").cast("double")
    loss = -y * F.log(s + 1e-10) - (1 - y) * F.log(1 - s + 1e-10)
    return scores.groupBy("prop").agg(
        F.avg(F.when((s > 0.5) == (y == 1), 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg(loss).alias("loss"))
