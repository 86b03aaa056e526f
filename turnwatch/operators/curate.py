"""Curation of anchor sets: duplicates, diversity, boundary cases, refinement."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from turnwatch.functions.vectors import bind, cosine, dot, exact_unit
from turnwatch.operators.grounding import knn_vote
from turnwatch.plans.layout import SEGMENT_ROWS, ranked
from turnwatch.plans.similarity import (
    BLOCK_ROWS, CELLS, SCALE, _vectors, compare, search, units)
from turnwatch.session import broadcast_if_small, cut_lineage, fits, new_folder, written

CENTRE_VALUES = 1_000_000  # values of all centres that a task of a k-means step may hold


# -- filters against existing anchors ------------------------------------------------------

def off_topic_filter(candidates: DataFrame, propositions: DataFrame, minimum: float = 0.15) -> DataFrame:
    """Candidates whose cosine to their proposition is at least ``minimum``."""
    joined = candidates.join(broadcast_if_small(propositions.select("prop", "prop_vec")), "prop")
    sim = F.round(cosine(F.col("embedding"), F.col("prop_vec")), 9)
    return joined.withColumn("prop_sim", sim).filter(F.col("prop_sim") >= minimum).drop("prop_vec")


def too_close_filter(candidates: DataFrame, positives: DataFrame, limit: float = 0.85, **kw) -> DataFrame:
    """Negatives that stay at or below ``limit`` to every positive of their proposition;
    0.92 is the limit for hard negatives."""
    best = _best_match(candidates, positives, **kw)
    return best.filter(F.coalesce(F.col("max_sim") <= limit, F.lit(True)))


def _best_only(items: DataFrame, refs: DataFrame, **kw) -> DataFrame:
    """Best similarity of each of ``items(id, prop, embedding)`` to ``refs(prop, id,
    embedding)`` of the same proposition: ``(id, prop, max_sim, match_id)``."""
    found = search(
        items.select(F.col("id").alias("msg_id"), F.array("embedding").alias("views"), "prop"),
        refs.select("prop", F.lit(True).alias("is_positive"), F.col("id").alias("idx"),
                    F.col("id").alias("anchor_id"), "embedding"), 1, floor=False, **kw)
    return found.select(F.col("msg_id").alias("id"), "prop", F.col("max_pos").alias("max_sim"),
                        F.col("top_id")[0].alias("match_id"))


def _best_match(items: DataFrame, refs: DataFrame, **kw) -> DataFrame:
    """The items with their best similarity; null where a proposition has no refs."""
    return items.join(_best_only(items, refs, **kw), ["id", "prop"], "left")


def novel_only(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose exact text is new; of equal candidates the lowest id stays. Copies are
    folded before the join, so a much repeated text is one row there."""
    key = F.sha2("text", 256).alias("key")  # digests travel, texts stay in the scan
    firsts = candidates.select(key, "id").groupBy("key").agg(F.min("id").alias("id"))
    new = firsts.join(existing.select(key).distinct(), "key", "left_anti")
    return candidates.join(new.select("id"), "id", "left_semi").select("text", "id")


def cross_dedup(candidates: DataFrame, existing: DataFrame, limit: float = 0.85, **kw) -> DataFrame:
    return too_close_filter(candidates, existing, limit, **kw)


def nearest_opposite(items: DataFrame, opposite: DataFrame, n: int = 10, **kw) -> DataFrame:
    """The ``n`` items of each proposition closest to the opposite class."""
    best = _best_only(items, opposite, **kw)
    rank = F.row_number().over(Window.partitionBy("prop").orderBy(F.desc("max_sim"), "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= n).select(
        "prop", "id", "max_sim", "match_id", "rank")


# -- duplicates -----------------------------------------------------------------------------

def _distinct_vectors(items: DataFrame, group: list[str]) -> DataFrame:
    """One row per distinct vector: an exact copy of an earlier item can neither be kept nor
    drop anything the first copy does not, so copies leave before any comparison."""
    first = F.min(F.struct("pos", "id")).alias("f")
    return items.groupBy(*group, "vec").agg(first).select(*group, "f.id", "f.pos", "vec")


def _zero(vec: str = "vec"):
    return dot(F.col(vec), F.col(vec)) == 0


def _fields(items: DataFrame, group: list[str]) -> str:
    return ", ".join(f"{g} {items.schema[g].dataType.simpleString()}" for g in group)


def _by_size(items: DataFrame, group: list[str], block_rows: int):
    """Rows of groups that fit a task, and rows of larger groups (None when there are none).
    Only the group columns are read to tell them apart."""
    big = items.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).filter(
        F.col("__n") > block_rows).select(*group)
    if big.isEmpty():
        return items, None
    big = broadcast_if_small(cut_lineage(big))
    return items.join(big, group, "left_anti"), items.join(big, group, "left_semi")


def _least_hit(threshold: float, inclusive: bool) -> float:
    """The least similarity that reaches ``threshold`` once it is rounded, so that unrounded ones need only be compared with it."""
    hit = np.greater_equal if inclusive else np.greater
    lo, hi = -2.0, 2.0
    while (mid := (lo + hi) / 2) not in (lo, hi):
        lo, hi = (lo, mid) if hit(np.rint(mid * SCALE) / SCALE, threshold) else (mid, hi)
    return hi


def _leads(vec: np.ndarray, least: float) -> np.ndarray:
    """For every unit vector in order the place of its seed: it joins the first seed that reaches it or becomes one."""
    lead = np.full(len(vec), -1)
    for i in range(len(vec)):
        if lead[i] < 0:
            lead[i] = i
            lead[i + 1:][(vec[i + 1:] @ vec[i] >= least) & (lead[i + 1:] < 0)] = i
    return lead


def _settle_in_task(items: DataFrame, group: list[str], threshold: float, inclusive: bool) -> DataFrame:
    """Leaders of groups that fit a task."""
    least = _least_hit(threshold, inclusive)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "id"]).reset_index(drop=True)
        lead = _leads(units(np.stack(pdf["vec"].to_list()).astype(np.float64)), least)
        return pdf[[*group, "id", "pos"]].assign(leader=pdf["id"].to_numpy()[lead])

    pos_type = items.schema["pos"].dataType.simpleString()
    return items.select(*group, "id", "pos", "vec").groupBy(*group).applyInPandas(
        settle, f"{_fields(items, group)}, id long, pos {pos_type}, leader long")


def _in_turn(items: DataFrame, group: list[str], block_rows: int) -> DataFrame:
    """Distinct vectors with a ``key`` (an id may come with several vectors), the ``turn`` their order gives them, four to
    a block, and the ``part`` of their group they are compared in."""
    rows = cut_lineage(_distinct_vectors(items, group).withColumn("key", F.monotonically_increasing_id()))
    places = ranked(rows.select(*group, "key", "pos", "id"), group, ["pos", "id", "key"]).select("key", "position")
    parts = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    return cut_lineage(rows.join(places, "key").join(broadcast_if_small(parts), group).select(
        *group, "key", "id", "pos", F.floor(F.col("position") / max(1, block_rows // 4)).alias("turn"),
        F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "parts", "vec"))


def _next_turns(open_: DataFrame, group: list[str], rows: int) -> DataFrame:
    """Per group the last turn (``until``) of the next ``rows`` open items, at least one turn."""
    along = Window.partitionBy(*group).orderBy("turn")  # a row per turn here
    turns = open_.groupBy(*group, "turn").agg(F.count(F.lit(1)).alias("n"))
    sums = turns.select(*group, "turn", F.sum("n").over(along).alias("so_far"), F.row_number().over(along).alias("nth"))
    return sums.filter((F.col("so_far") <= rows) | (F.col("nth") == 1)).groupBy(*group).agg(F.max("turn").alias("until"))


def _large_leaders(items: DataFrame, group: list[str], threshold: float, inclusive: bool, block_rows: int) -> DataFrame:
    """Leaders of the distinct vectors of groups that do not fit a task: ``(*group, id, pos, vec, leader, seed)``, without zero vectors.

    In each round the first open items of a group, about a block, are settled in one task. The later ones meet the seeds found
    there, part by part, and leave with the first seed that reaches them. So items are compared with seeds only, and once."""
    least, spark = _least_hit(threshold, inclusive), items.sparkSession
    open_ = _in_turn(items.filter(~_zero()), group, block_rows)
    kind = {f.name: f.dataType.simpleString() for f in open_.schema}
    columns = [*open_.columns, "leader", "seed"]
    kind |= {"leader": "long", "seed": "boolean"}
    out = ", ".join(f"{n} {kind[n]}" for n in columns)
    done, kept = new_folder(spark, "leaders"), [*group, "id", "pos", "vec", "leader", "seed"]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "id", "key"]).reset_index(drop=True)
        lead = _leads(units(np.stack(pdf["vec"].to_list()).astype(np.float64)), least)
        return pdf.assign(leader=pdf["id"].to_numpy()[lead], seed=lead == np.arange(len(pdf)))[columns]

    def meet(rows: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=columns)
        seeds = seeds.sort_values(["pos", "id", "key"])
        ids, vec = seeds["id"].to_numpy(), units(np.stack(seeds["vec"].to_list()).astype(np.float64)).T
        lead, reached = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        step = max(1, CELLS // len(ids))
        for lo in range(0, len(rows), step):
            near = units(np.stack(rows["vec"].iloc[lo:lo + step].to_list()).astype(np.float64)) @ vec >= least
            lead[lo:lo + step], reached[lo:lo + step] = ids[near.argmax(axis=1)], near.any(axis=1)
        return rows.assign(leader=pd.Series(lead, rows.index, "Int64").where(reached), seed=np.where(reached, False, None))[columns]

    while not open_.isEmpty():
        now = open_.join(broadcast_if_small(_next_turns(open_, group, block_rows)), group)
        first = written(now.filter(F.col("turn") <= F.col("until")).drop("until").groupBy(*group).applyInPandas(settle, out))
        seeds = first.filter("seed").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        later = now.filter(F.col("turn") > F.col("until")).drop("until")
        met = written(later.groupBy(*group, "part").cogroup(seeds.groupBy(*group, "part")).applyInPandas(meet, out))
        first.unionByName(met.filter(F.col("seed").isNotNull())).select(*kept) \
            .write.mode("append").parquet(done)
        open_ = met.filter(F.col("seed").isNull()).drop("leader", "seed")
    return spark.read.schema(", ".join(f"{n} {kind[n]}" for n in kept)).parquet(done)


def greedy_dedup(items: DataFrame, group: list[str], threshold: float, inclusive: bool = False,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Keep the first of every run of similar items: an item is dropped when its cosine to a
    kept earlier item exceeds the threshold. ``items(id long, pos, vec, *group)``. Groups
    within one block are settled in their task, larger ones block by block."""
    small, large = _by_size(items, group, block_rows)
    kept = _settle_in_task(small, group, threshold, inclusive).filter(
        F.col("leader") == F.col("id")).select(*group, "id", "pos")
    if large is None:
        return kept
    found = _large_leaders(large, group, threshold, inclusive, block_rows)
    return kept.unionByName(found.filter("seed").select(*group, "id", "pos")).unionByName(
        large.filter(_zero()).select(*group, "id", "pos"))


def leader_clusters(items: DataFrame, group: list[str], threshold: float = 0.85,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every item with the lowest seed it reaches (itself when it is a seed) and the size of
    that cluster. Seeds are the items greedy deduplication keeps."""
    small, large = _by_size(items, group, block_rows)
    members = _settle_in_task(small, group, threshold, True).select(*group, "id", "leader")
    if large is not None:
        # Copies of a vector share its leader.
        found = _large_leaders(large, group, threshold, True, block_rows).select(*group, "vec", "leader")
        zero = large.filter(_zero()).select(*group, "id", F.col("id").alias("leader"))
        members = members.unionByName(large.filter(~_zero()).select(*group, "id", "vec").join(
            found, [*group, "vec"]).select(*group, "id", "leader")).unionByName(zero)
    members = cut_lineage(members)  # ids only, used twice
    counts = members.groupBy(*group, "leader").agg(F.count(F.lit(1)).alias("cluster_size"))
    return members.join(counts, [*group, "leader"])


def drop_if_earlier_similar(items: DataFrame, group: list[str], threshold: float = 0.75,
                            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Axis rule: an item goes if any earlier item, kept or not, is too similar. ``pos`` is
    unique in its group."""
    fields = _fields(items, group)
    work = cut_lineage(_distinct_vectors(items.filter(~_zero()), group))

    def look(rows, others, sims):
        before = (others["pos"][None, :] < rows["pos"][:, None])
        near = ((sims > threshold) & before).any(axis=1)
        return pd.DataFrame({**{g: rows[g] for g in group}, "id": rows["id"]})[near]

    gone = compare(work, group, look, f"{fields}, id long", block_rows=block_rows)
    kept = work.select(*group, "id").join(gone.distinct(), [*group, "id"], "left_anti")
    return kept.unionByName(items.filter(_zero()).select(*group, "id"))


# -- diverse selection -------------------------------------------------------------------------

def balanced_quotas(pool: DataFrame, target_n: int) -> DataFrame:
    """Slots per category: small categories whole, the rest shared out, one extra for the
    largest. ``pool(prop, category, pos)``; ties follow first appearance."""
    sizes = pool.groupBy("prop", "category").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    all_ = Window.partitionBy("prop")  # one row per category here
    base = F.floor(F.lit(target_n) / F.count(F.lit(1)).over(all_))
    sizes = sizes.withColumn("whole", F.col("n") <= base)
    left = target_n - F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)).over(all_)
    open_ = F.count_if(~F.col("whole")).over(all_)
    place = F.row_number().over(all_.orderBy("whole", F.desc("n"), "first"))
    sizes = sizes.select("*", left.alias("left"), open_.alias("open"), place.alias("place"),
                         F.sum("n").over(all_).alias("total"))
    share = F.floor(F.col("left") / F.greatest(F.lit(1), F.col("open"))) + F.when(
        F.col("place") <= F.col("left") % F.greatest(F.lit(1), F.col("open")), 1).otherwise(0)
    quota = F.when((F.col("total") <= target_n) | F.col("whole"), F.col("n")).otherwise(share)
    return sizes.select("prop", "category", "n", quota.cast("int").alias("quota"))


def _lambda(step: int, quota: int, base: float, anneal: bool) -> float:
    """Weight of relevance for the pick after ``step`` further picks."""
    if not anneal or quota <= 2:
        return base
    high, low = min(0.8, base + 0.3), max(0.2, base - 0.3)
    return high + (low - high) * step / (quota - 2)


def diverse_picks(pool: DataFrame, group: list[str], base: float = 0.5, anneal: bool = True,
                  cap: int | None = None, task_rows: int = BLOCK_ROWS) -> DataFrame:
    """Maximal marginal relevance in every group at once. ``pool(*group, id, pos, vec,
    relevance, quota, cluster)``; with ``cap``, or a column of that name for a cap of each group, no
    cluster gives more than that many picks while another has candidates.

    A group that fits a task is picked there; a larger one stays spread over the cluster
    and takes one Spark round per pick."""
    types = {f.name: f.dataType.simpleString() for f in pool.schema}
    fields = ", ".join(f"{g} {types[g]}" for g in group)
    if cap is not None:
        pool = pool.withColumn("cap", F.lit(cap))
    capped = "cap" in pool.columns
    sizes = pool.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    sized = pool.withColumn("relevance", F.round("relevance", 9)).join(broadcast_if_small(sizes), group)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        quota, n = int(pdf["quota"].iloc[0]), len(pdf)
        if n <= quota:
            return pdf.assign(pick=np.arange(n))[[*group, "id", "pick"]]
        vec = units(np.stack(pdf["vec"].to_list()).astype(np.float64))
        rel, cluster = pdf["relevance"].to_numpy(), pdf["cluster"].to_numpy()
        near = np.full(n, -np.inf)
        free = np.ones(n, bool)
        used: dict = {}
        order = []
        for step in range(quota):
            if step == 0:
                score = rel.copy()
            else:
                lam = _lambda(step - 1, quota, base, anneal)
                score = lam * rel - (1 - lam) * near
                if capped:
                    full = np.array([used.get(c, 0) >= pdf["cap"].iloc[0] for c in cluster])
                    score = np.where(full, -np.inf, score)
            score = np.where(free, score, -np.inf)
            at = int(score.argmax()) if np.isfinite(score.max()) else int(free.argmax())
            order.append(at)
            free[at] = False
            used[cluster[at]] = used.get(cluster[at], 0) + 1
            near = np.maximum(near, np.rint(vec @ vec[at] * SCALE) / SCALE)
        return pdf.iloc[order].assign(pick=np.arange(len(order)))[[*group, "id", "pick"]]

    schema = f"{fields}, id long, pick int"
    small = sized.filter((F.col("__n") <= task_rows) & (F.col("quota") > 0)).drop("__n")
    out = small.groupBy(*group).applyInPandas(pick, schema)
    large = sized.filter((F.col("__n") > task_rows) & (F.col("quota") > 0))
    if large.isEmpty():
        return out
    whole = large.filter(F.col("__n") <= F.col("quota"))
    out = out.unionByName(ranked(whole.select(*group, "id", "pos"), group, ["pos"], "pick")
                          .select(*group, "id", F.col("pick").cast("int").alias("pick")))
    return out.unionByName(_pick_rounds(
        large.filter(F.col("__n") > F.col("quota")), group, base, anneal, capped))


def _pick_rounds(pool: DataFrame, group: list[str], base: float, anneal: bool, capped: bool) -> DataFrame:
    limit = ["cap"] if capped else []
    state = cut_lineage(pool.select(
        *group, "id", "pos", exact_unit(F.col("vec")).alias("u"), "relevance", "quota", "cluster", *limit,
        F.lit(None).cast("double").alias("near"), F.lit(0).alias("used"),
        F.lit(None).cast("int").alias("pick")))
    rounds = state.agg(F.max("quota")).first()[0] or 0
    for step in range(rounds):
        lam = F.lit(base)
        if anneal:
            high, low = min(0.8, base + 0.3), max(0.2, base - 0.3)
            lam = F.when(F.col("quota") > 2, high + (low - high) * F.lit(step - 1) / (F.col("quota") - 2)) \
                .otherwise(base)
        score = F.col("relevance") if step == 0 else lam * F.col("relevance") - (1 - lam) * F.col("near")
        allowed = F.lit(True) if not capped or step == 0 else F.col("used") < F.col("cap")
        best = state.filter(F.col("pick").isNull() & (F.col("quota") > step)).groupBy(*group).agg(
            F.max_by(F.struct("id", "u", "cluster"),
                     F.struct(allowed, F.when(allowed, score), -F.col("pos"))).alias("b"))
        best = best.select(*group, F.col("b.id").alias("bid"), F.col("b.u").alias("bu"),
                           F.col("b.cluster").alias("bc"))
        joined = state.join(broadcast_if_small(best, 50_000), group, "left")
        sim = F.round(dot(F.col("u"), F.col("bu")), 9)
        state = written(joined.select(
            *group, "id", "pos", "u", "relevance", "quota", "cluster", *limit,
            F.greatest("near", sim).alias("near"),
            (F.col("used") + F.coalesce((F.col("bc") == F.col("cluster")).cast("int"), F.lit(0))).alias("used"),
            F.when(F.col("bid") == F.col("id"), F.lit(step)).otherwise(F.col("pick")).alias("pick")))
    return state.filter(F.col("pick").isNotNull()).select(*group, "id", "pick")


def mmr_balanced(pool: DataFrame, propositions: DataFrame, target_n: int, base: float = 0.5,
                 anneal: bool = True, task_rows: int = BLOCK_ROWS) -> DataFrame:
    """Category-balanced selection: quotas first, then diverse picks per category.
    ``pool(prop, category, id, pos, vec)``, ``propositions(prop, prop_vec)``."""
    quotas = balanced_quotas(pool, target_n).select("prop", "category", "quota")
    rows = (pool.join(broadcast_if_small(quotas), ["prop", "category"])
            .join(broadcast_if_small(propositions.select("prop", "prop_vec")), "prop")
            .withColumn("relevance", cosine(F.col("vec"), F.col("prop_vec"))).drop("prop_vec")
            .withColumn("cluster", F.lit(0)))
    return diverse_picks(rows, ["prop", "category"], base, anneal, task_rows=task_rows)


def _distances(vec: Column, centres: Column) -> Column:
    """Squared distances to every centre, to nine decimals so that ties are the same everywhere."""
    def squared(c):
        apart = F.zip_with(vec, c, lambda x, y: x.cast("double") - y)
        return F.round(F.aggregate(apart, F.lit(0.0), lambda acc, x: acc + x * x), 9)
    return F.transform(centres, squared)


def _farthest_first(items: DataFrame, group: list[str], most: int) -> DataFrame:
    """``(*group, k, centres)``: the item of lowest id, then always the one farthest from the seeds so far
    (ties to the lower id). A round is one aggregate of all groups; only the seeds are written."""
    of = [*group, "k"]
    first = items.groupBy(*of).agg(F.min_by("vec", "id").alias("vec"))
    seeds = cut_lineage(first.select(*of, F.array(F.transform("vec", lambda x: x.cast("double"))).alias("centres")))
    for _ in range(1, most):
        met = items.join(broadcast_if_small(seeds), of).filter(F.size("centres") < F.col("k"))
        far = met.select(*group, "id", "vec", F.array_min(_distances(F.col("vec"), F.col("centres"))).alias("d")).filter("d > 0")
        best = far.groupBy(*group).agg(F.max_by("vec", F.struct("d", -F.col("id"))).alias("next"))
        added = F.when(F.col("next").isNull(), F.col("centres")).otherwise(
            F.concat("centres", F.array(F.transform("next", lambda x: x.cast("double")))))
        seeds = written(seeds.join(best, group, "left").select(*of, added.alias("centres")))
    return seeds


def _settle_clusters(pdf: pd.DataFrame, rounds: int) -> pd.DataFrame:
    """The clusters of one group that fits a task, by the same steps."""
    pdf = pdf.sort_values("id").reset_index(drop=True)
    v = np.stack(pdf["vec"].to_list()).astype(np.float64)

    def away(centre):
        return np.rint(((v - centre) ** 2).sum(axis=1) * SCALE) / SCALE
    centres, near = [v[0]], away(v[0])
    while len(centres) < pdf["k"].iloc[0] and near.max() > 0:
        centres.append(v[near.argmax()])
        near = np.minimum(near, away(centres[-1]))
    centres = np.array(centres)
    for _ in range(rounds):
        cluster = np.stack([away(c) for c in centres]).argmin(axis=0)
        new = np.array([v[cluster == i].mean(axis=0) if (cluster == i).any() else c for i, c in enumerate(centres)])
        moved = np.abs(new - centres).max() > 1e-9
        centres = new
        if not moved:
            break
    return pdf.assign(cluster=np.stack([away(c) for c in centres]).argmin(axis=0))


def grouped_kmeans(items: DataFrame, group: list[str], rounds: int = 20, task_rows: int = BLOCK_ROWS) -> DataFrame:
    """k-means in every group at once: ``items(*group, id, vec, k)`` with ``cluster`` added; ``k`` is the same in
    all rows of a group and ids are told apart. Seeds are chosen farthest first, so the result depends on the
    rows alone; a group with fewer distinct vectors than ``k`` has as many clusters as those.

    A group that fits a task is clustered there. For larger ones each of at most ``rounds`` Lloyd steps is one
    aggregate of all of them keyed by (group, cluster), combined before the shuffle; the steps end when no centre
    moves. Few centres go to the tasks that add up the items nearest to each; many are joined. A cluster that loses its items keeps its centre. Rows without a vector are left out."""
    items = items.filter(F.col("vec").isNotNull())
    sizes = items.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    sized = items.join(broadcast_if_small(sizes), group)
    small = sized.filter(F.col("__n") <= task_rows).select(*items.columns)
    schema = StructType([*small.schema.fields, StructField("cluster", IntegerType())])
    out = small.groupBy(*group).applyInPandas(lambda pdf: _settle_clusters(pdf, rounds), schema)
    large = sized.filter(F.col("__n") > task_rows).select(*items.columns)
    return out if large.isEmpty() else out.unionByName(_cluster_rounds(cut_lineage(large), group, rounds))


def _cluster_rounds(items: DataFrame, group: list[str], rounds: int) -> DataFrame:
    of = [*group, "k"]
    centres = _farthest_first(items, group, items.agg(F.max("k")).first()[0])
    if (centres.agg(F.sum(F.size(F.flatten("centres")))).first()[0] or 0) <= CENTRE_VALUES:
        centres, rounds = _shared_rounds(items, centres, group, rounds), 0

    def assigned(now):
        d = _distances(F.col("vec"), F.col("centres"))
        near = bind(d, lambda x: F.array_position(x, F.array_min(x)) - 1).cast("int")
        return items.join(broadcast_if_small(now.select(*of, "centres")), of).withColumn("cluster", near)

    for _ in range(rounds):
        means = assigned(centres).groupBy(*group, "cluster").agg(
            Summarizer.mean(array_to_vector(F.transform("vec", lambda x: x.cast("double")))).alias("m"))
        lists = means.groupBy(*group).agg(F.map_from_entries(F.collect_list(  # at most k entries
            F.struct("cluster", vector_to_array("m").alias("m")))).alias("by"))
        new = F.transform("centres", lambda c, i: F.coalesce(F.col("by")[i], c))
        moved = F.exists(F.zip_with("centres", new, lambda a, b: F.exists(
            F.zip_with(a, b, lambda x, y: F.abs(x - y) > 1e-9), lambda far: far)), lambda far: far)
        centres = written(centres.join(lists, group).select(*of, new.alias("centres"), moved.alias("moved")))
        if centres.filter("moved").isEmpty():
            break
        centres = centres.drop("moved")
    return assigned(centres).select(*items.columns, "cluster")


def _shared_rounds(items: DataFrame, centres: DataFrame, group: list[str], rounds: int) -> DataFrame:
    """The centres after at most ``rounds`` Lloyd steps. A step is one job: tasks get all centres (their size was checked by the
    caller), add up the items nearest to each, and the sums of a (group, cluster) are added up after the shuffle."""
    rows = centres.collect()
    known = items.sparkSession.createDataFrame(
        [(*[r[g] for g in group], i) for i, r in enumerate(rows)],
        StructType([*[items.schema[g] for g in group], StructField("__at", IntegerType())]))
    vectors = cut_lineage(items.join(broadcast_if_small(known), group).select(
        "__at", F.transform("vec", lambda x: x.cast("double")).alias("vec")))  # read in every step
    now = [np.array(r["centres"], np.float64) for r in rows]
    for _ in range(rounds):
        sums = vectors.mapInArrow(_adder(now), "at int, cluster int, s array<double>, n long").groupBy("at", "cluster").agg(
            Summarizer.sum(array_to_vector("s")).alias("s"), F.sum("n").alias("n")).collect()  # a row per centre
        far = 0.0
        new = [c.copy() for c in now]
        for r in sums:
            new[r["at"]][r["cluster"]] = r["s"].toArray() / r["n"]
            far = max(far, np.abs(new[r["at"]][r["cluster"]] - now[r["at"]][r["cluster"]]).max())
        now = new
        if not far > 1e-9:
            break
    return items.sparkSession.createDataFrame(
        [(*[r[g] for g in group], r["k"], c.tolist()) for r, c in zip(rows, now)], centres.schema)


def _adder(centres: list[np.ndarray]):
    """For a task: the sum and the number of its items nearest to each centre, one row per centre that has any."""
    def add(batches):
        sums, counts = [np.zeros_like(c) for c in centres], [np.zeros(len(c), np.int64) for c in centres]
        for batch in batches:
            at, vec = batch.column(0).to_numpy(), _vectors(batch.column(1)) if batch.num_rows else None
            for i in np.unique(at):
                mine = vec[at == i]
                near = np.stack([np.rint(((mine - c) ** 2).sum(axis=1) * SCALE) / SCALE for c in centres[i]]).argmin(axis=0)
                for j in range(len(centres[i])):
                    sums[i][j] += mine[near == j].sum(axis=0)
                counts[i] += np.bincount(near, minlength=len(centres[i]))
        some = [(i, j) for i, n in enumerate(counts) for j in np.flatnonzero(n)]
        yield pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in some], pa.int32()), pa.array([j for _, j in some], pa.int32()),
            pa.array([sums[i][j].tolist() for i, j in some], pa.list_(pa.float64())),
            pa.array([counts[i][j] for i, j in some], pa.int64())], names=["at", "cluster", "s", "n"])
    return add


def mmr_clusters(pool: DataFrame, propositions: DataFrame, target_n: int, base: float = 0.5, anneal: bool = True,
                 cap: int | None = None, rounds: int = 20, task_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cluster-capped selection for every proposition at once: ``pool(prop, category, id, pos, vec)``,
    ``propositions(prop, prop_vec)``. A pool of at most ``target_n`` items is taken whole."""
    shape = pool.groupBy("prop").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("category").alias("c"))
    k = F.least(F.col("n") - 1, F.greatest(F.lit(4), 2 * F.col("c")))
    most = F.lit(cap) if cap is not None else F.greatest(F.lit(3), F.floor(F.lit(target_n) / F.col("k")) * 2)
    shape = shape.withColumn("k", F.greatest(F.lit(1), k).cast("int")).select("prop", "n", "k", most.cast("int").alias("cap"))
    rows = (pool.join(broadcast_if_small(shape), "prop")
            .join(broadcast_if_small(propositions.select("prop", "prop_vec")), "prop")
            .withColumn("relevance", cosine(F.col("vec"), F.col("prop_vec"))).drop("prop_vec")
            .withColumn("quota", F.lit(target_n)))
    small = rows.filter(F.col("n") <= target_n).withColumn("cluster", F.lit(0))
    large = cut_lineage(grouped_kmeans(rows.filter(F.col("n") > target_n), ["prop"], rounds, task_rows))  # read several times
    return diverse_picks(large.unionByName(small).drop("n", "k"), ["prop"], base, anneal, None, task_rows)


def mmr_cluster(pool: DataFrame, prop_vec: list[float], target_n: int, base: float = 0.5,
                anneal: bool = True, cap: int | None = None, task_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cluster-capped selection from one proposition's pool ``(id, pos, vec, category)``."""
    one = pool.sparkSession.createDataFrame([(0, [float(x) for x in prop_vec])], "prop int, prop_vec array<double>")
    return mmr_clusters(pool.withColumn("prop", F.lit(0)), one, target_n, base, anneal, cap, task_rows=task_rows).drop("prop")


# -- boundary and mining -------------------------------------------------------------------------

def low_margin(items: DataFrame, share: float = 0.25, min_class: int = 10, min_hits: int = 5,
               segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Items nearest to a linear separator of the classes: ``items(id, vec, label 0/1)``.
    The cut-off is the exact percentile, found by rank so that no task holds all margins."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array
    schema = "id long, label int, vec array<float>, margin double, cluster int"
    counts = items.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    empty = items.sparkSession.createDataFrame([], schema).drop("cluster")
    if min(counts["p"], counts["n"]) < min_class:
        return empty
    total = counts["p"] + counts["n"]
    data = items.withColumn("features", array_to_vector(F.transform("vec", lambda x: x.cast("double")))) \
        .withColumn("label", F.col("label").cast("double"))
    model = LogisticRegression(maxIter=500, regParam=1.0 / total, standardization=False).fit(data)
    scored = model.transform(data).select(
        "id", F.col("label").cast("int").alias("label"), "vec",
        F.abs(vector_to_array("rawPrediction")[1]).alias("margin"))
    scored = cut_lineage(scored)
    place = (total - 1) * share
    order = ranked(scored.select("margin", "id", F.lit(1).alias("one")), ["one"], ["margin", "id"],
                   segment_rows=segment_rows)
    ends = {r["position"]: r["margin"] for r in order.filter(
        F.col("position").isin(math.floor(place), math.ceil(place))).collect()}
    lo, hi = ends[math.floor(place)], ends[math.ceil(place)]
    cut = lo + (hi - lo) * (place - math.floor(place))
    hits = scored.filter(F.col("margin") <= cut)
    return hits if not fits(hits, min_hits - 1) else empty


def weak_zones(low: DataFrame, texts: DataFrame, per_zone: int = 6) -> DataFrame:
    """Clusters of low-margin items: size, the first examples and the class to add."""
    low = cut_lineage(low)
    whole = low.withColumns({"__g": F.lit(0), "k": F.lit(min(5, max(2, low.count() // 5)))})
    return zone_report(grouped_kmeans(whole.select("__g", "id", "label", "vec", "k"), ["__g"], rounds=300), texts, per_zone)


def zone_report(zones: DataFrame, texts: DataFrame, per_zone: int = 6) -> DataFrame:
    """What ``weak_zones`` says of given zones ``(id, label, cluster)``."""
    sizes = zones.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= 2)
    head = F.row_number().over(Window.partitionBy("cluster").orderBy("id"))
    first = (zones.withColumn("nth", head).filter(F.col("nth") <= per_zone)
             .join(texts.select("id", "text"), "id", "left"))
    shown = first.groupBy("cluster").agg(
        F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"),
        F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]).alias("texts"))
    need = F.when(F.col("n_pos") < F.col("n_neg"), "positive").when(
        F.col("n_neg") < F.col("n_pos"), "negative").otherwise("both")
    return sizes.join(shown, "cluster").withColumn("add", need)


def hard_mining(scored: DataFrame, level: float = 0.50) -> DataFrame:
    """Labelled queries the vote gets wrong: ``scored(msg_id, prop, score, label 0/1)``."""
    hit = F.col("score") > level
    kind = F.when(hit & (F.col("label") == 0), "false_positive").when(
        ~hit & (F.col("label") == 1), "false_negative")
    return scored.withColumn("failure", kind).filter(F.col("failure").isNotNull()).select(
        "msg_id", "prop", "score", "failure")


def fix_budget(failures: DataFrame) -> DataFrame:
    """How many new examples to ask for: three per failure, at most fifteen."""
    return failures.groupBy("prop", "failure").agg(
        F.least(F.lit(15), 3 * F.count(F.lit(1))).alias("budget"))


def adversarial_rank(found: DataFrame, k: int = 20) -> DataFrame:
    """Candidates with the share of positives among their neighbours, a risk band, and ``rank``: 0 for
    the most dangerous of a proposition (share, then best similarity, then id)."""
    s = F.col("score")
    risk = F.when(s >= 0.7, "high").when(s >= 0.4, "medium").otherwise("low")
    rows = cut_lineage(  # read several times by the ranking
        knn_vote(found, k).select("msg_id", "prop", "score", "max_pos", risk.alias("risk")))
    order = rows.withColumn("__share", -F.col("score")).withColumn("__best", -F.col("max_pos"))
    return ranked(order, ["prop"], ["__share", "__best", "msg_id"], "rank").select(
        *rows.columns, F.col("rank").cast("int").alias("rank"))


# -- merging and sampling ----------------------------------------------------------------------------

def merge_anchor_sets(parts: list[DataFrame]) -> DataFrame:
    """Union of anchor sets ``(prop, category, idx, text)``; a category keeps its order and is
    extended by later sets."""
    rows = None
    for i, part in enumerate(parts):
        tagged = part.select("prop", "category", "idx", "text", F.lit(i).alias("source"))
        rows = tagged if rows is None else rows.unionByName(tagged)
    return ranked(rows, ["prop", "category"], ["source", "idx"], "new_idx")


def replace_low_variance(originals: DataFrame, replacements: DataFrame) -> DataFrame:
    """Keep the first third (at least one) of a category, add replacements, cap at n + 2.
    Both inputs are ``(category, idx, text)``."""
    sizes = originals.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    keep = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    old = ranked(originals, ["category"], ["idx"]).join(broadcast_if_small(sizes), "category") \
        .filter(F.col("position") < keep).select("category", "text", F.lit(0).alias("part"), F.col("position"))
    new = ranked(replacements, ["category"], ["idx"]).select(
        "category", "text", F.lit(1).alias("part"), "position")
    merged = ranked(old.unionByName(new).withColumnRenamed("position", "at"), ["category"], ["part", "at"])
    return merged.join(broadcast_if_small(sizes), "category").filter(
        F.col("position") < F.col("n") + 2).select("category", "text", "part", "position")


def _shuffled(id_col: str, seed: int) -> Column:
    """A key to shuffle by that other engines can compute too."""
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def stratified_folds(items: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Fold number per item: position modulo k in a seeded shuffle of its class."""
    mixed = items.withColumn("__h", _shuffled("id", seed))
    return ranked(mixed, ["label"], ["__h", "id"]).withColumn(
        "fold", (F.col("position") % k).cast("int")).drop("__h", "position")


def balance_classes(items: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """First rows of either class, as many as the smaller class has."""
    sizes = items.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    smallest = sizes.agg(F.min("n")).first()[0] or 0
    return ranked(items, ["label"], ["idx"], segment_rows=segment_rows).filter(
        F.col("position") < smallest)


def few_shot_sample(items: DataFrame, clusters: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """Prompt examples: the leader of every cluster, filled up to ``n`` by a seeded sample.
    Up to ``n`` items are taken whole."""
    if fits(items, n):
        return items.select("id").withColumn("is_leader", F.lit(False))
    leaders = clusters.filter((F.col("cluster_size") > 1) & (F.col("leader") == F.col("id"))) \
        .select("id", F.lit(True).alias("is_leader"))
    need = max(0, n - leaders.count())
    rest = items.join(leaders, "id", "left_anti").select("id", F.lit(False).alias("is_leader")) \
        .orderBy(_shuffled("id", seed), "id").limit(need)
    return leaders.unionByName(rest)


# -- refinement of anchor vectors -----------------------------------------------------------------------

def _pull_back(new: np.ndarray, old: np.ndarray, minimum: float) -> np.ndarray:
    """Blend vectors that left the cone around their original back to its edge."""
    def cos(x):
        return (x * old).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(old, axis=1) + 1e-10)
    out = cos(new) < minimum
    lo, hi = np.zeros(len(new)), np.ones(len(new))
    for _ in range(20):
        mid = (lo + hi) / 2
        short = cos(mid[:, None] * old + (1 - mid)[:, None] * new) < minimum
        lo, hi = np.where(short, mid, lo), np.where(short, hi, mid)
    return np.where(out[:, None], hi[:, None] * old + (1 - hi)[:, None] * new, new)


def _rows(column) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def soft_vote_sums(examples: DataFrame, anchors: DataFrame, k: int, temp: float, runs: list[int] | None = None, **kw) -> DataFrame:
    """One pass of several runs over labelled examples: what the gradient of the soft vote's loss needs.
    ``examples(key long, vec, label 0/1, fold)``, ``anchors(run int, key long, is_positive, idx, embedding)``.
    Run f trains on every fold but f; run -1 trains on all.

    Gives ``(run, key, v)``. For an anchor ``v`` holds the sum of d q and, as its last value, of d cos over
    the training examples q that have it among their ``k`` nearest, d being the loss's slope in that cosine.
    Key -1 counts examples, right answers and loss, for training and then for held-out examples.

    Anchors are searched like any library, in blocks when they are many; a task adds up every few
    thousand examples before anything is shuffled. ``runs`` that still have the same anchors are searched once: ``anchors``
    then holds one run, which stands for all of them."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    library = anchors.select(F.col("run").alias("prop"), "is_positive", "idx", F.col("key").alias("anchor_id"), "embedding")
    found = search(examples.select(F.col("key").alias("msg_id"), F.array("vec").alias("views")), library, k, floor=False, **kw)
    rows = found.select(F.col("msg_id").alias("key"), F.col("prop").alias("run"), "top_sim", "top_pos", "top_id") \
        .join(examples, "key").select("run", "vec", "label", "fold", "top_sim", "top_pos", "top_id")
    if runs:
        rows = rows.withColumn("run", F.explode(F.array(*[F.lit(r) for r in runs])))

    def add_up(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            step = max(1, CELLS // (len(pdf["top_id"].iloc[0]) * len(pdf["vec"].iloc[0]) or 1))
            for lo in range(0, len(pdf), step):
                yield from add_part(pdf.iloc[lo:lo + step])

    def add_part(pdf):
        q, s = units(_rows(pdf["vec"])), _rows(pdf["top_sim"])
        hit, ids = _rows(pdf["top_pos"]), np.stack(pdf["top_id"].to_list())
        y, run = pdf["label"].to_numpy(float), pdf["run"].to_numpy(np.int64)
        w = np.exp((s - s[:, :1]) / temp)
        w /= w.sum(1, keepdims=True)
        raw = (w * hit).sum(1)
        score = np.clip(raw, 1e-7, 1 - 1e-7)
        loss = -y * np.log(score + 1e-10) - (1 - y) * np.log(1 - score + 1e-10)
        right = (score > 0.5) == (y == 1)
        train = pdf["fold"].to_numpy(np.int64) != run
        for r in np.unique(run):
            tally = [f(at & (run == r)) for at in (train, ~train)
                     for f in (np.sum, lambda m: right[m].sum(), lambda m: loss[m].sum())]
            yield pd.DataFrame({"run": [r], "key": [-1], "vals": [np.array(tally, np.float64)]})
        inside = (raw > 1e-7) & (raw < 1 - 1e-7) & train
        slope = np.where(inside, -y / (score + 1e-10) + (1 - y) / (1 - score + 1e-10), 0.0)
        d = slope[:, None] * w * (hit - raw[:, None]) / temp
        row, col = np.nonzero(d)
        if not len(row):
            return
        d, owner = d[row, col], np.stack([run[row], ids[row, col]], axis=1)
        order = np.lexsort((owner[:, 1], owner[:, 0]))
        owner = owner[order]
        first = np.flatnonzero(np.append(True, (np.diff(owner, axis=0) != 0).any(axis=1)))
        parts = np.column_stack([d[:, None] * q[row], d * s[row, col]])[order]
        yield pd.DataFrame({"run": owner[first, 0], "key": owner[first, 1], "vals": list(np.add.reduceat(parts, first, axis=0))})

    parts = rows.mapInPandas(add_up, "run int, key long, vals array<double>")
    return parts.groupBy("run", "key").agg(Summarizer.sum(array_to_vector("vals")).alias("v")).select(
        "run", "key", vector_to_array("v").alias("v"))


def _gradient(vec: np.ndarray, sums) -> np.ndarray:
    """Gradient of the summed loss at ``vec``: d cos / d anchor = (q - cos * a) / |anchor|."""
    size = np.linalg.norm(vec, axis=1, keepdims=True) + 1e-10
    both = np.stack([np.zeros(vec.shape[1] + 1) if v is None else np.asarray(v, np.float64) for v in sums])
    return (both[:, :-1] - both[:, -1:] * (vec / size)) / size


def loss_gradient(anchors: DataFrame, sums: DataFrame) -> DataFrame:
    """``(run, key, gradient)`` of the loss summed over the training examples, for ``anchors(run, key, embedding)``
    and their ``soft_vote_sums``; anchors that are nobody's neighbour have a gradient of zeros."""
    def work(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf[["run", "key"]].assign(gradient=list(_gradient(_rows(pdf["embedding"]), pdf["v"])))

    return anchors.select("run", "key", "embedding").join(sums, ["run", "key"], "left").mapInPandas(
        work, "run int, key long, gradient array<double>")


_STATE = ("run int, key long, is_positive boolean, idx long, start array<double>, embedding array<double>, "
          "mean array<double>, spread array<double>")


def _step(seen: DataFrame, n_train: dict[int, int], epoch: int, rate: float, reg: float, minimum: float) -> DataFrame:
    """The anchors after one Adam step from ``seen``, the state joined with its sums."""
    def move(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            now, start = _rows(pdf["embedding"]), _rows(pdf["start"])
            share = pdf["run"].map(lambda r: max(1, n_train[r])).to_numpy(float)[:, None]
            grad = _gradient(now, pdf["v"]) / share + 2 * reg * (now - start)
            mean = 0.9 * _rows(pdf["mean"]) + 0.1 * grad
            spread = 0.999 * _rows(pdf["spread"]) + 0.001 * grad ** 2
            change = (mean / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(spread / (1 - 0.999 ** (epoch + 1))) + 1e-8)
            yield pdf.drop(columns="v").assign(embedding=list(_pull_back(now - rate * change, start, minimum)),
                                               mean=list(mean), spread=list(spread))

    return seen.mapInPandas(move, _STATE)


def anchor_refine(anchors: DataFrame, examples: DataFrame, epochs: int = 10, folds: int = 5,
                  rate: float = 0.001, reg: float = 0.01, temperature: float = 0.05, k: int = 20,
                  min_similarity: float = 0.85, patience: int = 5, seed: int = 42, **kw) -> DataFrame:
    """Move anchor vectors so that the soft vote fits labelled examples. The number of epochs is the one
    with the best mean held-out accuracy.

    ``anchors(anchor_id, is_positive, embedding)``, ``examples(id, vec, label 0/1)``. Rows with equal ids are
    anchors of their own. Examples without a vector or label take no part. Without examples the anchors stay
    as they are; without anchors the result is empty.

    Anchors of all folds and their optimiser state are one table, a row per (run, anchor). An epoch is one
    pass over the examples, whose sums are joined to that table and written by its one checkpoint; the step is a
    projection of what was written. Only six counts per run reach the driver. ``kw`` goes to ``search``."""
    table = cut_lineage(anchors.select(
        F.monotonically_increasing_id().alias("key"), "anchor_id", "is_positive",
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))
    known = examples.filter(F.col("vec").isNotNull() & F.col("label").isNotNull())
    data = cut_lineage(stratified_folds(known, folds, seed).select(
        F.monotonically_increasing_id().alias("key"), "vec", "label", "fold"))
    per_fold = {r["fold"]: r["n"] for r in data.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(per_fold.values())
    n_train = {r: total - per_fold.get(r, 0) for r in range(-1, folds)}

    def look(state, runs=None):
        library = state.filter(F.col("run") == runs[0]) if runs else state
        sums = soft_vote_sums(data, library, k, temperature, runs, **kw)
        seen = cut_lineage(state.join(sums, ["run", "key"], "full"))
        tally = {r["run"]: r["v"] for r in seen.filter(F.col("key") == -1).select("run", "v").collect()}
        return seen.filter(F.col("key") >= 0), tally

    # Every run, the last one on all examples included, starts from the same anchors.
    starts = [*range(folds), -1]
    zeros = F.transform("embedding", lambda x: F.lit(0.0))
    begun, _ = look(table.withColumn("run", F.explode(F.array(*[F.lit(r) for r in starts]))).select(
        "run", "key", "is_positive", F.col("anchor_id").cast("long").alias("idx"),
        F.col("embedding").alias("start"), "embedding", zeros.alias("mean"), zeros.alias("spread")), starts)

    def train(runs, epochs_to_run, held_out):
        history = {r: [] for r in runs}
        best = {r: (0.0, 0) for r in runs}  # accuracy, epochs without gain
        live = set(runs)
        seen = begun
        for epoch in range(epochs_to_run):
            now = rate * 0.1 + (rate - rate * 0.1) * (1 + math.cos(math.pi * epoch / epochs_to_run)) / 2
            state = _step(seen.filter(F.col("run").isin(sorted(live))), n_train, epoch, now, reg, min_similarity)
            if not held_out and epoch == epochs_to_run - 1:
                break
            seen, tally = look(state)
            if held_out:
                for r in sorted(live):
                    counts = tally.get(r, [0.0] * 6)
                    acc = counts[4] / max(1.0, counts[3])
                    history[r].append(acc)
                    gain = acc > best[r][0]
                    best[r] = (acc, 0) if gain else (best[r][0], best[r][1] + 1)
                    if best[r][1] >= patience:
                        live.discard(r)
                if not live:
                    break
        return state, history

    _, history = train(list(range(folds)), epochs, True)
    shortest = min(len(h) for h in history.values())
    means = [sum(h[e] for h in history.values()) / folds for e in range(shortest)]
    chosen = max(range(shortest), key=lambda e: means[e]) + 1
    final, _ = train([-1], chosen, False)
    moved = cut_lineage(final.select("key", "embedding"))
    return table.select("key", "anchor_id", "is_positive").join(moved, "key").select(
        F.col("anchor_id").cast("long").alias("anchor_id"), "is_positive", "embedding", F.lit(chosen).alias("epochs"))
