"""Grounding: votes over nearest anchors, re-ranking, hybrid votes, judges.

``search`` gives one row per (message, proposition) with its short list of anchors
in arrays, so every vote below is a projection: no shuffle after the search.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwatch.functions.prompts import CONTEXT_HEAD, CONTEXT_TEMPLATE, fill, judge_fields
from turnwatch.functions.vectors import bind
from turnwatch.plans.similarity import search

# Default vote parameters.
MATCH, WARNING = 0.55, 0.45
COSINE_K, NLI_RETRIEVE_K, NLI_VOTE_K, HYBRID_POOL = 20, 40, 20, 40
FORWARD_WEIGHT, ABSTAIN_MARGIN = 0.7, 0.15
VOTER_CHARS = 60
TEXT_BYTES = 128_000_000   # texts of anchors that a task holds
PROMPT_BYTES = 16_000_000  # texts that it hands on at a time


def verdict(score: Column, match: float = MATCH, warning: float = WARNING,
            inclusive: bool = False) -> Column:
    """MATCH / WARNING / NO MATCH; thresholds are exclusive unless asked otherwise."""
    over = (lambda t: score >= t) if inclusive else (lambda t: score > t)
    return F.when(over(match), "MATCH").when(over(warning), "WARNING").otherwise("NO MATCH")


def vote_margin(pos: Column, neg: Column) -> Column:
    return F.abs(pos - neg) / F.greatest(F.lit(1), pos + neg)


def abstains(pos: Column, neg: Column, margin: float = ABSTAIN_MARGIN) -> Column:
    return vote_margin(pos, neg) < margin


def voter_keys(library: DataFrame) -> DataFrame:
    """Give anchors of one class whose texts open alike (60 characters) one voter key."""
    head = F.substring("text", 1, VOTER_CHARS)
    firsts = library.groupBy("prop", "is_positive", head.alias("__head")).agg(
        F.min("anchor_id").alias("voter_key"))
    return library.withColumn("__head", head).join(
        firsts, ["prop", "is_positive", "__head"]).drop("__head")


def short_list(found: DataFrame) -> Column:
    """The arrays of ``search`` as one array of entries with their cosine rank."""
    zipped = F.arrays_zip("top_sim", "top_pos", "top_id", "top_key")
    return F.transform(zipped, lambda x, i: F.struct(
        i.alias("rank"), x["top_sim"].alias("sim"), x["top_pos"].alias("is_positive"),
        x["top_id"].alias("anchor_id"), x["top_key"].alias("voter_key")))


def _positives(entries: Column) -> Column:
    return F.size(F.filter(entries, lambda x: x["is_positive"]))


def knn_vote(found: DataFrame, k: int = COSINE_K) -> DataFrame:
    """Share of positives among the k nearest anchors."""
    pool = F.slice("top_pos", 1, k)
    pos, n = F.size(F.filter(pool, lambda x: x)), F.size(pool)
    return found.select(
        "msg_id", "prop", F.when(n > 0, pos / n).otherwise(0.0).alias("score"),
        pos.alias("pos_in_k"), n.alias("k"), F.coalesce("max_pos", F.lit(0.0)).alias("max_pos"),
        F.coalesce("max_neg", F.lit(0.0)).alias("max_neg"))


def top_anchors(messages: DataFrame, library: DataFrame, n: int = 3, **kw) -> DataFrame:
    """Nearest positive anchors, one row each."""
    found = search(messages, library.filter("is_positive"), n, **kw)
    return found.select("msg_id", "prop", F.posexplode(F.arrays_zip("top_sim", "top_id")).alias("rank", "a")) \
        .select("msg_id", "prop", "rank", F.col("a.top_id").alias("anchor_id"),
                F.col("a.top_sim").alias("sim"))


def softmax_net(logits: Column, entail: int = 1, contra: int = 0) -> Column:
    """P(entailment) - P(contradiction) under a stable softmax."""
    def from_logits(row: Column) -> Column:
        return bind(F.array_max(row), lambda top: (F.exp(row[entail] - top) - F.exp(row[contra] - top))
                    / F.aggregate(row, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return bind(logits, from_logits)


NetScore = Callable[[Column, Column], Column]


def _retrieved(found: DataFrame, retrieve_k: int) -> Column:
    """The short list cut to ``retrieve_k``. For 0 it must hold the whole pool; one that a smaller search cut off is an error."""
    entries = short_list(found)
    if retrieve_k:
        return F.slice(entries, 1, retrieve_k)
    whole = F.size("top_id") >= F.col("pool")
    return F.when(whole, entries).otherwise(F.raise_error(F.lit("retrieve_k = 0 needs a search with k = 0")))


def nli_voters(found: DataFrame, forward: NetScore, backward: NetScore,
               retrieve_k: int = NLI_RETRIEVE_K, vote_k: int = NLI_VOTE_K,
               forward_weight: float = FORWARD_WEIGHT) -> DataFrame:
    """Re-rank each message's short list by the weighted pair scores. The expensive scorer
    sees only the ``retrieve_k`` nearest anchors (0: every anchor of the pool, so search with k = 0). Ties keep the
    cosine order."""
    entries = _retrieved(found, retrieve_k)
    msg = F.col("msg_id")
    scored = F.transform(entries, lambda x: F.struct(
        (-(forward(msg, x["anchor_id"]) * forward_weight
           + backward(msg, x["anchor_id"]) * (1 - forward_weight))).alias("order_by"),
        x["rank"].alias("rank"), x["sim"].alias("sim"), x["is_positive"].alias("is_positive"),
        x["anchor_id"].alias("anchor_id"), x["voter_key"].alias("voter_key")))
    return found.withColumn("nli_top", F.slice(F.sort_array(scored), 1, vote_k))


def candidate_pairs(found: DataFrame, retrieve_k: int = NLI_RETRIEVE_K, once: list[str] | tuple = ()) -> DataFrame:
    """The (message, anchor) pairs worth a pair model's time: ``retrieve_k`` rows per message
    and proposition, with the view that came closest to a positive anchor (and its text, where ``found`` has it as ``view``).
    Score them with any DataFrame function, e.g. a pandas UDF. Columns named by ``once`` travel with the nearest pair of a message
    only; a message without anchors then keeps one row without an anchor."""
    entries = _retrieved(found, retrieve_k)
    side = ["msg_id", "prop", "max_pos", "max_neg", "best_view", *(["view"] if "view" in found.columns else [])]
    if not once:
        return found.select(*side, F.explode(entries).alias("c")).select(*side, "c.*")
    nearest = F.coalesce(F.col("c.rank"), F.lit(0)) == 0
    return found.select(*side, *once, F.explode_outer(entries).alias("c")).select(
        *side, "c.*", *[F.when(nearest, F.col(n)).alias(n) for n in once])


def voters_from_pairs(scored: DataFrame, vote_k: int = NLI_VOTE_K,
                      forward_weight: float = FORWARD_WEIGHT, once: list[str] | tuple = ()) -> DataFrame:
    """Voters from scored candidate pairs (``candidate_pairs`` plus ``net_fwd``, ``net_bwd``).
    A message has at most ``retrieve_k`` pairs, so its lists stay short. ``once`` as in ``candidate_pairs``."""
    net = F.col("net_fwd") * forward_weight + F.col("net_bwd") * (1 - forward_weight)
    entry = F.struct("rank", "sim", "is_positive", "anchor_id", "voter_key", (-net).alias("order_by"))
    rows = scored.groupBy("msg_id", "prop").agg(
        F.array_sort(F.collect_list(F.when(F.col("anchor_id").isNotNull(), entry))).alias("l"), F.first("max_pos").alias("max_pos"),
        F.first("max_neg").alias("max_neg"), *[F.any_value(n, True).alias(n) for n in once])
    ranked_ = F.array_sort(F.transform("l", lambda x: F.struct(
        x["order_by"].alias("order_by"), x["rank"].alias("rank"), x["sim"].alias("sim"),
        x["is_positive"].alias("is_positive"), x["anchor_id"].alias("anchor_id"),
        x["voter_key"].alias("voter_key"))))
    arrays = [F.col(f"l.{field}").alias(name) for name, field in (
        ("top_sim", "sim"), ("top_pos", "is_positive"), ("top_id", "anchor_id"), ("top_key", "voter_key"))]
    return rows.select("msg_id", "prop", *arrays, "max_pos", "max_neg",
                       F.slice(ranked_, 1, vote_k).alias("nli_top"), *once)


def nli_vote(voters: DataFrame, match: float = MATCH, warning: float = WARNING,
             margin: float = ABSTAIN_MARGIN) -> DataFrame:
    rows = voters.select("msg_id", "prop", _positives(F.col("nli_top")).alias("pos_in_k"),
                         F.size("nli_top").alias("vote_k"))
    neg = F.col("vote_k") - F.col("pos_in_k")
    score = F.col("pos_in_k") / F.greatest(F.lit(1), F.col("vote_k"))
    label = F.when(abstains(F.col("pos_in_k"), neg, margin), "abstain").otherwise(
        F.lower(F.replace(verdict(score, match, warning), F.lit(" "), F.lit("_"))))
    return rows.select(
        "*", neg.alias("neg_in_k"), score.alias("score"),
        vote_margin(F.col("pos_in_k"), neg).alias("vote_margin"),
        abstains(F.col("pos_in_k"), neg, margin).alias("abstain"), label.alias("action"))


def _keys(entries: Column, positive: bool) -> Column:
    keep = F.filter(entries, lambda x: x["is_positive"] == F.lit(positive))
    return F.array_distinct(F.transform(keep, lambda x: x["voter_key"]))


def _sides(voters: DataFrame, half: int) -> DataFrame:
    """The distinct voters of either list and class as columns, each worked out once: ``cp, cn`` of the cosine list,
    ``np, nn`` of the re-ranked one. Other columns are kept."""
    cos, nli = F.slice(short_list(voters), 1, half), F.slice("nli_top", 1, half)
    return voters.select("*", *[_keys(c, p).alias(n) for c, p, n in (
        (cos, True, "cp"), (cos, False, "cn"), (nli, True, "np"), (nli, False, "nn"))])


def voter_overlap(voters: DataFrame, half: int = HYBRID_POOL // 2) -> DataFrame:
    """One row per distinct voter of a message, telling which list holds it."""
    def rows(a: str, b: str, positive: bool) -> Column:
        return F.transform(F.array_union(a, b), lambda key: F.struct(
            key.alias("voter_key"), F.lit(positive).alias("is_positive"),
            F.array_contains(F.col(a), key).alias("in_cosine"), F.array_contains(F.col(b), key).alias("in_nli")))
    return (_sides(voters, half).select("msg_id", "prop", F.explode(F.concat(rows("cp", "np", True), rows("cn", "nn", False))).alias("v"))
            .select("msg_id", "prop", "v.*")
            .withColumn("is_duplicate", F.col("in_cosine") & F.col("in_nli")))


def hybrid_vote(voters: DataFrame, pool: int = HYBRID_POOL,
                margin: float = ABSTAIN_MARGIN) -> DataFrame:
    """Agreement-weighted vote of the cosine and the re-ranked list."""
    counts = _sides(voters, pool // 2).select(
        "msg_id", "prop", F.size("cp").alias("cos_pos"), F.size("np").alias("nli_pos"),
        F.size(F.array_intersect("cp", "np")).alias("dup_pos"),
        F.size(F.array_intersect("cn", "nn")).alias("dup_neg"))
    points = F.col("cos_pos") + F.col("nli_pos") + F.col("dup_pos") - F.col("dup_neg")
    size = max(1, pool)
    gap = F.abs(F.col("points") * 2 - pool) / size
    return (counts.withColumn("points", points)
            .withColumn("score", F.greatest(F.lit(0.0), F.col("points") / size))
            .withColumn("vote_margin", gap).withColumn("abstain", gap < margin))


def score_all_modes(voters: DataFrame, match: float = MATCH, warning: float = WARNING, keep: list[str] | tuple = ()) -> DataFrame:
    """Cosine, NLI and hybrid score per message in long form, from one search. ``keep`` names further columns of the voters."""
    keys = ["msg_id", "prop", *keep]
    k = COSINE_K
    pos, n = F.size(F.filter(F.slice("top_pos", 1, k), lambda x: x)), F.size(F.slice("top_pos", 1, k))
    nli = _positives(F.col("nli_top")) / F.greatest(F.lit(1), F.size("nli_top"))
    hyb = F.greatest(F.lit(0.0), (F.size("cp") + F.size("np") + F.size(F.array_intersect("cp", "np"))
                                  - F.size(F.array_intersect("cn", "nn"))) / HYBRID_POOL)
    scores = [("cosine", F.when(n > 0, pos / n).otherwise(0.0)), ("nli", nli), ("hybrid", hyb)]
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), s.cast("double").alias("score"))
                     for m, s in scores])
    return (_sides(voters, HYBRID_POOL // 2).select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
            .withColumn("verdict", verdict(F.col("score"), match, warning)))


def soft_knn(found: DataFrame, temperature: float = 0.05) -> DataFrame:
    """Softmax-weighted vote of the short list, kept away from 0 and 1."""
    best = F.array_max("top_sim")
    weights = F.transform("top_sim", lambda s: F.exp((s - best) / temperature))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    hits = F.aggregate(F.zip_with(weights, F.col("top_pos"), lambda w, p: F.when(p, w).otherwise(0.0)),
                       F.lit(0.0), lambda a, x: a + x)
    low = 1e-7
    return found.select("msg_id", "prop",
                        F.greatest(F.lit(low), F.least(F.lit(1 - low), hits / total)).alias("score"))


# -- judges --------------------------------------------------------------------------------

def few_shot_round_robin(anchors: DataFrame, n: int = 5) -> DataFrame:
    """``n`` examples per (prop, label), taken in turn from the categories.
    ``anchors(prop, is_positive, category_idx, idx, text)``."""
    from pyspark.sql import Window
    nth = F.row_number().over(Window.partitionBy("prop", "is_positive", "category_idx").orderBy("idx"))
    # Only the first n of a category can be taken, so a category of any size costs n rows.
    heads = anchors.withColumn("nth", nth).filter(F.col("nth") <= n)
    turn = F.row_number().over(Window.partitionBy("prop", "is_positive").orderBy("nth", "category_idx"))
    return heads.withColumn("turn", turn).filter(F.col("turn") <= n).drop("nth")


def context_prompt(pairs: DataFrame, top: DataFrame, template: str = CONTEXT_TEMPLATE, texts: DataFrame | None = None) -> DataFrame:
    """Zero-shot prompt listing the nearest positive anchors. ``top`` has rows
    ``(msg_id, prop, rank, sim, category, text)``, at most a handful per message. With ``texts(prop, anchor_id, category, text)`` it
    has the ids of the anchors instead: then texts come to a task once, however many prompts show them."""
    keys = ["msg_id", "prop"]
    if texts is None:
        shown = F.array_sort(F.collect_list(F.struct("rank", "sim", "category", "text")))
        rows = pairs.join(top.groupBy(*keys).agg(shown.alias("l")), keys, "left")
    else:
        rows = _with_texts(pairs, top, texts)
    lines = F.array_sort(F.transform("l", lambda x: F.struct(x["rank"].alias("rank"), F.concat(
        F.lit("  - ["), F.format_string("%.3f", x["sim"]), F.lit("] ("), x["category"], F.lit(') "'), x["text"], F.lit('"')).alias("line"))))
    context = F.when(F.size("l") > 0, F.concat(
        F.lit(CONTEXT_HEAD), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")))
    return rows.withColumn("prompt", fill(template, {"description": F.col("description"), "message": F.col("text"),
                                                     "context": context})).drop("l")


def _with_texts(pairs: DataFrame, top: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` with ``l``, the entries of ``top`` with category and text. A part is some messages of a proposition and the texts they
    name, each once; there are parts enough that the texts of one fit a task. Only ids and parts are shuffled by message."""
    spark, kind = pairs.sparkSession, {f.name: f.dataType.simpleString() for f in [*top.schema, *texts.schema]}
    held = texts.groupBy("prop").agg(F.count(F.lit(1)).alias("n"), F.sum(
        F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("category"), F.lit(0))).alias("bytes"))
    sizes = top.groupBy("prop").agg(F.count(F.lit(1)).alias("named")).join(held, "prop").orderBy("prop").collect()  # a row per proposition
    least, homes, parts = math.ceil(2 * spark.sparkContext.defaultParallelism / max(1, len(sizes))), [], 1
    for r in sizes:
        few = r["bytes"] <= TEXT_BYTES
        homes.append((r["prop"], parts, max(least, 1 if few else math.ceil(r["named"] * r["bytes"] / r["n"] / TEXT_BYTES))))
        parts += homes[-1][2]
    homes = F.broadcast(spark.createDataFrame(homes, f"prop {kind['prop']}, first int, parts int"))  # a row per proposition
    part = F.coalesce(F.col("first") + F.pmod(F.xxhash64("msg_id"), F.col("parts")), F.lit(0)).cast("int").alias("part")
    near = F.collect_list(F.struct("rank", "anchor_id", "sim"))
    rows = pairs.join(top.groupBy("msg_id", "prop").agg(near.alias("near")), ["msg_id", "prop"], "left").join(homes, "prop", "left")
    named = top.join(homes, "prop").select(part, "prop", "anchor_id").distinct().join(texts, ["prop", "anchor_id"])
    both = named.select("part", F.lit(0).alias("kind"), F.struct("prop", "anchor_id", "category", "text").alias("anchor")).unionByName(
        rows.select(part, F.lit(1).alias("kind"), F.struct(*pairs.columns, "near").alias("pair")), allowMissingColumns=True)

    def look_up(batches):
        known, categories, contents, n = {}, [], [], 0
        for batch in batches:
            anchors = int((batch["kind"].to_numpy() == 0).sum())  # they come first
            if anchors:
                prop, ids, category, text = batch["anchor"].slice(0, anchors).flatten()
                for i, key in enumerate(zip(prop.to_pylist(), ids.to_pylist())):
                    known.setdefault(key, []).append(n + i)
                categories.append(category.cast(pa.large_string()))
                contents.append(text.cast(pa.large_string()))
                n += anchors
            if anchors == batch.num_rows:
                continue
            if len(contents) != 1:
                categories, contents = [[pa.concat_arrays(x) if x else pa.array([], pa.large_string())] for x in (categories, contents)]
            size = np.append(pc.binary_length(contents[0]).fill_null(0).to_numpy(), 0)
            *own, lists = batch["pair"].slice(anchors).flatten()
            owner = pc.list_parent_indices(lists).to_numpy()
            rank, ids, sim = lists.flatten().flatten()
            props = own[at_prop].take(pa.array(owner)).to_pylist()
            found = [known.get(key, ()) for key in zip(props, ids.to_pylist())]
            times = np.array([len(x) for x in found], np.int64)
            entry, pick = np.repeat(np.arange(len(found)), times), np.array([i for x in found for i in x], np.int64)
            owner = owner[entry]
            ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(lists))))
            load = np.append(0, np.cumsum(size[pick]))[ends]
            lo = 0
            while lo < len(lists):
                hi = max(lo + 1, int(np.searchsorted(load, load[lo] + PROMPT_BYTES, "right")) - 1)
                e, t = pa.array(entry[ends[lo]:ends[hi]]), pa.array(pick[ends[lo]:ends[hi]])
                shown = pa.StructArray.from_arrays([rank.take(e), sim.take(e), categories[0].take(t).cast(pa.string()),
                                                    contents[0].take(t).cast(pa.string())], ["rank", "sim", "category", "text"])
                shown = pa.ListArray.from_arrays(pa.array((ends[lo:hi + 1] - ends[lo]).astype(np.int32)), shown)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in own], shown], names=[*names, "l"])
                lo = hi

    names, at_prop = pairs.columns, pairs.columns.index("prop")
    return both.repartitionById(parts, "part").sortWithinPartitions("kind").select("kind", "anchor", "pair").mapInArrow(
        look_up, f"{pairs._jdf.schema().toDDL()}, l array<struct<rank:{kind['rank']},sim:{kind['sim']},category:string,text:string>>")


def batch_judge(pairs: DataFrame, judge: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """Ask a user-supplied judge about every row of ``pairs``; a failing call is no match."""
    def ask(batches):
        for pdf in batches:
            answers = []
            for text in pdf[prompt]:
                try:
                    answers.append(judge(text))
                except Exception:  # noqa: BLE001 - any failure of the judge fails open
                    answers.append(None)
            yield pdf.assign(answer=answers)

    schema = f"{pairs._jdf.schema().toDDL()}, answer string"
    answered = pairs.mapInPandas(ask, schema)
    return answered.select("*", *[c.alias(n) for n, c in judge_fields(F.col("answer")).items()])
