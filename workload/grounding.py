"""Similarity, votes and judges."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwatch.functions.prompts import (
    ASSISTANT_TEMPLATE, CONTEXT_TEMPLATE, USER_TEMPLATE, example_fields, few_shot_block,
    judge_fields, judge_prompt as prompt_column)
from turnwatch.functions.vectors import cosine as cosine_column
from turnwatch.operators import grounding as G
from turnwatch.operators import judging
from turnwatch.operators.monitor import role_filter
from turnwatch.plans.similarity import search
from turnwatch.session import broadcast_if_small, cut_lineage, new_folder, spread, written
from workload.registry import documents, query, table
from workload.temporal import conversations, region_propositions

# -- inputs: every embedding is a message with two views, and an anchor of two propositions ----


def anchor_library(spark, sf, chars=None):
    """Anchors with their texts, or with the first ``chars`` characters, so that whole texts are not shuffled for them."""
    text = F.substring("text", 1, chars).alias("text") if chars else "text"
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), text)
    if not chars:  # only texts that are anchors are shuffled
        texts = texts.join(broadcast_if_small(table(spark, sf, "embeddings").select("vec_id").distinct()), "vec_id", "left_semi")
    e = table(spark, sf, "embeddings").join(texts, "vec_id", "left")
    sides = F.array(
        F.struct(F.col("label").alias("prop"), F.lit(True).alias("is_positive")),
        F.struct(((F.col("label") + 1) % 10).alias("prop"), F.lit(False).alias("is_positive")))
    name = F.concat(F.lit("anchor "), F.col("vec_id").cast("string"))
    return e.select(F.explode(sides).alias("s"), F.col("vec_id").alias("idx"),
                    F.col("vec_id").alias("anchor_id"), "embedding",
                    F.coalesce("text", name).alias("text")).select("s.*", "idx", "anchor_id", "embedding", "text")


def vector_library(spark, sf):
    """The same anchors without their texts."""
    e = table(spark, sf, "embeddings")
    sides = F.array(
        F.struct(F.col("label").alias("prop"), F.lit(True).alias("is_positive")),
        F.struct(((F.col("label") + 1) % 10).alias("prop"), F.lit(False).alias("is_positive")))
    return e.select(F.explode(sides).alias("s"), F.col("vec_id").alias("idx"),
                    F.col("vec_id").alias("anchor_id"), "embedding").select(
        "s.*", "idx", "anchor_id", "embedding")


def vector_messages(spark, sf, views=2):
    cols = ["embedding", F.reverse("embedding")][:views]
    return spread(table(spark, sf, "embeddings")).select(F.col("vec_id").alias("msg_id"), F.array(*cols).alias("views"))


def searched(spark, sf, k, views=2, floor=True):
    return search(vector_messages(spark, sf, views), vector_library(spark, sf), k, floor=floor, skip_same=True)


def _pair_logits(m, a, c):
    m, a = m.cast("long"), a.cast("long")
    return F.array(((m * c[0] + a * c[1]) % 11) / 3.0, ((m * c[2] + a * c[3]) % 7) / 2.0,
                   ((m + a * c[4]) % 13) / 4.0)


FORWARD, BACKWARD = (7, 13, 5, 3, 17), (3, 5, 11, 2, 7)


def _net(consts):
    return lambda m, a: F.round(G.softmax_net(_pair_logits(m, a, consts)), 9)


def voters(spark, sf):
    """Re-ranked voters with pair scores derived from the ids."""
    library = cut_lineage(G.voter_keys(anchor_library(spark, sf, G.VOTER_CHARS)))  # read several times by the search
    found = search(vector_messages(spark, sf), library, 40, skip_same=True)
    return G.nli_voters(found, _net(FORWARD), _net(BACKWARD))


LIB_SQL = """q AS (SELECT vec_id AS msg_id, embedding::DOUBLE[] AS v, list_reverse(embedding)::DOUBLE[] AS rv, label FROM embeddings),
 a0 AS (SELECT e.vec_id AS anchor_id, embedding::DOUBLE[] AS v, label, coalesce(text, 'anchor ' || e.vec_id) AS text
 FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id),
 lib0 AS (SELECT label AS prop, true AS is_positive, anchor_id, v, text FROM a0 UNION ALL
 SELECT (label+1)%10, false, anchor_id, v, text FROM a0),
 lib AS (SELECT *, min(anchor_id) OVER (PARTITION BY prop, is_positive, text[1:60]) AS voter_key FROM lib0)"""
SIM2_SQL = f"""{LIB_SQL}, sims AS (SELECT msg_id, prop, is_positive, anchor_id, voter_key, text,
 round(list_cosine_similarity(q.v, lib.v),9) AS s0, round(list_cosine_similarity(q.rv, lib.v),9) AS s1,
 greatest(0.0, round(list_cosine_similarity(q.v, lib.v),9), round(list_cosine_similarity(q.rv, lib.v),9)) AS sim
 FROM q JOIN lib ON lib.anchor_id <> q.msg_id)"""
POOL_SQL = f"""{SIM2_SQL}, pool AS (SELECT *, row_number() OVER (PARTITION BY msg_id, prop
 ORDER BY sim DESC, is_positive DESC, anchor_id) AS rk FROM sims)"""
SIM1_SQL = f"""{LIB_SQL}, sims AS (SELECT msg_id, prop, is_positive, anchor_id, q.label,
 round(list_cosine_similarity(q.v, lib.v),9) AS sim FROM q JOIN lib ON lib.anchor_id <> q.msg_id),
 pool AS (SELECT *, row_number() OVER (PARTITION BY msg_id, prop
 ORDER BY sim DESC, is_positive DESC, anchor_id) AS rk FROM sims)"""
KNN_SQL = """knn AS (SELECT msg_id, prop, count(nullif(is_positive AND rk<=20, false))/count(nullif(rk<=20, false)) AS score,
 count(nullif(is_positive AND rk<=20, false)) AS pos_in_k, count(nullif(rk<=20, false)) AS k,
 max(CASE WHEN is_positive THEN sim END) AS max_pos, max(CASE WHEN NOT is_positive THEN sim END) AS max_neg
 FROM pool GROUP BY ALL)"""


def _logit_sql(c):
    return (f"[((msg_id*{c[0]}+anchor_id*{c[1]})%11)/3.0::DOUBLE, ((msg_id*{c[2]}+anchor_id*{c[3]})%7)/2.0::DOUBLE,"
            f" ((msg_id+anchor_id*{c[4]})%13)/4.0::DOUBLE]")


def _net_sql(name):
    return (f"round((exp({name}[2]-list_max({name}))-exp({name}[1]-list_max({name})))/(exp({name}[1]-list_max({name}))"
            f"+exp({name}[2]-list_max({name}))+exp({name}[3]-list_max({name}))),9)")


NLI_SQL = f"""{POOL_SQL}, lg AS (SELECT *, {_logit_sql(FORWARD)} AS f, {_logit_sql(BACKWARD)} AS b FROM pool WHERE rk<=40),
 nt AS (SELECT *, {_net_sql('f')}*0.7::DOUBLE + {_net_sql('b')}*(1-0.7::DOUBLE) AS net FROM lg),
 nli AS (SELECT *, row_number() OVER (PARTITION BY msg_id, prop ORDER BY net DESC, rk) AS nrk FROM nt)"""
HYB_SQL = f"""{NLI_SQL}, vt AS (SELECT msg_id, prop, voter_key, is_positive, bool_or(rk<=20) AS in_cosine,
 bool_or(nrk<=20) AS in_nli FROM nli WHERE rk<=20 OR nrk<=20 GROUP BY ALL),
 pts AS (SELECT msg_id, prop, count(nullif(is_positive AND in_cosine, false)) AS cos_pos, count(nullif(is_positive AND in_nli, false)) AS nli_pos,
 count(nullif(is_positive AND in_cosine AND in_nli, false)) AS dup_pos, count(nullif(NOT is_positive AND in_cosine AND in_nli, false)) AS dup_neg
 FROM vt GROUP BY ALL)"""


@query("cosine", """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),6)+0.0 AS sim
 FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1""")
def cosine(spark, sf):
    """Every vector beside the next one."""
    e = table(spark, sf, "embeddings")
    a = e.select("vec_id", F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine_column(F.col("a"), F.col("b")), 6).alias("sim"))


@query("similarity_join", f"""WITH {SIM1_SQL} SELECT msg_id, prop, rk-1 AS rank, anchor_id, is_positive,
 sim+0.0 AS sim FROM pool WHERE rk<=20""")
def similarity_join(spark, sf):
    found = searched(spark, sf, 20, views=1, floor=False)
    return found.select("msg_id", "prop", F.posexplode(F.arrays_zip("top_sim", "top_pos", "top_id")).alias("rank", "a")) \
        .select("msg_id", "prop", "rank", F.col("a.top_id").alias("anchor_id"),
                F.col("a.top_pos").alias("is_positive"), F.col("a.top_sim").alias("sim"))


@query("view_max_sim", f"""WITH {POOL_SQL} SELECT msg_id, prop, anchor_id, is_positive, sim
 FROM pool WHERE rk<=5""")
def view_max_sim(spark, sf):
    found = searched(spark, sf, 5)
    return found.select("msg_id", "prop", F.explode(F.arrays_zip("top_sim", "top_pos", "top_id")).alias("a")).select(
        "msg_id", "prop", F.col("a.top_id").alias("anchor_id"), F.col("a.top_pos").alias("is_positive"),
        F.col("a.top_sim").alias("sim"))


@query("knn_vote", f"""WITH {POOL_SQL}, {KNN_SQL} SELECT msg_id, prop, round(score,6) AS score, pos_in_k, k,
 max_pos, max_neg FROM knn""")
def knn_vote(spark, sf):
    out = G.knn_vote(searched(spark, sf, 20))
    return out.select("msg_id", "prop", "pos_in_k", "k", "max_pos", "max_neg",
                      F.round("score", 6).alias("score"))


@query("hard_knn_simple", f"""WITH {SIM1_SQL}, {KNN_SQL} SELECT msg_id, prop, round(score,6) AS score FROM knn""")
def hard_knn_simple(spark, sf):
    return G.knn_vote(searched(spark, sf, 20, views=1, floor=False)).select(
        "msg_id", "prop", F.round("score", 6).alias("score"))


@query("top_anchors", f"""WITH {POOL_SQL} SELECT msg_id, prop, rank, anchor_id, sim FROM (SELECT *,
 row_number() OVER (PARTITION BY msg_id, prop ORDER BY sim DESC, anchor_id)-1 AS rank FROM pool WHERE is_positive)
 WHERE rank<3""")
def top_anchors(spark, sf):
    return G.top_anchors(vector_messages(spark, sf), vector_library(spark, sf), 3, skip_same=True)


@query("softmax_net", """SELECT vec_id, round((exp(embedding[2])-exp(embedding[1]))/(exp(embedding[1]::DOUBLE)
 +exp(embedding[2]::DOUBLE)+exp(embedding[3]::DOUBLE)),6)+0.0 AS net FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings)""")
def softmax_net(spark, sf):
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(G.softmax_net(logits), 6).alias("net"))


@query("nli_rerank_vote", f"""WITH {NLI_SQL}, n AS (SELECT msg_id, prop, count(nullif(is_positive, false)) AS pos_in_k,
 count(nullif(NOT is_positive, false)) AS neg_in_k FROM nli WHERE nrk<=20 GROUP BY ALL), z AS (SELECT *,
 pos_in_k/(pos_in_k+neg_in_k) AS score, abs(pos_in_k-neg_in_k)/(pos_in_k+neg_in_k) AS vote_margin FROM n)
 SELECT msg_id, prop, pos_in_k, neg_in_k, round(score,6) AS score, vote_margin < 0.15 AS abstain,
 CASE WHEN vote_margin < 0.15 THEN 'abstain' WHEN score>0.55 THEN 'match' WHEN score>0.45 THEN 'warning'
 ELSE 'no_match' END AS action FROM z""")
def nli_rerank_vote(spark, sf):
    return G.nli_vote(voters(spark, sf)).select(
        "msg_id", "prop", "pos_in_k", "neg_in_k", F.round("score", 6).alias("score"), "abstain", "action")


@query("nli_from_pairs", f"""WITH {NLI_SQL} SELECT msg_id, prop, count(nullif(is_positive AND nrk<=20, false)) AS pos_in_k,
 count(nullif(nrk<=20, false)) AS vote_k, count(nullif(is_positive AND rk<=20, false)) AS cosine_pos FROM nli GROUP BY ALL""")
def nli_from_pairs(spark, sf):
    """The same vote with the pair scores as a table, as a pair model would give them."""
    pairs = G.candidate_pairs(searched(spark, sf, 40))
    m, a = F.col("msg_id"), F.col("anchor_id")
    scored = pairs.withColumn("net_fwd", _net(FORWARD)(m, a)).withColumn("net_bwd", _net(BACKWARD)(m, a))
    voters_ = cut_lineage(G.voters_from_pairs(scored))  # used twice
    return G.nli_vote(voters_).join(G.knn_vote(voters_).select(
        "msg_id", "prop", F.col("pos_in_k").alias("cosine_pos")), ["msg_id", "prop"]).select(
        "msg_id", "prop", "pos_in_k", "vote_k", "cosine_pos")


@query("best_view", f"""WITH {SIM2_SQL}, b AS (SELECT msg_id, prop, max(s0) AS m0, max(s1) AS m1 FROM sims
 WHERE is_positive GROUP BY ALL) SELECT msg_id, prop, CASE WHEN greatest(m0,m1)<=0 OR m0>=m1 THEN 0 ELSE 1 END AS best_view FROM b""")
def best_view(spark, sf):
    """The anchor of a message itself counts here: the view is chosen over all positives."""
    found = search(vector_messages(spark, sf), vector_library(spark, sf), 1, skip_same=True)
    return found.select("msg_id", "prop", "best_view")


@query("voter_overlap", f"""WITH {HYB_SQL} SELECT msg_id, prop, voter_key, is_positive, in_cosine, in_nli,
 in_cosine AND in_nli AS is_duplicate FROM vt""")
def voter_overlap(spark, sf):
    return G.voter_overlap(voters(spark, sf))


@query("hybrid_vote", f"""WITH {HYB_SQL}, z AS (SELECT *, cos_pos+nli_pos+dup_pos-dup_neg AS points FROM pts)
 SELECT msg_id, prop, points, dup_pos, dup_neg, round(greatest(0.0, points/40),6) AS score,
 round(abs(2*points-40)/40,6) AS vote_margin, abs(2*points-40)/40 < 0.15 AS abstain FROM z""")
def hybrid_vote(spark, sf):
    return G.hybrid_vote(voters(spark, sf)).select(
        "msg_id", "prop", "points", "dup_pos", "dup_neg", F.round("score", 6).alias("score"),
        F.round("vote_margin", 6).alias("vote_margin"), "abstain")


VERDICT_SQL = "CASE WHEN score>0.55 THEN 'MATCH' WHEN score>0.45 THEN 'WARNING' ELSE 'NO MATCH' END"
MODES_SQL = f"""{HYB_SQL}, {KNN_SQL}, md AS (SELECT msg_id, prop, 'cosine' AS mode, score FROM knn UNION ALL
 SELECT msg_id, prop, 'nli', count(nullif(is_positive, false))/count(*) FROM nli WHERE nrk<=20 GROUP BY ALL UNION ALL
 SELECT msg_id, prop, 'hybrid', greatest(0.0, (cos_pos+nli_pos+dup_pos-dup_neg)/40) FROM pts),
 modes AS (SELECT *, {VERDICT_SQL} AS verdict FROM md)"""


@query("score_all_modes", f"WITH {MODES_SQL} SELECT msg_id, prop, mode, round(score,6) AS score, verdict FROM modes")
def score_all_modes(spark, sf):
    return G.score_all_modes(voters(spark, sf)).withColumn("score", F.round("score", 6))


@query("threshold_verdict", f"""WITH {POOL_SQL}, {KNN_SQL} SELECT msg_id, prop, {VERDICT_SQL} AS verdict,
 CASE WHEN score>=0.55 THEN 'MATCH' WHEN score>=0.45 THEN 'WARNING' ELSE 'NO MATCH' END AS inclusive FROM knn""")
def threshold_verdict(spark, sf):
    s = F.col("score")
    return G.knn_vote(searched(spark, sf, 20)).select(
        "msg_id", "prop", G.verdict(s).alias("verdict"), G.verdict(s, inclusive=True).alias("inclusive"))


@query("abstain_flag", f"""WITH {POOL_SQL}, {KNN_SQL} SELECT msg_id, prop,
 round(abs(pos_in_k-(k-pos_in_k))/k,6) AS margin, abs(pos_in_k-(k-pos_in_k))/k < 0.15 AS abstain FROM knn""")
def abstain_flag(spark, sf):
    pos, neg = F.col("pos_in_k"), F.col("k") - F.col("pos_in_k")
    return G.knn_vote(searched(spark, sf, 20)).select(
        "msg_id", "prop", F.round(G.vote_margin(pos, neg), 6).alias("margin"),
        G.abstains(pos, neg).alias("abstain"))


SOFT_SQL = """sm AS (SELECT *, max(sim) OVER (PARTITION BY msg_id, prop) AS top FROM pool WHERE rk<=20),
 soft AS (SELECT msg_id, prop, label, greatest(1e-7::DOUBLE, least(1-1e-7::DOUBLE,
 sum(CASE WHEN is_positive THEN exp((sim-top)/0.05) ELSE 0 END)/sum(exp((sim-top)/0.05)))) AS score FROM sm GROUP BY ALL)"""


@query("soft_knn", f"WITH {SIM1_SQL}, {SOFT_SQL} SELECT msg_id, prop, round(score,6) AS score FROM soft")
def soft_knn(spark, sf):
    return G.soft_knn(searched(spark, sf, 20, views=1, floor=False)).withColumn("score", F.round("score", 6))


# -- prompts and judges -------------------------------------------------------------------------------

BLOCK_SQL = r"""CASE WHEN {neg} IS NULL AND len({pos})=0 THEN 'NONE' ELSE array_to_string(list_concat(
 list_transform({pos}, lambda x, i: 'Example ' || i || ':' || chr(10) || 'Label: MATCH' || chr(10) || {who} || ' MESSAGE: ' || x),
 ['Example ' || (len({pos})+1) || ':' || chr(10) || 'Label: NO_MATCH' || chr(10) || {who} || ' MESSAGE: ' || {neg}]),
 chr(10) || chr(10)) END"""


@query("few_shot_block", f"""SELECT doc_id, md5({BLOCK_SQL.format(pos="string_split(text, chr(10))", neg="source",
    who="CASE WHEN lang='en' THEN 'ASSISTANT' ELSE 'USER' END")}) AS block FROM documents""")
def few_shots(spark, sf):
    role = F.when(F.col("lang") == "en", "assistant").otherwise("user")
    return table(spark, sf, "documents").select("doc_id", F.md5(few_shot_block(
        F.split("text", "\n"), F.array("source"), role)).alias("block"))


def _template_sql(template: str, slots: dict[str, str]) -> str:
    text = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, expr in slots.items():
        text = text.replace("{%s}" % name, f"' || {expr} || '")
    return text


_SLOTS = {"description": "prop_id", "examples": "'NONE'", "message": "text", "role": "upper(role)"}
PROMPT_SQL = f"""SELECT conv_id, turn, prop_id, text, CASE WHEN role='assistant' THEN {_template_sql(ASSISTANT_TEMPLATE, _SLOTS)}
 ELSE {_template_sql(USER_TEMPLATE, _SLOTS)} END AS prompt FROM conversations JOIN
 (SELECT lower(r_name) AS prop_id, CASE WHEN r_regionkey < 2 THEN 'user' ELSE 'assistant' END AS role FROM region) USING (role)"""


def prompts(spark, sf):
    df, _ = conversations(spark, sf)
    pairs = role_filter(df, region_propositions(spark, sf))
    none = few_shot_block(F.array().cast("array<string>"), F.array().cast("array<string>"), F.col("role"))
    return pairs.select("conv_id", "turn", "prop_id", "text", prompt_column(
        F.col("role"), F.col("role"), F.col("prop_id"), F.col("text"), none).alias("prompt"))


@query("judge_prompt", f"SELECT conv_id, turn, prop_id, md5(prompt) AS prompt FROM ({PROMPT_SQL})")
def judge_prompt(spark, sf):
    return prompts(spark, sf).select("conv_id", "turn", "prop_id", F.md5("prompt").alias("prompt"))


def length_judge(prompt: str) -> str:
    """A stand-in judge: long prompts match, middling ones break it."""
    if 700 <= len(prompt) < 900:
        raise RuntimeError("judge unavailable")
    return '{"match": %s, "confidence": 0.75, "reasoning": "length"}' % str(len(prompt) >= 900).lower()


@query("batch_judge", f"""SELECT conv_id, turn, prop_id, length(prompt) >= 900 AS match,
 CASE WHEN length(prompt) BETWEEN 700 AND 899 THEN 0.0 ELSE 0.75 END::DOUBLE AS confidence FROM ({PROMPT_SQL})""")
def batch_judge(spark, sf):
    return G.batch_judge(prompts(spark, sf), length_judge).select("conv_id", "turn", "prop_id", "match", "confidence")


ONE_TRY = judging.Pool(tries=1, pause=0.0)


@query("judge_pool", f"""SELECT conv_id, turn, prop_id, length(prompt) >= 900 AS match, CASE WHEN length(prompt) BETWEEN 700 AND 899 THEN 'ERROR'
 WHEN length(prompt) >= 900 THEN 'MATCH' ELSE 'NO MATCH' END AS verdict FROM ({PROMPT_SQL})""")
def judge_pool(spark, sf):
    """Half of the conversations first; the second run asks only what the table of answers lacks."""
    rows, answers = prompts(spark, sf), new_folder(spark, "answers")
    judging.judge_pool(rows.filter("conv_id % 2 = 0"), length_judge, answers, pool=ONE_TRY)
    return judging.judge_pool(rows, length_judge, answers, pool=ONE_TRY).select("conv_id", "turn", "prop_id", "match", "verdict")


@query("judge_answers", f"""SELECT sha256(chr(10) || prompt) AS digest, 1 AS times FROM ({PROMPT_SQL})
 WHERE length(prompt) NOT BETWEEN 700 AND 899 GROUP BY prompt""")
def judge_answers(spark, sf):
    """What two runs leave in the table of answers: each answered prompt once."""
    rows, answers = prompts(spark, sf), new_folder(spark, "answers")
    judging.answered(rows.filter("conv_id % 2 = 0"), length_judge, answers, pool=ONE_TRY)
    judging.answered(rows, length_judge, answers, pool=ONE_TRY)
    return spark.read.parquet(answers).groupBy("digest").agg(F.count(F.lit(1)).alias("times"))


def even_judge(prompt: str) -> str:
    return '{"match": %s}' % str(len(prompt) % 2 == 0).lower()


_SHOWN = {"description": "'about ' || prop", "examples": "block", "message": "text", "role": "upper(side)"}


@query("judge_few_shot", f"""WITH a AS (SELECT item_id%4 AS prop, item_id%3<>0 AS pos, item_id%5 AS cat, text,
 row_number() OVER (PARTITION BY item_id%4, item_id%3<>0, item_id%5 ORDER BY item_id) AS nth FROM benchmark),
 t AS (SELECT *, row_number() OVER (PARTITION BY prop, pos ORDER BY nth, cat) AS turn FROM a),
 e AS (SELECT *, row_number() OVER (PARTITION BY prop ORDER BY pos DESC, turn) AS i FROM t WHERE turn<=5),
 b AS (SELECT prop, who, string_agg('Example ' || i || ':' || chr(10) || 'Label: ' || CASE WHEN pos THEN 'MATCH' ELSE 'NO_MATCH' END || chr(10)
 || who || ' MESSAGE: ' || text, chr(10) || chr(10) ORDER BY i) AS block FROM e, (VALUES ('USER'), ('ASSISTANT')) r(who) GROUP BY prop, who),
 c AS (SELECT conv_id, turn, prop, CASE WHEN side='assistant' THEN {_template_sql(ASSISTANT_TEMPLATE, _SHOWN)}
 ELSE {_template_sql(USER_TEMPLATE, _SHOWN)} END AS prompt FROM (SELECT conv_id, turn, lower(trim(coalesce(role, 'user'))) AS side,
 coalesce(text, '') AS text, conv_id%4 AS prop, CASE WHEN side='assistant' THEN 'ASSISTANT' ELSE 'USER' END AS who
 FROM conversations) JOIN b USING (prop, who))
 SELECT conv_id, turn, prop, md5(prompt) AS prompt, CASE WHEN length(prompt)%2=0 THEN 'MATCH' ELSE 'NO MATCH' END AS verdict FROM c""")
def judge_few_shot(spark, sf):
    """Prompts that show ten examples, and what the judge makes of them."""
    anchors = table(spark, sf, "benchmark").select(
        (F.col("item_id") % 4).alias("prop"), (F.col("item_id") % 3 != 0).alias("is_positive"),
        (F.col("item_id") % 5).alias("category_idx"), F.col("item_id").alias("idx"), "text")
    pairs = table(spark, sf, "conversations").withColumn("prop", F.col("conv_id") % 4) \
        .withColumn("description", F.concat(F.lit("about "), F.col("prop").cast("string")))
    out = judging.judge_pool(judging.few_shot_prompts(pairs, anchors), even_judge, pool=ONE_TRY)
    return out.select("conv_id", "turn", "prop", F.md5("prompt").alias("prompt"), "verdict")


@query("few_shot_round_robin", """WITH a AS (SELECT lang AS prop, source >= 'src5' AS is_positive,
 source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS nth FROM documents),
 t AS (SELECT *, row_number() OVER (PARTITION BY prop, is_positive ORDER BY nth, source) AS turn FROM a)
 SELECT prop, is_positive, turn, doc_id FROM t WHERE turn<=5""")
def few_shot_round_robin(spark, sf):
    anchors = table(spark, sf, "documents").select(
        F.col("lang").alias("prop"), (F.col("source") >= "src5").alias("is_positive"),
        F.col("source").alias("category_idx"), F.col("doc_id").alias("idx"), "text")
    return G.few_shot_round_robin(anchors).select(
        "prop", "is_positive", "turn", F.col("idx").alias("doc_id"))


@query("judge_parse", """SELECT conv_id, turn, CASE WHEN turn IN (0,1,2) THEN length(text)>300 WHEN turn=6 THEN true ELSE false END AS match,
 CASE WHEN turn=0 THEN 0.5 WHEN turn IN (1,2) AND length(text)>300 THEN 1.0 WHEN turn=6 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence,
 CASE WHEN turn=0 THEN text WHEN turn IN (1,2,6) THEN '' WHEN turn IN (3,4,7) THEN 'match is not a boolean'
 ELSE 'unreadable answer' END AS reasoning FROM conversations""")
def judge_parse(spark, sf):
    """Answers of every shape a judge gives, built from the messages."""
    t, long = F.col("turn"), F.length("text") > 300
    plain = F.to_json(F.struct(long.alias("match"), F.lit(0.5).alias("confidence"), F.col("text").alias("reasoning")))
    bare = F.to_json(F.struct(long.alias("match")))
    answer = (F.when(t == 0, plain).when(t == 1, F.concat(F.lit("```json\n"), bare, F.lit("\n```")))
              .when(t == 2, F.concat(F.lit("Sure: "), bare, F.lit(" hope this helps")))
              .when(t == 3, F.lit('{"match": "true"}')).when(t == 4, F.lit('{"match": 1}'))
              .when(t == 5, F.lit('{"match": tr')).when(t == 6, F.lit('{"match": true, "confidence": true}'))
              .when(t == 7, F.lit('{"confidence": 1}')).otherwise(F.lit("")))
    fields = judge_fields(F.col("answer"))
    return table(spark, sf, "conversations").select("conv_id", "turn", answer.alias("answer")).select(
        "conv_id", "turn", *[fields[c].alias(c) for c in ("match", "confidence", "reasoning")])


@query("example_parse", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
 lambda x: regexp_replace(x,'^\s+|\s+$','','g')), lambda x: x<>'') AS p FROM documents)
 SELECT doc_id, CASE WHEN len(p)>=5 THEN array_to_string(p[1:5],'|') END AS positive,
 CASE WHEN len(p)>=5 THEN array_to_string(list_reverse(p)[1:5],'|') END AS negative FROM l""")
def example_parse(spark, sf):
    lines = F.split("text", "\n")
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(
        lines.alias("positive_examples"), F.reverse(lines).alias("negative_examples"))), F.lit("\n```"))
    f = example_fields(F.col("answer"))
    return documents(spark, sf).select("doc_id", answer.alias("answer")).select(
        "doc_id", *[F.array_join(f[c], "|").alias(c) for c in ("positive", "negative")])


@query("judge_with_context", f"""WITH {POOL_SQL}, top AS (SELECT msg_id, prop, rank, sim, text FROM (SELECT *,
 row_number() OVER (PARTITION BY msg_id, prop ORDER BY sim DESC, anchor_id) AS rank FROM pool WHERE is_positive) WHERE rank<=5),
 ctx AS (SELECT msg_id, prop, string_agg('  - [' || printf('%.3f', sim) || '] (c' || prop || ') "' || text || '"',
 chr(10) ORDER BY rank) AS lines FROM top GROUP BY ALL)
 SELECT msg_id, prop, md5({_template_sql(CONTEXT_TEMPLATE, {"description": "'proposition ' || prop",
    "message": "'message ' || msg_id",
    "context": "chr(10) || chr(10) || 'Closest anchors by similarity:' || chr(10) || lines"})}) AS prompt FROM ctx""")
def judge_with_context(spark, sf):
    library = anchor_library(spark, sf)
    top = cut_lineage(G.top_anchors(vector_messages(spark, sf), library, 5, skip_same=True))  # used twice
    texts = written(library.filter("is_positive").select(  # used twice
        "prop", "anchor_id", "text", F.concat(F.lit("c"), F.col("prop").cast("string")).alias("category")), "texts")
    pairs = top.select("msg_id", "prop").distinct().select(
        "*", F.concat(F.lit("proposition "), F.col("prop").cast("string")).alias("description"),
        F.concat(F.lit("message "), F.col("msg_id").cast("string")).alias("text"))
    return G.context_prompt(pairs, top, texts=texts).select(
        "msg_id", "prop", F.md5("prompt").alias("prompt"))
