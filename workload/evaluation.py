"""Evaluation of scoring modes and statistics of anchor sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwatch.functions.vectors import letter_histogram
from turnwatch.operators import evaluate as E
from turnwatch.operators import grounding as G
from turnwatch.plans.similarity import search
from turnwatch.session import broadcast_if_small, cut_lineage, spread
from workload.grounding import (
    KNN_SQL, LIB_SQL, MODES_SQL, SIM1_SQL, SOFT_SQL, searched, vector_library, vector_messages, voters)
from workload.registry import query, table

MODES = ["cosine", "nli", "hybrid"]


def mode_verdicts(spark, sf):
    truth = table(spark, sf, "embeddings").select(F.col("vec_id").alias("msg_id"), F.col("label").alias("own"))
    label = F.when(F.col("own") == F.col("prop"), "MATCH").otherwise("NO MATCH")
    return G.score_all_modes(voters(spark, sf)).join(truth, "msg_id").withColumn("label", label)


def knn_scores(spark, sf, soft=False):
    found = searched(spark, sf, 20, views=1, floor=False)
    scores = G.soft_knn(found) if soft else G.knn_vote(found)
    truth = table(spark, sf, "embeddings").select(F.col("vec_id").alias("msg_id"), F.col("label").alias("own"))
    return scores.join(truth, "msg_id").select(
        "msg_id", "prop", "score", (F.col("own") == F.col("prop")).cast("int").alias("label"))


T_SQL = f"""{MODES_SQL}, tm AS (SELECT modes.*, verdict IN ('MATCH','WARNING') AS hit, label = prop AS want
 FROM modes JOIN q USING (msg_id))"""


@query("verdict_counts", f"""WITH {MODES_SQL} SELECT mode, count(nullif(verdict='MATCH', false)) AS match,
 count(nullif(verdict='WARNING', false)) AS warning, count(nullif(verdict='NO MATCH', false)) AS no_match, count(nullif(verdict='ERROR', false)) AS error
 FROM modes GROUP BY mode""")
def verdict_counts(spark, sf):
    return E.verdict_counts(G.score_all_modes(voters(spark, sf)))


@query("confusion_metrics", f"""WITH {T_SQL}, c AS (SELECT mode, count(nullif(hit AND want, false)) AS tp, count(nullif(hit AND NOT want, false)) AS fp,
 count(nullif(NOT hit AND NOT want, false)) AS tn, count(nullif(NOT hit AND want, false)) AS fn FROM tm GROUP BY mode),
 pr AS (SELECT *, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0.0 END AS p, CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0.0 END AS r FROM c)
 SELECT mode, tp, fp, tn, fn, round(p,6) AS precision, round(r,6) AS recall,
 round(CASE WHEN p+r>0 THEN 2*p*r/(p+r) ELSE 0.0 END,6) AS f1, round((tp+tn)/(tp+fp+tn+fn),6) AS accuracy FROM pr""")
def confusion_metrics(spark, sf):
    out = E.confusion_metrics(mode_verdicts(spark, sf))
    return out.select("mode", "tp", "fp", "tn", "fn",
                      *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("mode_agreement", f"""WITH {MODES_SQL} SELECT count(*) AS total, count(nullif(n=1, false)) AS agree FROM
 (SELECT msg_id, prop, count(DISTINCT verdict) AS n FROM modes GROUP BY ALL)""")
def mode_agreement(spark, sf):
    return E.mode_agreement(G.score_all_modes(voters(spark, sf)), ["msg_id", "prop"])


@query("verdict_grid", f"""WITH {T_SQL} SELECT msg_id, prop, CASE WHEN bool_or(want) THEN 'MATCH' ELSE 'NO MATCH' END AS label,
 max(CASE WHEN mode='cosine' THEN verdict END) AS cosine, max(CASE WHEN mode='nli' THEN verdict END) AS nli,
 max(CASE WHEN mode='hybrid' THEN verdict END) AS hybrid, bool_or(hit<>want) AS any_wrong FROM tm GROUP BY ALL""")
def verdict_grid(spark, sf):
    return E.verdict_grid(mode_verdicts(spark, sf), ["msg_id", "prop"], MODES)


GRID_SQL = ", ".join(f"({i},{j},{m!r}::DOUBLE,{w!r}::DOUBLE)" for i, j, m, w in E.threshold_grid())


@query("calibrate_thresholds", f"""WITH {SIM1_SQL}, {KNN_SQL}, s AS (SELECT prop, score, label=prop AS pos FROM knn JOIN q USING (msg_id)),
 g(i,j,match,warning) AS (VALUES {GRID_SQL}), h AS (SELECT prop, score, pos, count(*) AS n FROM s GROUP BY ALL),
 pt AS (SELECT prop, i, j, match, warning, sum(CASE WHEN score>warning AND pos THEN n ELSE 0 END) AS tp,
 sum(CASE WHEN score>warning AND NOT pos THEN n ELSE 0 END) AS fp, sum(CASE WHEN score<=warning AND pos THEN n ELSE 0 END) AS fn,
 sum(CASE WHEN score<=warning AND NOT pos THEN n ELSE 0 END) AS tn FROM h, g GROUP BY ALL),
 f AS (SELECT *, 2*(tp/greatest(1,tp+fp))*(tp/greatest(1,tp+fn))/greatest(1e-10::DOUBLE,(tp/greatest(1,tp+fp))+(tp/greatest(1,tp+fn))) AS f1 FROM pt),
 b AS (SELECT *, row_number() OVER (PARTITION BY prop ORDER BY f1 DESC, i, j) AS rn FROM f)
 SELECT prop, round(CASE WHEN f1>0 THEN match ELSE 0.70 END,6) AS match, round(CASE WHEN f1>0 THEN warning ELSE 0.50 END,6) AS warning,
 round(f1,6) AS f1, round((tp+tn)/(tp+fp+tn+fn),6) AS accuracy FROM b WHERE rn=1""")
def calibrate_thresholds(spark, sf):
    out = E.calibrate_thresholds(knn_scores(spark, sf))
    return out.select("prop", *[F.round(c, 6).alias(c) for c in ("match", "warning", "f1", "accuracy")])


@query("score_distribution", f"""WITH {SIM1_SQL}, {KNN_SQL}, s AS (SELECT prop, score, label=prop AS pos FROM knn JOIN q USING (msg_id)),
 d AS (SELECT prop, min(CASE WHEN pos THEN score END) AS pos_min, avg(CASE WHEN pos THEN score END) AS pos_mean,
 max(CASE WHEN pos THEN score END) AS pos_max, min(CASE WHEN NOT pos THEN score END) AS neg_min,
 avg(CASE WHEN NOT pos THEN score END) AS neg_mean, max(CASE WHEN NOT pos THEN score END) AS neg_max FROM s GROUP BY prop)
 SELECT prop, round(pos_min,6) AS pos_min, round(pos_mean,6) AS pos_mean, round(pos_max,6) AS pos_max, round(neg_min,6) AS neg_min,
 round(neg_mean,6) AS neg_mean, round(neg_max,6) AS neg_max, round(pos_min-neg_max,6)+0.0 AS gap FROM d""")
def score_distribution(spark, sf):
    out = E.score_distribution(knn_scores(spark, sf))
    return out.select("prop", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("file_summary", f"""WITH {SIM1_SQL}, {KNN_SQL}, s AS (SELECT score, CASE WHEN label=prop THEN 'MATCH' ELSE 'NO MATCH' END AS lab
 FROM knn JOIN q USING (msg_id)) SELECT count(*) AS total, count(nullif(score>=0.55, false)) AS matches,
 count(nullif(score>=0.45 AND score<0.55, false)) AS warnings, count(nullif(score<0.45, false)) AS clean, count(lab) AS labelled,
 count(nullif((score>=0.45)=(lab='MATCH'), false)) AS correct FROM s""")
def file_summary(spark, sf):
    label = F.when(F.col("label") == 1, "MATCH").otherwise("NO MATCH")
    return E.file_summary(knn_scores(spark, sf).withColumn("label", label), 0.55, 0.45)


@query("soft_knn_eval", f"""WITH {SIM1_SQL}, {SOFT_SQL} SELECT prop, round(avg(CASE WHEN (score>0.5)=(label=prop) THEN 1.0 ELSE 0.0 END),6) AS accuracy,
 round(avg(CASE WHEN label=prop THEN -ln(score+1e-10::DOUBLE) ELSE -ln(1-score+1e-10::DOUBLE) END),6) AS loss FROM soft GROUP BY prop""")
def soft_knn_eval(spark, sf):
    out = E.soft_knn_eval(knn_scores(spark, sf, soft=True))
    return out.select("prop", F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss"))


@query("dataset_profile", """SELECT source AS proposition_id, min(lang) AS role, min(source) AS proposition,
 count(nullif(n_chars>1000, false)) AS positives, count(nullif(n_chars<=1000, false)) AS negatives, min(lang)=max(lang) AS consistent
 FROM documents GROUP BY source""")
def dataset_profile(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("source").alias("proposition_id"), F.col("lang").alias("role"), F.col("source").alias("proposition"),
        F.when(F.col("n_chars") > 1000, "positive").otherwise("negative").alias("example_type"))
    return E.dataset_profile(rows)


# -- similarity statistics --------------------------------------------------------------------


def vector_items(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label"), F.col("embedding").alias("vec"))


def document_items(spark, sf):
    """Documents with their letter histograms, embedded once and kept as a written table."""
    return cut_lineage(spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("id"), "source", "lang", letter_histogram(F.col("text")).alias("vec"), "text"))


LETTERS_SQL = """list_transform(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z',' '),
 lambda c: (length(lower({0}))-length(replace(lower({0}),c,'')))::DOUBLE)"""
V_SQL = "v AS MATERIALIZED (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"
D_SQL = f"d AS MATERIALIZED (SELECT doc_id AS id, source, lang, text, {LETTERS_SQL.format('text')} AS v FROM documents)"


def _cos(a, b):
    return f"coalesce(list_cosine_similarity({a},{b}),0.0)"


@query("similarity_stats", f"""WITH {V_SQL}, p AS (SELECT a.label, {_cos('a.v','b.v')} AS s FROM v a JOIN v b
 ON a.label=b.label AND a.id<b.id), n AS (SELECT label, count(*) AS n FROM v GROUP BY label)
 SELECT label, any_value(n) AS n, round(2*sum(s)/any_value(n*n),6)+0.0 AS mean_sim, round(greatest(0.0,max(s)),6) AS max_sim
 FROM p JOIN n USING (label) GROUP BY label""")
def similarity_stats(spark, sf):
    out = E.similarity_stats(vector_items(spark, sf), ["label"])
    return out.select("label", "n", F.round("mean_sim", 6).alias("mean_sim"), F.round("max_sim", 6).alias("max_sim"))


@query("pairwise_self_join", f"""WITH {V_SQL}, p AS (SELECT a.label, a.id, b.id AS nn, round({_cos('a.v','b.v')},9) AS s
 FROM v a JOIN v b ON a.label=b.label AND a.id<>b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, nn) AS rk FROM p)
 SELECT label, id, max(CASE WHEN rk=1 THEN nn END) AS nearest_id, max(s) AS nearest_sim, count(nullif(s>=0.2, false)) AS n_close FROM r GROUP BY label, id""")
def pairwise_self_join(spark, sf):
    return E.neighbour_stats(vector_items(spark, sf), ["label"], 0.2)


@query("category_variance", f"""WITH {D_SQL}, p AS (SELECT a.source, {_cos('a.v','b.v')} AS s FROM d a JOIN d b
 ON a.source=b.source AND a.id<b.id), n AS (SELECT source, count(*) AS n FROM d GROUP BY source HAVING count(*)>=3)
 SELECT source, any_value(n) AS n, round(1-2*sum(s)/any_value(n*n),6) AS variance, 1-2*sum(s)/any_value(n*n) < 0.15 AS low_variance
 FROM p JOIN n USING (source) GROUP BY source""")
def category_variance(spark, sf):
    out = E.category_variance(document_items(spark, sf), ["source"])
    return out.withColumn("variance", F.round("variance", 6))


def with_proposition(spark, sf):
    """Each class takes the embedding with its own number as its proposition."""
    props = table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("label"),
                                                  F.col("embedding").alias("prop_vec"))
    return vector_items(spark, sf).join(broadcast_if_small(props.filter(F.col("label").between(0, 9))), "label")


PV_SQL = f"{V_SQL}, pv AS (SELECT v.id, v.label, v.v, p.v AS pvec FROM v JOIN v p ON p.id=v.label)"


@query("directional_spread", f"""WITH {PV_SQL}, w AS (SELECT id, label, list_transform(list_zip(v,pvec), lambda x: x[1]-x[2]) AS u FROM pv),
 p AS (SELECT a.label, CASE WHEN list_sum(list_transform(a.u, lambda x: x*x))=0 OR list_sum(list_transform(b.u, lambda x: x*x))=0 THEN 0
 ELSE list_cosine_similarity(a.u,b.u) END AS s FROM w a JOIN w b ON a.label=b.label AND a.id<b.id),
 n AS (SELECT label, count(*) AS n FROM w GROUP BY label)
 SELECT label, round(2*sum(s)/any_value(n*n),6)+0.0 AS spread FROM p JOIN n USING (label) GROUP BY label""")
def directional_spread(spark, sf):
    return E.directional_spread(with_proposition(spark, sf), ["label"]).select(
        "label", F.round("mean_sim", 6).alias("spread"))


@query("proposition_proximity", f"""WITH {PV_SQL} SELECT label, round(min({_cos('v','pvec')}),6)+0.0 AS min_sim,
 round(avg({_cos('v','pvec')}),6)+0.0 AS avg_sim, round(max({_cos('v','pvec')}),6)+0.0 AS max_sim FROM pv GROUP BY label""")
def proposition_proximity(spark, sf):
    out = E.proposition_proximity(with_proposition(spark, sf), ["label"])
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("min_sim", "avg_sim", "max_sim")])


KIND_SQL = f"""{V_SQL}, pr AS (SELECT CASE WHEN a.label<5 AND b.label<5 THEN 'pp' WHEN a.label>=5 AND b.label>=5 THEN 'nn' ELSE 'pn' END AS kind,
 round({_cos('a.v','b.v')},9) AS s FROM v a JOIN v b ON a.id<b.id)"""


def class_items(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("label") < 5).alias("is_pos"))


@query("class_similarity_hist", f"""WITH {KIND_SQL} SELECT kind, least(39, greatest(0, floor((s+1)/0.05::DOUBLE)))::INT AS bin,
 count(*) AS n FROM pr GROUP BY ALL""")
def class_similarity_hist(spark, sf):
    return E.class_similarity_histogram(class_items(spark, sf))[0]


@query("class_similarity_summary", f"""WITH {KIND_SQL}, e AS (SELECT avg(s)-stddev_pop(s) AS edge, stddev_pop(s) AS sd FROM pr WHERE kind='pp')
 SELECT round(avg(CASE WHEN kind='pp' THEN s END),6)+0.0 AS pp_mean, round(avg(CASE WHEN kind='pn' THEN s END),6)+0.0 AS pn_mean,
 round(avg(CASE WHEN kind='nn' THEN s END),6)+0.0 AS nn_mean, round(any_value(sd),6) AS pp_std,
 round(count(nullif(kind='pn' AND s>edge, false))/count(nullif(kind='pn', false)),6) AS overlap FROM pr, e""")
def class_similarity_summary(spark, sf):
    out = E.class_similarity_histogram(class_items(spark, sf))[1]
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


# -- coverage -------------------------------------------------------------------------------------


def subtopics(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.lit("all").alias("prop"), F.col("item_id").alias("subtopic_idx"),
        letter_histogram(F.col("text")).alias("embedding"))


def assigned(spark, sf):
    docs = document_items(spark, sf)
    near = E.nearest_subtopic(docs.select(F.col("id").alias("msg_id"), F.array("vec").alias("views")),
                              subtopics(spark, sf))
    texts = docs.select(F.col("id").alias("msg_id"), "text")
    forced = table(spark, sf, "documents").filter(F.col("lang") == "de").select(
        "text", F.lit(0).cast("long").alias("subtopic_idx")).distinct()
    return E.forced_assignment(near.join(texts, "msg_id"), forced)


ASSIGN_SQL = f"""{D_SQL}, b AS (SELECT item_id, {LETTERS_SQL.format('text')} AS v FROM benchmark),
 s AS (SELECT d.id, d.text, item_id, round({_cos('d.v','b.v')},9) AS s FROM d, b),
 near AS (SELECT id, text, arg_min(item_id, item_id) FILTER (WHERE s=top) AS item_id FROM
 (SELECT *, max(s) OVER (PARTITION BY id) AS top FROM s) GROUP BY id, text),
 asg AS (SELECT id, CASE WHEN text IN (SELECT text FROM documents WHERE lang='de') THEN 0 ELSE item_id END AS idx FROM near),
 cov AS (SELECT item_id AS subtopic_idx, count(id) AS n FROM benchmark LEFT JOIN asg ON idx=item_id GROUP BY item_id),
 tot AS (SELECT sum(n) AS total, count(*) AS k FROM cov)"""


@query("forced_assignment", f"WITH {ASSIGN_SQL} SELECT id AS msg_id, idx AS subtopic_idx FROM asg")
def forced_assignment(spark, sf):
    return assigned(spark, sf).select("msg_id", "subtopic_idx")


@query("subtopic_coverage", f"""WITH {ASSIGN_SQL} SELECT subtopic_idx, n, round(n/total,6) AS share,
 CASE WHEN n < total/k*0.6 THEN 'UNDERREPRESENTED' WHEN n < total/k*0.9 THEN 'LOW' ELSE 'OK' END AS status FROM cov, tot""")
def subtopic_coverage(spark, sf):
    return E.subtopic_coverage(assigned(spark, sf), subtopics(spark, sf)).select(
        "subtopic_idx", "n", F.round("share", 6).alias("share"), "status")


@query("subtopic_shortfall", f"""WITH {ASSIGN_SQL} SELECT subtopic_idx, n, greatest(20, (500//k))::INT AS target,
 greatest(0, greatest(20, 500//k)-n)::BIGINT AS shortfall FROM cov, tot""")
def subtopic_shortfall(spark, sf):
    coverage = E.subtopic_coverage(assigned(spark, sf), subtopics(spark, sf))
    return E.subtopic_shortfall(coverage, 500, 20).drop("prop")


@query("boundary_quality", f"""WITH {LIB_SQL}, f AS (SELECT msg_id, prop, label=prop AS is_pos,
 max(CASE WHEN is_positive THEN round(list_cosine_similarity(q.v,lib.v),9) END) AS mp,
 max(CASE WHEN NOT is_positive THEN round(list_cosine_similarity(q.v,lib.v),9) END) AS mn
 FROM q JOIN lib ON lib.anchor_id<>q.msg_id AND (label=prop OR (label+1)%10=prop) GROUP BY ALL),
 lv AS (SELECT prop, avg(mp) AS level FROM f WHERE NOT is_pos GROUP BY prop)
 SELECT prop, count(nullif(is_pos, false)) AS hard_pos, count(nullif(is_pos AND mn>=mp-0.05::DOUBLE, false)) AS boundary_pos, count(nullif(NOT is_pos, false)) AS hard_neg,
 count(nullif(NOT is_pos AND mp>level, false)) AS boundary_neg FROM f JOIN lv USING (prop) GROUP BY prop""")
def boundary_quality(spark, sf):
    own = vector_messages(spark, sf, 1).join(
        table(spark, sf, "embeddings").select(F.col("vec_id").alias("msg_id"), "label"), "msg_id")
    library = vector_library(spark, sf)

    def found(prop):
        return search(own.select("msg_id", "views", prop.alias("prop")), library, 1, floor=False, skip_same=True)
    negatives = cut_lineage(found((F.col("label") + 1) % 10))  # used twice
    return E.boundary_quality(found(F.col("label")), negatives, negatives)


@query("category_allocation", """SELECT source, count(*) AS pool_n, count(quality) AS selected_n FROM documents
 LEFT JOIN (SELECT doc_id, quality FROM labels WHERE quality=1) USING (doc_id) GROUP BY source""")
def category_allocation(spark, sf):
    pool = table(spark, sf, "documents")
    good = table(spark, sf, "labels").filter(F.col("quality") == 1)
    return E.category_allocation(pool, pool.join(good, "doc_id", "left_semi"), ["source"])


@query("drift_stats", """WITH c AS (SELECT vec_id, label<5 AS pos, round(list_cosine_similarity(e, list_transform(list_zip(e, list_reverse(e)),
 lambda x: x[1]+0.1::DOUBLE*x[2])),9) AS c FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))
 SELECT round(1-avg(c) FILTER (WHERE pos),6) AS pos_drift, round(1-avg(c) FILTER (WHERE NOT pos),6) AS neg_drift,
 min(c) AS min_cos, (SELECT vec_id FROM c ORDER BY c, vec_id LIMIT 1) AS min_anchor FROM c""")
def drift_stats(spark, sf):
    before = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("anchor_id"), (F.col("label") < 5).alias("is_positive"), "embedding")
    moved = F.zip_with("embedding", F.reverse("embedding"),
                       lambda a, b: a.cast("double") + b.cast("double") * 0.1)
    out = E.drift_stats(before, before.withColumn("embedding", moved))
    return out.select(F.round("pos_drift", 6).alias("pos_drift"), F.round("neg_drift", 6).alias("neg_drift"),
                      "min_cos", "min_anchor")
