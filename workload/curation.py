"""Curation of anchor sets over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwatch.functions.vectors import norm
from turnwatch.operators import curate as C
from turnwatch.operators import evaluate as E
from workload.evaluation import D_SQL, V_SQL, _cos, document_items, knn_scores, vector_items
from workload.grounding import (
    KNN_SQL, LIB_SQL, SIM1_SQL, searched, vector_library)
from workload.registry import query, table

NEAR = 0.995  # letter histograms of copies


def ordered_documents(spark, sf):
    return document_items(spark, sf).select("source", "id", F.col("id").alias("pos"), "vec")


# Greedy selection walks each group in order; the recursion carries the kept ids.
def _greedy_sql(op: str, limit: float) -> str:
    return f"""{D_SQL}, near AS MATERIALIZED (SELECT a.source, a.id AS id, b.id AS other FROM d a JOIN d b
 ON a.source=b.source AND b.id<a.id AND round({_cos('a.v','b.v')},9) {op} {limit}::DOUBLE),
 item AS MATERIALIZED (SELECT d.source, d.id, row_number() OVER (PARTITION BY d.source ORDER BY d.id) AS n,
 coalesce(l, []) AS l FROM d LEFT JOIN (SELECT id, list(other) AS l FROM near GROUP BY id) x ON x.id=d.id),
 walk(source, n, kept) AS (SELECT source, n, [id] FROM item WHERE n=1 UNION ALL
 SELECT w.source, i.n, CASE WHEN list_has_any(w.kept, i.l) THEN w.kept ELSE list_append(w.kept, i.id) END
 FROM walk w JOIN item i ON i.source=w.source AND i.n=w.n+1),
 kept AS MATERIALIZED (SELECT source, unnest(kept) AS id FROM (SELECT source, arg_max(kept, n) AS kept FROM walk GROUP BY source))"""


@query("greedy_dedup", f"WITH RECURSIVE {_greedy_sql('>', NEAR)} SELECT source, id FROM kept")
def greedy_dedup(spark, sf):
    return C.greedy_dedup(ordered_documents(spark, sf), ["source"], NEAR).select("source", "id")


@query("leader_clusters", f"""WITH RECURSIVE {_greedy_sql('>=', NEAR)}, lead AS (SELECT d.source, d.id, CASE WHEN d.id IN (SELECT id FROM kept)
 THEN d.id ELSE (SELECT min(k.id) FROM near k WHERE k.id=d.id AND k.other IN (SELECT id FROM kept)) END AS self,
 (SELECT min(k.other) FROM near k WHERE k.id=d.id AND k.other IN (SELECT id FROM kept)) AS low FROM d),
 l AS (SELECT source, id, CASE WHEN id IN (SELECT id FROM kept) THEN id ELSE low END AS leader FROM lead)
 SELECT source, id, leader, count(*) OVER (PARTITION BY source, leader) AS cluster_size FROM l""")
def leader_clusters(spark, sf):
    return C.leader_clusters(ordered_documents(spark, sf), ["source"], NEAR)


@query("drop_if_earlier_similar", f"""WITH {D_SQL} SELECT source, id FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b
 WHERE b.source=a.source AND b.id<a.id AND round({_cos('a.v','b.v')},9) > 0.98::DOUBLE)""")
def drop_if_earlier_similar(spark, sf):
    return C.drop_if_earlier_similar(ordered_documents(spark, sf), ["source"], 0.98)


@query("novel_only", """SELECT text, min(doc_id) AS id FROM documents WHERE text NOT IN (SELECT text FROM benchmark)
 GROUP BY text""")
def novel_only(spark, sf):
    docs = table(spark, sf, "documents").select("text", F.col("doc_id").alias("id"))
    return C.novel_only(docs, table(spark, sf, "benchmark"))


def document_candidates(spark, sf):
    return document_items(spark, sf).select("id", F.lit("all").alias("prop"), F.col("vec").alias("embedding"))


def benchmark_refs(spark, sf):
    from turnwatch.functions.vectors import letter_histogram
    return table(spark, sf, "benchmark").select(
        F.lit("all").alias("prop"), F.col("item_id").alias("id"), letter_histogram(F.col("text")).alias("embedding"))


B_SQL = """b AS MATERIALIZED (SELECT item_id, list_transform(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z',' '),
 lambda c: (length(lower(text))-length(replace(lower(text),c,'')))::DOUBLE) AS v FROM benchmark)"""


@query("cross_dedup", f"""WITH {D_SQL}, {B_SQL}, s AS (SELECT id, max(round({_cos('d.v','b.v')},9)) AS m FROM d, b GROUP BY id)
 SELECT id, m AS max_sim FROM s WHERE m <= 0.97::DOUBLE""")
def cross_dedup(spark, sf):
    return C.cross_dedup(document_candidates(spark, sf), benchmark_refs(spark, sf), 0.97).select("id", "max_sim")


def class_sides(spark, sf):
    """Positives are the embeddings of a class, negatives those of the class before it."""
    lib = vector_library(spark, sf).withColumnRenamed("anchor_id", "id").drop("idx")
    return lib.filter("is_positive"), lib.filter(~F.col("is_positive"))


SIDE_SQL = f"""{LIB_SQL}, pos AS (SELECT prop, anchor_id AS id, v FROM lib0 WHERE is_positive),
 neg AS (SELECT prop, anchor_id AS id, v FROM lib0 WHERE NOT is_positive),
 s AS (SELECT n.prop, n.id, max(round(list_cosine_similarity(n.v,p.v),9)) AS m FROM neg n JOIN pos p USING (prop) GROUP BY ALL)"""


@query("too_close_filter", f"WITH {SIDE_SQL} SELECT prop, id, m AS max_sim FROM s WHERE m <= 0.3::DOUBLE")
def too_close_filter(spark, sf):
    pos, neg = class_sides(spark, sf)
    return C.too_close_filter(neg, pos, 0.3).select("prop", "id", "max_sim")


@query("nearest_opposite", f"""WITH {SIDE_SQL} SELECT prop, id, m AS max_sim, rank FROM (SELECT *,
 row_number() OVER (PARTITION BY prop ORDER BY m DESC, id) AS rank FROM s) WHERE rank<=10""")
def nearest_opposite(spark, sf):
    pos, neg = class_sides(spark, sf)
    return C.nearest_opposite(neg, pos, 10).select("prop", "id", "max_sim", "rank")


def propositions(spark, sf):
    """The embedding numbered like a class stands for its proposition."""
    return table(spark, sf, "embeddings").join(
        table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi") \
        .select(F.col("vec_id").cast("int").alias("prop"), F.col("embedding").alias("prop_vec"))


@query("offtopic_filter", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
 s AS (SELECT a.vec_id AS id, a.label AS prop, round(list_cosine_similarity(a.v,p.v),9) AS prop_sim FROM e a JOIN e p ON p.vec_id=a.label)
 SELECT * FROM s WHERE prop_sim >= 0.15::DOUBLE""")
def offtopic_filter(spark, sf):
    cand = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("prop"), "embedding")
    return C.off_topic_filter(cand, propositions(spark, sf)).select("id", "prop", "prop_sim")


# -- selection -------------------------------------------------------------------------------------


def labelled_pool(spark, sf):
    """Embeddings by class, with two categories each."""
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("prop"), F.when(F.col("embedding")[0] > 0, "right").otherwise("left").alias("category"),
        F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))


def _quota_sql(n: int) -> str:
    return f"""s AS (SELECT label AS prop, CASE WHEN embedding[1]>0 THEN 'right' ELSE 'left' END AS category, count(*) AS n,
 min(vec_id) AS first FROM embeddings GROUP BY ALL), t AS (SELECT *, n <= {n}//count(*) OVER w AS whole, sum(n) OVER w AS total FROM s WINDOW w AS (PARTITION BY prop)),
 u AS (SELECT *, {n}-sum(CASE WHEN whole THEN n ELSE 0 END) OVER w AS rest, greatest(1,count(nullif(NOT whole, false)) OVER w) AS k,
 row_number() OVER (PARTITION BY prop ORDER BY whole, n DESC, first) AS place FROM t WINDOW w AS (PARTITION BY prop)),
 quotas AS (SELECT prop, category, n, CASE WHEN total<={n} OR whole THEN n ELSE rest//k + CASE WHEN place <= rest%k THEN 1 ELSE 0 END END::INT AS quota FROM u)"""


@query("mmr_quotas", f"WITH {_quota_sql(45)} SELECT * FROM quotas")
def mmr_quotas(spark, sf):
    return C.balanced_quotas(labelled_pool(spark, sf), 45)


# One row per group and step carries the picks so far; every step scores what is left of the group.
MMR_SQL = """near AS MATERIALIZED (SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.v,y.v),9) AS s, x.cl=y.cl AS same
 FROM cand x JOIN cand y ON x.grp=y.grp),
 walk AS (SELECT grp, quota, 1 AS step, [list(id ORDER BY rel DESC, id)[1]] AS picks FROM cand WHERE n > quota AND quota > 0 GROUP BY grp, quota
 UNION ALL SELECT grp, quota, step+1, list_append(any_value(picks), list(id ORDER BY open DESC, CASE WHEN open THEN score END DESC, id)[1]) FROM (
  SELECT w.grp, w.quota, w.step, c.id, any_value(w.picks) AS picks, any_value(lam)*any_value(c.rel) - (1-any_value(lam))*max(s) AS score,
   count(nullif(same,false)) < any_value(c.cap) AS open
  FROM (SELECT *, CASE WHEN quota <= 2 THEN 0.5::DOUBLE ELSE 0.8::DOUBLE + (0.2::DOUBLE-0.8::DOUBLE)*(step-1)/(quota-2) END AS lam FROM walk WHERE step < quota) w
  JOIN cand c ON c.grp=w.grp AND NOT list_contains(w.picks, c.id) JOIN near ON a=c.id AND list_contains(w.picks, b)
  GROUP BY w.grp, w.quota, w.step, c.id) GROUP BY grp, quota, step),
 picked AS (SELECT grp, unnest(picks) AS id, generate_subscripts(picks,1)-1 AS pick FROM walk WHERE step=quota UNION ALL
 SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY id)-1 FROM cand WHERE n <= quota)"""


@query("mmr_balanced", f"""WITH RECURSIVE {_quota_sql(15)}, cand AS MATERIALIZED (SELECT [prop::VARCHAR, q.category] AS grp, quota, n, 0 AS cl, n AS cap, e.vec_id AS id,
 e.embedding::DOUBLE[] AS v, round(list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[]),9) AS rel
 FROM embeddings e JOIN embeddings p ON p.vec_id=e.label JOIN quotas q ON prop=e.label AND category=CASE WHEN e.embedding[1]>0 THEN 'right' ELSE 'left' END),
 {MMR_SQL} SELECT grp[1]::INT AS prop, grp[2] AS category, id, pick::INT AS pick FROM picked""")
def mmr_balanced(spark, sf):
    return C.mmr_balanced(labelled_pool(spark, sf), propositions(spark, sf), 15)


# Farthest-first seeds by recursion, then the Lloyd steps one after the other.
def _kmeans_sql(rounds: int) -> str:
    """``k{rounds}(grp, id, cl)`` from ``item(grp, id, v, k)``."""
    steps = ["""far AS MATERIALIZED (SELECT x.grp, x.id AS a, y.id AS b, round(list_distance(x.v,y.v)**2, 9) AS d FROM item x JOIN item y ON x.grp=y.grp),
 seed AS (SELECT grp, k, [min(id)] AS ids FROM item GROUP BY grp, k UNION ALL
  SELECT grp, k, list_append(any_value(ids), list(a ORDER BY d DESC, a)[1]) FROM (
   SELECT s.grp, s.k, a, any_value(ids) AS ids, min(d) AS d FROM seed s JOIN far f ON f.grp=s.grp AND list_contains(s.ids, f.b)
   WHERE len(s.ids) < s.k GROUP BY s.grp, s.k, a HAVING min(d) > 0) GROUP BY grp, k),
 c0 AS MATERIALIZED (SELECT s.grp, list_position(ids, id)-1 AS cl, v FROM (SELECT grp, arg_max(ids, len(ids)) AS ids FROM seed GROUP BY grp) s
  JOIN item i ON i.grp=s.grp AND list_contains(ids, id))"""]
    for i in range(rounds + 1):
        steps.append(f"""k{i} AS MATERIALIZED (SELECT i.grp, i.id, any_value(i.v) AS v, list(c.cl ORDER BY round(list_distance(i.v,c.v)**2, 9), c.cl)[1] AS cl
 FROM item i JOIN c{i} c ON c.grp=i.grp GROUP BY i.grp, i.id)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.grp, c.cl, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT grp, cl, list(x ORDER BY j) AS v
 FROM (SELECT grp, cl, j, avg(v[j]) AS x FROM k{i}, range(1, 1 + (SELECT max(len(v)) FROM item)) t(j) GROUP BY grp, cl, j) GROUP BY grp, cl) m
 ON m.grp=c.grp AND m.cl=c.cl)""")
    return ", ".join(steps)


@query("grouped_kmeans", f"""WITH RECURSIVE item AS MATERIALIZED (SELECT label AS grp, vec_id AS id, embedding::DOUBLE[] AS v, 3 + label % 3 AS k
 FROM embeddings), {_kmeans_sql(3)} SELECT grp AS label, id, cl::INT AS cluster FROM k3""")
def grouped_kmeans(spark, sf):
    items = vector_items(spark, sf).select("label", "id", "vec", (3 + F.col("label") % 3).alias("k"))
    return C.grouped_kmeans(items, ["label"], rounds=3).select("label", "id", "cluster")


@query("mmr_clusters", f"""WITH RECURSIVE size AS (SELECT label, count(*) AS n, least(count(*)-1, greatest(4, 2*count(DISTINCT embedding[1]>0))) AS k
 FROM embeddings GROUP BY label), item AS MATERIALIZED (SELECT label AS grp, vec_id AS id, embedding::DOUBLE[] AS v, k FROM embeddings JOIN size USING (label)
 WHERE n > 12), {_kmeans_sql(3)}, cand AS MATERIALIZED (SELECT e.label AS grp, 12 AS quota, n, coalesce(k3.cl, 0) AS cl, greatest(3, 12//k*2) AS cap, e.vec_id AS id,
 e.embedding::DOUBLE[] AS v, round(list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[]),9) AS rel
 FROM embeddings e JOIN embeddings p ON p.vec_id=e.label JOIN size ON size.label=e.label LEFT JOIN k3 ON k3.id=e.vec_id),
 {MMR_SQL} SELECT grp::INT AS prop, id, pick::INT AS pick FROM picked""")
def mmr_clusters(spark, sf):
    return C.mmr_clusters(labelled_pool(spark, sf), propositions(spark, sf), 12, rounds=3)


@query("mmr_cluster")
def mmr_cluster(spark, sf):
    pool = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"),
        F.col("label").alias("category"))
    target = pool.orderBy("id").first()["vec"]
    return C.mmr_cluster(pool, target, 40)


# -- boundary and mining ------------------------------------------------------------------------------


def binary_items(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("label") < 5).cast("int").alias("label"))


@query("low_margin")
def low_margin(spark, sf):
    return C.low_margin(binary_items(spark, sf)).select("id", "label", F.round("margin", 6).alias("margin"))


@query("weak_zones")
def weak_zones(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return C.weak_zones(C.low_margin(binary_items(spark, sf)), texts)


@query("zone_report", """WITH d AS (SELECT doc_id AS id, (quality=1)::INT AS label, doc_id%7 AS cluster FROM labels),
 r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id) AS nth FROM d),
 s AS (SELECT cluster, count(nullif(label=1,false)) AS n_pos, count(nullif(label=0,false)) AS n_neg,
 md5(string_agg(text, '|' ORDER BY nth)) AS shown FROM r JOIN documents ON doc_id=id WHERE nth<=6 GROUP BY cluster)
 SELECT cluster, count(*) AS size, any_value(n_pos) AS n_pos, any_value(n_neg) AS n_neg, any_value(shown) AS shown,
 CASE WHEN any_value(n_pos)<any_value(n_neg) THEN 'positive' WHEN any_value(n_neg)<any_value(n_pos) THEN 'negative' ELSE 'both' END AS "add"
 FROM d JOIN s USING (cluster) GROUP BY cluster HAVING count(*)>=2""")
def zone_report(spark, sf):
    """The report on given zones, with the texts it shows."""
    zones = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"), (F.col("doc_id") % 7).alias("cluster"))
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return C.zone_report(zones, texts).withColumn("shown", F.md5(F.array_join("texts", "|"))).drop("texts")


@query("hard_mining", f"""WITH {SIM1_SQL}, {KNN_SQL}, s AS (SELECT msg_id, prop, score, label=prop AS pos FROM knn JOIN q USING (msg_id))
 SELECT msg_id, prop, round(score,6) AS score, CASE WHEN pos THEN 'false_negative' ELSE 'false_positive' END AS failure FROM s
 WHERE (score>0.50) <> pos""")
def hard_mining(spark, sf):
    return C.hard_mining(knn_scores(spark, sf)).withColumn("score", F.round("score", 6))


@query("fix_budget", f"""WITH {SIM1_SQL}, {KNN_SQL}, s AS (SELECT prop, score>0.50 AS hit, label=prop AS pos FROM knn JOIN q USING (msg_id))
 SELECT prop, CASE WHEN pos THEN 'false_negative' ELSE 'false_positive' END AS failure, least(15, 3*count(*)) AS budget FROM s
 WHERE hit <> pos GROUP BY ALL""")
def fix_budget(spark, sf):
    return C.fix_budget(C.hard_mining(knn_scores(spark, sf)))


@query("adversarial_rank", f"""WITH {SIM1_SQL}, {KNN_SQL} SELECT msg_id, prop, round(score,6) AS score, max_pos,
 CASE WHEN score>=0.7 THEN 'high' WHEN score>=0.4 THEN 'medium' ELSE 'low' END AS risk,
 (row_number() OVER (PARTITION BY prop ORDER BY score DESC, max_pos DESC, msg_id) - 1)::INT AS rank FROM knn""")
def adversarial_rank(spark, sf):
    return C.adversarial_rank(searched(spark, sf, 20, views=1, floor=False)).withColumn("score", F.round("score", 6))


# -- merging and sampling --------------------------------------------------------------------------------


@query("merge_anchor_sets", """WITH u AS (SELECT lang AS prop, source AS category, doc_id AS idx, text, 0 AS src FROM documents UNION ALL
 SELECT lang, source, -doc_id, text, 1 FROM documents JOIN labels USING (doc_id))
 SELECT prop, category, idx, row_number() OVER (PARTITION BY prop, category ORDER BY src, idx)-1 AS new_idx FROM u""")
def merge_anchor_sets(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("lang").alias("prop"), F.col("source").alias("category"), F.col("doc_id").alias("idx"), "text", "doc_id")
    extra = docs.join(table(spark, sf, "labels"), "doc_id").withColumn("idx", -F.col("idx"))
    return C.merge_anchor_sets([docs, extra]).select("prop", "category", "idx", "new_idx")


@query("replace_low_variance", """WITH o AS (SELECT source AS category, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)-1 AS k,
 count(*) OVER (PARTITION BY source) AS n FROM documents), r AS (SELECT source AS category, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)-1 AS k
 FROM documents JOIN labels USING (doc_id)), m AS (SELECT category, 0 AS part, k, doc_id AS id FROM o WHERE k < greatest(1, n//3) UNION ALL
 SELECT category, 1, k, doc_id FROM r), z AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY part, k)-1 AS position FROM m)
 SELECT category, part, position, id FROM z JOIN (SELECT category, max(n) AS n FROM o GROUP BY category) USING (category) WHERE position < n+2""")
def replace_low_variance(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("category"), F.col("doc_id").alias("idx"), F.col("doc_id").cast("string").alias("text"))
    spare = docs.join(table(spark, sf, "labels"), "doc_id")
    return C.replace_low_variance(docs, spare).select(
        "category", "part", "position", F.col("text").cast("long").alias("id"))


@query("stratified_folds", """SELECT doc_id AS id, quality AS label, ((row_number() OVER (PARTITION BY quality
 ORDER BY md5(doc_id || '|42'), doc_id) - 1) % 5)::INT AS fold FROM labels""")
def stratified_folds(spark, sf):
    items = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return C.stratified_folds(items, 5)


@query("stratified_fold_sizes", """WITH c AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY quality)
 SELECT label, fold::INT AS fold, n//5 + CASE WHEN fold < n%5 THEN 1 ELSE 0 END AS size FROM c, range(5) r(fold)""")
def stratified_fold_sizes(spark, sf):
    return stratified_folds(spark, sf).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("size"))


@query("balance_classes", """WITH r AS (SELECT doc_id, quality AS label, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS rn FROM labels)
 SELECT doc_id, label FROM r WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""")
def balance_classes(spark, sf):
    items = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"), F.col("doc_id").alias("idx"))
    return C.balance_classes(items).select("doc_id", "label")


@query("few_shot_sample")
def few_shot_sample(spark, sf):
    docs = document_items(spark, sf).select(F.lit(1).alias("g"), "id", F.col("id").alias("pos"), "vec")
    return C.few_shot_sample(docs, C.leader_clusters(docs, ["g"], NEAR))


@query("anchor_refine")
def anchor_refine(spark, sf):
    anchors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("anchor_id"), (F.col("label") < 5).alias("is_positive"), "embedding")
    out = C.anchor_refine(anchors, binary_items(spark, sf), epochs=3, folds=3, rate=0.01)
    return out.select("anchor_id", "is_positive", "epochs", F.round(F.col("embedding")[0], 6).alias("first"))


@query("refine_gradient", """WITH e AS (SELECT vec_id AS id, (label<5)::INT AS y, embedding::DOUBLE[] AS v, sqrt(list_dot_product(v,v)) AS size FROM embeddings),
 p AS (SELECT x.id AS q, a.id AS a, x.y, a.y AS hit, round(list_cosine_similarity(x.v,a.v),9) AS s FROM e x, e a),
 n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, hit DESC, a) <= 20),
 x AS (SELECT *, exp((s - max(s) OVER (PARTITION BY q))/0.5::DOUBLE) AS x FROM n),
 w AS (SELECT *, x/sum(x) OVER (PARTITION BY q) AS w FROM x), r AS (SELECT *, sum(w*hit) OVER (PARTITION BY q) AS raw FROM w),
 d AS (SELECT *, CASE WHEN y=1 THEN -1/(raw+1e-10::DOUBLE) ELSE 1/(1-raw+1e-10::DOUBLE) END * w * (hit-raw)/0.5::DOUBLE AS d FROM r
  WHERE raw > 1e-7::DOUBLE AND raw < 1-1e-7::DOUBLE),
 g AS (SELECT d.a, i, sum(d.d * (q.v[i]/q.size - d.s*b.v[i]/b.size))/any_value(b.size) AS g
  FROM d JOIN e q ON q.id=d.q JOIN e b ON b.id=d.a, range(1, 1 + (SELECT max(len(v)) FROM e)) t(i) GROUP BY d.a, i)
 SELECT id AS anchor_id, round(coalesce(any_value(g) FILTER (i=1), 0), 6) + 0 AS first, round(coalesce(sqrt(sum(g*g)), 0), 6) AS steep
 FROM e LEFT JOIN g ON a=id GROUP BY id""")
def refine_gradient(spark, sf):
    """The gradient that the first step of a refinement on all examples takes."""
    examples = binary_items(spark, sf).select(F.col("id").alias("key"), "vec", "label", F.lit(0).alias("fold"))
    anchors = binary_items(spark, sf).select(F.lit(-1).alias("run"), F.col("id").alias("key"), (F.col("label") == 1).alias("is_positive"),
                                             F.col("id").alias("idx"), F.col("vec").alias("embedding"))
    grads = C.loss_gradient(anchors, C.soft_vote_sums(examples, anchors, 20, 0.5))
    return grads.select(F.col("key").alias("anchor_id"), (F.round(F.col("gradient")[0], 6) + 0.0).alias("first"),
                        F.round(norm(F.col("gradient")), 6).alias("steep"))


@query("diversity_gain", f"""WITH {V_SQL},
 a AS (SELECT a.label, sum({_cos('a.v','b.v')})*2 AS s FROM v a JOIN v b ON a.label=b.label AND a.id<b.id GROUP BY a.label),
 n AS (SELECT label, count(*) AS n FROM v GROUP BY label)
 SELECT label, round((1-(s/(n*n))/((s+n)/(n*n)+1e-10::DOUBLE))*100,6) AS gain FROM a JOIN n USING (label)""")
def diversity_gain(spark, sf):
    """Improvement figure of a selection that keeps its whole pool."""
    stats = E.mean_similarity(vector_items(spark, sf), ["label"])
    pool = F.col("mean_sim") + 1 / F.col("n")  # the pool average counts the diagonal
    return stats.select("label", F.round(E.diversity_gain(pool, F.col("mean_sim")), 6).alias("gain"))
