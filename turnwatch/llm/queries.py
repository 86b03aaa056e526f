"""Registered queries of the operators, with checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwatch.llm import (
    alignment, bpe, collocations, jaccard_join, language_id, line_dedup, mixing, quality_rules, substring_dedup, suffix_dedup, token_order,
    topk_search, vptree)
from turnwatch.llm.rows import table, written
from turnwatch.session import new_folder, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Further queries beside the one of each operator.
MORE: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, into: dict = QUERIES):
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(spark, folder)
        into[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_suffix_dedup")
def op1(spark, folder):
    """Every document without the bytes of 200-byte strings that start twice or more in the corpus."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffix_dedup.suffix_dedup(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_jaccard_join")
def op2(spark, folder):
    """Shingle count and component of every document."""
    return jaccard_join.jaccard_components(table(spark, folder, "documents").select("doc_id", "text"))


@query("op3_line_dedup", r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS w
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM split WHERE len(ls) >= 3)),
ink AS (SELECT * FROM w WHERE regexp_matches(w, '[^\x20\x09-\x0D]')),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM ink),
gone AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM ranked WHERE r > 1),
kept AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS kept, count(*) AS n FROM
         (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM split) ANTI JOIN gone USING (doc_id, i)
         GROUP BY doc_id)
SELECT s.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines,
       (coalesce(len(ls), 0) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(kept, '') END) AS kept_sha256
FROM split s LEFT JOIN kept USING (doc_id)""")
def op3(spark, folder):
    """Lines and removed lines of every document, and the digest of the text that is left."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op4_topk_search", """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([p[1] * p[2] FOR p IN list_zip(q.w, c.w)])::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op4(spark, folder):
    """The five vectors of highest quantised inner product for every fiftieth vector."""
    rows = topk_search.quantised(table(spark, folder, "embeddings"), "vec_id", "embedding")
    found = topk_search.topk_search(rows.filter(F.col("id") % 50 == 0), rows, 5)
    return found.withColumnRenamed("item_id", "vec_id")


@query("op5_nearest")
def op5(spark, folder):
    """The ten nearest vectors found for every hundredth vector."""
    rows = vptree.usable(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return vptree.nearest(rows.filter(F.col("id") % 100 == 0), rows, 10).withColumnRenamed("item_id", "vec_id")


@query("op6_language_id")
def op6(spark, folder):
    """Language of every document, by a model that never sees the held-out fifth."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return language_id.predict(docs, language_id.fit(docs))


@query("op7_bpe")
def op7(spark, folder):
    """Every document encoded and decoded again, as digests."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                            digests=True)


# Shares of sources and languages are flattened by these exponents, topics are made equal.
MIX_TARGETS = {"source": 0.7, "lang": 0.5, "topic": 0.0}
MIX_KEEP = 0.5


def mix_dims() -> dict:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.form("text")}


def _mix_sql() -> str:
    """The same fit as a chain of tables, a step per round and dimension; the scale that keeps the
    wanted share of tokens is found over the cells in order of their rate."""
    ctes = [r"""d AS (SELECT doc_id, coalesce(source, '<null>') AS source, coalesce(lang, '<null>') AS lang,
               CASE WHEN contains(text, '|') THEN 'table' WHEN length(text) >= 2000 THEN 'long' ELSE 'prose' END AS topic,
               coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens FROM documents)""",
            """c0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, sum(tokens)::DOUBLE AS weight
               FROM d GROUP BY ALL HAVING sum(tokens) > 0)"""]
    for dim, power in MIX_TARGETS.items():
        ctes.append(f"""goal_{dim} AS (SELECT {dim}, r / sum(r) OVER () * sum(t) OVER () AS goal FROM
                    (SELECT {dim}, sum(tokens) AS t, pow(sum(tokens), {power}) AS r FROM c0 GROUP BY 1))""")
    at = 0
    for _ in range(mixing.ROUNDS):
        for dim in MIX_TARGETS:
            ctes.append(f"""c{at + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * (goal / have) AS weight FROM c{at}
                        JOIN (SELECT {dim}, sum(weight) AS have FROM c{at} GROUP BY 1) USING ({dim}) JOIN goal_{dim} USING ({dim}))""")
            at += 1
    return "WITH " + ",\n".join(ctes) + f""",
ranked AS (SELECT *, weight / tokens AS rate, row_number() OVER o AS r,
                  coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
                  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
           FROM c{at} WINDOW o AS (ORDER BY weight / tokens DESC, source, lang, topic)),
scale AS (SELECT ({MIX_KEEP} * (SELECT sum(tokens) FROM c0) - fixed) / free AS s FROM ranked
          WHERE ({MIX_KEEP} * (SELECT sum(tokens) FROM c0) - fixed) / free * rate < 1 ORDER BY r LIMIT 1),
p AS (SELECT source, lang, topic, least(1.0, rate * (SELECT s FROM scale)) AS probability FROM ranked),
m AS (SELECT doc_id, tokens, CASE WHEN tokens = 0 THEN 1.0 ELSE coalesce(probability, 1.0) END AS probability
      FROM d LEFT JOIN p USING (source, lang, topic))
SELECT doc_id, tokens, round(probability, 6) AS probability,
       ('0x' || substr(md5(doc_id || '|0'), 1, 8))::BIGINT / 4294967296.0 < probability AS sampled FROM m"""


@query("op8_mixing", _mix_sql())
def op8(spark, folder):
    """Every document's chance under the raked weights, and whether it is drawn."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, mix_dims(), MIX_TARGETS, mixing.word_count("text"), MIX_KEEP)
    return mixed.select("doc_id", "tokens", F.round("probability", 6).alias("probability"), "sampled")


@query("op9_token_order")
def op9(spark, folder):
    """Every document's byte tokens written in training order, and where each sequence stands."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_order.materialise(docs, token_order.byte_tokens("text"), new_folder(spark, "shards"), key=20240229)


#: The end of a document and what fills its last sequence: above the 50,256 ids of the rank file.
END_ID = 0xFFFF


@query("op9_token_ids", into=MORE)
def op9_ids(spark, folder):
    """Every document's token ids written in training order: texts are encoded once, counted and written from a table."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = written(bpe.token_ids(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, END_ID), "ids")
    return token_order.materialise(coded, F.col("ids"), new_folder(spark, "shards"), key=20240229, width=2,
                                   pad=END_ID.to_bytes(2, "little"))


@query("op10_substring_dedup")
def op10(spark, folder):
    """Every document without the words of windows of twenty words that also start earlier."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_alignment")
def op11(spark, folder):
    """Every document's tokens by two tokenizers, cut into groups where both end, and how common its links are."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
                           public_tokenizers.PATTERN)


@query("op12_collocations", r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang,
                  string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, [w FOR w IN ws IF w <> ''] AS ws FROM (SELECT lang, string_split_regex(unnest(ps), '[\x20\x09]+') AS ws FROM d)),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM
      (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) t(k) WHERE len(ws) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k >= 2 AND f >= 30),
cuts AS (SELECT lang, phrase, k, a, ws, unnest(range(1, k)) AS cut FROM c),
scored AS (SELECT x.lang, x.phrase, x.k, x.a, x.ws, cut, l.f AS l, r.f AS r, ((2000000 * x.a::HUGEINT) // (l.f + r.f))::BIGINT AS score FROM cuts x
           JOIN g l ON l.lang = x.lang AND l.phrase = array_to_string(ws[1:cut], ' ')
           JOIN g r ON r.lang = x.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM
          (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) t(m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN parts USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""")
def op12(spark, folder):
    """The first two thousand collocations of each language."""
    return collocations.collocations(table(spark, folder, "documents").select("text", "lang"))


def _rules_sql() -> str:
    """The measures by plain windows; a document is kept where no rule fails, whatever their order."""
    return r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM documents),
w AS (SELECT doc_id, i, ws[i:i + 4] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2, 3, 4]) AS j FROM twice) GROUP BY doc_id),
m AS (SELECT d.doc_id, t, ws, ls, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN ws]), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
             (word_chars < 2 * n_words OR word_chars > 20 * n_words OR n_symbols > n_words OR 100 * n_dup_lines > 60 * len(ls)
              OR 100 * len([x FOR x IN ls IF regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')]) > 90 * len(ls)
              OR 100 * len([x FOR x IN ls IF regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')]) > 30 * len(ls)
              OR 100 * len([x FOR x IN ws IF regexp_matches(x, '\p{L}')]) < 50 * n_words
              OR 100 * len(regexp_extract_all(t, '[A-Z]')) > 60 * word_chars) AS bad FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM b"""


@query("op13_quality_rules", _rules_sql())
def op13(spark, folder):
    """Measures of every document and whether the rules keep it."""
    judged = quality_rules.quality(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")
