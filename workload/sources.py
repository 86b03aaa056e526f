"""Readers and writers of the file formats, fed from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwatch.session import new_folder
from turnwatch.sources import readers, sinks
from workload.grounding import vector_library
from workload.registry import documents, query, table

# -- labelled text ------------------------------------------------------------------------


def labelled_content(spark, sf):
    """Every document as labelled text; its language decides the style of the labels."""
    mark = (F.when(F.col("lang") == "en", "\n### MATCH\n").when(F.col("lang") == "de", " ### clean ### ")
            .when(F.col("lang") == "fr", "\n### Warning\n### no match\n").otherwise(" ### "))
    return documents(spark, sf).select(
        F.col("doc_id").alias("file"), F.replace(F.col("text"), F.lit("\n"), mark).alias("content"))


@query("labeled_text_scan", r"""WITH c AS (SELECT doc_id, replace(text, chr(10), CASE lang WHEN 'en' THEN chr(10) || '### MATCH' || chr(10)
 WHEN 'de' THEN ' ### clean ### ' WHEN 'fr' THEN chr(10) || '### Warning' || chr(10) || '### no match' || chr(10) ELSE ' ### ' END) AS content FROM documents),
 p AS (SELECT doc_id, unnest(string_split(content,'###')) AS part, generate_subscripts(string_split(content,'###'),1) AS pos FROM c),
 t AS (SELECT doc_id, pos, regexp_replace(part,'^\s+|\s+$','','g') AS part FROM p),
 h AS (SELECT doc_id, pos, part, upper(trim(string_split(part,chr(10))[1])) AS head, regexp_replace(substr(part, length(string_split(part,chr(10))[1])+1),'^\s+|\s+$','','g') AS rest
 FROM t WHERE part<>''), x AS (SELECT doc_id, pos, 0 AS sub, CASE WHEN head IN ('MATCH','WARNING','NO MATCH','CLEAN') THEN head ELSE part END AS piece FROM h
 UNION ALL SELECT doc_id, pos, 1, rest FROM h WHERE head IN ('MATCH','WARNING','NO MATCH','CLEAN') AND rest<>''),
 l AS (SELECT *, CASE WHEN upper(piece) IN ('MATCH','WARNING') THEN 'MATCH' WHEN upper(piece) IN ('NO MATCH','CLEAN') THEN 'NO MATCH' END AS label FROM x),
 n AS (SELECT *, count(nullif(label IS NULL, false)) OVER (PARTITION BY doc_id ORDER BY pos, sub ROWS UNBOUNDED PRECEDING) AS n FROM l)
 SELECT doc_id, n-1 AS msg_idx, md5(max(CASE WHEN label IS NULL THEN piece END)) AS text,
 arg_min(label, pos*2+sub) FILTER (WHERE label IS NOT NULL) AS label FROM n WHERE n>0 GROUP BY doc_id, n""")
def labeled_text_scan(spark, sf):
    parts = readers.split_labelled(labelled_content(spark, sf))
    return readers.labelled_messages(parts).select(
        F.col("file").alias("doc_id"), "msg_idx", F.md5("text").alias("text"), "label")


@query("labeled_text_files", r"""SELECT count(*) AS messages, count(nullif(length(t)>200, false)) AS long_messages FROM
 (SELECT regexp_replace(unnest(string_split(text,'###')),'^\s+|\s+$','','g') AS t FROM documents) WHERE t<>''""")
def labeled_text_files(spark, sf):
    """Write documents as separated text files and read them back split by separator."""
    path = new_folder(spark, "labelled")
    table(spark, sf, "documents").select(F.col("text").alias("value")).write.option(
        "lineSep", readers.SEPARATOR).text(path)
    out = readers.read_labelled_text(spark, path)
    return out.agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.length("text") > 200).alias("long_messages"))


# -- anchor libraries ------------------------------------------------------------------------


def library_long(spark, sf):
    """One small library per document: its lines are positives, its source the negative."""
    lines = F.split("text", "\n")
    docs = table(spark, sf, "documents")
    base = docs.select(F.col("doc_id").cast("string").alias("name"), F.col("source").alias("proposition"),
                       F.lit("user").alias("role"), "source", "lang", lines.alias("lines"))
    sides = F.array(
        F.struct(F.lit(True).alias("is_positive"), F.lit("lines").alias("category"), F.col("lines").alias("texts")),
        F.struct(F.lit(False).alias("is_positive"), F.lit("source").alias("category"), F.array("source").alias("texts")),
        F.struct(F.lit(None).cast("boolean").alias("is_positive"), F.lit("NEUTRAL").alias("category"),
                 F.array("lang").alias("texts")))
    rows = base.select("name", "proposition", "role", F.explode(sides).alias("s")).select(
        "name", "proposition", "role", "s.is_positive", F.lit(0).alias("category_idx"), "s.category",
        F.posexplode("s.texts").alias("idx", "text"))
    return rows


ANCHOR_SQL = """SELECT doc_id::VARCHAR AS name, 'yes' AS side, 'lines' AS category, generate_subscripts(l,1)-1 AS idx, md5(unnest(l)) AS text,
 0.55::DOUBLE AS match_threshold FROM (SELECT doc_id, string_split(text,chr(10)) AS l FROM documents)
 UNION ALL SELECT doc_id::VARCHAR, 'no', 'source', 0, md5(source), 0.55 FROM documents
 UNION ALL SELECT doc_id::VARCHAR, 'neutral', 'NEUTRAL', 0, md5(lang), 0.55 FROM documents"""
SINK_SQL = f"""SELECT name, side, category, idx, text, coalesce((5 + name::BIGINT % 4) / 10.0, 0.55)::DOUBLE AS match_threshold,
 ((1 + name::BIGINT % 3) / 10.0)::DOUBLE AS warning_threshold FROM ({ANCHOR_SQL})"""


def _side(df, *more):
    side = F.when(F.col("is_positive"), "yes").when(~F.col("is_positive"), "no").otherwise("neutral")
    return df.select("name", side.alias("side"), "category", "idx", F.md5("text").alias("text"), "match_threshold", *more)


@query("anchor_library_scan", ANCHOR_SQL)
def anchor_library_scan(spark, sf):
    lines = F.split("text", "\n")
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("proposition"), F.col("doc_id").cast("string").alias("name"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("double").alias("match_threshold"),
        F.lit(None).cast("double").alias("warning_threshold"), F.create_map(F.lit("lines"), lines).alias("anchors"),
        F.create_map(F.lit("source"), F.array("source")).alias("negative_anchors"), F.array("lang").alias("neutral_anchors"))
    return _side(readers.library_rows(docs))


@query("anchor_library_sink", SINK_SQL)
def anchor_library_sink(spark, sf):
    """Libraries with thresholds of their own, written and read back."""
    path = new_folder(spark, "library")
    name = F.col("name").cast("long")
    sinks.write_anchor_library(library_long(spark, sf).withColumn("match_threshold", (F.lit(5) + name % 4) / 10)
                               .withColumn("warning_threshold", (F.lit(1) + name % 3) / 10), path)
    return _side(readers.read_anchor_library(spark, path, multi_line=False), "warning_threshold")


@query("optimized_vectors_scan", """SELECT label AS prop, true AS is_positive, vec_id AS idx, label<=4 AS optimised,
 round((CASE WHEN label<=4 THEN embedding[64] ELSE embedding[1] END)::DOUBLE,6)+0.0 AS first FROM embeddings UNION ALL
 SELECT (label+1)%10, false, vec_id, (label+1)%10<=4,
 round((CASE WHEN (label+1)%10<=4 THEN embedding[64] ELSE embedding[1] END)::DOUBLE,6)+0.0 FROM embeddings""")
def optimized_vectors_scan(spark, sf):
    """Optimised vectors lack the negatives of half the propositions, so those keep theirs."""
    library = vector_library(spark, sf)
    better = library.filter(F.col("is_positive") | (F.col("prop") <= 4)).withColumn("embedding", F.reverse("embedding"))
    out = readers.with_optimised_vectors(library, better)
    return out.select("prop", "is_positive", "idx", "optimised",
                      F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


# -- datasets -----------------------------------------------------------------------------------


@query("grounding_csv_scan", r"""SELECT source AS proposition_id, lang AS role, doc_id::VARCHAR AS example_id,
 md5(regexp_replace(text,'^\s+|\s+$','','g')) AS text FROM documents""")
def grounding_csv_scan(spark, sf):
    """Write documents as a dataset file with untidy headers and read it back."""
    path = new_folder(spark, "dataset")
    docs = table(spark, sf, "documents")
    docs.select(F.concat(F.lit(" "), "source").alias("﻿Proposition_ID"), F.col("lang").alias(" ROLE "),
                F.col("source").alias("Proposition"), F.lit("positive").alias("example_type "),
                F.col("doc_id").alias("Example_Id"), F.col("text").alias("TEXT")).write.csv(
        path, header=True, escape='"', quoteAll=True)
    return readers.read_grounding_csv(spark, path).select(
        "proposition_id", "role", "example_id", F.md5("text").alias("text"))


@query("dataset_csv_sink", """WITH r AS (SELECT source, doc_id, n_chars>1000 AS pos, row_number() OVER
 (PARTITION BY source, n_chars>1000 ORDER BY doc_id) AS nth FROM documents)
 SELECT source || CASE WHEN pos THEN '_pos_' ELSE '_neg_' END || nth AS example_id,
 CASE WHEN pos THEN 'positive' ELSE 'negative' END AS example_type, doc_id::VARCHAR AS text FROM r""")
def dataset_csv_sink(spark, sf):
    path = new_folder(spark, "examples")
    docs = table(spark, sf, "documents")
    examples = docs.select(
        F.col("source").alias("proposition_id"), F.col("lang").alias("role"), F.col("source").alias("proposition"),
        F.when(F.col("n_chars") > 1000, "positive").otherwise("negative").alias("example_type"),
        F.col("doc_id").alias("idx"), F.col("doc_id").cast("string").alias("text"))
    sinks.write_dataset_csv(examples, path)
    return readers.read_grounding_csv(spark, path).select("example_id", "example_type", "text")
