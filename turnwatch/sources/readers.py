"""Readers: traces, policy tables, labelled text, anchor libraries, datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwatch.functions.text import json_list, strip
from turnwatch.plans.layout import SEGMENT_ROWS, TraceLayout, ranked

# Fixed words of the labelled text format.
LABEL_WORDS = {"MATCH": "MATCH", "WARNING": "MATCH", "NO MATCH": "NO MATCH", "CLEAN": "NO MATCH"}
SEPARATOR = "###"
DATASET_COLUMNS = ("proposition_id", "role", "proposition", "example_type", "example_id", "text")
DEFAULT_MATCH, DEFAULT_WARNING = 0.55, 0.45


def trace_scan(messages: DataFrame, layout: TraceLayout) -> DataFrame:
    """Messages with their 0-based position in the trace."""
    return layout.with_index(messages)


def propositions_scan(raw: DataFrame) -> DataFrame:
    """Proposition rows with their example lists read from JSON text."""
    return raw.select(
        "prop_id", "description", "role",
        json_list(F.col("few_shot_positive")).alias("few_shot_positive"),
        json_list(F.col("few_shot_negative")).alias("few_shot_negative"))


def policies_scan(raw: DataFrame, enabled_only: bool = False, ranks: bool = False) -> DataFrame:
    """Policies in the order they were made; with ``ranks`` their place in it is a column, which outlives
    a shuffle or a written table."""
    out = raw.filter("enabled") if enabled_only else raw
    if ranks:
        rows = ranked(out.withColumn("__one", F.lit(1)), ["__one"], ["created_at", "policy_id"], "rank")
        return rows.withColumn("rank", F.col("rank").cast("int")).drop("__one")
    return out.orderBy("created_at", "policy_id")


# -- labelled text -------------------------------------------------------------------------

def _label(part: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LABEL_WORDS.items() for x in pair])
    return table[F.upper(part)]


def labelled_messages(parts: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Messages and labels from the parts of separated text: ``parts(file, pos, part)``.

    A label stands alone or on the first line of a part; the first label after a message
    is its label; labels before any message are dropped."""
    part = strip(F.col("part"))
    head = F.substring_index(part, "\n", 1)
    rest = strip(F.expr("substring(p, length(substring_index(p, '\\n', 1)) + 1)"))
    pieces = F.when(_label(strip(F.substring_index("p", "\n", 1))).isNotNull(),
                    F.filter(F.array(strip(F.substring_index("p", "\n", 1)), rest), lambda x: x != "")) \
        .otherwise(F.array("p"))
    rows = (parts.select("file", "pos", part.alias("p")).filter(F.col("p") != "")
            .select("file", "pos", F.posexplode(pieces).alias("sub", "piece"))
            .withColumn("label", _label(F.col("piece"))))
    layout = TraceLayout.of(rows, "file", ["pos", "sub"], segment_rows)
    rows = layout.running_sum(rows, {"n": F.when(F.col("label").isNull(), 1).otherwise(0)})
    is_message = F.col("label").isNull()
    return rows.filter(F.col("n") > 0).groupBy("file", (F.col("n") - 1).alias("msg_idx")).agg(
        F.max(F.when(is_message, F.col("piece"))).alias("text"),
        F.min_by("label", F.when(~is_message, F.struct("pos", "sub"))).alias("label"))


def read_labelled_text(spark: SparkSession, path: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Read separated text files. The separator is the record delimiter of the scan, so a
    file of any size is split over tasks and never held whole."""
    raw = spark.read.text(path, lineSep=SEPARATOR).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("nth")).alias("pos"),
        F.col("value").alias("part"))
    return labelled_messages(raw, segment_rows)


def split_labelled(content: DataFrame) -> DataFrame:
    """Parts of texts that are already rows ``(file, content)``."""
    return content.select("file", F.posexplode(F.split("content", SEPARATOR)).alias("pos", "part"))


# -- anchor libraries ------------------------------------------------------------------------

_LIBRARY = ("proposition string, name string, role string, match_threshold double, "
            "warning_threshold double, anchors map<string, array<string>>, "
            "negative_anchors map<string, array<string>>, neutral_anchors array<string>")


def library_rows(docs: DataFrame) -> DataFrame:
    """Nested libraries as long rows. Neutral anchors have a null class."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    neutral = F.create_map(F.lit("NEUTRAL"), F.coalesce("neutral_anchors", F.array().cast("array<string>")))
    sides = F.array(*[F.struct(flag.alias("is_positive"), F.coalesce(c, empty).alias("m")) for flag, c in (
        (F.lit(True), F.col("anchors")), (F.lit(False), F.col("negative_anchors")),
        (F.lit(None).cast("boolean"), neutral))])
    rows = docs.select(
        "name", "proposition", F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("match_threshold", F.lit(DEFAULT_MATCH)).alias("match_threshold"),
        F.coalesce("warning_threshold", F.lit(DEFAULT_WARNING)).alias("warning_threshold"),
        F.explode(sides).alias("s"))
    base = ["name", "proposition", "role", "match_threshold", "warning_threshold", "is_positive"]
    rows = rows.select(*base[:-1], "s.is_positive", F.posexplode("s.m").alias("category_idx", "category", "texts"))
    return rows.select(*base, "category_idx", "category", F.posexplode("texts").alias("idx", "text"))


def read_anchor_library(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return library_rows(spark.read.schema(_LIBRARY).json(path, multiLine=multi_line))


def with_optimised_vectors(library: DataFrame, optimised: DataFrame) -> DataFrame:
    """Use optimised vectors of a proposition only when the number of positives and of
    negatives both agree: ``(prop, is_positive, idx, embedding)`` on either side."""
    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("prop").agg(F.struct(
            F.count_if("is_positive"), F.count_if(~F.col("is_positive"))).alias(name))
    usable = sizes(library, "a").join(sizes(optimised, "b"), "prop").filter(
        F.col("a") == F.col("b")).select("prop", F.lit(True).alias("usable"))
    vectors = optimised.select("prop", "is_positive", "idx", F.col("embedding").alias("better")) \
        .join(usable, "prop")
    out = library.join(vectors, ["prop", "is_positive", "idx"], "left")
    use = F.coalesce("usable", F.lit(False)) & F.col("better").isNotNull()
    return out.withColumn("embedding", F.when(use, F.col("better")).otherwise(F.col("embedding"))) \
        .withColumn("optimised", use).drop("usable", "better")


# -- grounding datasets -----------------------------------------------------------------------

def normalise_dataset(raw: DataFrame) -> DataFrame:
    """Lower-case, trimmed headers without byte-order mark; required columns; trimmed values."""
    names = [c.replace("﻿", "").strip().lower() for c in raw.columns]
    missing = sorted(set(DATASET_COLUMNS) - set(names))
    if missing:
        raise ValueError("dataset lacks columns: " + ", ".join(missing))
    out = raw.toDF(*names)
    return out.select(*[strip(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in names])


def read_grounding_csv(spark: SparkSession, path: str) -> DataFrame:
    return normalise_dataset(spark.read.csv(path, header=True, multiLine=True, escape='"'))
