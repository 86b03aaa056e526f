"""Writers: verdicts, replay results, anchor libraries, datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwatch.plans.layout import ranked


def write_verdicts(verdicts: DataFrame, path: str, mode: str = "append") -> None:
    """Messages with verdict, first violated policy and per-policy map, as nested columns."""
    verdicts.write.mode(mode).parquet(path)


def write_replay_json(summary: DataFrame, outcomes: DataFrame, path: str) -> None:
    """Summary and per-conversation results as JSON lines in two folders."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    outcomes.write.mode("overwrite").json(f"{path}/conversations")


def library_documents(library: DataFrame) -> DataFrame:
    """Long anchors ``(name, proposition, role, match_threshold, warning_threshold, is_positive,
    category_idx, category, idx, text)`` as one nested document per proposition with its thresholds and
    totals. A document gathers the anchors of one proposition; for sets that nobody would read as a document the
    long rows are the better form."""
    thresholds = ["match_threshold", "warning_threshold"]
    library = library.withColumns({c: F.lit(None).cast("double") for c in thresholds if c not in library.columns})
    ident = ["name", "proposition", "role", *thresholds]
    lists = library.groupBy(*ident, "is_positive", "category_idx", "category").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("texts"))
    entry = F.struct("category_idx", "category", "texts")

    def side(cond):
        ordered = F.array_sort(F.collect_list(F.when(cond, entry)))
        return F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["category"], x["texts"])))
    size = F.size("texts")
    pos, neg, none = F.col("is_positive"), ~F.col("is_positive"), F.col("is_positive").isNull()
    return lists.groupBy(*ident).agg(
        side(pos).alias("anchors"), side(neg).alias("negative_anchors"),
        F.flatten(F.collect_list(F.when(none, F.col("texts")))).alias("neutral_anchors"),
        F.struct(F.coalesce(F.sum(F.when(pos, size)), F.lit(0)).alias("total_anchors"),
                 F.coalesce(F.sum(F.when(neg, size)), F.lit(0)).alias("total_negative_anchors"),
                 F.coalesce(F.sum(F.when(none, size)), F.lit(0)).alias("total_neutral_anchors")).alias("metadata"))


def write_anchor_library(library: DataFrame, path: str) -> None:
    library_documents(library).write.mode("overwrite").json(path)


def dataset_rows(examples: DataFrame) -> DataFrame:
    """Number examples per proposition and type: ``p1_pos_1``, ``p1_neg_1``. Input has
    ``(proposition_id, role, proposition, example_type, idx, text)``."""
    rows = ranked(examples, ["proposition_id", "example_type"], ["idx"])
    tag = F.when(F.col("example_type") == "positive", "_pos_").otherwise("_neg_")
    return rows.select("proposition_id", "role", "proposition", "example_type",
                       F.concat("proposition_id", tag, (F.col("position") + 1).cast("string"))
                       .alias("example_id"), "text")


def write_dataset_csv(examples: DataFrame, path: str) -> None:
    dataset_rows(examples).write.mode("overwrite").csv(path, header=True, escape='"')
