"""Training-data pipeline over ``documents``: five stages, each written and read again."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwatch.llm import bpe, jaccard_join, language_id, line_dedup, mixing
from turnwatch.llm.queries import ORACLES, QUERIES, mix_dims
from turnwatch.session import new_folder, ship

#: A document whose likeliest language has less than this share of the score is rejected.
MIN_SCORE = 0.5
#: Shares are flattened a little and most tokens stay.
TARGETS = {"source": 0.9, "lang": 0.9, "topic": 0.9}
KEEP = 0.95


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those whose language is in doubt, go."""
    found = language_id.identified(docs, language_id.fit(docs))
    kept = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return kept.select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which nothing is left goes with them."""
    cut = line_dedup.line_dedup(docs).filter("n_removed = 0 OR n_removed < n_lines")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at a similarity of 0.8, the one of
    smallest id stays. Documents without an id stay."""
    found = jaccard_join.jaccard_components(docs, words=5, percent=80)
    first = found.filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(*docs.columns).union(docs.filter("doc_id IS NULL"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by raked probabilities; a category too rare for its target stays whole."""
    mixed = mixing.mix(docs, mix_dims(), TARGETS, mixing.word_count("text"), KEEP, bounded=True)
    return mixed.filter("sampled").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded_sha256)`` of every document."""
    coded = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


#: Rows handed to a Python worker at a time: documents are long, and the workers of all stages share an executor.
BATCH_ROWS = 1000


#: The columns of ``documents`` that stages work on.
CORE = ["doc_id", "text", "lang", "source", "n_chars"]


def _shipped(stage):
    """The stage, with the package handed to the Python workers and their batches kept small. Further columns
    travel packed in one, so that none of them meets a name that an operator adds."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        extra = [c for c in docs.columns if c.lower() not in CORE]
        if not extra:
            return stage(spark, docs, sf_dir)
        core = [c for c in docs.columns if c not in extra]
        out = stage(spark, docs.select(*core, F.struct(*[F.col(f"`{c}`") for c in extra]).alias("_extra")), sf_dir)
        if "_extra" not in out.columns:
            return out
        return out.select(*[F.col(f"_extra.`{c}`") if c in extra else F.col(c) for c in docs.columns])
    return run_stage


STAGES = [(name, _shipped(stage)) for name, stage in (
    ("language_id", language), ("line_dedup", lines), ("jaccard_join", near_copies), ("mixing", mixture), ("bpe", tokens))]
#: No SQL for a trained model: ``run`` is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs


QUERIES["pipeline"] = run
