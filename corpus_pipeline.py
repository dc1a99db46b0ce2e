"""From raw documents to packed training sequences: four stages, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargelake.llm.decision_list import fit_rules, quality_rules
from chargelake.llm.packing import pack_documents
from chargelake.llm.prob_minhash import drop_near_duplicates
from chargelake.llm.quality_eb import fit_evidence, quality_scores
from chargelake.llm.util import scratch_dir, table_written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def all_columns(stage: Stage) -> Stage:
    """Further columns of ``docs``, whatever their names, travel as one column and come back in their places."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        more = [c for c in docs.columns if c not in COLUMNS]
        if not more:
            return stage(spark, docs.select(*COLUMNS), sf_dir).select(*docs.columns)
        quoted = [F.col(f"`{c}`") for c in more]
        kept = stage(spark, docs.select(*COLUMNS, F.struct(*quoted).alias("more_")), sf_dir)
        return kept.select(*(F.col(c) if c in COLUMNS else F.col("more_").getField(c).alias(c) for c in docs.columns))

    return run


@all_columns
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality, from their text and their site, is at least one half; fitted to the labels of ``docs``.

    Null, empty and very long texts, null ids, hosts and paths, and repeated rows are judged each by itself as in ``quality_scores``.
    Without labels every document has the same evidence and all stay.  Empty table: no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs, fit_evidence(docs, labels), labels, keep_text=True).filter("kept")


@all_columns
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the decision list learned from the labels of ``docs`` keep.

    Null and empty texts fail the base rules.  Null ids, ties, repeated rows and very long texts: each row by itself.  Without labels
    only the base rules reject.  Empty table: no rows.
    """
    learned = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules(docs, learned, keep_text=True).filter("kept")


@all_columns
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id; of repeated rows one.

    Texts without words (null, empty, white space) all stay.  Very long texts: whole.  Empty table: no rows.
    """
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens.

    Null and empty texts are one end token, very long ones are cut, repeated rows and null ids are documents of their own.
    Empty table: no rows.  Columns are those of ``pack_documents``.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: SQL can express neither the learned classifier and rules nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents; the table of each is written under ``spark.checkpoint.dir`` and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = table_written(stage(spark, docs, sf_dir), scratch_dir(spark))
    return docs
