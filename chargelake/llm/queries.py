"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe_tree import digest_bpe
from .chat import PERSPECTIVES_SQL, rotate_perspectives
from .decision_list import fit_rules, quality_rules
from .divergence import DIVERGENCE_SQL, source_divergence
from .hamming_topk import HAMMING_SQL, hamming_neighbors
from .katz import score_katz
from .ngram_join import jaccard_components
from .packing import pack_documents
from .prob_minhash import near_duplicates
from .quality_eb import fit_evidence, quality_scores
from .resampling import importance_resampling
from .token_counts import count_tokens
from .toxicity import fit_toxicity, score_toxicity
from .util import doc_crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(table(spark, sf_dir, "documents"), path, keep=["doc_id"])


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "link_id", "n_copies")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_katz(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (doc_crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_scores(docs, fit_evidence(docs, labels), labels)
    return scored.select("doc_id", "doc_p", "site_p", "quality_p", "kept")


def op7_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op8_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_neighbors(table(spark, sf_dir, "embeddings"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality_rules(docs.select("doc_id", "text"), fit_rules(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_token_counts, op2_near_dup, op3_packing, op4_katz, op5_toxicity,
            op6_quality, op7_chat_perspectives, op8_hamming_topk, op9_bpe_codec, op10_quality_rules,
            op11_source_divergence, op12_importance_resampling, op13_ngram_join,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_perspectives": PERSPECTIVES_SQL, "op8_hamming_topk": HAMMING_SQL, "op11_source_divergence": DIVERGENCE_SQL}
