"""The operators as queries over the driver's tables, and DuckDB SQL where it can state the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workforce_signals.llm import (
    alignment,
    bpe,
    conversations,
    decontamination,
    html_extraction,
    hyperminhash,
    jaccard_join,
    language_id,
    nearest,
    personal_data,
    quality,
    sharding,
    token_store,
)
from workforce_signals.plans.stored import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs, vocabulary("piece_bpe_32k.model")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_store.write_tokens(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), path)
    return token_store.token_digests(spark, path)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = personal_data.find(docs, personal_data.train(docs))
    counts = [f"n_{kind}" for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(_table(spark, sf_dir, "conversations"))


def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_sharding, op2_byte_bpe, op3_decontamination, op4_quality_rules, op5_html_text, op6_language_id, op7_token_files,
        op8_jaccard_join, op9_nearest, op10_personal_data, op11_token_alignment,
        op12_conversation_repair, op13_hyperminhash,
    )
    return {query.__name__: query for query in found}


def all_oracles() -> dict[str, str]:
    """Tokenizers and trained models have no SQL; they are tested against brute force instead."""
    return {
        "op1_sharding": sharding.oracle_sql(),
        "op3_decontamination": decontamination.ORACLE_SQL,
        "op8_jaccard_join": jaccard_join.ORACLE_SQL,
        "op12_conversation_repair": conversations.oracle_sql(),
        "op13_hyperminhash": hyperminhash.ORACLE_SQL,
    }
