"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddings, html_text, jaccard, licenses, line_dedup, mixing, negatives, pii, prefix_trie, quality, rules, secrets

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer() -> tuple[str, str]:
    """Path of the ranks and the pattern the production tokenizer uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _over(table: str, digest: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: digest(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": _over("documents", line_dedup.dedup_digest),
        "op2_quality_classifier": _quality,
        "op3_pii": _over("documents", pii.pii_digest),
        "op4_ngram_jaccard_join": _over("documents", jaccard.jaccard_digest),
        "op5_html_extraction": _over("pages", html_text.html_digest),
        "op6_secret_scan": _over("documents", secrets.secrets_digest),
        "op7_byte_bpe": _over("documents", lambda docs: bpe.bpe_digest(docs, *tokenizer())),
        "op8_embedding_dedup": _over("embeddings", embeddings.near_duplicates),
        "op9_quality_rules": _over("documents", rules.rules_digest),
        "op10_source_mixing": _over("documents", mixing.mixing_digest),
        "op11_hard_negatives": _over("embeddings", negatives.hard_negatives),
        "op12_prefix_trie": _over("conversations", prefix_trie.prefix_trie),
        "op13_license_scan": _over("documents", licenses.license_digest),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE_SQL,
        "op9_quality_rules": rules.ORACLE_SQL,
        "op10_source_mixing": mixing.ORACLE_SQL,
        "op11_hard_negatives": negatives.ORACLE_SQL,
        "op12_prefix_trie": prefix_trie.ORACLE_SQL,
        "op13_license_scan": licenses.ORACLE_SQL,
    }
