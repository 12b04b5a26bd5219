"""A corpus from raw documents to token ids: classify, drop repeated lines, drop near copies, mix, encode.

Every stage takes and, but for the last, returns the columns of documents; other columns go.
Nulls are allowed in any of them. A row without a doc_id is a document of its own. Rows that
repeat a doc_id are decided by their own text, except that of near copies all rows of a
doc_id stay if one does. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindsight.llm import bpe, jaccard, line_dedup, mixing, quality
from hindsight.llm.common import materialise
from hindsight.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject; it learns from the labelled documents of its input.

    A null or empty text is scored like any other, by statistics that are all 0.
    """
    return quality.keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of repeated three-line windows; n_chars follows the text. No document goes; a null text stays null."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: five words, similarity 0.8 or more. Documents without words stay."""
    return jaccard.keep_one(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them; those without words never. A null source is a source."""
    return mixing.repeat_documents(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of token ids and decoded bytes, one row per document copy; a null text is an empty one."""
    return bpe.bpe_digest(docs, *tokenizer())


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix),
    ("byte_bpe", tokenize),
]

#: A discriminant, components and merges have no SQL; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
