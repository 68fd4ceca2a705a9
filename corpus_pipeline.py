"""Corpus pipeline: toxicity filter, exact dedup, near-dedup, mixing to target weights, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage to the shared checkpoint folder before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm import exact_dedup, minhash, mixing, sentence_pieces, toxicity
from kvlake.llm._spark import cut, table

#: Three fifths of the tokens that reach the stage, each row once at most.
MIX = mixing.Plan(
    domains=mixing.PRODUCTION.domains, domain_weights=mixing.PRODUCTION.domain_weights, lang_weights=mixing.PRODUCTION.lang_weights, source_weights=mixing.PRODUCTION.source_weights, percent=60, max_epochs=1
)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.7 or more go. Learned from the labelled rows of ``docs`` whose crc32(doc_id) mod 3 is not 1."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    return toxicity.drop_toxic(docs, labels)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (five-word shingles, similarity 0.8) the row with the smallest doc_id stays."""
    return minhash.drop_near_copies(docs, minhash.Settings(words=5))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the budgets take, those without a doc_id too."""
    return mixing.keep_selected(docs, MIX, unnamed=True)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether decoding gives the text back."""
    rows = sentence_pieces.code(docs.select("doc_id", "lang", "source", "text"), sentence_pieces.read_model())
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("sentence_pieces", encoding_stage),
]

#: SQL can't express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
