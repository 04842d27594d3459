"""The corpus pipeline: documents in, clean token ids out.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; every stage but the last returns the
columns of docs, whatever they are called. run() writes each stage's result to the shared folder and reads it again, so a
lost executor costs one stage's work at most.

In every stage an empty table gives no rows, texts of any length are worked on whole, and a null text counts as an empty
one (it stays null where its row stays).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import decontamination, pii, quality, simhash, tokenization
from traceloom.llm.common import drop_between, materialize, table, tables_made
from traceloom.llm.registry import SENTENCEPIECE_MODEL, surrogate_key


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.3) go.

    Rows that repeat are judged alike; null ids only matter for the fold. Without labels of both classes every score is the
    labels' smoothed share, so all rows stay or all go.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the row with the smallest id, null ids last.

    Empty and null texts are copies of each other; rows that repeat an id with other texts are documents of their own; of
    rows that repeat id and text one stays.
    """
    return simhash.keep_representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is verified go.

    Empty and null texts and items match nothing; repeated rows go or stay alike, whatever their ids.
    """
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; n_chars, where there is such a column, follows the new text.

    Every row stays, repeated ones with the same new text, null and empty texts as they are.
    """
    out = pii.replace_entities(docs, surrogate_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded_ok, parity_ok) of the texts that are left.

    Every row gives one, repeated and null ids too; null and empty texts have no ids.
    """
    return tokenization.encode(docs, SENTENCEPIECE_MODEL)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII surrogates", pii_stage),
    ("SentencePiece encoding", encoding_stage),
]

# Neither a classifier fitted on all labels nor SimHash components can be said in SQL; the tests have a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in sequence; what a stage read and its own tables go when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), tables_made()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_between(spark, before, tables_made() - 1)
        before = tables_made() - 1
    return STAGES[-1][1](spark, docs, sf_dir)
