"""The corpus pipeline: five stages over ``documents``, each applying one operator.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the
documents that go on, with the columns of documents (the last: the encoded texts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm import decontaminate, langid, line_dedup, ngram_join, pieces
from textlens.llm.common import cut, table
from textlens.llm.queries import MODEL

#: Texts of whose trigrams less than this share occurs in the learned texts are rejected.
MIN_KNOWN = 0.6


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts of no learned language: null, without a letter, or spelled like none of them.

    Empty texts go, very long ones are read whole, equal rows go or stay together, an
    empty table stays empty, and all columns come through as they are.
    """
    labelled = docs.select("lang", "text")
    prototypes, known = langid.train_prototypes(labelled), langid.known_trigrams(labelled)
    return langid.in_learned_language(docs, prototypes, known, MIN_KNOWN)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines found on many sites; the first document that has one keeps it.

    No row goes. Null texts stay null, rows with a null key or site keep their lines,
    rows that repeat a key are told apart by their text, other columns are untouched.
    """
    return _recounted(line_dedup.dedup_lines(docs, min_sites=8, counts=False))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates, that of the smallest key.

    Texts without a word, null ones and rows with a null key are nobody's duplicate and
    stay; rows that repeat a key are one document and stay together.
    """
    return ngram_join.keep_one(docs, 0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item; null texts and null keys contain none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts that are left; decoding gives them back. A null text has null ids, an empty one none."""
    return pieces.encode_texts(docs, MODEL)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

#: SQL can't express the language model, the join or the encoder; tests/llm/test_pipeline.py has the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of each is written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
