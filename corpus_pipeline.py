"""The corpus pipeline: five stages, each applied to all rows that the one before it kept.

All stages but the last return the columns of documents, whatever further ones there are and however they are named, and
an empty table for an empty one. Rows are judged one by one, and rows that share a doc_id share the fate of the document.
What each stage does with nulls, empty texts, ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelex.llm import decontaminate, fertility, jaccard, pieces, secrets
from tracelex.llm.common import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility band of their language (null or unknown: of their script). Null,
    empty and short texts have fewer than 20 words and go; repeated rows are judged alike."""
    return fertility.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8) the document with the least id. Rows that share
    the id are one document and stay together; a null id stays, since no id is less; texts without words are in no group."""
    return jaccard.keep_one(docs, words=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item. Null and empty texts have no words and stay; null ids
    match null ids."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows the text. Null texts stay null."""
    return secrets.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids, which decode to the text; a null text has none. The draws are keyed by doc_id,
    so repeated rows get equal ids."""
    return pieces.tokenized(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scans", redaction),
    ("SentencePiece encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no tokeniser; tests/llm compare the stages with brute force instead.
ORACLE_SQL = None
