"""A corpus pipeline over documents: each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlspike.llm.common import materialize
from marlspike.llm.jaccard_join import keep_one
from marlspike.llm.language_id import keep_identified
from marlspike.llm.mixing import mixed
from marlspike.llm.packing import pack
from marlspike.llm.queries import vocabulary
from marlspike.llm.secrets import redact_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null and empty texts, texts without a letter and those that no language fits go; where no row is labelled, every
    text with a letter stays. Ties and repeated rows are read each; an empty table stays empty."""
    return keep_identified(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies: 80 % of their five-word shingles in common.

    Null and empty texts link with nothing and stay, repeated rows become one, and rows without doc_id stay once for each distinct text."""
    return keep_one(docs, size=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets blotted out and n_chars counted anew; null and empty texts, repeated rows and null columns stay as they are."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a last part of one as its first words; texts without a word are taken no time and go, a null source is
    a source of its own, rows that are equal or share a doc_id are rows each."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; null and empty texts are an end token, repeated rows are packed each, no rows give no pieces."""
    return pack(docs, vocabulary())


STAGES = [("language ID", language_id), ("n-gram Jaccard join", jaccard_join), ("secret scans", secret_scans), ("mixing", mixing), ("packing", packing)]

#: Language ID, secret linking and packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs
