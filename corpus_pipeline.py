"""Training-text pipeline: toxicity, near-duplicates, personal data, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loanbook.llm import bpe, lsh_forest, mixing, pii
from loanbook.llm.common import staged, table
from loanbook.llm.queries import judged_toxicity, tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; the rest stay as they are, null and empty texts included."""
    return judged_toxicity(spark, docs, sf_dir).filter("predicted = 0").select(docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return lsh_forest.one_of_each(docs, lsh_forest.Likeness(words=5, part=80))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars is counted anew where a text changes."""
    return pii.mask(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the remaining sources: a document comes once for each round in which blocks of it are used."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text that they decode to."""
    return bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path())


STAGES = [("toxicity", without_toxic), ("minhash", without_copies), ("pii", without_personal_data), ("mixing", mixed), ("bpe", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
