"""Documents to a training mix: language, repeated lines, near copies, benchmark text, weights."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slotwise.llm import contamination, language, lines, mixing, similar
from slotwise.llm.frames import read, settle


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells clearly; learned from their own labels."""
    return language.accepted(docs, language.learn(docs))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without runs of lines, long ones of one or two included, that repeat earlier ones."""
    return lines.drop_repeated_lines(docs, words=lines.PASSAGE)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of texts that are alike to 0.8 in five-word shingles."""
    return similar.one_of_each(docs)


def unseen_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a trace of the benchmark."""
    return contamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the mix, with probability and weight."""
    return mixing.mixed(docs).where("sampled").drop("sampled")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("lines", fresh_lines),
    ("near-copies", distinct_documents),
    ("benchmark", unseen_benchmark),
    ("mix", weighted_mix),
]

#: Compression by trained dictionaries and fingerprint trees have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that the one before it kept, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
