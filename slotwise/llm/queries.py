"""The operators as named queries over the given tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import (
    contamination,
    language,
    lines,
    merkle,
    mixing,
    near_copies,
    outliers,
    phrases,
    secret_scan,
    sketches,
    suffix_columns,
    warc,
    word_index,
)
from slotwise.llm.frames import read, scratch_path

def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents that no language is learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def learned(docs: DataFrame) -> language.LanguageModel:
    return language.learn(docs.where(~F.coalesce(held_out(), F.lit(False))))


def op1_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by the dictionary that makes it smallest."""
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs, learned(docs))
    return found.select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected"
    )


def op2_zstandard_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its archived record tells it."""
    folder = scratch_path(spark, "warc")
    if folder.startswith("/"):
        folder = f"file://{folder}"
    return warc.round_trip(read(spark, sf_dir, "pages"), folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"
    )


def op3_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.secrets(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "n_dense", "base_sha256", "spans"
    )


def op4_covariance_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return outliers.judged(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("distance", 3).alias("distance"),
    )


def op5_vantage_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the component of near copies of every document."""
    found = near_copies.near_copies(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )

def op6_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its calibrated probability and whether it is drawn."""
    found = mixing.mixed(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "source", "lang", "topic", "tokens", "probability", "weight", "sampled"
    )


def op7_column_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without byte strings that also begin elsewhere."""
    found = suffix_columns.without_repeats(read(spark, sf_dir, "documents"), digests=True)
    return found.select(
        "doc_id",
        F.col("n_units").alias("n_bytes"),
        "n_removed",
        "n_spans",
        F.col("kept").alias("kept_sha256"),
    )


def op8_word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without runs of words that also begin elsewhere."""
    found = word_index.without_repeats(read(spark, sf_dir, "documents"), digests=True)
    return found.select(
        "doc_id", F.col("n_units").alias("n_words"), "n_removed", F.col("kept").alias("kept_sha256")
    )


def op9_winnowed_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = contamination.contamination(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_winnowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that repeat earlier ones."""
    kept = lines.drop_repeated_lines(read(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op11_bottom_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shingles of every document and the component of near copies it is in."""
    found = sketches.sketch_groups(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_shingles",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def op12_nested_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf and the proof of every document, and the root it leads to once tampered with."""
    found = merkle.manifest(read(spark, sf_dir, "documents"))
    folded = merkle.folded(F.col("other"), F.col("path"))
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == F.col("root")).alias("verified"),
    )


def op13_tiled_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return phrases.collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_compression_language,
        op2_zstandard_archives,
        op3_token_efficiency_secrets,
        op4_covariance_outliers,
        op5_vantage_near_copies,
        op6_raked_mix,
        op7_column_suffixes,
        op8_word_index,
        op9_winnowed_contamination,
        op10_winnowed_lines,
        op11_bottom_sketches,
        op12_nested_manifest,
        op13_tiled_phrases,
    )
}
