"""Queries op1 to op13 over the given tables, with production parameters, and oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from korpusflow.llm import bpe, contamination, divergence, html, licenses, lines, merkle, minhash, ppm, quality, secrets, toxicity, warc
from korpusflow.llm.common import read_table
from korpusflow.llm.oracles import ORACLES  # noqa: F401


def vocabulary_path() -> str:
    """The public byte-level vocabulary of 50,257 entries; a parameter of the operators, never copied here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=4, percent=80)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(read_table(spark, sf_dir, "pages"), min_bytes=0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read_table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read_table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.predictions(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read_table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read_table(spark, sf_dir, "documents"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(read_table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(read_table(spark, sf_dir, "documents"))


_ALL = (
    op1_minhash, op2_bpe, op3_warc, op4_quality, op5_decontamination, op6_ppm, op7_html, op8_line_dedup, op9_toxicity,
    op10_secrets, op11_divergence, op12_licenses, op13_merkle,
)
QUERIES = {f.__name__: f for f in _ALL}
