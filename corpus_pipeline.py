"""A corpus from documents: toxic texts out, repeated line runs out, one text of each near-duplicate group, benchmark
passages out, and the rest as tokens. Each stage takes (spark, docs, sf_dir) and works on all that the last one kept.

Cases, for all stages: a null or empty text is clean, has no lines, no near duplicate and no tokens, and stays; a null
doc_id is a document like any other, linked with none; rows that repeat are kept or dropped alike (near duplicates go by
doc_id, so rows of one id stay or go together); ties go to the smallest doc_id; very long texts are worked on whole; an
empty table gives an empty table of the same columns; further columns, whatever their names, pass through all stages but
the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusflow.llm import bpe, contamination, lines, minhash, toxicity
from korpusflow.llm.common import bounded_batches, discard, materialize, quoted, read_table
from korpusflow.llm.registry import vocabulary_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    bounded_batches(spark)
    return toxicity.without_toxic(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of line runs of 50 words or more."""
    return lines.dedup_lines(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that five-word shingles link at a similarity of 0.8."""
    bounded_batches(spark)
    found = minhash.near_duplicates(docs, size=5, percent=80).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*map(quoted, docs.columns))


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    bounded_batches(spark)
    return contamination.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of each text, their number, and digests of ids and of the text decoded from them."""
    bounded_batches(spark)
    both = bpe.encode_and_decode(docs.select("doc_id", "text"), vocabulary_path())
    ids_text = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", delete_repeated_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", reject_contaminated),
    ("bpe", tokenize),
]

#: SQL cannot express the trained and retrieval stages; tests/llm holds run() against stage-wise brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
