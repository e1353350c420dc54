"""Pieces that several registered plans share: tables in their roles, and SQL fragments of the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusflow.functions.text import TR_LETTERS, token_pattern


TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Texts cost much more to work on than to read: where a file's layout gives fewer tasks than there
    are cores, its rows are dealt out; a large table has more and is read as it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(df) if name in TEXTS else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows that each cost much, dealt out where they lie in fewer tasks than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as passages."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))


PATTERN = token_pattern(TR_LETTERS).replace("'", "''")


def sql_form(c: str) -> str:
    return f"trim(regexp_replace(lower(translate({c}, 'Iİ', 'ıi')), '\\s+', ' ', 'g'))"


def sql_tokens(c: str) -> str:
    return f"list_transform(regexp_extract_all({sql_form(c)}, '{PATTERN}'), lambda t: regexp_replace(t, '\\s+', '', 'g'))"


def sql_stem(t: str, n: int = 5) -> str:
    base = f"regexp_extract({t}, '^([^''’]*)', 1)"
    return f"CASE WHEN regexp_full_match({base}, '\\p{{L}}+') THEN left({base}, {n}) ELSE {t} END"


def sql_stems(c: str, n: int = 5) -> str:
    return f"list_transform({sql_tokens(c)}, lambda u: {sql_stem('u', n)})"


def sql_bm25(stem: bool = False, where: str = "true", name: str = "bm25") -> str:
    """CTEs that end in `name`(query_id, chunk_id, score), for WITH."""
    words = sql_stems if stem else sql_tokens
    return f"""
{name}_docs AS (SELECT doc_id AS chunk_id, lang, {words('text')} AS terms FROM documents),
{name}_tok AS (SELECT chunk_id, lang, len(terms) AS dl, unnest(terms) AS term FROM {name}_docs),
{name}_tf AS (SELECT chunk_id, lang, dl, term, count(*) AS tf FROM {name}_tok GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM {name}_docs),
{name}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({words('text')}) AS term FROM benchmark) GROUP BY ALL),
{name} AS (SELECT query_id, chunk_id, lang, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (1.2 * (0.25 + 0.75 * dl / avgdl) + tf)), 6) AS score
  FROM {name}_tf JOIN {name}_df USING (term) JOIN {name}_q USING (term), {name}_st WHERE {where} GROUP BY query_id, chunk_id, lang)"""


def sql_top(source: str, k: int, by: str = "query_id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, chunk_id) AS rank FROM {source}) WHERE rank <= {k}"
