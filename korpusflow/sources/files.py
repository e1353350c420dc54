"""Scans: directories of files, manifests, query sets, and cleaned web results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Media type by suffix.
MEDIA_TYPES = {"pdf": "application/pdf", "html": "text/html", "htm": "text/html", "txt": "text/plain"}
QUERY_SCHEMA = "query_id string, query string, split string, domains array<string>, topic string, expected_refs array<string>, coverage_gap boolean, labels array<struct<chunk_id:string,relevance:int,review_status:string>>"


def scan_directory(spark: SparkSession, folder: str) -> DataFrame:
    """path, media_type, content, byte_length, content_hash of all files of known kinds under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{pdf,html,htm,txt}").load(folder)
    kind = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    return files.select("path", kind[suffix].alias("media_type"), "content", F.col("length").alias("byte_length"), F.sha2("content", 256).alias("content_hash"))


def manifest_sources(spark: SparkSession, path: str) -> DataFrame:
    """A row for each source of a manifest, with the manifest's parser_version."""
    return spark.read.option("multiLine", True).json(path).select("parser_version", F.explode("sources").alias("s")).select("parser_version", "s.*")


def manifest_violations(sources: DataFrame, parser_version: str) -> DataFrame:
    """source_document_id, rule: another parser version; legislation without a sound range of expected articles."""
    low, high = (F.col(f"metadata.domain_metadata.article_expectations.required_numeric_{x}") for x in ("start", "end"))
    broken = F.array_compact(F.array(F.when(F.col("parser_version") != parser_version, F.lit("parser_version")), F.when((F.col("metadata.source_kind") == "legislation") & ~F.coalesce((low >= 1) & (low <= high), F.lit(False)), F.lit("article_expectations"))))
    return sources.select("source_document_id", F.explode(broken).alias("rule"))


def query_set(spark: SparkSession, path: str, default_domain: str) -> tuple[DataFrame, DataFrame]:
    """eval_queries and eval_labels of a JSON-lines file, with defaults filled in."""
    rows = spark.read.schema(QUERY_SCHEMA).json(path)
    queries = rows.drop("labels").withColumn("domains", F.coalesce("domains", F.array(F.lit(default_domain)))).withColumn("coverage_gap", F.coalesce("coverage_gap", F.lit(False)))
    labels = rows.select("query_id", F.explode("labels").alias("l")).select("query_id", "l.chunk_id", "l.relevance", F.coalesce("l.review_status", F.lit("pending")).alias("review_status"))
    return queries, labels


def clean_web_results(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """url, site, title, text, published of (position, url, title, text, date) rows: http(s) with a host and a text, each
    URL once (the first), hosts without www, titles of 300 characters at most (the site if none), excluded hosts out."""
    host = F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), r"^www\.", "")
    kept = rows.withColumn("site", host).filter(F.lower("url").rlike("^https?://") & F.col("site").isNotNull() & (F.col("site") != "") & (F.trim("text") != ""))
    first = kept.withColumn("__n", F.row_number().over(Window.partitionBy("url").orderBy("position"))).filter("__n = 1")
    allowed = first.join(excluded.select(F.col("host").alias("site")), "site", "left_anti")
    date = F.coalesce(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")), F.try_to_timestamp("date"), F.try_to_timestamp("date", F.lit("d MMM yyyy HH:mm:ss")))
    return allowed.select("url", "site", F.substring(F.coalesce(F.nullif(F.trim("title"), F.lit("")), "site"), 1, 300).alias("title"), F.trim("text").alias("text"), date.cast("date").alias("published"))


def safe_url(url):
    return url.rlike(r"(?i)^https?://[^\s/]+") & F.try_parse_url(url, F.lit("HOST")).isNotNull()


def write_report(report: DataFrame, path: str) -> None:
    report.select(*sorted(report.columns)).write.mode("errorifexists").json(path)
