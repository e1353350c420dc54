"""A corpus as tables that are bucketed alike by document: pins, documents, their domains, chunks, units and the links
between chunks and units meet without a shuffle, and rows leave a bucket in the order of documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("pins", "documents", "domains", "chunks", "units", "links")
#: What each table is sorted by within its buckets, after the document.
SORTED = {"pins": ["corpus_version"], "domains": ["domain_code"], "chunks": ["chunk_index"], "units": ["unit_key"], "links": ["chunk_index", "unit_key"]}
#: Units whose label names an article, and what stands before the label, by unit type.
ARTICLES = {"article": "", "additional_article": "Ek", "temporary_article": "Geçici", "additional_temporary_article": "EkGeçici", "repeated_article": "Mükerrer"}


def write_corpus(tables: dict[str, DataFrame], prefix: str, path: str, buckets: int) -> None:
    """The tables of TABLES as bucketed ones, named prefix_table, in folders of a path. Every table has document_id. The number of buckets is the
    corpus's, for good: tables of one corpus meet bucket by bucket."""
    for name in TABLES:
        df = tables[name]
        dealt = df.repartition(buckets, "document_id")  # one file a bucket
        dealt.write.mode("overwrite").bucketBy(buckets, "document_id").sortBy("document_id", *SORTED.get(name, [])).option("path", f"{path}/{name}").saveAsTable(f"{prefix}_{name}")


def read_corpus(spark: SparkSession, prefix: str) -> dict[str, DataFrame]:
    """The tables. The session is told that sides which are dealt alike by a part of a join's keys need no shuffle, as
    those here are, by document."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return {name: spark.table(f"{prefix}_{name}") for name in TABLES}


def law_number(source_id: Column, title: Column) -> Column:
    """The number in a law's id ("law-4857") or else at the start of its title ("4857 sayılı ...")."""
    named = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    return F.coalesce(named(source_id, r"^law-(\d+)"), named(title, r"^(\d+)\s+[Ss]ayılı"))


def article_label(unit_type: Column, label: Column) -> Column:
    prefixes = F.create_map(*(F.lit(x) for pair in ARTICLES.items() for x in pair))
    return F.when(unit_type.isin(*ARTICLES), F.concat(prefixes[unit_type], label))


def scope_records(tables: dict[str, DataFrame], version: str, domain: str, roles: list[str] | None = None, eligible_only: bool = True) -> DataFrame:
    """The chunks of a version and a domain, of given roles (None: all) and eligible for retrieval, with their document's
    fields, domain_role, law numbers and article_labels (sorted, distinct). All steps keep the buckets of document_id, so
    none shuffles; within a bucket the rows are in the order of document and chunk."""
    pins, domains = tables["pins"], tables["domains"].filter(F.col("domain_code") == domain)
    if roles is not None:
        domains = domains.filter(F.col("role").isin(*roles))
    chunks = tables["chunks"].withColumn("retrieval_eligible", F.coalesce("retrieval_eligible", F.lit(True)))
    if eligible_only:
        chunks = chunks.filter("retrieval_eligible")
    pinned = pins.filter(F.col("corpus_version") == version).join(domains.withColumnRenamed("role", "domain_role"), "document_id")
    rows = pinned.join(tables["documents"], "document_id").join(chunks, ["document_id", "parse_id"])
    named = tables["links"].join(tables["units"].select("document_id", "parse_id", "unit_key", "unit_type", "label"), ["document_id", "parse_id", "unit_key"])
    label = article_label(F.col("unit_type"), F.col("label"))
    labels = named.groupBy("document_id", "parse_id", "chunk_index").agg(F.array_sort(F.collect_set(label)).alias("article_labels"))
    is_law = F.col("source_kind") == "legislation"
    own = F.when(is_law, law_number(F.col("source_document_id"), F.col("title")))
    related = F.coalesce("related_legislation", F.array().cast("array<string>"))
    out = rows.join(labels, ["document_id", "parse_id", "chunk_index"], "left").select(
        "document_id", "parse_id", "chunk_index", F.concat_ws("#", "document_id", "chunk_index").alias("chunk_id"), "corpus_version", "domain_code", "domain_role",
        *(c for c in tables["documents"].columns if c not in ("document_id", "related_legislation")), "text", "section_type", "retrieval_eligible",
        own.alias("primary_legislation_number"), F.when(is_law, F.array_compact(F.concat(F.array(own), related))).otherwise(related).alias("legislation_numbers"),
        F.coalesce("article_labels", F.array().cast("array<string>")).alias("article_labels"),
    )
    return out.sortWithinPartitions("document_id", "chunk_index")
