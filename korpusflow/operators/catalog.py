"""The readable catalog of a corpus, the checks that it must pass before it is published, and reparsing with merged metadata
that rewrites no document it doesn't have to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpusflow.operators.corpus_store import law_number

LAW, DECISION = "legislation", "court_decision"
#: What kinds of documents are called.
CATEGORIES = {"law": "Kanun", "regulation": "Yönetmelik", "court_decision": "İçtihat Kararı"}
OTHER = "Diğer"
#: What an exported decision must not have kept, as words that follow each other in a chunk.
FOOTERS = (("kullanıcısı tarafından", "tarihinde oluşturuldu"), ("anonimleştirilmiştir",))
DECISION_FIELDS = ("chamber", "case_number", "decision_number", "document_date")


def document_category(kind: Column) -> Column:
    named = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))
    return F.coalesce(named[kind], F.lit(OTHER))


def legal_identifier(number: Column) -> Column:
    """How lawyers name a document: a law by its number, a decision by its case and decision numbers, others by title."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    decision = F.nullif(F.concat_ws(" / ", F.concat(F.lit("E. "), some("case_number")), F.concat(F.lit("K. "), some("decision_number"))), F.lit(""))
    own = F.when(F.col("source_kind") == LAW, F.concat(F.lit("Kanun No. "), number)).when(F.col("source_kind") == DECISION, decision)
    return F.coalesce(own, F.col("title"), F.col("source_document_id"))


def catalog(documents: DataFrame, parses: DataFrame, artifacts: DataFrame, pins: DataFrame) -> DataFrame:
    """A row for each document (document_id, title, source_kind, document_type, source_document_id, case_number,
    decision_number, current_parse_id): display name, number, identifier and category, its current parse (document_id,
    parse_id, artifact_id, parser_version, status) and artifact (document_id, artifact_id, media_type, storage_path,
    content_hash), and the versions that pin that parse, in order."""
    number = F.when(F.col("source_kind") == LAW, law_number(F.col("source_document_id"), F.col("title")))
    named = documents.withColumn("document_number", number)
    parse = parses.select("document_id", F.col("parse_id").alias("current_parse_id"), "artifact_id", "parser_version", F.col("status").alias("parse_status"))
    artifact = artifacts.select("document_id", "artifact_id", "media_type", "storage_path", F.col("content_hash").alias("artifact_hash"))
    versions = pins.groupBy("document_id", F.col("parse_id").alias("current_parse_id")).agg(F.array_sort(F.collect_set("corpus_version")).alias("corpus_versions"))
    rows = named.join(parse, ["document_id", "current_parse_id"], "left").join(artifact, ["document_id", "artifact_id"], "left").join(versions, ["document_id", "current_parse_id"], "left")
    return rows.select(
        "document_id", F.col("title").alias("display_name"), "document_number", legal_identifier(F.col("document_number")).alias("legal_identifier"), "source_kind", "document_type",
        document_category(F.col("document_type")).alias("document_category"), "current_parse_id", "parser_version", "parse_status", "artifact_id", "media_type", "storage_path", "artifact_hash",
        F.coalesce("corpus_versions", F.array().cast("array<string>")).alias("corpus_versions"),
    )


def leaks_footer(text: Column) -> Column:
    """Whether a chunk has kept what exports add: the words of one of FOOTERS in their order."""
    low = F.lower(text)
    follows = lambda words: F.regexp_like(low, F.lit("(?s)" + ".*".join(words)))
    return reduce(Column.__or__, (follows(w) for w in FOOTERS))


def corpus_checks(
    version: str, expected: dict[str, int], parser_version: str, pins: DataFrame, documents: DataFrame, parses: DataFrame, chunks: DataFrame, units: DataFrame, links: DataFrame, artifacts: DataFrame, failures: DataFrame,
) -> DataFrame:
    """check, actual, expected, ok of the nine checks that a version must pass, by counts over its pinned parses. expected
    has document_count, legislation_count and decision_count. failures: artifact_id of damaged artifacts."""
    pinned = pins.filter(F.col("corpus_version") == version).select("document_id", "parse_id").distinct()
    rows = pinned.join(documents, "document_id").join(parses.select("parse_id", "status", "parser_version"), "parse_id")
    is_law, is_decision = F.col("source_kind") == LAW, F.col("source_kind") == DECISION
    lacking = reduce(Column.__or__, (F.col(c).isNull() for c in DECISION_FIELDS))
    counted = rows.agg(
        F.count(F.lit(1)).alias("document_count"), F.count_if(is_law).alias("legislation_count"), F.count_if(is_decision).alias("decision_count"), F.count_if(F.col("status") == "ready").alias("ready_parses"),
        F.count_if(F.col("parser_version") == parser_version).alias("parser_version"), F.count_if(is_decision & lacking).alias("decision_metadata"),
    )
    of_kind = lambda kind: rows.filter(F.col("source_kind") == kind).select("parse_id")
    leaks = chunks.filter(leaks_footer(F.col("text"))).join(of_kind(DECISION), "parse_id", "left_semi").agg(F.count(F.lit(1)).alias("footer_cleanup"))
    alone = units.join(of_kind(LAW), "parse_id", "left_semi").join(links, ["parse_id", "unit_key"], "left_anti").agg(F.count(F.lit(1)).alias("legal_unit_links"))
    mine = artifacts.join(pinned.select("document_id").distinct(), "document_id", "left_semi").join(failures.select("artifact_id", F.lit(1).alias("bad")), "artifact_id", "left")
    sound = mine.agg(F.count_if(F.col("bad").isNull()).alias("artifact_hashes"), F.count("bad").alias("damaged"))
    one = F.lit(0).alias("one")
    facts = counted.select("*", one).join(leaks.select("*", one), "one").join(alone.select("*", one), "one").join(sound.select("*", one), "one")
    wanted = {**{c: F.lit(expected.get(c, -1)) for c in ("document_count", "legislation_count", "decision_count")}, **{c: F.col("document_count") for c in ("ready_parses", "parser_version", "artifact_hashes")}, **{c: F.lit(0) for c in ("decision_metadata", "footer_cleanup", "legal_unit_links")}}
    holds = lambda c, want: (F.col(c) == want) & ((F.col("damaged") == 0) if c == "artifact_hashes" else F.lit(True))
    each = [F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("actual"), want.cast("long").alias("expected"), holds(c, want).alias("ok")) for c, want in wanted.items()]
    return facts.select(F.inline(F.array(*each)))


def merged_metadata(stored: DataFrame, target: DataFrame, fields: list[str], maps: list[str]) -> DataFrame:
    """document_id, fields and maps: what the target (a row for each document it changes) gives wins over what is stored,
    key by key in maps; a document without a target keeps what it has."""
    given = target.select("document_id", *(F.col(c).alias(f"__{c}") for c in (*fields, *maps)))
    both = stored.select("document_id", *fields, *maps).join(given, "document_id", "left")

    def union(c: str) -> Column:
        kind = stored.schema[c].dataType
        old, new = (F.coalesce(F.col(x), F.create_map().cast(kind)) for x in (c, f"__{c}"))
        kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
        return F.when(F.col(c).isNotNull() | F.col(f"__{c}").isNotNull(), F.map_concat(kept, new)).alias(c)

    return both.select("document_id", *(F.coalesce(f"__{c}", c).alias(c) for c in fields), *(union(c) for c in maps))


def bucket_of(document_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(buckets)).cast("int")


def write_documents(documents: DataFrame, path: str, buckets: int) -> None:
    """Documents in folders by a hash of their id, each of which can be replaced alone."""
    dealt = documents.withColumn("bucket", bucket_of(F.col("document_id"), buckets))
    dealt.repartition(buckets, "bucket").write.mode("errorifexists").partitionBy("bucket").parquet(path)


def reparse_documents(spark: SparkSession, path: str, staging: str, target: DataFrame, buckets: int, fields: list[str], maps: list[str], failed: DataFrame | None = None) -> DataFrame:
    """Merge the target's metadata into stored documents (document_id, fields, maps, attempt) and return those it touched.
    Only folders that hold one of them are read and rewritten, through a copy in `staging`; all other files stay as they
    are. A document in `failed` (document_id) keeps its metadata; every document that was tried counts one attempt more."""
    asked = target.select("document_id").distinct().withColumn("bucket", bucket_of(F.col("document_id"), buckets))
    touched = [r.bucket for r in asked.select("bucket").distinct().collect()]  # `buckets` at most
    stored = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
    bad = (failed if failed is not None else target.limit(0)).select("document_id").distinct()
    merged = merged_metadata(stored, target.join(bad, "document_id", "left_anti"), fields, maps)
    tried = asked.select("document_id", F.lit(1).alias("tried"))
    rest = [c for c in stored.columns if c not in ("document_id", "attempt", *fields, *maps)]
    new = stored.select("document_id", "attempt", *rest).join(merged, "document_id").join(tried, "document_id", "left")
    new = new.withColumn("attempt", F.coalesce("attempt", F.lit(0)) + F.coalesce("tried", F.lit(0))).drop("tried").select(*stored.columns)
    new.write.mode("errorifexists").parquet(staging)
    copy = spark.read.schema(new.schema).parquet(staging)
    copy.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return copy.join(asked.select("document_id"), "document_id", "left_semi")


def merge_web_results(hits: DataFrame, prefix: str = "SOURCE_WEB_") -> DataFrame:
    """query_id, source_id, position and the columns of hits (query_id, part, rank, url, ...): of the same address the first
    by part and rank stays; the sources are numbered in that order."""
    rest = [c for c in hits.columns if c not in ("query_id", "url")]
    first = hits.groupBy("query_id", "url").agg(F.min(F.struct("part", "rank", *(c for c in rest if c not in ("part", "rank")))).alias("x"))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("x.part", "x.rank", "url"))
    numbered = first.withColumn("position", position)
    label = F.concat(F.lit(prefix), F.when(F.col("position") < 10, F.concat(F.lit("0"), "position")).otherwise(F.col("position").cast("string")))
    return numbered.select("query_id", label.alias("source_id"), "position", "url", "x.*")
