"""What the sources that answers cite must agree with, by kind of source: a page of the web carries itself, a file's passage
is a chunk of a ready file of the same workspace, and a corpus passage is a chunk of the parse that was in force when it
was cited. Each rule that is broken is a row: citation_id, rule.

Citations have citation_id, source_channel, source_id, document_id, parse_id, chunk_id, file_id, file_chunk_id,
workspace_id, cited_at and a snapshot (a struct). Values are compared null-safely: two nulls agree. A citation of no known
channel breaks the rule `channel`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEB_PREFIX = "SOURCE_WEB_"
CHANNELS = ("web", "file", "corpus")
#: What a corpus snapshot repeats of its document and of its chunk, and a file snapshot of its chunk.
DOCUMENT_FIELDS = ("title", "authority", "case_number", "decision_number", "document_date")
CHUNK_FIELDS = ("page_number", "exact_passage")


def broken(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """citation_id and the name of each rule whose condition holds."""
    named = F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in rules.items()))
    return rows.select("citation_id", F.explode(F.array_compact(named)).alias("rule"))


def differs(a: Column | str, b: Column | str) -> Column:
    text = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string")
    return ~text(a).eqNullSafe(text(b))


def lacks_text(x: str) -> Column:
    return F.coalesce(F.regexp_replace(x, r"\s", ""), F.lit("")) == ""


def web_violations(citations: DataFrame) -> DataFrame:
    """A web citation points at no stored row, and its snapshot has an address and the passage itself."""
    url = F.coalesce(F.col("snapshot.source_url"), F.lit(""))
    stored = [F.col(c).isNotNull() for c in ("document_id", "parse_id", "chunk_id", "file_id", "file_chunk_id")]
    return broken(citations.filter("source_channel = 'web'"), {
        "snapshot_channel": differs("snapshot.source_channel", F.lit("web")), "source_id": ~F.coalesce(F.col("source_id").startswith(WEB_PREFIX), F.lit(False)),
        "stored_row": reduce(Column.__or__, stored), "source_url": ~F.regexp_like(url, F.lit(r"(?i)^https?://[^/?#\s]")), "exact_passage": lacks_text("snapshot.exact_passage"),
    })


def file_violations(citations: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """A file citation quotes a chunk (file_chunk_id, file_id, workspace_id, text, page_start, page_end) of a ready file
    (file_id, workspace_id, status, original_name) of its own workspace, word for word."""
    ready = files.filter("status = 'ready'").select("file_id", "workspace_id", "original_name")
    known = chunks.join(ready, ["file_id", "workspace_id"]).select(
        "file_chunk_id", "workspace_id", F.struct("file_id", "text", "page_start", "page_end", "original_name", F.col("file_chunk_id").alias("id")).alias("stored"))
    rows = citations.filter("source_channel = 'file'").join(known, ["file_chunk_id", "workspace_id"], "left")
    there = F.col("stored").isNotNull()
    same = {"file_id": "file_id", "exact_passage": "text", "title": "original_name", "page_start": "page_start", "page_end": "page_end", "file_chunk_id": "id"}
    return broken(rows, {
        "no_ready_chunk": ~there, "file": there & differs("file_id", "stored.file_id"), "stored_row": F.col("document_id").isNotNull() | F.col("parse_id").isNotNull(),
        **{f"snapshot_{c}": there & differs(f"snapshot.{c}", f"stored.{own}") for c, own in same.items()},
    })


def in_force(citations: DataFrame, versions: DataFrame) -> DataFrame:
    """citation_id and the version (corpus_version, parse_id) of its document that was in force when it was cited: of those
    (document_id, corpus_version, parse_id, valid_from, valid_to; null: open) whose validity holds cited_at the newest."""
    asked = citations.select("citation_id", "document_id", "cited_at")
    holds = (F.col("valid_from") <= F.col("cited_at")) & (F.col("valid_to").isNull() | (F.col("cited_at") < F.col("valid_to")))
    found = asked.join(versions, "document_id").filter(holds)
    newest = F.max(F.struct("valid_from", "corpus_version", "parse_id")).alias("version")
    return found.groupBy("citation_id").agg(newest).select("citation_id", F.struct("version.corpus_version", "version.parse_id").alias("version"))


def corpus_violations(citations: DataFrame, chunks: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """A corpus citation repeats its chunk (chunk_id, document_id, parse_id, page_number, exact_passage) and document
    (document_id, DOCUMENT_FIELDS, source_url), of the parse and version in force when it was cited."""
    mine = citations.filter("source_channel = 'corpus'")
    chunk = chunks.select("chunk_id", F.struct("document_id", "parse_id", *CHUNK_FIELDS).alias("chunk"))
    document = documents.select("document_id", F.struct(*DOCUMENT_FIELDS, "source_url").alias("document"))
    rows = mine.join(chunk, "chunk_id", "left").join(document, "document_id", "left").join(in_force(mine, versions), "citation_id", "left")
    cited, known = F.col("chunk").isNotNull(), F.col("document").isNotNull()
    url = F.col("snapshot.source_url").isNotNull() & differs("snapshot.source_url", "document.source_url")
    same = {**{c: (known, f"document.{c}") for c in DOCUMENT_FIELDS}, **{c: (cited, f"chunk.{c}") for c in CHUNK_FIELDS}}
    return broken(rows, {
        "no_chunk": ~cited, "no_document": ~known, "chunk_document": cited & differs("chunk.document_id", "document_id"), "chunk_parse": cited & differs("chunk.parse_id", "parse_id"),
        "source_url": known & url, **{f"snapshot_{c}": there & differs(f"snapshot.{c}", stored) for c, (there, stored) in same.items()},
        "no_version_in_force": F.col("version").isNull(), "parse_in_force": F.col("version").isNotNull() & differs("version.parse_id", "parse_id"),
        "corpus_version": F.col("version").isNotNull() & differs("version.corpus_version", "snapshot.corpus_version"),
    })


def snapshot_violations(citations: DataFrame, chunks: DataFrame, documents: DataFrame, versions: DataFrame, file_chunks: DataFrame, files: DataFrame) -> DataFrame:
    """citation_id, rule of all citations, by the rules of their kind."""
    other = citations.filter(~F.coalesce(F.col("source_channel").isin(*CHANNELS), F.lit(False))).select("citation_id", F.lit("channel").alias("rule"))
    parts = [web_violations(citations), file_violations(citations, file_chunks, files), corpus_violations(citations, chunks, documents, versions), other]
    return reduce(DataFrame.unionByName, parts)
