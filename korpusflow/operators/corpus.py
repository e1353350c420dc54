"""Corpus lifecycle: ingest, registries, versions, verification. Tables are append-only Parquet; a pointer table names the
active version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpusflow.functions.text import normalize, text_status
from korpusflow.operators.relational import missing
from korpusflow.operators.segment import cut_chunks, scan_markers, units


def row_digests(records: DataFrame, order: list[str]) -> DataFrame:
    """The order columns and the SHA-256 of each record's JSON with sorted keys."""
    return records.select(*order, F.sha2(F.to_json(F.struct(*sorted(records.columns))), 256).alias("row_hash"))


def corpus_digest(records: DataFrame, order: list[str], number: str, bits: int = 12, levels: int = 6) -> DataFrame:
    """One digest of all records, as a tree: digests of runs of 2^bits record numbers, in order, then of 2^bits of those
    digests, and so on for `levels` levels (enough for every number), so that no group has more than 2^bits digests, or
    the records that share a number. digest, records (none without records)."""
    hashes = lambda value, *cols: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*cols, value))), lambda x: x[value]), ""), 256)
    rows = row_digests(records, list(dict.fromkeys([*order, number])))
    now = rows.groupBy(F.floor(F.col(number) / (1 << bits)).cast("long").alias("no")).agg(hashes("row_hash", *order).alias("hash"), F.count(F.lit(1)).alias("n"))
    for _ in range(levels - 1):
        now = now.groupBy(F.floor(F.col("no") / (1 << bits)).cast("long").alias("next")).agg(hashes("hash", "no").alias("hash"), F.sum("n").alias("n")).withColumnRenamed("next", "no")
    return now.groupBy().agg(hashes("hash", "no").alias("digest"), F.sum("n").alias("records")).filter("records > 0")


def artifact_failures(artifacts: DataFrame) -> DataFrame:
    """Artifacts whose bytes are not what the metadata says."""
    bad = F.when(F.octet_length("content") != F.col("byte_length"), "length").when(F.sha2("content", 256) != F.col("content_hash"), "hash")
    return artifacts.select("artifact_id", bad.alias("failure")).filter("failure is not null")


def new_artifacts(raw: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose content is not stored yet, the first of each content by id."""
    hashed = raw.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    first = hashed.withColumn("__n", F.row_number().over(Window.partitionBy("content_hash").orderBy("document_id"))).filter("__n = 1").drop("__n")
    return missing(first, existing, ["content_hash"]).select(*hashed.columns)


def fingerprints(docs: DataFrame) -> DataFrame:
    """fingerprint: composite court identity, else source and id, else content."""
    court = F.concat_ws("|", F.lit("court"), "authority", "chamber", "case_number", "decision_number")
    complete = F.col("authority").isNotNull() & F.col("chamber").isNotNull() & F.col("case_number").isNotNull() & F.col("decision_number").isNotNull()
    return docs.withColumn("fingerprint", F.when(complete, F.lower(court)).when(F.col("source").isNotNull() & F.col("source_id").isNotNull(), F.concat_ws(":", "source", "source_id")).otherwise(F.col("content_hash")))


def ingest(raw: DataFrame, existing: DataFrame, run_id: str, least_chars: int = 40) -> dict[str, DataFrame]:
    """units, chunks, links, outcomes and errors of (document_id, text) rows. A bad document becomes an error row and
    never stops the run; contents that are stored already (or come twice) are duplicates."""
    clean = raw.withColumn("text", normalize(F.col("text")))
    problem = F.when(text_status(F.col("text")) != "ok", text_status(F.col("text"))).when(F.length("text") < least_chars, "too_short")
    marked = clean.withColumn("error", problem)
    good = marked.filter("error is null").drop("error")
    fresh = new_artifacts(good, existing)
    found = units(fresh, scan_markers(fresh))
    chunks = cut_chunks(fresh)
    u = found.select("document_id", "unit_key", "unit_index", F.col("char_start").alias("us"), F.col("char_end").alias("ue"))
    links = chunks.select("document_id", "chunk_index", "char_start", "char_end").join(u, "document_id").filter((F.col("us") < F.col("char_end")) & (F.col("ue") > F.col("char_start"))).select("document_id", "chunk_index", "unit_key", F.row_number().over(Window.partitionBy("document_id", "chunk_index").orderBy("unit_index")).alias("unit_order"))
    errors = marked.filter("error is not null").select(F.lit(run_id).alias("run_id"), "document_id", F.col("error").alias("code"), F.substring(F.concat(F.lit("document refused: "), "error"), 1, 2000).alias("detail"), (F.col("error") == "noisy").alias("retryable"), F.lit(1).alias("attempt"))
    imported = fresh.select("document_id", F.lit("imported").alias("status"))
    outcomes = imported.unionByName(errors.select("document_id", F.lit("failed").alias("status"))).unionByName(missing(good, fresh, ["document_id"]).select("document_id", F.lit("duplicate").alias("status"))).withColumn("run_id", F.lit(run_id))
    return {"artifacts": fresh, "units": found, "chunks": chunks, "links": links, "errors": errors, "outcomes": outcomes}


def register_version(registry: DataFrame, version: str, content_hash: str) -> DataFrame:
    """The registry with the version: the same hash again changes nothing, another hash is refused."""
    known = registry.filter(F.col("corpus_version") == version).select("content_hash").limit(1).collect()
    if known and known[0][0] != content_hash:
        raise ValueError(f"{version} is registered with another content")
    return registry if known else registry.unionByName(registry.sparkSession.createDataFrame([(version, content_hash)], "corpus_version string, content_hash string"))


def pin_conflicts(pins: DataFrame) -> DataFrame:
    return pins.groupBy("corpus_version", "document_id").agg(F.count_distinct("parse_id").alias("parses")).filter("parses > 1")


def pin(pins: DataFrame, new: DataFrame) -> DataFrame:
    """One parse per document and version; a conflicting pin is refused."""
    both = pins.unionByName(new).distinct()
    if not pin_conflicts(both).isEmpty():
        raise ValueError("a document is pinned to two parses of one version")
    return both


def supersede(parses: DataFrame) -> DataFrame:
    """Of each document's ready parses the newest stays ready."""
    newest = F.row_number().over(Window.partitionBy("document_id", "status").orderBy(F.desc("created_at"), F.desc("parse_id")))
    return parses.withColumn("__n", newest).withColumn("status", F.when((F.col("status") == "ready") & (F.col("__n") > 1), "superseded").otherwise(F.col("status"))).drop("__n")


def publish(versions: DataFrame, version: str, as_of) -> DataFrame:
    """The version becomes published at as_of, published ones of its domain retire."""
    domain = versions.filter(F.col("corpus_version") == version).select(F.col("domain_code").alias("__d")).limit(1)
    joined = versions.crossJoin(F.broadcast(domain))
    own = F.col("corpus_version") == version
    status = F.when(own, "published").when((F.col("domain_code") == F.col("__d")) & (F.col("status") == "published"), "retired").otherwise(F.col("status"))
    return joined.withColumn("published_at", F.when(own, as_of).otherwise(F.col("published_at"))).withColumn("status", status).drop("__d")


def activate(registry: DataFrame, domain: str, channel: str, backend: str, version: str, as_of) -> DataFrame:
    """Exactly one ready index of a domain, channel and backend: the named one."""
    mine = (F.col("domain_code") == domain) & (F.col("channel") == channel) & (F.col("backend") == backend)
    chosen = mine & (F.col("index_version") == version)
    status = F.when(chosen, "ready").when(mine & (F.col("status") == "ready"), "retired").otherwise(F.col("status"))
    return registry.withColumn("activated_at", F.when(chosen, as_of).otherwise(F.col("activated_at"))).withColumn("status", status)


def prune_payload(df: DataFrame) -> DataFrame:
    """What a vector index keeps of a row: all but the text, which hits are joined with later."""
    return df.drop("text")


def write_records(records: DataFrame, path: str, number: str) -> DataFrame:
    """The records and, beside them, a row with their digest and count; an existing place is refused. Returns that row."""
    records.write.mode("errorifexists").parquet(f"{path}/records")
    written = records.sparkSession.read.schema(records.schema).parquet(f"{path}/records")
    corpus_digest(written, [number], number).write.mode("errorifexists").parquet(f"{path}/manifest")
    return records.sparkSession.read.parquet(f"{path}/manifest")


def read_records(spark, path: str, number: str) -> DataFrame:
    """The records of write_records, if they still have the digest and count that stand beside them."""
    records, manifest = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/manifest").collect()
    if [tuple(r) for r in corpus_digest(records, [number], number).collect()] != [tuple(r) for r in manifest]:
        raise ValueError(f"the records in {path} are not those that were written")
    return records


def reparse(artifacts: DataFrame, metadata: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """ingest() anew from stored artifacts (artifact_id, document_id, content, byte_length, content_hash) with merged
    metadata (document_id, ...): damaged artifacts become errors. Contents that come twice are parsed once."""
    damaged = artifact_failures(artifacts)
    sound = artifacts.join(damaged, "artifact_id", "left_anti").select("document_id", F.decode("content", "UTF-8").alias("text"))
    out = ingest(sound, artifacts.select("content_hash").filter("false"), run_id)
    bad = damaged.join(artifacts.select("artifact_id", "document_id"), "artifact_id")
    errors = bad.select(F.lit(run_id).alias("run_id"), "document_id", F.col("failure").alias("code"), F.lit("document refused: artifact damaged").alias("detail"), F.lit(False).alias("retryable"), F.lit(1).alias("attempt"))
    out["errors"] = out["errors"].unionByName(errors)
    out["documents"] = out["artifacts"].select("document_id", "content_hash").join(metadata, "document_id", "left")
    return out


def write_vectors(df: DataFrame, path: str, index_version: str, dims: int) -> DataFrame:
    """An immutable vector index: one row with indexed and truncated. Wrong dimensions or an existing version are refused."""
    if not df.filter(F.size("vec") != dims).isEmpty():
        raise ValueError(f"not all vectors have {dims} dimensions")
    target = f"{path}/index_version={index_version}"
    prune_payload(df).write.mode("errorifexists").parquet(target)
    return df.sparkSession.read.parquet(target).agg(F.count(F.lit(1)).alias("indexed"), F.count_if("truncated").alias("truncated"))


def corpus_quality(docs: DataFrame, parses: DataFrame, chunks: DataFrame, expected: dict[str, int]) -> DataFrame:
    """check, actual, expected, ok: counts against expectations, and what must be none. Children are counted before they
    are joined, so each table shuffles once at most."""
    facts = {
        "documents": docs.agg(F.count(F.lit(1)).alias("v")), "ready_parses": parses.agg(F.count_if(F.col("status") == "ready").alias("v")), "chunks": chunks.agg(F.count(F.lit(1)).alias("v")),
        "documents_without_parse": missing(docs, parses, ["document_id"]).agg(F.count(F.lit(1)).alias("v")), "footer_leaks": chunks.agg(F.count_if(F.lower("text").contains("oluşturulma tarihi")).alias("v")),
    }
    out = None
    for name, df in facts.items():
        part = df.select(F.lit(name).alias("check"), F.col("v").cast("long").alias("actual"), F.lit(expected.get(name, 0)).cast("long").alias("expected"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("ok", F.col("actual") == F.col("expected"))


def dry_run(raw: DataFrame) -> dict[str, DataFrame]:
    hashed = raw.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    return {"counts": hashed.groupBy("source_kind").agg(F.count(F.lit(1)).alias("n")), "duplicate_content": hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "duplicate_identity": hashed.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")}


def corpus_records(pins: DataFrame, documents: DataFrame, chunks: DataFrame, links: DataFrame, found: DataFrame, version: str, domain: str) -> DataFrame:
    """The search table: pinned documents of a domain with their chunks, article labels and law numbers."""
    pinned = pins.filter(F.col("corpus_version") == version).select("document_id", "parse_id").join(documents.filter(F.col("domain_code") == domain), "document_id")
    labels = links.join(found.select("document_id", "unit_key", "unit_type", "label"), ["document_id", "unit_key"]).groupBy("document_id", "chunk_index").agg(F.array_sort(F.collect_set(F.when(F.col("unit_type").endswith("article"), F.col("label")))).alias("article_labels"))
    joined = pinned.join(chunks, "document_id").join(labels, ["document_id", "chunk_index"], "left")
    law = F.nullif(F.regexp_extract("title", r"^(\d{3,5})\s+[Ss]ayılı", 1), F.lit(""))
    return joined.withColumn("article_labels", F.coalesce("article_labels", F.array().cast("array<string>"))).withColumn("primary_legislation_number", law).withColumn("chunk_id", F.concat_ws("#", "document_id", "chunk_index"))
