"""Registered plans of a corpus's life and of what surrounds an answer: records and fingerprints, versions and pins, index
activation, audits of structure, threads, hints, support of claims, notices, and evidence as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpusflow.functions import text
from korpusflow.operators import citations, corpus, evaluate, relational, search, segment, temporal
from korpusflow.plans.common import sql_tokens, table
from korpusflow.sources import scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def plan(oracle: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return keep


def said(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@plan("SELECT doc_id, md5(text) AS text_md5, lang, CASE WHEN doc_id % 5 = 0 THEN 'length' WHEN doc_id % 7 = 0 THEN 'hash' END AS failure FROM documents")
def verified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written with their digest and read back against it, and which of their artifacts are damaged."""
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    path = scratch.path(spark, "records")
    corpus.write_records(docs.select("doc_id", "text", "lang"), path, "doc_id")
    content = F.col("text").cast("binary")
    stored = docs.select(d.alias("artifact_id"), content.alias("content"), (F.octet_length(content) + F.when(d % 5 == 0, 1).otherwise(0)).alias("byte_length"), F.when(d % 7 == 0, "x").otherwise(F.sha2(content, 256)).alias("content_hash"))
    bad = corpus.artifact_failures(stored).withColumnRenamed("artifact_id", "doc_id")
    return corpus.read_records(spark, path, "doc_id").join(bad, "doc_id", "left").select("doc_id", F.md5("text").alias("text_md5"), "lang", "failure")


@plan("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'court|yargıtay|c' || doc_id % 9 || '|' || doc_id || '|k' WHEN 1 THEN source || ':' || doc_id ELSE sha256(text) END AS fingerprint FROM documents""")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Court decisions by their numbers, others by source and id, the rest by content."""
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    court = lambda x: F.when(d % 3 == 0, x)
    rows = docs.select("doc_id", court(F.lit("Yargıtay")).alias("authority"), court(said("C", d % 9)).alias("chamber"), court(d.cast("string")).alias("case_number"), court(F.lit("K")).alias("decision_number"), "source", F.when(d % 3 != 2, d.cast("string")).alias("source_id"), F.sha2("text", 256).alias("content_hash"))
    return corpus.fingerprints(rows).select("doc_id", "fingerprint")


@plan("SELECT o_orderkey AS document_id, 'v' || o_orderkey % 3 AS corpus_version, 'p' || o_orderkey % 5 AS parse_id, CASE o_orderkey % 3 WHEN 0 THEN 'h0' WHEN 1 THEN 'h1' ELSE 'new' END AS content_hash FROM orders")
def pinned_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins of orders to parses of three versions, pinned again without effect, with the hashes of the versions: one is new,
    one is registered again."""
    o, k = table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey")
    registry = spark.createDataFrame([("v0", "h0"), ("v1", "h1")], "corpus_version string, content_hash string")
    for version, digest in (("v2", "new"), ("v1", "h1")):
        registry = corpus.register_version(registry, version, digest)
    pins = o.select(said("v", k % 3).alias("corpus_version"), k.alias("document_id"), said("p", k % 5).alias("parse_id"))
    return corpus.pin(pins.filter(k % 2 == 0), pins.filter(k % 4 != 2)).join(F.broadcast(registry), "corpus_version").select("document_id", "corpus_version", "parse_id", "content_hash")


@plan("""SELECT s_suppkey AS index_no, CASE WHEN s_nationkey <> 3 THEN CASE s_suppkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'retired' ELSE 'building' END WHEN s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = 3) THEN 'ready' WHEN s_suppkey % 3 = 2 THEN 'building' ELSE 'retired' END AS status,
(s_nationkey = 3 AND s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = 3)) AS activated FROM supplier""")
def activated_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as indexes of domains (their nations): the first of one domain is made its only ready one."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    first = s.filter("s_nationkey = 3").agg(F.min("s_suppkey")).first()[0]
    status = F.when(k % 3 == 0, "ready").when(k % 3 == 1, "retired").otherwise("building")
    registry = s.select(k.alias("index_no"), F.col("s_nationkey").cast("string").alias("domain_code"), F.lit("law").alias("channel"), F.lit("vector").alias("backend"), k.cast("string").alias("index_version"), status.alias("status"), F.lit(None).cast("date").alias("activated_at"))
    found = corpus.activate(registry, "3", "law", "vector", str(first), F.lit("2024-01-01").cast("date"))
    return found.select("index_no", "status", F.col("activated_at").isNotNull().alias("activated"))


@plan("SELECT count(*) AS indexed, count(*) FILTER (vec_id % 4 = 0) AS truncated FROM embeddings")
def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as an immutable index, counted."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), (F.col("vec_id") % 4 == 0).alias("truncated"), F.lit("left out").alias("text"))
    dims = v.select(F.size("vec")).first()[0]
    return corpus.write_vectors(v, scratch.path(spark, "vectors"), "v1", dims)


@plan("""WITH n AS (SELECT o_custkey AS c, o_orderkey % 7 + 1 AS a, count(*) AS times FROM orders GROUP BY ALL), w AS (SELECT DISTINCT o_custkey AS c, a FROM orders, range(1, 6) r(a))
SELECT c::VARCHAR AS document_id, coalesce(string_agg(wa::VARCHAR, ',' ORDER BY wa) FILTER (na IS NULL), '') AS missing, coalesce(string_agg(na::VARCHAR, ',' ORDER BY na) FILTER (times > 1), '') AS duplicated,
coalesce(string_agg(na::VARCHAR, ',' ORDER BY na) FILTER (na > 5), '') AS unexpected FROM (SELECT coalesce(w.c, n.c) AS c, w.a AS wa, n.a AS na, times FROM w FULL JOIN n ON w.c = n.c AND w.a = n.a) GROUP BY c""")
def article_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles 1 to 5 are expected of a text for each customer whose articles are numbered by its orders."""
    o = table(spark, sf_dir, "orders")
    lines = o.select("o_custkey", F.col("o_orderkey").alias("chunk_index"), said("MADDE ", (F.col("o_orderkey") % 7 + 1).cast("string"), " - Metin").alias("text"))
    docs = relational.document_text(lines, "o_custkey").select(F.col("o_custkey").cast("string").alias("document_id"), F.col("body").alias("text"))
    wanted = docs.select("document_id", F.lit(1).alias("first"), F.lit(5).alias("last"), F.lit(None).cast("array<string>").alias("labels"))
    listed = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    found = segment.structure_audit(segment.units(docs), wanted)
    return found.select("document_id", listed("missing"), listed("duplicated"), listed("unexpected"))


@plan("""WITH m AS (SELECT conv_id, turn, conv_id || '-' || turn AS id, role FROM conversations)
SELECT id AS message_id, CASE WHEN turn % 2 = 0 THEN conv_id || 'g' || turn ELSE conv_id || 'g' || (turn - 1) END AS generation_id, CASE WHEN turn % 2 = 1 AND turn % 3 <> 0 THEN 's0,s1' ELSE '' END AS sources FROM m""")
def message_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages, of which each two are the sides of a generation; some answers cite two sources."""
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("message_id"))
    t = F.col("turn")
    other = F.concat_ws("-", "conv_id", (t + 1).cast("string"))
    generations = m.filter(t % 2 == 0).select(said(F.col("conv_id").cast("string"), "g", t.cast("string")).alias("generation_id"), F.col("message_id").alias("user_message_id"), other.alias("assistant_message_id"), F.lit("done").alias("status"))
    cited = m.filter((t % 2 == 1) & (t % 3 != 0)).select("message_id", F.explode(F.array(F.lit(1), F.lit(0))).alias("ordinal")).withColumn("source_id", said("s", F.col("ordinal").cast("string")))
    found = relational.thread(m, generations, cited)
    return found.select("message_id", "generation_id", F.array_join(F.transform("citations", lambda c: c["source_id"]), ",").alias("sources"))


@plan("""WITH q AS (SELECT o_orderkey AS k FROM orders), c AS (SELECT k, unnest([{n: 1, law: (1000 + k % 9)::VARCHAR, a: 'Ek' || (1 + k % 30)}, {n: 2, law: (1000 + k % 9)::VARCHAR, a: (1 + k % 40) || '/A'}, {n: 4, law: '6100', a: (1 + k % 50)::VARCHAR}]) AS x FROM q)
SELECT k::VARCHAR AS query_id, x.law AS law, x.a AS article, x.n AS position FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY x.n) <= 2""")
def article_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two readable hints of each order: some have no law, no article, or come twice."""
    k = F.col("o_orderkey")
    law = said((1000 + k % 9).cast("string"))
    number = lambda n: (1 + k % n).cast("string")
    hint = lambda p, named, article: F.struct(F.lit(p).alias("position"), named.alias("law"), article.alias("article"))
    every = F.array(hint(0, F.lit("yok"), number(9)), hint(1, law, said("Ek madde ", number(30))), hint(2, law, said("m. ", number(40), "/a")), hint(3, law, said("EK ", number(30))), hint(4, F.lit("6100"), number(50)), hint(5, law, F.lit("hiç")))
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("query_id"), F.explode(every).alias("h")).select("query_id", "h.*")
    return search.clean_hints(rows, 2).select("query_id", "law", "article", "position")


@plan("""WITH c AS (SELECT o_orderkey AS k, o_orderkey % 6 AS r FROM orders)
SELECT k::VARCHAR AS answer_id, CASE r WHEN 0 THEN 'plain' WHEN 1 THEN 'verified' WHEN 2 THEN 'partial' WHEN 3 THEN 'unverified' WHEN 4 THEN 'plain' ELSE 'unverified' END AS verification, CASE r WHEN 1 THEN 'a,b' WHEN 2 THEN 'b' ELSE '' END AS kept FROM c""")
def supported_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each order: headings, claims whose sources support, partly support or don't, or were not assessed, and
    claims without sources that state a legal fact or none."""
    k = F.col("o_orderkey")
    r = k % 6
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("answer_id"), r.alias("r"))
    fact = F.when(F.col("r") == 5, "Süre 7 gündür.").otherwise("Merhaba.")
    claims = rows.select("answer_id", F.lit("S1").alias("claim_id"), F.lit(1).alias("n"), F.when(F.col("r") == 0, "heading").otherwise("text").alias("kind"), fact.alias("text"), "r")
    pairs = claims.withColumn("source_id", F.explode_outer(F.when(F.col("r").isin(1, 2, 3), F.array(F.lit("a"), F.lit("b"))))).drop("r")
    one = lambda source, status: F.struct(F.lit(source).alias("source_id"), F.lit(status).alias("status"))
    status = F.when(F.col("r") == 1, F.array(one("a", "supported"), one("b", "partial"))).when(F.col("r") == 2, F.array(one("a", "unsupported"), one("b", "partial")))
    told = rows.select("answer_id", F.lit("S1").alias("claim_id"), F.explode(status).alias("x")).select("answer_id", "claim_id", "x.source_id", "x.status")
    return citations.apply_support(pairs, told).select("answer_id", "verification", F.array_join("kept", ",").alias("kept"))


@plan("""SELECT o_orderkey::VARCHAR AS query_id, '4857' AS law, (o_orderkey % 5)::VARCHAR AS article, 'Mülga: 4857 m.' || o_orderkey % 5 || ', ' || strftime(o_orderdate::DATE, '%d.%m.%Y') AS text FROM orders
WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 1 AND o_orderkey % 7 <> 2 AND o_orderkey % 5 <> 4 AND o_orderdate::DATE <= DATE '1997-01-01'""")
def repeal_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repealed articles that a passage mentions: not amended ones, parts of one, later than the case or not yet in force."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders")
    items = o.select(
        k.cast("string").alias("query_id"), F.lit("4857").alias("law"), (k % 5).cast("string").alias("article"), F.when(k % 3 == 0, "amended").otherwise("repealed").alias("event_type"), (k % 4 != 1).alias("whole_unit"),
        F.lit(None).cast("date").alias("effective_from"), day.alias("change_date"), F.when(k % 7 == 2, F.date_sub(day, 1)).when(k % 7 == 3, day).alias("case_date"),
    )
    mentions = o.select(k.cast("string").alias("query_id"), F.array(*(F.lit(str(i)) for i in range(4)), F.lit("x")).alias("articles"))
    return temporal.repeal_notice(items, mentions, F.lit("1997-01-01").cast("date"))


@plan(f"""SELECT doc_id, md5(array_to_string({sql_tokens('text')}, ' ')) AS canonical_md5, md5('[' || 'k]' || ' son ' || text) AS scrubbed_md5,
md5('source_id=s' || doc_id || chr(10) || 'channel=' || lang || chr(10) || 'title=Belge' || chr(10) || 'document_type=' || chr(10) || 'authority=' || chr(10) || 'date=2020-01-02' || chr(10) || 'breadcrumb=A > B' || chr(10) || 'page=' || doc_id || chr(10) || '<passage>' || chr(10) || text || chr(10) || '</passage>' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '<amendments>' || chr(10) || 'değişti' || chr(10) || '</amendments>' ELSE '' END) AS block_md5 FROM documents""")
def shown_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' canonical tokens, a text scrubbed of internal names, and documents as evidence for a model."""
    d = F.col("doc_id")
    marked = F.concat(F.lit("[k] [SOURCE_LAW_7] son "), F.col("text"))
    block = text.evidence_block(said("s", d), F.col("lang"), F.lit("Belge"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("2020-01-02").cast("date"), F.array(F.lit("A"), F.lit("B")), d, F.col("text"), F.when(d % 2 == 0, "değişti"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.canonical_tokens(F.col("text"))).alias("canonical_md5"), F.md5(text.scrub_internal(marked)).alias("scrubbed_md5"), F.md5(block).alias("block_md5"))


@plan("""SELECT item_id AS query_id FROM benchmark WHERE item_id % 5 NOT IN (0, 4) AND item_id % 7 <> 0 AND item_id % 3 <> 0""")
def eligible_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that count in an evaluation: of two splits, without a gap, with a reviewed positive label."""
    i = F.col("item_id")
    b = table(spark, sf_dir, "benchmark")
    queries = b.select(i.alias("query_id"), F.when(i % 5 == 0, "train").when(i % 5 == 4, None).when(i % 2 == 0, "development").otherwise("holdout").alias("split"), F.when(i % 7 == 0, True).alias("coverage_gap"))
    labels = b.select(i.alias("query_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("relevance")).withColumn("review_status", F.when((F.col("query_id") % 3 == 0) & (F.col("relevance") > 0), "pending").otherwise("reviewed"))
    return evaluate.eligible(queries, labels).select("query_id")


@plan("SELECT conv_id AS query_id, max(turn) AS position, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def last_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), "text")
    return evaluate.last_plan(c).select("query_id", "position", "text")


@plan("""SELECT b.item_id AS query_id, d.doc_id AS chunk_id, md5(d.text) AS text_md5, d.lang FROM benchmark b JOIN documents d ON d.doc_id % 97 = b.item_id % 97 WHERE d.lang IN ('en', 'de')""")
def hydrated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their rows, of the languages that a scope admits."""
    docs = table(spark, sf_dir, "documents")
    hits = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 97).alias("r")).join(docs.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 97).alias("r")), "r").drop("r")
    found = search.hydrate(hits, docs.withColumnRenamed("doc_id", "chunk_id"), {"lang": ["en", "de"]})
    return found.select("query_id", "chunk_id", F.md5("text").alias("text_md5"), "lang")


@plan("""WITH h AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT 'kind' AS fact, lang AS key, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'content', h, n FROM h WHERE n > 1""")
def dry_run_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ingest would meet: documents of each kind, and contents that come more than once."""
    found = corpus.dry_run(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("source_kind"), "text"))
    named = lambda fact, key: found[key[0]].select(F.lit(fact).alias("fact"), F.col(key[1]).alias("key"), "n")
    return named("kind", ("counts", "source_kind")).unionByName(named("content", ("duplicate_content", "content_hash")))


@plan("""WITH b AS (SELECT conv_id, turn, turn % 4 = 0 AS head FROM conversations), h AS (SELECT *, max(CASE WHEN head THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM b)
SELECT conv_id AS answer_id, turn::DOUBLE AS position, CASE WHEN head THEN 'B' || turn ELSE 't' || turn END AS text FROM h WHERE head OR h IS DISTINCT FROM 4
UNION ALL SELECT conv_id, 4 + n / 1000000.0, 'yeni' || n FROM b, (VALUES (1), (2)) v(n) WHERE turn = 4""")
def replaced_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose section under the heading B4 is computed anew."""
    t = F.col("turn")
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer_id"), t.alias("position"), F.when(t % 4 == 0, "heading").otherwise("text").alias("kind"), F.concat(F.when(t % 4 == 0, "B").otherwise("t"), t.cast("string")).alias("text"))
    new = c.select("answer_id").distinct().select("answer_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).select("answer_id", "n", F.lit("text").alias("kind"), said("yeni", F.col("n").cast("string")).alias("text"))
    return citations.replace_section(c, "B4", new).select("answer_id", "position", "text")


@plan("""WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey::VARCHAR AS document_id, 'chapter:İKİNCİ/article:' || n || CASE WHEN p = 1 THEN '/paragraph:1' ELSE '' END AS unit_key, 'Genel Hükümler|' || 'Konu ' || o_orderkey || CASE WHEN p = 1 THEN '|paragraph 1' ELSE '' END AS breadcrumb FROM a, (VALUES (0), (1)) v(p)
UNION ALL SELECT DISTINCT o_custkey::VARCHAR, 'chapter:İKİNCİ', 'Genel Hükümler' FROM a""")
def unit_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way to each unit of a text with a chapter and an article, under its own title, for each order of a customer."""
    k = F.col("o_orderkey").cast("string")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    head = F.when(number == 1, "İKİNCİ BÖLÜM\nGenel Hükümler\n").otherwise("")
    lines = table(spark, sf_dir, "orders").select("o_custkey", number.alias("chunk_index"), F.concat(head, F.lit("Konu "), k, F.lit("\nMADDE "), number.cast("string"), F.lit(" - Metin.\n(1) Fıkra.")).alias("text"))
    docs = relational.document_text(lines, "o_custkey").select(F.col("o_custkey").cast("string").alias("document_id"), F.col("body").alias("text"))
    return segment.text_breadcrumbs(docs).select("document_id", "unit_key", F.array_join("breadcrumb", "|").alias("breadcrumb"))
