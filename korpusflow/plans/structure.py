"""Registered plans of a law's structure, chunks along it, the corpus as bucketed tables, matches by any term, and the rules
of what answers cite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusflow.functions.compose import compose
from korpusflow.functions.text import lexical_form
from korpusflow.operators import catalog, corpus_store, covers, lawrefs, relational, segment, snapshots
from korpusflow.operators import chunks as chunking
from korpusflow.plans.common import chunks, questions, sql_stems, table
from korpusflow.sources import scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def plan(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


# --- normal form ---------------------------------------------------------------------------------------------------

#: Texts with letters taken apart, marks stacked in both orders, and signs that stand for letters.
APART = "CASE doc_id % 4 WHEN 0 THEN replace(text, 'e', 'e' || chr(769)) WHEN 1 THEN replace(replace(text, 'o', 'o' || chr(770) || chr(803)), 'a', 'a' || chr(803) || chr(774)) WHEN 2 THEN replace(text, 'n', chr(8491) || chr(803)) ELSE text END"


@plan(f"""SELECT doc_id, md5(t) AS text_md5, length(t) AS n, md5(trim(regexp_replace(lower(translate(t, 'Iİ', 'ıi')), '\\s+', ' ', 'g'))) AS lexical_md5 FROM (SELECT doc_id, nfc_normalize({APART}) AS t FROM documents)""")
def composed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical composition of texts that need it and of texts that don't."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("apart_documents")
    apart = spark.sql(f"SELECT doc_id, {APART.replace('chr(', 'chr_(')} AS text FROM apart_documents".replace("chr_(769)", "'\u0301'").replace("chr_(770)", "'\u0302'").replace("chr_(803)", "'\u0323'").replace("chr_(774)", "'\u0306'").replace("chr_(8491)", "'\u212b'"))
    whole = apart.select("doc_id", compose(F.col("text")).alias("text"))
    return whole.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n"), F.md5(lexical_form(F.col("text"), composed=True)).alias("lexical_md5"))


# --- citations -----------------------------------------------------------------------------------------------------

#: How a text may write article n, paragraph p: the text, and whether it names the article and the paragraph.
FORMS = (
    ("'m.' || n", True, False), ("'md.' || n", True, False), ("'m.' || n || '/' || p", True, True), ("'madde ' || n || '/A'", True, False),
    ("n || '. maddesi'", True, False), ("n || '/' || p || '. maddesi'", True, True), ("'madde ' || n", True, False), ("'2010/' || n || ' maddesi'", False, False),
    ("n || '/A maddesi'", False, False), ("'1.' || n || ' maddesi'", False, False),
)
FORM = "CASE o_orderkey // 8 % 10 " + " ".join(f"WHEN {i} THEN {text}" for i, (text, _, _) in enumerate(FORMS)) + " END"
NAMES = [i for i, (_, article, _) in enumerate(FORMS) if article]
PARAGRAPHS = [i for i, (_, _, paragraph) in enumerate(FORMS) if paragraph]
NUMBERS = "o_orderkey, CAST(1 + o_orderkey % 120 AS VARCHAR(9)) AS n, CAST(1 + o_custkey % 9 AS VARCHAR(9)) AS p"


@plan(f"""SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 2 = 0 THEN '4857' ELSE '6100' END AS law, n AS article, CASE WHEN o_orderkey // 8 % 10 IN ({', '.join(map(str, PARAGRAPHS))}) THEN p::INT END AS paragraph
FROM (SELECT {NUMBERS} FROM orders) WHERE o_orderkey // 8 % 10 IN ({', '.join(map(str, NAMES))})""")
def article_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a law in all forms that texts write them in, and numbers that are none, one for each order."""
    rows = table(spark, sf_dir, "orders").selectExpr(*(NUMBERS.replace("VARCHAR(9)", "STRING").split(", ")))
    form = FORM.replace("o_orderkey // 8", "o_orderkey div 8")
    text = rows.selectExpr("o_orderkey AS id", f"CASE WHEN o_orderkey % 2 = 0 THEN '4857 sayılı Kanun ' ELSE 'HMK ' END || {form} || ' uyarınca' AS text", "CAST(NULL AS DATE) AS decided")
    return lawrefs.extract_refs(text)


# --- structure -----------------------------------------------------------------------------------------------------

#: A line (or two) of a customer's law for each order; n is the order's number in it, k the order.
LINES = (
    "'MADDE ' || n || ' - Genel ' || k", "'MADDE ' || n || '- (1) Fıkra ' || k", "'a) bent ' || k", "'1) alt bent ' || k", "'(2) ikinci fıkra ' || k",
    "'MADDE ' || n || ' İLA ' || (n + 2) || ' - Aralık'", "'MADDE ' || n || '-' || (n + 3) || ' - Aralık'", "'Madde' || chr(10) || n || ' - Alt satır ' || k",
    "'GEÇİCİ MADDE - Sayısız ' || k", "'EK GEÇİCİ MADDE ' || n || ' – Ek geçici'", "'MADDE l' || n || ' - Okuma ' || k", "'İKİNCİ BÖLÜM' || chr(10) || 'Başlık ' || k",
    "'EK-' || n", "'(I) SAYILI CETVEL ' || k", "'MADDE ' || n || ' (Mülga: 1/1/2000-4/4 md.)'", "'Bu metinde madde ' || n || ' - sayılmaz'", "'b) bent ' || k || chr(10) || 'ii) alt bent'",
    "'MÜKERRER MADDE ' || n || ' - Tekrar'", "'MADDE ' || n || ', virgüllü'",
)
END_LINE = "'4857 SAYILI KANUNA İŞLENEMEYEN HÜKÜMLER'"
LINE = f"CASE WHEN k % 64 = 7 THEN {END_LINE} " + " ".join(f"WHEN k % {len(LINES)} = {i} THEN {x}" for i, x in enumerate(LINES)) + " END"
NUMBERED = "SELECT o_custkey, o_orderkey AS k, 1 + o_orderkey % 90 AS n FROM orders"
ARTICLE = "^(EK GEÇICI |GEÇICI |EK |MÜKERRER )?MADDE (?:([LI]?[0-9]+)(?: ILA ([0-9]+)| ?- ?([0-9]+)(?: ?-| ?\\())?)?(?: ?[-–]| \\(MÜLGA| [A-Z]|$)"


def law_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, text: a text of law for each customer, with a line for each order."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("structure_orders")
    lines = spark.sql(f"SELECT o_custkey, k AS chunk_index, {LINE} AS text FROM ({NUMBERED.replace('FROM orders', 'FROM structure_orders')})")
    whole = relational.document_text(lines, "o_custkey")
    return whole.select(F.col("o_custkey").cast("string").alias("document_id"), F.col("body").alias("text"))


STRUCTURE = rf"""WITH docs AS (SELECT o_custkey AS d, string_agg({LINE}, chr(10) ORDER BY k) AS text FROM ({NUMBERED}) GROUP BY o_custkey),
l AS (SELECT d, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs),
p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS at_char, upper(translate(line, 'iıİ', 'III')) AS u,
lead(upper(line)) OVER (PARTITION BY d ORDER BY i) AS following FROM l),
c AS (SELECT d, min(i) AS stop FROM p WHERE regexp_matches(u, '^[0-9]{{3,4}} SAYILI KANUNA IŞLENEMEYEN HÜKÜM') GROUP BY d),
h AS (SELECT p.*, stop, CASE WHEN u = 'MADDE' THEN u || ' ' || following ELSE u END AS head FROM p LEFT JOIN c USING (d) WHERE stop IS NULL OR i <= stop),
k AS (SELECT *, CASE WHEN i = stop THEN 'end' WHEN regexp_matches(u, '^[^ ]+ BÖLÜM$') THEN 'chapter' WHEN regexp_matches(head, '{ARTICLE}') AND regexp_matches(head, 'MADDE (-|[LI]?[0-9])') AND NOT regexp_matches(head, '^MADDE -') THEN 'article'
WHEN regexp_matches(u, '^EK-[0-9]+$') OR regexp_matches(u, '^\([IVX]+\) SAYILI CETVEL') THEN 'annex' END AS head_kind FROM h),
s AS (SELECT *, last_value(head_kind IGNORE NULLS) OVER w AS inside, max(CASE WHEN head_kind = 'article' THEN i END) OVER w AS article_at, max(CASE WHEN regexp_matches(line, '^[a-zçğıöşü]\) ') THEN i END) OVER w AS item_at
FROM k WINDOW w AS (PARTITION BY d ORDER BY i ROWS UNBOUNDED PRECEDING)),
m AS (SELECT d, at_char AS start, CASE head_kind WHEN 'end' THEN 'annex' WHEN 'article' THEN CASE regexp_extract(head, '{ARTICLE}', 1) WHEN '' THEN 'article' WHEN 'EK ' THEN 'additional_article' WHEN 'GEÇICI ' THEN 'temporary_article' WHEN 'MÜKERRER ' THEN 'repeated_article' ELSE 'additional_temporary_article' END ELSE head_kind END AS unit_type,
CASE head_kind WHEN 'end' THEN 'supplement' WHEN 'chapter' THEN split_part(line, ' ', 1) WHEN 'annex' THEN CASE WHEN u LIKE 'EK-%' THEN line ELSE '(I) SAYILI CETVEL' END ELSE nullif(regexp_replace(regexp_extract(head, '{ARTICLE}', 2), '^[LI]', '1'), '') END AS label,
CASE WHEN head_kind = 'article' THEN try_cast(coalesce(nullif(regexp_extract(head, '{ARTICLE}', 3), ''), regexp_extract(head, '{ARTICLE}', 4)) AS INT) END AS last FROM s WHERE head_kind IS NOT NULL
UNION ALL SELECT d, at_char + strpos(line, '(1)') - 1, 'paragraph', '1', NULL FROM s WHERE head_kind = 'article' AND line LIKE '%- (1) %'
UNION ALL SELECT d, at_char, 'paragraph', regexp_extract(line, '^\(([0-9]+)\)', 1), NULL FROM s WHERE head_kind IS NULL AND inside = 'article' AND regexp_matches(line, '^\([0-9]+\) ')
UNION ALL SELECT d, at_char, 'item', line[1], NULL FROM s WHERE head_kind IS NULL AND inside = 'article' AND regexp_matches(line, '^[a-zçğıöşü]\) ')
UNION ALL SELECT d, at_char, 'subitem', split_part(line, ')', 1), NULL FROM s WHERE head_kind IS NULL AND inside = 'article' AND item_at > article_at AND regexp_matches(line, '^([0-9]+|[ivx]{{2,}})\) '))
SELECT d::VARCHAR AS document_id, start, unit_type, label, last FROM m UNION ALL SELECT d::VARCHAR, 0, 'metadata', 'document', NULL FROM m GROUP BY d HAVING min(start) > 0"""


@plan(STRUCTURE)
def law_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of texts that have every form: numbered, unnumbered, wrapped, misread and repealed articles, ranges, chapters,
    annexes, children with their state, text that is none of it, and what follows the law."""
    return segment.scan_markers(law_texts(spark, sf_dir)).select("document_id", "start", "unit_type", "label", "last")


MOST = 48
CHUNK_TEXT = "'MADDE ' || n || ' - Sipariş ' || k || chr(10) || '(1) Birinci fıkra. Müşteri ' || c || ' için. Bitti.' || chr(10) || '(2) ' || repeat('uzun metin ', k % 12) || chr(10) || '(3)  Son'"
CHUNKED = rf"""WITH RECURSIVE a AS (SELECT o_custkey AS d, n, {CHUNK_TEXT} || CASE WHEN n < many THEN chr(10) ELSE '' END AS t FROM (SELECT o_custkey, o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS many FROM orders)),
s AS (SELECT *, (sum(length(t)) OVER (PARTITION BY d ORDER BY n))::BIGINT - length(t) AS a0 FROM a),
b AS (SELECT *, list_transform(['(1)', '(2)', '(3)'], lambda x: strpos(t, chr(10) || x)) AS par FROM s),
r AS (SELECT d, n, t, par, 0::BIGINT AS c0, length(t)::BIGINT AS e FROM b UNION ALL SELECT d, n, t, par, cut + length(substr(t, cut + 1)) - length(ltrim(substr(t, cut + 1), ' ' || chr(10))), e FROM (
SELECT *, coalesce(list_max(list_filter(par, lambda x: x > c0 AND x <= c0 + {MOST})), CASE WHEN strpos(piece, chr(10)) > 0 THEN c0 + 1 + length(piece) - strpos(reverse(piece), chr(10)) WHEN strpos(piece, '. ') > 0 THEN c0 + 1 + length(piece) - strpos(reverse(piece), ' .') ELSE c0 + {MOST} END) AS cut
FROM (SELECT *, substr(t, c0 + 2, {MOST} - 1) AS piece FROM r WHERE e - c0 > {MOST}))),
o AS (SELECT *, coalesce(lead(c0) OVER (PARTITION BY d, n ORDER BY c0), e) AS c1 FROM r WHERE c0 < e),
x AS (SELECT d, n, par, c0, rtrim(substr(t, c0 + 1, c1 - c0), ' ' || chr(10)) AS body, length(rtrim(t, chr(10))) AS whole FROM o),
u AS (SELECT *, c0 + length(body) AS c9 FROM x WHERE body <> ''),
v AS (SELECT *, list_filter([{{key: '', s: 0::BIGINT, e: whole}}, {{key: '/paragraph:1', s: par[1], e: par[2] - 1}}, {{key: '/paragraph:2', s: par[2], e: length(rtrim(substr('', 1, 0))) + par[3] - 1}}, {{key: '/paragraph:3', s: par[3], e: whole}}], lambda y: y.s < c9 AND y.e > c0) AS over FROM u)
SELECT d::VARCHAR AS document_id, (row_number() OVER (PARTITION BY d ORDER BY n, c0) - 1)::INT AS chunk_index, md5(body) AS text_md5, n::VARCHAR AS label,
'article:' || n || list_sort(list_transform(over, lambda y: {{w: y.e - y.s, s: y.s, key: y.key}}))[1].key AS unit_key, len(over) AS n_units FROM v"""


@plan(CHUNKED)
def law_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a text with an article of three paragraphs for each order of a customer, with a limit that cuts at
    paragraphs, lines, sentences and within words, and the smallest unit and label of each."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("chunk_orders")
    lines = spark.sql(f"SELECT o_custkey, n AS chunk_index, {CHUNK_TEXT} AS text FROM (SELECT o_custkey, o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM chunk_orders)")
    docs = relational.document_text(lines, "o_custkey").select(F.col("o_custkey").cast("string").alias("document_id"), F.col("body").alias("text"))
    cut = chunking.structured_chunks(docs, max_chars=MOST)
    return cut.select("document_id", "chunk_index", F.md5("text").alias("text_md5"), "label", "unit_key", F.size("unit_keys").cast("long").alias("n_units"))


# --- corpus as tables ----------------------------------------------------------------------------------------------


@plan(r"""WITH l AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE doc_id % 4 <> 0),
c AS (SELECT * FROM l WHERE i % 5 <> 4)
SELECT doc_id, i::INT AS chunk_index, CASE WHEN source LIKE '%1' THEN 'case_law' ELSE 'primary' END AS domain_role, md5(c.text) AS text_md5, CASE WHEN doc_id % 3 = 0 THEN (1000 + doc_id)::VARCHAR END AS primary_legislation_number,
CASE WHEN doc_id % 3 = 0 THEN (1000 + doc_id) || ',77' ELSE '77' END AS legislation_numbers, CASE WHEN i % 3 = 0 THEN CASE WHEN i % 2 = 0 THEN '' ELSE 'Geçici' END || i ELSE '' END AS article_labels
FROM c WHERE lang = 'en' AND source NOT LIKE '%2'""")
def corpus_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a version and a domain, from bucketed tables: documents as laws or decisions, lines as chunks, every
    third with an article."""
    docs = table(spark, sf_dir, "documents").withColumn("document_id", F.col("doc_id")).withColumn("parse_id", F.lit("p1"))
    law = F.col("doc_id") % 3 == 0
    documents = docs.select("document_id", F.when(law, "legislation").otherwise("decision").alias("source_kind"), F.concat(F.lit("law-"), F.col("doc_id") + 1000).alias("source_document_id"), F.lit("Başlık").alias("title"), F.array(F.lit("77")).alias("related_legislation"))
    lines = docs.select("document_id", "parse_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "text"))
    chunk_rows = lines.withColumn("section_type", F.lit("line")).withColumn("retrieval_eligible", F.when(F.col("chunk_index") % 5 == 4, False))
    units = lines.filter("chunk_index % 3 = 0").select("document_id", "parse_id", F.concat(F.lit("u"), F.col("chunk_index")).alias("unit_key"), F.when(F.col("chunk_index") % 2 == 0, "article").otherwise("temporary_article").alias("unit_type"), F.col("chunk_index").cast("string").alias("label"))
    role = F.when(F.col("source").endswith("1"), "case_law").when(F.col("source").endswith("2"), "other").otherwise("primary")
    tables = {
        "pins": docs.filter("doc_id % 4 <> 0").select("document_id", "parse_id", F.lit("v1").alias("corpus_version")).unionByName(docs.select("document_id", F.lit("p0").alias("parse_id"), F.lit("v0").alias("corpus_version"))),
        "documents": documents, "domains": docs.select("document_id", F.col("lang").alias("domain_code"), role.alias("role")), "chunks": chunk_rows,
        "units": units, "links": units.select("document_id", "parse_id", "unit_key", F.expr("CAST(substr(unit_key, 2) AS INT)").alias("chunk_index")),
    }
    path = scratch.path(spark, "corpus")
    prefix = "corpus_" + path.rpartition("-")[2]
    corpus_store.write_corpus(tables, prefix, path, 8)
    found = corpus_store.scope_records(corpus_store.read_corpus(spark, prefix), "v1", "en", ["primary", "case_law"])
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select(F.col("document_id").alias("doc_id"), "chunk_index", "domain_role", F.md5("text").alias("text_md5"), "primary_legislation_number", joined("legislation_numbers"), joined("article_labels"))


# --- matches and citations -----------------------------------------------------------------------------------------


@plan(f"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({sql_stems('text')}) AS term FROM benchmark), t AS (SELECT doc_id AS chunk_id, unnest({sql_stems('text')}) AS term FROM documents),
s AS (SELECT query_id, chunk_id, round(count(*) * 0.1, 6) AS score FROM t JOIN q USING (term) GROUP BY query_id, chunk_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def any_term_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents with the greatest cover density for each benchmark item, any of whose words may match."""
    return covers.cover_search(questions(spark, sf_dir), chunks(spark, sf_dir), 10).select("query_id", "chunk_id", "score", F.col("rank").cast("long"))


@plan("""WITH w AS (SELECT 'w' || page_id AS id, unnest(list_filter([CASE WHEN page_id % 3 = 0 THEN 'source_url' END, CASE WHEN page_id % 5 = 0 THEN 'exact_passage' END, CASE WHEN page_id % 7 = 0 THEN 'stored_row' END, CASE WHEN page_id % 11 = 0 THEN 'source_id' END, CASE WHEN page_id % 13 = 0 THEN 'snapshot_channel' END], lambda x: x IS NOT NULL)) AS rule FROM pages),
f AS (SELECT 'f' || conv_id || '-' || turn AS id, unnest(list_filter([CASE WHEN conv_id % 4 = 0 OR turn % 5 = 4 THEN 'no_ready_chunk' END, CASE WHEN conv_id % 4 <> 0 AND turn % 5 <> 4 AND turn % 3 = 0 THEN 'snapshot_exact_passage' END, CASE WHEN conv_id % 4 <> 0 AND turn % 5 <> 4 AND conv_id % 6 = 1 THEN 'snapshot_title' END, CASE WHEN turn % 4 = 1 THEN 'stored_row' END], lambda x: x IS NOT NULL)) AS rule FROM conversations),
c AS (SELECT 'c' || doc_id AS id, unnest(list_filter([CASE WHEN doc_id % 9 = 0 THEN 'no_chunk' END, CASE WHEN doc_id % 9 <> 0 AND doc_id % 4 = 1 THEN 'snapshot_exact_passage' END, CASE WHEN doc_id % 5 = 0 THEN 'snapshot_title' END, CASE WHEN doc_id % 7 = 3 THEN 'source_url' END, CASE WHEN doc_id % 6 = 0 THEN 'no_version_in_force' END,
CASE WHEN doc_id % 6 <> 0 AND doc_id % 2 = 1 AND doc_id % 3 = 2 THEN 'parse_in_force' END, CASE WHEN doc_id % 6 <> 0 AND doc_id % 2 = 1 AND doc_id % 3 = 2 THEN 'corpus_version' END], lambda x: x IS NOT NULL)) AS rule FROM documents)
SELECT id AS citation_id, rule FROM w UNION ALL SELECT id, rule FROM f UNION ALL SELECT id, rule FROM c""")
def snapshot_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of citations of pages (web), turns (files of conversations) and documents (two versions of odd ones),
    with faults at known places."""
    pages, turns, docs = (table(spark, sf_dir, name) for name in ("pages", "conversations", "documents"))
    none = lambda kind: F.lit(None).cast(kind)
    fields = {"source_channel": "string", "source_url": "string", "exact_passage": "string", "title": "string", "file_id": "string", "file_chunk_id": "string", "page_start": "int", "page_end": "int", "corpus_version": "string", "page_number": "int", "authority": "string", "case_number": "string", "decision_number": "string", "document_date": "date"}
    ids = ("source_id", "document_id", "parse_id", "chunk_id", "file_id", "file_chunk_id", "workspace_id")

    def cited(rows: DataFrame, channel: str, citation_id, cited_at, snapshot: dict, **own) -> DataFrame:
        told = F.struct(*(snapshot.get(c, none(kind)).cast(kind).alias(c) for c, kind in fields.items()))
        return rows.select(citation_id.alias("citation_id"), F.lit(channel).alias("source_channel"), cited_at.alias("cited_at"), *(own.get(c, none("string")).cast("string").alias(c) for c in ids), told.alias("snapshot"))

    page = lambda n: F.col("page_id") % n == 0
    web = cited(
        pages, "web", F.concat(F.lit("w"), "page_id"), none("date"), {"source_url": F.when(page(3), F.concat(F.lit("ftp://x/"), "page_id")).otherwise(F.concat(F.lit("https://x/"), "page_id")), "exact_passage": F.when(page(5), " \n").otherwise(F.lit("geçer")), "source_channel": F.when(page(13), "file").otherwise("web")},
        source_id=F.when(page(11), F.lit("S")).otherwise(F.concat(F.lit("SOURCE_WEB_"), "page_id")), document_id=F.when(page(7), F.lit("d")),
    )
    chunk_id, workspace = F.concat_ws("-", "conv_id", "turn"), (F.col("conv_id") % 3).cast("string")
    file = cited(
        turns, "file", F.concat(F.lit("f"), chunk_id), none("date"), {"exact_passage": F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), "title": F.concat(F.lit("ad"), F.col("conv_id") + (F.col("conv_id") % 6 == 1).cast("int")), "file_id": F.col("conv_id"), "file_chunk_id": chunk_id, "page_start": F.col("turn"), "page_end": F.col("turn") + 1},
        file_id=F.col("conv_id"), file_chunk_id=chunk_id, workspace_id=F.when(F.col("turn") % 5 == 4, "x").otherwise(workspace), parse_id=F.when(F.col("turn") % 4 == 1, F.lit("p")),
    )
    file_chunks = turns.select(chunk_id.alias("file_chunk_id"), F.col("conv_id").cast("string").alias("file_id"), workspace.alias("workspace_id"), "text", F.col("turn").alias("page_start"), (F.col("turn") + 1).alias("page_end"))
    files = turns.select(F.col("conv_id").cast("string").alias("file_id"), workspace.alias("workspace_id"), F.when(F.col("conv_id") % 4 == 0, "processing").otherwise("ready").alias("status"), F.concat(F.lit("ad"), "conv_id").alias("original_name")).distinct()
    d = F.col("doc_id")
    day = F.when(d % 6 == 0, F.lit("2019-06-01")).when(d % 3 == 2, "2023-01-01").otherwise("2020-06-01").cast("date")
    corpus = cited(
        docs, "corpus", F.concat(F.lit("c"), d), day, {"exact_passage": F.when(d % 4 == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text")), "title": F.when(d % 5 == 0, "Başka").otherwise(F.concat(F.lit("Belge "), d)), "source_url": F.when(d % 7 == 3, F.lit("http://y")).when(d % 7 == 4, none("string")).otherwise(F.concat(F.lit("http://x/"), d)), "corpus_version": F.lit("v1"), "document_date": F.lit("2001-01-01")},
        document_id=d, parse_id=F.lit("p1"), chunk_id=F.when(d % 9 == 0, F.lit("none")).otherwise(F.concat(F.lit("k"), d)),
    )
    kept = docs.select(F.concat(F.lit("k"), d).alias("chunk_id"), d.cast("string").alias("document_id"), F.lit("p1").alias("parse_id"), none("int").alias("page_number"), F.col("text").alias("exact_passage"))
    known = docs.select(d.cast("string").alias("document_id"), F.concat(F.lit("Belge "), d).alias("title"), *(none("string").alias(c) for c in ("authority", "case_number", "decision_number")), F.lit("2001-01-01").cast("date").alias("document_date"), F.concat(F.lit("http://x/"), d).alias("source_url"))
    version = lambda name, parse, begin, end, rows: rows.select(d.cast("string").alias("document_id"), F.lit(name).alias("corpus_version"), F.lit(parse).alias("parse_id"), F.lit(begin).cast("date").alias("valid_from"), end.cast("date").alias("valid_to"))
    versions = version("v1", "p1", "2020-01-01", F.when(d % 2 == 1, "2022-01-01"), docs).unionByName(version("v2", "p2", "2022-01-01", none("date"), docs.filter("doc_id % 2 = 1")))
    return snapshots.snapshot_violations(web.unionByName(file).unionByName(corpus), kept, known, versions, file_chunks, files)


# --- catalog, checks, reparsing ------------------------------------------------------------------------------------


@plan("""SELECT doc_id AS document_id, CASE WHEN doc_id % 7 <> 0 THEN 'Belge ' || doc_id END AS display_name, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN doc_id::VARCHAR END AS document_number,
CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'Kanun No. ' || doc_id WHEN doc_id % 3 = 1 AND doc_id % 5 <> 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'E. 2020/' || doc_id ELSE 'E. 2020/' || doc_id || ' / K. 2021/' || doc_id END WHEN doc_id % 3 = 1 AND doc_id % 4 <> 0 THEN 'K. 2021/' || doc_id
WHEN doc_id % 7 <> 0 THEN 'Belge ' || doc_id ELSE CASE WHEN doc_id % 2 = 0 THEN 'law-' ELSE 'x-' END || doc_id END AS legal_identifier,
CASE doc_id % 3 WHEN 0 THEN 'Kanun' WHEN 1 THEN 'İçtihat Kararı' ELSE 'Diğer' END AS document_category, CASE WHEN doc_id % 11 <> 0 THEN '2026.' || doc_id % 2 END AS parser_version, CASE WHEN doc_id % 11 <> 0 THEN sha256(text) END AS artifact_hash, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'v1,v2' ELSE 'v1' END AS versions FROM documents""")
def document_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as laws, decisions and others, with their parse, artifact and the versions that pin them."""
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    text_id = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    documents = docs.select(
        d.alias("document_id"), F.when(d % 7 != 0, text_id("Belge ", d)).alias("title"), F.when(d % 3 == 0, "legislation").when(d % 3 == 1, "court_decision").otherwise("doctrine").alias("source_kind"),
        F.when(d % 3 == 0, "law").when(d % 3 == 1, "court_decision").otherwise("book").alias("document_type"), F.when(d % 2 == 0, text_id("law-", d)).otherwise(text_id("x-", d)).alias("source_document_id"),
        F.when(d % 5 == 0, "").otherwise(text_id("2020/", d)).alias("case_number"), F.when(d % 4 != 0, text_id("2021/", d)).alias("decision_number"), text_id("p", d).alias("current_parse_id"),
    )
    parses = docs.filter("doc_id % 11 <> 0").select(d.alias("document_id"), text_id("p", d).alias("parse_id"), text_id("a", d).alias("artifact_id"), text_id("2026.", d % 2).alias("parser_version"), F.lit("ready").alias("status"))
    artifacts = docs.select(d.alias("document_id"), text_id("a", d).alias("artifact_id"), F.lit("text/plain").alias("media_type"), F.lit("x").alias("storage_path"), F.sha2("text", 256).alias("content_hash"))
    pin = lambda v, rows: rows.select(d.alias("document_id"), text_id("p", d).alias("parse_id"), F.lit(v).alias("corpus_version"))
    pins = pin("v1", docs.filter("doc_id % 11 <> 0")).unionByName(pin("v2", docs.filter("doc_id % 2 = 0 AND doc_id % 11 <> 0"))).unionByName(docs.select(d.alias("document_id"), F.lit("old").alias("parse_id"), F.lit("v0").alias("corpus_version")))
    found = catalog.catalog(documents, parses, artifacts, pins)
    return found.select("document_id", "display_name", "document_number", "legal_identifier", "document_category", "parser_version", "artifact_hash", F.array_join("corpus_versions", ",").alias("versions"))


@plan("""WITH d AS (SELECT doc_id, doc_id % 3 AS kind, text FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT count(*) AS n, count(*) FILTER (kind = 0) AS laws, count(*) FILTER (kind = 1) AS decisions, count(*) FILTER (doc_id % 8 <> 1) AS ready, count(*) FILTER (doc_id % 9 <> 2) AS parser,
count(*) FILTER (kind = 1 AND doc_id % 14 = 4) AS lacking, count(*) FILTER (kind = 1 AND doc_id % 5 = 2) AS leaks, count(*) FILTER (kind = 0 AND doc_id % 4 = 2) AS alone, count(*) FILTER (doc_id % 13 <> 5) AS sound FROM d)
SELECT unnest(['document_count', 'legislation_count', 'decision_count', 'ready_parses', 'parser_version', 'decision_metadata', 'footer_cleanup', 'legal_unit_links', 'artifact_hashes']) AS "check", unnest([n, laws, decisions, ready, parser, lacking, leaks, alone, sound]) AS actual,
unnest([7, laws, -1, n, n, 0, 0, 0, n]) AS expected, unnest([n = 7, true, decisions = -1, ready = n, parser = n, lacking = 0, leaks = 0, alone = 0, sound = n]) AS ok FROM (SELECT *, laws AS l FROM n)""")
def corpus_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine checks of a version of all documents but every tenth, with faults of each kind at known places."""
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    key = d.alias("document_id")
    none = F.lit(None).cast("string")
    pins = docs.filter("doc_id % 10 <> 0").select(key, d.alias("parse_id"), F.lit("v").alias("corpus_version"))
    documents = docs.select(key, F.when(d % 3 == 0, catalog.LAW).when(d % 3 == 1, catalog.DECISION).otherwise("doctrine").alias("source_kind"), F.lit("c").alias("chamber"), F.lit("1").alias("case_number"), F.when(d % 14 == 4, none).otherwise("2").alias("decision_number"), F.lit("2020-01-01").cast("date").alias("document_date"))
    parses = docs.select(d.alias("parse_id"), F.when(d % 8 == 1, "failed").otherwise("ready").alias("status"), F.when(d % 9 == 2, "old").otherwise("now").alias("parser_version"))
    leak = F.concat(F.lit("X kullanıcısı tarafından\n"), "text", F.lit(" tarihinde oluşturuldu."))
    chunk_rows = docs.select(d.alias("parse_id"), F.when(d % 5 == 2, leak).otherwise(F.col("text")).alias("text"))
    units = docs.select(d.alias("parse_id"), F.lit("u").alias("unit_key"))
    artifacts = docs.select(key, d.alias("artifact_id"))
    laws = docs.filter("doc_id % 10 <> 0 AND doc_id % 3 = 0").count()
    expected = {"document_count": 7, "legislation_count": laws}
    return catalog.corpus_checks("v", expected, "now", pins, documents, parses, chunk_rows, units, units.filter("parse_id % 4 <> 2"), artifacts, artifacts.filter("artifact_id % 13 = 5").select("artifact_id"))


@plan("""SELECT s_suppkey AS document_id, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 6 <> 0 THEN 'Yeni ' || s_suppkey ELSE s_name END AS title, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 6 <> 0 THEN 'a=new,b=2,c=3' ELSE 'a=1,b=2' END AS meta, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS attempt FROM supplier""")
def merged_reparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stored documents of which every third is parsed again; of those every second fails and stays."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    told = lambda *pairs: F.create_map(*(F.lit(x) for x in pairs))
    stored = s.select(k.alias("document_id"), F.col("s_name").alias("title"), told("a", "1", "b", "2").alias("meta"), F.lit(1).alias("attempt"))
    path = scratch.path(spark, "documents")
    catalog.write_documents(stored, path, 16)
    again = s.filter(k % 3 == 0)
    target = again.select(k.alias("document_id"), F.concat(F.lit("Yeni "), k.cast("string")).alias("title"), told("a", "new", "c", "3").alias("meta"))
    catalog.reparse_documents(spark, path, scratch.path(spark, "reparse"), target, 16, ["title"], ["meta"], again.filter(k % 6 == 0).select(k.alias("document_id")))
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return spark.read.parquet(path).select("document_id", "title", entries.alias("meta"), "attempt")


@plan("""WITH h AS (SELECT l_suppkey AS q, 'http://x/' || l_partkey % 40 AS url, l_linenumber AS part, l_orderkey AS rank FROM lineitem),
f AS (SELECT q, url, min([part, rank]) AS x FROM h GROUP BY q, url), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY x[1], x[2], url) AS p FROM f)
SELECT q AS query_id, 'SOURCE_WEB_' || CASE WHEN p < 10 THEN '0' || p ELSE p::VARCHAR END AS source_id, url, x[1]::BIGINT AS part, x[2]::BIGINT AS rank FROM n""")
def web_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web results of several ordered queries, each address once, numbered by its first place."""
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.concat(F.lit("http://x/"), F.col("l_partkey") % 40).alias("url"), F.col("l_linenumber").cast("long").alias("part"), F.col("l_orderkey").cast("long").alias("rank"))
    return catalog.merge_web_results(hits).select("query_id", "source_id", "url", "part", "rank")


PAGE = """concat_ws(chr(10), CASE WHEN doc_id % 3 <> 0 THEN 'BAŞLIK ' || doc_id ELSE 'Giriş metni' END, CASE WHEN doc_id % 4 = 0 THEN '- ' || doc_id % 90 || ' -' ELSE 'Alt ' || source END, '', text, CASE WHEN doc_id % 5 = 0 THEN 'Sayfa ' || doc_id % 90 || ' / 99' ELSE 'son satır' END, CASE WHEN doc_id % 2 = 0 THEN '7/8' ELSE 'DİP NOT' END)"""
_NOISE = "(trim(y) = 'DİP NOT' OR starts_with(trim(y), 'BAŞLIK ') OR regexp_matches(lower(trim(y)), '^(sayfa)?[ -]*[0-9]{1,4}[ -]*(/[ -]*[0-9]{1,4})?[ -]*$'))"


@plan(f"""WITH p AS (SELECT doc_id, string_split({PAGE}, chr(10)) AS l FROM documents), i AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda k: trim(l[k]) <> '') AS s, list_transform(l, lambda y: {_NOISE}) AS z FROM p),
g AS (SELECT doc_id, l, list_concat(CASE WHEN z[s[1]] THEN CASE WHEN z[s[2]] THEN [s[1], s[2]] ELSE [s[1]] END ELSE [] END, CASE WHEN z[s[-1]] THEN CASE WHEN z[s[-2]] THEN [s[-1], s[-2]] ELSE [s[-1]] END ELSE [] END) AS gone FROM i)
SELECT doc_id, md5(array_to_string(list_transform(range(1, len(l) + 1), lambda k: CASE WHEN list_contains(gone, k) THEN '' ELSE l[k] END), chr(10))) AS text_md5 FROM g""")
def stripped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with headers, footers and page numbers of several forms, in two rounds from each end."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("page_documents")
    pages = spark.sql(f"SELECT 'd' AS document_id, doc_id AS page, {PAGE} AS text FROM page_documents")
    again = pages.select("document_id", F.explode(F.split("text", "\n")).alias("line")).filter("line = 'DİP NOT' OR startswith(line, 'BAŞLIK ')")
    repeated = again.select("document_id", F.regexp_replace("line", "[0-9]", "#").alias("edge_line")).distinct()
    return segment.strip_edges(pages, repeated).select(F.col("page").alias("doc_id"), F.md5("text").alias("text_md5"))


DECISION = "CASE k % 9 WHEN 0 THEN 'DAVA:' WHEN 1 THEN 'II. GEREKÇE' WHEN 2 THEN 'Davacının İstemi' WHEN 3 THEN '  HUKUKİ DEĞERLENDİRME : ' WHEN 4 THEN 'İlk Derece Mahkemesi Kararı' WHEN 5 THEN 'Karar metni ' || k WHEN 6 THEN 'SONUÇ: metin' WHEN 7 THEN 'Sonuç' ELSE 'satır ' || k END || chr(10) || 'gövde ' || k"


@plan(rf"""WITH o AS (SELECT o_custkey AS d, string_agg({DECISION}, chr(10) ORDER BY k) AS t FROM (SELECT o_custkey, o_orderkey AS k FROM orders) GROUP BY o_custkey),
l AS (SELECT d, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM o),
h AS (SELECT *, regexp_extract(upper(translate(line, 'iıİ', 'III')), '^ *(?:[IVX]+[.)] *)?(DAVA|GEREKÇE|DAVACININ ISTEMI|HUKUKI DEĞERLENDIRME|ILK DERECE MAHKEMESI KARARI|SONUÇ|KARAR) *:? *$', 1) AS u FROM l),
n AS (SELECT *, count(*) FILTER (u <> '') OVER (PARTITION BY d ORDER BY i ROWS UNBOUNDED PRECEDING) AS part FROM h)
SELECT d AS document_id, part::INT AS part, CASE max(u) WHEN '' THEN 'metadata' WHEN 'DAVA' THEN 'dava' WHEN 'GEREKÇE' THEN 'gerekçe' WHEN 'HUKUKI DEĞERLENDIRME' THEN 'gerekçe' WHEN 'DAVACININ ISTEMI' THEN 'davacı_istemi' WHEN 'ILK DERECE MAHKEMESI KARARI' THEN 'ilk_derece_mahkemesi_kararı' WHEN 'SONUÇ' THEN 'sonuç' ELSE 'karar' END AS section, md5(string_agg(line, chr(10) ORDER BY i)) AS text_md5 FROM n GROUP BY d, part""")
def decision_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a decision for each customer, with headers in several forms and lines that only look like one."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("decision_orders")
    lines = spark.sql(f"SELECT o_custkey, k AS chunk_index, {DECISION} AS text FROM (SELECT o_custkey, o_orderkey AS k FROM decision_orders)")
    docs = relational.document_text(lines, "o_custkey").select(F.col("o_custkey").alias("document_id"), F.col("body").alias("text"))
    return segment.sections(docs).select("document_id", "part", "section", F.md5("text").alias("text_md5"))
