"""Registered plans of joins, dates, packing, corpus building, audits and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpusflow.functions import dates, text
from korpusflow.operators import citations, corpus, lawrefs, pack, relational, search, segment, temporal
from korpusflow.plans.common import chunks, questions, sql_bm25, sql_top, table
from korpusflow.sources import files, pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def plan(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


# --- joins ---------------------------------------------------------------------------------------------------------


@plan("""SELECT a.l_orderkey, a.l_linenumber AS x, b.l_linenumber AS y, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
AND epoch(a.l_shipdate)::BIGINT < epoch(b.l_shipdate)::BIGINT + 604800 AND epoch(a.l_shipdate)::BIGINT + 604800 > epoch(b.l_shipdate)::BIGINT GROUP BY ALL""")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_timestamp("l_shipdate")
    side = lambda n, s, e: table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias(n), start.alias(s), (start + 604800).alias(e))
    found = relational.overlap(side("x", "s1", "e1"), side("y", "s2", "e2"), ["l_orderkey"], ("s1", "e1"), ("s2", "e2"), bin=30 * 86400)
    return found.filter("x < y").groupBy("l_orderkey", "x", "y").agg(F.count(F.lit(1)).alias("n"))


@plan("""WITH i AS (SELECT l_orderkey, l_linenumber AS unit, l_linenumber * 5 AS s, l_linenumber * 5 + 3 + l_quantity::INT AS e FROM lineitem), p AS (SELECT DISTINCT l_orderkey, l_quantity::INT AS point FROM lineitem)
SELECT p.l_orderkey, p.point, min(e - s) IS NOT NULL AS held, (min((e - s, unit)) FILTER (e IS NOT NULL))[2] AS unit FROM p LEFT JOIN i ON i.l_orderkey = p.l_orderkey AND s <= point AND point < e GROUP BY ALL""")
def smallest_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    intervals = lines.select("l_orderkey", (F.col("l_linenumber") * 5).alias("s"), (F.col("l_linenumber") * 5 + 3 + F.col("l_quantity").cast("int")).alias("e"), F.col("l_linenumber").alias("unit"))
    points = lines.select("l_orderkey", F.col("l_quantity").cast("int").alias("point")).distinct().withColumn("id", F.col("point"))
    held = relational.smallest_container(points, intervals, ["l_orderkey"], "point", "id", "s", "e", "unit")
    return held.select("l_orderkey", "point", F.col("unit").isNotNull().alias("held"), "unit")


CHANGES = """c AS (SELECT o_orderkey AS event_id, (o_custkey % 40)::VARCHAR AS law, (o_orderkey % 7)::VARCHAR AS article, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 2 + 1)::INT END AS paragraph,
CASE o_orderstatus WHEN 'F' THEN 'amended' WHEN 'O' THEN 'added' ELSE 'annulled' END AS event_type, o_orderdate::DATE AS change_date, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderdate + INTERVAL 90 DAY)::DATE END AS effective_from FROM orders)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as dated change events of articles."""
    o, day = table(spark, sf_dir, "orders"), F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 40).cast("string").alias("law"), (F.col("o_orderkey") % 7).cast("string").alias("article"), F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 2 + 1).cast("int")).alias("paragraph"),
        F.when(F.col("o_orderstatus") == "F", "amended").when(F.col("o_orderstatus") == "O", "added").otherwise("annulled").alias("event_type"), day.alias("change_date"), F.when(F.col("o_orderkey") % 5 == 0, F.date_add(day, 90)).alias("effective_from"),
    )


@plan(f"""WITH {CHANGES}, d AS (SELECT s_suppkey AS id, DATE '1996-06-01' + (s_suppkey % 700)::INT AS decided, (s_suppkey % 40)::VARCHAR AS law, (s_suppkey % 7)::VARCHAR AS article, CASE WHEN s_suppkey % 2 = 0 THEN 1 END AS par FROM supplier)
SELECT DISTINCT id, event_id, event_type, coalesce(effective_from, change_date) AS change_date FROM d JOIN c USING (law, article) WHERE coalesce(effective_from, change_date) > decided AND (par IS NULL OR paragraph IS NOT DISTINCT FROM par OR (paragraph IS NULL AND event_type <> 'added'))""")
def asof_changes_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    decisions = s.select(F.col("s_suppkey").alias("id"), F.date_add(F.lit("1996-06-01").cast("date"), (F.col("s_suppkey") % 700).cast("int")).alias("decided"))
    refs = s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 40).cast("string").alias("law"), (F.col("s_suppkey") % 7).cast("string").alias("article"), F.when(F.col("s_suppkey") % 2 == 0, 1).alias("paragraph"))
    return temporal.changes_after(decisions, refs, changes(spark, sf_dir))


@plan(f"""WITH {CHANGES}, a AS (SELECT event_id, law, DATE '1997-03-01' AS day, * EXCLUDE (event_id, law) FROM c), l AS (SELECT *, CASE WHEN effective_from IS NOT NULL THEN CASE WHEN day < effective_from THEN 'changed_after' END WHEN day < change_date THEN 'changed_after'
WHEN day - change_date < CASE event_type WHEN 'annulled' THEN 366 ELSE 183 END THEN 'near_change' END AS level FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY law ORDER BY CASE level WHEN 'changed_after' THEN 0 ELSE 2 END, change_date DESC, event_id) AS position FROM l WHERE level IS NOT NULL)
SELECT law AS query_id, position, level, event_id, event_type, change_date FROM r WHERE position <= 8""")
def temporal_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changes(spark, sf_dir).withColumn("chunk_id", F.col("law"))
    cited = c.select(F.col("law").alias("query_id"), F.col("law").alias("source_id"), "chunk_id").distinct()
    case = cited.select("query_id", "source_id").withColumn("case_date", F.lit("1997-03-01").cast("date"))
    found = temporal.temporal_checks(cited, c.drop("law", "article", "paragraph"), case)
    return found.select("query_id", F.col("position").cast("long"), "level", "event_id", "event_type", "change_date")


@plan(f"""WITH {CHANGES}, t AS (SELECT law AS chunk_id, event_id, change_date, row_number() OVER (PARTITION BY law ORDER BY change_date DESC, event_id) AS n FROM c)
SELECT chunk_id, string_agg(event_id, ',' ORDER BY n) AS events FROM t WHERE n <= 12 GROUP BY chunk_id""")
def changes_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = temporal.changes_by_chunk(changes(spark, sf_dir).withColumn("chunk_id", F.col("law")))
    return c.select("chunk_id", F.array_join(F.transform("changes", lambda e: e["event_id"].cast("string")), ",").alias("events"))


@plan("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN DATE '1997-01-01' < (o_orderdate + INTERVAL 90 DAY)::DATE THEN 'changed_after' END WHEN DATE '1997-01-01' < o_orderdate::DATE THEN 'changed_after'
WHEN DATE '1997-01-01' - o_orderdate::DATE < CASE o_orderstatus WHEN 'P' THEN 366 ELSE 183 END THEN 'near_change' END AS level FROM orders""")
def change_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changes(spark, sf_dir)
    return c.select(F.col("event_id").alias("o_orderkey"), dates.assess(F.col("event_type"), F.col("change_date"), F.col("effective_from"), F.lit("1997-01-01").cast("date")).alias("level"))


@plan("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS s, (o_orderkey % 30 + 1)::INT AS n FROM orders)
SELECT o_orderkey, (SELECT d FROM (SELECT s + i::INT AS d, row_number() OVER (ORDER BY i) AS k FROM generate_series(1, 60) g(i) WHERE isodow(s + i::INT) < 6) WHERE k = n) AS last FROM o""")
def deadline_business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.last_day(F.to_date("o_orderdate"), F.col("o_orderkey") % 30 + 1, F.lit("iş günü")).alias("last"))


@plan("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS s, (o_orderkey % 14 + 1)::INT AS n, ['gün', 'hafta', 'ay', 'yıl'][(o_orderkey % 4 + 1)::INT] AS unit, (o_orderdate + INTERVAL 40 DAY)::DATE AS act FROM orders),
l AS (SELECT *, CASE unit WHEN 'gün' THEN s + n WHEN 'hafta' THEN s + 7 * n WHEN 'ay' THEN (s + n * INTERVAL 1 MONTH)::DATE ELSE (s + n * INTERVAL 1 YEAR)::DATE END AS last FROM o)
SELECT o_orderkey, last, act <= last AS in_time, isodow(last) > 5 AS weekend FROM l""")
def deadline_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.to_date("o_orderdate")
    unit = F.element_at(F.array(*map(F.lit, ("gün", "hafta", "ay", "yıl"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    checked = dates.check_deadline(start, F.col("o_orderkey") % 14 + 1, unit, F.date_add(start, 40))
    return table(spark, sf_dir, "orders").select("o_orderkey", checked.alias("c")).select("o_orderkey", "c.last", "c.in_time", "c.weekend")


@plan("SELECT o_orderkey, o_orderdate::DATE AS stated, 1 AS n FROM orders")
def dates_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in four ways (beside what is no date) are found again."""
    day = F.to_date("o_orderdate")
    names = F.element_at(F.array(*map(F.lit, text.MONTHS)), F.month(day))
    spelled = F.element_at(F.array(F.date_format(day, "dd.MM.yyyy"), F.date_format(day, "d/M/yyyy"), F.date_format(day, "yyyy-MM-dd"), F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.initcap(names), F.year(day).cast("string"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    body = F.concat(F.lit("Esas 2022/123, 31.02.2023 ve 1.234.2023 dışında "), spelled, F.lit(" tarihinde karar verildi."))
    found = table(spark, sf_dir, "orders").select("o_orderkey", text.dates_in(body).alias("d"))
    return found.select("o_orderkey", F.col("d")[0].alias("stated"), F.size("d").alias("n"))


@plan("""SELECT o_orderkey::VARCHAR AS id, CASE o_orderkey % 3 WHEN 0 THEN '4857' WHEN 1 THEN '6100' ELSE '6098' END AS law, (o_orderkey % 120 + 1)::VARCHAR AS article, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 9 + 1)::INT END AS paragraph FROM orders""")
def article_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in a sentence of each order: by number, by name and by abbreviation, with and without a paragraph."""
    law = F.element_at(F.array(*map(F.lit, ("4857 sayılı İş Kanunu'nun ", "HMK'nın ", "Türk Borçlar Kanunu'nun "))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    paragraph = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/"), (F.col("o_custkey") % 9 + 1).cast("string"))).otherwise("")
    sentence = F.concat(F.lit("Mahkemece "), law, (F.col("o_orderkey") % 120 + 1).cast("string"), paragraph, F.lit(". maddesi uyarınca karar verildi."))
    return lawrefs.extract_refs(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), sentence.alias("text"), F.lit(None).cast("date").alias("decided")))


# --- packing and windows -------------------------------------------------------------------------------------------


@plan(f"""WITH RECURSIVE {sql_bm25()}, top AS ({sql_top('bm25', 25)}),
i AS (SELECT query_id, chunk_id, greatest(1, (length(text) + 1) // 2) AS cost, CASE t.lang WHEN 'en' THEN 0 WHEN 'de' THEN 2 ELSE 1 END AS stage, rank FROM top t JOIN documents d ON d.doc_id = t.chunk_id),
o AS (SELECT *, CASE stage WHEN 0 THEN 4000 WHEN 1 THEN 6000 ELSE 8000 END AS cap, row_number() OVER (PARTITION BY query_id ORDER BY stage, rank, chunk_id::VARCHAR) AS n FROM i),
f AS (SELECT query_id, n, cost, cap, chunk_id, 1000 + cost <= cap AS keep, CASE WHEN 1000 + cost <= cap THEN 1000 + cost ELSE 1000 END AS used FROM o WHERE n = 1
 UNION ALL SELECT o.query_id, o.n, o.cost, o.cap, o.chunk_id, f.used + o.cost <= o.cap, CASE WHEN f.used + o.cost <= o.cap THEN f.used + o.cost ELSE f.used END FROM f JOIN o ON o.query_id = f.query_id AND o.n = f.n + 1)
SELECT query_id, chunk_id::VARCHAR AS id, row_number() OVER (PARTITION BY query_id ORDER BY n) AS position FROM f WHERE keep""")
def pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunks(spark, sf_dir)
    hits = search.bm25_search(questions(spark, sf_dir), docs, 25).join(docs, "chunk_id")
    channel = F.when(F.col("lang") == "en", "file").when(F.col("lang") == "de", "doctrine").otherwise("primary")
    items = hits.select("query_id", channel.alias("channel"), F.col("rank").alias("order"), F.col("chunk_id").alias("id"), text.token_cost(F.col("text")).alias("cost"))
    return pack.pack(items, base=1000, target=6000, hard=8000, file_tokens=3000).select("query_id", "id", F.col("position").cast("long"))


@plan("""WITH RECURSIVE t AS (SELECT conv_id, turn, greatest(1, (length(text) + 1) // 2) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations), r AS (SELECT * FROM t WHERE n <= 12),
f AS (SELECT conv_id, turn, n, cost <= 300 AS keep, CASE WHEN cost <= 300 THEN cost ELSE 0 END AS used FROM r WHERE n = 1
 UNION ALL SELECT r.conv_id, r.turn, r.n, f.used + r.cost <= 300, CASE WHEN f.used + r.cost <= 300 THEN f.used + r.cost ELSE f.used END FROM f JOIN r ON r.conv_id = f.conv_id AND r.n = f.n + 1)
SELECT conv_id, turn FROM f WHERE keep""")
def select_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.select_history(table(spark, sf_dir, "conversations"), max_tokens=300).select("conv_id", "turn")


@plan("""WITH t AS (SELECT conv_id, turn, greatest(1, (length(text) + 1) // 2) AS cost FROM conversations), s AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS s, sum(cost) OVER (PARTITION BY conv_id) AS total FROM t)
SELECT conv_id, turn, total > 500 AS truncated FROM s WHERE s <= 500""")
def prefix_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.token_cost(F.col("text")).alias("cost"))
    return pack.prefix_pack(turns, "conv_id", "turn", "cost", 500).select("conv_id", "turn", "truncated")


@plan("""WITH c AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations)
SELECT conv_id, turn, md5(coalesce(CASE WHEN regexp_replace(trim(text), '\\s+', ' ', 'g') IS DISTINCT FROM regexp_replace(trim(before), '\\s+', ' ', 'g') THEN before END, '')) AS context_md5 FROM c WHERE role = 'user'""")
def followup_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.followup_context(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.md5(F.coalesce("context", F.lit(""))).alias("context_md5"))


@plan("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE (o_totalprice, o_orderkey) < (150000.0, 0)) > 50 AS has_more FROM orders WHERE (o_totalprice, o_orderkey) < (150000.0, 0) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50""")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursor = relational.next_cursor({"o_totalprice": 150000.0, "o_orderkey": 0}, ["o_totalprice", "o_orderkey"])
    return relational.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 50, cursor)


@plan("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@plan("""WITH RECURSIVE i AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS s, l_partkey + l_quantity::BIGINT AS e FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s, e DESC) AS n FROM i),
f AS (SELECT g, s, e, n, true AS keep, e AS at FROM o WHERE n = 1 UNION ALL SELECT o.g, o.s, o.e, o.n, o.s >= f.at, CASE WHEN o.s >= f.at THEN o.e ELSE f.at END FROM f JOIN o ON o.g = f.g AND o.n = f.n + 1)
SELECT g AS l_suppkey, s AS "start", e AS "end" FROM f WHERE keep""")
def non_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end")).distinct()
    return relational.non_overlapping(spans, ["l_suppkey"])


# --- text and segmentation -----------------------------------------------------------------------------------------

TAGS = "p|div|br|li|ul|ol|tr|table|h1|h2|h3|h4|h5|h6|section|article|header|footer|nav"
VISIBLE = "html"
for _tag in ("script", "style", "noscript"):
    VISIBLE = f"regexp_replace({VISIBLE}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"
VISIBLE = f"regexp_replace(regexp_replace(regexp_replace({VISIBLE}, '(?s)<!--.*?-->', '', 'g'), '(?i)</?(?:{TAGS})\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _name, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    VISIBLE = f"replace({VISIBLE}, '{_name}', '{_sign}')"


@plan(f"SELECT page_id, md5({VISIBLE}) AS text_md5 FROM pages")
def html_text_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.visible_text(F.col("html"))).alias("text_md5"))


@plan()
def html_text_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.parse_html(table(spark, sf_dir, "pages")).select("page_id", "text")


@plan("""WITH l AS (SELECT doc_id, list_transform(string_split(regexp_replace(replace(nfc_normalize(text), chr(173), ''), '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[\\t\\x0B\\f  ]+', ' ', 'g'))) AS a FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(a, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM l""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.md5(text.normalize(F.col("text"))).alias("text_md5"))


@plan("""SELECT doc_id, md5(regexp_replace(regexp_replace(translate(lower(translate(source || ' ' || lang || ' ' || text, 'Iİ', 'ıi')), 'çğıöşüáàâäãåéèêëíìîïñòóôõúùûýÿ', 'cgiosuaaaaaaeeeeiiiinoooouuuyy'), '[^0-9a-z]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug_md5 FROM documents""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.slug(F.concat_ws(" ", "source", "lang", "text"))).alias("slug_md5"))


@plan("""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) AS t FROM documents) SELECT doc_id, count(*) AS n, sum(length(regexp_replace(t, '^\\s+|\\s+$', '', 'g'))) AS chars FROM p WHERE regexp_replace(t, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY doc_id""")
def doc_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = segment.paragraphs(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"))
    return parts.groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents of a source and language as pages of one paper."""
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", (F.col("doc_id") % 13).cast("string")).alias("document_id"), F.col("doc_id").alias("page"), "text")


@plan("""WITH p AS (SELECT source || '/' || lang || '/' || (doc_id % 13) AS d, doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
e AS (SELECT DISTINCT d, doc_id, regexp_replace(x, '[0-9]', '#', 'g') AS k FROM (SELECT d, doc_id, unnest(list_concat(l[1:2], l[-2:])) AS x FROM p) WHERE length(x) <= 60), n AS (SELECT d, count(DISTINCT doc_id) AS pages FROM p GROUP BY d HAVING count(DISTINCT doc_id) >= 3)
SELECT d AS document_id, k AS edge_line, count(*) AS n FROM e JOIN n USING (d) GROUP BY d, k, pages HAVING count(*) >= greatest(3, ceil(pages / 2))""")
def repeated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.repeated_edges(as_pages(spark, sf_dir))


@plan()
def split_pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding prose chunks of all documents, a paragraph a line."""
    lines = table(spark, sf_dir, "documents").select(F.concat_ws("-", "doc_id", F.xxhash64("text")).alias("document_id"), F.posexplode(F.split("text", "\n")).alias("paragraph", "text"), F.lit("").alias("section"))
    return segment.prose_chunks(lines.filter(F.trim("text") != "").withColumn("page", (F.col("paragraph") / 40).cast("int")))


@plan("SELECT 0::BIGINT AS violations, count(*) FILTER (trim(text) <> '') AS documents FROM documents")
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut chunks of all documents leave no text out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    cut = segment.cut_chunks(docs, 1000)
    bad = segment.coverage_violations(docs, cut).agg(F.count(F.lit(1)).alias("violations"))
    return bad.crossJoin(cut.agg(F.count_distinct("document_id").alias("documents")))


@plan("""WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), u AS (SELECT o_custkey, n, 'article:' || n AS unit_key, 'MADDE ' || n || ' - Sipariş ' || o_orderkey || chr(10) || '(1) Birinci fıkra' AS t FROM a)
SELECT o_custkey::VARCHAR AS document_id, unit_key, md5(t) AS text_md5 FROM u UNION ALL SELECT o_custkey::VARCHAR, unit_key || '/paragraph:1', md5('(1) Birinci fıkra') FROM u""")
def legal_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a text with an article and a paragraph for each order of a customer."""
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    lines = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey"), number.alias("chunk_index"))
    body = F.concat(F.lit("MADDE "), F.col("chunk_index").cast("string"), F.lit(" - Sipariş "), F.col("o_orderkey").cast("string"), F.lit("\n(1) Birinci fıkra"))
    docs = relational.document_text(lines.select("o_custkey", "chunk_index", body.alias("text")), "o_custkey").select(F.col("o_custkey").alias("document_id"), F.col("body").alias("text"))
    return segment.units(docs).select("document_id", "unit_key", F.md5("text").alias("text_md5"))


@plan("""WITH p AS (SELECT source || '/' || lang || '/' || (doc_id % 13) AS d, doc_id, text FROM documents WHERE trim(text) <> ''), s AS (SELECT d, doc_id, sum(length(text) + 2) OVER (PARTITION BY d ORDER BY doc_id) - 2 AS e, length(text) AS n FROM p)
SELECT d AS document_id, doc_id AS page, e - n AS start, e AS "end" FROM s""")
def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.page_spans(as_pages(spark, sf_dir))


@plan("""WITH p AS (SELECT source || '/' || lang || '/' || (doc_id % 13) AS d, doc_id, text FROM documents WHERE trim(text) <> ''), s AS (SELECT d, doc_id, sum(length(text) + 2) OVER (PARTITION BY d ORDER BY doc_id) - 2 AS e, length(text) AS n FROM p),
o AS (SELECT DISTINCT d, doc_id * 97 AS o FROM p)
SELECT o.d AS document_id, o.o AS "offset", max(s.doc_id) AS page FROM o LEFT JOIN s ON s.d = o.d AND o.o >= s.e - s.n AND o.o < s.e GROUP BY o.d, o.o""")
def page_at_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page at an offset of each document's text."""
    pages = as_pages(spark, sf_dir)
    offsets = pages.filter(F.trim("text") != "").select("document_id", (F.col("page") * 97).alias("offset")).distinct()
    return segment.page_at(offsets, segment.page_spans(pages))


@plan("""SELECT conv_id AS query_id, turn AS position, title FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(trim(title)) ORDER BY turn) AS k FROM (SELECT conv_id, turn, text AS title FROM conversations)
WHERE length(lower(trim(title))) >= 3) WHERE k = 1) WHERE n <= 2""")
def distinct_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), F.col("text").alias("title"))
    return citations.distinct_queries(q, 2).select("query_id", "position", "title")


@plan("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END, p_brand) AS p_name FROM part UNION ALL SELECT -s_suppkey - 1, s_name FROM supplier")
def upsert_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("p_name"))
    new = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("p_name")).unionByName(table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("p_partkey"), F.col("s_name").alias("p_name")))
    return relational.upsert_coalesce(old, new, ["p_partkey"], ["p_name"])


@plan()
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of one ingest run over all documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    none = docs.select(F.sha2("text", 256).alias("content_hash")).filter("false")
    return corpus.ingest(docs, none, "run-1")["outcomes"]


@plan("""SELECT doc_id // 16 AS document_id, md5(string_agg(md5(text), chr(10) ORDER BY doc_id)) AS body_md5 FROM documents GROUP BY doc_id // 16""")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen rows in a row are the chunks of a document."""
    c = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 16).cast("long").alias("document_id"), "doc_id", F.md5("text").alias("text"))
    return relational.document_text(c, "document_id", "doc_id").select("document_id", F.md5("body").alias("body_md5"))


# --- lifecycle, audits, citations ----------------------------------------------------------------------------------


@plan("""SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY text HAVING max(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END) = 0""")
def dedupe_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    stored = docs.filter("document_id % 10 = 0").select(F.sha2("text", 256).alias("content_hash"))
    return corpus.new_artifacts(docs, stored).select(F.col("document_id").alias("doc_id"), "content_hash")


@plan("SELECT sha256(text) AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def fingerprint_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.duplicates(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash")), ["content_hash"])


LEVEL = ", g{k} AS (SELECT no // 4096 AS no, sha256(string_agg(h, '' ORDER BY no, h)) AS h, sum(n) AS n FROM g{j} GROUP BY no // 4096)"


@plan(f"""WITH r AS (SELECT source, doc_id, sha256(to_json({{doc_id: doc_id, source: source, text_hash: md5(text)}})::VARCHAR) AS h FROM documents), g0 AS (SELECT doc_id // 4096 AS no, sha256(string_agg(h, '' ORDER BY doc_id, h)) AS h, count(*) AS n FROM r GROUP BY doc_id // 4096)
{''.join(LEVEL.format(k=k, j=k - 1) for k in range(1, 6))}
SELECT sha256(string_agg(h, '' ORDER BY no)) AS digest, sum(n)::BIGINT AS records FROM g5""")
def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("text_hash"))
    return corpus.corpus_digest(records, ["doc_id"], "doc_id")


@plan("""WITH c AS (SELECT doc_id AS citation_id, CASE WHEN doc_id % 9 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS chunk, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents)
SELECT citation_id, 'doc_id' AS field, chunk::VARCHAR AS expected, NULL::VARCHAR AS actual FROM c WHERE chunk NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT citation_id, 'lang', c.lang, d.lang FROM c JOIN documents d ON d.doc_id = chunk WHERE c.lang IS DISTINCT FROM d.lang""")
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    cited = docs.select(F.col("doc_id").alias("citation_id"), F.when(F.col("doc_id") % 9 == 0, F.col("doc_id") + 1000000000).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")).alias("lang"), "source")
    return citations.citation_violations(cited, docs, "doc_id", ["lang", "source"])


@plan("""SELECT 'documents' AS "table", doc_id::VARCHAR AS key, 'long_enough' AS rule FROM documents WHERE n_chars < 200 UNION ALL SELECT 'documents', doc_id::VARCHAR, 'known_language' FROM documents WHERE lang NOT IN ('en', 'de')
UNION ALL SELECT 'documents', doc_id::VARCHAR, 'counted' FROM documents WHERE n_chars <> length(text)""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"long_enough": F.col("n_chars") >= 200, "known_language": F.col("lang").isin("en", "de"), "counted": F.col("n_chars") == F.length("text")}
    return relational.violations(table(spark, sf_dir, "documents"), "documents", "doc_id", rules)


@plan("SELECT source AS workspace_id, sum(CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE doc_id END)::BIGINT AS bytes FROM documents GROUP BY source")
def quota_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("workspace_id"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("verified_bytes"), F.col("doc_id").alias("reserved_bytes"))
    return relational.quota_usage(rows)


@plan("""SELECT *, CASE "check" WHEN 'documents' THEN 1000 ELSE 0 END AS expected, actual = CASE "check" WHEN 'documents' THEN 1000 ELSE 0 END AS ok FROM (SELECT unnest(['documents', 'ready_parses', 'chunks', 'documents_without_parse', 'footer_leaks']) AS "check", unnest([(SELECT count(*) FROM documents), (SELECT count(*) FROM labels WHERE quality = 1), (SELECT count(*) FROM documents), (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), (SELECT count(*) FROM documents WHERE contains(lower(text), 'oluşturulma tarihi'))]) AS actual)""")
def corpus_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    parses = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "ready").otherwise("failed").alias("status"))
    return corpus.corpus_quality(docs, parses, docs, {"documents": 1000})


@plan("""SELECT user_id AS run_id, count(*) AS discovered, count(*) FILTER (event_type = 'view') AS imported, count(*) FILTER (event_type = 'click') AS duplicate, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"view": "imported", "click": "duplicate", "error": "failed"}
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.coalesce(F.create_map(*(F.lit(x) for p in names.items() for x in p))[F.col("event_type")], F.lit("other")).alias("status"))
    return relational.run_counters(e)


@plan("SELECT event_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 30 MINUTE")
def stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("status", F.col("event_type"))
    return relational.stale(e, "ts", "error", 30, F.lit("2024-01-02 00:00:00").cast("timestamp")).select("event_id")


@plan("""WITH p AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS site FROM pages WHERE regexp_matches(lower(url), '^https?://') AND trim(html) <> '')
SELECT url, site, CASE WHEN page_id % 2 = 0 THEN 'Page ' || page_id ELSE site END AS title, md5(trim(html)) AS text_md5, CASE WHEN page_id % 3 < 2 THEN DATE '2024-05-01' END AS published FROM p WHERE site NOT LIKE '%.example.net' QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1""")
def web_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    rows = p.select(F.col("page_id").alias("position"), "url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" Page "), F.col("page_id").cast("string"))).otherwise("").alias("title"), F.col("html").alias("text"), F.element_at(F.array(F.lit("2024-05-01"), F.lit("1 May 2024 10:00:00"), F.lit("soon")), (F.col("page_id") % 3 + 1).cast("int")).alias("date"))
    host = F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), r"^www\.", "")
    excluded = p.select(host.alias("host")).filter(F.col("host").endswith(".example.net")).distinct()
    return files.clean_web_results(rows, excluded).select("url", "site", "title", F.md5("text").alias("text_md5"), "published")


@plan("""WITH r AS (SELECT l_suppkey AS query_id, (l_partkey % 9)::VARCHAR AS law, (l_linenumber * 100)::VARCHAR AS article, l_orderkey % 5 AS part FROM lineitem), k AS (SELECT * FROM r WHERE NOT (law = '3' AND article = '300') AND NOT (query_id % 2 = 0 AND law = '1' AND article = '100'))
SELECT * FROM (SELECT query_id, law, article, count(*) AS n, min(part) AS first_part FROM k GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first_part, law, article) <= 4""")
def most_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_partkey") % 9).cast("string").alias("law"), (F.col("l_linenumber") * 100).cast("string").alias("article"), (F.col("l_orderkey") % 5).alias("part"))
    covered = refs.filter("query_id % 2 = 0 and law = '1' and article = '100'").select("query_id", "law", "article").distinct()
    return citations.most_cited(refs, covered, refs.filter("law = '3' and article = '300'").select("law", "article").distinct())


@plan("""SELECT c_custkey, coalesce(n_name, c_name) AS c_name, c_acctbal, 'a=' || CASE WHEN n_name IS NULL THEN c_name ELSE n_name END || ',b=' || c_custkey || CASE WHEN n_name IS NULL THEN '' ELSE ',c=new' END AS facts FROM customer LEFT JOIN nation ON n_nationkey = c_custkey""")
def merge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = F.create_map(F.lit("a"), F.col("c_name"), F.lit("b"), F.col("c_custkey").cast("string"))
    stored = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", facts.alias("facts"))
    target = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("c_custkey"), F.col("n_name").alias("c_name"), F.create_map(F.lit("a"), F.col("n_name"), F.lit("c"), F.lit("new")).alias("facts"))
    merged = relational.merge_metadata(stored, target, ["c_custkey"], ["facts"])
    entries = F.array_sort(F.transform(F.map_entries("facts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return merged.withColumn("facts", F.array_join(entries, ","))


@plan("""SELECT doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')""")
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.missing(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").filter("lang = 'en'"), ["doc_id"])


@plan("""SELECT l_orderkey, list_aggregate(list_sort(list_distinct(list(CASE WHEN l_quantity > 25 THEN l_linenumber END))), 'string_agg', ',') AS labels FROM lineitem GROUP BY l_orderkey""")
def article_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.article_labels(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", F.col("l_quantity") > 25)
    return found.select("l_orderkey", F.when(F.size("article_labels") > 0, F.array_join(F.col("article_labels").cast("array<string>"), ",")).alias("labels"))


@plan()
def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers: each sentence is a claim on the user turn before it."""
    turns = table(spark, sf_dir, "conversations")
    answers = turns.filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), F.array(F.struct(F.lit("text").alias("kind"), F.transform(F.split("text", r"(?<=\.)\s+"), lambda s: F.struct(s.alias("text"), F.array(F.concat_ws("-", "conv_id", (F.col("turn") - 1).cast("string"))).alias("source_ids"))).alias("sentences"))).alias("blocks"))
    passages = turns.select(F.concat_ws("-", "conv_id", "turn").alias("source_id"), F.col("text").alias("passage"))
    allowed = answers.select("answer_id", F.explode(F.array_distinct(F.flatten(F.transform(F.flatten("blocks.sentences"), lambda s: s["source_ids"])))).alias("source_id"))
    pairs = citations.claim_pairs(answers, allowed)
    return citations.apply_support(pairs, citations.assess_support(pairs, passages))
