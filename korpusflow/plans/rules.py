"""Registered plans of rules over text, law, evidence and versions: each takes values of the given tables through one or
more operators, and its SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpusflow.functions import text
from korpusflow.operators import citations, corpus, court, evaluate, events, lawrefs, pack, relational, search, segment, temporal
from korpusflow.plans.common import dealt, table
from korpusflow.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def plan(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))


def shown(day: str = "day", form: str = "d/M/yyyy"):
    return F.date_format(day, form)


@plan("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'amended' WHEN 1 THEN 'repealed' WHEN 2 THEN 'added' ELSE 'annulled' END AS event_type, CASE o_orderkey % 4 WHEN 2 THEN 'paragraph' WHEN 3 THEN 'sentence' ELSE 'unit' END AS target_type,
CASE WHEN o_orderkey % 4 < 3 THEN (1000 + o_custkey % 9000)::VARCHAR END AS source_law_number, CASE WHEN o_orderkey % 4 < 3 THEN (1 + o_orderkey % 60)::VARCHAR END AS source_law_article, CASE WHEN o_orderkey % 4 = 3 THEN '2010/' || o_orderkey END AS case_number,
o_orderdate::DATE AS event_date, CASE WHEN o_orderkey % 4 = 3 THEN (o_orderdate::DATE + INTERVAL 5 DAY + INTERVAL 9 MONTH)::DATE END AS effective_from, 'article:2' AS legal_unit_key, 0.9 AS confidence FROM orders""")
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes under an article for each order: amended, repealed, added and annulled with a delay."""
    o, key = dealt(orders(spark, sf_dir)), F.col("o_orderkey")
    source = F.concat(shown(), F.lit("-"), (1000 + F.col("o_custkey") % 9000).cast("string"), F.lit("/"), (1 + key % 60).cast("string"), F.lit(" md.)"))
    ruling = F.concat(F.lit("Anayasa Mahkemesinin "), shown(), F.lit(" tarihli ve E: 2010/"), key.cast("string"), F.lit(", K: 2011/7 sayılı kararı ile bu cümle iptal edilmiştir. Bu Karar Resmî Gazete'de yayımlandığı "), F.date_format(F.date_add("day", 5), "d/M/yyyy"), F.lit(" tarihinden dokuz ay sonra yürürlüğe girer."))
    note = F.when(key % 4 == 0, F.concat(F.lit("(Değişik: "), source)).when(key % 4 == 1, F.concat(F.lit("(Mülga: "), source)).when(key % 4 == 2, F.concat(F.lit("(Ek fıkra: "), source)).otherwise(ruling)
    docs = o.select(key.cast("string").alias("document_id"), F.concat(F.lit("MADDE 1 - Amaç.\nMADDE 2 - Kapsam. "), note, F.lit("\nMADDE 3 - Son.")).alias("text"))
    found = events.extract_events(docs, segment.units(docs))
    return found.select(F.col("document_id").cast("long").alias("o_orderkey"), "event_type", "target_type", "source_law_number", "source_law_article", "case_number", "event_date", "effective_from", "legal_unit_key", "confidence")


@plan("""SELECT o_custkey % 100 AS law, o_orderkey % 9 AS article, count(*) AS n, max(o_orderdate::DATE) AS newest FROM orders WHERE o_orderkey % 9 IN (1, 2) GROUP BY 1, 2""")
def article_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the first and second article of each law: a law for each hundredth customer, an event for each order."""
    o = orders(spark, sf_dir).withColumn("law", F.col("o_custkey") % 100).withColumn("article", F.col("o_orderkey") % 9)
    titles = o.select(F.col("law").cast("string").alias("document_id"), F.concat((1000 + F.col("law")).cast("string"), F.lit(" sayılı Kanun")).alias("title")).distinct()
    key = F.concat(F.lit("article:"), F.col("article").cast("string"))
    units = o.select(F.col("law").cast("string").alias("document_id"), key.alias("unit_key"), F.array(key).alias("unit_path")).distinct()
    changes = o.select(F.col("law").cast("string").alias("document_id"), key.alias("legal_unit_key"), F.col("day").alias("event_date"), "o_orderkey")
    refs = o.select((1000 + F.col("law")).cast("string").alias("law"), F.col("article").cast("string").alias("article"), key.alias("unit")).distinct().filter("article in ('1', '2')")
    found = events.article_changes(titles, units, changes, refs)
    return found.groupBy((F.col("law").cast("long") - 1000).alias("law"), F.col("article").cast("long").alias("article")).agg(F.count(F.lit(1)).alias("n"), F.max("event_date").alias("newest"))


@plan("""SELECT o_orderkey, (1 + o_custkey % 20) || '. Hukuk Dairesi' AS chamber, year(o_orderdate) || '/' || o_orderkey AS case_number, CASE WHEN o_orderkey % 3 = 0 THEN '1999/1' ELSE year(o_orderdate) || '/7-' || o_custkey END AS decision_number,
(o_orderdate::DATE + INTERVAL 30 DAY)::DATE AS document_date, o_orderkey % 5 = 0 AS conflict FROM orders""")
def court_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and outcome of a decision for each order; one in three leaves its number to what was supplied, one in five
    was supplied with another case number."""
    o, key = orders(spark, sf_dir), F.col("o_orderkey")
    case = F.concat(F.year("day").cast("string"), F.lit("/"), key.cast("string"))
    number = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("Karar No : "), F.year("day").cast("string"), F.lit("/7-"), F.col("o_custkey").cast("string"), F.lit("\n")))
    body = F.concat(F.lit("T.C.\nYARGITAY\n KARAR \n"), (1 + F.col("o_custkey") % 20).cast("string"), F.lit(" .  HUKUK DAİRESİ\nEsas No: "), case, F.lit("\n"), number, F.lit("Dava "), shown(form="dd.MM.yyyy"), F.lit(" tarihinde açıldı. "), F.date_format(F.date_add("day", 30), "dd.MM.yyyy"), F.lit(" gününde oybirliğiyle karar verildi."))
    none = F.lit(None).cast("string")
    docs = o.select(key.alias("document_id"), body.alias("text"), none.alias("authority"), none.alias("chamber"), F.when(key % 5 == 0, "1/1").otherwise(case).alias("case_number"), F.when(key % 3 == 0, "1999/1").alias("decision_number"), none.alias("document_date"), F.lit(True).alias("complete"))
    found = court.court_metadata(docs)
    bad = court.metadata_conflicts(found, docs).select("document_id", F.lit(True).alias("conflict")).distinct()
    return found.join(bad, "document_id", "left").select(F.col("document_id").alias("o_orderkey"), "chamber", "case_number", "decision_number", "document_date", F.coalesce("conflict", F.lit(False)).alias("conflict"))


@plan("""WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)
SELECT o_custkey, unit_key, text_md5, eligible FROM (
SELECT o_custkey, 'chapter:BİRİNCİ/section:' || n AS unit_key, md5('§ ' || n || '. Sipariş ' || o_orderkey || chr(10) || 'a) ilk' || chr(10) || 'metin') AS text_md5, true AS eligible FROM a
UNION ALL SELECT o_custkey, 'chapter:BİRİNCİ/section:' || n || '/item:a', md5('a) ilk' || chr(10) || 'metin'), true FROM a
UNION ALL SELECT DISTINCT o_custkey, 'metadata:bibliography', md5('YARARLANILAN KAYNAKLAR' || chr(10) || 'A. Yazar'), false FROM a
UNION ALL SELECT o_custkey, 'chapter:BİRİNCİ', md5('BİRİNCİ BÖLÜM' || chr(10) || 'GENEL' || chr(10) || string_agg('§ ' || n || '. Sipariş ' || o_orderkey || chr(10) || 'a) ilk' || chr(10) || 'metin', chr(10) ORDER BY n)), true FROM a GROUP BY o_custkey)""")
def book_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each customer, with a topic and an item for each order."""
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    body = F.concat(F.lit("§ "), F.col("n").cast("string"), F.lit(". Sipariş "), F.col("o_orderkey").cast("string"), F.lit("\na) ilk\nmetin"))
    topics = orders(spark, sf_dir).withColumn("n", number).select("o_custkey", "n", body.alias("text"))
    docs = relational.document_text(topics, "o_custkey", "n").select(F.col("o_custkey").alias("document_id"), F.concat(F.lit("BİRİNCİ BÖLÜM\nGENEL\n"), "body", F.lit("\nYARARLANILAN KAYNAKLAR\nA. Yazar")).alias("text"))
    return segment.doctrine_units(docs).select(F.col("document_id").cast("long").alias("o_custkey"), "unit_key", F.md5("text").alias("text_md5"), F.col("retrieval_eligible").alias("eligible"))


@plan("""WITH t AS (SELECT conv_id, turn, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN length(s) <= 40 THEN s ELSE rtrim(left(s, 39)) || '…' END AS clipped, left(regexp_replace(text, '[^a-zA-Z0-9_-]+', '_', 'g'), 255) AS index_name, greatest(1, (length(text) + 1) // 2) AS cost,
trim(regexp_replace(translate(regexp_replace(text, '\\.[A-Za-z0-9]{1,5}$', ''), '_-', '  '), '\\s+', ' ', 'g')) AS display, CASE WHEN trim(text) = '' THEN 'empty' ELSE 'ok' END AS status, length(regexp_replace(text, '\\P{L}', '', 'g')) AS letters FROM t""")
def small_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short renderings of each turn: clipped, as an index name, its cost, as a title, its state and its letters."""
    c = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clip(c, 40).alias("clipped"), text.index_name(c).alias("index_name"), text.token_cost(c).cast("long").alias("cost"), text.display_title(c).alias("display"), text.text_status(c).alias("status"), text.readable_letters(c).cast("long").alias("letters"))


@plan("""SELECT conv_id, turn, CASE WHEN length(s) <= 120 THEN s ELSE q END AS query FROM (SELECT conv_id, turn, s, coalesce(q, left(s, 120)) AS q FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM conversations) LEFT JOIN (
WITH RECURSIVE p AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\s'), lambda w: w <> '')) AS w, generate_subscripts(list_filter(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\s'), lambda w: w <> ''), 1) AS i FROM conversations),
b AS (SELECT *, coalesce(sum(CASE WHEN right(w, 1) IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM p),
z AS (SELECT conv_id, turn, no, string_agg(w, ' ' ORDER BY i) AS t FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY contains(t, '?') DESC, list_sum(list_transform(['alacak','arabulucu','fesih','ihbar','işçi','işveren','işe iade','kanun','kıdem','madde','sözleşme','tazminat','ücret','yargıtay','zamanaşımı'], lambda k: contains(lower(t), k)::INT)) DESC, no DESC) AS k FROM z),
f AS (SELECT conv_id, turn, k, no, t, length(t) <= 120 AS keep, CASE WHEN length(t) <= 120 THEN length(t) ELSE 0 END AS used FROM r WHERE k = 1
UNION ALL SELECT r.conv_id, r.turn, r.k, r.no, r.t, f.used + length(r.t) + (f.used > 0)::INT <= 120, CASE WHEN f.used + length(r.t) + (f.used > 0)::INT <= 120 THEN f.used + length(r.t) + (f.used > 0)::INT ELSE f.used END FROM f JOIN r ON r.conv_id = f.conv_id AND r.turn = f.turn AND r.k = f.k + 1)
SELECT conv_id, turn, nullif(string_agg(t, ' ' ORDER BY no) FILTER (keep), '') AS q FROM f GROUP BY ALL HAVING length(coalesce(string_agg(t, ' ' ORDER BY no) FILTER (keep), '')) >= 3) USING (conv_id, turn))""")
def condensed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a search query of at most 120 characters."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.condense(F.col("text"), 120).alias("query"))


@plan("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN 'Ek' || n WHEN 1 THEN n::VARCHAR WHEN 2 THEN 'Geçici' || n ELSE n || '/B' END AS label, CASE l_linenumber % 4 WHEN 0 THEN 'additional_article:' || n WHEN 1 THEN 'article:' || n WHEN 2 THEN 'temporary_article:' || n ELSE 'article:' || n || '/B' END AS unit,
CASE l_linenumber % 4 WHEN 0 THEN 'ek m.' || n WHEN 1 THEN 'm.' || n WHEN 2 THEN 'geçici m.' || n ELSE 'm.' || n || '/B' END || ', ' || l_linenumber || '. fıkra' AS provision, len(range(n, n + l_linenumber + 1)) AS in_range, 's. ' || n || '–' || (n + l_linenumber) AS place
FROM (SELECT *, 1 + l_partkey % 300 AS n FROM lineitem)""")
def article_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as people write them for each order line: label, unit, provision, range and place."""
    n, k = 1 + F.col("l_partkey") % 300, F.col("l_linenumber")
    number = n.cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("Ek madde "), number)).when(k % 4 == 1, F.concat(F.lit("m. "), number)).when(k % 4 == 2, F.concat(F.lit("GEÇİCİ "), number, F.lit(". maddesi"))).otherwise(F.concat(F.lit("Madde "), number, F.lit("/b")))
    label = text.article_label(raw)
    path = F.array(F.lit("chapter:II"), text.article_unit(label), F.concat(F.lit("paragraph:"), k.cast("string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", label.alias("label"), text.article_unit(label).alias("unit"), text.provision_label(path).alias("provision"), F.size(text.article_range(n, n + k)).cast("long").alias("in_range"), text.location_label(n, n + k, F.lit(None), F.lit(None)).alias("place"))


@plan("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate::DATE END AS parsed, list_sort(list_distinct([(1000 + o_custkey % 9000)::VARCHAR, '4857'])) AS laws, CASE WHEN o_custkey % 2 = 0 THEN (1000 + o_custkey % 9000)::VARCHAR END AS number, o_orderkey % 3 <> 0 AS fact FROM orders""")
def order_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in three forms and one that is none, laws named in a sentence, a law's number in a title, and legal facts."""
    key, law = F.col("o_orderkey"), (1000 + F.col("o_custkey") % 9000).cast("string")
    day = F.when(key % 4 == 0, shown(form="yyyy-MM-dd")).when(key % 4 == 1, shown(form="d.M.yyyy")).when(key % 4 == 2, shown()).otherwise("31.02.2020")
    title = F.when(F.col("o_custkey") % 2 == 0, F.concat(law, F.lit(" sayılı Kanun"))).otherwise("Karar")
    fact = F.when(key % 3 == 0, "Merhaba, teşekkürler").when(key % 3 == 1, F.concat(F.lit("Süre "), key.cast("string"), F.lit(" gündür"))).otherwise("4857 sayılı")
    return orders(spark, sf_dir).select("o_orderkey", text.parse_date(day).alias("parsed"), F.array_sort(F.array_distinct(text.related_laws(F.concat(law, F.lit(" Sayılı Kanun")), F.array(F.lit("4857"))))).alias("laws"), text.law_number(F.lit("karar"), title).alias("number"), text.states_legal_fact(fact).alias("fact"))


@plan("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 + o_orderkey % 12 END AS paragraph, list_sort(list_distinct([(1 + o_orderkey % 90)::VARCHAR, (1 + o_custkey % 90)::VARCHAR])) AS articles FROM orders""")
def mentioned_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of whatever law in a sentence for each order, and the paragraph that an amendment note names."""
    o, key = orders(spark, sf_dir), F.col("o_orderkey")
    words = "birinci ikinci üçüncü dördüncü beşinci altıncı yedinci sekizinci dokuzuncu onuncu onbirinci".split() + ["on ikinci"]
    note = F.when(key % 2 == 0, F.concat(F.lit("Değişik "), F.element_at(F.array(*map(F.lit, words)), (1 + key % 12).cast("int")), F.lit(" fıkra: 1/1/2001"))).otherwise("Ek fıkra: 1/1/2001")
    sentence = F.concat(F.lit("Kanun'un "), (1 + key % 90).cast("string"), F.lit("., "), (1 + F.col("o_custkey") % 90).cast("string"), F.lit(". maddeleri"))
    found = lawrefs.mentioned_articles(o.select(key.alias("id"), sentence.alias("text")))
    notes = o.select(key.cast("string").alias("id"), lawrefs.annotation_paragraph(note).cast("long").alias("paragraph"))
    return notes.join(found, "id").select(F.col("id").cast("long").alias("o_orderkey"), "paragraph", "articles")


@plan("""WITH d AS (SELECT doc_id, text, sha256(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(translate(text, '­', ''), '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[\\t\\x0B\\f  ]+', ' ', 'g'))), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS h,
length(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(translate(text, '­', ''), '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[\\t\\x0B\\f  ]+', ' ', 'g'))), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS n FROM documents)
SELECT doc_id, CASE WHEN n < 40 THEN 'failed' WHEN doc_id::VARCHAR = min(doc_id::VARCHAR) FILTER (n >= 40) OVER (PARTITION BY h) THEN 'imported' ELSE 'duplicate' END AS status FROM d""")
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one ingest run does with each document: short ones are refused, contents that come twice are imported once."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    none = docs.select(F.sha2("text", 256).alias("content_hash")).filter("false")
    return corpus.ingest(docs, none, "run-1")["outcomes"].select(F.col("document_id").cast("long").alias("doc_id"), "status")


@plan("""WITH c AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN (4000 + doc_id % 7)::VARCHAR END AS law, doc_id % 40 AS art, lang, source FROM documents),
r AS (SELECT item_id AS query_id, 4000 + item_id % 7 AS l, item_id % 30 AS lo FROM benchmark)
SELECT query_id, chunk_id, max(g) AS grade FROM (SELECT query_id, chunk_id, CASE WHEN art BETWEEN lo AND lo + 5 THEN 2 ELSE 0 END AS g FROM r JOIN c ON c.law = r.l::VARCHAR UNION ALL SELECT query_id, chunk_id, 1 FROM r JOIN c ON c.source = 'src' || (query_id % 20)) WHERE g > 0 GROUP BY ALL""")
def reference_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of documents for expected references: an article range of a law, and an authority."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 3 == 0, (4000 + F.col("doc_id") % 7).cast("string")).alias("primary_legislation_number"), F.array((F.col("doc_id") % 40).cast("string")).alias("article_labels"), F.col("lang").alias("title"), F.col("source").alias("authority"), F.lit("law").alias("document_type"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 30).alias("lo"))
    refs = q.select("query_id", F.explode(F.array(F.concat((4000 + F.col("query_id") % 7).cast("string"), F.lit(":"), F.col("lo").cast("string"), F.lit("-"), (F.col("lo") + 5).cast("string")), F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))).alias("ref"))
    return evaluate.reference_grade(refs, rows).select("query_id", "chunk_id", F.col("grade").cast("long"))


@plan("""WITH q AS (SELECT conv_id AS query_id, min(turn) AS position, conv_id % 5 AS topic FROM conversations GROUP BY conv_id)
SELECT query_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY position, query_id) AS n FROM (SELECT query_id, query_id AS position, topic FROM q WHERE query_id % 4 <> 0)) WHERE n <= 6""")
def question_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six conversations of each topic whose references name an article."""
    q = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id")).distinct().withColumn("position", F.col("query_id")).withColumn("topic", F.col("query_id") % 5)
    refs = F.array(F.lit("Yargıtay"), F.when(F.col("query_id") % 4 == 0, F.lit("4857")).otherwise(F.concat(F.lit("4857:"), F.col("query_id").cast("string"))))
    return evaluate.select_questions(q.withColumn("expected_refs", refs)).select("query_id", "topic")


@plan("""WITH r AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant, value AS seconds, event_id % 7 AS cited, least(event_id % 5, event_id % 7) AS verified, event_type = 'error' AS fallback FROM events)
SELECT variant, count(*) AS questions, round(avg(seconds), 3) AS mean_seconds, sum(cited)::BIGINT AS cited, sum(verified)::BIGINT AS verified, round(sum(verified) / nullif(sum(cited), 0), 3) AS verified_share, count(*) FILTER (fallback) AS fallbacks FROM r GROUP BY variant""")
def answer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("variant"), F.col("value").alias("seconds"), (F.col("event_id") % 7).alias("cited"), F.least(F.col("event_id") % 5, F.col("event_id") % 7).alias("verified"), (F.col("event_type") == "error").alias("fallback"))
    return evaluate.answer_summary(rows)


@plan("""SELECT event_type, count(*) AS n FROM events GROUP BY event_type""")
def event_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.histogram(table(spark, sf_dir, "events"), "event_type")


@plan("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'ready' END AS status, ts FROM events)
SELECT event_id, CASE WHEN status = 'ready' AND row_number() OVER (PARTITION BY user_id, status ORDER BY ts DESC, event_id DESC) > 1 THEN 'superseded' ELSE status END AS status FROM e""")
def superseded_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's ready events, as parses of a document, the newest stays ready."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("parse_id"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("ready").alias("status"), F.col("ts").alias("created_at"))
    return corpus.supersede(e).select(F.col("parse_id").alias("event_id"), "status")


@plan("""SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'published' WHEN c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 7) AND c_custkey % 2 = 0 THEN 'retired' WHEN c_custkey % 2 = 0 THEN 'published' ELSE 'draft' END AS status, CASE WHEN c_custkey = 7 THEN DATE '2024-05-06' END AS published FROM customer""")
def published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishing one version retires the published ones of its domain (a nation's customers)."""
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("corpus_version"), F.col("c_nationkey").alias("domain_code"), F.when(F.col("c_custkey") % 2 == 0, "published").otherwise("draft").alias("status"), F.lit(None).cast("date").alias("published_at"))
    return corpus.publish(v, 7, F.lit("2024-05-06").cast("date")).select(F.col("corpus_version").alias("c_custkey"), "status", F.col("published_at").alias("published"))


@plan("""SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' AND o_orderstatus IN ('F', 'O') AND (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')""")
def filtered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership, a date range and an array overlap as one filter."""
    import datetime

    rows = orders(spark, sf_dir).withColumn("levels", F.array(F.substring("o_orderpriority", 1, 1)))
    wanted = search.matches({"o_orderstatus": ["F", "O"], "day": (datetime.date(1995, 1, 1), datetime.date(1996, 6, 30)), "levels": {"any": ["1", "2"]}})
    return rows.filter(wanted).select("o_orderkey", "day")


@plan("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 4 <> 3 AND (o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND (o_orderkey % 50 BETWEEN 10 AND 20 OR o_orderkey % 50 = 33)))""")
def scoped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a domain and version whose role admits them: whole documents, listed provisions, or none."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("domain_code"), F.when(F.col("o_custkey") % 4 == 3, "v2").otherwise("v1").alias("corpus_version"), F.concat(F.lit("r"), (key % 3).cast("string")).alias("domain_role"), (key % 50).cast("string").alias("label"), F.lit(True).alias("retrieval_eligible"))
    rules = spark.createDataFrame([("r0", "full_document", None), ("r1", "provision_allowlist", ["10-20", "33"]), ("r2", "excluded", ["*"])], "domain_role string, rule string, entries array<string>")
    return search.in_scope(rows, rules, "O", "v1").select("o_orderkey", "o_custkey")


@plan("""SELECT page_id, regexp_full_match(url, '(?i)https?://[^\\s/]+.*') AS safe FROM pages""")
def safe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", files.safe_url(F.col("url")).alias("safe"))


@plan("""WITH f AS (SELECT o_orderkey AS file_id, o_custkey % 20 AS w, o_custkey % 7 AS talk, o_custkey % 11 AS kase, o_orderstatus FROM orders), s AS (SELECT c_custkey AS query_id, c_custkey % 20 AS w, c_custkey % 7 AS talk, c_custkey % 11 AS kase FROM customer WHERE c_custkey % 50 = 0)
SELECT query_id, count(*) AS files FROM s JOIN f ON f.w = s.w AND f.o_orderstatus = 'O' AND (f.talk = s.talk OR f.kase = s.kase) GROUP BY query_id""")
def visible_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that each fiftieth customer sees: of its workspace, and of its conversation or its case."""
    key = F.col("o_custkey")
    owned = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), (key % 20).alias("workspace_id"), (key % 7).alias("conversation_id"), (key % 11).alias("case_id"), F.when(F.col("o_orderstatus") == "O", "ready").otherwise("pending").alias("status"))
    me = F.col("c_custkey")
    scopes = table(spark, sf_dir, "customer").filter("c_custkey % 50 = 0").select(me.alias("query_id"), (me % 20).alias("workspace_id"), (me % 7).alias("conversation_id"), (me % 11).alias("case_id"))
    return search.visible_counts(owned, scopes)


@plan("""WITH RECURSIVE c AS (SELECT l_suppkey AS q, (l_orderkey * 10 + l_linenumber)::VARCHAR AS id, l_linenumber % 3 AS part, l_partkey % 9 + 1 AS rank, (l_quantity * 10)::BIGINT AS cost, l_returnflag = 'R' AS is_file, CASE WHEN l_returnflag = 'R' THEN 3000 ELSE 9000 END AS budget
FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1),
i AS (SELECT *, row_number() OVER (PARTITION BY q, is_file ORDER BY rank, part, id) AS n FROM c),
k AS (SELECT q, is_file, n, cost, cost <= budget AS kept, CASE WHEN cost <= budget THEN cost ELSE 0 END AS used FROM i WHERE n = 1
UNION ALL SELECT i.q, i.is_file, i.n, i.cost, used + i.cost <= budget, used + CASE WHEN used + i.cost <= budget THEN i.cost ELSE 0 END FROM k JOIN i ON i.q = k.q AND i.is_file = k.is_file AND i.n = k.n + 1)
SELECT q AS query_id, count(*) AS offered, sum(cost)::BIGINT AS cost FROM k WHERE kept GROUP BY q""")
def offered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two budgets leave of each supplier's lines, files apart, in the order of rank and part: an item that does not
    fit is passed over, smaller ones after it may fit."""
    once = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey", "l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").withColumn("times", once).filter("times = 1")  # ids are to be unique
    c = rows.select(
        F.col("l_suppkey").alias("query_id"), F.when(F.col("l_returnflag") == "R", "file").otherwise("law").alias("channel"), (F.col("l_linenumber") % 3).alias("part"), (F.col("l_partkey") % 9 + 1).alias("rank"),
        F.col("l_orderkey").alias("source_no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("id"), (F.col("l_quantity") * 10).cast("long").alias("cost"),
    )
    kept = pack.pack_parts(c, 9000, 3000)
    return kept.join(c.select("query_id", "id", "cost"), ["query_id", "id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("offered"), F.sum("cost").alias("cost"))


@plan("""WITH c AS (SELECT conv_id AS answer_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role FROM conversations WHERE trim(text) <> '')
SELECT answer_id, 'S' || n AS claim_id, CASE WHEN role = 'user' THEN NULL WHEN turn % 3 = 2 THEN NULL ELSE 's' || (turn % 3) END AS source_id FROM c""")
def claims_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as claims: the user's are headings, others cite a source by turn, of which one is unknown."""
    t = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "heading").otherwise("text")
    sentence = F.struct(F.col("text").alias("text"), F.array(F.concat(F.lit("s"), (F.col("turn") % 3).cast("string"))).alias("source_ids"))
    blocks = t.groupBy(F.col("conv_id").cast("string").alias("answer_id")).agg(F.array_sort(F.collect_list(F.struct("turn", kind.alias("kind"), F.array(sentence).alias("sentences")))).alias("b"))
    answers = blocks.select("answer_id", F.transform("b", lambda x: F.struct(x["kind"].alias("kind"), x["sentences"].alias("sentences"))).alias("blocks"))
    allowed = blocks.select("answer_id", F.explode(F.array(F.lit("s0"), F.lit("s1"))).alias("source_id"))
    return citations.claim_pairs(answers, allowed).select(F.col("answer_id").cast("long").alias("answer_id"), "claim_id", "source_id")


@plan("""SELECT conv_id AS answer_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations WHERE text <> '' GROUP BY conv_id""")
def rendered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    sentence = F.struct(F.col("text").alias("text"))
    blocks = t.groupBy(F.col("conv_id").alias("answer_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.array(sentence).alias("sentences")))).alias("blocks"))
    return citations.render(blocks).filter("body <> ''")


@plan("""WITH e AS (SELECT conv_id AS query_id, turn AS position, CASE WHEN turn % 2 = 0 THEN 'changed_after' ELSE 'near_change' END AS level, DATE '2020-01-01' + turn::INT AS d FROM conversations),
f AS (SELECT query_id, 'Kanun ' || (position % 3) || ' ' || position || ' 2020 değişiklik' AS text, row_number() OVER (PARTITION BY query_id ORDER BY position) AS n FROM e WHERE level = 'changed_after') SELECT query_id, text FROM f WHERE n <= 2""")
def amendment_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web queries for the first two firm findings of each conversation."""
    t = F.col("turn")
    checks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), t.alias("position"), F.when(t % 2 == 0, "changed_after").otherwise("near_change").alias("level"), F.concat(F.lit("Kanun "), (t % 3).cast("string")).alias("law_title"), t.cast("string").alias("article"), F.date_add(F.lit("2020-01-01").cast("date"), (t % 300).cast("int")).alias("change_date"))
    return temporal.amendment_queries(checks)


@plan("""SELECT c_nationkey AS source_id, min(o_orderdate::DATE) AS date, min_by('o' || o_orderkey, (o_orderdate::DATE, 'o' || o_orderkey)) AS label FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey""")
def earliest_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest order of each nation's customers, as the date of the issues that use a source."""
    use = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("issue_id"), F.col("c_nationkey").alias("source_id"))
    days = orders(spark, sf_dir).select(F.col("o_custkey").alias("issue_id"), F.col("day").alias("date"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("label"))
    return temporal.earliest_dates(use, days)


@plan("""WITH d AS (SELECT o_orderkey AS id, o_custkey % 40 AS query_id, 'K' || (o_orderkey % 6) AS title, 'm.' || (o_orderkey % 9) AS provision, o_orderdate::DATE AS change_date FROM orders), c AS (SELECT s_suppkey AS query_id, DATE '1996-01-01' + (s_suppkey % 100)::INT AS case_date FROM supplier WHERE s_suppkey < 40 AND s_suppkey % 3 <> 0),
j AS (SELECT d.query_id, title, provision FROM d LEFT JOIN c USING (query_id) WHERE case_date IS NULL OR change_date <= case_date), g AS (SELECT query_id, title, list_sort(list(DISTINCT provision)) AS p FROM j GROUP BY ALL)
SELECT query_id, title, 'decision_outdated' AS level, array_to_string(p[1:3], ', ') || CASE WHEN len(p) > 3 THEN ' +' || (len(p) - 3) ELSE '' END AS provisions FROM g""")
def outdated_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that rest on provisions changed since, up to the case's day: the first three named, the rest counted."""
    o = orders(spark, sf_dir)
    decisions = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("query_id"), F.concat(F.lit("K"), (F.col("o_orderkey") % 6).cast("string")).alias("title"))
    after = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("m."), (F.col("o_orderkey") % 9).cast("string")).alias("provision"), F.col("day").alias("change_date"))
    dates = table(spark, sf_dir, "supplier").filter("s_suppkey < 40 and s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("query_id"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("s_suppkey") % 100).cast("int")).alias("case_date"))
    return temporal.decision_checks(decisions, after, dates)


@plan("""SELECT o_orderkey AS id, (o_orderdate::DATE + INTERVAL 1 DAY)::DATE AS date FROM orders WHERE o_orderkey % 2 = 0""")
def grounded_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed days, of which every second one stands in the text."""
    o = orders(spark, sf_dir)
    texts = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Tebliğ "), F.date_format(F.when(F.col("o_orderkey") % 2 == 0, F.date_add("day", 1)).otherwise(F.date_add("day", 2)), "dd.MM.yyyy"), F.lit(" günü yapıldı.")).alias("text"))
    return temporal.ground_dates(o.select(F.col("o_orderkey").alias("id"), F.date_add("day", 1).alias("date")), texts)


@plan("""SELECT o_orderkey AS deadline_id, 's' || o_orderkey AS source_id FROM orders WHERE o_orderkey % 3 <> 0""")
def stating_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that state a period in digits or words; every third states another unit."""
    key = F.col("o_orderkey")
    words = F.element_at(F.array(*map(F.lit, ("bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz", "on", "on bir", "oniki"))), (1 + key % 12).cast("int"))
    number = F.when(key % 2 == 0, words).otherwise((1 + key % 12).cast("string"))
    body = F.concat(F.lit("Dava "), number, F.when(key % 3 == 0, " hafta").otherwise(" aylık"), F.lit(" süre içinde açılır."))
    passages = table(spark, sf_dir, "orders").select(key.alias("issue_id"), F.concat(F.lit("s"), key.cast("string")).alias("source_id"), body.alias("text"))
    deadlines = table(spark, sf_dir, "orders").select(key.alias("issue_id"), key.alias("deadline_id"), (1 + key % 12).cast("int").alias("amount"), F.lit("ay").alias("unit"))
    return temporal.stating_passages(deadlines, passages)


@plan("""SELECT doc_id, md5(lower(translate(text, 'Iİ', 'ıi'))) AS m FROM documents""")
def turkish_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.turkish_lower(F.col("text"))).alias("m"))


@plan("""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(source), '[^0-9a-z]+', '-', 'g'), '^-+|-+$', '', 'g')) || '/' || lower(lang) || '--' || left(sha256(text), 12) || '.txt' AS path, left(sha256(source || ':' || sha256(text) || ':v1'), 16) AS version FROM documents""")
def storage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from korpusflow.functions.vectors import index_version

    sha = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", text.storage_path(F.col("source"), F.col("lang"), sha, F.lit(".txt")).alias("path"), index_version(F.col("source"), sha, F.lit("v1")).alias("version"))


@plan("""SELECT lang AS channel, doc_id::VARCHAR AS source_id, sha256(text) AS content_hash, md5(text) AS text_md5, NULL::VARCHAR AS title, NULL::VARCHAR AS page_start FROM documents""")
def evidence_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in the one shape of evidence, its language as channel."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text", "lang", F.sha2("text", 256).alias("content_hash"))
    return citations.snapshot(d, F.col("lang")).select("channel", "source_id", "content_hash", F.md5("text").alias("text_md5"), "title", "page_start")
