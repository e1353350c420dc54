"""Registered plans of tokens, indexes, ranking, fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpusflow.functions.text import lexical_tokens
from korpusflow.functions.vectors import hash_embed
from korpusflow.operators import evaluate as ev
from korpusflow.operators import relational as rel
from korpusflow.operators import ann, search
from korpusflow.plans.common import chunks, questions, sql_bm25, sql_stems, sql_top, table, vectors
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


@plan(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {sql_stems('text')} AS t FROM documents)")
def tokenize_prefix5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("t", lexical_tokens(F.col("text"), "prefix5"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@plan(f"WITH {sql_bm25()} SELECT query_id, chunk_id, score, rank FROM ({sql_top('bm25', 10)})")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_search(questions(spark, sf_dir), chunks(spark, sf_dir), 10).select("query_id", "chunk_id", "score", F.col("rank").cast("long"))


@plan(f"""WITH {sql_bm25(True, "lang IN ('en', 'de')")} SELECT query_id, chunk_id, score, rank FROM ({sql_top('bm25', 10)})""")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.bm25_search(questions(spark, sf_dir), chunks(spark, sf_dir), 10, "prefix5", {"lang": ["en", "de"]})
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("long"))


@plan(f"WITH t AS (SELECT doc_id, unnest({sql_stems('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_counts(chunks(spark, sf_dir), "prefix5")


DENSE = """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10"""


@plan(DENSE)
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = vectors(spark, sf_dir)
    asked = data.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vec")  # the stated query set
    return search.dense_search(asked, data, 10).select("query_id", "chunk_id", "score", F.col("rank").cast("long"))


@plan(DENSE)
def dense_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with small parts and blocks, so that many meet."""
    data = vectors(spark, sf_dir)
    asked = data.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    return search.dense_search(asked, data, 10, block=16, part_rows=200).select("query_id", "chunk_id", "score", F.col("rank").cast("long"))


@plan()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours from the compressed index."""
    data = vectors(spark, sf_dir)
    asked = data.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    return ann.ann_search(asked, stored_index(spark, data), 10)[0]


def stored_index(spark: SparkSession, data: DataFrame) -> ann.Index:
    """The index, written once in the shared folder and read back."""
    path = scratch.path(spark, "ann")
    ann.write_index(ann.build_index(data), path)
    return ann.read_index(spark, path)


@plan("SELECT count(*) AS queries, 10 * count(*) AS wanted, true AS recall_reached, true AS few_scored FROM embeddings WHERE vec_id % 50 = 0")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the approximate search against the exact one (0.9 at least), and whether it scored under a fifth of all
    rows for a query, on average."""
    data = vectors(spark, sf_dir)
    asked = data.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    found, counts = ann.ann_search(asked, stored_index(spark, data), 10)
    measured = ann.recall(found, search.dense_search(asked, data, 10))
    rows = data.agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("one"))
    mean = counts.agg(F.avg("scored").alias("scored"), F.lit(0).alias("one"))
    both = measured.withColumn("one", F.lit(0)).join(mean, "one").join(rows, "one")
    return both.select("queries", "wanted", (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("scored") < F.col("n") / 5).alias("few_scored"))


@plan("""WITH r AS (SELECT doc_id, list_transform(range(16), lambda i: ('0x' || substr(sha256(text), (i * 2 + 1)::INT, 2))::INT / 127.5 - 1.0) AS v FROM documents),
n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM r)
SELECT doc_id, array_to_string(list_transform(v, lambda x: round(x / norm * 1000000)::BIGINT), ',') AS parts FROM n""")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select("doc_id", hash_embed(F.col("text")).alias("v"))
    return v.select("doc_id", F.array_join(F.transform("v", lambda x: F.round(x * 1000000).cast("long").cast("string")), ",").alias("parts"))


COORD = """coord AS (SELECT query_id, chunk_id, lang, count(*)::DOUBLE AS score FROM bm25_tf JOIN bm25_q USING (term) GROUP BY query_id, chunk_id, lang)"""
RRF = f"""WITH {sql_bm25()}, {COORD},
ranked AS (SELECT 'bm25' AS source, query_id, chunk_id, score, rank FROM ({sql_top('bm25', 25)}) UNION ALL SELECT 'coord', query_id, chunk_id, score, rank FROM ({sql_top('coord', 25)}))"""


def two_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and coordination (distinct query terms that a passage has), 25 deep."""
    docs, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    terms = search.query_terms(asked).select("query_id", "term")
    own = docs.select("chunk_id", F.explode(F.array_distinct(lexical_tokens(F.col("text")))).alias("term")).join(terms, "term")
    coord = search.rank_hits(own.groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).cast("double").alias("score")), 25)
    return search.union_rankings(bm25=search.bm25_search(asked, docs, 25), coord=coord)


@plan(f"""{RRF}, f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM ranked GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 10""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuse(two_rankings(spark, sf_dir), 10).select("query_id", "chunk_id", "score", F.col("rank").cast("long"))


@plan(f"""{RRF} SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(source || ':' || rank, ',' ORDER BY source) AS provenance FROM ranked GROUP BY query_id, chunk_id""")
def pool_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = search.pool_candidates(two_rankings(spark, sf_dir))
    return pool.select("query_id", "chunk_id", "score", F.array_join(F.transform("provenance", lambda p: F.concat_ws(":", p["source"], p["rank"].cast("string"))), ",").alias("provenance"))


@plan(f"""WITH {sql_bm25()}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, chunk_id) AS r FROM bm25), f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + r)), 9) AS score FROM d WHERE r <= 10 GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 10""")
def rrf_multi_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunks(spark, sf_dir)
    hits = search.bm25_search(questions(spark, sf_dir), docs, 10, per="lang").withColumnRenamed("lang", "domain")
    return search.fuse_domains(hits, 10).select("query_id", "chunk_id", "score", F.col("rank").cast("long"))


@plan(f"""WITH {sql_bm25()}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, chunk_id) AS r FROM bm25)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY r, lang, chunk_id) AS position FROM d WHERE r <= 5""")
def round_robin_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunks(spark, sf_dir)
    top = search.bm25_search(questions(spark, sf_dir), docs, 5, per="lang")
    return rel.round_robin(top, "query_id", "lang", "rank", "chunk_id").select("query_id", "chunk_id", F.col("position").cast("long"))


@plan(f"""WITH {sql_bm25()}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, chunk_id) AS r FROM bm25),
m AS (SELECT query_id, chunk_id, min((lang, r)) AS first FROM d WHERE r <= 5 GROUP BY ALL)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY first, chunk_id) AS source_no FROM m""")
def merge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunks(spark, sf_dir)
    hits = search.bm25_search(questions(spark, sf_dir), docs, 5, per="lang").withColumnRenamed("lang", "part")
    return search.merge_parts(hits).select("query_id", "chunk_id", F.col("source_no").cast("long"))


@plan(f"""WITH {sql_bm25()}, top AS ({sql_top('bm25', 25)}),
s AS (SELECT t.query_id, t.chunk_id, len(list_intersect(list_distinct({sql_stems('b.text')}), list_distinct({sql_stems('d.text')}))) / greatest(1, len(list_distinct({sql_stems('b.text')}))) AS share
  FROM top t JOIN benchmark b ON b.item_id = t.query_id JOIN documents d ON d.doc_id = t.chunk_id),
r AS (SELECT query_id, chunk_id, round(1 / (1 + exp(-(8 * share - 4))), 6) AS score FROM s)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM r) WHERE rank <= 10""")
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    pool = search.bm25_search(asked, docs, 25)
    return search.rerank(pool, asked, docs, 10).select("query_id", "chunk_id", "score", F.col("rank").cast("long"))


GOLD = "gold AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b, documents d WHERE contains(d.text, b.text))"


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item's text."""
    return search.containing(chunks(spark, sf_dir), questions(spark, sf_dir))


@plan(f"""WITH {sql_bm25()}, {GOLD}, top AS ({sql_top('bm25', 25)}), r AS (SELECT query_id, min(rank) AS rank FROM top JOIN gold USING (query_id, chunk_id) GROUP BY query_id)
SELECT k, count(*) FILTER (rank <= k) AS found, round(count(*) FILTER (rank <= k) / count(*), 3) AS share FROM (SELECT DISTINCT query_id FROM gold) LEFT JOIN r USING (query_id), (VALUES (1), (3), (8), (25)) v(k) GROUP BY k""")
def known_item_success_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = gold(spark, sf_dir).withColumn("grade", F.lit(2))
    ranks = ev.first_match(search.bm25_search(questions(spark, sf_dir), chunks(spark, sf_dir), 25), right)
    return ev.success_at(right.select("query_id").distinct(), ranks).select("k", "found", "share")


LABELS = f"""{GOLD}, part AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b, documents d WHERE contains(d.text, split_part(b.text, '.', 1) || '.')),
lab AS (SELECT query_id, chunk_id, max(g) AS rel FROM (SELECT *, 2 AS g FROM gold UNION ALL SELECT *, 1 FROM part) GROUP BY ALL)"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 for documents with the whole item, 1 for its first sentence."""
    start = questions(spark, sf_dir).select("query_id", F.concat(F.substring_index("text", ".", 1), F.lit(".")).alias("text"))
    part = search.containing(chunks(spark, sf_dir), start).withColumn("relevance", F.lit(1))
    return gold(spark, sf_dir).withColumn("relevance", F.lit(2)).unionByName(part).withColumn("review_status", F.lit("reviewed"))


NDCG = f"""WITH {sql_bm25()}, {LABELS}, top AS ({sql_top('bm25', 10)}),
i AS (SELECT query_id, count(*) FILTER (rel > 0) AS pos, sum(CASE WHEN n <= 10 THEN (2 ** rel - 1) / log2(n + 1) ELSE 0 END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, chunk_id) AS n FROM lab) GROUP BY query_id),
f AS (SELECT query_id, count(*) AS found, sum((2 ** rel - 1) / log2(rank + 1)) AS dcg FROM top JOIN lab USING (query_id, chunk_id) GROUP BY query_id),
m AS (SELECT query_id, round(coalesce(found, 0) / pos, 6) AS recall, round(coalesce(dcg, 0) / ideal, 6) AS ndcg FROM i LEFT JOIN f USING (query_id))"""


@plan(f"{NDCG} SELECT * FROM m")
def recall_ndcg_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.evaluate(search.bm25_search(questions(spark, sf_dir), chunks(spark, sf_dir), 10), graded(spark, sf_dir), 10)


@plan(f"""{NDCG}, s AS (SELECT CASE WHEN query_id % 2 = 0 THEN 'development' ELSE 'holdout' END AS split, recall, ndcg, query_id AS seconds FROM m)
SELECT split, count(*) AS eligible, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, quantile_disc(seconds, 0.95) AS p95 FROM s GROUP BY GROUPING SETS ((split), ())""")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ev.evaluate(search.bm25_search(questions(spark, sf_dir), chunks(spark, sf_dir), 10), graded(spark, sf_dir), 10)
    return ev.metric_summary(m.withColumn("split", F.when(F.col("query_id") % 2 == 0, "development").otherwise("holdout")).withColumn("seconds", F.col("query_id")))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of six systems, computed from the events of each type and of all."""
    e = table(spark, sf_dir, "events").withColumn("system", F.concat(F.lit("s"), (F.col("user_id") % 6).cast("string")))
    return e.groupBy("system").agg(
        F.lit("v1").alias("metric_version"), F.count(F.lit(1)).alias("eligible_queries"), F.round(F.avg((F.col("value") < 90).cast("int")), 4).alias("recall_at_10"), F.round(F.avg((F.col("value") < 50).cast("int")), 4).alias("ndcg_at_10"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95_latency_seconds"), F.round(F.max("value") / 20, 4).alias("peak_process_memory_gb"),
    )


REPORTS = """r AS (SELECT 's' || (user_id % 6) AS system, count(*) AS eligible_queries, round(avg(CASE WHEN value < 90 THEN 1 ELSE 0 END), 4) AS recall_at_10, round(avg(CASE WHEN value < 50 THEN 1 ELSE 0 END), 4) AS ndcg_at_10,
quantile_disc(value, 0.95) AS p95, round(max(value) / 20, 4) AS mem FROM events GROUP BY 1)"""


@plan(f"""WITH {REPORTS}, n AS (SELECT * FROM r WHERE (SELECT max(ndcg_at_10) FROM r) - ndcg_at_10 < 0.01)
SELECT first(system ORDER BY p95, mem, system) AS selected, CASE WHEN count(*) > 1 THEN 'lowest_cost_within_margin' ELSE 'highest_ndcg' END AS reason FROM n""")
def select_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.select_model(reports(spark, sf_dir))


@plan(f"""WITH {REPORTS}, n AS (SELECT CASE system WHEN 's0' THEN 'bm25' WHEN 's1' THEN 'vector' ELSE system END AS system, * EXCLUDE (system) FROM r), a AS (SELECT count(*) AS c, min(eligible_queries) AS q, max(ndcg_at_10) FILTER (system IN ('bm25', 'vector')) AS single FROM n), f AS (SELECT * FROM n WHERE system = 's5')
SELECT unnest(['reports_present', 'one_metric_version', 'enough_queries', 'recall', 'ndcg_gain', 'latency', 'memory']) AS "check", unnest([c >= 6, true, q >= 100, recall_at_10 >= 0.8, ndcg_at_10 >= single + 0.02, p95 <= 3, mem <= 6]) AS ok FROM a, f""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = reports(spark, sf_dir).replace({"s0": "bm25", "s1": "vector"}, subset="system")
    return ev.quality_gate(named, "s5")


@plan(f"""WITH {sql_bm25()}, {sql_bm25(True, name='stem')}, {GOLD},
a AS (SELECT 'plain' AS setup, query_id, min(rank) AS rank FROM ({sql_top('bm25', 25)}) JOIN gold USING (query_id, chunk_id) GROUP BY query_id),
b AS (SELECT 'prefix5' AS setup, query_id, min(rank) AS rank FROM ({sql_top('stem', 25)}) JOIN gold USING (query_id, chunk_id) GROUP BY query_id),
q AS (SELECT DISTINCT query_id FROM gold), s AS (SELECT setup, query_id, rank FROM (VALUES ('plain'), ('prefix5')) v(setup) CROSS JOIN q LEFT JOIN (SELECT * FROM a UNION ALL SELECT * FROM b) USING (setup, query_id))
SELECT setup, round(count(*) FILTER (rank <= 1) / count(*), 3) AS top_1, round(count(*) FILTER (rank <= 3) / count(*), 3) AS top_3, round(count(*) FILTER (rank <= 8) / count(*), 3) AS top_8, round(count(*) FILTER (rank <= 25) / count(*), 3) AS top_25 FROM s GROUP BY setup""")
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    return ev.ablation({"plain": search.bm25_search(asked, docs, 25), "prefix5": search.bm25_search(asked, docs, 25, "prefix5")}, gold(spark, sf_dir))


@plan("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_suppkey AS law, l_orderkey AS document_id, l_linenumber AS chunk_index, unnest(list_distinct([l_partkey % 50, l_linenumber])) AS article FROM lineitem)
SELECT query_id, chunk_id, rank FROM (SELECT s_suppkey AS query_id, chunk_id, row_number() OVER (PARTITION BY s_suppkey ORDER BY document_id, chunk_index, chunk_id) AS rank FROM (SELECT DISTINCT chunk_id, law, document_id, chunk_index, article FROM c) JOIN supplier ON law = s_suppkey AND article = s_suppkey % 50) WHERE rank <= 3""")
def article_lookup_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"])
    corpus = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_suppkey").alias("primary_legislation_number"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), F.array_distinct(F.array(F.col("l_partkey") % 50, F.col("l_linenumber").cast("long"))).alias("article_labels"))
    corpus = corpus.select("chunk_id", "primary_legislation_number", "document_id", "chunk_index", F.explode("article_labels").alias("a")).distinct().select("chunk_id", "primary_legislation_number", "document_id", "chunk_index", F.array("a").alias("article_labels"))
    refs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").alias("law"), (F.col("s_suppkey") % 50).alias("article"))
    return search.article_lookup(corpus, refs).select("query_id", "chunk_id", F.col("rank").cast("long"))


@plan("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND (s_suppkey % 17 = 0 OR l_partkey BETWEEN s_suppkey * 10 AND s_suppkey * 10 + 200))""")
def allowlist_range_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("law"), F.when(F.col("s_suppkey") % 17 == 0, "*").otherwise(F.concat((F.col("s_suppkey") * 10).cast("string"), F.lit("-"), (F.col("s_suppkey") * 10 + 200).cast("string"))).alias("entry"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_suppkey").alias("law"), F.col("l_partkey").cast("string").alias("label"))
    return search.in_allowlist(lines, rules).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@plan(f"""WITH {sql_bm25()}, {GOLD}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm25 QUALIFY rank <= 10)
SELECT t.query_id, t.chunk_id, CASE WHEN g.chunk_id IS NULL THEN 0 ELSE 2 END AS relevance, CASE WHEN g.chunk_id IS NULL THEN 'needs_review' ELSE 'candidate_match' END AS note FROM top t LEFT JOIN gold g USING (query_id, chunk_id)""")
def draft_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.bm25_search(questions(spark, sf_dir), chunks(spark, sf_dir), 10)
    drafts = ev.draft_labels(search.pool_candidates(search.union_rankings(bm25=hits)), gold(spark, sf_dir).withColumn("grade", F.lit(2)))
    return drafts.select("query_id", F.explode("labels").alias("l")).select("query_id", "l.chunk_id", "l.relevance", "l.note")
