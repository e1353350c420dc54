"""Steps whose work grew past their tables: how it is dealt out, and that the results are the same."""

import re

import numpy as np
from pyspark.sql import functions as F

from korpusflow.operators import chunks, search, segment, temporal
from korpusflow.operators.markers import Line, capitals, sign_capitals
from korpusflow.plans import common, corpus, rules


def test_rows_of_change_events_are_dealt_out(spark):
    few = spark.range(100).coalesce(1)
    assert common.dealt(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert common.dealt(few.repartition(20)).rdd.getNumPartitions() == 20
    sf = "/root/testdata/sf0.001"
    plan = rules.change_events(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") >= 2  # both readers of the texts


def test_signs_of_a_rest_are_few_and_their_capitals_the_same():
    line = Line("MADDE 2 - (1) bir iki üç dört beş 4857 sayılı", 0)
    rest = line.rest(3)
    assert [s.text for s in rest.signs] == ["(", "1", ")", "BIR"] and rest.start == 10
    assert all(sign_capitals(x) == capitals(x) for x in ("iİıI", "straße", "ğüşöç"))


def test_changes_after_does_not_shuffle_its_pairs(spark):
    day = lambda x: F.to_date(F.lit(x))
    decisions = spark.createDataFrame([(1,), (2,)], "id int").withColumn("decided", day("2020-01-01"))
    refs = spark.createDataFrame([(1, "a", "1", 1), (1, "a", "1", 2), (1, "b", "1", None), (2, "a", "1", None), (2, "a", "1", 1)], "id int, law string, article string, paragraph int")
    rows = [(10, "a", "1", 1, "amended"), (10, "a", "1", 2, "amended"), (10, "b", "1", None, "amended"), (11, "a", "1", None, "added"), (12, "a", "1", None, "repealed"), (13, "a", "1", 3, "amended")]
    changes = spark.createDataFrame(rows, "event_id int, law string, article string, paragraph int, event_type string").withColumn("change_date", day("2021-01-01")).withColumn("effective_from", day(None))
    found = temporal.changes_after(decisions, refs, changes)
    assert sorted((r.id, r.event_id) for r in found.collect()) == [(1, 10), (1, 12), (2, 10), (2, 11), (2, 12), (2, 13)]
    plan = corpus.asof_changes_after(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    top = plan.splitlines()
    assert top[0].startswith("Union") and "Project [id" in top[1] and "Join" in top[2]  # the first branch: pairs, then no aggregate


def test_visible_counts_are_those_of_the_pairs(spark):
    files = spark.range(600).select(F.col("id").alias("file_id"), (F.col("id") % 3).alias("workspace_id"), F.expr("nullif(id % 7, 0)").alias("conversation_id"), F.expr("nullif(id % 5, 0)").alias("case_id"), F.expr("if(id % 2 = 0, 'ready', 'pending')").alias("status"))
    scopes = spark.range(90).select(F.col("id").alias("query_id"), (F.col("id") % 4).alias("workspace_id"), F.expr("nullif(id % 8, 1)").alias("conversation_id"), F.expr("nullif(id % 6, 2)").alias("case_id"))
    pairs = search.visible_files(files, scopes).groupBy("query_id").agg(F.count(F.lit(1)).alias("files"))
    counted = search.visible_counts(files, scopes)
    assert {tuple(r) for r in counted.collect()} == {tuple(r) for r in pairs.collect()}
    assert "file_id" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_exact_search_holds_small_products_and_sends_vectors_seldom(spark):
    v = lambda n: spark.range(n).selectExpr("id", "transform(sequence(0, 7), k -> double(pmod(xxhash64(id % 300, k), 2001)) - 1000) AS vec")
    rows, asked = v(3000).withColumnRenamed("id", "chunk_id"), v(70).withColumnRenamed("id", "query_id")
    found = search.dense_search(asked, rows, 7, block=4, part_rows=50)
    whole = {tuple(r) for r in search.dense_search(asked, rows, 7).collect()}
    x, y = (np.array([r.vec for r in df.orderBy(df.columns[0]).collect()]) for df in (asked, rows))
    scores = np.round((x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T, 6) + 0.0
    want = {(q, int(c), scores[q, c], n) for q in range(70) for n, c in enumerate(np.lexsort((np.arange(3000), -scores[q]))[:7], 1)}
    assert {tuple(r) for r in found.collect()} == want == whole
    plan = found._jdf.queryExecution().analyzed().toString()
    copies = [int(x) + 1 for x in re.findall(r"explode\(sequence\(0, (\d+)", plan)]
    assert len(copies) == 2 and max(copies) <= spark.sparkContext.defaultParallelism, plan  # before: 18 and 60


def test_hits_of_a_chunk_are_summed_where_its_terms_lie(spark):
    asked = spark.createDataFrame([(1, "bir iki iki"), (2, "üç yok")], "query_id int, text string")
    docs = spark.createDataFrame([(1, "bir iki üç"), (2, "iki iki dört"), (3, None), (4, "dört")], "chunk_id int, text string")
    few = search.bm25_search(asked, docs, 10)
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+?)#", few._jdf.queryExecution().executedPlan().toString())
    assert exchanges.count("query_id") <= 3 and "REPARTITION_BY_COL" in few._jdf.queryExecution().executedPlan().toString()
    most, search.BROADCAST_TERMS = search.BROADCAST_TERMS, 0
    try:
        many = search.bm25_search(asked, docs, 10)
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) != []
    finally:
        search.BROADCAST_TERMS = most


LAWS = (
    "Ön söz\n\nİKİNCİ BÖLÜM\nGenel Hükümler\nAmaç\nMADDE 1 - Metin. Bir cümle daha.\n(1) Fıkra.\nm) bent\n1) alt bent\n(2) İkinci fıkra.\nMADDE 1 - Yine bir.\n(1) Fıkra.\nKapsam\nMadde\n7 - Alt satır",
    "EK-1\nBirinci\nMADDE 2 - Uzun bir metin. Sonu da gelir, gelmez de.\n( 3 ) Ara.\n4857 SAYILI KANUNA İŞLENEMEYEN HÜKÜMLER\nMADDE 9 - Sayılmaz", "Yalnız\n\nparagraflar.", "", None,
)


def test_chunks_of_a_text_are_cut_where_its_units_are_found(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(LAWS)], "document_id string, text string")
    got = chunks.structured_chunks(docs, max_chars=30)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = chunks.structured_chunks(docs, segment.units(docs), 30)
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect()) and got.filter("unit_key like '%~2%'").count() > 0


def test_breadcrumbs_are_read_where_the_text_is(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(LAWS)], "document_id string, text string")
    got = segment.text_breadcrumbs(docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.collect()) == sorted(segment.breadcrumbs(segment.units(docs)).select(got.columns).collect()) and got.count() > 10


def test_terms_are_counted_where_their_text_is_read(spark):
    rows = [(1, "ev ev okul"), (2, "ev yol"), (None, "yol yol"), (4, None), (5, "")]
    want = {"ev": (2, 3), "okul": (1, 1), "yol": (1, 3)}
    counts = lambda r: {x.term: (x.df, x.cf) for x in search.term_counts(spark.createDataFrame(r, "chunk_id long, text string")).collect()}
    assert counts(rows) == want
    assert counts([*rows, (2, "ev"), (None, "okul")]) == {"ev": (2, 4), "okul": (1, 2), "yol": (1, 3)}
    plan = search.term_counts(spark.createDataFrame(rows, "chunk_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
