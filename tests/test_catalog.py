import os

from pyspark.sql import functions as F

from korpusflow.functions import text
from korpusflow.operators import catalog, segment


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_reparse_rewrites_only_the_folders_of_its_documents(spark, tmp_path):
    path = f"{tmp_path}/docs"
    kind = "document_id int, title string, meta map<string,string>, attempt int"
    catalog.write_documents(spark.createDataFrame([(i, f"t{i}", {"a": "1"} if i % 2 else None, None) for i in range(60)], kind), path, 8)
    before = files_of(path)
    target = spark.createDataFrame([(3, "neu", {"a": "2", "b": "3"}), (4, None, {"c": "1"}), (5, "x", None), (999, "new", None)], "document_id int, title string, meta map<string,string>")
    failed = spark.createDataFrame([(5,)], "document_id int")
    touched = catalog.reparse_documents(spark, path, f"{tmp_path}/s", target, 8, ["title"], ["meta"], failed)
    rows = {r.document_id: r for r in spark.read.parquet(path).collect()}
    assert (rows[3].title, rows[3].meta, rows[3].attempt) == ("neu", {"a": "2", "b": "3"}, 1) and (rows[4].title, rows[4].meta) == ("t4", {"c": "1"})
    assert (rows[5].title, rows[5].meta, rows[5].attempt) == ("t5", {"a": "1"}, 1) and rows[7].attempt in (None, 0) and len(rows) == 60
    assert {r.document_id for r in touched.collect()} == {3, 4, 5}
    buckets = {r.b for r in target.select(catalog.bucket_of(F.col("document_id"), 8).alias("b")).collect()}
    same = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in buckets}
    assert same and same == {f for f in files_of(path) if f in before}


def test_identifiers(spark):
    rows = [("court_decision", "E1", "", "Başlık", "x"), ("court_decision", "", None, None, "id"), ("legislation", None, None, "4857 sayılı Kanun", "x"), ("book", None, None, None, "b")]
    df = spark.createDataFrame(rows, "source_kind string, case_number string, decision_number string, title string, source_document_id string")
    number = F.when(F.col("source_kind") == catalog.LAW, catalog.law_number(F.col("source_document_id"), F.col("title")))
    assert [r[0] for r in df.select(catalog.legal_identifier(number)).collect()] == ["E. E1", "id", "Kanun No. 4857", "b"]
    assert [one(spark, catalog.document_category(F.lit(k))) for k in ("law", "nothing", None)] == ["Kanun", "Diğer", "Diğer"]
    assert one(spark, catalog.leaks_footer(F.lit("a kullanıcısı tarafından\nb tarihinde"))) is False and one(spark, catalog.leaks_footer(F.lit("metin anonimleştirilmiştir."))) is True


def test_page_gates_and_cleaning(spark):
    kind = "document_id string, page int, text string"
    pages = spark.createDataFrame([("a", 1, "x" * 30), ("a", 2, None), ("b", 1, "1 2 3"), ("c", 1, "y" * 19), ("c", 2, "z" * 40), ("c", 3, "")], kind)
    assert {(r.document_id, r.readable, r.accepted) for r in segment.readable_documents(pages).collect()} == {("a", 1, True), ("b", 0, False), ("c", 1, False)}
    book = spark.createDataFrame([("d", 1, "12 | ALİ VELİ\nsöz-\nleşme\nİş Hukuku | IV"), ("d", 2, "temiz | sayfa\nAli Veli | sayfa")], kind)
    cleaned, counts = segment.clean_book_pages(book, ["Ali Veli", "İŞ  HUKUKU"])
    assert [r.text for r in cleaned.orderBy("page").collect()] == ["sözleşme", "temiz | sayfa\nAli Veli | sayfa"] and counts.first().changed_pages == 1
    _, changed = segment.clean_export_pages(spark.createDataFrame([("e", 1, "gövde\n 3 / 12 \n"), ("e", 2, "gövde")], kind))
    assert changed.first().changed_pages == 1


def test_headings_by_their_first_word(spark):
    cases = (("1. Sonuç", True), ("IV) Sonuç", True), ("a) Sonuç", True), ("12-Sonuç", True), ("x. sonuç", True), ("sonuç:", True), ("123. sonuç", False), ("k) sonuç", False), ("iki. sonuç", False))
    for line, want in cases:
        assert one(spark, text.is_heading(F.lit(line))) is want, line
