"""Change events, court decisions, books, and what is said about them: literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from korpusflow.functions import text
from korpusflow.operators import corpus, court, events, search, segment

D = dt.date.fromisoformat


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


LAW = """MADDE 1 - Amaç.
(1) Birinci hüküm. (Değişik: 4/5/2011-6111/12 md.)
MADDE 2 - Kapsam. (Mülga: 7/7/2012-6331/30 md.)
MADDE 3 - Usul. (Ek fıkra: 1/2/2015-6645/7 md.) Devamı.
MADDE 4 - (Anayasa Mahkemesinin 3/4/2014 tarihli ve E.: 2013/5, K.: 2014/9 sayılı Kararı ile bu cümle iptal edilmiştir.)
MADDE 5 - Son. Anayasa Mahkemesinin 5/6/2018 tarihli ve E: 2017/11, K: 2018/22 sayılı kararı ile bu fıkra iptal edilmiştir. Bu Karar Resmî Gazete'de yayımlandığı 10/7/2018 tarihinden dokuz ay sonra yürürlüğe girer. Kalan metin.
Ekli liste; Değişik düzen; ekonomik: karar."""


def test_change_events(spark):
    docs = spark.createDataFrame([("d", LAW), ("e", None), ("f", "Ek 3 kişi geldi.")], "document_id string, text string")
    found = events.extract_events(docs, segment.units(docs)).orderBy("document_id", "event_index").collect()
    assert [(r.event_type, r.target_type) for r in found] == [("amended", "unit"), ("repealed", "unit"), ("added", "paragraph"), ("annulled", "sentence"), ("annulled", "paragraph")]
    assert [r.legal_unit_key for r in found] == ["article:1/paragraph:1", "article:2", "article:3", "article:4", "article:5"]
    assert [(r.source_law_number, r.source_law_article) for r in found[:3]] == [("6111", "12"), ("6331", "30"), ("6645", "7")]
    assert [(r.case_number, r.decision_number) for r in found[3:]] == [("2013/5", "2014/9"), ("2017/11", "2018/22")]
    assert [r.event_date for r in found] == [D("2011-05-04"), D("2012-07-07"), D("2015-02-01"), D("2014-04-03"), D("2018-06-05")]
    last = found[-1]
    assert (last.official_gazette_date, last.delay_months, last.effective_from) == (D("2018-07-10"), 9, D("2019-04-10"))
    assert last.effect_requires_review and last.authority == "Anayasa Mahkemesi" and found[0].confidence == 0.9 and not found[0].effect_requires_review
    assert all(LAW[r.char_start : r.char_end].strip() == r.raw_annotation for r in found)
    told = spark.createDataFrame([("Anayasa Mahkemesinin kararı, on iki ay sonra (1/3/2020) yürürlüğe girer",)], "raw_annotation string")
    row = events.read_notes(told).first()
    assert (row.delay_months, row.effective_from) == (12, D("2020-03-01"))


def test_article_changes(spark):
    docs = spark.createDataFrame([("d", LAW)], "document_id string, text string")
    found = segment.units(docs)
    titles = spark.createDataFrame([("d", "4857 sayılı İş Kanunu"), ("x", "Genel 4857 sayılı")], "document_id string, title string")
    refs = spark.createDataFrame([("4857", "1", "article:1"), ("4857", "9", "article:9"), ("6098", "1", "article:1")], "law string, article string, unit string")
    got = events.article_changes(titles, found, events.extract_events(docs, found), refs).collect()
    assert [(r.law, r.article, r.event_type, r.unit_path) for r in got] == [("4857", "1", "amended", ["article:1", "paragraph:1"])]


DECISION = """T.C.
YARGITAY
KARAR
9 . HUKUK  DAİRESİ
Esas No : 2021/345
Karar No: 2022/67-8
Dava 01.02.2020 tarihinde açılmıştır.
... 03.04.2022 tarihinde oybirliğiyle karar verildi. Ek görüşme 05.06.2022 gününde yapıldı; dosyanın gönderilmesine karar verildi."""


def test_court_metadata(spark):
    supplied = spark.createDataFrame([("a", DECISION, None, "9. hukuk dairesi", "2021/999", None, None, True), ("b", "metin", None, None, None, "1/1", "2020-01-02", True), ("c", None, "AYM", None, None, None, None, False)], "document_id string, text string, authority string, chamber string, case_number string, decision_number string, document_date string, complete boolean")
    got = {r.document_id: r for r in court.court_metadata(supplied).collect()}
    a = got["a"]
    assert (a.authority, a.chamber, a.case_number, a.decision_number, a.document_date) == ("Yargıtay", "9. Hukuk Dairesi", "2021/345", "2022/67-8", D("2022-06-05"))
    assert got["b"].decision_number == "1/1" and got["b"].document_date == D("2020-01-02") and got["c"].authority == "AYM"
    bad = {(r.document_id, r.field, r.rule) for r in court.metadata_conflicts(court.court_metadata(supplied), supplied).collect()}
    assert bad == {("a", "case_number", "differs"), ("b", "chamber", "missing"), ("b", "case_number", "missing")}


def test_book_structure(spark):
    body = "Önsöz\n\nBİRİNCİ BÖLÜM\nGENEL OLARAK\n§ 1. Kavram\nI. TANIM\nA. Dar anlamda\na) ilk hal\nmetin\nB. Geniş anlamda\nII. Karışık başlık\n§ Tür\nYARARLANILAN KAYNAKLAR\nA. Yazar"
    docs = spark.createDataFrame([("k", body)], "document_id string, text string")
    start = spark.createDataFrame([("k", body.index("BİRİNCİ"))], "document_id string, start int")
    got = segment.doctrine_units(docs, start).orderBy("char_start").collect()
    assert [(r.unit_type, r.label, r.heading) for r in got] == [
        ("metadata", "front_matter", None), ("chapter", "BİRİNCİ", "BİRİNCİ BÖLÜM — GENEL OLARAK"), ("section", "1", "Kavram"), ("part", "I", "TANIM"),
        ("paragraph", "A", "Dar anlamda"), ("item", "a", "ilk hal"), ("paragraph", "B", "Geniş anlamda"), ("section", "", "Tür"), ("metadata", "bibliography", None),
    ]
    assert [r.retrieval_eligible for r in got] == [False] + [True] * 7 + [False]
    assert got[4].text == "A. Dar anlamda\na) ilk hal\nmetin" and got[5].unit_path[-1] == "item:a" and all(body[r.char_start : r.char_end] == r.text for r in got)


def test_condensed_queries_and_labels(spark):
    filler = "Bu cümle yalnızca yer tutar ve bir şey sormaz. " * 12
    message = filler + "Kıdem tazminat alacak davası açtım. Süre ne zaman biter? " + filler
    got = one(spark, text.condense(F.col("t"), 120), t=message)
    assert got.startswith("Kıdem tazminat alacak davası açtım. Süre ne zaman biter?") and len(got) <= 120
    assert one(spark, text.condense(F.col("t")), t="  kısa \n soru? ") == "kısa soru?" and one(spark, text.condense(F.col("t"), 10), t="x" * 40) == "x" * 10
    path = F.array(*map(F.lit, ("chapter:II", "temporary_article:3", "paragraph:12", "item:b", "subitem:1#2")))
    assert one(spark, text.provision_label(path)) == "geçici m.3, 12. fıkra, (b) bendi, (1) alt bendi"
    assert one(spark, text.scrub_internal(F.lit("Süre geçti [SOURCE_FILE_01] ve SOURCE_LAW_2 answer_status."))) == "Süre geçti ve ."
    block = text.evidence_block(F.lit("s1"), F.lit("law"), F.lit("T"), F.lit("law"), F.lit(None).cast("string"), F.lit(D("2020-01-02")), F.array(F.lit("a"), F.lit("b")), F.lit(3), F.lit("metin"), F.lit("x"))
    assert one(spark, block) == "source_id=s1\nchannel=law\ntitle=T\ndocument_type=law\nauthority=\ndate=2020-01-02\nbreadcrumb=a > b\npage=3\n<passage>\nmetin\n</passage>\n<amendments>\nx\n</amendments>"


def test_channels_scope_and_records(spark, tmp_path):
    rows = spark.createDataFrame([("a", "kira bedeli", "law", "s1"), ("b", "kira", "law", "s2"), ("c", "kira artışı", "doctrine", "s1")], "chunk_id string, text string, channel string, scope string")
    asked = spark.createDataFrame([("q", "kira")], "query_id string, text string")
    got = {(r.channel, r.chunk_id, r.rank) for r in search.channel_search(asked, rows, 1, stemming=None).collect()}
    assert got == {("law", "b", 1), ("doctrine", "c", 1)}
    hits = search.bm25_search(asked, rows, 10)
    assert {r.chunk_id for r in search.hydrate(hits, rows, {"scope": ["s1"]}).collect()} == {"a", "c"}
    with pytest.raises(ValueError):
        search.require_reviewed(spark.createDataFrame([("v1", "pending")], "version string, review_status string"))
    phrases = spark.createDataFrame([(1, "b c d e f"), (2, "c"), (3, "x y z a b"), (4, "d  e f g")], "query_id long, text string")
    texts = spark.createDataFrame([(1, "ab c d e fg"), (2, "b c d e f"), (3, "b c d  e f g"), (4, ""), (5, None)], "chunk_id long, text string")
    pairs = {(r.query_id, r.chunk_id) for r in search.containing(texts, phrases).collect()}
    assert pairs == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (4, 3)}
    path = f"{tmp_path}/records"
    records = spark.createDataFrame([(i, f"t{i}") for i in range(10_000)], "no long, text string")
    assert corpus.write_records(records, path, "no").first()["records"] == 10_000
    assert corpus.read_records(spark, path, "no").count() == 10_000
    records.filter("no <> 7").write.mode("overwrite").parquet(f"{path}/records")
    with pytest.raises(ValueError):
        corpus.read_records(spark, path, "no")
    vec = spark.createDataFrame([("a", "t", [1.0, 0.0], False)], "chunk_id string, text string, vec array<double>, truncated boolean")
    assert corpus.write_vectors(vec, f"{tmp_path}/v", "i1", 2).first()["indexed"] == 1
    assert "text" not in spark.read.parquet(f"{tmp_path}/v/index_version=i1").columns


def test_reparse(spark):
    import hashlib

    content = ("MADDE 1 - " + "söz " * 30).encode()
    sha = hashlib.sha256(content).hexdigest()
    stored = spark.createDataFrame([("a1", "d1", bytearray(content), len(content), sha), ("a2", "d2", bytearray(b"broken"), 6, sha)], "artifact_id string, document_id string, content binary, byte_length int, content_hash string")
    out = corpus.reparse(stored, spark.createDataFrame([("d1", "İş Kanunu")], "document_id string, title string"), "r2")
    assert [r.title for r in out["documents"].collect()] == ["İş Kanunu"] and {(r.document_id, r.code) for r in out["errors"].collect()} == {("d2", "hash")}
    assert out["units"].count() == 1
