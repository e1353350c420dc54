"""Literal cases of the operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from korpusflow.functions import dates, text, vectors
from korpusflow.operators import citations, corpus, evaluate, lawrefs, pack, relational, search, segment, temporal
from korpusflow.sources import files, pages
from korpusflow.streaming import ingest

D = dt.date.fromisoformat


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_tokens_and_stems(spark):
    got = one(spark, text.tokens(F.col("t")), t="İŞÇİNİN 35/A maddesi ve Yargıtay E. 2022/9-1222, K. 2024/360 kararı")
    assert {"işçinin", "35/a", "e.2022/9-1222", "k.2024/360"} <= set(got)
    stems = one(spark, text.lexical_tokens(F.col("t"), "prefix5"), t="Savunmam alınmadan, E.2022/123 ve 18/A kanun'un iş")
    assert stems == ["savun", "alınm", "e.2022/123", "ve", "18/a", "kanun", "iş"]
    for bad in ("prefix0", "prefix12", "porter"):
        with pytest.raises(ValueError):
            text.stemming_letters(bad)


def test_prefix_index_finds_inflected_forms(spark):
    chunks = spark.createDataFrame([("a", "İşçinin savunması alınmadan sözleşmesi feshedilemez."), ("b", "Kira bedeli")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "Savunmam alındı mı?")], "query_id string, text string")
    assert search.bm25_search(asked, chunks).count() == 0
    assert [r.chunk_id for r in search.bm25_search(asked, chunks, stemming="prefix5").collect()] == ["a"]


def test_written_index_keeps_its_stemming(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "savunması alınmadan"), ("b", "kira bedeli savunma"), ("c", "")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "Savunmam")], "query_id string, text string")
    path = f"{tmp_path}/index"
    search.write_bm25_index(chunks, path, "prefix5")
    want = {(r.chunk_id, r.score) for r in search.bm25_search(asked, chunks, stemming="prefix5").collect()}
    assert {(r.chunk_id, r.score) for r in search.search_index(asked, path).collect()} == want and len(want) == 2
    with pytest.raises(Exception):
        search.write_bm25_index(chunks, path, "prefix5")
    with pytest.raises(ValueError):
        search.write_bm25_index(chunks.limit(0), f"{tmp_path}/other")


def test_labels_dates_and_small_texts(spark):
    for raw, want in (("Ek madde 3", "Ek3"), ("m. 18/a", "18/A"), ("geçici 20. madde", "Geçici20"), ("ek geçici madde 1", "EkGeçici1"), ("hüküm", None)):
        assert one(spark, text.article_label(F.col("t")), t=raw) == want, raw
    assert one(spark, text.article_unit(F.lit("Geçici20"))) == "temporary_article:20" and one(spark, text.article_unit(F.lit("EkGeçici2"))) == "additional_temporary_article:2"
    found = one(spark, text.dates_in(F.col("t")), t="14.06.2023, 14/06/2023, 2023-06-15, 16 Haziran 2023 ve 17-06-2023; 31.02.2023, 1.234.2023")
    assert sorted(found) == [D("2023-06-14"), D("2023-06-14"), D("2023-06-15"), D("2023-06-16"), D("2023-06-17")]
    assert one(spark, text.slug(F.lit("  İş Kanunu – Çalışma (2) "))) == "is-kanunu-calisma-2"
    assert one(spark, text.normalize(F.lit(" a \t b\r\n\r\n\r\n\r\nc­d "))) == "a b\n\ncd"
    assert one(spark, text.join_wrapped_lines(F.lit("söz-\nleşme A-\nB"))) == "sözleşme A-\nB"
    assert one(spark, text.location_label(F.lit(3), F.lit(5), F.lit(None), F.lit(None))) == "s. 3–5"
    assert one(spark, text.token_cost(F.lit("abc"))) == 2 and one(spark, text.token_cost(F.lit(None).cast("string"))) == 1
    assert one(spark, text.article_range(F.lit(15), F.lit(18))) == ["15", "16", "17", "18"]
    assert one(spark, text.related_laws(F.lit("4857 sayılı Kanun ve 6100 Sayılı"), F.array(F.lit("1475")))) == ["1475", "4857", "6100"]


def test_deadlines(spark):
    for start, n, unit, want in (("2023-06-14", 1, "ay", "2023-07-14"), ("2024-01-31", 1, "ay", "2024-02-29"), ("2023-01-31", 1, "ay", "2023-02-28"), ("2023-07-26", 2, "hafta", "2023-08-09"), ("2023-01-10", 30, "gün", "2023-02-09"), ("2023-07-28", 6, "iş günü", "2023-08-07"), ("2024-02-29", 1, "yıl", "2025-02-28")):
        assert one(spark, dates.last_day(F.lit(D(start)), F.lit(n), F.lit(unit))) == D(want), (start, n, unit)
    for body, n, unit, want in (("onbeş gün içinde", 15, "gün", True), ("on beş günlük", 15, "gün", True), ("bir ayrım", 1, "ay", False), ("11 ay sonra", 1, "ay", False), ("altı iş günü", 6, "gün", False), ("altı iş günü", 6, "iş günü", True), ("bir aylık süre", 1, "ay", True), ("iki yüz yirmi beş gün", 225, "gün", True), ("on bir ay", 1, "ay", False), ("3 yıl", 3, "yıl", True), ("", 3, "yıl", False)):
        assert one(spark, dates.states_period(F.lit(body), F.lit(n), F.lit(unit))) is want, body


def test_change_levels(spark):
    for kind, effective, when, want in (("amended", None, "2023-07-05", "changed_after"), ("amended", None, "2024-11-20", "near_change"), ("amended", None, "2025-06-01", None), ("amended", "2025-01-01", "2024-12-01", "changed_after"), ("amended", "2025-01-01", "2025-01-02", None), ("annulled", None, "2025-08-01", "near_change")):
        assert one(spark, dates.assess(F.lit(kind), F.lit(D("2024-11-07")), F.lit(D(effective) if effective else None).cast("date"), F.lit(D(when)))) == want


def test_article_references(spark):
    refs = lambda text, decided=None: set(lawrefs.references(text, decided))
    assert refs("Dava, HMK'nın 114/2. maddesi gereği usulden reddedilmiştir") == {("6100", "114", 2)}
    assert refs("6331 sayılı Kanun'un 4., 5. ve 10. maddeleri") == {("6331", "4", None), ("6331", "5", None), ("6331", "10", None)}
    assert refs("5510 sayılı Kanun’un 88/1 ve 90. maddeleri") == {("5510", "88", None), ("5510", "90", None)}
    assert refs("Türk Medeni Kanunu'nun geçici 2. maddesi ile ek madde 7") == {("4721", "Geçici2", None), ("4721", "Ek7", None)}
    assert refs("6356 sayılı Sendikalar ve Toplu İş Sözleşmesi Kanunu'nun 25 inci maddesinin onikinci fıkrası") == {("6356", "25", 12)}
    assert refs("SENDİKALAR KANUNU (2821) Madde 31; md. 33/4") == {("2821", "31", None), ("2821", "33", 4)}
    assert refs("TBK'nın 49. maddesinin (2) numaralı fıkrası") == {("6098", "49", 2)}
    assert refs("Deniz İş Kanunu'nun 14. maddesi") == refs("Esas no 2022/123 sayılı karar, 5. madde") == refs("Hukuk Usulü Muhakemeleri Kanunu'nun 76. maddesi") == refs(None) == set()
    far = "7036 sayılı Kanun yürürlüktedir. " + "Dosya incelendi. " * 20
    assert refs(far + "Bu nedenle 3. maddesi") == set() and refs(far + "Kanun'un 3. maddesi") == {("7036", "3", None)}
    assert refs("iş mahkemeleri kanunu 5. madde", D("2010-01-01")) == set()
    df = spark.createDataFrame([("a", "HMK m. 5 ve 6. madde", None), (None, "TMK'nın 1. maddesi", None), ("c", None, None)], "id string, text string, decided date")
    assert {tuple(r) for r in lawrefs.extract_refs(df).collect()} == {("a", "6100", "5", None), ("a", "6100", "6", None), (None, "4721", "1", None)}
    assert {r.id: r.articles for r in lawrefs.mentioned_articles(df).collect()} == {"a": ["5", "6"], None: ["1"], "c": []}
    for note, want in (("Değişik üçüncü fıkra: 2/5/2010", 3), ("İPTAL ON BİRİNCİ FIKRA", 11), ("Mülga onuncu fıkra", 10), ("Ek fıkra: 3/3/2003", None), (None, None)):
        assert one(spark, lawrefs.annotation_paragraph(F.lit(note).cast("string"))) == want, note


def test_changes_after_a_decision(spark):
    change = lambda e, p, kind: (e, "4857", "20", p, kind, D("2017-10-25"), None)
    changes = spark.createDataFrame([change("first", 1, "amended"), change("third", 3, "amended"), change("added", None, "added")], "event_id string, law string, article string, paragraph int, event_type string, change_date date, effective_from date")
    decisions = spark.createDataFrame([("d", D("2013-06-04"))], "id string, decided date")
    for paragraph, want in ((None, {"first", "third", "added"}), (1, {"first"})):
        refs = spark.createDataFrame([("d", "4857", "20", paragraph)], "id string, law string, article string, paragraph int")
        assert {r.event_id for r in temporal.changes_after(decisions, refs, changes).collect()} == want


def test_fusion_ties_pool_and_permutation(spark):
    rows = [("x", "q", "a", 1.0, 1), ("x", "q", "b", 0.5, 2), ("y", "q", "b", 1.0, 1), ("y", "q", "a", 0.5, 2)]
    ranked = spark.createDataFrame(rows, "source string, query_id string, chunk_id string, score double, rank int")
    assert [r.chunk_id for r in search.fuse(ranked).orderBy("rank").collect()] == ["a", "b"]
    assert [tuple(r) for r in search.fuse(ranked).collect()] == [tuple(r) for r in search.fuse(ranked.orderBy(F.desc("rank"))).collect()]
    assert search.breakdown(search.fuse(ranked)).filter("chunk_id = 'a'").first()["score_breakdown"] == {"x": 1.0, "y": 0.5}
    pool = spark.createDataFrame([("bm25", "q", "shared", 2.0, 1), ("bm25", "q", "lex", 1.0, 2), ("bge-m3", "q", "den", 0.9, 1), ("bge-m3", "q", "shared", 0.8, 2)], ranked.schema)
    got = search.pool_candidates(pool).orderBy("rank").collect()
    assert len(got) == 3 and got[0].chunk_id == "shared" and sorted(p.source for p in got[0].provenance) == ["bge-m3", "bm25"]


def test_recall_and_ndcg(spark):
    hits = lambda ids: spark.createDataFrame([("q", c, i) for i, c in enumerate(ids, 1)], "query_id string, chunk_id string, rank int")
    labels = lambda rows: spark.createDataFrame([("q", *r) for r in rows], "query_id string, chunk_id string, relevance int, review_status string")
    r = evaluate.evaluate(hits(["a", "x", "p", "u"]), labels([("a", 1, "reviewed"), ("b", 1, "reviewed"), ("c", 1, "reviewed"), ("x", 0, "reviewed"), ("p", 2, "pending")])).first()
    assert r.recall == pytest.approx(1 / 3, abs=1e-6)
    r = evaluate.evaluate(hits(["b", "a"]), labels([("a", 2, "reviewed"), ("b", 1, "reviewed")])).first()
    assert r.ndcg == pytest.approx((1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3)), abs=1e-6)
    assert evaluate.evaluate(hits(["a", "a"]), labels([("a", 2, "reviewed")])).first().ndcg == 1.0


def test_reference_grades(spark):
    corpus_rows = spark.createDataFrame([("law", "4857", ["18"], "İş Kanunu", None, "law"), ("decision", None, [], "Karar", "Yargıtay", "court_decision")], "chunk_id string, primary_legislation_number string, article_labels array<string>, title string, authority string, document_type string")
    refs = spark.createDataFrame([("q", "4857:18-19"), ("q", "Yargıtay")], "query_id string, ref string")
    assert {(r.chunk_id, r.grade) for r in evaluate.reference_grade(refs, corpus_rows).collect()} == {("law", 2), ("decision", 1)}


def test_packing_skips_what_does_not_fit(spark):
    rows = [("q", "file", 1, "f1", 50), ("q", "file", 2, "f2", 60), ("q", "primary", 1, "p1", 80), ("q", "primary", 2, "p2", 30), ("q", "doctrine", 1, "d1", 100), ("q", "doctrine", 2, "d2", 20)]
    df = spark.createDataFrame(rows, "query_id string, channel string, `order` int, id string, cost int")
    got = [r.id for r in pack.pack(df, base=10, target=120, hard=150, file_tokens=60).orderBy("position").collect()]
    assert got == ["f1", "p2", "d2"]
    parts = spark.createDataFrame([("q", "law", 1, 1, 3, "a", 50), ("q", "law", 2, 1, 1, "b", 50), ("q", "file", 1, 2, 2, "c", 10), ("q", "law", 1, 2, 4, "e", 50)], "query_id string, channel string, part int, rank int, source_no int, id string, cost int")
    assert [r.id for r in pack.pack_parts(parts, budget=100, file_budget=20).orderBy("position").collect()] == ["b", "c", "a"]


def test_units_hierarchy_and_audit(spark):
    body = "BİRİNCİ BÖLÜM\nMADDE 1 - Amaç.\n(1) Bir.\na) İlk;\n(2) İki.\nMADDE 2 - Kapsam.\nİKİNCİ BÖLÜM\nMADDE 2 - Yine.\nGEÇİCİ MADDE 1 - Geçiş."
    docs = spark.createDataFrame([("d", body)], "document_id string, text string")
    got = {r.unit_key: r for r in segment.units(docs).collect()}
    assert "chapter:BİRİNCİ/article:1/paragraph:1/item:a" in got and "chapter:İKİNCİ/article:2" in got and "chapter:İKİNCİ/temporary_article:1" in got
    assert got["chapter:BİRİNCİ/article:1/paragraph:1"].text == "(1) Bir.\na) İlk;" and got["chapter:BİRİNCİ/article:1/paragraph:1"].parent_key == "chapter:BİRİNCİ/article:1"
    assert all(body[r.char_start : r.char_end] == r.text for r in got.values())
    wanted = spark.createDataFrame([("d", 1, 3, None)], "document_id string, first int, last int, labels array<string>")
    audit = segment.structure_audit(segment.units(docs), wanted).first()
    assert audit.missing == ["3"] and not audit.passed


def test_chunks_sentences_and_coverage(spark):
    assert segment.sentences("Av. Ali geldi. Dr. Can 3. Daire'ye yazdı. Sonra gitti.") == ["Av. Ali geldi.", "Dr. Can 3. Daire'ye yazdı.", "Sonra gitti."]
    rows = [(i, i // 5, "A" if i < 3 else "B", f"Cümle {i} burada bitiyor. " * 12) for i in range(20)]
    found = segment.chunk_paragraphs(rows)
    assert all(len(c[5]) <= segment.MAX_CHARS for c in found) and {c[0] for c in found} == {"A", "B"} and found[-1][2] == 3
    docs = spark.createDataFrame([("d", "Bir cümle. " * 400 + "\n\n" + "x" * 3000), ("e", ""), ("f", None)], "document_id string, text string")
    assert segment.coverage_violations(docs, segment.cut_chunks(docs, 500)).count() == 0
    assert segment.coverage_violations(docs, segment.cut_chunks(docs, 500).filter("chunk_index <> 1")).count() == 1


def test_edges_and_paragraphs(spark):
    page = lambda i: f"YARGITAY 9. HD\nGövde {i} metni.\nDevam {i}\nSayfa {i} / 4"
    df = spark.createDataFrame([("d", i, page(i)) for i in range(1, 5)], "document_id string, page int, text string")
    repeated = segment.repeated_edges(df)
    assert {r.edge_line for r in repeated.collect()} == {"YARGITAY #. HD", "Devam #", "Sayfa # / #", "Gövde # metni."}
    assert "YARGITAY" not in segment.strip_edges(df, repeated.filter("edge_line like 'YARGITAY%'")).first()["text"]
    lines = ["AÇIKLAMALAR", "Bu uzun bir satırdır ve sözleş-", "menin devamı budur.", "", "Yeni paragraf."]
    got = segment.rebuild_paragraphs(spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "document_id string, no int, line string")).orderBy("paragraph").collect()
    assert [r.text for r in got] == ["AÇIKLAMALAR", "Bu uzun bir satırdır ve sözleşmenin devamı budur.", "Yeni paragraf."]


def test_line_shapes(spark):
    for line, want in (("GEREKÇE", True), ("2) Deliller:", True), ("iv. Sonuç ve talep", True), ("DAVACI : ALİ", False), ("YETER BU KADAR.", False), ("Sıradan bir satır", False), ("AB", False)):
        assert one(spark, text.is_heading(F.lit(line))) is want, line
    for line, want in (("Sayfa 3 / 12", True), ("- 7 -", True), ("12345", False), ("3 kişi", False), ("", False)):
        assert one(spark, segment.is_page_number(F.lit(line))) is want, line
    for line, want in (("12. madde", True), ("a) ilk", True), ("• son", True), ("12.", False), ("Ab) x", False)):
        assert one(spark, segment.begins_item(F.lit(line))) is want, line


def test_claims(spark):
    blocks = [("heading", [("Başlık", ["s1"])]), ("text", [("İşçi haklıdır.", ["s1", "zz"]), ("Süre 30 gün.", []), ("Merhaba.", [])])]
    answers = spark.createDataFrame([("a", blocks)], "answer_id string, blocks array<struct<kind:string,sentences:array<struct<text:string,source_ids:array<string>>>>>")
    allowed = spark.createDataFrame([("a", "s1")], "answer_id string, source_id string")
    pairs = citations.claim_pairs(answers, allowed)
    support = citations.assess_support(pairs, spark.createDataFrame([("s1", "işçi haklıdır")], "source_id string, passage string"))
    got = {r.claim_id: (r.verification, r.kept) for r in citations.apply_support(pairs, support).collect()}
    assert got == {"S1": ("plain", []), "S2": ("verified", ["s1"]), "S3": ("unverified", []), "S4": ("plain", [])}


def test_registry_rules(spark):
    reg = corpus.register_version(spark.createDataFrame([], "corpus_version string, content_hash string"), "v1", "h")
    assert corpus.register_version(reg, "v1", "h").count() == 1
    with pytest.raises(ValueError):
        corpus.register_version(reg, "v1", "other")
    pins = spark.createDataFrame([("v1", "d", "p1")], "corpus_version string, document_id string, parse_id string")
    assert corpus.pin(pins, pins).count() == 1
    with pytest.raises(ValueError):
        corpus.pin(pins, spark.createDataFrame([("v1", "d", "p2")], pins.schema))


def test_ingest_refuses_bad_documents(spark):
    docs = spark.createDataFrame([("a", "MADDE 1 - " + "x " * 40), ("b", "MADDE 1 - " + "x " * 40), ("c", "short"), ("d", None)], "document_id string, text string")
    got = corpus.ingest(docs, spark.createDataFrame([], "content_hash string"), "r")
    assert {(r.document_id, r.status) for r in got["outcomes"].collect()} == {("a", "imported"), ("b", "duplicate"), ("c", "failed"), ("d", "failed")}
    assert {r.code for r in got["errors"].collect()} == {"too_short", "empty"} and got["links"].count() >= 1


def test_modes_filters_and_scope(spark):
    docs = spark.createDataFrame([("a", "kira bedeli", "x", 1), ("b", "kira artışı", None, 2)], "chunk_id string, text string, kind string, n int")
    asked = spark.createDataFrame([("q", "kira")], "query_id string, text string")
    vec = docs.select("chunk_id", vectors.hash_embed(F.col("text")).alias("vec"))
    qvec = asked.select("query_id", vectors.hash_embed(F.col("text")).alias("vec"))
    for mode in ("bm25", "vector", "hybrid", "hybrid_rerank"):
        assert search.hybrid_search(mode, asked, docs, qvec, vec, limit=2).count() == 2
        assert [r.chunk_id for r in search.hybrid_search(mode, asked, docs, qvec, vec, limit=2, filters={"kind": ["x"]}).collect()] == ["a"]
    with pytest.raises(ValueError):
        search.hybrid_search("vector", asked, docs)
    with pytest.raises(ValueError):
        search.matches({"kind": ["x"] * 51})
    rows = spark.createDataFrame([("4857", "18"), ("4857", "25"), ("4857", "18/A"), ("6100", "1")], "law string, label string")
    rules = spark.createDataFrame([("4857", "18-21"), ("6100", "*")], "law string, entry string")
    assert {tuple(r) for r in search.in_allowlist(rows, rules).collect()} == {("4857", "18"), ("6100", "1")}


def test_pages_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "<p>a&amp;b</p><script>x</script><div>c"), (2, None)], "id int, html string")
    assert [r.text.split() for r in pages.parse_html(df).orderBy("id").collect()] == [["a&b", "c"], []]
    assert pages.compose(spark.createDataFrame([("é",), ("x",), (None,)], "text string")).filter("text = 'é'").count() == 1
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.HTML".lower()).write_text("<p>x")
    (tmp_path / "b.doc").write_text("no")
    got = files.scan_directory(spark, str(tmp_path)).collect()
    assert [(r.media_type, r.byte_length) for r in got] == [("text/html", 4)]


def test_stream_ingest_resumes(spark, tmp_path):
    src, sink, check = (f"{tmp_path}/{x}" for x in ("src", "sink", "check"))
    rows = lambda *t: spark.createDataFrame([(str(i), x) for i, x in enumerate(t)], "document_id string, text string")
    rows("a", "b", "a").coalesce(1).write.parquet(src)
    ingest.stream_ingest(spark, src, "document_id string, text string", check, sink).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(sink).collect()) == ["a", "b"]
    rows("b", "c").coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        ingest.stream_ingest(spark, src, "document_id string, text string", check, sink).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]


def test_thread_page_and_versions(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "id int, k int")
    first = relational.page(df, ["k", "id"], 4).collect()
    assert [r.id for r in first] == [8, 5, 2, 7] and first[0].has_more
    cursor = relational.next_cursor(first[-1].asDict(), ["k", "id"])
    assert [r.id for r in relational.page(df, ["k", "id"], 4, cursor).collect()] == [4, 1, 9, 6]
    assert one(spark, vectors.index_version(F.lit("a"), F.lit("b"), F.lit("t"))) == one(spark, F.substring(F.sha2(F.lit("a:b:t"), 256), 1, 16))
