import random

import numpy as np
import pytest

from korpusflow.operators import ann, chunks, corpus_store, covers, search, segment, snapshots
from korpusflow.streaming import ingest


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "chunk_id long, vec array<double>")


def asked(df):
    return df.withColumnRenamed("chunk_id", "query_id")


def clusters(rng, n, dims=32, groups=12):
    centres = rng.normal(size=(groups, dims))
    return centres[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, dims))


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_compressed_search_finds_neighbours_and_scores_few_rows(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32)) if kind == "random" else clusters(rng, 4000)
    df = vectors(spark, x)
    queries = asked(df.filter("chunk_id % 100 = 0"))
    found, counts = ann.ann_search(queries, ann.build_index(df), 10)
    row = ann.recall(found, search.dense_search(queries, df, 10)).first()
    assert (row.queries, row.wanted) == (40, 400) and row.recall >= 0.97
    assert counts.agg({"scored": "avg"}).first()[0] < 4000 / 5


def test_copies_and_ties_and_rows_without_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    copies = np.repeat(x[:1], 900, axis=0)
    df = vectors(spark, x, 5000).unionByName(vectors(spark, copies)).unionByName(spark.createDataFrame([(9000, None), (9001, []), (9002, [0.0] * 16)], "chunk_id long, vec array<double>"))
    queries = asked(df.filter("chunk_id in (5, 5001, 9000, 9002)"))
    found, counts = ann.ann_search(queries, ann.build_index(df), 10, margin=4.0)
    exact = search.dense_search(queries.filter("query_id < 9000"), df.filter("chunk_id < 9000"), 10)
    assert {tuple(r) for r in found.select("query_id", "chunk_id", "rank").collect()} == {tuple(r) for r in exact.select("query_id", "chunk_id", "rank").collect()}
    assert [r.chunk_id for r in found.filter("query_id = 5").orderBy("rank").collect()] == list(range(10))
    nothing = df.limit(0)
    assert ann.ann_search(queries, ann.build_index(nothing), 10)[0].count() == 0 and ann.ann_search(asked(nothing), ann.build_index(df), 10)[0].count() == 0


def test_stored_index_gives_the_same(spark, tmp_path):
    df = vectors(spark, clusters(np.random.default_rng(5), 600))
    index, queries = ann.build_index(df), asked(df.filter("chunk_id % 60 = 0"))
    ann.write_index(index, f"{tmp_path}/i")
    read = ann.read_index(spark, f"{tmp_path}/i")
    rows = lambda i: {tuple(r) for r in ann.ann_search(queries, i, 5)[0].collect()}
    assert rows(read) == rows(index) and read.rows.count() == 600 and read.cells.agg({"n": "sum"}).first()[0] == 600
    with pytest.raises(Exception, match="exists"):
        ann.write_index(index, f"{tmp_path}/i")


def test_hot_cells_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    df = vectors(spark, clusters(np.random.default_rng(6), 900, groups=2))
    index, queries = ann.build_index(df), asked(df.filter("chunk_id % 30 = 0"))
    assert index.rows.groupBy("cell", "part").count().agg({"count": "max"}).first()[0] < 110
    row = ann.recall(ann.ann_search(queries, index, 10)[0], search.dense_search(queries, df, 10, block=9, part_rows=100)).first()
    assert row.recall >= 0.97


def brute_covers(words, terms):
    """Sum over the shortest stretches with all terms."""
    places = [(i, terms.index(w)) for i, w in enumerate(words) if w in terms]
    score, seen = 0.0, -1
    for k, (end, _) in enumerate(places):
        last = [max((p for p, t in places[: k + 1] if t == no), default=-1) for no in range(len(terms))]
        start = min(last)
        if start >= 0 and start > seen:
            inside = sum(start <= p <= end for p, _ in places)
            score += 0.1 / (1 + end - start + 1 - inside)
            seen = start
    return round(score, 6)


def test_cover_density(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices("alfa beta gama delta kapa".split(), k=rng.randrange(0, 40)))) for i in range(60)] + [(90, None), (91, "")]
    queries = [(1, "alfa beta"), (2, "beta gama beta alfa"), (3, "omega"), (4, "alfa omega"), (5, None)]
    c, q = spark.createDataFrame(texts, "chunk_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in covers.cover_search(q, c, None, None, every=True).collect()}
    want = {}
    for qid, text in queries:
        terms = list(dict.fromkeys((text or "").split()))
        for cid, body in texts:
            words = (body or "").split()
            if terms and all(t in words for t in terms):
                want[qid, cid] = brute_covers(words, terms)
    assert got == pytest.approx(want) and len(want) > 80
    some = {(r.query_id, r.chunk_id): r.score for r in covers.cover_search(q, c, None, None).collect()}
    assert some == pytest.approx({(qid, cid): round(0.1 * n, 6) for qid, text in queries for cid, body in texts if (n := sum(w in (text or "").split() for w in (body or "").split()))})
    files = spark.createDataFrame([(i, t, i % 3) for i, t in texts], "chunk_id long, text string, file_id int")
    own = spark.createDataFrame([(1, "alfa", 0), (1, "alfa", 2)], "query_id long, text string, file_id int")
    assert {r.chunk_id % 3 for r in covers.cover_search(own, files, None, None, shared=["file_id"]).collect()} == {0, 2}


BODY = "Başlık\n\nMADDE 1 - Amaç budur.\n(1) Birinci fıkra burada.\na) bent bir\nb) bent iki\n(2) İkinci fıkra.\nMADDE 2 - Çok uzun bir cümle. Sonra bir cümle daha gelir ve sürer gider."


def test_chunks_follow_the_structure(spark):
    docs = spark.createDataFrame([("d", BODY), ("e", "Bir paragraf.\n\n\nİkinci\nparagraf."), ("f", None), ("g", " \n ")], "document_id string, text string")
    got = chunks.structured_chunks(docs, segment.units(docs), 40).orderBy("document_id", "chunk_index").collect()
    law = [r for r in got if r.document_id == "d"]
    assert all(BODY[r.char_start : r.char_end] == r.text and len(r.text) <= 40 for r in law)
    assert [(r.section_type, r.label, r.unit_key) for r in law] == [
        ("metadata", "document", "metadata:document"), ("article", "1", "article:1"), ("item", "1", "article:1/paragraph:1/item:a"), ("item", "1", "article:1/paragraph:1/item:b"),
        *[("article", "2", "article:2")] * 3,
    ]
    assert law[3].unit_keys == ["article:1", "article:1/paragraph:1", "article:1/paragraph:1/item:b", "article:1/paragraph:2"]
    assert law[4].text == "MADDE 2 - Çok uzun bir cümle."
    assert [(r.text, r.section_type, r.unit_key) for r in got if r.document_id == "e"] == [("Bir paragraf.", "paragraph", None), ("İkinci\nparagraf.", "paragraph", None)]
    assert {r.document_id for r in got} == {"d", "e"}
    assert chunks.pieces("x" * 100, 0, 100, 30, []) == [(0, 30), (30, 60), (60, 90), (90, 100)]


def test_snapshot_rules(spark):
    told = "struct<source_channel:string,source_url:string,exact_passage:string,title:string,file_id:string,file_chunk_id:string,page_start:int,page_end:int,corpus_version:string,page_number:int,authority:string,case_number:string,decision_number:string,document_date:date>"
    kind = f"citation_id string, source_channel string, cited_at date, source_id string, document_id string, parse_id string, chunk_id string, file_id string, file_chunk_id string, workspace_id string, snapshot {told}"
    good = dict(source_channel="web", source_url="HTTPS://a.b", exact_passage="x")
    row = lambda cid, channel, snap, **c: (cid, channel, None, *(c.get(k) for k in ("source_id", "document_id", "parse_id", "chunk_id", "file_id", "file_chunk_id", "workspace_id")), snap)
    rows = [row("w1", "web", good, source_id="SOURCE_WEB_1"), row("w2", "web", {**good, "source_url": "https:///x"}, source_id="SOURCE_WEB_2"), row("w3", "web", None, source_id=None, chunk_id="c"), row("n", None, good), row("m", "mail", good), row("c", "corpus", None, document_id="d", chunk_id="k", parse_id="p")]
    citations = spark.createDataFrame(rows, kind)
    empty = lambda s: spark.createDataFrame([], s)
    chunk_rows = empty("chunk_id string, document_id string, parse_id string, page_number int, exact_passage string")
    documents = empty("document_id string, title string, authority string, case_number string, decision_number string, document_date date, source_url string")
    versions = empty("document_id string, corpus_version string, parse_id string, valid_from date, valid_to date")
    file_chunks, files = empty("file_chunk_id string, file_id string, workspace_id string, text string, page_start int, page_end int"), empty("file_id string, workspace_id string, status string, original_name string")
    got = {(r.citation_id, r.rule) for r in snapshots.snapshot_violations(citations, chunk_rows, documents, versions, file_chunks, files).collect()}
    assert got == {
        ("w2", "source_url"), ("w3", "snapshot_channel"), ("w3", "source_id"), ("w3", "stored_row"), ("w3", "source_url"), ("w3", "exact_passage"), ("n", "channel"), ("m", "channel"),
        ("c", "no_chunk"), ("c", "no_document"), ("c", "no_version_in_force"),
    }


def test_corpus_tables_meet_without_a_shuffle(spark, tmp_path):
    rows = lambda data, kind: spark.createDataFrame(data, kind)
    n = 40
    tables = {
        "pins": rows([(i, "p", "v1") for i in range(n)], "document_id int, parse_id string, corpus_version string"),
        "documents": rows([(i, "legislation", f"law-{i}", "5 sayılı", None) for i in range(n)], "document_id int, source_kind string, source_document_id string, title string, related_legislation array<string>"),
        "domains": rows([(i, "x", "primary") for i in range(n)], "document_id int, domain_code string, role string"),
        "chunks": rows([(i, p, k, "t", "s", None if k else False) for i in range(n) for k in range(3) for p in ("p", "q")], "document_id int, parse_id string, chunk_index int, text string, section_type string, retrieval_eligible boolean"),
        "units": rows([(i, "p", "a", "article", "7") for i in range(n)], "document_id int, parse_id string, unit_key string, unit_type string, label string"),
        "links": rows([(i, "p", "a", 1) for i in range(n)], "document_id int, parse_id string, unit_key string, chunk_index int"),
    }
    corpus_store.write_corpus(tables, "meet", str(tmp_path), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = corpus_store.scope_records(corpus_store.read_corpus(spark, "meet"), "v1", "x", ["primary"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.document_id, r.chunk_index) for r in got) == [(i, k) for i in range(n) for k in (1, 2)]
    one = next(r for r in got if (r.document_id, r.chunk_index) == (3, 1))
    assert (one.article_labels, one.primary_legislation_number, one.legislation_numbers, one.domain_role) == (["7"], "3", ["3"], "primary")
    assert corpus_store.scope_records(corpus_store.read_corpus(spark, "meet"), "v1", "x", ["case_law"]).count() == 0
    assert corpus_store.scope_records(corpus_store.read_corpus(spark, "meet"), "v1", "x", eligible_only=False).count() == 3 * n


def test_ledger_reads_only_the_parts_of_a_batch(spark, tmp_path):
    sink = f"{tmp_path}/sink"
    rows = lambda t: spark.createDataFrame([(str(i), x) for i, x in enumerate(t)], "document_id string, text string").selectExpr("*", "sha2(text, 256) AS content_hash")
    ingest.upsert(rows([f"t{i}" for i in range(200)]), 0, sink)
    batch = rows(["t5", "new", "new"])
    parts = sorted({r.content_hash[:3] for r in batch.collect()})
    read = ingest.ledger_parts(spark, ingest.ledger_of(sink), parts)
    assert 1 <= len(read.inputFiles()) <= 3 and read.count() < 5
    for _ in range(2):  # a batch that runs again changes nothing
        ingest.upsert(batch, 1, sink)
        assert sorted(r.text for r in spark.read.parquet(sink).filter("batch = 1").collect()) == ["new"]
    ingest.compact(spark, sink, 1)
    ingest.upsert(rows(["new", "t7", "last"]), 2, sink)
    assert spark.read.parquet(sink).count() == 202 and spark.read.parquet(sink).select("content_hash").distinct().count() == 202
    ingest.upsert(rows([]), 3, sink)
    assert spark.read.parquet(sink).count() == 202
