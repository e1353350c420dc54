import os

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from korpusflow.llm.registry import vocabulary_path
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_minhash import brute as brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns
    rows = {r.doc_id: r.text for r in clean.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    assert len(toxic - set(rows)) <= 0.02 * len(toxic)  # clean documents stay

    lined = stages["line_dedup"](spark, clean, SF)
    assert lined.columns == docs.columns
    texts = {r.doc_id: r.text for r in lined.collect()}
    assert texts == brute_lines(list(rows.items()), 50)

    single = stages["near_dedup"](spark, lined, SF)
    want = {d for d, _, root, kept in brute_components(list(texts.items()), 5, 80) if kept}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == want

    kept = stages["decontamination"](spark, single, SF)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = kept.collect()
    assert kept.columns == docs.columns and not [r.doc_id for r in left if any(i in r.text for i in items)]

    theirs = Tokenizer.from_file(vocabulary_path())
    for r in stages["bpe"](spark, kept, SF).collect():
        assert r.ids == theirs.encode(texts[r.doc_id] or "", add_special_tokens=False).ids


def test_run_and_empty_documents(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_cases_of_all_stages(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    long = "\n".join(f"line {i} of a long text with words {i * 7}" for i in range(30_000))
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (None, "", "en", "s", 0), (10**6, None, None, None, None), (10**6 + 1, long, "en", "s", 1), (10**6 + 2, "twice", "en", "s", 5), (10**6 + 2, "twice", "en", "s", 5)], plain.schema)
    extra = ("ids", "decoded", "label", "score", "component_id", "gone", "text_hash", "__gone", "row", "kind")
    docs = plain.unionByName(odd).select("*", *(F.lit(c).alias(c) for c in extra))
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        kept = stages[name](spark, docs, SF)
        assert kept.columns == docs.columns, name
        rows = kept.filter("doc_id is null or doc_id >= 1000000").select("doc_id", "text", "gone").collect()
        assert len(rows) == 6 and {r.gone for r in rows} == {"gone"} and any(r.text == long for r in rows), name
    out = {r.doc_id: r for r in stages["bpe"](spark, docs.filter("doc_id >= 1000000 or doc_id is null"), SF).collect()}
    assert out[None].ids == [] and out[10**6].n_tokens == 0 and len(out[10**6 + 1].ids) > 100_000
