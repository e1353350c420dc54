"""The latent vectors of decontamination are fitted on every text, not on some of them."""

import numpy as np

from korpusflow.llm import contamination


def test_every_text_is_fitted(spark, monkeypatch):
    seen = []
    whole = contamination.normal_product

    def counted(texts, *rest):
        seen.append(texts.count())
        return whole(texts, *rest)

    monkeypatch.setattr(contamination, "normal_product", counted)
    n = 8200  # once the fit took 8,000 documents
    docs = spark.range(n).selectExpr("if(id % 100 = 0, null, id) AS doc_id", "concat('w', id % 97, ' v', id % 89, ' only', id) AS text")
    latent = contamination.latent_terms(docs, None)
    assert seen == [n, n] and latent.shape == ((1 << contamination.TERM_BITS) + 1, contamination.RANK) and np.isfinite(latent).all()


def test_the_product_is_that_of_the_whole_matrix(spark):
    words = [[f"t{(i * 7 + k * k) % 23}" for k in range(16)] for i in range(300)]
    docs = spark.createDataFrame([(" ".join(w),) for w in words], "text string").repartition(5)
    size = 1 << contamination.TERM_BITS
    rng = np.random.default_rng(1)
    idf, x = rng.random(size), rng.standard_normal((size, 3))
    a = np.zeros((len(words), size))
    for row, w in zip(a, words):
        np.add.at(row, contamination.terms_of(contamination.word_hashes([t.encode() for t in w])), 1)
    a *= idf
    assert np.allclose(contamination.normal_product(docs, idf, x, 16), a.T @ (a @ x), rtol=1e-4, atol=1e-4)


def test_words_are_told_apart_once_for_all_passes(spark, monkeypatch):
    rows = [(None,), ("",), (" \n",), ("one",), (" ".join(f"Wört{k % 41}" for k in range(50_000)),), *((f"a{k} b{k % 7} c",) for k in range(2_500))]
    docs = spark.createDataFrame(rows, "text string").repartition(3)
    rng = np.random.default_rng(2)
    idf, x = rng.random(1 << contamination.TERM_BITS), rng.standard_normal((1 << contamination.TERM_BITS, 2))
    terms = contamination.term_table(docs)
    assert terms.columns == ["terms"] and terms.count() == len(rows)
    for got, want in zip(contamination.document_frequencies(terms, 16), contamination.document_frequencies(docs, 16)):
        assert np.array_equal(got, want)
    assert np.allclose(contamination.normal_product(terms, idf, x, 16), contamination.normal_product(docs, idf, x, 16), rtol=1e-4, atol=1e-4)
    seen, whole = [], contamination.normal_product
    monkeypatch.setattr(contamination, "normal_product", lambda texts, *rest: seen.append(texts.columns) or whole(texts, *rest))
    contamination.latent_terms(docs, None)
    assert seen == [["terms"], ["terms"]]
