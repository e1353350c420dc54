import os
import random

import numpy as np
import pytest

from korpusflow.llm import contamination as c

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_bitwise_subsequence_length():
    import numpy as np

    rng = random.Random(1)
    latent = np.zeros(((1 << c.TERM_BITS) + 1, 4), np.float32)
    for _ in range(100):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(1, 30))] for _ in range(2))
        asked = c.Asked([(1, " ".join(a), False)], latent)
        assert asked.common(0, [x.encode() for x in b]) == lcs(a, b)


def corpus():
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(3000)]
    make = lambda n: [rng.choice(vocab[: 40 if rng.random() < 0.5 else 3000]) for _ in range(n)]
    items = [(i, make(rng.choice([3, 9, 16, 24, 40, 60]))) for i in range(30)]
    docs, copies, changed = [], set(), set()
    for d in range(150):
        words = make(rng.randrange(0, 300))
        if d % 5 == 0:
            item_id, item = rng.choice(items)
            copy = list(item)
            if len(copy) > 20 and d % 2:  # a paraphrase: one word in seven is changed, the end is kept
                for k in range(2, len(copy) - 6, 7):
                    copy[k] = rng.choice(vocab)
                changed.add((d, item_id))
            else:
                copies.add((d, item_id))
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = copy
        docs.append((d, " ".join(words)))
    return docs, [(i, " ".join(w)) for i, w in items], copies, changed


def test_planted_copies_and_paraphrases(spark):
    docs, items, copies, changed = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in c.contaminated(df, bench).collect()}
    assert copies <= got
    assert len(changed & got) >= 0.95 * len(changed)
    texts, by_id = dict(docs), dict(items)
    for d, i in got - copies - changed:  # anything else must be a real match as well
        item = by_id[i].split()
        assert lcs(item, texts[d].split()) >= c.PARAPHRASE * len(item)


def test_middle_of_long_items():
    import numpy as np
    import pyarrow as pa

    latent = np.random.default_rng(9).standard_normal(((1 << c.TERM_BITS) + 1, 256)).astype(np.float32)
    latent[-1] = 0
    item = [f"q{i}" for i in range(200)]
    texts = pa.array([" ".join([f"a{i}" for i in range(300 + d)] + item[20:180] + [f"b{i}" for i in range(300)]) for d in range(8)])  # in all alignments
    got = c.matches(c.Asked([(1, " ".join(item), False)], latent), latent, texts, c.CANDIDATE_COSINE, 0.8, 0.6)
    assert [(t, common) for t, _, _, common, *_ in got] == [(d, 160) for d in range(8)]


def test_bound_keeps_every_match():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(7)
    latent = np.zeros(((1 << c.TERM_BITS) + 1, 4), np.float32)
    vocab = [f"w{i}" for i in range(90)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 12, 30, 90]))), answer) for i, answer in enumerate([False, "w1 w2", "w3", "", "absent"] * 8)]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 200))]
        copy = [w if rng.random() < 0.8 else rng.choice(vocab) for w in rng.choice(items)[1].split()]
        texts.append(" ".join(words[:50] + copy + words[50:]))
    asked = c.Asked(items, latent)
    got = {(t, i) for t, i, *_ in c.matches(asked, latent, pa.array(texts), -1.0, 0.8, 0.6)}  # every window is a candidate
    truth, by_answer = set(), set()
    for t, text in enumerate(texts):
        words = c.item_words(text)
        for i in range(len(items)):
            n = len(asked.words[i])
            for p in range(0, len(words), max(1, c.window_length(n) // 2)):
                segment = words[max(0, p - n) : p + 2 * n]
                both = asked.common(i, segment)
                if both >= 0.8 * n or both >= 0.6 * n and c.holds(segment, asked.answers[i]):
                    truth.add((t, i))
                if both >= 0.6 * n and asked.answers[i] and c.holds(segment, asked.answers[i]):
                    by_answer.add((t, i))
    assert got == truth
    assert by_answer and {(t, i) for t, i, *_ in c.matches(asked, latent, pa.array(texts), 2.0, 0.8, 0.6)} == by_answer  # no window is


def test_long_texts_and_ties(spark):
    item = [f"q{i}" for i in range(40)]
    fill = [f"f{i % 5000}" for i in range(300_000)]
    rows = [(1, " ".join(fill + item + fill + item)), (2, " ".join(["x", *item, "y", *item]))]  # the first place is told
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(item)), (5, " ".join(item))], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start_word) for r in c.contaminated(df, bench).collect())
    assert [g[:2] for g in got] == [(1, 5), (1, 5), (2, 5), (2, 5)]
    assert all(300_000 - 120 <= g[2] <= 300_000 for g in got[:2]) and all(g[2] == 0 for g in got[2:])


def test_defined_cases(spark):
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(None, f"a {item} b", 1), (1, None, 2), (2, "", 3), (3, item.upper(), 4), (3, item.upper(), 4), (4, "clean text here", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item, "q18 q19"), (8, None, None), (None, "", "x")], "item_id long, text string, answer string")
    got = sorted((r.doc_id or -1, r.item_id, r.similarity, r.has_answer) for r in c.contaminated(df, bench).collect())
    assert got == [(-1, 7, 1.0, True), (3, 7, 1.0, True), (3, 7, 1.0, True)]
    kept = c.decontaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert c.contaminated(df.limit(0), bench).count() == 0 and c.contaminated(df, bench.limit(0)).count() == 0


@needs_tables
def test_recall_against_brute_force(spark):
    from korpusflow.llm.registry import QUERIES

    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontamination"](spark, SF).collect()}
    items = {r.item_id: b" " + b" ".join(c.item_words(r.text)) + b" " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    truth = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = b" " + b" ".join(c.item_words(r.text)) + b" "
        truth |= {(r.doc_id, k) for k, v in items.items() if v in text}
    assert truth and truth <= got


def test_product_equals_its_definition(spark):
    texts = ["a b c a", "b b d", "", None, "c " * 40]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rng = np.random.default_rng(1)
    idf, x = rng.random(1 << c.TERM_BITS), rng.standard_normal((1 << c.TERM_BITS, 3))
    passages = [w[k : k + 4] for t in texts for w in [(t or "").split()] for k in range(0, len(w), 4)]
    want = np.zeros_like(x)
    for p in passages:
        at = c.terms_of(c.word_hashes([w.encode() for w in p]))
        np.add.at(want, at, (idf[at, None] * x[at]).sum(axis=0) * idf[at, None])
    assert np.allclose(c.normal_product(docs, idf, x, 4), want, atol=1e-4)
