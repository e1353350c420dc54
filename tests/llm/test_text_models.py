import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from korpusflow.llm import ppm, quality, toxicity
from korpusflow.llm.ngrams import Grams

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def base_brute(text):
    words = (text or "").encode().split()
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_base_counts():
    rng = random.Random(1)
    texts = [None, "", " \n\n ", "a", "a b c d e f g h", "a b c d e f g h a b c d e f g h i", "x\nx\n \n\nx y\nx", "é ß # <b> |", "w " * 500]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(80)]
    got = quality.base_counts(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base_brute(text), text


def test_sparse_and_dense_scores_agree():
    grams = Grams(pa.array(["the cat sat", "", "a", None, "über die Brücke the the cat"], pa.string()))
    w = np.random.default_rng(0).standard_normal(1 << 18)
    assert np.allclose(grams.scores(w), [float((w[a] * v).sum()) for a, v in grams.sparse()])


@needs_tables
def test_quality_query(spark):
    from korpusflow.llm.registry import QUERIES

    got = {r.doc_id: r for r in QUERIES["op4_quality"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_brute(text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    judged = [(got[r.doc_id], r.quality) for r in labels if r.doc_id in got and not got[r.doc_id].base_failed]
    assert sum(g.kept == (q == 1) for g, q in judged) / len(judged) > 0.95


def test_quality_defined_cases(spark):
    rows = [(None, "a b", 1), (1, None, 2), (2, "word " * 30, 3), (2, "word " * 30, 3), (3, " ".join(map(str, range(40))), 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(3, 1), (3, 1), (None, 0), (9, None)], "doc_id long, quality int")
    got = quality.score(df, quality.train(df, labels)).collect()
    assert len(got) == 5 and [r.kept for r in got if r.doc_id == 3] == [True]
    assert quality.score(df.limit(0), quality.train(df.limit(0), labels.limit(0))).count() == 0


class BrutePpm:
    """The textbook definition, byte by byte, over dictionaries."""

    def __init__(self, texts, order):
        self.order, self.seen = order, [{} for _ in range(order + 1)]
        for t in texts:
            raw = b"\n" * order + ppm.canonical(t)
            for i in range(order, len(raw)):
                for k in range(order + 1):
                    self.seen[k].setdefault(raw[i - k : i], Counter())[raw[i]] += 1

    def log10(self, text):
        raw, total = b"\n" * self.order + ppm.canonical(text), 0.0
        for i in range(self.order, len(raw)):
            refused = set()
            for k in range(self.order, -1, -1):
                here = self.seen[k].get(raw[i - k : i])
                if here is None:
                    continue
                left = {s: n for s, n in here.items() if s not in refused}
                weight = sum(left.values()) + len(left)
                if raw[i] in left:
                    total += math.log10(left[raw[i]] / weight)
                    break
                if left:
                    total += math.log10(len(left) / weight)
                refused = set(here)
            else:
                total -= math.log10(max(1, 256 - len(self.seen[0].get(b"", ()))))
        return total


def test_ppm_matches_definition(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the", "then", "zu", "Über", "no!", "x"]) for _ in range(rng.randrange(0, 30)))) for i in range(80)] + [(900, None), (901, "qqq 日本 zz"), (None, "the"), (901, "qqq 日本 zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    import zlib

    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    training = [t for d, t in rows if not held(d)]
    words = Counter()
    for t in training:
        words.update([*(t or "").encode().lower().split(), None])
    n, v = sum(words.values()), len(words)
    model = BrutePpm(training, ppm.ORDER)
    for top, nodes in ((400_000, 1_000_000), (2, 40), (0, 0)):  # the bounds of the tables change no score
        got = ppm.score(df, top_words=top, hot_nodes=nodes).collect()
        assert len(got) == len(rows)
        want = {}
        for d, t in rows:
            tokens = [*(t or "").encode().lower().split(), None]
            want[d] = (held(d), len(tokens), sum(words[w] > 0 for w in tokens), n, sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), model.log10(t))
        for r in got:
            w = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
            assert r.base_score == pytest.approx(w[4], abs=1e-6) and r.score == pytest.approx(w[5], abs=1e-6)
    assert ppm.score(df.limit(0)).count() == 0


@needs_tables
def test_toxicity_held_out(spark):
    from korpusflow.llm.registry import QUERIES

    got = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    pairs = [(got[k].predicted, t) for k, t in labels.items() if k in got and got[k].held_out]
    assert sum(p == t for p, t in pairs) / len(pairs) > 0.95 and sum(p and t for p, t in pairs) >= 0.8 * sum(t for _, t in pairs)


def test_deobfuscation(spark):
    df = spark.createDataFrame([(1, "the worthless idiot said these idle words to the moron and a loser " * 40)], "doc_id long, text string")
    channel = toxicity.Channel(toxicity.letter_counts(df))
    assert [channel.restore(w) for w in ("1d10t", "m0r0n", "idiiiiot", "l.o.s.e.r", "w0rthl3ss", "words")] == ["idiot", "moron", "idiot", "loser", "worthless", "words"]
    assert [channel.restore(toxicity.core(w, toxicity.bare(w))) for w in ("!diot", "(loser!)", "m-o-r-o-n", "2024")] == ["idiot", "loser", "moron", "2024"]
    texts = ["you i d i o t !", "an i d 1 0 t here", "1 * d * i * o * t", "a b", None, "", "| a | 1 | 2 |"]
    restored = toxicity.Restored(pa.array(texts, pa.string()), channel)
    assert [t.split() for t in restored.texts()[:5]] == [["you", "idiot"], ["an", "idiot", "here"], ["idiot"], ["a", "b"], []]


def test_lattice_against_all_paths(spark):
    df = spark.createDataFrame([(1, "an idle idiot sat on his old boat and lost it " * 5)], "doc_id long, text string")
    channel = toxicity.Channel(toxicity.letter_counts(df))

    def every(word, i=0):
        """All output strings of a word with the channel's cost."""
        if i == len(word):
            yield "", 0.0
            return
        c = word[i]
        stretched = i and word[i - 1] == c and (word[i - 2 : i - 1] == c or word[i + 1 : i + 2] == c)
        options = [(c, 0.0)] + [(x, toxicity.SWAP_COST) for x in toxicity.LOOKALIKES.get(c, "")]
        if stretched:
            options.append(("", toxicity.STRETCH_COST))
        elif (c in toxicity.SEPARATORS and i) or c in toxicity.SIGNS:
            options.append(("", toxicity.DROP_COST))
        for rest, cost in every(word, i + 1):
            for x, extra in options:
                yield x + rest, cost + extra

    def model(word):
        codes = [0, 0, *(toxicity.INDEX.get(c, toxicity.OTHER) for c in word), 0]
        return sum(channel.cost[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:]))

    rng = random.Random(5)
    for word in ["1d10t", "i.d.i.o.t", "b0@t", "!d!ot", "iiidiot", "a$$", "455", "s4t", "|ost"] + ["".join(rng.choice("ids0145!|.-aot$") for _ in range(rng.randrange(1, 7))) for _ in range(60)]:
        costs = sorted((cost + model(x), x) for x, cost in every(word))
        assert channel.decode(word) in {x for v, x in costs if v < costs[0][0] + 1e-9}, word


def test_fragments_are_joined():
    lexicon = toxicity.Lexicon(toxicity.polynomials(pa.array(["idiot", "worthless"], pa.large_string())))
    channel = toxicity.Channel(np.ones((toxicity.SYMBOLS,) * 3))
    texts = pa.array(["such an id iot", "wor th less man", "id", "iot idiot", None, "worth", "less"], pa.string())
    got = toxicity.Restored(texts, channel, lexicon).texts()
    assert got == ["such an idiot", "worthless man", "id", "iot idiot", "", "worth", "less"]  # no word reaches over two texts


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_toxicity_recall_of_held_out_rows(spark):
    from korpusflow.llm.registry import QUERIES

    sf = "/root/testdata/sf0.1"
    judged = QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in judged.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * n[0, 0]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_quality_of_held_out_rows(spark):
    """Trained on four folds of the labels, judged on the fifth."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter("pmod(doc_id, 5) = 0")
    found = quality.score(docs.join(held.select("doc_id"), "doc_id", "left_semi"), quality.train(docs, labels.join(held, "doc_id", "left_anti")))
    judged = found.drop("quality").join(held, "doc_id").filter("not base_failed").selectExpr("kept = (quality = 1) as right").groupBy("right").count().collect()
    n = {r.right: r["count"] for r in judged}
    assert n[True] >= 0.98 * (n[True] + n.get(False, 0))


def test_quality_labels_that_contradict(spark):
    rows = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{k}" for k in range(30))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = [(i, i % 2) for i in range(40)]
    right = spark.createDataFrame(plain, "doc_id long, quality int")
    mixed = spark.createDataFrame(plain + [(0, 1), (0, 1)], "doc_id long, quality int")  # the smallest counts
    a, b = ({r.doc_id: r.kept for r in quality.score(df, quality.train(df, x)).collect()} for x in (right, mixed))
    assert a == b == {i: i % 2 == 1 for i in range(40)}


def test_toxicity_defined_cases(spark):
    rows = [(None, "an idiot", 1), (1, None, 2), (2, "", 3), (2, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.predictions(df, toxicity.train(df, none)).collect()
    assert len(got) == 4 and all(r.predicted == 0 and 0 <= r.score <= 1 for r in got)
    assert toxicity.without_toxic(df, toxicity.train(df, none)).columns == ["doc_id", "text", "score"]
    assert toxicity.predictions(df.limit(0), toxicity.train(df.limit(0), none)).count() == 0
