import random
import re
from collections import Counter

import pytest

from korpusflow.llm import divergence


def brute(rows, least=3, ranks=200):
    rows = [(text or "", lang or "", source or "") for text, lang, source in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [[t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)] for text, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, counts = Counter(), {}
        for (_, at, source), found in zip(rows, terms):
            if at == lang:
                docs.update(set(found))
                counts.setdefault(source, Counter()).update(found)
        kept = [t for t, n in docs.items() if n >= least]

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + len(kept)) for t in kept}

        whole = shares(sum(counts.values(), Counter()))
        own = {s: shares(c) for s, c in counts.items()}
        f = lambda p, q: (p - q) * (p - q) // q
        for s in own:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in own if o != s]
            words = [(f(own[s][t], whole[t]), t) for t in kept if counts[s][t] and own[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", words, ranks)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(items[:most], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, p int, value string").repartition(3)


def corpus(seed, n=200):
    rng = random.Random(seed)
    words = ["a", "B", "b", "été", "É", "naïve", "x1y", "don't", "ß", "語", "the", "The", "zz_top"] + [f"{x}{y}" for x in "abcdefgh" for y in "klmnop"]
    text = lambda: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randrange(0, 60)))
    rows = [(rng.choice([text(), text() * 9, "", None]), rng.choice(["en"] * 4 + ["fr", None, ""]), rng.choice(["s1"] * 3 + ["s2", "s3", "é", None])) for _ in range(n)]
    return rows + rows[:5] + [("123 -- _", "de", "s1"), (None, "de", "s2"), ("only once", "de", "s3")]


@pytest.mark.parametrize("seed", [1, 2])
def test_values_and_ranks_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = sorted(tuple(r) for r in divergence.source_divergence(table(spark, rows)).collect())
    assert got == brute(rows)
    assert any(r[0] == "de" and r[4] == 0 for r in got)  # a language that keeps no term


def test_small_buckets_and_ranks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BUCKET", 3)
    monkeypatch.setattr(divergence, "SLICE", 64)
    rows = corpus(3, 80)
    got = sorted(tuple(r) for r in divergence.source_divergence(table(spark, rows), ranks=4).collect())
    assert got == brute(rows, ranks=4)


def test_empty_table(spark):
    assert divergence.source_divergence(table(spark, corpus(1, 3)).limit(0)).count() == 0


def test_levels_are_disjoint_sets_of_terms(spark):
    rows = corpus(4)
    counted = divergence.term_counts(divergence.text_groups(table(spark, rows))).groupBy("lang", "source", "term").sum("n", "docs").toDF("lang", "source", "term", "n", "docs")
    kept = counted.drop("docs").join(divergence.kept_terms(counted, 3), ["lang", "term"]).selectExpr("*", "1L as p", "1L as p0")
    maps = divergence.bitmaps(kept).collect()
    assert sum(bin(r.bits & (1 << 64) - 1).count("1") for r in maps) == kept.count()
    seen = {}
    for r in maps:
        key = (r.lang, r.bucket, r.word, r.source)
        assert not seen.get(key, 0) & r.bits
        seen[key] = seen.get(key, 0) | r.bits
