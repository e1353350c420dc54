import random
import re

from korpusflow.llm import minhash
from korpusflow.llm.components import connected_components


def brute(rows, size, percent):
    sets = {}
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        s = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets[doc_id] = s
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(d, len(sets[d]), root(d), root(d) == d) for d in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, bases = [], [[rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 6, 20, 60, 200]))] for _ in range(25)]
    for i in range(260):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i * 7, " ".join(words).upper() if i % 9 == 0 else "\n".join(words)))
    return rows + [(5001, ""), (5002, None), (5003, " \t\n"), (5004, "one"), (5005, "ONE"), (5006, "x y z"), (5007, "x y z")]


def test_components_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {tuple(r) for r in minhash.near_duplicates(df, size=4).collect()}
    assert got == brute(rows, 4, 80)


def test_large_group_of_near_copies_that_miss_the_star(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):  # each copy changes its own words, so many pairs of copies fall under the limit
        words = list(base)
        for _ in range(3):
            words[rng.randrange(len(words))] = f"n{i}_{rng.random()}"
        rows.append((i, " ".join(words)))
    got = {tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert got == brute(rows, 4, 80)


def test_defined_cases(spark):
    rows = [(None, "a b c d e", 1), (1, "a b c d e", 2), (1, "a b c d e", 3), (2, "A b c d e", 4), (3, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 1, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7), (5, 200), (1000, 1001), (1000, 1001), (None, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict.fromkeys([*range(41), 200], 0) | dict.fromkeys([98, 99, 100], 98) | dict.fromkeys([1000, 1001], 1000)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_all_texts_of_one_id_are_linked(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(12)) for k in "abcdef"}
    rows = [(1, "a"), (3, "b"), (5, "a"), (5, "b"), (5, "c"), (8, "c"), (9, "d"), (9, "e"), (9, "f"), (7, "e"), (6, "f"), (20, "d"), (30, "b"), (9, "d")]
    df = spark.createDataFrame([(i, text[k]) for i, k in rows], "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df, size=4).collect()}
    assert got == {(i, 1 if i in (1, 3, 5, 8, 30) else 6, i in (1, 6)) for i, _ in rows}


def test_words_that_collide_as_polynomials_differ():
    import numpy as np
    import pyarrow as pa

    from korpusflow.llm.common import polynomials, token_hashes

    bits = [bin(i).count("1") % 2 for i in range(2048)]
    pair = pa.array(["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits), "x", "x"], pa.large_string())
    same, apart = polynomials(pair), token_hashes(pair)
    assert same[0] == same[1] and apart[0] != apart[1] and apart[2] == apart[3] and len(np.unique(apart)) == 3
