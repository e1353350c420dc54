import random

from korpusflow.llm import lines


def brute(rows, min_words):
    """Delete, for each maximal run that occurs earlier and has min_words words, all its lines."""
    seqs, order = [], sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text in order:
        raw = (text or "").split("\n")
        seqs.append([(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate(raw) if x.strip(" \t\r\x0b\x0c")])
    flat = [[x for _, x in s] for s in seqs]
    out = {}
    for d, (doc_id, text) in enumerate(order):
        gone = set()
        for i in range(len(flat[d])):
            best = 0
            for e in range(d + 1):
                for j in range(len(flat[e]) if e < d else i):
                    n = 0
                    while i + n < len(flat[d]) and j + n < len(flat[e]) and flat[d][i + n] == flat[e][j + n]:
                        n += 1
                    best = max(best, n)
            if sum(len(x.split()) for x in flat[d][i : i + best]) >= min_words:
                gone |= {seqs[d][k][0] for k in range(i, i + best)}
        kept, off = [], False
        for k, x in enumerate((text or "").split("\n")):
            off = (k in gone) if x.strip(" \t\r\x0b\x0c") else off
            if not off:
                kept.append(x)
        out[doc_id] = (text if not gone else "\n".join(kept))
    return out


def corpus():
    rng = random.Random(4)
    pool = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.choice([1, 2, 5, 9, 12]))) for _ in range(40)]
    passages = [[rng.choice(pool) for _ in range(rng.choice([1, 2, 4, 9]))] for _ in range(8)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randrange(1, 6)):
            text += rng.choice(passages) if rng.random() < 0.5 else [" ".join(f"u{d}_{rng.random():.3f}" for _ in range(rng.randrange(1, 9)))]
            if rng.random() < 0.2:
                text.append(" ")
        rows.append((d, "\n".join(text)))
    return rows + [(100, "x y\n" * 12), (101, ""), (102, None), (103, "x y\n" * 3), (None, "\n".join(passages[0] * 3))]


def test_matches_brute_force(spark):
    for min_words in (6, 14, 50):
        rows = corpus()
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {r.doc_id: r.text for r in lines.dedup_lines(df, min_words).collect()}
        want = brute(rows, min_words)
        assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_long_text_and_clashing_names(spark):
    run = [f"line {i} " + " ".join(f"w{k}" for k in range(9)) for i in range(40)]
    text = "\n".join([f"own {i}" for i in range(100_000)] + run + [""] + [f"more {i}" for i in range(5)] + run)
    rows = [(1, text, "a", "b", 1), (2, "\n".join(run), "c", "d", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_hash string, gone string, row int")
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert got[1].text == text[: -len("\n".join(["", *run]))] and got[2].text == ""
    assert (got[1].text_hash, got[1].gone, got[2].row) == ("a", "b", 2) and lines.dedup_lines(df).columns == df.columns


def test_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(2, f"head\n{long}\n\ntail", 9, 1), (1, f"{long}\nother", 9, 2), (1, f"{long}\nother", 9, 2), (3, long, 9, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, line int")
    got = sorted(tuple(r) for r in lines.dedup_lines(df).collect())
    assert got == sorted([(2, "head\ntail", 9, 1), (1, rows[1][1], 9, 2), (1, rows[1][1], 9, 2), (3, "", 0, 3)])
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_names_with_signs(spark):
    import corpus_pipeline

    text = "\n".join(["word " * 60, "other " * 60])
    df = spark.createDataFrame([(1, text, 1, 2), (2, text, 3, 4)], ["doc_id", "text", "a.b", "back`tick"])
    for stage in (corpus_pipeline.delete_repeated_lines, corpus_pipeline.keep_one_of_near_duplicates):
        assert stage(spark, df, None).columns == df.columns
    assert sorted(r["a.b"] for r in lines.dedup_lines(df).collect()) == [1, 3]
