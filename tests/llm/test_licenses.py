import random
import re

import pytest

from korpusflow.llm import licenses
from korpusflow.llm.licenses import NOTICES, PHRASES, Notice


def words_of(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))


def brute(text, notices=NOTICES, percent=80, step=64):
    words = words_of(text)
    starts, base = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += here
        base |= {label} if here else set()
    met = []
    for k in range(max(1, -(-len(words) // step))):
        block = set(words[k * step : (k + 2) * step])
        for n in notices:
            own = set(words_of(n.text))
            if 100 * len(own & block) >= percent * len(own) and set(n.must) <= block:
                met.append((k * step, n.label, len(own & block) / len(own)))
    labels = base | {label for _, label, _ in met}
    score = 1.0 if starts else max((c for _, _, c in met), default=0.0)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score), met


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def corpus():
    rng = random.Random(5)
    filler = "the of software is licensed été and 語 to any person use copy modify free version 3 public gnu mit apache cc by nc 4 0".split()
    odd = ["", None, "CC BY", "cc-by cc by CC_BY", "mit  License\nMIT LICENSE", "gnu general public licenses", "xmit license", "İMIT License", "Gnu.General.Public.License", "  ", "---"]
    rows = [*odd]
    for _ in range(150):
        text = rng.choices(filler, k=rng.randrange(0, 400))
        for _ in range(rng.randrange(0, 3)):
            kept = [w for w in rng.choice(NOTICES).text.split() if rng.random() < rng.choice([1, 0.9, 0.75])]
            at = rng.randrange(0, len(text) + 1)
            text[at:at] = kept
        rows.append(rng.choice([" ", "\n", ", "]).join(text))
    return [(i, t) for i, t in enumerate(rows)] + [(None, "MIT License"), (7, "mit license"), (7, "mit license")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, words string, key int").repartition(3)


def test_labels_places_and_scores_match_brute_force(spark):
    rows = corpus()
    got = sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in licenses.licenses(table(spark, rows)).collect()), key=str)
    want = sorted(((d, *brute(t)[0]) for d, t in rows), key=str)
    assert got == want
    assert len({r[6] for r in want}) > 10 and any(r[5] != r[6] for r in want)


def test_every_block_that_meets_a_notice_is_found_once(spark):
    rows = corpus()
    got = sorted(((r.doc_id, r.first_word, r.label, round(r.containment, 9)) for r in licenses.license_blocks(table(spark, rows)).collect()), key=str)
    assert got == sorted(((d, k, label, round(c, 9)) for d, t in rows for k, label, c in brute(t)[1]), key=str)


def test_other_thresholds_and_steps(spark):
    notices = (Notice("a", "one two three four five"), Notice("b", "two four six eight", ("six",)), Notice("c", "one"))
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("one two three four five six seven eight nine ten".split(), k=rng.randrange(0, 40)))) for i in range(60)]
    for percent in (50, 100):
        got = sorted((r.doc_id, *(r[c] for c in COLUMNS)) for r in licenses.licenses(table(spark, rows), notices, percent=percent, step=5).collect())
        assert sorted(str(x) for x in got) == sorted(str((d, *brute(t, notices, percent, 5)[0])) for d, t in rows)


def test_defined_cases(spark):
    assert licenses.licenses(table(spark, corpus()).limit(0)).count() == 0
    long = "word " * 300_000 + NOTICES[6].text + " word" * 1000
    got = licenses.licenses(table(spark, [(1, long)])).first()
    assert (got.n_words, got.labels, got.score) == (len(words_of(long)), "mit", 1.0) and got.n_base == 0
    with pytest.raises(ValueError):
        licenses.licenses(table(spark, [(1, "x")]), (Notice("long", "word " * 70),))


def test_no_python_on_the_path(spark):
    text = licenses.licenses(table(spark, corpus()[:5]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
