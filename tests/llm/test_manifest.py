import hashlib
import random
import zlib

import pytest

from korpusflow.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climbing(leaves):
    """Levels of a tree, and each leaf's siblings as (hash, left) or None where it stands alone."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    ways = []
    for at in range(len(leaves)):
        way = []
        for level in levels[:-1]:
            way.append((level[at ^ 1], at % 2 == 1) if at ^ 1 < len(level) else None)
            at //= 2
        ways.append(way)
    return levels[-1][0], ways


def up(leaf, way):
    for step in way:
        leaf = sha(leaf) if step is None else sha(step[0], leaf) if step[1] else sha(leaf, step[0])
    return leaf


def brute(rows):
    trees = {}
    for doc_id, source, lang, n_chars, text in rows:
        leaf = lambda n: sha(*map(part, (doc_id, source, lang, n, text)))
        hit = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        trees.setdefault(lang, []).append(((doc_id is not None, doc_id or 0), leaf(n_chars), leaf(n_chars + 1) if hit else leaf(n_chars), doc_id))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    done = {x: climbing([leaf for _, leaf, _, _ in sorted(trees[x])]) for x in langs}
    root, tops = climbing([done[x][0] for x in langs]) if langs else (None, [])
    out = []
    for lang, top in zip(langs, tops):
        subroot, ways = done[lang]
        for (_, leaf, changed, doc_id), way in zip(sorted(trees[lang]), ways):
            whole = way + top
            proof = sha(*(s[0] for s in whole if s))
            out.append((doc_id, leaf, subroot, root, proof, up(changed, whole), up(changed, whole) == root))
    return sorted(out, key=str)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def found(spark, rows, step, parts=3):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], COLUMNS + ", root string, pos int").repartition(parts)
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in names) for r in merkle.verified(df, step).collect()), key=str)


def rows_of(n, rng):
    rows = [(rng.choice([None, *range(n)]) if rng.random() < 0.1 else i, rng.choice(["s1", None, "é"]), rng.choice(["en"] * 5 + ["fr", None, "é", "z", ""]), rng.choice([None, 3, 10**12]), rng.choice([None, "", "text é\n" * 3, "x" * 5000])) for i in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize("n, step", [(0, 2), (1, 2), (2, 2), (9, 1), (37, 2), (130, 3), (70, 8)])
def test_trees_proofs_and_tampering_match_brute_force(spark, n, step):
    rows = rows_of(n, random.Random(n))
    assert found(spark, rows, step) == brute(rows)


def test_only_every_few_levels_are_stored(spark):
    rows = [(i, "s", "en", 1, "t") for i in range(100)]
    built = merkle.manifest(spark.createDataFrame(rows, COLUMNS), step=3)
    assert [df.count() for df in built.trees.levels] == [100, 13, 2, 1]
    assert [df.count() for df in built.top.levels] == [1]


def test_a_changed_row_fails_alone(spark):
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(40)]
    got = found(spark, rows, 3)
    tampered = {i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert tampered and {r[0] for r in got if not r[6]} == tampered
