import random
import unicodedata

from pyspark.sql import functions as F

from korpusflow.functions.compose import compose, tables
from korpusflow.functions.text import normalize


def test_equals_the_standard(spark):
    rng = random.Random(1)
    marks = [chr(c) for c in range(0x300, 0x370)] + ["ͅ", "̣", "़", "ִ", "゙"]
    letters = list("abceioun AEIOU αωι") + list("éüñệǖḗᾳᾂ가각か क") + ["Å", "̈́", "क़", "ﬡ"]
    rows = [unicodedata.normalize(f, s) for s in ("Tiếng Việt è é ệ ǭ ᾂ", "Çağ Ağrı ŞİŞ", "ǖ̌ ç̣̇") for f in ("NFC", "NFD")] + ["", "́", "̣́a"]
    rows += ["".join(rng.choice(letters) + "".join(rng.choices(marks, k=rng.choice([0, 0, 1, 1, 2, 3]))) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in [*rows, None]], "t string").select("t", compose(F.col("t")).alias("c"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        assert r.c == (None if r.t is None else unicodedata.normalize("NFC", r.t)), [hex(ord(x)) for x in r.t or ""]


def test_every_character_that_is_made_of_others(spark):
    whole = list(tables().pairs[0]) + list(tables().single[0])
    df = spark.createDataFrame([(c, unicodedata.normalize("NFD", c)) for c in whole], "c string, d string")
    out = df.select("c", compose(F.col("c")).alias("x"), compose(F.col("d")).alias("y")).collect()
    wrong = [r.c for r in out if not r.x == unicodedata.normalize("NFC", r.c)]
    assert not wrong
    parted = [r.c for r in out if r.y != unicodedata.normalize("NFC", r.c)]
    # Only vowel signs that compose with letters are left.
    assert all(len(unicodedata.normalize("NFD", c)) > 1 and not unicodedata.combining(unicodedata.normalize("NFD", c)[1]) for c in parted) and len(parted) < 60


def test_normalized_text_is_composed(spark):
    row = spark.createDataFrame([("é  x\r\n\r\n\r\n\r\ny",)], "t string").select(normalize(F.col("t"))).first()
    assert row[0] == "é x\n\ny"


def test_distinct_clusters_are_composed_once_whatever_their_number(spark):
    few = "abc e\u0301\n" * 300 + "жa\u0323\u0302ж文\n"
    many = "".join(f"{chr(97 + i % 26)}{chr(0x300 + i // 26)}x文" for i in range(26 * 12))
    long = "ж" * 50_000 + "e\u0301" + "a" * 50_000
    df = spark.createDataFrame([(x,) for x in (few, many, long, "\n", "e\u0301\n", "\u0301\n\n")], "t string").select("t", compose(F.col("t")).alias("c"))
    assert "map_from_arrays" in df._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.c == unicodedata.normalize("NFC", r.t) for r in df.collect())
