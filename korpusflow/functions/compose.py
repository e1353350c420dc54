"""Canonical composition (NFC) in expressions. The tables follow from the character database by a rule; a text is touched
only where a combining mark, or a character that is never used composed, stands in it.

There each letter with its marks is taken apart, the marks are put in the order of their classes, and the letter takes those
marks that compose with it and are not blocked by another of the same class. Letters that compose with letters (Hangul jamo,
some vowel signs of Indic scripts) are left as they are."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How often a character can be taken apart in two.
ROUNDS = 3
#: A text's distinct clusters that are looked up by a walk over them; with more, each cluster is composed by itself.
LOOKED_UP = 128
HANGUL = range(0xAC00, 0xD7A4)


class Tables(NamedTuple):
    marks: str  # a pattern's class of the characters with a combining class
    never: str  # and of those that composed text doesn't have
    single: tuple[str, str]  # characters that stand for another one
    pairs: tuple[str, str, str]  # characters, and the two that each is made of
    classes: tuple[str, str]  # marks, and a character with the number of their class
    composed: str  # letter and mark, a colon, and what they become, with commas between


def in_class(chars: list[str]) -> str:
    """A pattern's character class, as ranges of code points."""
    out, begin, last = [], None, None
    for code in [*sorted(map(ord, chars)), None]:
        if last is not None and code != last + 1:
            out.append(f"\\x{{{begin:X}}}" + (f"-\\x{{{last:X}}}" if last > begin else ""))
            begin = code
        begin, last = begin if begin is not None else code, code
    return "".join(out)


@lru_cache(maxsize=1)
def tables() -> Tables:
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and c not in HANGUL]
    marks = [c for c in every if unicodedata.combining(c)]
    parts = {c: "".join(chr(int(x, 16)) for x in d.split()) for c in every if (d := unicodedata.decomposition(c)) and not d.startswith("<")}
    single = {c: unicodedata.normalize("NFC", c) for c in parts if len(unicodedata.normalize("NFC", c)) == 1 and unicodedata.normalize("NFC", c) != c}
    never = [c for c in parts if len(unicodedata.normalize("NFC", c)) > 1]
    two = {c: p for c, p in parts.items() if len(p) == 2}
    composed = ",".join(f"{p}:{c}" for c, p in two.items() if unicodedata.combining(p[1]) and unicodedata.normalize("NFC", p) == c)
    join = lambda x: "".join(x)
    return Tables(
        in_class(marks), in_class(never), (join(single), join(single.values())), (join(two), join(p[0] for p in two.values()), join(p[1] for p in two.values())),
        (join(marks), join(chr(unicodedata.combining(c)) for c in marks)), composed,
    )


def taken_apart(chars: Column) -> Column:
    whole, first, second = tables().pairs
    apart = lambda c: F.array_compact(F.array(F.translate(c, whole, first), F.nullif(F.translate(c, whole, second), c)))
    for _ in range(ROUNDS):
        chars = F.flatten(F.transform(chars, apart))
    return chars


def together(letter: Column, mark: Column) -> Column:
    """What a letter and a mark become, or null. The table is one literal, made of its text when the plan is."""
    return F.try_element_at(F.expr(f"str_to_map('{tables().composed}', ',', ':')"), F.concat(letter, mark))


def composed_cluster(cluster: Column) -> Column:
    """A letter and its marks in canonical composition."""
    def of_class(c: Column) -> Column:
        number = F.translate(c, *tables().classes)
        return F.when(number == c, 0).otherwise(F.ascii(number))

    placed = F.transform(taken_apart(F.regexp_extract_all(cluster, F.lit("(?s)."), F.lit(0))), lambda c, i: F.struct(of_class(c).alias("class"), i.alias("i"), c.alias("c")))
    begin = F.struct(F.lit("").alias("letter"), F.lit("").alias("rest"), F.lit(0).alias("class"))

    def step(state, mark):
        one = F.when((state["letter"] != "") & ((state["rest"] == "") | (state["class"] < mark["class"])), together(state["letter"], mark["c"]))
        first = (state["letter"] == "") & (state["rest"] == "") & (mark["class"] == 0)
        letter = F.when(first, mark["c"]).otherwise(F.coalesce(one, state["letter"]))
        stays = ~first & one.isNull()
        return F.struct(letter.alias("letter"), F.when(stays, F.concat(state["rest"], mark["c"])).otherwise(state["rest"]).alias("rest"), F.when(stays, mark["class"]).otherwise(state["class"]).alias("class"))

    return F.aggregate(F.array_sort(placed), begin, step, lambda s: F.concat(s["letter"], s["rest"]))


def once(value: Column, body) -> Column:
    """body of a value that is worked out once for a row, however often the body's own lambdas read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def composed_clusters(clusters: Column) -> Column:
    """from and to for each cluster of a text, to being its canonical composition: few are distinct, and each of those is
    composed once."""
    both = lambda c, to: F.struct(c.alias("from"), to.alias("to"))

    def looked_up(all_of: Column) -> Column:
        def by_map(few: Column) -> Column:
            known = F.map_from_arrays(few, F.transform(few, composed_cluster))
            own = F.transform(all_of, lambda c: both(c, F.when(c == "", c).otherwise(composed_cluster(c))))
            return F.when(F.size(few) <= LOOKED_UP, once(known, lambda m: F.transform(all_of, lambda c: both(c, m[c])))).otherwise(own)

        return once(F.array_distinct(all_of), by_map)

    return once(clusters, looked_up)


def among(chars: str, least: int = 0x300) -> str:
    """A pattern for the characters of a class that has none below a code point: plain letters are told apart by that alone."""
    return f"[\\x{{{least:X}}}-\\x{{10FFFF}}&&[{chars}]]"


def compose(text: Column) -> Column:
    """The text in canonical composition; null for null."""
    t = tables()
    mark, never = among(t.marks), among(t.never)
    letter = f"[\\x{{0}}-\\x{{2FF}}[^{t.marks}]]"
    # Letters below all marks are passed in one run, but for the last where a higher one follows.
    pattern = rf"(?s)(?:[\x{{0}}-\x{{2FF}}]+(?![\x{{300}}-\x{{10FFFF}}]))?(?:({never}{mark}*|{letter}{mark}+|{mark}+)|.|\z)"
    plain = F.when(text.rlike(among(in_class(list(t.single[0])))), F.translate(text, *t.single)).otherwise(text)

    def joined(of: Column) -> Column:
        pieces, clusters = (F.regexp_extract_all(of, F.lit(pattern), F.lit(group)) for group in (0, 1))
        apart = F.zip_with(pieces, composed_clusters(clusters), lambda p, c: F.when(c["from"] == "", p).otherwise(F.concat(F.substring(p, F.lit(1), F.length(p) - F.length(c["from"])), c["to"])))
        return F.array_join(apart, "")

    whole = once(plain, joined)
    needs = text.rlike(among(f"{t.never}{t.marks}{in_class(list(t.single[0]))}"))
    return F.when(needs, whole).otherwise(text)
