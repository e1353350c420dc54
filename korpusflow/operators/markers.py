"""Where the units of a text of law begin: a walk over its lines that carries what the lines before have opened.

A line is read as words, numbers and signs. It may open a container (book, part, chapter, section), an article of one of
five kinds (with a number, a range, or none; the number may stand on the next line), an annex, or, inside an article, a
paragraph, an item or, after an item, a sub-item; the words after an article's header count as a line of their own. From the
line on that says that what follows is not part of the law (provisions that could not be worked in, the list of amending
laws), nothing is read any more.
"""

from __future__ import annotations

import re
from functools import cached_property, lru_cache
from itertools import islice
from typing import NamedTuple

#: Containers and their levels; articles by the words before "MADDE"; notes that may follow an article's
#: number; annexes by what stands after "SAYILI"; limits in characters.
LEVELS = {"KITAP": (1, "book"), "KISIM": (2, "part"), "BÖLÜM": (3, "chapter"), "AYIRIM": (4, "section")}
ARTICLE_TYPES = {
    (): "article", ("EK",): "additional_article", ("GEÇICI",): "temporary_article", ("EK", "GEÇICI"): "additional_temporary_article",
    ("MÜKERRER",): "repeated_article",
}
PREFIXES = sorted(ARTICLE_TYPES, key=len, reverse=True)
ARTICLE_BEGINS = {"MADDE", "M", *(p[0] for p in PREFIXES if p)}
NOTES = ("MÜLGA", "EK", "DEĞIŞIK", "IPTAL")
SCHEDULES = ("CETVEL", "LISTE")
#: What a law could not take in, and the list of what changed it, by the words after "... SAYILI KANUN".
LEFT_OUT = ("IŞLENEMEYEN GEÇICI MADDELER", "IŞLENEMEYEN KANUN HÜKMÜNDE KARARNAME HÜKÜM", "IŞLENEMEYEN KANUN HÜKÜM", "IŞLENEMEYEN HÜKÜM", "EK VE DEĞIŞIKLIK GETIREN MEVZUATIN")
CHANGED_BY = "EK VE DEĞIŞIKLIK YAPAN MEVZUATIN"
BEFORE_LAW_NUMBER, NEAR_HEADING, LONGEST_HEADING, LONGEST_RANGE = 100, 240, 160, 2000
#: Signs that a header has at most.
HEADER_SIGNS = 16
#: Fixed value: the most signs that a child's header has, and one after it.
CHILD_SIGNS = 4
DASHES = ("-", "–", "—")
METADATA, ARTICLE, PARAGRAPH, ITEM, SUBITEM = 9, 5, 6, 7, 8


class Marker(NamedTuple):
    start: int
    level: int
    unit_type: str
    label: str | None
    last: int | None = None
    heading: str | None = None
    represented: list[str] | None = None
    repaired: bool = False


class Sign(NamedTuple):
    text: str  # in capitals, with one letter for all of i
    raw: str
    start: int
    end: int


def capitals(text: str) -> str:
    return text.replace("i", "I").replace("ı", "I").replace("İ", "I").upper()


#: Signs come again and again, so their capitals are kept; a bounded number of them.
sign_capitals = lru_cache(1 << 14)(capitals)


def short_capitals(sign: str) -> str:
    return sign_capitals(sign) if len(sign) <= 40 else capitals(sign)


SIGN = re.compile(r"\d+|[^\W\d_]+|\S")
#: The first two signs of a line.
HEAD = re.compile(rf"\s*({SIGN.pattern})\s*({SIGN.pattern})?")
#: A number in brackets, or a sign before a bracket, with white space or the line's end after it.
CHILD = re.compile(rf"\s*(?:(\()\s*({SIGN.pattern})\s*\)|({SIGN.pattern})\))(?=\s|\Z)")


class Line:
    """One line of a text from a place on, as signs: the first of them, as no header is longer, or all where a law is
    named."""

    def __init__(self, text: str, start: int, most: int | None = None):
        self.text, self.start, self.most = text, start, most

    @cached_property
    def names_law(self) -> bool:
        return "SAYILI" in capitals(self.text)

    @cached_property
    def head(self) -> tuple[str, str]:
        """The first two signs in capitals: they tell of most lines that they open nothing."""
        found = HEAD.match(self.text)
        first, second = found.groups("") if found else ("", "")
        return short_capitals(first), short_capitals(second)

    @cached_property
    def signs(self) -> list[Sign]:
        found = SIGN.finditer(self.text)
        return [Sign(short_capitals(m[0]), m[0], m.start(), m.end()) for m in islice(found, self.most or (None if self.names_law else HEADER_SIGNS))]

    def ends_in_list(self) -> bool:
        return re.split(r"\W", capitals(self.text.rstrip()))[-1] == "LISTE"

    def at(self, i: int) -> str:
        return self.signs[i].text if 0 <= i < len(self.signs) else ""

    def raw(self, i: int) -> str:
        return self.signs[i].raw if 0 <= i < len(self.signs) else ""

    def spaced(self, i: int) -> bool:
        """Whether white space stands before a sign."""
        return 0 < i < len(self.signs) and self.signs[i - 1].end < self.signs[i].start

    def words(self, i: int, n: int) -> tuple[str, ...]:
        return tuple(self.at(k) for k in range(i, i + n))

    def rest(self, i: int) -> Line:
        """What stands from a sign on, for a child's header to be looked for."""
        begin = self.signs[i].start if i < len(self.signs) else len(self.text)
        return Line(self.text[begin:], self.start + begin, CHILD_SIGNS)

    def take_number(self, i: int) -> tuple[str, int, bool] | None:
        """A number, perhaps with a letter in place of its 1, in two parts, or with a letter after a slash; the place
        after it, and whether it had to be put right."""
        k, digits, whole = i, "", True
        if self.raw(k) in ("l", "I", "ı", "İ"):
            digits, k, whole = "1", k + 1, False
        if self.at(k).isdigit() and (not digits or not self.spaced(k)):
            digits, k = digits + self.at(k), k + 1
        if not digits:
            return None
        if self.at(k).isdigit():
            digits, k, whole = digits + self.at(k), k + 1, False
        if self.at(k) == "/" and not self.spaced(k) and len(self.at(k + 1)) == 1 and self.at(k + 1).isalpha() and not self.spaced(k + 1):
            return f"{digits}/{self.at(k + 1)}", k + 2, not whole
        return digits, k, not whole

    def take_dash(self, i: int) -> int | None:
        return i + 1 if self.at(i) in DASHES else None

    def is_open(self, i: int) -> bool:
        """Whether an article's header may end here without a dash."""
        noted = self.at(i) == "(" and self.at(i + 1) in NOTES
        return i >= len(self.signs) or noted or (self.spaced(i) and self.at(i)[0].isalpha())


def article_words(line: Line) -> tuple[tuple[str, ...], int] | None:
    """The words before "MADDE" (also "M ADDE"), and the place after it."""
    if line.at(0) not in ARTICLE_BEGINS:
        return None
    for prefix in PREFIXES:
        k = len(prefix)
        if k and prefix[0] != line.at(0):
            continue
        if line.words(0, k) == prefix:
            if line.at(k) == "MADDE":
                return prefix, k + 1
            if line.words(k, 2) == ("M", "ADDE"):
                return prefix, k + 2
    return None


def range_labels(first: str, last: str) -> list[str]:
    """The numbers from one to another, and the last one's letter form; none if that is no range."""
    number, _, letter = last.partition("/")
    if not first.isdigit() or not 0 <= int(number) - int(first) <= LONGEST_RANGE:
        return []
    return [str(n) for n in range(int(first), int(number) + 1)] + ([last] if letter else [])


def take_range(line: Line, i: int) -> tuple[str, int] | None:
    """The end of a range and the place after its header."""
    if line.at(i) == "ILA" and (found := line.take_number(i + 1)):
        after = line.take_dash(found[1]) or (found[1] if line.is_open(found[1]) and line.at(found[1]) != "(" else None)
        return (found[0], after) if after is not None else None
    if (k := line.take_dash(i)) and (found := line.take_number(k)):
        after = line.take_dash(found[1]) or (found[1] if line.at(found[1]) == "(" else None)
        return (found[0], after) if after is not None else None
    return None


def take_article(line: Line, following: Line | None) -> tuple[Marker, Line] | None:
    """An article that a line opens, and what of the line (or of the next one, if the number stands there) comes after its
    header."""
    begun = article_words(line)
    if begun is None:
        return None
    (prefix, k), unit_type, start = begun, ARTICLE_TYPES[begun[0]], line.start + line.signs[0].start
    if k >= len(line.signs) and following is not None:
        line, k = following, 0
    found = line.take_number(k)
    if found is None:
        after = line.take_dash(k) if prefix and prefix != ("MÜKERRER",) else None
        return (Marker(start, ARTICLE, unit_type, None), line.rest(after)) if after else None
    label, k, repaired = found
    if ranged := take_range(line, k):
        labels = range_labels(label, ranged[0])
        last = int(ranged[0].partition("/")[0]) if labels else None
        return Marker(start, ARTICLE, unit_type, label, last, None, labels or None, repaired), line.rest(ranged[1])
    after = line.take_dash(k + 1 if line.at(k) == "." else k) or (k if line.is_open(k) else None)
    return (Marker(start, ARTICLE, unit_type, label, repaired=repaired), line.rest(after)) if after is not None else None


def take_container(line: Line) -> Marker | None:
    if len(line.signs) == 2 and line.at(1) in LEVELS and line.at(0).isalnum():
        level, unit_type = LEVELS[line.at(1)]
        return Marker(line.start + line.signs[0].start, level, unit_type, line.raw(0))
    return None


def take_annex(line: Line) -> Marker | None:
    """EK alone or with a number, a numbered schedule or list (Roman numbers), or a numbered tariff."""
    label = None
    if line.at(0) == "EK":
        k = 2 if line.at(1) in DASHES else 1
        if line.at(k).isdigit():
            label = line.text[line.signs[0].start : line.signs[k].end]
        elif len(line.signs) == 1:
            label = line.raw(0)
    elif line.signs:
        k = 1 if line.at(0) == "(" else 0
        roman = bool(line.at(k)) and set(line.at(k)) <= set("IVXLCDM")
        n = k + 1 + (line.at(k + 1) == ")")
        if line.at(n) == "SAYILI" and ((roman and line.at(n + 1) in SCHEDULES) or (line.at(k).isdigit() and k == 0 and line.at(n + 1) == "TARIFE")):
            label = line.text[line.signs[0].start : line.signs[n + 1].end]
    return Marker(line.start + line.signs[0].start, 1, "annex", " ".join(label.split())) if label else None


def ends_law(line: Line, following: Line | None) -> bool:
    """Whether a line says that the law's own text is over."""
    for i in range(len(line.signs) - 1 if line.names_law else 0):
        if line.at(i).isdigit() and 3 <= len(line.at(i)) <= 4 and line.at(i + 1) == "SAYILI" and line.signs[i].start <= BEFORE_LAW_NUMBER:
            k = i + 2 + (line.at(i + 2) == "ANA")
            said = " ".join(s.text for s in line.signs[k + 1 : k + 7])
            if line.at(k) == "KANUNA" and said.startswith(LEFT_OUT):
                return True
            if i == 0 and line.at(2) == "KANUNDA" and said.startswith(CHANGED_BY) and (line.ends_in_list() or (following is not None and following.ends_in_list())):
                return True
    return False


def take_child(line: Line, item_seen: bool) -> Marker | None:
    """A paragraph "(1)", an item "a)" or, after an item, a sub-item "1)" or "iv)", with white space or the line's end after
    it."""
    found = CHILD.match(line.text)
    if found is None:
        return None
    if found[2] is not None:
        return Marker(line.start + found.start(1), PARAGRAPH, "paragraph", found[2]) if found[2].isdigit() else None
    label, start = found[3], line.start + found.start(3)
    if len(label) == 1 and label.isalpha() and label == label.lower():
        return Marker(start, ITEM, "item", label)
    if item_seen and (label.isdigit() or set(label) <= set("ivxlcdm")):
        return Marker(start, SUBITEM, "subitem", label)
    return None


def is_marked(line: Line) -> bool:
    return (line.head[1] in LEVELS or line.head[0] in ARTICLE_BEGINS) and (take_container(line) is not None or take_article(line, None) is not None)


def heading_after(lines: list[Line], i: int) -> str | None:
    """The line that names a container: the next with text, near enough and short."""
    for line in lines[i + 1 :]:
        if line.start - lines[i].start - len(lines[i].text) > NEAR_HEADING:
            return None
        if line.head[0]:
            title = line.text.strip()
            return None if len(title) > LONGEST_HEADING or is_marked(line) else title
    return None


def heading_before(lines: list[Line], i: int) -> str | None:
    """The line that names an article: the last one with text, near enough, short, and not the end of a sentence."""
    for line in reversed(lines[max(0, i - NEAR_HEADING) : i]):
        if lines[i].start - line.start > NEAR_HEADING:
            return None
        if line.head[0]:
            title = line.text.strip()
            return None if len(title) > LONGEST_HEADING or title[-1] in ".;:)" or is_marked(line) else title
    return None


def lines_of(text: str) -> list[Line]:
    lines, at = [], 0
    for part in text.split("\n"):
        lines.append(Line(part, at))
        at += len(part) + 1
    return lines


def markers_of(text: str) -> list[Marker]:
    """The markers of a text, in order, each at a place of its own; what stands before the first is metadata."""
    lines, out, names_law = lines_of(text), [], "SAYILI" in capitals(text)
    in_article = item_seen = False
    passed = -1  # the line whose signs an article's header has used
    for i, line in enumerate(lines):
        if i == passed:
            continue
        # Where no law is named, a line with a child's header is nothing else, and most others show by their first signs
        # that they open nothing.
        if not (names_law and line.names_law):
            if in_article and (child := take_child(line, item_seen)):
                out.append(child)
                item_seen = item_seen or child.level == ITEM
                continue
            if line.head[0] not in ARTICLE_BEGINS and line.head[1] not in LEVELS:
                continue
        following = next((x for x in lines[i + 1 : i + 2]), None)
        if ends_law(line, following):
            out.append(Marker(line.start + line.signs[0].start, 1, "annex", "supplement", None, line.text.strip()))
            break
        if container := take_container(line):
            out.append(container._replace(heading=heading_after(lines, i)))
            in_article = False
        elif opened := take_article(line, following):
            marker, rest = opened
            out.append(marker._replace(heading=heading_before(lines, i)))
            passed = i + 1 if following is not None and rest.start >= following.start else -1
            in_article, item_seen = True, False
            if child := take_child(rest, False):
                out.append(child)
                item_seen = child.level == ITEM
        elif annex := take_annex(line):
            out.append(annex)
            in_article = False
        elif in_article and (child := take_child(line, item_seen)):
            out.append(child)
            item_seen = item_seen or child.level == ITEM
    if out and text[: out[0].start].strip():
        out.insert(0, Marker(0, METADATA, "metadata", "document"))
    return out


class Unit(NamedTuple):
    marker: Marker
    end: int
    path: list[str]


def nested(markers: list[Marker], length: int) -> list[Unit]:
    """Each marker with its end (where the next of its level or above begins) and its path, by one pass with a stack of
    what is open. A marker without a label takes its number in the text."""
    ends, paths, opened = [length] * len(markers), [], []
    for i, m in enumerate(markers):
        while opened and markers[opened[-1]].level >= m.level:
            ends[opened.pop()] = m.start
        own = f"{m.unit_type}:{m.label if m.label is not None else i}"
        paths.append([*(paths[opened[-1]] if opened else []), own])
        opened.append(i)
    return [Unit(m, end, path) for m, end, path in zip(markers, ends, paths)]
