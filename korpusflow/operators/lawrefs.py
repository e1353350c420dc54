"""Which articles of which laws a text cites.

A text is read once as words, numbers and signs. Small readers try, at each place, to take a law ("4857 sayılı ...
Kanun", "... Kanunu (4857)", a law by its name) or articles (numbers before the word for article, or after it). The
reader carries the law that it met last, so an article's law is known when the article is read.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.functions.text import ARTICLE_KINDS, fold

#: Laws by the words before "kanunu", their number and the first day on which the name can mean them.
LAW_NAMES = {
    "türk borçlar": ("6098", "2011-07-04"),
    "hukuk muhakemeleri": ("6100", "2011-02-04"),
    "iş mahkemeleri": ("7036", "2017-10-25"),
    "hukuk uyuşmazlıklarında arabuluculuk": ("6325", "2012-06-22"),
    "sosyal sigortalar ve genel sağlık sigortası": ("5510", "2006-06-16"),
    "sendikalar ve toplu iş sözleşmesi": ("6356", "2012-11-07"),
    "iş sağlığı ve güvenliği": ("6331", "2012-06-30"),
    "türk medeni": ("4721", "2002-01-01"),
    "iş": ("4857", "2003-06-10"),
}
LAW_SHORT_NAMES = {"tbk": "türk borçlar", "hmk": "hukuk muhakemeleri", "tmk": "türk medeni"}
#: A law whose name follows one of these is another one.
OTHER_LAWS = frozenset("basın deniz mahkemeleri federasyonu cumhuriyeti devleti krallığı almanya alman fransa fransız ingiltere rusya amerika birleşik".split())
#: How far before an article its law may end, in characters: at once, or by "of the Law" this far before it.
NEAR, FAR, BACK = 160, 900, 60
#: Paragraphs by their spelled number.
ORDINALS = {w: i for i, w in enumerate("birinci ikinci üçüncü dördüncü beşinci altıncı yedinci sekizinci dokuzuncu onuncu".split(), 1)}
CHANGED = ("değişik", "iptal", "mülga")

LONGEST_NAME = max(len(n.split()) for n in LAW_NAMES)
NAME_WORDS = 12


class Token(NamedTuple):
    text: str
    start: int
    end: int

    @property
    def number(self) -> bool:
        return self.text.isdigit()


class Article(NamedTuple):
    start: int
    label: str
    paragraph: int | None


def folded(text: str | None) -> str:
    """Turkish lower case, straight apostrophes, single spaces."""
    plain = (text or "").replace("İ", "i").replace("I", "ı").replace("’", "'").replace("‘", "'").lower()
    return " ".join(plain.split())


def tokens(text: str) -> list[Token]:
    return [Token(m[0], m.start(), m.end()) for m in re.finditer(r"\d+|[^\W\d_]+|\S", text)]


class Reader:
    """The tokens of one folded text. Each take_* method gives what begins at a place and where it ends, or None."""

    def __init__(self, text: str):
        self.tokens = tokens(text)

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def glued(self, i: int) -> bool:
        """Whether a number goes on from a sign before it, as in a case number."""
        return i > 0 and self.at(i - 1) in ("/", ".") and self.tokens[i - 1].end == self.tokens[i].start

    def is_law_word(self, i: int) -> bool:
        return self.at(i).startswith(("kanun", "yasa"))

    def take_law(self, i: int, decided) -> tuple[str, int] | None:
        """A law's number and the place after its mention. A name after "... sayılı" belongs to the number."""
        word = self.at(i)
        if word.isdigit() and 3 <= len(word) <= 4 and not self.glued(i) and self.at(i + 1).startswith("sayılı"):
            return word, self.end_of_name(i + 2)
        if word in ("kanunu", "yasası"):
            if self.at(i + 1) == "(" and len(self.at(i + 2)) == 4 and self.at(i + 2).isdigit() and self.at(i + 3) == ")":
                return self.at(i + 2), i + 4
            return self.named(i, decided)
        if word in LAW_SHORT_NAMES:
            number, first = LAW_NAMES[LAW_SHORT_NAMES[word]]
            return (number, i + 1) if decided is None or decided >= datetime.date.fromisoformat(first) else None
        return None

    def end_of_name(self, i: int) -> int:
        for k in range(i, min(i + NAME_WORDS, len(self.tokens))):
            if self.tokens[k].number:
                break
            if self.is_law_word(k) or self.at(k) in LAW_SHORT_NAMES:
                return k + 1
        return i

    def named(self, i: int, decided) -> tuple[str, int] | None:
        for n in range(min(LONGEST_NAME, i), 0, -1):
            number, first = LAW_NAMES.get(" ".join(t.text for t in self.tokens[i - n : i]), (None, None))
            if number:
                known = decided is None or decided >= datetime.date.fromisoformat(first)
                return (number, i + 1) if known and self.at(i - n - 1) not in OTHER_LAWS else None
        return None

    def take_item(self, i: int, named: bool = False) -> tuple[str, int | None, int] | None:
        """An article's number, its paragraph after a slash (a letter there is not part of it), and the place after both
        and an ordinal ending. A number that is not named by a word before it must not go on from a sign."""
        number = self.at(i)
        if not number.isdigit() or len(number) > 3 or (not named and self.glued(i)):
            return None
        paragraph, k = None, i + 1
        if self.at(k) == "/" and self.at(k + 1).isdigit() and len(self.at(k + 1)) <= 2:
            paragraph, k = int(self.at(k + 1)), k + 2
        ending = k + 1 if self.at(k) == "'" else k
        if self.at(ending)[1:] in ("nci", "ncı", "ncu", "ncü") or self.at(ending) in ("nci", "ncı", "ncu", "ncü"):
            k = ending + 1
        elif self.at(k) == ".":
            k += 1
        return number, paragraph, k

    def take_paragraph(self, i: int) -> int | None:
        """The paragraph that the words after the word for article name."""
        if self.at(i) == "(" and self.at(i + 1).isdigit() and self.at(i + 2) == ")" and self.at(i + 3) == "numaralı":
            return int(self.at(i + 1)) if self.at(i + 4).startswith("fıkra") else None
        for words in (2, 1):
            if self.at(i + words).startswith("fıkra"):
                number = paragraph_number("".join(self.at(i + k) for k in range(words)))
                if number:
                    return number
        return None

    def take_kind(self, i: int) -> tuple[str, int]:
        """The label prefix of a kind of article (empty without one) and the place after it."""
        for n in (2, 1):
            kind = ARTICLE_KINDS.get(" ".join(self.at(i + k) for k in range(n)))
            if kind:
                return kind[0], i + n
        return "", i

    def take_articles(self, i: int) -> tuple[list[Article], int] | None:
        start = self.tokens[i].start
        prefix, k = self.take_kind(i)
        before = self.take_item(k)
        if before is None:
            word = self.at(k) == "madde" or (self.at(k) in ("m", "md") and self.at(k + 1) == ".")
            after = self.take_item(k + 1 + (self.at(k) != "madde"), True) if word else None
            return ([Article(start, prefix + after[0], after[1])], after[2]) if after else None
        series, k = [before], before[2]
        while self.at(k) in (",", "ve", "ile") and (more := self.take_item(k + 1)):
            series.append(more)
            k = more[2]
        if not self.at(k).startswith("madde"):
            return None
        if self.at(k).startswith("maddeler"):
            return [Article(start, prefix + number, None) for number, _, _ in series], k + 1
        number, paragraph, _ = series[-1]
        return [Article(start, prefix + number, paragraph or self.take_paragraph(k + 1))], k + 1

    def back_reference(self, i: int) -> bool:
        """"Of the Law", which means the one named before."""
        whole = self.at(i) in ("kanunun", "yasanın")
        return whole or (self.at(i) in ("kanun", "yasa") and self.at(i + 1) == "'" and self.at(i + 2) in ("un", "nun", "nın"))

    def read(self, decided=None) -> Iterator[tuple[Article, str | None]]:
        """Each article with its law, or None where no law is near enough."""
        law, law_end, back, i = None, 0, None, 0
        while i < len(self.tokens):
            found = self.take_law(i, decided)
            if found:
                law, i = found
                law_end = self.tokens[i - 1].end
                continue
            articles = self.take_articles(i)
            if articles:
                for a in articles[0]:
                    gap = a.start - law_end
                    near = law and (gap <= NEAR or (gap <= FAR and back is not None and a.start - back <= BACK))
                    yield a, law if near else None
                i = articles[1]
                continue
            if self.back_reference(i):
                back = self.tokens[i].start
            i += 1


def paragraph_number(word: str) -> int | None:
    """birinci is 1, onikinci is 12."""
    if word in ORDINALS:
        return ORDINALS[word]
    return 10 + ORDINALS[word[2:]] if word.startswith("on") and ORDINALS.get(word[2:], 10) < 10 else None


def references(text: str | None, decided=None) -> list[tuple[str, str, int | None]]:
    """(law, article, paragraph) that a text cites, each once, in its order."""
    return list(dict.fromkeys((law, a.label, a.paragraph) for a, law in Reader(folded(text)).read(decided) if law))


def extract_refs(docs: DataFrame) -> DataFrame:
    """id, law, article, paragraph of (id, text, decided): what is near needs places in the text, so texts go to Arrow
    batches. A null text cites nothing; a null decided day allows every name."""

    def run(batches):
        for batch in batches:
            ids, texts, days = (batch.column(k).to_pylist() for k in range(3))
            rows = [(i, *r) for i, text, day in zip(ids, texts, days) for r in references(text, day)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "law", "article", "paragraph"])

    asked = docs.select(F.col("id").cast("string"), "text", F.col("decided").cast("date"))
    return asked.mapInArrow(run, "id string, law string, article string, paragraph int")


def mentioned_articles(docs: DataFrame) -> DataFrame:
    """id, articles: labels cited of whatever law."""

    def run(batches):
        for batch in batches:
            found = [sorted({a.label for a, _ in Reader(folded(t)).read()}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["id", "articles"])

    return docs.select(F.col("id").cast("string"), "text").mapInArrow(run, "id string, articles array<string>")


def annotation_paragraph(text):
    """The paragraph that an amendment note names, as a number: a word for the change, one or two words, "fıkra"."""
    numbers = F.create_map(*(F.lit(x) for w in [*ORDINALS, *(f"on{w}" for w in ORDINALS if w != "onuncu")] for x in (w, paragraph_number(w))))
    words = F.split(fold(text), r"[^\p{L}]+")
    word = lambda i: F.get(words, i)
    named = lambda i: F.when(word(i + 2).startswith("fıkra"), numbers[word(i + 1)]).when(word(i + 3).startswith("fıkra"), numbers[F.concat(word(i + 1), word(i + 2))])
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: word(i).isin(*CHANGED))
    return F.get(F.filter(F.transform(places, named), lambda n: n.isNotNull()), F.lit(0))
