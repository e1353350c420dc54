"""Change events from the notes in a text of law: what a note says was added, amended, repealed or annulled, and from when.

Only finding the notes needs places in the text, so only that runs in Arrow batches, by a walk over the text from one
opening word to the next. What a note means is read by column expressions, and its unit is the smallest that holds it.
"""

from __future__ import annotations

import datetime
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusflow.functions.dates import ONES
from korpusflow.functions.text import slug
from korpusflow.operators import lawrefs
from korpusflow.operators.relational import smallest_container

#: What may stand between a note's opening word and its colon (other openings: anything short), the court,
#: and limits in characters.
BETWEEN = {"ek": ("", "fıkra", "cümle"), "mülga": ("",), "yeniden düzenleme": ("",)}
COURT = "anayasa mahkemesi"
BEFORE_COLON, BODY, COURT_BODY, AFTER_RULING = 40, 700, 1600, 350
#: What a note changes, by a word of it, in order of preference.
TARGETS = (("ibare", "phrase"), ("cumle", "sentence"), ("fikra", "paragraph"), ("bent", "item"), ("madde", "article"))
OPENING_WORD = re.compile(r"(?<!\w)(?:(?:ek|değişik|mülga|iptal|yeniden\s+düzenleme)(?=[\s:])|anayasa\s+mahkemesi)")
NOTE = "document_id string, event_index int, char_start int, char_end int, raw_annotation string"


def lowered(text: str) -> str:
    """Turkish lower case of unchanged length."""
    return text.replace("İ", "i").replace("I", "ı").lower()


def end_of_note(text: str, opening: str, after: int) -> int | None:
    """Where the note whose opening word ends at a place ends itself: a few words more, a colon, and a body up to a
    bracket or semicolon."""
    colon = text.find(":", after, after + BEFORE_COLON + 2)
    between = " ".join(lowered(text[after:colon]).split())
    if colon < 0 or any(c in "();" for c in between) or between not in BETWEEN.get(" ".join(opening.split()), (between,)):
        return None
    stops = [p for c in ";()" if (p := text.find(c, colon + 1)) >= 0]
    end = min([*stops, colon + 1 + BODY, len(text)])
    return end if len(text[colon + 1 : end].strip()) >= 3 else None


def end_of_ruling(text: str, lower: str, at: int, inside: int | None) -> int | None:
    """Where a ruling of the court ends: with its bracket, or else with the sentence that annuls, after the numbers of the
    case and the decision, and the next one if that says when it takes effect."""
    if inside is not None:
        close = text.find(")", at)
        return close if 0 < close - at <= COURT_BODY and "(" not in text[at:close] and "iptal" in lower[at:close] else None
    again = lower.find(COURT, at + len(COURT))
    limit = min([x for x in (again, at + COURT_BODY, len(text)) if x > 0])
    numbers = [m.end() for m in re.finditer(r"\d{4}/\d+", text[at:limit])]
    ruling = lower.find("ipta", at + numbers[1], limit) if len(numbers) > 1 else -1
    if ruling < 0:
        return None
    stop = text.find(".", ruling, limit)
    if stop < 0:
        return limit if limit == len(text) else None
    following = text.find(".", stop + 1, stop + AFTER_RULING)
    sentence = lower[stop + 1 : following] if following > 0 else ""
    return following + 1 if sentence.lstrip().startswith("bu karar") and "yürürlüğe gir" in sentence else stop + 1


def notes_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the notes of a text, in order and apart from each other."""
    lower, out, at = lowered(text), [], 0
    for m in OPENING_WORD.finditer(lower):
        start = m.start()
        if start < at:
            continue
        opened = text.rfind("(", 0, start)
        inside = opened if opened >= 0 and not text[opened + 1 : start].strip() else None
        end = end_of_ruling(text, lower, start, inside) if lower.startswith("anayasa", start) else end_of_note(text, m[0], m.end())
        if end is not None:
            out.append((start, end))
            at = end
    return out


def find_notes(docs: DataFrame) -> DataFrame:
    """document_id, event_index, char_start, char_end, raw_annotation of (document_id, text). A null text has none."""

    def run(batches):
        for batch in batches:
            rows = [(d, i, a, b, t[a:b].strip()) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, (a, b) in enumerate(notes_of(t or ""))]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in NOTE.split(", ")])

    return docs.select(F.col("document_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, NOTE)


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


READ = "source_law_number string, source_law_article string, case_number string, decision_number string, event_date date, official_gazette_date date, delay_months int, named date"
#: Months by their words; twelve is the one number of two words that notes have.
MONTHS = {w: n for n, w in enumerate([*ONES[1:], "on"], 1)}
#: Characters between the gazette's name and its date, and between a date and "takes effect".
TO_GAZETTE_DATE, TO_EFFECT = 100, 60


class Note:
    """A note as words, numbers and signs, from which each fact is taken where it stands."""

    def __init__(self, text: str):
        self.tokens = lawrefs.tokens(lawrefs.folded(text))
        self.end = next((i for i in range(len(self.tokens)) if self.later(i)), len(self.tokens))

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def later(self, i: int) -> bool:
        """Whether "months later" stands here."""
        return self.at(i) == "ay" and self.at(i + 1) == "sonra"

    def pair(self, i: int) -> str | None:
        """A year, a slash and a number."""
        whole = len(self.at(i)) == 4 and self.at(i).isdigit() and self.at(i + 1) == "/" and self.at(i + 2).isdigit()
        return f"{self.at(i)}/{self.at(i + 2)}" if whole else None

    def day(self, i: int) -> datetime.date | None:
        """Day, month and year with slashes; None if there is no such day."""
        parts = [self.at(i + k) for k in (0, 2, 4)]
        if self.at(i + 1) == self.at(i + 3) == "/" and all(p.isdigit() for p in parts) and len(parts[0]) <= 2 and len(parts[1]) <= 2 and len(parts[2]) == 4:
            try:
                return datetime.date(*map(int, reversed(parts)))
            except ValueError:
                return None
        return None

    def dated(self, i: int) -> bool:
        return self.at(i).isdigit() and self.at(i + 1) == self.at(i + 3) == "/" and len(self.at(i + 4)) == 4 and not (self.at(i - 1) == "/" and self.at(i - 2).isdigit())

    def numbered(self, letter: str, begin: int) -> tuple[str, int] | None:
        """The number after a letter ("E.: 2013/5"), and the place after it."""
        for i in range(begin, len(self.tokens)):
            if self.at(i) == letter:
                k = i + 1
                while self.at(k) in (".", ":", "："):
                    k += 1
                if found := self.pair(k):
                    return found, k + 3
        return None

    def law(self) -> tuple[str | None, str | None]:
        """Law and article after the day of a change ("-6111/12 md.")."""
        for i in range(len(self.tokens)):
            if self.at(i) == "-" and (found := self.pair(i + 1)) and self.at(i + 4).startswith(("md", "maddesi")):
                return tuple(found.split("/"))
        return None, None

    def rulings(self) -> tuple[str | None, str | None]:
        case = self.numbered("e", 0)
        decision = self.numbered("k", case[1]) if case else None
        return (case[0], decision[0]) if decision else (None, None)

    def gazette(self) -> datetime.date | None:
        """The first day after the gazette's name, before "months later"."""
        for i in range(self.end):
            if self.at(i).startswith("gazete") and self.at(i - 1) in ("resmî", "resmi"):
                number = next((k for k in range(i + 1, self.end) if self.at(k).isdigit()), None)
                if number is not None and self.tokens[number].start - self.tokens[i].end <= TO_GAZETTE_DATE and (day := self.day(number)):
                    return day
        return None

    def delay(self) -> int | None:
        before = self.at(self.end - 1) if self.end < len(self.tokens) else ""
        if before == "iki" and self.at(self.end - 2) == "on":
            return 12
        return int(before) if before.isdigit() else MONTHS.get(before)

    def named(self) -> datetime.date | None:
        """The day in brackets after "months later", if it is said to be when the change takes effect."""
        for i in range(self.end, len(self.tokens)):
            if self.later(i) and self.at(i + 2) == "(" and self.at(i + 8) == ")" and (day := self.day(i + 3)):
                close = self.tokens[i + 8].end
                for k in range(i + 9, len(self.tokens)):
                    if self.at(k) == "." or self.tokens[k].start - close > TO_EFFECT + 2:
                        break
                    if self.at(k) == "yürürlüğe" and self.at(k + 1).startswith("gir"):
                        return day
        return None

    def read(self) -> tuple:
        first = next((i for i in range(len(self.tokens)) if self.dated(i)), None)
        return (*self.law(), *self.rulings(), self.day(first) if first is not None else None, self.gazette(), self.delay(), self.named())


def read_raw(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([Note(x or "").read() for x in raw], columns=[c.split()[0] for c in READ.split(", ")], dtype=object)


def read_notes(notes: DataFrame) -> DataFrame:
    """What notes (raw_annotation) say: event_type, target_type, authority, source law and article, case and decision,
    event, gazette and effective dates, delay_months."""
    plain = slug(F.col("raw_annotation"))
    court = plain.contains(slug(F.lit(COURT)))
    target = F.coalesce(*(F.when(plain.contains(word), kind) for word, kind in TARGETS), F.lit("unit"))
    kind = F.when(court | plain.startswith("iptal"), "annulled").when(plain.startswith("mulga"), "repealed").when(plain.startswith("ek"), "added").otherwise("amended")
    authority = F.when(court, "Anayasa Mahkemesi").otherwise("Türkiye Büyük Millet Meclisi")
    told = notes.select("*", kind.alias("event_type"), target.alias("target_type"), authority.alias("authority"), F.pandas_udf(read_raw, READ)("raw_annotation").alias("__read"))
    read = told.select(*(c for c in told.columns if c != "__read"), "__read.*")
    return read.withColumn("effective_from", F.coalesce("named", F.add_months("official_gazette_date", F.col("delay_months")))).drop("named")


def extract_events(docs: DataFrame, units: DataFrame) -> DataFrame:
    """Events of (document_id, text), each with the smallest unit (document_id, unit_key, char_start, char_end) around its
    note. An event that names its source, in a known unit, is accepted; others are for review."""
    read = read_notes(find_notes(docs))
    spans = units.select("document_id", F.col("char_start").alias("us"), F.col("char_end").alias("ue"), F.col("unit_key").alias("legal_unit_key"))
    linked = smallest_container(read, spans, ["document_id"], "char_start", "event_index", "us", "ue", "legal_unit_key")
    sourced = F.col("source_law_number").isNotNull() | F.col("case_number").isNotNull() | (F.col("event_type") == "repealed")
    confidence = F.when(F.col("legal_unit_key").isNotNull() & sourced, 0.9).otherwise(0.7)
    delayed = (F.col("authority") == "Anayasa Mahkemesi") & ((F.col("target_type") != "unit") | F.col("delay_months").isNotNull())
    return linked.withColumn("confidence", confidence).withColumn("review_status", F.when(F.col("confidence") >= 0.9, "accepted").otherwise("needs_review")).withColumn("effect_requires_review", delayed)


def article_changes(documents: DataFrame, units: DataFrame, events: DataFrame, refs: DataFrame) -> DataFrame:
    """law, article and the events of each referenced article: refs (law, article, unit) meet the documents whose title
    begins with the law's number, and of their events those whose unit has the referenced one in its path."""
    laws = documents.select("document_id", F.col("title").alias("law_title"), first_group(F.col("title"), r"^(\d+) sayılı ").alias("law")).filter("law is not null")
    paths = units.select("document_id", F.col("unit_key").alias("legal_unit_key"), "unit_path", F.explode(F.array_distinct("unit_path")).alias("unit"))
    dated = events.filter("event_date is not null")
    asked = refs.select("law", "article", "unit").distinct().join(laws, "law")
    return asked.join(paths, ["document_id", "unit"]).join(dated, ["document_id", "legal_unit_key"]).select("law", "article", "law_title", *dated.columns, "unit_path")
