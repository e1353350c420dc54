"""What the header and the outcome of a court decision say, and whether it agrees with what was supplied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusflow.functions.text import parse_date, slug

#: The header is the text from the decision's own title line on, of so many characters: a rule of the feature.
HEADER_CHARS = 6000
OUTCOME_CHARS = 260
NUMBER = r"\d{4}/(?:\d+-)?\d+"
DAY = r"\d{1,2}[./]\d{1,2}[./]\d{4}"
FIELDS = ("chamber", "case_number", "decision_number")


def header(text: Column) -> Column:
    title = F.regexp_instr(text, F.lit(r"(?m)^[ \t]*KARAR[ \t]*$"))
    return F.substring(text, F.greatest(title, F.lit(1)), F.lit(HEADER_CHARS))


def chamber(head: Column) -> Column:
    """The chamber that the first line made of its name alone names, else the first that is named within a line. Its words
    are compared, so signs and spacing between them don't matter."""
    words = lambda x: F.filter(F.split(slug(x), "-"), lambda w: w != "")
    lines = F.transform(F.split(head, "\n", -1), words)
    whole = F.filter(F.transform(lines, lambda w: F.when(F.size(w) <= 3, named_at(w, F.size(w) - 2))), lambda x: x.isNotNull())
    said = words(head)
    within = F.filter(F.transform(F.sequence(F.lit(0), F.size(said)), lambda i: named_at(said, i)), lambda x: x.isNotNull())
    return F.coalesce(F.get(whole, F.lit(0)), F.get(within, F.lit(0)))


def named_at(words: Column, i: Column) -> Column:
    """The chamber whose name has "hukuk" at a place: a chamber's number stands before it; the board has none."""
    at = lambda k: F.get(words, (i + k).cast("int"))
    number = at(-1).try_cast("int")
    one = F.when((at(0) == "hukuk") & (at(1) == "dairesi"), F.concat(F.coalesce(F.concat(number.cast("string"), F.lit(". ")), F.lit("")), F.lit("Hukuk Dairesi")))
    board = F.when((at(-1) == "hukuk") & (at(0) == "genel") & (at(1) == "kurulu"), "Hukuk Genel Kurulu")
    return F.when(i >= 0, F.coalesce(one, board))


def spaced(head: Column) -> Column:
    """The header with single spaces, without "no" and colons: a label is then followed by its value."""
    return F.regexp_replace(F.regexp_replace(head, r"(?iu)\bno\b\.?|[:：]", " "), r"\s+", " ")


def labelled(head: Column, labels: str, value: str) -> Column:
    """The value that comes first after one of the labels."""
    return F.nullif(F.regexp_extract(spaced(head), rf"(?iu)(?<!\p{{L}})(?:{labels}) ?({value})", 1), F.lit(""))


def outcome_date(text: Column) -> Column:
    """The last day on which, by the text, the court decided: the text is cut at its days, and what follows a day counts."""
    days = F.regexp_extract_all(text, F.lit(DAY), F.lit(0))
    after = F.slice(F.split(text, DAY, -1), 2, F.size(days))
    decided = lambda x: F.regexp_like(x, F.lit(rf"(?isu)^\s*(?:tarihinde|gününde).{{0,{OUTCOME_CHARS}}}?\bkarar\s+verildi"))
    hits = F.filter(F.zip_with(days, after, lambda d, x: F.when(decided(x), d)), lambda d: d.isNotNull())
    return F.when(F.size(hits) > 0, F.element_at(hits, -1))


def court_metadata(docs: DataFrame) -> DataFrame:
    """document_id, authority, chamber, case_number, decision_number, document_date, and the extracted_* values, of
    (document_id, text) with what was supplied (authority, chamber, ..., document_date; nulls for none)."""
    head = header(F.col("text"))
    found = {"chamber": chamber(head), "case_number": labelled(head, r"esas|e\.", NUMBER), "decision_number": labelled(head, r"karar|k\.", NUMBER)}
    day = parse_date(F.coalesce(outcome_date(F.col("text")), labelled(head, "(?:karar )?tarihi?", DAY)))
    return docs.select(
        "document_id", F.coalesce("authority", F.lit("Yargıtay")).alias("authority"), *(F.coalesce(x, F.col(c)).alias(c) for c, x in found.items()),
        F.coalesce(day, F.col("document_date").cast("date")).alias("document_date"), *(x.alias(f"extracted_{c}") for c, x in found.items()),
    )


def metadata_conflicts(extracted: DataFrame, supplied: DataFrame) -> DataFrame:
    """document_id, field, rule, expected, actual: fields that differ in more than spacing and case, and, for documents
    whose supplied `complete` is true, fields without a value."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    both = extracted.join(supplied.select("document_id", "complete", *(F.col(c).alias(f"supplied_{c}") for c in FIELDS)), "document_id")
    differ = [F.when(plain(F.col(f"supplied_{c}")) != plain(F.col(f"extracted_{c}")), F.struct(F.lit(c).alias("field"), F.lit("differs").alias("rule"), F.col(f"supplied_{c}").alias("expected"), F.col(f"extracted_{c}").alias("actual"))) for c in FIELDS]
    none = F.lit(None).cast("string")
    lacking = [F.when(F.coalesce("complete", F.lit(False)) & F.col(c).isNull(), F.struct(F.lit(c).alias("field"), F.lit("missing").alias("rule"), none.alias("expected"), none.alias("actual"))) for c in (*FIELDS, "document_date")]
    return both.select("document_id", F.explode(F.array_compact(F.array(*differ, *lacking))).alias("x")).select("document_id", "x.*")
