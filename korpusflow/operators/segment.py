"""Segmentation: one document to many units and chunks. Only finding markers and cutting pieces needs places in the text,
so only that runs in Arrow batches; intervals, hierarchy and keys are windows and expressions."""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusflow.functions.text import drop_boilerplate, join_wrapped_lines, readable_letters, turkish_lower
from korpusflow.operators.markers import Marker, Unit, markers_of, nested

#: Abbreviations, limits in characters.
ABBREVIATIONS = frozenset("av dr prof doç yrd md mad vd vb vs bkz s sy no nr ltd şti a.ş t.c tic san cad sok mah apt e k hmk tbk ik tmk hgk ygk ibk ör yy hd cd".split())
CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZÇĞİÖŞÜ")
TARGET_CHARS, MAX_CHARS, OVERLAP_CHARS, MIN_SECTION_CHARS = 1400, 2000, 200, 400
MARKERS = "document_id string, start int, level int, unit_type string, label string, last int, heading string"
UNITS = MARKERS + ", represented array<string>, repaired boolean, unit_index int, end int, unit_path array<string>, text string"
#: Rows of units that a batch holds at most: a unit's text is part of its parent's, so a long text gives much of it.
BATCH_UNITS = 2000


def kept_columns(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return [(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]


def in_batches(schema: str, rows_of):
    """A mapInArrow function: the rows that rows_of gives for each row of (document_id, text, ...), some at a time."""

    def run(batches):
        columns = kept_columns(schema)
        for batch in batches:
            rows = (r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in rows_of(*row))
            while some := list(itertools.islice(rows, BATCH_UNITS)):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], t) for k, (_, t) in enumerate(columns)], [n for n, _ in columns])

    return run


def scan_markers(docs: DataFrame) -> DataFrame:
    """document_id, start, level, unit_type, label, last (of a range), heading of (document_id, text) rows."""
    found = lambda d, t: ((d, m.start, m.level, m.unit_type, m.label, m.last, m.heading) for m in markers_of(t or ""))
    return docs.select(F.col("document_id").cast("string"), F.col("text").cast("string")).mapInArrow(in_batches(MARKERS, found), MARKERS)


def unit_rows(document_id, text, given=None):
    text = text or ""
    found = markers_of(text) if given is None else [Marker(*(x[c] for c in ("start", "level", "unit_type", "label", "last", "heading"))) for x in given]
    for i, (m, end, path) in enumerate(nested(found, len(text)), 1):
        body = text[m.start : end].rstrip()
        yield document_id, m.start, m.level, m.unit_type, m.label, m.last, m.heading, m.represented, m.repaired, i, m.start + len(body), path, body


def unit_keys(found: list[Unit]) -> list[str]:
    """The key of each unit of a text, as `units` gives it: one that comes again gets ~2, ~3."""
    seen: dict[str, int] = {}
    out = []
    for unit in found:
        key = "/".join(unit.path)
        seen[key] = seen.get(key, 0) + 1
        out.append(key if seen[key] == 1 else f"{key}~{seen[key]}")
    return out


def units(docs: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """Units with interval, text, key, parent and path. A unit ends where the next of its level or above begins; its
    parent is the nearest unit above of a lower level; a key that comes again gets ~2, ~3 and is for review. Markers,
    nesting and texts come from one pass over each text; given markers (as scan_markers has them) replace its own."""
    texts = docs.select(F.col("document_id").cast("string"), F.col("text").cast("string"))
    if markers is not None:
        fields = [c for c, _ in kept_columns(MARKERS)[1:]]
        by_text = markers.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("given"))
        texts = texts.join(by_text, "document_id").select("document_id", "text", "given")
    found = texts.mapInArrow(in_batches(UNITS, unit_rows), UNITS)
    key = F.array_join("unit_path", "/")
    parent = F.when(F.size("unit_path") > 1, F.array_join(F.slice("unit_path", F.lit(1), F.size("unit_path") - 1), "/"))
    again = F.row_number().over(Window.partitionBy("document_id", "unit_key").orderBy("unit_index"))
    numbered = found.withColumn("unit_key", key).withColumn("parent_key", parent).withColumn("n", again)
    repeated = F.col("n") > 1
    named = F.when(repeated, F.concat("unit_key", F.lit("~"), F.col("n").cast("string"))).otherwise(F.col("unit_key"))
    return numbered.select(
        "document_id", "unit_index", "unit_type", "label", "last", "heading", "represented", "repaired", "unit_path", F.col("start").alias("char_start"), F.col("end").alias("char_end"),
        "text", named.alias("unit_key"), "parent_key", F.when(repeated, "needs_review").otherwise("parsed").alias("review_status"), F.sha2("text", 256).alias("content_hash"),
    )


#: The title of a bibliography, and a heading's level and unit type by the shape of its label.
BIBLIOGRAPHY = "YARARLANILAN KAYNAKLAR"
CHAPTER_LINE = r"^(BİRİNCİ|İKİNCİ|ÜÇÜNCÜ|DÖRDÜNCÜ|BEŞİNCİ|ALTINCI|YEDİNCİ|SEKİZİNCİ|DOKUZUNCU|ONUNCU)\s+BÖLÜM$"
DOCTRINE_LEVELS = {"chapter": 1, "section": 2, "part": 3, "paragraph": 4, "item": 5}


def doctrine_lines(docs: DataFrame) -> DataFrame:
    """document_id, start, line, no: the lines of (document_id, text) that have text, with their places."""
    lines = docs.select(F.col("document_id").cast("string"), F.posexplode(F.split("text", "\n", -1)).alias("at", "raw"))
    upto = Window.partitionBy("document_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("begin", F.coalesce(F.sum(F.length("raw") + 1).over(upto), F.lit(0)))
    some = placed.withColumn("line", F.trim(F.regexp_replace("raw", r"\s+", " "))).filter("line <> ''")
    start = F.col("begin") + F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))
    return some.select("document_id", start.cast("int").alias("start"), "line", F.row_number().over(Window.partitionBy("document_id").orderBy("at")).alias("no"))


def doctrine_markers(docs: DataFrame, body_start: DataFrame | None = None) -> DataFrame:
    """Markers (as scan_markers gives) of the headings of a book: chapters, topics (§), Roman, lettered and lower-case
    ones, after body_start (document_id, start) and before the bibliography. A chapter's title is the next of three lines
    in capitals."""
    lines = doctrine_lines(docs)
    order = Window.partitionBy("document_id").orderBy("no")
    bounds = lines.filter(F.col("line") == BIBLIOGRAPHY)
    if body_start is not None:
        lines = lines.join(body_start.select(F.col("document_id").cast("string"), F.col("start").alias("body")), "document_id", "left").filter(F.col("start") >= F.coalesce("body", F.lit(0))).drop("body")
        bounds = bounds.join(body_start.select(F.col("document_id").cast("string"), F.col("start").alias("body")), "document_id", "left").filter(F.col("start") >= F.coalesce("body", F.lit(0)))
    ends = bounds.groupBy("document_id").agg(F.min("start").alias("bibliography"))
    capitals = lambda k: F.when((F.upper(F.lead("line", k).over(order)) == F.lead("line", k).over(order)) & ~F.lead("line", k).over(order).startswith("§"), F.lead("line", k).over(order))
    label = lambda pattern: F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))
    roman, title = label(r"^([IVXLCDM]+)\. +\S"), F.regexp_extract("line", r"^\S+ +(.+)$", 1)
    unit_type = (
        F.when(label(CHAPTER_LINE).isNotNull(), "chapter").when(F.col("line").rlike(r"^§\s*\S"), "section").when(roman.isNotNull() & (F.upper(title) == title), "part")
        .when(label(r"^([A-ZÇĞİÖŞÜ])\. +\S").isNotNull(), "paragraph").when(label(r"^([a-zçğıöşü])\) +\S").isNotNull(), "item")
    )
    levels = F.create_map(*(F.lit(x) for pair in DOCTRINE_LEVELS.items() for x in pair))
    heading = F.when(F.col("unit_type") == "chapter", F.concat_ws(" — ", "line", F.coalesce(*(capitals(k) for k in (1, 2, 3))))).when(F.col("unit_type") == "section", F.regexp_replace("line", r"^§\s*\d*\s*\.?\s*", "")).otherwise(title)
    named = F.coalesce(label(CHAPTER_LINE), label(r"^§\s*(\d+)"), label(r"^([^\s.)]+)[.)]"), F.lit(""))
    found = lines.withColumn("unit_type", unit_type).withColumn("heading", heading).withColumn("label", named).filter("unit_type is not null")
    kept = found.join(ends, "document_id", "left").filter(F.col("bibliography").isNull() | (F.col("start") < F.col("bibliography")))
    return kept.select("document_id", "start", levels[F.col("unit_type")].alias("level"), "unit_type", "label", F.lit(None).cast("int").alias("last"), "heading")


def doctrine_units(docs: DataFrame, body_start: DataFrame | None = None) -> DataFrame:
    """Units of a book with retrieval_eligible. What stands before the body and the bibliography are units of their own,
    of type metadata, that retrieval leaves out."""
    rows = docs.select(F.col("document_id").cast("string"), "text")
    markers = doctrine_markers(docs, body_start)
    outside = lambda start, label: start.select("document_id", F.col("start").cast("int").alias("start"), F.lit(1).alias("level"), F.lit("metadata").alias("unit_type"), F.lit(label).alias("label"), F.lit(None).cast("int").alias("last"), F.lit(None).cast("string").alias("heading"))
    last_body = (body_start.select(F.col("document_id").cast("string"), F.col("start").alias("body")) if body_start is not None else rows.select("document_id", F.lit(0).alias("body")))
    bibliography = doctrine_lines(docs).filter(F.col("line") == BIBLIOGRAPHY).join(last_body, "document_id", "left").filter(F.col("start") >= F.coalesce("body", F.lit(0))).groupBy("document_id").agg(F.min("start").alias("start"))
    extra = outside(bibliography, "bibliography")
    if body_start is not None:
        extra = extra.unionByName(outside(rows.join(last_body.filter("body > 0"), "document_id").select("document_id", F.lit(0).alias("start")), "front_matter"))
    return units(docs, markers.unionByName(extra)).withColumn("retrieval_eligible", F.col("unit_type") != "metadata")


def structure_audit(found: DataFrame, expectations: DataFrame) -> DataFrame:
    """Per document: required article numbers that are missing, those that come twice, numbers outside the range, passed.
    expectations: document_id, first, last, labels array<string>."""
    articles = found.filter("unit_type = 'article'")
    represented = articles.withColumn("all", F.coalesce("represented", F.when(F.col("label").isNotNull(), F.array("label"))))
    by_document = represented.groupBy("document_id").agg(F.array_distinct(F.flatten(F.collect_list("all"))).alias("have"), F.array_sort(F.collect_set(F.when(F.col("review_status") == "needs_review", F.col("label")))).alias("duplicated"))
    joined = expectations.join(by_document, "document_id", "left")
    have = F.coalesce("have", F.array().cast("array<string>"))
    wanted = F.array_union(F.transform(F.sequence("first", "last"), lambda x: x.cast("string")), F.coalesce("labels", F.array().cast("array<string>")))
    outside = F.filter(have, lambda x: x.rlike(r"^\d+$") & ~x.try_cast("int").between(F.col("first"), F.col("last")))
    return joined.select("document_id", F.array_except(wanted, have).alias("missing"), F.coalesce("duplicated", F.array().cast("array<string>")).alias("duplicated"), outside.alias("unexpected")).withColumn("passed", (F.size("missing") == 0) & (F.size("duplicated") == 0) & (F.size("unexpected") == 0))


def paragraphs(docs: DataFrame) -> DataFrame:
    """document_id, part, text: a text cut at blank lines; parts without text are left out."""
    parts = docs.select("document_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("part", "text"))
    return parts.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter("text <> ''")


#: Headers of a decision's sections, and the kinds of those that have several names.
SECTION_HEADERS = (
    "HUKUKİ KAVRAMLAR", "HUKUKİ KONULAR", "ANAHTAR KELİMELER", "ÖZET", "İDDİA", "DAVA", "DAVACI İSTEMİ", "DAVACININ İSTEMİ", "SAVUNMA", "CEVAP", "DAVALI CEVABI", "DAVALININ CEVABI",
    "YARGILAMA SÜRECİ", "UYUŞMAZLIK", "İLK DERECE MAHKEMESİ KARARI", "BÖLGE ADLİYE MAHKEMESİ KARARI", "İSTİNAF", "ÖZEL DAİRE BOZMA KARARI", "BOZMA VE BOZMADAN SONRAKİ YARGILAMA SÜRECİ",
    "DİRENME KARARI", "TEMYİZ", "GEREKÇE", "HUKUKİ DEĞERLENDİRME", "SONUÇ", "HÜKÜM", "KARAR",
)
SECTION_KINDS = {"davacının istemi": "davacı_istemi", "davalının cevabı": "davalı_cevabı", "hukuki değerlendirme": "gerekçe"}


def section_header(line: Column) -> Column:
    """The header that a line consists of, without a Roman number before it and a colon after it; else null."""
    bare = F.rtrim(F.regexp_replace(F.trim(line), r"\s*:$", ""))
    first = F.substring_index(bare, " ", 1)
    number = F.translate(squeezed_capitals(F.translate(first, ".)", "")), "IVXLCDM", "") == ""
    rest = F.ltrim(F.substr(bare, F.length(first) + 1))
    known = F.create_map(*(F.lit(x) for h in SECTION_HEADERS for x in (h.replace("İ", "I"), h)))
    return F.coalesce(known[squeezed_capitals(bare)], F.when(number & first.rlike(r"[.)]$"), known[squeezed_capitals(rest)]))


def sections(docs: DataFrame) -> DataFrame:
    """document_id, part, section, text of a decision (document_id, text): from one header line to the next, by the kind of
    the header; what comes before the first is metadata."""
    lines = docs.select("document_id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).withColumn("header", section_header(F.col("line")))
    upto = Window.partitionBy("document_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("part", F.count("header").over(upto).cast("int"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n")
    parts = numbered.groupBy("document_id", "part").agg(F.max("header").alias("header"), body.alias("text")).filter(F.trim("text") != "")
    low = turkish_lower(F.col("header"))
    kinds = F.create_map(*(F.lit(x) for pair in SECTION_KINDS.items() for x in pair))
    return parts.select("document_id", "part", F.coalesce(kinds[low], F.regexp_replace(low, " ", "_"), F.lit("metadata")).alias("section"), "text")


def split_long(text: str, max_chars: int = 3000) -> list[tuple[int, int]]:
    """Intervals of at most max_chars: cut at the last line end, else the last sentence end, else hard."""
    out, at = [], 0
    while at < len(text):
        while at < len(text) and text[at].isspace():
            at += 1
        end = min(len(text), at + max_chars)
        if end < len(text):
            cut = text.rfind("\n", at + 1, end)
            cut = cut if cut > at else text.rfind(". ", at + 1, end) + 1
            end = cut if cut > at else end
        stop = at + len(text[at:end].rstrip())
        if stop > at:
            out.append((at, stop))
        at = max(end, at + 1)
    return out


def ends_sentence(word: str, following: str) -> bool:
    """Whether a sentence ends between two words: not after an abbreviation, an initial or an ordinal."""
    opening = following.lstrip("\"“'(")[:1]
    if word[-1:] not in (".", "!", "?", "…") or opening not in CAPITALS or len(following) - len(following.lstrip("\"“'(")) > 1:
        return False
    bare = word.rstrip(".").lstrip("(\"“'")
    return not word.endswith(".") or not (bare.lower() in ABBREVIATIONS or bare.isdigit() or len(bare) == 1)


def sentences(text: str, max_chars: int = MAX_CHARS) -> list[str]:
    """Sentences, as words with single spaces; one over max_chars is cut between words, and a longer word by itself."""
    out: list[str] = []
    now: list[str] = []
    words = text.split()
    for word, following in zip(words, [*words[1:], ""]):
        now.append(word)
        if not following or ends_sentence(word, following):
            out += _within(now, max_chars)
            now = []
    return out


def _within(words: list[str], max_chars: int) -> list[str]:
    lines: list[str] = []
    for word in words:
        if lines and len(lines[-1]) + 1 + len(word) <= max_chars:
            lines[-1] += " " + word
        else:
            lines += [word[k : k + max_chars] for k in range(0, len(word), max_chars)]
    return lines


def chunk_paragraphs(rows: list[tuple], target: int = TARGET_CHARS, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS, least: int = MIN_SECTION_CHARS) -> list[tuple]:
    """(section, page start, page end, first, last, text) from (paragraph number, page, section, text) rows: sentences are
    packed to the target, a chunk begins with the last few of the one before, none crosses sections, and a section under
    `least` characters joins the next."""
    groups: list[list] = []
    for no, page, section, text in rows:
        if groups and (groups[-1][0] == section or sum(len(r[3]) for r in groups[-1][1]) < least):
            groups[-1][1].append((no, page, section, text))
        else:
            groups.append([section, [(no, page, section, text)]])
    out = []
    for section, members in groups:
        pieces = [(no, page, s) for no, page, _, text in members for s in sentences(text, most)]
        now: list[tuple] = []
        fresh = 0
        for piece in pieces:
            size = sum(len(p[2]) + 1 for p in now)
            if now and fresh and (size + len(piece[2]) > most or size >= target):
                out.append((section, now))
                tail, width = [], 0
                for p in reversed(now):
                    if width + len(p[2]) > overlap:
                        break
                    tail.insert(0, p)
                    width += len(p[2]) + 1
                now, fresh = tail if sum(len(p[2]) + 1 for p in tail) + len(piece[2]) <= most else [], 0
            now.append(piece)
            fresh += 1
        if now and fresh:
            out.append((section, now))
    return [(s, min(p[1] for p in c), max(p[1] for p in c), min(p[0] for p in c), max(p[0] for p in c), " ".join(p[2] for p in c)) for s, c in out]


def prose_chunks(paragraph_rows: DataFrame, **limits) -> DataFrame:
    """Overlapping chunks per document of (document_id, paragraph, page, section, text): a carried state in each
    document, so documents are grouped; one document is one group."""

    def run(key, table):
        rows = sorted(zip(*(table[c].to_pylist() for c in ("paragraph", "page", "section", "text"))), key=lambda r: r[0])
        found = [(key[0].as_py(), i, *c) for i, c in enumerate(chunk_paragraphs(rows, **limits))]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        names = ("document_id", "chunk_index", "section_title", "page_start", "page_end", "paragraph_start", "paragraph_end", "text")
        return pa.table([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names)

    schema = "document_id string, chunk_index int, section_title string, page_start int, page_end int, paragraph_start int, paragraph_end int, text string"
    return paragraph_rows.select(F.col("document_id").cast("string"), "paragraph", "page", "section", "text").groupBy("document_id").applyInArrow(run, schema)


def cut_chunks(docs: DataFrame, max_chars: int = 3000) -> DataFrame:
    """document_id, chunk_index, char_start, char_end, text, content_hash: exact intervals of at most max_chars."""

    def run(batches):
        for batch in batches:
            rows = [(d, i, a, b, t[a:b]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, (a, b) in enumerate(split_long(t or "", max_chars))]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["document_id", "chunk_index", "char_start", "char_end", "text"])

    schema = "document_id string, chunk_index int, char_start int, char_end int, text string"
    return docs.select(F.col("document_id").cast("string"), "text").mapInArrow(run, schema).withColumn("content_hash", F.sha2("text", 256))


def coverage_rows(document_id, text, chunks):
    """The rules that a document's chunks break, by one walk over them in order."""
    text, reached, rules = text or "", 0, set()
    for c in sorted(chunks or [], key=lambda c: (c["char_start"], c["char_end"])):
        if text[c["char_start"] : c["char_end"]] != c["text"]:
            rules.add("text_differs")
        if text[reached : c["char_start"]].strip():
            rules.add("uncovered_text")
        reached = max(reached, c["char_end"])
    if text[reached:].strip():
        rules.add("uncovered_text")
    return ((document_id, rule) for rule in sorted(rules))


def coverage_violations(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, rule: text outside all chunks that isn't white space, and chunks whose text isn't the text there. A text
    meets its chunks once, and is read once."""
    of_text = chunks.groupBy("document_id").agg(F.collect_list(F.struct("char_start", "char_end", "text")).alias("chunks"))
    texts = docs.select(F.col("document_id").cast("string"), F.col("text").cast("string")).join(of_text, "document_id", "left")
    schema = "document_id string, rule string"
    return texts.mapInArrow(in_batches(schema, coverage_rows), schema)


def page_spans(pages: DataFrame) -> DataFrame:
    """document_id, page, start, end of (document_id, page, text) in the document's text, where pages with text are joined
    by a blank line. Texts don't travel: a page's place is a running sum of lengths."""
    some = pages.filter(F.trim("text") != "").select("document_id", "page", F.length("text").alias("n"))
    upto = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return some.withColumn("end", F.sum(F.col("n") + 2).over(upto) - 2).select("document_id", "page", (F.col("end") - F.col("n")).alias("start"), "end")


def joined_pages(pages: DataFrame) -> DataFrame:
    """document_id, text: pages with text joined by a blank line; a document is one text, and one row."""
    rows = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.filter(F.trim("text") != "").groupBy("document_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n\n").alias("text"))


def page_at(offsets: DataFrame, spans: DataFrame) -> DataFrame:
    """document_id, offset, page of (document_id, offset): the page whose span holds the offset, or null. The last page that
    begins at or before it is found in one pass over both, in order of place."""
    rows = spans.select("document_id", F.col("start").alias("at"), F.lit(0).alias("asked"), "page", "end").unionByName(
        offsets.select("document_id", F.col("offset").alias("at"), F.lit(1).alias("asked"), F.lit(None).cast("long").alias("page"), F.lit(None).cast("long").alias("end")), allowMissingColumns=True
    )
    before = Window.partitionBy("document_id").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("asked") == 0, F.struct("page", "end")), True).over(before)
    found = rows.withColumn("last", last).filter("asked = 1")
    return found.select("document_id", F.col("at").alias("offset"), F.when(F.col("at") < F.col("last.end"), F.col("last.page")).alias("page"))


def repeated_edges(pages: DataFrame, edge: int = 2, longest: int = 60) -> DataFrame:
    """document_id, edge_line (digits as #) of lines among a page's first or last two that come on a third page or on
    half of the pages, in documents of three pages or more."""
    lines = pages.select("document_id", "page", F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))
    edges = F.array_union(F.slice("lines", 1, edge), F.slice(F.reverse("lines"), 1, edge))
    keyed = lines.select("document_id", "page", F.explode(edges).alias("line")).filter(F.length("line") <= longest).select("document_id", "page", F.regexp_replace("line", r"[0-9]", "#").alias("edge_line"))
    counts = keyed.groupBy("document_id", "edge_line").agg(F.count_distinct("page").alias("n"))
    total = pages.groupBy("document_id").agg(F.count_distinct("page").alias("pages")).filter("pages >= 3")
    return counts.join(total, "document_id").filter(F.col("n") >= F.greatest(F.lit(3), F.ceil(F.col("pages") / 2))).select("document_id", "edge_line", F.col("n"))


def is_page_number(line):
    """3, - 3 -, 3/12, Sayfa 3 / 12."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(line), "^\\s*sayfa", ""), "[\\s-]", "")
    numbers = F.split(bare, "/")
    return (F.size(numbers) <= 2) & F.forall(numbers, lambda n: n.rlike("^[0-9]+$") & (F.length(n) <= 4))


def begins_item(line):
    """Whether a line's first word is a bullet, or a number or letter with its mark."""
    first = F.get(F.split(line, r"\s+", 2), F.lit(0))
    mark, rest = F.substring(first, -1, 1), F.substring(first, F.lit(1), F.length(first) - 1)
    numbered = rest.rlike(r"^\d{1,3}$") & mark.isin(".", ")", "-")
    lettered = (F.length(rest) == 1) & rest.rlike(r"^\p{Ll}$") & mark.isin(".", ")")
    return line.rlike(r"\s") & (first.isin("-", "•", "*", "–") | numbered | lettered)


def strip_edges(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """Pages whose first and last lines with text, if they are page numbers or repeated, are emptied, in two rounds: the
    second line from an end goes only where the one beyond it went. Empty lines within stay."""
    lines = pages.select("document_id", "page", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    filled = lines.withColumn("some", F.trim("line") != "")
    whole = Window.partitionBy("document_id", "page")
    count = lambda *by: F.sum(F.col("some").cast("int")).over(whole.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    placed = filled.withColumn("top", count("no")).withColumn("bottom", count(F.desc("no"))).withColumn("edge_line", F.regexp_replace(F.trim("line"), "[0-9]", "#"))
    marked = placed.join(repeated.select("document_id", "edge_line", F.lit(True).alias("again")), ["document_id", "edge_line"], "left")
    marked = marked.withColumn("noise", F.col("some") & (F.coalesce("again", F.lit(False)) | is_page_number(F.col("line"))))
    outer = lambda side: F.coalesce(F.bool_or((F.col(side) == 1) & F.col("noise")).over(whole), F.lit(False))
    gone = lambda side: F.col("noise") & ((F.col(side) == 1) | ((F.col(side) == 2) & outer(side)))
    kept = marked.withColumn("line", F.when(gone("top") | gone("bottom"), "").otherwise(F.col("line")))
    body = F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"])
    return kept.groupBy("document_id", "page").agg(F.array_join(body, "\n").alias("text"))


def readable_documents(pages: DataFrame, least: int = 20) -> DataFrame:
    """document_id, pages, readable, accepted: a page is readable with so many letters; a document is refused without any
    readable page, or if more than half of several pages are not."""
    counted = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(readable_letters(F.coalesce("text", F.lit(""))) >= least).alias("readable"))
    refused = (F.col("readable") == 0) | ((F.col("pages") > 1) & ((F.col("pages") - F.col("readable")) * 2 > F.col("pages")))
    return counted.withColumn("accepted", ~refused)


def clean_export_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of exported decisions without what exports add, and how many pages of each document that changed."""
    cleaned = pages.withColumn("clean", drop_boilerplate(F.col("text")))
    counts = cleaned.groupBy("document_id").agg(F.count_if(F.col("clean") != F.col("text")).alias("changed_pages"))
    return cleaned.withColumn("text", F.col("clean")).drop("clean"), counts


def clean_book_pages(pages: DataFrame, titles: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pages of a book without running headers (a page number, a bar and one of the titles, in either order) and with
    divided words put together, and how many pages of each document that changed."""
    named = [squeezed_capitals(F.lit(t)) for t in titles]

    def is_header(line: Column) -> Column:
        sides = F.transform(F.split(line, r"\|", -1), squeezed_capitals)
        is_number = lambda x: (x != "") & ((F.translate(x, "0123456789", "") == "") | (F.translate(x, "IVXLCDM", "") == ""))
        pair = lambda a, b: is_number(F.get(sides, F.lit(a))) & F.get(sides, F.lit(b)).isin(*named)
        return (F.size(sides) == 2) & (pair(0, 1) | pair(1, 0))

    lines = F.filter(F.split(join_wrapped_lines(F.col("text")), "\n", -1), lambda x: ~F.coalesce(is_header(x), F.lit(False)))
    cleaned = pages.withColumn("clean", F.array_join(lines, "\n"))
    counts = cleaned.groupBy("document_id").agg(F.count_if(F.col("clean") != F.col("text")).alias("changed_pages"))
    return cleaned.withColumn("text", F.col("clean")).drop("clean"), counts


def squeezed_capitals(line: Column) -> Column:
    return F.upper(F.translate(F.trim(F.regexp_replace(line, r"\s+", " ")), "iıİ", "III"))


def rebuild_paragraphs(lines: DataFrame) -> DataFrame:
    """document_id, paragraph, text from visual (document_id, no, line): a blank line, a heading, a list item, or a short
    line that ends a sentence closes a paragraph; divided words are put together."""
    from korpusflow.functions.text import is_heading

    order = Window.partitionBy("document_id").orderBy("no")
    some = lines.withColumn("line", F.trim("line")).withColumn("median", F.expr("percentile(length(line), 0.5)").over(Window.partitionBy("document_id")))
    last, item = F.lag("line").over(order), begins_item(F.col("line"))
    fresh = last.isNull() | (last == "") | is_heading(F.col("line")) | is_heading(last) | item | (last.rlike(r"[.!?:…]$") & (F.length(last) < F.col("median") * 0.8))
    numbered = some.withColumn("paragraph", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("line <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy("document_id", "paragraph").agg(F.regexp_replace(F.regexp_replace(text, r"(?<=\p{L})-\n(?=\p{Ll})", ""), "\n", " ").alias("text"))


def breadcrumbs(found: DataFrame) -> DataFrame:
    """document_id, unit_key, breadcrumb: headings or labels of the unit's ancestors and itself, each once."""
    names = found.select("document_id", F.col("unit_key").alias("k"), F.coalesce("heading", F.concat_ws(" ", "unit_type", "label")).alias("name"))
    steps = found.select("document_id", "unit_key", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("unit_path")), lambda i: F.array_join(F.slice("unit_path", F.lit(1), i), "/"))).alias("depth", "k"))
    rows = F.array_sort(F.collect_list(F.struct("depth", "name")))
    return steps.join(names, ["document_id", "k"]).groupBy("document_id", "unit_key").agg(F.array_distinct(F.transform(rows, lambda x: x["name"])).alias("breadcrumb"))


def breadcrumb_rows(document_id, text):
    found = nested(markers_of(text or ""), len(text or ""))
    keys = unit_keys(found)
    names = {key: unit.marker.heading if unit.marker.heading is not None else " ".join(x for x in (unit.marker.unit_type, unit.marker.label) if x is not None) for unit, key in zip(found, keys)}
    for unit, key in zip(found, keys):
        yield document_id, key, list(dict.fromkeys(names[k] for k in itertools.accumulate(unit.path, "{}/{}".format)))


def text_breadcrumbs(docs: DataFrame) -> DataFrame:
    """`breadcrumbs` of the units of (document_id, text) rows, a document_id being one text: a text holds all of a unit's
    ancestors, so the way to each unit is read where the text is, and nothing of it is shuffled."""
    schema = "document_id string, unit_key string, breadcrumb array<string>"
    return docs.select(F.col("document_id").cast("string"), F.col("text").cast("string")).mapInArrow(in_batches(schema, breadcrumb_rows), schema)
