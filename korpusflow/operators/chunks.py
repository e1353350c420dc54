"""Chunks of a text along its structure: sections are cut at the last unit that begins within the limit, and each chunk
names the units that it overlaps and the smallest of them.

Cutting is greedy, so each document is one pass over its text, with its units in order. The same pass sweeps over chunks and
units: both are sorted by their start, and of the units, which nest, only those still open are looked at.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.operators.markers import markers_of, nested
from korpusflow.operators.segment import in_batches, unit_keys

MAX_CHARS = 3000
#: Units that are cut within their section, and units whose text is a table that nobody parsed.
CHILDREN = ("paragraph", "item", "subitem", "sentence")
CHUNKS = (
    "document_id string, chunk_index int, section_type string, label string, char_start int, char_end int, text string, unit_key string, unit_keys array<string>"
)


def pieces(text: str, start: int, end: int, most: int, boundaries: list[int]) -> list[tuple[int, int]]:
    """Intervals of [start, end) of at most `most` characters: a cut falls on the last boundary within the limit, else on
    the last line end, else after the last sentence, else anywhere. White space after a cut belongs to no piece."""
    out, at = [], start
    while end - at > most:
        last = bisect_right(boundaries, at + most) - 1
        line, sentence = text.rfind("\n", at + 1, at + most), text.rfind(". ", at + 1, at + most)
        if last >= 0 and boundaries[last] > at:
            cut = boundaries[last]
        elif line > 0:
            cut = line
        else:
            cut = sentence + 1 if sentence > 0 else at + most
        out.append((at, cut))
        at = cut
        while at < end and text[at].isspace():
            at += 1
    return [*out, (at, end)] if at < end else out


def sections_of(text: str, units: list) -> list[tuple[str, str | None, int, int]]:
    """type, label, start and end: from one unit that is no child to the next; paragraphs of a text without units."""
    heads = [u for u in units if u["unit_type"] not in CHILDREN]
    if heads:
        ends = [*(u["char_start"] for u in heads[1:]), len(text)]
        return [(u["unit_type"], u["label"], u["char_start"], end) for u, end in zip(heads, ends)]
    out, at = [], 0
    for part in blank_line_parts(text):
        out.append(("paragraph", None, at, at + len(part)))
        at += len(part)
    return out


def blank_line_parts(text: str) -> list[str]:
    """A text cut before each line with text that follows an empty one."""
    parts, empty = [""], False
    for line in text.splitlines(True):
        if empty and line.strip():
            parts.append("")
        parts[-1] += line
        empty = not line.strip()
    return parts


def chunk_rows(document_id, text, units, most):
    text, units = text or "", sorted(units or [], key=lambda u: (u["char_start"], u["unit_index"]))
    boundaries = [u["char_start"] for u in units if u["unit_type"] in CHILDREN]
    opened, ahead, number = [], 0, 0
    for kind, label, begin, end in sections_of(text, units):
        for a, b in pieces(text, begin, end, most, boundaries):
            body = text[a:b].strip()
            if not body:
                continue
            start = a + len(text[a:b]) - len(text[a:b].lstrip())
            stop = start + len(body)
            while ahead < len(units) and units[ahead]["char_start"] < stop:
                opened.append(units[ahead])
                ahead += 1
            opened = [u for u in opened if u["char_end"] > start]
            least = min(opened, key=lambda u: u["char_end"] - u["char_start"], default=None)
            keys = [u["unit_key"] for u in opened]
            yield document_id, number, least["unit_type"] if least else kind, label, start, stop, body, least["unit_key"] if least else None, keys
            number += 1


def own_units(text: str) -> list[dict]:
    """What segment.units finds in a text, without the texts of the units."""
    found = nested(markers_of(text), len(text))
    return [
        {"unit_index": i, "char_start": m.start, "char_end": m.start + len(text[m.start : end].rstrip()), "unit_type": m.unit_type, "label": m.label, "unit_key": key}
        for i, ((m, end, _), key) in enumerate(zip(found, unit_keys(found)), 1)
    ]


def text_chunk_rows(document_id, text, most):
    return chunk_rows(document_id, text, own_units(text or ""), most)


def structured_chunks(docs: DataFrame, found: DataFrame | None = None, max_chars: int = MAX_CHARS) -> DataFrame:
    """document_id, chunk_index, section_type (of the smallest unit), label (of the section), char_start, char_end, text,
    unit_key (of the smallest unit), unit_keys (all, in order), content_hash of (document_id, text) with its units. Without
    given ones, those of segment.units are found where the text is cut: a document_id is one text then, and nothing of it
    is shuffled."""
    if found is None:
        rows = docs.select(F.col("document_id").cast("string"), F.col("text").cast("string"), F.lit(max_chars).alias("most")).mapInArrow(in_batches(CHUNKS, text_chunk_rows), CHUNKS)
        return rows.withColumn("content_hash", F.sha2("text", 256))
    fields = ("unit_index", "char_start", "char_end", "unit_type", "label", "unit_key")
    by_text = found.groupBy("document_id").agg(F.collect_list(F.struct(*fields)).alias("units"))
    texts = docs.select(F.col("document_id").cast("string"), F.col("text").cast("string")).join(by_text, "document_id", "left")
    rows = texts.select("document_id", "text", "units", F.lit(max_chars).alias("most")).mapInArrow(in_batches(CHUNKS, chunk_rows), CHUNKS)
    return rows.withColumn("content_hash", F.sha2("text", 256))
