"""Exact text of pages where patterns are not enough: an HTML parser and Unicode composition, in Arrow batches."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that start a line, and elements whose content is not text.
BLOCKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer nav blockquote pre".split())
HIDDEN = frozenset(("script", "style", "noscript"))


class VisibleText(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in HIDDEN
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.depth -= tag in HIDDEN and self.depth > 0
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def visible(page: str | None) -> str:
    parser = VisibleText()
    parser.feed(page or "")
    parser.close()
    return "".join(parser.parts)


def mapped(df: DataFrame, column: str, out: str, change) -> DataFrame:
    names = [c for c in df.columns if c != out]

    def run(batches):
        for batch in batches:
            values = pa.array([change(x) for x in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), values], [*names, out])

    return df.mapInArrow(run, T.StructType([*(df.schema[n] for n in names), T.StructField(out, T.StringType())]))


def parse_html(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """pages with the visible text of each."""
    return mapped(pages, column, out, visible)


def compose(df: DataFrame, column: str = "text") -> DataFrame:
    """NFC; only rows with combining marks go through Python."""
    needs = F.coalesce(F.col(column).rlike(r"\p{M}"), F.lit(False))
    changed = mapped(df.filter(needs), column, "__composed", lambda x: unicodedata.normalize("NFC", x) if x else x)
    return df.filter(~needs).unionByName(changed.withColumn(column, F.col("__composed")).drop("__composed").select(*df.columns))
