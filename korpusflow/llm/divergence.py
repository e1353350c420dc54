"""How far the sources of a language diverge in their words, with count-level bitmaps.

A term's share in a group (a language's source) is a whole number that depends on its count there and on the group's size
alone. So a group is stored as levels: for each count the set of the terms that have it, as 64-bit words of a bitset over
the language's terms (lang, bucket, word, source, count, bits). Where levels of two sources meet, the population count of
their AND is the number of terms in that joint cell, and each cell's divergence is computed once and multiplied. Terms that
a source lacks are the complement: with f(a, b) the divergence of counts a and b,

    sum f = V f(0, 0) + sum over a of n(a) (f(a, 0) - f(0, 0)) + sum over b of n(b) (f(0, b) - f(0, 0))
            + sum over joint cells (a, b > 0) of n(a, b) (f(a, b) - f(a, 0) - f(0, b) + f(0, 0)),

so only cells that are occupied on both sides come from bitmaps; the rest comes from the levels' sizes. Terms are dealt to
buckets with others of like frequency, so frequent ones, each a level of its own, do not share words with rare ones, which
are many on a level. A bucket has about `BUCKET` terms, so no task holds more than those terms times the sources.

All arithmetic is on whole numbers: a source's shares sum to at most 10^9 + V, so each of the sums above is below 4 * 10^18
for fewer than half a thousand million terms; counts are multiplied as decimals.

Cases: null text, lang and source count as ''; an empty text is a document without terms; a group without terms has the
shares of a source with no words, and all values are 0 in a language that keeps no term; rows that repeat count as often
as they stand there; ties are in the order of the items' UTF-8 bytes; a long text is read whole, in slices of a batch; an
empty table gives an empty one; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusflow.llm.common import hot_keys, materialize, row_slices, spread_join, words

#: Documents of its language that a term needs, ranks of part `term`, the whole of which shares are parts.
LEAST_DOCS, TERM_RANKS, WHOLE = 3, 200, 1_000_000_000
#: Terms of a bucket, on average. Parts in which a group's terms are ranked first. Cells worked on at once.
BUCKET, RANK_PARTS, CELLS = 128, 32, 1 << 22
SLICE = 1 << 22

#: A byte as terms have it: letters (A to Z lowered) and what is not ASCII; anything else is a space.
TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of an array of texts, and where each text's begin and end."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    valid, ends, data = texts.buffers()
    data = pa.py_buffer(data.to_pybytes().translate(TERM_BYTES)) if data is not None else None
    return words(pa.Array.from_buffers(pa.large_string(), len(texts), [valid, ends, data], offset=texts.offset), lower=False)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), added up for each slice of a batch."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts = table.column("text").combine_chunks()
            group = table.select(["lang", "source"]).append_column("row", pa.array(np.arange(len(texts))))
            numbers = group.group_by(["lang", "source"], use_threads=False).aggregate([("row", "list")])
            of_row = np.zeros(len(texts), np.int64)
            for no, rows in enumerate(numbers.column("row_list").to_pylist()):
                of_row[rows] = no
            begun = 0
            for piece in row_slices(texts, SLICE):
                flat, ends = terms(piece)
                mine, begun = of_row[begun : begun + len(piece)], begun + len(piece)
                if len(flat) == 0:
                    continue
                coded = flat.dictionary_encode()
                code, many = np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)
                row = np.repeat(np.arange(len(piece)), np.diff(ends))
                in_row, n = np.unique(row * many + code, return_counts=True)
                keys, place = np.unique(mine[in_row // many] * many + in_row % many, return_inverse=True)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, place, n)
                at = pa.array(keys // many)
                columns = [numbers.column(c).take(at).combine_chunks() for c in ("lang", "source")]
                columns += [coded.dictionary.take(pa.array(keys % many)).cast(pa.string()), pa.array(total), pa.array(np.bincount(place, minlength=len(keys)))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / whole), null where a language has neither terms nor words."""
    return F.when(whole > 0, F.expr("1L") + F.call_function("div", (count + 1).cast("decimal(19,0)") * F.lit(WHOLE).cast("decimal(10,0)"), whole.cast("decimal(19,0)")))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def text_groups(docs: DataFrame) -> DataFrame:
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(plain("lang"), plain("source"), plain("text"))


def kept_terms(counted: DataFrame, least: int) -> DataFrame:
    """lang, term, total, docs of the terms in enough documents, with bucket, word and bit."""
    totals = counted.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    stored = materialize(totals.withColumn("size_class", F.length(F.bin("total"))), "divergence-terms")
    many = stored.groupBy("lang", "size_class").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("long").alias("buckets"))
    # One row a language and power of two.
    dealt = spread_join(stored, many, ["lang", "size_class"], hot_keys(stored.groupBy("lang", "size_class").count(), ["lang", "size_class"], "count"), F.xxhash64("term"))
    bucket = F.col("size_class") * F.lit(1 << 40).cast("long") + F.pmod(F.xxhash64("term"), F.col("buckets"))
    number = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("term")) - 1
    placed = dealt.withColumn("bucket", bucket).withColumn("number", number)
    return placed.select("lang", "term", "total", "bucket", F.shiftright("number", 6).alias("word"), F.col("number").bitwiseAND(F.lit(63)).alias("bit"))


def bitmaps(kept: DataFrame) -> DataFrame:
    """lang, bucket, word, source, count, p, p0 (the share of a term that the source lacks), bits."""
    return kept.groupBy("lang", "bucket", "word", "source", "n", "p", "p0").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").cast("int"))).alias("bits"))


def joint_cells(maps: DataFrame) -> DataFrame:
    """lang, source, item, value: what the cells that both sources occupy add, a bucket at a time."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def run(key, table):
        names = table.column("source").combine_chunks().dictionary_encode()
        source, number = np.asarray(names.indices).astype(np.int64), len(names.dictionary)
        word, p, p0 = (table.column(c).to_numpy() for c in ("word", "p", "p0"))
        bits = table.column("bits").to_numpy().view(np.uint64)
        value = np.zeros(number * number, np.int64)
        met = np.zeros(number * number, bool)
        order = np.argsort(word, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(word[order])) + 1):
            height = max(1, CELLS // len(rows))
            for a in range(0, len(rows), height):
                left = rows[a : a + height]
                n = np.bitwise_count(bits[left][:, None] & bits[rows][None, :])
                i, j = np.nonzero(n)
                r, c = left[i], rows[j]
                apart = source[r] != source[c]
                r, c, n = r[apart], c[apart], n[i[apart], j[apart]].astype(np.int64)
                cell = f(p[r], p[c]) - f(p[r], p0[c]) - f(p0[r], p[c]) + f(p0[r], p0[c])
                pair = source[r] * number + source[c]
                np.add.at(value, pair, n * cell)
                met[pair] = True
        pairs = np.flatnonzero(met)
        named = lambda x: names.dictionary.take(pa.array(x))
        lang = pa.array([key[0].as_py()] * len(pairs), pa.string())
        return pa.table([lang, named(pairs // number), named(pairs % number), pa.array(value[pairs])], ["lang", "source", "item", "value"])

    return maps.groupBy("lang", "bucket").applyInArrow(run, "lang string, source string, item string, value long")


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has each other source of the language by its divergence, part
    `term` the first `ranks` terms that a source has more of than its language."""
    rows = text_groups(docs)
    counted = term_counts(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = materialize(counted, "divergence-counts")
    terms_of = materialize(kept_terms(counted, least_docs), "divergence-kept")
    kept = materialize(counted.drop("docs").join(terms_of, ["lang", "term"]), "divergence-group-terms")

    languages = terms_of.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = rows.select("lang", "source").distinct().join(languages, "lang", "left").join(sizes, ["lang", "source"], "left").fillna(0, ["v", "lang_n", "group_n"])
    zero = F.lit(0).cast("long")
    groups = materialize(groups.withColumn("p0", share(zero, F.col("group_n") + F.col("v"))), "divergence-groups")

    hot = hot_keys(kept.groupBy("lang", "source").count(), ["lang", "source"], "count")
    shares = spread_join(kept, groups, ["lang", "source"], hot, F.xxhash64("term")).withColumn("p", share(F.col("n"), F.col("group_n") + F.col("v")))
    shares = materialize(shares.withColumn("q", share(F.col("total"), F.col("lang_n") + F.col("v"))), "divergence-shares")
    maps = materialize(bitmaps(shares), "divergence-bitmaps")

    levels = maps.groupBy("lang", "source", "n", "p", "p0").agg(F.sum(F.bit_count("bits").cast("long")).alias("terms"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    met = levels.join(others, "lang").filter(F.col("source") != F.col("item"))
    empty = lambda a, b: divergence(F.col(a), F.col(b))
    here = met.select("lang", "source", "item", (F.col("terms") * (empty("p", "q0") - empty("p0", "q0"))).alias("value"))
    there = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("terms") * (empty("q0", "p") - empty("q0", "p0"))).alias("value"))
    both = groups.alias("a").join(others, "lang").filter(F.col("source") != F.col("item"))
    nothing = both.select("lang", "source", "item", F.coalesce(F.col("v") * empty("p0", "q0"), zero).alias("value"))
    summed = nothing.unionByName(here).unionByName(there).unionByName(joint_cells(maps)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = ranked(summed).withColumn("part", F.lit("pair"))

    more = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    first = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(RANK_PARTS))).orderBy(F.desc("value"), "item")
    best = more.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= ranks).drop("rank")
    named = ranked(best).filter(F.col("rank") <= ranks).withColumn("part", F.lit("term"))
    return pairs.unionByName(named).select("lang", "source", "part", "item", "value", "rank")
