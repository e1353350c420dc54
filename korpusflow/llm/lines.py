"""Removal of repeated line runs with a suffix array over line-id sequences, built by distributed prefix doubling.

A document is its sequence of lines that have a word. Lines that occur once in the corpus cannot be part of a repeat, so
suffixes are kept only where their first line repeats. Round k ranks the suffixes by their first 2^k lines: pairs of
ranks (of a suffix, and of the suffix 2^(k-1) lines on) are range-sorted and numbered in that order, each round written
to the shared folder. Suffixes of one rank are an interval of the suffix array whose longest common prefix is 2^k lines
or more; a prefix of any other length is the overlap of two such intervals. A repeated run counts from `min_words` words,
which `min_words` lines hold at most, so rounds end at that depth. Every maximal repeated run is the union of its least
qualifying prefix at its first line and of its least qualifying suffix at each further line, so the members of these
intervals name all its lines: copies after the first (by doc_id, then place) are deleted.

Cases: null and empty texts stay as they are; lines without a word are no part of a run and go with the line before them
when that is deleted; lines are compared with their outer white space removed; rows that repeat both doc_id and text are
one document and get the same result; a null doc_id sorts before all others; ties of place do not occur; a text that
loses all lines becomes empty; a text of any length is one sequence of lines; other columns, whatever their names, are
passed through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpusflow.llm.common import discard, hot_keys, materialize, quoted, spread_join

MIN_WORDS = 50
GAPS = "\\x20\\x09-\\x0D"


def place_of(doc_id):
    """A document's place in the order of documents: its id, and the least number for a null id."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id (place_of), text_hash, no (line number), h1 and h2 (128-bit line id), n_words of each line with a word."""
    rows = docs.select(place_of(F.col("doc_id")).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("no", "raw"))
    trimmed = split.select("doc_id", "text_hash", "no", F.regexp_replace("raw", f"^[{GAPS}]+|[{GAPS}]+$", "").alias("line")).filter("line <> ''")
    return trimmed.select("doc_id", "text_hash", "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(71), "line").alias("h2"), F.size(F.split("line", f"[{GAPS}]+")).alias("n_words"))


def numbered(pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct keys that occur more than once, their members, and a number that grows in their sort order: a written table."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    ordered = found.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return materialize(ordered.select(*keys, "members", F.monotonically_increasing_id().alias("rank")), name)


def with_rank(suffixes: DataFrame, ranks: DataFrame, keys: list[str], name: str, how: str = "inner") -> DataFrame:
    """Each suffix with the number of its keys; a line that a large share of all texts have is dealt to several tasks."""
    hot = hot_keys(ranks, keys, "members")
    return spread_join(suffixes, ranks.select(*keys, F.col("rank").alias(name)), keys, hot, F.xxhash64("doc_id", "text_hash", "no"), how)


def suffix_ranks(lines: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """Suffixes whose first line repeats: doc_id, text_hash, no, until (the last line without a word after it, or null at
    the end), at, n_words and r0, r1 ...: their rank by the first 1, 2, 4 ... lines, null where no other suffix has
    those lines."""
    ids = numbered(lines, ["h1", "h2"], "line-ids")
    place = Window.partitionBy("doc_id", "text_hash").orderBy("no")
    one_each = lines.dropDuplicates(["doc_id", "text_hash", "no"])
    placed = one_each.withColumn("at", F.row_number().over(place)).withColumn("until", F.lead("no").over(place) - 1)
    ranked = with_rank(placed, ids, ["h1", "h2"], "r0")
    now = materialize(ranked.select("doc_id", "text_hash", "no", "until", "at", "n_words", "r0"), "suffixes")
    discard(ids)
    rounds = 1
    while (1 << rounds) <= depth:
        k, half = rounds, 1 << (rounds - 1)
        key = ["doc_id", "text_hash"]
        # The suffix `half` lines on: frames by value of `at`, since places between may be missing.
        on = Window.partitionBy(*key).orderBy("at").rangeBetween(half, half)
        paired = now.withColumn("next", F.when(F.col(f"r{k - 1}").isNotNull(), F.first(f"r{k - 1}").over(on)))
        full = paired.filter("next is not null")
        ranks = numbered(full, [f"r{k - 1}", "next"], "ranks")
        if ranks.isEmpty():
            discard(ranks)
            break
        joined = with_rank(full, ranks, [f"r{k - 1}", "next"], f"r{k}", "left").unionByName(paired.filter("next is null").withColumn(f"r{k}", F.lit(None).cast("long")))
        after = materialize(joined.drop("next"), "suffixes")
        discard(now, ranks)
        now, rounds = after, rounds + 1
    return now, rounds


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id (place_of), text_hash, no and until (the last line that goes with it, or null: all further ones) of the lines
    to delete: those in a later copy of a repeated run of min_words words."""
    lines = materialize(line_table(docs), "lines")
    now, rounds = suffix_ranks(lines, min_words)
    discard(lines)
    key = ["doc_id", "text_hash"]
    # Stretches of adjoining repeated lines; a repeated run lies within one.
    place = Window.partitionBy(*key).orderBy("at")
    islands = now.withColumn("stretch", F.col("at") - F.row_number().over(place))
    inside = Window.partitionBy(*key, "stretch").orderBy("at")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    words = islands.withColumn("sum", F.sum("n_words").over(upto)).withColumn("before", F.col("sum") - F.col("n_words"))
    whole = Window.partitionBy(*key, "stretch")
    # As each line has a word, sums grow strictly; the end of the least prefix is found among the next min_words lines.
    ahead, behind = inside.rowsBetween(0, min_words - 1), inside.rowsBetween(-(min_words - 1), 0)
    sums = words.withColumn("total", F.sum("n_words").over(whole)).filter(F.col("total") >= min_words)
    sums = sums.withColumn("later", F.collect_list("sum").over(ahead)).withColumn("earlier", F.collect_list("before").over(behind))
    sized = sums.select(
        *key, "no", "until", "at", *(f"r{k}" for k in range(rounds)),
        F.size(F.filter("later", lambda x: x < F.col("before") + min_words)).alias("short"), F.size("later").alias("ahead"),
        F.size(F.filter("earlier", lambda x: x > F.col("sum") - min_words)).alias("short_back"), F.size("earlier").alias("behind"),
    )
    sized = sized.select(*key, "no", "until", "at", *(f"r{k}" for k in range(rounds)), F.when(F.col("short") < F.col("ahead"), F.col("short") + 1).alias("prefix"), F.when(F.col("short_back") < F.col("behind"), F.col("short_back") + 1).alias("suffix"))
    sized = materialize(sized, "sized")
    discard(now)

    def windows(length, start):
        """Windows of `length` lines from `start`: name (level and the ranks of their two overlapping intervals)."""
        level = F.floor(F.log2(length.cast("double") + 0.5)).cast("int")
        return level, start + length - F.pow(F.lit(2), level).cast("int")

    ranks = F.array(*(f"r{k}" for k in range(rounds)))
    heads = sized.filter(F.col("prefix").isNotNull()).select(*key, F.col("at").alias("start"), F.col("prefix").alias("length"), F.lit(0).alias("side"))
    tails = sized.filter(F.col("suffix").isNotNull()).select(*key, (F.col("at") - F.col("suffix") + 1).alias("start"), F.col("suffix").alias("length"), F.lit(1).alias("side"))
    both = heads.unionByName(tails)
    level, second = windows(F.col("length"), F.col("start"))
    asked = both.withColumn("level", level).withColumn("second", second).filter(F.col("level") < rounds)
    suffixes = sized.select(*key, "at", ranks.alias("ranks"))
    first = asked.join(suffixes.withColumnRenamed("at", "start"), [*key, "start"]).withColumn("a", F.element_at("ranks", F.col("level") + 1)).drop("ranks").filter("a is not null")
    named = first.join(suffixes.withColumnRenamed("at", "second"), [*key, "second"]).withColumn("b", F.element_at("ranks", F.col("level") + 1)).drop("ranks").filter("b is not null")
    named = materialize(named.select(*key, "start", "length", "side", "level", "a", "b"), "windows")
    # The first window of each name stays; as a row of its own, so that all copies of a name never meet in a task.
    here = F.struct(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("start").alias("s"))
    name = ["length", "level", "a", "b"]
    first_ones = named.groupBy(*name).agg(F.min(here).alias("o")).select(*name, F.col("o.d").alias("doc_id"), F.col("o.h").alias("text_hash"), F.col("o.s").alias("start"))
    later = named.join(first_ones, [*name, *key, "start"], "left_anti")
    # A prefix deletes all its lines, a suffix its last one.
    gone = later.select(*key, F.explode(F.when(F.col("side") == 0, F.sequence("start", F.col("start") + F.col("length") - 1)).otherwise(F.array(F.col("start") + F.col("length") - 1))).alias("at")).distinct()
    return gone.join(sized.select(*key, "at", "no", "until"), [*key, "at"]).select(*key, "no", "until")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs, with their columns, without later copies of repeated line runs of min_words words or more.
    An n_chars column is set to the new length."""
    spans = F.array_sort(F.collect_list(F.struct("no", "until")))
    gone = repeated_lines(docs, min_words).groupBy("doc_id", "text_hash").agg(spans.alias("gone"))
    gone = materialize(gone, "gone")
    marked = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), place_of(docs["doc_id"]).alias("doc_id"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("text_hash"))
    # The same kind of join at every size: a switch to a broadcast would only hide what a larger input shuffles.
    joined = marked.join(gone.hint("merge"), ["doc_id", "text_hash"], "left")
    lines = F.split(F.col("row")["text"].cast("string"), "\n", -1)
    n = F.size("gone")
    # What lies between the spans stays: stretch k runs from the end of span k - 1 to the begin of span k.
    first = lambda k: F.when(k == 0, 0).otherwise(F.coalesce(F.get(F.col("gone"), k - 1)["until"], F.size(lines) - 1) + 1)
    end = lambda k: F.when(k == n, F.size(lines)).otherwise(F.get(F.col("gone"), k)["no"])
    stretches = F.filter(F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(first(k).alias("first"), (end(k) - first(k)).alias("n"))), lambda s: s["n"] > 0)
    kept = F.array_join(F.transform(stretches, lambda s: F.array_join(F.slice(lines, s["first"] + 1, s["n"]), "\n")), "\n")
    touched = F.col("gone").isNotNull()
    of_row = lambda c: F.col("row").getField(c)
    new = {c: of_row(c) for c in docs.columns} | {"text": F.when(touched, kept).otherwise(of_row("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(touched, F.length(kept)).otherwise(of_row("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(x.alias(c) for c, x in new.items()))
