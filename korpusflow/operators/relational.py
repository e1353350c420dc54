"""General table operators: ranks, pages, interval joins, audits, merges and counters."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return rank_within(df, by, order, "__n").filter(F.col("__n") <= n).drop("__n")


def keep_first(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return top_n(df, by, order, 1)


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return keep_first(df, by, [F.desc(c) for c in order])


def round_robin(df: DataFrame, by: str, part: str, rank: str, item: str) -> DataFrame:
    """Items taken in turn over the parts, each once: by, item, position."""
    first = df.groupBy(by, item).agg(F.min(F.struct(rank, part)).alias("__first"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("__first", item))).drop("__first")


def page(df: DataFrame, order: list[str], limit: int, cursor: str | None = None) -> DataFrame:
    """One page by descending keyset, with `has_more`: limit + 1 rows are taken, never an offset."""
    if cursor:
        values = json.loads(base64.urlsafe_b64decode(cursor))
        bound = F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, values)))
        df = df.filter(F.struct(*order) < bound)
    taken = df.orderBy(*(F.desc(c) for c in order)).limit(limit + 1)
    numbered = taken.withColumn("__n", F.row_number().over(Window.orderBy(*(F.desc(c) for c in order))))  # of limit + 1 rows
    return numbered.withColumn("has_more", F.max("__n").over(Window.partitionBy()) > limit).filter(F.col("__n") <= limit).drop("__n")


def next_cursor(row: dict, order: list[str]) -> str:
    return base64.urlsafe_b64encode(json.dumps([str(row[c]) for c in order]).encode()).decode()


def overlap(left: DataFrame, right: DataFrame, key: list[str], l: tuple[str, str], r: tuple[str, str], bin: int | None = None) -> DataFrame:  # noqa: E741
    """Pairs of a key whose half-open intervals overlap. Column names other than the key differ. With `bin`, both sides
    are dealt to bins of that width, for keys with very many intervals; a pair is taken in the bin where it begins."""
    touch = (F.col(l[0]) < F.col(r[1])) & (F.col(l[1]) > F.col(r[0]))
    if bin is None:
        return left.join(right, key).filter(touch)
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin), F.floor(F.greatest(F.col(e) - 1, F.col(s)) / bin)))
    both = left.withColumn("__bin", bins(*l)).join(right.withColumn("__bin", bins(*r)), [*key, "__bin"]).filter(touch)
    return both.filter(F.col("__bin") == F.floor(F.greatest(l[0], r[0]) / bin)).drop("__bin")


def smallest_container(points: DataFrame, intervals: DataFrame, key: list[str], point: str, id_col: str, start: str, end: str, unit: str) -> DataFrame:
    """For each point its smallest interval that holds it (ties: the first unit); points without one have null."""
    inside = points.select(*key, id_col, point).join(intervals.select(*key, start, end, unit), key).filter((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end)))
    best = inside.groupBy(*key, id_col).agg(F.min(F.struct((F.col(end) - F.col(start)).alias("size"), F.col(unit).alias("unit"))).getField("unit").alias(unit))
    return points.join(best, [*key, id_col], "left")


def missing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_anti")


def merge_metadata(stored: DataFrame, target: DataFrame, on: list[str], map_cols: list[str] = ()) -> DataFrame:
    """Stored rows with the target's non-null values; in map columns the target's entries win."""
    names = [c for c in stored.columns if c not in on]
    given = target.select(*on, *(F.col(c).alias(f"__{c}") for c in names if c in target.columns))
    merged = stored.join(given, on, "left")

    def value(c: str) -> Column:
        if f"__{c}" not in given.columns:
            return F.col(c)
        if c in map_cols:
            new = F.col(f"__{c}")
            return F.when(new.isNull(), F.col(c)).when(F.col(c).isNull(), new).otherwise(F.map_concat(F.map_filter(c, lambda k, _: ~F.map_contains_key(new, k)), new)).alias(c)
        return F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c)

    return merged.select(*on, *(value(c) for c in names)).select(*stored.columns)


def upsert_coalesce(old: DataFrame, new: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    """All rows of both; new values win where they are not null."""
    a, b = old.select(*on, *(F.col(c).alias(f"__old_{c}") for c in cols)), new.select(*on, *cols)
    return a.join(b, on, "full_outer").select(*on, *(F.coalesce(c, f"__old_{c}").alias(c) for c in cols))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def violations(df: DataFrame, table: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """table, key, rule for every row and rule that does not hold (unknown counts as broken)."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda r: r.isNotNull())
    return df.select(F.lit(table).alias("table"), F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def quota_usage(files: DataFrame) -> DataFrame:
    return files.groupBy("workspace_id").agg(F.coalesce(F.sum(F.coalesce("verified_bytes", "reserved_bytes", F.lit(0))), F.lit(0)).alias("bytes"))


def run_counters(outcomes: DataFrame) -> DataFrame:
    """run_id, discovered, imported, duplicate, failed of per-document outcome rows."""
    return outcomes.groupBy("run_id").agg(F.count(F.lit(1)).alias("discovered"), *(F.count_if(F.col("status") == s).alias(s) for s in ("imported", "duplicate", "failed")))


def article_labels(df: DataFrame, by: list[str], label: str = "label", keep: Column | None = None) -> DataFrame:
    """Distinct labels in order for each key; without any, an empty array."""
    value = F.col(label) if keep is None else F.when(keep, F.col(label))
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias("article_labels"))


def document_text(chunks: DataFrame, by: str = "parse_id", order: str = "chunk_index", sep: str = "\n") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(order, "text")))
    return chunks.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), sep).alias("body"))


def stale(rows: DataFrame, ts: str, status: str, minutes: int, as_of: Column) -> DataFrame:
    """Rows that have had a status for longer than some minutes at as_of."""
    return rows.filter((F.col("status") == status) & (F.col(ts) < as_of - F.make_dt_interval(mins=F.lit(minutes))))


def non_overlapping(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Greedy choice of (start, end) in order of start, the longer first: an interval stays if it begins at or after the
    end of the last one kept. Where one begins after all before it end, the choice starts anew: so only intervals that
    hang together are folded over as one list."""
    order = Window.partitionBy(*by).orderBy("start", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    islands = intervals.select(*by, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).withColumn("__fresh", fresh)
    islands = islands.withColumn("__island", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "end")))
    kind = "array<struct<start:bigint,end:bigint>>"
    picked = F.aggregate(
        ordered,
        F.struct(F.lit(None).cast("long").alias("at"), F.array().cast(kind).alias("kept")),
        lambda s, x: F.when(s["at"].isNull() | (x["start"] >= s["at"]), F.struct(x["end"].alias("at"), F.concat(s["kept"], F.array(F.struct(x["start"], x["end"]))).cast(kind).alias("kept"))).otherwise(s),
        lambda s: s["kept"],
    )
    return islands.groupBy(*by, "__island").agg(picked.alias("__kept")).select(*by, F.explode("__kept").alias("k")).select(*by, "k.start", "k.end")


def thread(messages: DataFrame, generations: DataFrame, citations: DataFrame) -> DataFrame:
    """Messages with their generation (as user's or assistant's message) and its citations in order."""
    sides = [generations.select(F.col(c).alias("message_id"), "generation_id", "status") for c in ("user_message_id", "assistant_message_id")]
    of_message = sides[0].unionByName(sides[1]).filter("message_id is not null").dropDuplicates(["message_id", "generation_id"])
    cited = citations.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "source_id"))).alias("citations"))
    return messages.join(of_message, "message_id", "left").join(cited, "message_id", "left").withColumn("citations", F.coalesce("citations", F.array().cast("array<struct<ordinal:int,source_id:string>>")))
