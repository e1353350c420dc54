"""Dated changes against dated cases: which cited texts changed, when, and what to say about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpusflow.functions.dates import assess, states_period
from korpusflow.functions.text import dates_in, fold

MAX_CHANGES, MAX_CHECKS, MAX_NAMED = 12, 8, 3


def ground_dates(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """Claims (id, date) that some text of their id states."""
    stated = texts.select("id", F.explode(dates_in(F.col("text"))).alias("date")).distinct()
    return claims.join(stated, ["id", "date"], "left_semi")


def stating_passages(deadlines: DataFrame, passages: DataFrame) -> DataFrame:
    """deadline_id, source_id of passages of the same issue that state the period."""
    return deadlines.join(passages, "issue_id").filter(states_period(fold(F.col("text")), F.col("amount"), F.col("unit"))).select("deadline_id", "source_id")


def changes_by_chunk(changes: DataFrame, n: int = MAX_CHANGES) -> DataFrame:
    """chunk_id and its change events, each once, newest first, n at most."""
    once = changes.dropDuplicates(["chunk_id", "event_id"])
    top = once.withColumn("__n", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("change_date"), "event_id"))).filter(F.col("__n") <= n)
    return top.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.struct("event_id", "event_type", "change_date", "effective_from").alias("e")))), lambda x: x["e"]).alias("changes"))


def changes_after(decisions: DataFrame, refs: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes of what a decision cites that took effect after it: id, event_id, event_type, change_date. A citation of a
    paragraph is touched by changes of that paragraph or of the whole article, and by no mere addition beside it."""
    in_force = F.coalesce("effective_from", "change_date").alias("change_date")
    part = (F.bool_or(F.col("paragraph").isNull()), F.collect_set("paragraph"))
    cited = decisions.select("id", "decided").join(refs.select("id", "law", "article", "paragraph"), "id").groupBy("id", "law", "article").agg(F.min("decided").alias("decided"), part[0].alias("cites_all"), part[1].alias("cited"))
    event = ["event_id", "event_type", "change_date"]
    placed = changes.select("law", "article", "paragraph", "event_id", "event_type", in_force).groupBy(*event, "law", "article").agg(part[0].alias("all"), part[1].alias("paragraphs"))
    places = placed.withColumn("places", F.count(F.lit(1)).over(Window.partitionBy(*event)))
    concerns = F.col("cites_all") | F.arrays_overlap("paragraphs", "cited") | (F.col("all") & (F.col("event_type") != "added"))
    found = lambda some: places.filter(some).join(cited, ["law", "article"]).filter((F.col("change_date") > F.col("decided")) & concerns).select("id", *event)
    # A decision meets an event of one article once, as both sides are one row for it: the pairs, which are far more than
    # both tables, are not sorted out by a shuffle. Only an event of several articles may meet a decision again.
    return found("places = 1").unionByName(found("places > 1").distinct())


def temporal_checks(citations: DataFrame, changes: DataFrame, dates: DataFrame, limit: int = MAX_CHECKS) -> DataFrame:
    """query_id, source_id, level and event for cited sources that changed around the case's date: one per event, firm
    findings first."""
    level = assess(F.col("event_type"), F.col("change_date"), F.col("effective_from"), F.col("case_date"))
    order = F.create_map(F.lit("changed_after"), F.lit(0), F.lit("decision_outdated"), F.lit(1), F.lit("near_change"), F.lit(2))
    found = citations.join(changes, "chunk_id").join(dates, ["query_id", "source_id"]).withColumn("level", level).filter("level is not null").withColumn("firmness", order[F.col("level")])
    once = found.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "event_id").orderBy("firmness", "source_id"))).filter("__n = 1")
    ranked = once.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("firmness", F.desc("change_date"), "event_id"))).filter(F.col("position") <= limit)
    return ranked.select("query_id", "position", "source_id", "level", "event_id", "event_type", "change_date")


def decision_checks(decisions: DataFrame, after: DataFrame, dates: DataFrame, named: int = MAX_NAMED) -> DataFrame:
    """Decisions that rest on provisions changed since (and in force by the case's date, if known): one row per title with
    the first few provisions and how many more."""
    joined = decisions.join(after, "id").join(dates.select("query_id", "case_date"), "query_id", "left").filter(F.col("case_date").isNull() | (F.col("change_date") <= F.col("case_date")))
    grouped = joined.groupBy("query_id", "title").agg(F.array_sort(F.collect_set("provision")).alias("all"))
    text = F.concat(F.array_join(F.slice("all", 1, named), ", "), F.when(F.size("all") > named, F.concat(F.lit(" +"), (F.size("all") - named).cast("string"))).otherwise(""))
    return grouped.select("query_id", "title", F.lit("decision_outdated").alias("level"), text.alias("provisions"))


def repeal_notice(items: DataFrame, mentions: DataFrame, as_of) -> DataFrame:
    """Whole units repealed and in force at as_of, not after the case, whose article the cited passage mentions."""
    gone = items.filter((F.col("event_type") == "repealed") & F.col("whole_unit") & (F.coalesce("effective_from", "change_date") <= as_of) & (F.col("case_date").isNull() | (F.col("case_date") >= F.coalesce("effective_from", "change_date"))))
    named = mentions.select("query_id", F.explode("articles").alias("article")).distinct()
    return gone.join(named, ["query_id", "article"], "left_semi").select("query_id", "law", "article", F.concat(F.lit("Mülga: "), "law", F.lit(" m."), "article", F.lit(", "), F.date_format("change_date", "dd.MM.yyyy")).alias("text")).distinct()


def earliest_dates(issue_sources: DataFrame, dates: DataFrame) -> DataFrame:
    """source_id and the earliest date (with its label) of the issues that use it."""
    return issue_sources.join(dates, "issue_id").groupBy("source_id").agg(F.min(F.struct("date", "label")).alias("x")).select("source_id", "x.date", "x.label")


def warning_text(checks: DataFrame) -> DataFrame:
    day = F.date_format("change_date", "dd.MM.yyyy")
    text = F.when(F.col("level") == "changed_after", F.concat(F.lit("Olay tarihinden sonra değişmiş: "), day)).when(F.col("level") == "near_change", F.concat(F.lit("Olay tarihi değişikliğe yakın: "), day)).otherwise(F.concat(F.lit("Karardan sonra değişmiş: "), day))
    return checks.withColumn("text", text)


def amendment_queries(checks: DataFrame, n: int = 2) -> DataFrame:
    """Web query texts of the first firm checks of each query."""
    firm = checks.filter("level = 'changed_after'").withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).filter(F.col("__n") <= n)
    return firm.select("query_id", F.concat_ws(" ", "law_title", F.col("article"), F.date_format("change_date", "yyyy"), F.lit("değişiklik")).alias("text"))
