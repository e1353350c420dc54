"""Claims and their sources: allow-lists, pairs, support, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusflow.functions.text import lexical_tokens, states_legal_fact

STATUSES = ("unsupported", "partial", "supported")


def claim_pairs(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """answer_id, claim_id (S1 ...), kind, text, source_id of (answer_id, blocks): headings carry no source, unknown ids
    are dropped, a claim without any keeps one row with a null source. allowed: answer_id, source_id."""
    one = answers.select("answer_id", F.posexplode("blocks").alias("b", "block")).select("answer_id", "b", "block.kind", F.posexplode("block.sentences").alias("s", "sentence"))
    told = one.filter(F.trim("sentence.text") != "").withColumn("n", F.row_number().over(Window.partitionBy("answer_id").orderBy("b", "s")))
    claims = told.select("answer_id", F.concat(F.lit("S"), F.col("n").cast("string")).alias("claim_id"), "n", "kind", F.col("sentence.text").alias("text"), F.when(F.col("kind") == "heading", F.array().cast("array<string>")).otherwise(F.col("sentence.source_ids")).alias("ids"))
    known = claims.select("answer_id", "claim_id", F.explode(F.array_distinct("ids")).alias("source_id")).join(allowed, ["answer_id", "source_id"], "left_semi")
    return claims.drop("ids").join(known, ["answer_id", "claim_id"], "left").select("answer_id", "claim_id", "n", "kind", "text", "source_id")


def containment_scorer(pairs: DataFrame, full: float = 0.6, part: float = 0.3) -> DataFrame:
    """Default support: share of the claim's distinct tokens that the passage has, against two thresholds."""
    claim, passage = F.array_distinct(lexical_tokens(F.col("text"), "prefix5")), F.array_distinct(lexical_tokens(F.col("passage"), "prefix5"))
    share = F.size(F.array_intersect(claim, passage)) / F.greatest(F.lit(1), F.size(claim))
    return pairs.withColumn("status", F.when(share >= full, "supported").when(share >= part, "partial").otherwise("unsupported"))


def assess_support(pairs: DataFrame, passages: DataFrame, scorer=containment_scorer) -> DataFrame:
    return scorer(pairs.filter("source_id is not null").join(passages, "source_id")).select("answer_id", "claim_id", "source_id", "status")


def apply_support(pairs: DataFrame, support: DataFrame) -> DataFrame:
    """answer_id, claim_id, verification, kept: sources that do not contradict are kept; a claim is verified, partial or
    unverified by its best source; one without sources is plain unless it states a legal fact. No assessment: unsupported."""
    rank = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, STATUSES)), c), F.lit(1))
    joined = pairs.join(support, ["answer_id", "claim_id", "source_id"], "left").withColumn("level", F.when(F.col("source_id").isNotNull(), rank(F.coalesce("status", F.lit("unsupported")))))
    grouped = joined.groupBy("answer_id", "claim_id", "n", "kind", "text").agg(F.max("level").alias("best"), F.array_sort(F.collect_list(F.when(F.col("level") > 1, F.col("source_id")))).alias("kept"))
    told = F.when(F.col("kind") == "heading", "plain").when(F.col("best") == 3, "verified").when(F.col("best") == 2, "partial").when((F.col("best") == 1) | states_legal_fact(F.col("text")), "unverified").otherwise("plain")
    return grouped.select("answer_id", "claim_id", told.alias("verification"), "kept")


def citation_violations(citations: DataFrame, chunks: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """citation_id, field, expected, actual for every snapshot field that differs from its chunk (null-safe); a missing
    chunk differs in `key`."""
    stored = chunks.select(key, *(F.col(f).cast("string").alias(f"__{f}") for f in fields), F.lit(True).alias("__there"))
    joined = citations.join(stored, key, "left")
    gone = F.when(F.col("__there").isNull(), F.struct(F.lit(key).alias("field"), F.col(key).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual")))
    wrong = [F.when(F.col("__there") & ~F.col(f).cast("string").eqNullSafe(F.col(f"__{f}")), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("expected"), F.col(f"__{f}").alias("actual"))) for f in fields]
    return joined.select("citation_id", F.explode(F.array_compact(F.array(gone, *wrong))).alias("v")).select("citation_id", "v.field", "v.expected", "v.actual")


def web_offer(df: DataFrame) -> DataFrame:
    reason = F.when(F.col("sources") == 0, "no_sources").when(F.col("changed"), "provision_changed").when(F.col("missing"), "missing_info")
    return df.withColumn("reason", reason)


def render(blocks: DataFrame) -> DataFrame:
    """answer_id, body: sentences of a block joined by spaces, blocks by blank lines, in order."""
    lines = F.transform("blocks", lambda b: F.array_join(F.transform(b["sentences"], lambda s: s["text"]), " "))
    return blocks.select("answer_id", F.array_join(F.filter(lines, lambda x: x != ""), "\n\n").alias("body"))


def replace_section(blocks: DataFrame, section: str, computed: DataFrame) -> DataFrame:
    """Blocks (answer_id, position, kind, text) with those under the heading `section` replaced by computed ones."""
    order = Window.partitionBy("answer_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("kind") == "heading", F.struct("text", "position")), True).over(order)
    marked = blocks.withColumn("head", head)
    place = marked.filter((F.col("kind") == "heading") & (F.col("text") == section)).select("answer_id", F.col("position").alias("at"))
    kept = marked.filter((F.col("kind") == "heading") | ~F.coalesce(F.col("head.text") == section, F.lit(False))).select("answer_id", F.col("position").cast("double").alias("position"), "kind", "text")
    new = computed.join(place, "answer_id").select("answer_id", (F.col("at") + F.col("n") / 1e6).alias("position"), "kind", "text")
    return kept.unionByName(new)


def followup_context(turns: DataFrame) -> DataFrame:
    """Each user turn with the user's turn before it, unless that says the same."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("role") == "user", F.col("text")), True).over(order)
    same = F.regexp_replace(F.trim("text"), r"\s+", " ").eqNullSafe(F.regexp_replace(F.trim(before), r"\s+", " "))
    return turns.withColumn("context", F.when(~same, before)).filter("role = 'user'").select("conv_id", "turn", "text", "context")


def distinct_queries(queries: DataFrame, n: int = 5, least: int = 3) -> DataFrame:
    """The first n queries of each part whose case-folded titles differ and have `least` characters."""
    titled = queries.withColumn("title_key", F.lower(F.trim("title"))).filter(F.length("title_key") >= least)
    once = titled.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "title_key").orderBy("position"))).filter("k = 1")
    return once.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).filter(F.col("n") <= n).drop("k", "title_key")


def most_cited(refs: DataFrame, covered: DataFrame, boilerplate: DataFrame, n: int = 4) -> DataFrame:
    """query_id, law, article, n, first_part of the articles cited most, without covered and boilerplate ones."""
    left = refs.join(covered, ["query_id", "law", "article"], "left_anti").join(boilerplate, ["law", "article"], "left_anti")
    counts = left.groupBy("query_id", "law", "article").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("first_part"))
    return counts.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "first_part", "law", "article"))).filter(F.col("k") <= n).drop("k")


def snapshot(df: DataFrame, channel: str | Column) -> DataFrame:
    """One shape for corpus, file and web evidence; absent fields are null. The channel is a name, or what a column says."""
    fields = ("source_id", "title", "text", "location", "url", "content_hash", "page_start", "page_end")
    named = F.lit(channel) if isinstance(channel, str) else channel
    return df.select(named.alias("channel"), *(F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields))
