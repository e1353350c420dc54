"""Positional full-text match and rank by cover density: each shortest stretch of a text that satisfies the query adds the
more the fewer other words stand in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.functions.text import lexical_tokens
from korpusflow.operators.search import rank_hits

#: What a cover without other words in it adds: the weight of plain text.
WEIGHT, DIGITS = 0.1, 6


def asked_terms(queries: DataFrame, stemming: str | None) -> DataFrame:
    """query_id, term, no (place among the query's distinct terms), terms (how many it has)."""
    listed = queries.select("query_id", F.array_distinct(lexical_tokens(F.col("text"), stemming)).alias("t"))
    return listed.select("query_id", F.size("t").alias("terms"), F.posexplode("t").alias("no", "term"))


def positions(queries: DataFrame, chunks: DataFrame, stemming: str | None = "prefix5", shared: list[str] | None = None) -> DataFrame:
    """query_id, chunk_id, pos, no, terms: where the terms of queries stand in chunks (chunk_id, text). With `shared`
    columns, a query meets only chunks that agree with it there (the files that it may read, say)."""
    keys = shared or []
    tokens = chunks.select("chunk_id", *keys, F.posexplode(lexical_tokens(F.col("text"), stemming)).alias("pos", "term"))
    extra = queries.select("query_id", *keys).distinct() if keys else None
    asked = asked_terms(queries.select("query_id", "text").distinct(), stemming)
    asked = asked.join(extra, "query_id") if keys else asked
    return tokens.join(asked, ["term", *keys]).select("query_id", "chunk_id", "pos", "no", "terms")


def any_term(found: DataFrame) -> DataFrame:
    """query_id, chunk_id, score where any term may match: each occurrence is a cover of its own."""
    counted = found.groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("covers"))
    return counted.select("query_id", "chunk_id", F.round(F.col("covers") * WEIGHT, DIGITS).alias("score"))


def all_terms(found: DataFrame) -> DataFrame:
    """query_id, chunk_id, score of chunks with all terms. Walking the places in order, a cover ends where all terms have
    been seen since its start and no cover began there yet; it starts at the earliest of their last places. The places of
    one query in one chunk are as many as the chunk's words at most."""
    places = F.array_sort(F.collect_list(F.struct("pos", "no")))
    grouped = found.groupBy("query_id", "chunk_id", "terms").agg(places.alias("places"), F.count_distinct("no").alias("seen")).filter("seen = terms")
    never = F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("at"))
    begin = F.struct(F.array_repeat(never, F.col("terms")).alias("last"), F.lit(-1).alias("start"), F.lit(0).alias("at"), F.lit(0.0).alias("score"))

    def step(state, place):
        now = F.struct(place["pos"].alias("pos"), state["at"].alias("at"))
        last = F.transform(state["last"], lambda x, i: F.when(i == place["no"], now).otherwise(x))
        first = F.array_min(last)
        others = (place["pos"] - first["pos"]) - (state["at"] - first["at"])
        ends = (first["pos"] >= 0) & (first["pos"] > state["start"])
        gain = F.when(ends, WEIGHT / (1 + others)).otherwise(0.0)
        start = F.when(ends, first["pos"]).otherwise(state["start"])
        return F.struct(last.alias("last"), start.alias("start"), (state["at"] + 1).alias("at"), (state["score"] + gain).alias("score"))

    score = F.aggregate("places", begin, step, lambda s: s["score"])
    return grouped.select("query_id", "chunk_id", F.round(score, DIGITS).alias("score"))


def cover_search(queries: DataFrame, chunks: DataFrame, limit: int | None = 10, stemming: str | None = "prefix5", every: bool = False, shared: list[str] | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of chunks that match any term (or every term) of queries (query_id, text)."""
    found = positions(queries, chunks, stemming, shared)
    return rank_hits(all_terms(found) if every else any_term(found), limit)
