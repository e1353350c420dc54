"""Retrieval evaluation: grades, recall, nDCG, success at k, gates and model choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def eligible(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """Queries of the development and holdout splits, without coverage gap, that have a reviewed positive."""
    positive = labels.filter("review_status = 'reviewed' and relevance > 0").select("query_id").distinct()
    return queries.filter("split in ('development', 'holdout') and not coalesce(coverage_gap, false)").join(positive, "query_id", "left_semi")


def evaluate(hits: DataFrame, labels: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """query_id, recall, ndcg at k over reviewed labels, for each query with a positive. Gain 2^grade - 1, discount
    log2(rank + 1); a chunk that comes again earns nothing."""
    reviewed = labels.filter("review_status = 'reviewed'").groupBy("query_id", "chunk_id").agg(F.max("relevance").alias("relevance"))
    gain = lambda c: F.pow(F.lit(2.0), c) - 1
    ordered = reviewed.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "chunk_id")))
    ideal = ordered.groupBy("query_id").agg(
        F.count_if(F.col("relevance") > 0).alias("positives"),
        F.sum(F.when(F.col("n") <= k, gain(F.col("relevance")) / F.log2(F.col("n") + 1)).otherwise(0.0)).alias("ideal"),
    )
    first = hits.filter(F.col("rank") <= k).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    found = first.join(reviewed, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count_if(F.col("relevance") > 0).alias("found"), F.sum(gain(F.col("relevance")) / F.log2(F.col("rank") + 1)).alias("dcg"))
    both = ideal.filter("positives > 0").join(found, "query_id", "left")
    return both.select("query_id", F.round(F.coalesce("found", F.lit(0)) / F.col("positives"), digits).alias("recall"), F.round(F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0), digits).alias("ndcg"))


def first_match(hits: DataFrame, grades: DataFrame, grade: int = 2) -> DataFrame:
    """query_id and the least rank of a hit with the grade."""
    return hits.join(grades.filter(F.col("grade") == grade), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))


def success_at(gold_queries: DataFrame, ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 8, 25)) -> DataFrame:
    """k, found, share (of all gold queries, to 3 places) and the queries missed."""
    joined = gold_queries.select("query_id").join(ranks, "query_id", "left").select("query_id", "rank", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    hit = F.coalesce(F.col("rank") <= F.col("k"), F.lit(False))
    return joined.groupBy("k").agg(F.count_if(hit).alias("found"), F.round(F.count_if(hit) / F.count(F.lit(1)), 3).alias("share"), F.array_sort(F.collect_list(F.when(~hit, F.col("query_id")))).alias("missed"))


def p95(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The element at ceil(0.95 n) of the sorted values."""
    return df.groupBy(*by).agg(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {column})").alias("p95"))


def metric_summary(per_query: DataFrame) -> DataFrame:
    """Means per split and over all (split null)."""
    return per_query.rollup("split").agg(F.count(F.lit(1)).alias("eligible"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY seconds)").alias("p95"))


def reference_grade(refs: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, chunk_id, grade of expected references (query_id, ref) like 4857:18-19, 4857 or a title: 2 for the law and
    an article in range, 1 for the law, title or type alone, 0 is left out."""
    parsed = refs.select("query_id", "ref", F.regexp_extract("ref", r"^(\d{3,5})(?::|$)", 1).alias("law"), F.regexp_extract("ref", r"^\d{3,5}:(\d+)", 1).try_cast("int").alias("low"), F.regexp_extract("ref", r"^\d{3,5}:\d+-(\d+)$", 1).try_cast("int").alias("high"))
    parsed = parsed.withColumn("high", F.coalesce("high", "low"))
    labels = corpus.select("chunk_id", F.col("primary_legislation_number").alias("law"), F.explode_outer("article_labels").alias("label"))
    in_range = F.col("label").try_cast("int").between(F.col("low"), F.col("high"))
    by_law = parsed.filter("law <> ''").join(labels, "law").select("query_id", "chunk_id", F.when(F.col("low").isNull(), 1).when(F.coalesce(in_range, F.lit(False)), 2).otherwise(0).alias("grade"))
    names = corpus.select("chunk_id", F.explode(F.array_distinct(F.array(F.lower("title"), F.lower("authority"), F.lower("document_type")))).alias("name")).filter("name is not null")
    by_name = parsed.filter("law = ''").join(names, F.lower("ref") == F.col("name")).select("query_id", "chunk_id", F.lit(1).alias("grade"))
    return by_law.unionByName(by_name).groupBy("query_id", "chunk_id").agg(F.max("grade").alias("grade")).filter("grade > 0")


def select_questions(queries: DataFrame, per_topic: int = 6) -> DataFrame:
    """Queries whose references name an article, the first few of each topic in file order."""
    naming = queries.filter(F.exists("expected_refs", lambda r: r.rlike(r"^\d{3,5}:\d+")))
    return naming.withColumn("__n", F.row_number().over(Window.partitionBy("topic").orderBy("position"))).filter(F.col("__n") <= per_topic).drop("__n")


def select_model(reports: DataFrame, margin: float = 0.01) -> DataFrame:
    """selected, reason: among systems within `margin` of the best nDCG, the one least in p95, memory and name."""
    best = reports.agg(F.max("ndcg_at_10").alias("__best"))
    near = reports.crossJoin(F.broadcast(best)).filter(F.col("__best") - F.col("ndcg_at_10") < margin)
    pick = F.min_by("system", F.struct("p95_latency_seconds", "peak_process_memory_gb", "system"))
    return near.agg(pick.alias("selected"), F.when(F.count(F.lit(1)) > 1, "lowest_cost_within_margin").otherwise("highest_ndcg").alias("reason"))


def quality_gate(reports: DataFrame, final: str, systems: int = 6, min_queries: int = 100) -> DataFrame:
    """check, ok: six reports of one metric version, enough queries, and the final system's recall, gain over the best
    single system, latency and memory."""
    own = F.col("system") == final
    single = F.max(F.when(F.col("system").isin("bm25", "vector"), F.col("ndcg_at_10")))
    of = lambda c: F.max(F.when(own, F.col(c)))
    checks = {
        "reports_present": F.count_distinct("system") >= systems, "one_metric_version": F.count_distinct("metric_version") == 1, "enough_queries": F.min("eligible_queries") >= min_queries,
        "recall": of("recall_at_10") >= 0.80, "ndcg_gain": of("ndcg_at_10") >= single + 0.02, "latency": of("p95_latency_seconds") <= 3, "memory": of("peak_process_memory_gb") <= 6,
    }
    row = reports.agg(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok")) for n, ok in checks.items())).alias("c"))
    return row.select(F.explode("c").alias("c")).select("c.check", "c.ok")


def answer_summary(rows: DataFrame) -> DataFrame:
    """variant, questions, mean seconds, cited and verified sentences, share verified, fallbacks."""
    return rows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("questions"), F.round(F.avg("seconds"), 3).alias("mean_seconds"), F.sum("cited").alias("cited"), F.sum("verified").alias("verified"),
        F.round(F.sum("verified") / F.nullif(F.sum("cited"), F.lit(0)), 3).alias("verified_share"), F.count_if("fallback").alias("fallbacks"),
    )


def draft_labels(pool: DataFrame, grades: DataFrame) -> DataFrame:
    """Pooled candidates with a draft grade: pending, and whether a reference matched."""
    joined = pool.join(grades, ["query_id", "chunk_id"], "left")
    label = F.struct("chunk_id", F.coalesce("grade", F.lit(0)).alias("relevance"), F.lit("pending").alias("review_status"), F.when(F.col("grade") > 0, "candidate_match").otherwise("needs_review").alias("note"), "provenance")
    return joined.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", label.alias("label")))).alias("x")).select("query_id", F.transform("x", lambda r: r["label"]).alias("labels"))


def ablation(setups: dict[str, DataFrame], gold: DataFrame, ks: tuple[int, ...] = (1, 3, 8, 25)) -> DataFrame:
    """setup, top_1, top_3 ...: share of gold (query_id, chunk_id) found by each setup's hits."""
    out = None
    for name, hits in setups.items():
        ranks = hits.join(gold, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
        part = success_at(gold.select("query_id").distinct(), ranks, ks).select(F.lit(name).alias("setup"), "k", "share")
        out = part if out is None else out.unionByName(part)
    wide = out.groupBy("setup").pivot("k", list(ks)).agg(F.first("share"))
    return wide.select("setup", *(F.col(str(k)).alias(f"top_{k}") for k in ks))


def last_plan(plans: DataFrame) -> DataFrame:
    return plans.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("position")))).filter("__n = 1").drop("__n")


def ab_order(df: DataFrame, key: str, a: str = "A", b: str = "B") -> DataFrame:
    """Which of two answers is shown first, by the parity of the key's crc32."""
    odd = F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 1
    return df.withColumn("first", F.when(odd, b).otherwise(a)).withColumn("second", F.when(odd, a).otherwise(b))
