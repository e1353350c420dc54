"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("bm25_topk", "bm25_filtered", "dense_topk", "rrf_hybrid", "rerank_lexical", "recall_ndcg_at_10", "known_item_success_at_k", "tokenize_prefix5", "html_text_sql", "normalize_text", "interval_overlap_join", "asof_changes_after", "pack_budget", "deadline_business_days", "repeated_edges")


def main() -> None:
    from pyspark.sql import SparkSession

    from korpusflow.plans import registry

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["tokenize_prefix5"](spark, sf_dir).limit(1).collect()
    seconds, facts = {}, {}
    for name in HEADLINE:
        begun = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begun, 3)
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    for name in ("bm25_topk", "rrf_hybrid", "recall_ndcg_at_10"):
        facts[f"{name}_queries_per_s"] = round(asked / seconds[name], 1)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "throughput": facts, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
