"""Greedy packing under token budgets. What does not fit is skipped and later items may still fit, so these are folds over
each group's sorted candidates (a query has some hundreds at most), not running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusflow.functions.text import token_cost

KEPT = "array<struct<id:string,position:int>>"


def _fold(items: Column, limit_of, used: Column) -> Column:
    """Kept items and tokens used, taking each sorted item that stays within its limit."""
    start = F.struct(used.cast("long").alias("used"), F.array().cast(KEPT).alias("kept"))

    def step(state, x):
        total = state["used"] + x["cost"]
        one = F.array(F.struct(x["id"].cast("string").alias("id"), (F.size(state["kept"]) + 1).alias("position")))
        return F.when(total <= limit_of(x), F.struct(total.cast("long").alias("used"), F.concat(state["kept"], one).cast(KEPT).alias("kept"))).otherwise(state)

    return F.aggregate(items, start, step)


def pack(candidates: DataFrame, base: int, target: int, hard: int, file_tokens: int = 24_000) -> DataFrame:
    """query_id, id, position of (query_id, channel, order, id, cost): files up to min(target, base + file_tokens), then
    primary and web to target, then doctrine to hard. base tokens are spent already."""
    stage = F.when(F.col("channel") == "file", 0).when(F.col("channel") == "doctrine", 2).otherwise(1)
    limit = F.when(stage == 0, min(target, base + file_tokens)).when(stage == 1, target).otherwise(hard)
    items = F.array_sort(F.collect_list(F.struct(stage.alias("stage"), F.col("order").alias("order"), F.col("id").cast("string").alias("id"), F.col("cost").cast("long").alias("cost"), limit.cast("long").alias("limit"))))
    packed = candidates.groupBy("query_id").agg(items.alias("items")).select("query_id", _fold(F.col("items"), lambda x: x["limit"], F.lit(base))["kept"].alias("kept"))
    return packed.select("query_id", F.explode("kept").alias("k")).select("query_id", "k.id", "k.position")


def select_history(turns: DataFrame, max_tokens: int = 24_000, last: int = 12) -> DataFrame:
    """Of each conversation's last turns, newest first, those that fit; in order of turn."""
    recent = turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("back") <= last)
    items = F.array_sort(F.collect_list(F.struct(F.col("back"), F.col("turn").cast("string").alias("id"), token_cost(F.col("text")).cast("long").alias("cost"))))
    kept = recent.groupBy("conv_id").agg(items.alias("items")).select("conv_id", _fold(F.col("items"), lambda x: F.lit(max_tokens), F.lit(0))["kept"].alias("kept"))
    chosen = kept.select("conv_id", F.explode("kept").alias("k")).select("conv_id", F.col("k.id").cast("long").alias("turn"))
    return recent.drop("back").join(chosen, ["conv_id", "turn"], "left_semi")


def prefix_pack(items: DataFrame, by: str, order: str, cost: str, budget: int) -> DataFrame:
    """Items up to the first that overflows, and whether any did."""
    running = F.sum(cost).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(cost).over(Window.partitionBy(by))
    return items.withColumn("__sum", running).withColumn("truncated", total > budget).filter(F.col("__sum") <= budget).drop("__sum")


def pack_parts(candidates: DataFrame, budget: int = 90_000, file_budget: int = 20_000) -> DataFrame:
    """query_id, id, position of (query_id, channel, part, rank, source_no, id, cost): files within their own budget;
    law and doctrine in turn over the parts share the rest; the result is in order of source_no."""
    once = candidates.groupBy("query_id", "id").agg(F.min_by(F.struct("channel", "source_no", "cost"), F.struct("rank", "part")).alias("x"), F.min(F.struct("rank", "part")).alias("turn"))
    is_file = F.col("x.channel") == "file"
    rows = once.select("query_id", "id", F.col("x.source_no").alias("source_no"), F.col("x.cost").cast("long").alias("cost"), "turn", is_file.alias("is_file"))
    items = F.array_sort(F.collect_list(F.struct("turn", F.col("id").cast("string").alias("id"), "cost")))
    by_kind = rows.groupBy("query_id", "is_file").agg(items.alias("items"))
    limit = F.when(F.col("is_file"), file_budget).otherwise(budget)
    kept = by_kind.select("query_id", F.explode(_fold(F.col("items"), lambda x: limit, F.lit(0))["kept"]).alias("k")).select("query_id", F.col("k.id").alias("id"))
    chosen = rows.join(kept, ["query_id", "id"], "left_semi")
    return chosen.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("source_no", "id"))).select("query_id", "id", "position")
