"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.common import discard, hot_keys, materialize, spread_join


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for the nodes of (a, b) edges. Self-loops and repeated edges are
    allowed; an edge with a null end is left out; nodes without an edge are not listed."""
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components-edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        larger, tied = _large_star(now)
        after, tied_again = _small_star(larger)
        discard(now, larger, tied, tied_again)
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = materialize(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    discard(now)
    return found


def _spread(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with their node's least neighbour; those of a node with very many are dealt to several tasks."""
    return spread_join(edges, least.select("u", "m"), ["u"], hot_keys(least, ["u"]), F.xxhash64("v"))


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's larger neighbours are tied to its least neighbour (or itself). What a star gives and the least neighbours
    that it goes by are stored: plans stay short, and no star is worked out again to find hot nodes."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    least = materialize(least, "components-least")
    moved = _spread(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(moved.filter("u > v").distinct(), "components-edges"), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node and its smaller neighbours are tied to the least of them; also the least of each, as above."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "components-least")
    moved = _spread(edges, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct(), "components-edges"), least
