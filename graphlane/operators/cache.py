"""A cache of hot vertices' rows: access counts of a byte, a choice under a capacity, hits and misses, refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.functions import ranked, running_sum
from graphlane.graph import VERTEX_BYTES, Graph

MOST = 255  # a hotness is a byte
REPLACED = 0.30  # share of new candidates from which a cache is refreshed


def hotness(accesses: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """accesses: v, a row per access. v, hotness: accesses so far, MOST at most. Partial counts are summed before rows meet."""
    own = accesses.groupBy("v").agg(F.count("*").alias("hotness"))
    if before is not None:
        own = own.unionByName(before.select("v", F.col("hotness").cast("long").alias("hotness"))).groupBy("v").agg(F.sum("hotness").alias("hotness"))
    return own.select("v", F.least("hotness", F.lit(MOST)).cast("long").alias("hotness"))


def choose(graph: Graph, hot: DataFrame, capacity_bytes: int) -> DataFrame:
    """v, hotness, bytes of the cached vertices: the hottest first, then the least id, as long as their rows fit together."""
    if capacity_bytes < 0:
        raise ValueError("the capacity must not be negative")
    rows = hot.join(graph.vertices.select("v", (F.col("deg") * VERTEX_BYTES).alias("bytes")), "v")
    placed = running_sum(ranked(rows, [F.desc("hotness"), "v"], "place"), "place", "bytes", "before")
    return placed.where(F.col("before") + F.col("bytes") <= capacity_bytes).select("v", "hotness", "bytes")


def account(accesses: DataFrame, cache: DataFrame | None) -> DataFrame:
    """One row: accesses, hits, misses, hit_rate (0 without accesses). No cache: all are misses."""
    own = accesses.groupBy("v").agg(F.count("*").alias("n"))
    own = own.withColumn("hit", F.lit(False)) if cache is None else own.join(cache.select("v", F.lit(True).alias("hit")), "v", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = own.agg(zero("n").alias("accesses"), zero(F.when(F.col("hit"), F.col("n"))).alias("hits"))
    return out.select("accesses", "hits", (F.col("accesses") - F.col("hits")).alias("misses"), F.when(F.col("accesses") == 0, 0.0).otherwise(F.col("hits") / F.greatest("accesses", F.lit(1))).alias("hit_rate"))


def refresh_plan(cache: DataFrame, candidates: DataFrame) -> DataFrame:
    """v, bytes, action: keep, load or evict, for each vertex of either."""
    old, new = (df.select("v", "bytes", F.lit(True).alias(name)) for df, name in ((cache, "old"), (candidates, "new")))
    both = old.join(new.withColumnRenamed("bytes", "new_bytes"), "v", "full")
    action = F.when(F.col("old") & F.col("new"), "keep").when(F.col("new"), "load").otherwise("evict")
    return both.select("v", F.coalesce("new_bytes", "bytes").alias("bytes"), action.alias("action"))


def refresh_metrics(plan: DataFrame, replaced: float = REPLACED, enabled: bool = True) -> DataFrame:
    """One row: kept, loaded, evicted, share (of candidates that are new), refreshed, loaded_bytes (what a refresh moves)."""
    n = lambda a: F.count_if(F.col("action") == a)
    out = plan.agg(n("keep").alias("kept"), n("load").alias("loaded"), n("evict").alias("evicted"), F.coalesce(F.sum(F.when(F.col("action") == "load", F.col("bytes"))), F.lit(0)).cast("long").alias("load_bytes"))
    out = out.withColumn("share", F.when(F.col("kept") + F.col("loaded") == 0, 0.0).otherwise(F.col("loaded") / F.greatest(F.col("kept") + F.col("loaded"), F.lit(1))))
    out = out.withColumn("refreshed", F.lit(enabled) & (F.col("loaded") > 0) & (F.col("share") >= replaced))
    return out.select("kept", "loaded", "evicted", "share", "refreshed", F.when(F.col("refreshed"), F.col("load_bytes")).otherwise(0).alias("loaded_bytes"))


def refresh(cache: DataFrame, candidates: DataFrame, replaced: float = REPLACED, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """The cache after a refresh, or as it was where too little changes or refreshes are off, and its metrics."""
    metrics = refresh_metrics(refresh_plan(cache, candidates), replaced, enabled)
    return (candidates if metrics.first().refreshed else cache), metrics
