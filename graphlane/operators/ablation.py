"""The planning steps added one after another, each with its modelled cost and its tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.functions import stored
from graphlane.graph import Graph
from graphlane.operators import costing, scheduling, tasks
from graphlane.operators.costing import COMPACTION, FILTER, CostOptions


def chain(graph: Graph, parts: DataFrame, active: DataFrame, cache: DataFrame, options: CostOptions = CostOptions(), k: int = 4) -> DataFrame:
    """step, name, cost, executable_tasks, reordered: direct access alone, then with the choice of engines, with cached
    vertices (cache: v) that needn't be moved, with combined tasks, and with tasks in order of their active edges."""

    def costs(front: DataFrame) -> DataFrame:
        chosen = F.when(F.col("engine") == FILTER, F.col("filter_cost")).when(F.col("engine") == COMPACTION, F.col("compaction_cost")).otherwise(F.col("zc_cost"))
        return stored(costing.evaluate(costing.cost_inputs(graph, parts, front, options, check=False), options).withColumn("cost", chosen))

    def step(number: int, name: str, rows: DataFrame, cost: str, own: DataFrame | None = None, reordered: DataFrame | None = None) -> DataFrame:
        out = rows.agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"), F.count("*").alias("n"))
        done = (own if own is not None else rows).agg(F.count("*").alias("executable_tasks"))
        moved = reordered.agg(F.count_if(F.col("position") != F.col("input_pos")).alias("reordered")) if reordered is not None else graph.spark.createDataFrame([(0,)], "reordered long")
        return out.crossJoin(done).crossJoin(moved).select(F.lit(number).cast("long").alias("step"), F.lit(name).alias("name"), "cost", "executable_tasks", "reordered")

    every, left = costs(active), costs(active.join(cache, "v", "left_anti"))
    grouped = stored(tasks.combine(left.select("pid", "engine"), k, check=False))
    edges = grouped.select("task_id", F.explode("partition_indices").alias("pid")).join(left.select("pid", "active_edges"), "pid").groupBy("task_id").agg(F.sum("active_edges").cast("double").alias("contribution"))
    order = scheduling.schedule(edges.select(F.col("task_id").alias("input_pos"), F.col("task_id").alias("item_index"), "contribution"), check=False)
    steps = [step(0, "direct", every, "zc_cost"), step(1, "selection", every, "cost"), step(2, "cache", left, "cost"), step(3, "combining", left, "cost", grouped), step(4, "scheduling", left, "cost", grouped, order)]
    return reduce(DataFrame.unionByName, steps)
