"""Grouping of partitions' movements into executable tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.functions import ranked, running_sum
from graphlane.operators.costing import COMPACTION, FILTER, ZERO_COPY


def combine(engines: DataFrame, k: int = 4, check: bool = True) -> DataFrame:
    """engines: pid, engine. task_id, engine, first, end, partition_count, partition_indices.

    Runs of consecutive FILTER partitions go in groups of at most k; all COMPACTION partitions are one task, and so
    are all ZERO_COPY ones; tasks are numbered by their first partition. Partitions and tasks are numbered in ranges, by two
    levels of counts; only the rows of one task meet.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    own = ranked(engines.select("pid", "engine"), ["pid"], "number")
    if check and own.where(~F.col("engine").isin(FILTER, COMPACTION, ZERO_COPY) | F.col("engine").isNull()).limit(1).count():
        raise ValueError("unknown engine")
    own = own.withColumn("filters", (F.col("engine") == FILTER).cast("long"))
    own = running_sum(own, "number", "filters", "before").withColumn("run", F.when(F.col("engine") == FILTER, F.col("number") - F.col("before")).otherwise(-1))
    first = own.groupBy("engine", "run").agg(F.min("before").alias("first"))
    own = own.join(first, ["engine", "run"]).withColumn("chunk", F.when(F.col("engine") == FILTER, F.expr(f"(before - first) div {k}")).otherwise(-1))
    tasks = own.groupBy("engine", "run", "chunk").agg(F.array_sort(F.collect_list("pid")).alias("partition_indices"))
    tasks = tasks.select("engine", F.element_at("partition_indices", 1).alias("first"), (F.element_at("partition_indices", -1) + 1).alias("end"), F.size("partition_indices").cast("long").alias("partition_count"), "partition_indices")
    return ranked(tasks, ["first"], "task_id").select("task_id", "engine", "first", "end", "partition_count", "partition_indices")


def metrics(tasks: DataFrame) -> DataFrame:
    """One row: logical_tasks, executable_tasks, filter_combined, compaction_combined, zero_copy_combined, reduced, reduction."""
    n = F.col("partition_count")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = tasks.agg(
        zero(F.sum(n)).alias("logical_tasks"), F.count("*").alias("executable_tasks"),
        zero(F.sum(F.when(F.col("engine") == FILTER, n - 1))).alias("filter_combined"),
        zero(F.sum(F.when(F.col("engine") == COMPACTION, n))).alias("compaction_combined"),
        zero(F.sum(F.when(F.col("engine") == ZERO_COPY, n))).alias("zero_copy_combined"),
    )
    return out.withColumns({"reduced": F.col("executable_tasks") < F.col("logical_tasks"), "reduction": F.col("logical_tasks") - F.col("executable_tasks")})
