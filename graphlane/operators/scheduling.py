"""Work items in order of what they contribute."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlane.functions import is_finite, ranked


@dataclass(frozen=True)
class ScheduleOptions:
    """policy is accepted and has no effect."""

    policy: str = "DESCENDING"
    deterministic_ties: bool = True
    zero_epsilon: float = 0.0


def priorities(spark: SparkSession, items: Sequence[int], values: Sequence[float]) -> DataFrame:
    """input_pos, item_index, contribution."""
    if len(items) != len(values):
        raise ValueError("there must be a contribution for each item")
    return spark.createDataFrame([(k, i, float(v)) for k, (i, v) in enumerate(zip(items, values, strict=True))], "input_pos long, item_index long, contribution double")


def schedule(prios: DataFrame, options: ScheduleOptions = ScheduleOptions(), check: bool = True) -> DataFrame:
    """prios with position: larger contributions first, ties by item_index and then input position, or by that alone."""
    ties = ["item_index", "input_pos"] if options.deterministic_ties else ["input_pos"]
    out = ranked(prios, [F.desc("contribution"), *ties], "position")
    if check and out.where(F.col("contribution").isNull() | ~is_finite(F.col("contribution"))).limit(1).count():
        raise ValueError("contributions must be finite")
    return out


@dataclass(frozen=True)
class Plan:
    """A schedule with its accessors."""

    rows: DataFrame

    def size(self) -> int:
        return self.rows.count()

    def empty(self) -> bool:
        return not self.rows.limit(1).count()

    def reordered(self) -> bool:
        return self.rows.where("position <> input_pos").limit(1).count() > 0


def synchronous_reference(prios: DataFrame) -> DataFrame:
    return prios.withColumn("position", F.col("input_pos"))


def overhead(n: int) -> float:
    return math.log2(n) if n else 0.0


def metrics(plan: DataFrame, options: ScheduleOptions = ScheduleOptions()) -> DataFrame:
    """One row: input_count, scheduled_count, reordered, zero, redundant, overhead."""
    n = F.count("*")
    return plan.agg(
        n.alias("input_count"), n.alias("scheduled_count"), F.count_if(F.col("position") != F.col("input_pos")).alias("reordered"),
        F.count_if(F.abs("contribution") <= options.zero_epsilon).alias("zero"), (n - F.countDistinct("item_index")).alias("redundant"),
        F.when(n > 0, F.log2(F.greatest(n, F.lit(1)).cast("double"))).otherwise(0.0).alias("overhead"),
    )


def reference_metrics(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("input_count"), F.count_if(F.col("contribution") == 0).alias("zero"))


def work_metrics(prios: DataFrame, observations: DataFrame | None = None, epsilon: float = 0.0) -> DataFrame:
    """redundant, zero and stale (of observations item_index, stale; 0 without them)."""
    out = prios.agg((F.count("*") - F.countDistinct("item_index")).alias("redundant"), F.count_if(F.abs("contribution") <= epsilon).alias("zero"))
    if observations is None:
        return out.withColumn("stale", F.lit(0).cast("long"))
    return out.crossJoin(observations.agg(F.count_if("stale").alias("stale")))
