"""Hubs first: an order of vertices by the product of their degrees."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.functions import ranked, running_sum
from graphlane.graph import Graph

FRACTION = 0.08


def hub_count(n: int, fraction: float) -> int:
    """The least whole number from n * fraction on; within 1e-12 of a whole number, that one."""
    if not math.isfinite(fraction) or not 0 <= fraction <= 1:
        raise ValueError("the fraction must be from 0 to 1")
    x = n * fraction
    return min(n, round(x) if abs(x - round(x)) <= 1e-12 else math.ceil(x))


def scores(graph: Graph) -> DataFrame:
    """v, score: out-degree times in-degree over the product of their largest values, 0 if that is 0."""
    d = graph.vertices.select("v", "deg").join(graph.in_degrees(), "v")
    most = F.col("max_out") * F.col("max_in")
    value = F.when(most == 0, 0.0).otherwise((F.col("deg") * F.col("in_deg")).cast("double") / F.when(most != 0, most))
    return d.crossJoin(F.broadcast(graph.max_degrees())).select("v", value.alias("score"))


def order(graph: Graph, fraction: float = FRACTION) -> DataFrame:
    """v, score, is_hub, new_id: the hubs by score (larger first), then id; the others after them by id.

    Scores are ranked in ranges, the other vertices numbered by a two-level running sum, so no task sees all hubs.
    """
    k = hub_count(graph.n, fraction)
    marked = ranked(scores(graph), [F.desc("score"), "v"], "rank").withColumn("rest", (F.col("rank") >= k).cast("long"))
    placed = running_sum(marked, "v", "rest", "before")
    return placed.select("v", "score", (F.col("rank") < k).alias("is_hub"), F.when(F.col("rank") < k, F.col("rank")).otherwise(F.col("before") + k).alias("new_id"))
