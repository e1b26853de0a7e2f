"""Costs of the three ways to move a partition, and the choice among them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlane.functions import ceil_div, is_finite
from graphlane.graph import Graph
from graphlane.operators.activity import range_statistics
from graphlane.operators.movement import DirectOptions, direct_partitions
from graphlane.operators.partitioning import check_rows

FILTER, COMPACTION, ZERO_COPY = "FILTER", "COMPACTION", "ZERO_COPY"


@dataclass(frozen=True)
class CostOptions:
    alpha: float = 0.80
    beta: float = 0.40
    gamma: float = 0.625
    payload: int = 128
    max_requests: int = 256
    rtt: float = 1.0
    throughput: float = 1.0
    neighbor_bytes: int = 4
    index_bytes: int = 8
    alignment: int = 128

    def __post_init__(self) -> None:
        finite = all(map(math.isfinite, (self.alpha, self.beta, self.gamma, self.rtt, self.throughput)))
        if not finite or self.alpha <= 0 or self.beta <= 0 or not 0 <= self.gamma <= 1 or self.rtt < 0 or self.throughput <= 0:
            raise ValueError("a cost parameter is out of its range")
        if min(self.payload, self.max_requests, self.neighbor_bytes, self.index_bytes, self.alignment) <= 0:
            raise ValueError("sizes must be positive")


def select_engine(f: Column, c: Column, z: Column, alpha: float = 0.80, beta: float = 0.40) -> Column:
    """COMPACTION if strictly below alpha * f and beta * z, else FILTER if strictly below z, else ZERO_COPY. Costs must be finite and not negative."""
    if not (math.isfinite(alpha) and math.isfinite(beta)) or alpha <= 0 or beta <= 0:
        raise ValueError("weights must be positive")
    bad = ~(is_finite(f) & is_finite(c) & is_finite(z)) | (F.least(f, c, z) < 0)
    return F.when(bad, F.raise_error(F.lit("costs must be finite and not negative")).cast("string")).when((c < alpha * f) & (c < beta * z), COMPACTION).when(f < z, FILTER).otherwise(ZERO_COPY)


def cost_inputs(graph: Graph, parts: DataFrame, active: DataFrame, o: CostOptions = CostOptions(), check: bool = True) -> DataFrame:
    """pid, total_edges, filter_bytes, active_vertices, active_edges, compaction_bytes, zc_requests, zc_alignment, zc_total."""
    if check:
        check_rows(graph, parts)
    s = range_statistics(graph, active, parts, check).select("pid", "total_edges", "active_vertices", "active_edges")
    z = direct_partitions(graph, parts, active, DirectOptions(o.payload, o.max_requests, o.alignment), check=False).select("pid", F.col("memory_requests").alias("zc_requests"), F.col("alignment_overhead").alias("zc_alignment"))
    return s.join(z, "pid").select(
        "pid", "total_edges", (F.col("total_edges") * o.neighbor_bytes).alias("filter_bytes"), "active_vertices", "active_edges",
        (F.col("active_edges") * o.neighbor_bytes + F.col("active_vertices") * o.index_bytes).alias("compaction_bytes"),
        "zc_requests", "zc_alignment", (F.col("zc_requests") + F.col("zc_alignment")).alias("zc_total"),
    )


def evaluate(inputs: DataFrame, o: CostOptions = CostOptions()) -> DataFrame:
    """inputs with filter_cost, compaction_cost, zc_rtt, zc_cost and engine."""
    unit = o.payload * o.max_requests
    f = ceil_div(F.col("filter_bytes"), unit) * F.lit(float(o.rtt))
    c = ceil_div(F.col("compaction_bytes"), unit) * F.lit(float(o.rtt)) + F.col("compaction_bytes") / F.lit(float(o.throughput))
    share = F.when(F.col("total_edges") == 0, 0.0).otherwise(F.col("active_edges") / F.when(F.col("total_edges") != 0, F.col("total_edges")))
    rtt = F.lit(o.gamma * o.rtt) + F.lit((1 - o.gamma) * o.rtt) * share
    out = inputs.withColumns({"filter_cost": f, "compaction_cost": c, "zc_rtt": rtt})
    out = out.withColumn("zc_cost", ceil_div(F.col("zc_total"), o.max_requests) * F.col("zc_rtt"))
    return out.withColumn("engine", select_engine(F.col("filter_cost"), F.col("compaction_cost"), F.col("zc_cost"), o.alpha, o.beta))
