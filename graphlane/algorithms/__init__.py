"""Iterative graph analytics: supersteps of joins and aggregations, each written to the shared folder, which cuts its lineage."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlane.functions import stored
from graphlane.graph import Graph


@dataclass(frozen=True)
class PageRankOptions:
    damping: float = 0.85
    tolerance: float = 1e-6
    max_iterations: int = 100

    def check(self, n: int) -> None:
        if n < 1 or not 0 <= self.damping < 1 or not (math.isfinite(self.tolerance) and self.tolerance > 0) or self.max_iterations < 1:
            raise ValueError("a PageRank option is out of its range")


@dataclass(frozen=True)
class PageRankResult:
    ranks: DataFrame  # v, rank
    iterations: int
    residual: float
    converged: bool


def _pagerank_step(graph: Graph, ranks: DataFrame, damping: float) -> DataFrame:
    """ranks: v, rank, deg. v, rank, deg, old: one sweep. Parallel edges count once each; the mass of dangling vertices is shared by all."""
    base = (1 - damping) / graph.n
    loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("deg") == 0, F.col("rank"))), F.lit(0.0)).alias("loose"))
    sent = graph.edges.join(ranks.select(F.col("v").alias("src"), (F.col("rank") / F.when(F.col("deg") != 0, F.col("deg"))).alias("part")), "src").groupBy(F.col("dst").alias("v")).agg(F.sum("part").alias("got"))
    new = F.lit(base) + F.lit(damping) * F.col("loose") / F.lit(float(graph.n)) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
    return ranks.join(sent, "v", "left").crossJoin(F.broadcast(loose)).select("v", new.alias("rank"), "deg", F.col("rank").alias("old"))


def pagerank(graph: Graph, options: PageRankOptions = PageRankOptions()) -> PageRankResult:
    options.check(graph.n)
    ranks, step = graph.vertices.select("v", F.lit(1.0 / graph.n).alias("rank"), "deg"), None
    for k in range(1, options.max_iterations + 1):
        step = stored(_pagerank_step(graph, ranks, options.damping), step)
        residual = step.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = step.drop("old")
        if residual <= options.tolerance:
            return PageRankResult(ranks.select("v", "rank"), k, residual, True)
    return PageRankResult(ranks.select("v", "rank"), options.max_iterations, residual, False)


def pagerank_sweeps(graph: Graph, sweeps: int, damping: float = 0.85) -> DataFrame:
    """v, rank after so many sweeps, as one lazy plan."""
    ranks = graph.vertices.select("v", F.lit(1.0 / graph.n).alias("rank"), "deg")
    for _ in range(sweeps):
        ranks = _pagerank_step(graph, ranks, damping).drop("old")
    return ranks.select("v", "rank")


def pagerank_contributions(graph: Graph, ranks: DataFrame, options: PageRankOptions = PageRankOptions(), check: bool = True) -> DataFrame:
    """v, delta: how much one sweep would change each of the given ranks (v, rank)."""
    options.check(graph.n)
    if check and ranks.count() != graph.n:
        raise ValueError("there must be a rank for each vertex")
    step = _pagerank_step(graph, ranks.join(graph.vertices.select("v", "deg"), "v"), options.damping)
    return step.select("v", F.abs(F.col("rank") - F.col("old")).alias("delta"))


@dataclass(frozen=True)
class SSSPOptions:
    source: int = 0
    tolerance: float = 0.0
    max_iterations: int = 0  # 0: as many as there are vertices

    def check(self, n: int) -> None:
        if n < 1 or not 0 <= self.source < n or not (math.isfinite(self.tolerance) and self.tolerance >= 0):
            raise ValueError("a shortest-path option is out of its range")


@dataclass(frozen=True)
class SSSPResult:
    distances: DataFrame  # v, distance; infinite where nothing leads
    iterations: int
    converged: bool


CANDIDATES, RUN = "array<struct<edge_id:bigint,cand:double>>", 4096  # edges of a run that are looked at together


def _sssp_step(edges: DataFrame, state: DataFrame, tolerance: float) -> DataFrame:
    """state: v, distance, active. Relaxes the edges of active vertices against the old distances."""
    front = state.where("active").select(F.col("v").alias("src"), F.col("distance").alias("from"))
    cand = edges.join(front, "src").select(F.col("dst").alias("v"), "edge_id", (F.col("from") + F.col("weight")).alias("cand"))
    if tolerance == 0:
        best = cand.groupBy("v").agg(F.min("cand").alias("cand"))
        new = F.least("distance", F.coalesce("cand", F.lit(float("inf"))))
    else:
        # In the order of edges a candidate must beat the best so far by more than the tolerance. One that isn't below all
        # before it never does, so runs of edges keep only their falling candidates before a vertex's all meet.
        falling = F.aggregate("cands", F.array().cast(CANDIDATES), lambda a, c: F.when((F.size(a) == 0) | (c["cand"] < F.element_at(a, -1)["cand"]), F.concat(a, F.array(c))).otherwise(a))
        for run in (F.expr(f"edge_id div {RUN}"), None):
            keys = ["v"] if run is None else ["v", run.alias("run")]
            each = cand if "cand" in cand.columns else cand.select("v", F.explode("cands").alias("c")).select("v", "c.*")
            cand = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("edge_id", "cand"))).alias("cands")).select("v", falling.alias("cands"))
        best = cand
        new = F.aggregate(F.coalesce("cands", F.array().cast(CANDIDATES)), F.col("distance"), lambda b, c: F.when(c["cand"] + tolerance < b, c["cand"]).otherwise(b))
    return state.join(best, "v", "left").select("v", new.alias("new"), "distance").select("v", F.col("new").alias("distance"), (F.col("new") + tolerance < F.col("distance")).alias("active"))


def _weighted(graph: Graph) -> DataFrame:
    return graph.edges.select("edge_id", "src", "dst", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))


def _begin(graph: Graph, source: int) -> DataFrame:
    at = F.col("v") == source
    return graph.vertices.select("v", F.when(at, 0.0).otherwise(float("inf")).alias("distance"), at.alias("active"))


def sssp(graph: Graph, options: SSSPOptions = SSSPOptions()) -> SSSPResult:
    """The sweep that changes nothing ends the run and is counted."""
    options.check(graph.n)
    if graph.edges.where("weight < 0 or isnan(weight) or weight = double('inf')").limit(1).count():
        raise ValueError("weights must be finite and not negative")
    edges, state, most = _weighted(graph), _begin(graph, options.source), options.max_iterations or graph.n
    for k in range(1, most + 1):
        state = stored(_sssp_step(edges, state, options.tolerance), state)
        if not state.where("active").limit(1).count():
            return SSSPResult(state.select("v", "distance"), k, True)
    return SSSPResult(state.select("v", "distance"), most, False)


def sssp_hops(graph: Graph, source: int, hops: int) -> DataFrame:
    """v, distance over at most so many edges, as one lazy plan."""
    edges, state = _weighted(graph), _begin(graph, source)
    for _ in range(hops):
        state = _sssp_step(edges, state, 0.0)
    return state.select("v", "distance")


def improvement(current: Column, candidate: Column, tolerance: float = 0.0) -> Column:
    """current - candidate if both are finite and that is above the tolerance; 1 if newly reachable; else 0."""
    inf = F.lit(float("inf"))
    return F.when((current == inf) & (candidate < inf), 1.0).when((current < inf) & (candidate < inf) & (current - candidate > tolerance), current - candidate).otherwise(0.0)


def sssp_contributions(current: DataFrame, candidate: DataFrame, tolerance: float = 0.0, check: bool = True) -> DataFrame:
    """current and candidate: v, distance. v, improvement."""
    if check and current.count() != candidate.count():
        raise ValueError("both must have a distance for each vertex")
    pair = current.select("v", F.col("distance").alias("a")).join(candidate.select("v", F.col("distance").alias("b")), "v")
    return pair.select("v", improvement(F.col("a"), F.col("b"), tolerance).alias("improvement"))


def bfs(graph: Graph, source: int = 0) -> SSSPResult:
    """Levels: shortest paths over edges of weight 1."""
    plain = Graph(graph.n, graph.edges.withColumn("weight", F.lit(None).cast("float")), False, graph.vertices)
    return sssp(plain, SSSPOptions(source))


def connected_components(graph: Graph) -> DataFrame:
    """v, component (least vertex): both directions count. Labels of neighbours, then of the label itself, until nothing moves."""
    both = stored(graph.edges.select("src", "dst").union(graph.edges.select("dst", "src")).distinct())
    state = stored(graph.vertices.select("v", F.col("v").alias("component")))
    while True:
        near = both.join(state, both.src == state.v).groupBy("dst").agg(F.min("component").alias("near"))
        step = state.join(near, state.v == near.dst, "left").select("v", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = state.select(F.col("v").alias("component"), F.col("component").alias("up"))
        state = stored(step.join(up, "component").select("v", F.least("component", "up").alias("component"), (F.least("component", "up") < F.col("old")).alias("moved")), state)
        if not state.where("moved").limit(1).count():
            return state.select("v", "component")
