"""Active vertices and what they touch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlane.functions import running_sums
from graphlane.graph import Graph


class Activity:
    """A set of active vertices of a graph of n: a DataFrame of distinct v."""

    def __init__(self, spark: SparkSession, n: int, active: DataFrame | None = None) -> None:
        self.spark, self.n = spark, n
        self.active = active.select("v").distinct() if active is not None else spark.createDataFrame([], "v long")

    def _rows(self, vertices: Iterable[int]) -> DataFrame:
        own = list(vertices)
        if any(not 0 <= v < self.n for v in own):
            raise IndexError("no such vertex")
        return self.spark.createDataFrame([(v,) for v in own], "v long")

    def vertex_count(self) -> int:
        return self.n

    def clear(self) -> None:
        self.active = self.spark.createDataFrame([], "v long")

    def set_active(self, v: int, on: bool = True) -> None:
        row = self._rows([v])
        self.active = self.active.union(row).distinct() if on else self.active.join(row, "v", "left_anti")

    def is_active(self, v: int) -> bool:
        return self.active.join(self._rows([v]), "v", "left_semi").limit(1).count() > 0

    def set_active_vertices(self, vertices: Iterable[int]) -> None:
        self.active = self._rows(vertices).distinct()

    def active_vertices(self) -> DataFrame:
        return self.active.orderBy("v")

    def active_vertex_count(self) -> int:
        return self.active.count()

    def _fits(self, graph: Graph) -> None:
        if graph.n != self.n:
            raise ValueError("the graph has another number of vertices")

    def active_edge_count(self, graph: Graph) -> int:
        self._fits(graph)
        return graph.vertices.join(self.active, "v", "left_semi").agg(F.coalesce(F.sum("deg"), F.lit(0))).first()[0]

    def partition_statistics(self, graph: Graph, ranges: DataFrame) -> DataFrame:
        self._fits(graph)
        return range_statistics(graph, self.active, ranges)


def check_ranges(ranges: DataFrame, n: int) -> None:
    r = ranges.agg(F.max((F.col("v_begin") > F.col("v_end")).cast("int")).alias("reversed"), F.max("v_end").alias("end"), F.min("v_begin").alias("begin")).first()
    if r.reversed:
        raise ValueError("a range ends before it begins")
    if r.end is not None and (r.end > n or r.begin < 0):
        raise IndexError("a range goes past the vertices")


def range_statistics(graph: Graph, active: DataFrame, ranges: DataFrame, check: bool = True) -> DataFrame:
    """ranges: pid, v_begin, v_end, which may overlap, be empty or leave vertices out. Adds active_vertices,
    active_edges, total_edges, has_active_vertices, has_active_edges.

    Each sum is the difference of two running sums over the vertices, looked up at the range's ends by equi-joins.
    """
    if check:
        check_ranges(ranges, graph.n)
    marked = graph.vertices.join(active.select("v", F.lit(1).cast("long").alias("on")), "v", "left").select("v", "deg", F.coalesce("on", F.lit(0)).alias("on"))
    marked = marked.withColumn("live", F.col("on") * F.col("deg"))
    sums = running_sums(marked, "v", {"s_on": "on", "s_live": "live", "s_deg": "deg"}).select("v", "s_on", "s_live", "s_deg")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = sums.unionByName(marked.agg(F.lit(graph.n).cast("long").alias("v"), zero("on").alias("s_on"), zero("live").alias("s_live"), zero("deg").alias("s_deg")))
    at = lambda end: sums.select(F.col("v").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("s_on", "s_live", "s_deg")))
    out = ranges.join(at("v_begin"), "v_begin").join(at("v_end"), "v_end")
    named = {"active_vertices": "s_on", "active_edges": "s_live", "total_edges": "s_deg"}
    out = out.select(*ranges.columns, *((F.col(f"{c}_v_end") - F.col(f"{c}_v_begin")).alias(name) for name, c in named.items()))
    return out.withColumns({"has_active_vertices": F.col("active_vertices") > 0, "has_active_edges": F.col("active_edges") > 0})
