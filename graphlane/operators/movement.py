"""Plans for moving what is active: whole partitions, packed active rows, or direct requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlane.functions import ceil_div, ranked, running_sum
from graphlane.graph import OFFSET_BYTES, VERTEX_BYTES, Graph
from graphlane.operators.activity import range_statistics
from graphlane.operators.partitioning import check_cover, check_rows


def filter_plan(graph: Graph, parts: DataFrame, active: DataFrame, enabled: bool = True, check: bool = True) -> DataFrame:
    """Whole partitions with active edges are transferred, all if disabled: pid, total_edges, active, transferred, edges and bytes."""
    if check:
        check_cover(graph, parts)
    s = range_statistics(graph, active, parts, check)
    moved = F.col("has_active_edges") if enabled else F.lit(True)
    edges = F.col("e_end") - F.col("e_begin")
    return s.select("pid", "v_begin", "v_end", edges.alias("total_edges"), "active_edges", F.col("has_active_edges").alias("active"), moved.alias("transferred"), F.when(moved, edges).otherwise(0).alias("transferred_edges"), F.when(moved, edges * VERTEX_BYTES).otherwise(0).alias("transferred_bytes"))


def filter_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_if("active").alias("active_partitions"), F.count_if("transferred").alias("transferred_partitions"), F.coalesce(F.sum("transferred_edges"), F.lit(0)).alias("transferred_edges"), F.coalesce(F.sum("transferred_bytes"), F.lit(0)).alias("transferred_bytes"))


def _placed(graph: Graph, parts: DataFrame, active: DataFrame) -> DataFrame:
    """Active vertices with their partition: pid, v, deg, e0.

    Partitions don't overlap, so a vertex lies in the last one that begins up to it: the running count of begins is that
    one's number in order, by which both sides meet.
    """
    full = ranked(parts.where("v_begin < v_end").select("pid", "v_begin", "v_end"), ["v_begin"], "number")
    begins = full.select(F.col("v_begin").alias("v"), F.lit(1).cast("long").alias("begins"))
    every = graph.vertices.select("v", "deg", "e0").join(begins, "v", "left").withColumn("begins", F.coalesce("begins", F.lit(0)))
    numbered = running_sum(every, "v", "begins", "before").select("v", "deg", "e0", (F.col("before") + F.col("begins") - 1).alias("number"))
    return numbered.join(active, "v", "left_semi").join(full, "number").where("v < v_end").select("pid", "v", "deg", "e0")


def compaction_index(graph: Graph, parts: DataFrame, active: DataFrame) -> DataFrame:
    """pid, v, index_begin, index_end: where each active vertex's neighbours lie within its packed partition. Flat, one row a vertex."""
    w = Window.partitionBy("pid").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _placed(graph, parts, active).withColumn("index_end", F.sum("deg").over(w)).select("pid", "v", (F.col("index_end") - F.col("deg")).alias("index_begin"), "index_end")


def compaction_neighbors(graph: Graph, parts: DataFrame, active: DataFrame) -> DataFrame:
    """pid, position, dst: the packed neighbours in order. Flat, one row an edge."""
    own = compaction_index(graph, parts, active).join(graph.vertices.select("v", "e0"), "v")
    return graph.edges.join(own, graph.edges.src == own.v).select("pid", (F.col("index_begin") + F.col("edge_id") - F.col("e0")).alias("position"), "dst")


def compact(graph: Graph, parts: DataFrame, active: DataFrame, enabled: bool = True, check: bool = True) -> DataFrame:
    """A row per partition with active vertices: pid, active_vertices, neighbors, neighbor_index as arrays.

    The rows are as large as the partitions, whose target size bounds them; the flat forms above have no such rows.
    """
    if check:
        check_rows(graph, parts)
    index = compaction_index(graph, parts, active)
    if not enabled:
        index = index.limit(0)
    vs = index.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("v", "index_end"))).alias("rows"))
    ns = compaction_neighbors(graph, parts, active).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("position", "dst"))).alias("ns"))
    return vs.join(ns, "pid", "left").select("pid", F.col("rows.v").alias("active_vertices"), F.coalesce(F.col("ns.dst"), F.array().cast("array<long>")).alias("neighbors"), F.concat(F.array(F.lit(0).cast("long")), F.col("rows.index_end")).alias("neighbor_index"))


def compaction_sizes(compacted: DataFrame) -> DataFrame:
    e, v = F.size("neighbors").cast("long"), F.size("active_vertices").cast("long")
    return compacted.select("pid", e.alias("active_edge_count"), v.alias("active_vertex_count"), (e * VERTEX_BYTES).alias("neighbor_bytes"), ((v + 1) * OFFSET_BYTES).alias("index_bytes"), (e * VERTEX_BYTES + (v + 1) * OFFSET_BYTES).alias("total_bytes"))


def compaction_totals(sizes: DataFrame) -> DataFrame:
    names = ["active_edge_count", "active_vertex_count", "neighbor_bytes", "index_bytes", "total_bytes"]
    return sizes.agg(F.count("*").alias("partitions"), *(saturating_sum(c).alias(c) for c in names))


def saturating_sum(column: str) -> Column:
    """The sum, or the largest long if it is larger."""
    total = F.coalesce(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def expanded_neighbors(compacted: DataFrame) -> DataFrame:
    """pid, v, dst in order of position, after checks of the index."""
    i, n = F.col("neighbor_index"), F.size("neighbors")
    falls = F.exists(F.sequence(F.lit(1), F.size(i) - 1), lambda k: F.get(i, k) < F.get(i, k - 1))
    if compacted.where((F.size(i) != F.size("active_vertices") + 1) | (F.get(i, F.lit(0)) != 0) | (F.get(i, F.size(i) - 1) != n) | falls).limit(1).count():
        raise ValueError("a compacted partition has a wrong index")
    each = compacted.select("pid", "neighbors", "neighbor_index", F.posexplode("active_vertices").alias("k", "v"))
    span = F.slice("neighbors", F.get("neighbor_index", F.col("k")).cast("int") + 1, (F.get("neighbor_index", F.col("k") + 1) - F.get("neighbor_index", F.col("k"))).cast("int"))
    return each.select("pid", "v", F.posexplode(span).alias("at", "dst"))


@dataclass(frozen=True)
class DirectOptions:
    """enable_host_mapping is accepted and has no effect."""

    payload: int = 128
    max_requests: int = 256
    alignment: int = 128
    enable_host_mapping: bool = False

    def check(self) -> None:
        if min(self.payload, self.max_requests, self.alignment) <= 0:
            raise ValueError("sizes must be positive")


def direct_vertex_requests(graph: Graph, parts: DataFrame, active: DataFrame, options: DirectOptions = DirectOptions()) -> DataFrame:
    """pid, vertex, degree, memory_requests, alignment_overhead for each active vertex."""
    options.check()
    off = F.pmod(F.col("e0") * VERTEX_BYTES, F.lit(options.alignment))
    return _placed(graph, parts, active).select("pid", F.col("v").alias("vertex"), F.col("deg").alias("degree"), ceil_div(F.col("deg") * VERTEX_BYTES, options.payload).alias("memory_requests"), F.when((F.col("deg") != 0) & (off != 0), 1).otherwise(0).cast("long").alias("alignment_overhead"))


def direct_partitions(graph: Graph, parts: DataFrame, active: DataFrame, options: DirectOptions = DirectOptions(), check: bool = True) -> DataFrame:
    """A row per partition, zeros if nothing is active: active_vertices, active_edges, memory_requests, alignment_overhead, modeled_tlp (0), mode, host_memory_mapped."""
    if check:
        check_cover(graph, parts)
        check_rows(graph, parts)
    sums = direct_vertex_requests(graph, parts, active, options).groupBy("pid").agg(F.count("*").alias("active_vertices"), F.sum("degree").alias("active_edges"), F.sum("memory_requests").alias("memory_requests"), F.sum("alignment_overhead").alias("alignment_overhead"))
    names = ["active_vertices", "active_edges", "memory_requests", "alignment_overhead"]
    return parts.select("pid").join(sums, "pid", "left").fillna(0, names).select("pid", *names, F.lit(0).cast("long").alias("modeled_tlp"), F.lit("MODELED").alias("mode"), F.lit(False).alias("host_memory_mapped"))


def direct_totals(rows: DataFrame, options: DirectOptions = DirectOptions()) -> DataFrame:
    sums = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("active_vertices", "active_edges", "memory_requests", "alignment_overhead")))
    return sums.withColumn("modeled_tlp", ceil_div(F.col("memory_requests"), options.max_requests))
