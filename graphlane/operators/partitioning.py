"""Contiguous vertex ranges of about equal edge bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.functions import ranked
from graphlane.graph import VERTEX_BYTES, Graph

TARGET_BYTES = 32 << 20
CHUNK = 1 << 16  # vertices whose offsets the driver looks at together
SCHEMA = "pid long, v_begin long, v_end long, e_begin long, e_end long, target_bytes long"


@dataclass(frozen=True)
class LogicalPartition:
    v_begin: int
    v_end: int
    e_begin: int
    e_end: int
    target_bytes: int

    def __post_init__(self) -> None:
        if self.v_begin > self.v_end or self.e_begin > self.e_end:
            raise ValueError("a partition ends before it begins")
        if self.target_bytes <= 0:
            raise ValueError("the target must be positive")

    @property
    def vertex_count(self) -> int:
        return self.v_end - self.v_begin

    @property
    def edge_count(self) -> int:
        return self.e_end - self.e_begin

    @property
    def edge_data_bytes(self) -> int:
        return VERTEX_BYTES * self.edge_count


def _offset_chunks(graph: Graph) -> Iterator[tuple[int, np.ndarray]]:
    """The first vertex of each chunk in order, and where the rows of its vertices end."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("v")
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "ends": pa.array([rows.column("e1").to_numpy().astype("<i8").tobytes()], pa.binary())})

    each = graph.vertices.select("v", "e1", F.expr(f"v div {CHUNK}").alias("chunk")).groupBy("chunk").applyInArrow(pack, "chunk long, ends binary")
    together = -(-graph.n // (16 * CHUNK)) or 1  # partitions of 16 chunks: the driver holds two at most
    for r in each.repartitionByRange(together, "chunk").sortWithinPartitions("chunk").toLocalIterator(prefetchPartitions=True):
        yield r.chunk * CHUNK, np.frombuffer(r.ends, "<i8")


def partition(graph: Graph, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """pid, v_begin, v_end, e_begin, e_end, target_bytes, in order.

    A partition ends before the vertex whose row would take it past the target; a row is never split, and a row that
    alone is larger stands alone. Each partition depends on where the last one ended, so the offsets stream through the
    driver in order, a few chunks at a time, with one binary search per partition.
    """
    if target_bytes <= 0:
        raise ValueError("the target must be positive")
    rows: list[tuple[int, ...]] = []
    begin = e_begin = last = 0  # where the open partition begins, and the end of the rows seen so far
    for first, ends in _offset_chunks(graph):
        while True:
            # the first vertex here whose row goes past the target
            at = int(np.searchsorted(ends, e_begin + target_bytes // VERTEX_BYTES, side="right"))
            end = max(first + at, begin + 1)
            if end >= first + len(ends) and at >= len(ends):
                break
            e_end = int(ends[end - 1 - first]) if end > first else last
            rows.append((len(rows), begin, end, e_begin, e_end, target_bytes))
            begin, e_begin = end, e_end
            if end >= first + len(ends):
                break
        last = int(ends[-1])
    if begin < graph.n:
        rows.append((len(rows), begin, graph.n, e_begin, last, target_bytes))
    return graph.spark.createDataFrame(rows, SCHEMA)


def with_sizes(parts: DataFrame) -> DataFrame:
    return parts.withColumns({"vertex_count": F.col("v_end") - F.col("v_begin"), "edge_count": F.col("e_end") - F.col("e_begin"), "edge_data_bytes": (F.col("e_end") - F.col("e_begin")) * VERTEX_BYTES})


def check_cover(graph: Graph, parts: DataFrame) -> None:
    """Partitions follow one another and cover all vertices and edges: each is held against the next one in order of pid."""
    bounds = ["v_begin", "v_end", "e_begin", "e_end"]
    own = ranked(parts.select("pid", *bounds), ["pid"], "number")
    r = own.agg(
        F.count("*").alias("n"), F.max(((F.col("v_end") < F.col("v_begin")) | (F.col("e_end") < F.col("e_begin"))).cast("int")).alias("falls"),
        F.min_by(F.struct(*bounds), "number").alias("first"), F.max_by(F.struct(*bounds), "number").alias("last"),
    ).first()
    after = own.select((F.col("number") - 1).alias("number"), F.col("v_begin").alias("v_next"), F.col("e_begin").alias("e_next"))
    gaps = own.join(after, "number").where("v_end <> v_next or e_end <> e_next").limit(1).count()
    if r.falls or gaps or (r.n and (r.first.v_begin or r.first.e_begin)):
        raise ValueError("partitions must be contiguous")
    if (r.last.v_end if r.n else 0) != graph.n or (r.last.e_end if r.n else 0) != graph.m:
        raise ValueError("partitions must cover the graph")


def check_rows(graph: Graph, parts: DataFrame) -> None:
    """Each partition begins and ends where rows of the graph do."""
    bounds = parts.select(F.explode(F.array(F.struct(F.col("v_begin").alias("v"), F.col("e_begin").alias("e")), F.struct(F.col("v_end").alias("v"), F.col("e_end").alias("e")))).alias("x")).select("x.*")
    edge = graph.vertices.select("v", F.col("e0").alias("at")).union(graph.spark.createDataFrame([(graph.n, graph.m)], "v long, at long"))
    if bounds.join(edge, "v", "left").where("at is null or at <> e").limit(1).count():
        raise ValueError("a partition isn't aligned with the rows of the graph")
