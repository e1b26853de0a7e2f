"""Directed multigraphs as DataFrames: vertices (v, deg, e0, e1) and edges (edge_id, src, dst, weight)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlane.functions import ranked, running_sum, stored

MAX_VERTICES = 1 << 32
VERTEX_BYTES, OFFSET_BYTES = 4, 8  # fixed values of the storage model: a neighbour id and an offset


@dataclass
class Graph:
    """n dense vertex ids from 0; isolated vertices, self-loops and parallel edges are allowed.

    Positions of edges are contiguous by source. weight is null on all edges or on none (has_weights).
    """

    n: int
    edges: DataFrame
    has_weights: bool
    _vertices: DataFrame | None = field(default=None, repr=False)
    _m: int | None = field(default=None, repr=False)

    # construction

    @classmethod
    def from_edges(cls, edges: DataFrame, n: int, weighted: bool, order: Sequence[str] = ("dst", "weight"), check: bool = True) -> Graph:
        """edges: src, dst and, if weighted, weight, with the columns of order to place the edges of a source.

        Edges are sorted in ranges of (source, order), so a hub's edges are dealt to several tasks too, and written once:
        what is done with the graph later reads them there.
        """
        spark = edges.sparkSession
        if not 0 <= n <= MAX_VERTICES:
            raise ValueError("the number of vertices must be from 0 to 2**32")
        if not weighted:
            edges = edges.withColumn("weight", F.lit(None).cast("float"))
        placed = ranked(edges, ["src", *order], "_place").select(F.col("_place").alias("edge_id"), "src", "dst", F.col("weight").cast("float").alias("weight"))
        graph = cls(n, placed, weighted)
        if check:
            graph._check_edges()
        graph._vertices = stored(offsets(spark, n, placed.groupBy("src").agg(F.count("*").alias("deg"))))
        return graph

    @classmethod
    def from_csr(cls, spark: SparkSession, n: int, row_offsets: Sequence[int], dst: Sequence[int], weights: Sequence[float] = ()) -> Graph:
        """From the arrays of a small graph, with all checks of such arrays."""
        if len(row_offsets) != n + 1:
            raise ValueError("row offsets must have one entry more than there are vertices")
        if row_offsets[0] != 0:
            raise ValueError("the first row offset must be 0")
        if any(a > b for a, b in zip(row_offsets, row_offsets[1:], strict=False)):
            raise ValueError("row offsets must not decrease")
        if row_offsets[-1] != len(dst):
            raise ValueError("the last row offset must be the number of edges")
        if any(not 0 <= d < n for d in dst):
            raise ValueError("a destination isn't a vertex")
        if len(weights) not in (0, len(dst)) or (weights and not dst):
            raise ValueError("there must be a weight for each edge or none at all")
        src = [v for v in range(n) for _ in range(row_offsets[v], row_offsets[v + 1])]
        rows = [(i, s, d, float(weights[i]) if weights else None) for i, (s, d) in enumerate(zip(src, dst, strict=True))]
        edges = spark.createDataFrame(rows, "edge_id long, src long, dst long, weight float")
        vertices = spark.createDataFrame([(v, row_offsets[v + 1] - row_offsets[v], row_offsets[v], row_offsets[v + 1]) for v in range(n)], "v long, deg long, e0 long, e1 long")
        return cls(n, edges, bool(weights), vertices, len(dst))

    # projections

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def m(self) -> int:
        if self._m is None:
            self._m = self.edges.count()
        return self._m

    @property
    def vertices(self) -> DataFrame:
        if self._vertices is None:
            self._vertices = offsets(self.spark, self.n, self.edges.groupBy("src").agg(F.count("*").alias("deg")))
        return self._vertices

    def num_vertices(self) -> int:
        return self.n

    def num_edges(self) -> int:
        return self.m

    def _vertex(self, v: int):
        if not 0 <= v < self.n:
            raise IndexError("no such vertex")
        return self.vertices.where(F.col("v") == v).first()

    def out_degree(self, v: int) -> int:
        return self._vertex(v).deg

    def neighbor_range(self, v: int) -> tuple[int, int]:
        r = self._vertex(v)
        return r.e0, r.e1

    def _edge(self, e: int):
        if not 0 <= e < self.m:
            raise IndexError("no such edge")
        return self.edges.where(F.col("edge_id") == e).first()

    def neighbor_at(self, e: int) -> int:
        return self._edge(e).dst

    def weight_at(self, e: int) -> float:
        if not self.has_weights:
            raise RuntimeError("the graph has no weights")
        return self._edge(e).weight

    def to_csr(self) -> tuple[list[int], list[int], list[float]]:
        """The arrays, on the driver: for small graphs."""
        v = self.vertices.orderBy("v").collect()
        e = self.edges.orderBy("edge_id").collect()
        return [0] + [r.e1 for r in v], [r.dst for r in e], [r.weight for r in e] if self.has_weights else []

    def in_degrees(self) -> DataFrame:
        """v, in_deg, zero for vertices without incoming edges."""
        own = self.edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("in_deg"))
        return self.spark.range(self.n).withColumnRenamed("id", "v").join(own, "v", "left").select("v", F.coalesce("in_deg", F.lit(0)).alias("in_deg"))

    def max_degrees(self) -> DataFrame:
        """One row: max_out, max_in."""
        out = self.edges.groupBy("src").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("max_out"))
        return out.crossJoin(self.edges.groupBy("dst").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("max_in")))

    def dangling(self) -> DataFrame:
        """Vertices without outgoing edges."""
        return self.vertices.where("deg = 0").select("v")

    # checks and structure

    def _check_edges(self) -> None:
        r = self.edges.agg(
            F.coalesce(F.min(F.least("src", "dst")), F.lit(0)).alias("low"),
            F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)).alias("high"),
            F.sum(F.when(F.col("src").isNull() | F.col("dst").isNull(), 1).otherwise(0)).alias("nulls"),
            F.count("weight").alias("weights"), F.count("*").alias("m"),
        ).first()
        if r.low < 0 or r.high >= self.n or r.nulls:
            raise ValueError("an edge has an end that isn't a vertex")
        if r.weights != (r.m if self.has_weights else 0):
            raise ValueError("there must be a weight for each edge or none at all")
        self._m = r.m

    def validate(self) -> None:
        """One job over edges, one over vertices; raises ValueError."""
        self._check_edges()
        w = Window.partitionBy(F.expr("v div 65536")).orderBy("v")
        bad = self.vertices.where((F.col("e1") - F.col("e0") != F.col("deg")) | (F.col("deg") < 0))
        broken = self.vertices.withColumn("p", F.lag("e1").over(w)).where(F.col("p").isNotNull() & (F.col("p") != F.col("e0")))
        r = self.vertices.agg(F.count("*").alias("n"), F.min("e0").alias("a"), F.max("e1").alias("b")).first()
        if r.n != self.n or (self.n and (r.a != 0 or r.b != self.m)) or bad.limit(1).count() or broken.limit(1).count():
            raise ValueError("offsets don't fit the edges")

    def transpose(self) -> DataFrame:
        """Incoming edges: dst, src, weight (1 where there is none), in_pos by destination, then edge position."""
        placed = ranked(self.edges, ["dst", "edge_id"], "_place")
        first = placed.groupBy("dst").agg(F.min("_place").alias("_first"))
        return placed.join(first, "dst").select("dst", "src", F.coalesce("weight", F.lit(1.0).cast("float")).alias("weight"), "edge_id", (F.col("_place") - F.col("_first")).alias("in_pos"))

    def reorder(self, order: DataFrame) -> Graph:
        """order: new_id, old. Rows move, ends are renamed, each row's edges keep their order and weights."""
        r = order.agg(F.count("*").alias("n"), F.countDistinct("old").alias("olds"), F.countDistinct("new_id").alias("news"), F.min("old").alias("a"), F.max("old").alias("b"), F.min("new_id").alias("c"), F.max("new_id").alias("d")).first()
        if (r.n, r.olds, r.news) != (self.n,) * 3 or (self.n and (r.a, r.b, r.c, r.d) != (0, self.n - 1, 0, self.n - 1)):
            raise ValueError("the order must be a permutation of all vertices")
        src = order.select(F.col("old").alias("src"), F.col("new_id").alias("new_src"))
        dst = order.select(F.col("old").alias("dst"), F.col("new_id").alias("new_dst"))
        moved = self.edges.join(src, "src").join(dst, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "weight", "edge_id")
        return Graph.from_edges(moved, self.n, self.has_weights, order=("edge_id",), check=False)


def offsets(spark: SparkSession, n: int, degrees: DataFrame) -> DataFrame:
    """degrees: src, deg. v, deg, e0, e1 of all n vertices."""
    every = spark.range(n).withColumnRenamed("id", "v").join(degrees.withColumnRenamed("src", "v"), "v", "left").select("v", F.coalesce("deg", F.lit(0)).alias("deg"))
    return running_sum(every, "v", "deg", "e0").select("v", "deg", "e0", (F.col("e0") + F.col("deg")).alias("e1"))
