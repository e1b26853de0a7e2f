"""Sources of graphs: edge-list text, tables, synthetic graphs."""

from __future__ import annotations


from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlane.graph import Graph


def load_edge_list(spark: SparkSession, path: str, num_vertices: int, weighted: bool = False) -> Graph:
    """Lines `src dst` or `src dst weight` by white space; blank lines and those that begin with # don't count.

    Edges stay in order of their lines within a source. Raises ValueError with the 1-based line of the first fault,
    RuntimeError if the file can't be read. Files are read in as many parts as they have blocks: a line's place is its
    file, its block and its row there, and only a fault's line is counted. Several files are read in order of their names.
    """
    try:
        raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    except AnalysisException as e:
        raise RuntimeError(f"can't read {path}") from e
    raw = raw.withColumn("row", F.monotonically_increasing_id())
    place = ["file", "block", "row"]
    lines = raw.withColumn("line", F.regexp_replace("value", r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).select(*place, F.split("line", r"\s+").alias("t"))
    number = lambda i: F.expr(f"CASE WHEN t[{i}] RLIKE '^[0-9]+$' THEN try_cast(t[{i}] AS BIGINT) END")
    parsed = lines.select(*place, F.size("t").alias("k"), F.when(F.size("t") > 0, number(0)).alias("src"), F.when(F.size("t") > 1, number(1)).alias("dst"), F.when(F.size("t") > 2, F.expr("try_cast(t[2] AS FLOAT)")).alias("weight"))
    bad = F.col("src").isNull() | F.col("dst").isNull() | (F.col("k") != (3 if weighted else 2)) | (F.col("weight").isNull() if weighted else F.lit(False))
    outside = (F.col("src") >= num_vertices) | (F.col("dst") >= num_vertices)
    fault = parsed.where(bad | outside).agg(F.min(F.struct(*place, (~bad).alias("outside")))).first()[0]
    if fault is not None:
        before = raw.where((F.col("file") == fault.file) & ((F.col("block") < fault.block) | ((F.col("block") == fault.block) & (F.col("row") < fault.row)))).count()
        raise ValueError(f"{'a vertex is out of range' if fault.outside else 'malformed edge'} at line {before + 1}")
    return Graph.from_edges(parsed.select("src", "dst", *(["weight"] if weighted else []), *place), num_vertices, weighted, order=place)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str, returns: bool = True) -> Graph:
    """Suppliers, then parts. An edge from supplier to part for each line item, and back where it was returned."""
    suppliers, parts = _t(spark, sf_dir, "supplier").count(), _t(spark, sf_dir, "part").count()
    item = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") + suppliers).alias("p"), F.col("l_quantity").cast("float").alias("weight"), "l_returnflag")
    edges = item.select(F.col("s").alias("src"), F.col("p").alias("dst"), "weight")
    if returns:
        edges = edges.union(item.where("l_returnflag = 'R'").select("p", "s", "weight"))
    return Graph.from_edges(edges, suppliers + parts, True, check=False)


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """As trade, without the way back: all parts are dangling."""
    return trade(spark, sf_dir, returns=False)


MODULUS = (1 << 31) - 1


def rmat(spark: SparkSession, scale: int, edges: int, a: float = 0.5, b: float = 0.2, c: float = 0.2, seed: int = 1) -> Graph:
    """2**scale vertices; each edge descends into one quarter of the matrix per bit, by two rounds of squares and products
    modulo MODULUS of its number, the bit and the seed. Parallel edges and self-loops stay."""
    e = spark.range(edges).select((F.col("id") % MODULUS).alias("e"))
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for bit in range(scale):
        x = (F.col("e") * 48271 + F.lit(seed * 69621 + bit * 16807 + 1)) % MODULUS
        x = (x * x + F.col("e")) % MODULUS
        u = (x * 16807 + F.lit(bit)) % MODULUS / F.lit(float(MODULUS))
        src = src * 2 + F.when(u >= a + b, 1).otherwise(0)
        dst = dst * 2 + F.when(((u >= a) & (u < a + b)) | (u >= a + b + c), 1).otherwise(0)
    return Graph.from_edges(e.select(src.alias("src"), dst.alias("dst")), 1 << scale, False, order=("dst",), check=False)
