"""Column helpers, numbering of rows in order, and lineage control."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ceil_div(a: Column, b: int) -> Column:
    """Integer ceiling of a / b for a >= 0, in whole numbers throughout; ANSI long arithmetic raises on overflow."""
    top = a.cast("long") + F.lit(b - 1).cast("long")
    whole = top - F.pmod(top, F.lit(b).cast("long"))
    return (whole.cast("decimal(20,0)") / F.lit(b).cast("decimal(20,0)")).cast("long")


def is_finite(c: Column) -> Column:
    return ~(F.isnan(c) | (F.abs(c) == float("inf")))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session may lack that setting and then gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="graphlane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read again: outlives lost executors, cuts lineage.

    instead_of: an earlier result of this function that nothing reads any more; its files go.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphlane-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if old := getattr(instead_of, "stored_at", None):
        folder = spark._jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out


def running_sums(df: DataFrame, key: str, sums: Mapping[str, str], rows_per_chunk: int = 1 << 16) -> DataFrame:
    """df with, for each (out, value) of sums, the sum of value over all smaller keys (integers, distinct), in two levels.

    Chunks of the key range are summed apart from one another; only their totals, one row per chunk, meet in one task.
    """
    d = df.withColumn("_chunk", F.expr(f"{key} div {rows_per_chunk}"))
    totals = d.groupBy("_chunk").agg(*(F.sum(v).alias(f"_total_{o}") for o, v in sums.items()))
    before = Window.orderBy("_chunk")
    base = totals.select("_chunk", *((F.sum(f"_total_{o}").over(before) - F.col(f"_total_{o}")).alias(f"_base_{o}") for o in sums))
    inner = Window.partitionBy("_chunk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = d.withColumns({f"_before_{o}": F.coalesce(F.sum(v).over(inner), F.lit(0)) for o, v in sums.items()})
    return own.join(base, "_chunk").select(*df.columns, *((F.col(f"_base_{o}") + F.col(f"_before_{o}")).alias(o) for o in sums))


def running_sum(df: DataFrame, key: str, value: str, out: str, rows_per_chunk: int = 1 << 16) -> DataFrame:
    return running_sums(df, key, {out: value}, rows_per_chunk)


def ranked(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """df with each row's place in the order, from 0; rows that the order doesn't tell apart stand in any order.

    Rows are sorted in ranges of the order and written; a row's place is that in its range, plus the rows of the ranges
    before. No task sees more than a range, and only one count per range goes to the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = {"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    placed = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns(own))
    bases, base = [], 0
    for r in placed.groupBy("_part").count().orderBy("_part").collect():
        bases.append((r["_part"], base))
        base += r["count"]
    before = F.broadcast(spark.createDataFrame(bases, "_part int, _base long"))
    return placed.join(before, "_part").select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_base") + F.col("_row")).alias(out))
