"""Edges that arrive as a stream: degrees kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_degrees(edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """edges: a stream with src, dst. Each batch's degree changes are written to a folder of their own under path, which a
    repeated batch overwrites, so every edge counts once. All waiting edges are taken, then the query ends."""

    def write(batch: DataFrame, number: int) -> None:
        ends = batch.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
        ends.groupBy(F.col("x.v").alias("v")).agg(F.sum("x.o").alias("out_deg"), F.sum("x.i").alias("in_deg")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return edges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def degrees(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("v").agg(F.sum("out_deg").alias("out_deg"), F.sum("in_deg").alias("in_deg"))
