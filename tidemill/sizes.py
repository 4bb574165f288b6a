"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemill.scratch import scratch

#: Rows, and bytes as JSON text, of a side that may be copied to every executor.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 200_000, 64 << 20


def measured(df: DataFrame) -> tuple[DataFrame, int, int]:
    """df, its rows, and their bytes as JSON text. It is computed once, written, and read from there from then on."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "side")
    watch = Observation()
    df.observe(watch, F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), watch.get["rows"], watch.get["bytes"]


def small_side(df: DataFrame, rows: int = MAX_BROADCAST_ROWS, size: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if it has at most so many rows and bytes; otherwise Spark chooses a shuffled join."""
    found, n, length = measured(df)
    return F.broadcast(found) if n <= rows and length <= size else found
