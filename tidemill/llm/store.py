"""Shared storage for intermediate tables, and other small helpers on sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemill.scratch import remove
from tidemill.scratch import scratch as new_path

#: Bytes of one Arrow batch sent to Python (a row more, at most); bounds a worker's memory with long texts.
BATCH_BYTES = 4 << 20


def cut(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: its lineage ends there, and lost executors
    cost no more than the tasks that they ran."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._cut_path = path
    return found


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that nothing will read again."""
    for t in tables:
        remove(t.sparkSession, t._cut_path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by their bytes, not only by their rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_row(schema: str, rows: DataFrame) -> T.StructType:
    """A schema, with rows' column "row" if it has one."""
    return T.StructType([*T._parse_datatype_string(schema).fields, *[f for f in rows.schema.fields if f.name == "row"]])
