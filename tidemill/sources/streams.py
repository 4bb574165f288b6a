"""Unbounded sources. Messages are JSON files in a folder here; a broker's source gives the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "payload string, attributes map<string,string>, publish_time timestamp"


def polled_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """path, value of each line of each file as it appears in a folder or below."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select(F.col("_metadata.file_path").alias("path"), "value")


def records(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Rows of JSON files as they appear."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def messages(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """payload, attributes, publish_time."""
    return records(spark, folder, MESSAGE, files_per_batch)


def topics(spark: SparkSession, **folders: str) -> DataFrame:
    """Messages of several topics, each with its topic's name."""
    out = None
    for name, folder in folders.items():
        one = messages(spark, folder).withColumn("topic", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def attribute(name: str) -> Column:
    """A message's attribute; null if it has none of that name."""
    return F.try_element_at(F.col("attributes"), F.lit(name))


def decoded(payload: str) -> Column:
    return F.decode(payload, "UTF-8")


def heartbeat(spark: SparkSession, seconds: int = 5, start_ms: int | None = None) -> DataFrame:
    """beat, ts: a row each so many seconds of event time, one a micro-batch, from start_ms or now on."""
    reader = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", seconds * 1000)
    if start_ms is not None:
        reader = reader.option("startTimestamp", start_ms)
    return reader.load().select(F.col("value").alias("beat"), F.col("timestamp").alias("ts"))
