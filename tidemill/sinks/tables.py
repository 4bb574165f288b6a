"""Tables as sinks: dispositions, routing, dead letters, merging."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.joins import upsert
from tidemill.operators.quality import error_table, split_bad, typed
from tidemill.scratch import remove

#: Destinations that rows may be routed to, each with a schema of its own.
MAX_DESTINATIONS = 1000


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in a schema's columns and types; absent columns are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_table(df: DataFrame, path: str, schema: T.StructType | None = None, truncate: bool = False, create: bool = True) -> None:
    """Append to a Parquet table, or replace it; without create, a missing one is an error."""
    if not create and not exists(df.sparkSession, path):
        raise FileNotFoundError(path)
    (df if schema is None else conform(df, schema)).write.mode("overwrite" if truncate else "append").parquet(path)


def route(df: DataFrame, destination: Column, root: str) -> None:
    """Append rows to root/destination=<name>, in one pass, whatever the number of destinations."""
    df.withColumn("destination", destination).repartition("destination", F.pmod(F.xxhash64(*df.columns, F.spark_partition_id()), F.lit(8))).write.mode("append").partitionBy("destination").parquet(root)


def route_by_schema(df: DataFrame, destination: Column, root: str, schemas: Mapping[str, Sequence[Column]]) -> dict[str, str]:
    """Append rows to root/<name> for each named destination, in the columns given for it; others are left out."""
    if len(schemas) > MAX_DESTINATIONS:
        raise ValueError(f"more than {MAX_DESTINATIONS} destinations")
    kept = df.withColumn("__destination", destination).persist()
    try:
        for name, columns in schemas.items():
            kept.filter(F.col("__destination") == name).select(*columns).write.mode("append").parquet(f"{root}/{name}")
    finally:
        kept.unpersist()
    return {name: f"{root}/{name}" for name in schemas}


def write_typed(df: DataFrame, schema: T.StructType, path: str, errors: str | None = None) -> tuple[str, str]:
    """Append rows that fit a schema to a table, and the others, as they were, to its error table; returns both paths."""
    checked = typed(df, schema).persist()
    bad_path = error_table(path, errors)
    try:
        good, bad = split_bad(checked)
        good.write.mode("append").parquet(path)
        bad.select(F.to_json(F.struct("*")).alias("original")).write.mode("append").parquet(bad_path)
    finally:
        checked.unpersist()
    return path, bad_path


def recovered(spark: SparkSession, path: str) -> bool:
    """Put a table back that a merge had moved aside and, ended half-way, not replaced; whether there was one."""
    if exists(spark, path) or not exists(spark, f"{path}-old"):
        return False
    return _renamed(spark, f"{path}-old", path)


def _renamed(spark: SparkSession, a: str, b: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return at(a).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at(a), at(b))


def merge_table(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str]) -> str:
    """Upsert changes into a Parquet table: the merged table is written beside it and then takes its place.

    For one writer at a time. Between two renames the table is at path-old alone: a merge that ends there is undone by
    the next one, or by recovered().
    """
    recovered(spark, path)
    fresh, old = f"{path}-{uuid.uuid4().hex}", f"{path}-old"
    there = exists(spark, path)
    (upsert(spark.read.parquet(path), changes, keys) if there else changes).write.parquet(fresh)
    remove(spark, old)
    if there:
        _renamed(spark, path, old)
    _renamed(spark, fresh, path)
    remove(spark, old)
    spark.catalog.refreshByPath(path)
    return path
