"""Bounded sources: literals, files as lines, whole files, compressed files, tables and notifications of files."""

from __future__ import annotations

import gzip
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths or patterns that a list of them, itself data, may hold.
MAX_PATHS = 100_000


def literal(spark: SparkSession, rows: Sequence, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def starter(spark: SparkSession, **values: object) -> DataFrame:
    """One row of parameters to start from."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def generated(spark: SparkSession, n: int, seed: int = 42, keys: int = 10) -> DataFrame:
    """n made rows: id, key, value."""
    return spark.range(n).select("id", F.floor(F.rand(seed) * keys).cast("int").alias("key"), F.round(F.rand(seed + 1) * 100, 2).alias("value"))


def lines(spark: SparkSession, *paths: str, with_path: bool = False) -> DataFrame:
    """value: a row for each line; with_path adds path."""
    read = spark.read.text(list(paths))
    return read.select(F.col("_metadata.file_path").alias("path"), "value") if with_path else read


def whole_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, value: each file's text."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def matched(spark: SparkSession, *globs: str) -> DataFrame:
    """path, length, modificationTime of files that match; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(list(globs)).select("path", "length", "modificationTime").distinct()


def listed(paths: DataFrame, column: str) -> list[str]:
    """The paths that a table lists; more than MAX_PATHS are an error."""
    found = [r[0] for r in paths.select(column).distinct().limit(MAX_PATHS + 1).collect()]
    if len(found) > MAX_PATHS:
        raise ValueError(f"more than {MAX_PATHS} paths")
    return sorted(found)


def lines_of(paths: DataFrame, column: str) -> DataFrame:
    """path, value of the lines of all files that a table lists."""
    found = listed(paths, column)
    return lines(paths.sparkSession, *found, with_path=True) if found else paths.sparkSession.createDataFrame([], "path string, value string")


def notified_paths(messages: DataFrame, payload: str, scheme: str) -> DataFrame:
    """path of each message {"id": bucket/path/generation} about a file."""
    name = F.regexp_replace(F.get_json_object(payload, "$.id"), "/[^/]*$", "")
    return messages.select(F.concat(F.lit(scheme), name).alias("path")).filter("path IS NOT NULL")


def gunzipped(spark: SparkSession, *paths: str) -> DataFrame:
    """path, ok, text, error of each compressed file; one that can't be read is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    out.append((path, True, gzip.decompress(content).decode(), None))
                except (OSError, EOFError, ValueError, gzip.zlib.error) as e:
                    out.append((path, False, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "ok", "text", "error"])

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(run, "path string, ok boolean, text string, error string")


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """A query over tables by the names given."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def selected(spark: SparkSession, path: str, *columns: str, where: Column | None = None) -> DataFrame:
    """Columns of a Parquet table; only they, and row groups that a filter allows, are read."""
    df = spark.read.parquet(path)
    return (df if where is None else df.filter(where)).select(*columns)
