"""Bounded sinks: text, CSV and JSON files, files by key or window, binary files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import stable_name


def write_lines(df: DataFrame, path: str, line: Column | None = None, shards: int | None = None, mode: str = "errorifexists") -> None:
    """A line for each row: its only column, or the given one; in so many files."""
    out = df if line is None else df.select(line.alias("value"))
    if shards == 1:
        out = out.coalesce(1)
    elif shards:
        out = out.repartition(shards)
    out.write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, header: bool = True, quote_all: bool = True, shards: int | None = 1) -> None:
    out = df.coalesce(shards) if shards else df
    out.write.option("header", header).option("quoteAll", quote_all).csv(path)


def write_by_key(df: DataFrame, path: str, key: str, line: Column, spread: int = 1) -> None:
    """A folder key=... of lines for each key; a key's rows go to one file, or to spread files where keys are large."""
    salt = F.pmod(F.xxhash64(*df.columns, F.spark_partition_id()), F.lit(spread))  # equal rows are spread too
    df.select(key, line.alias("value"), salt.alias("__salt")).repartition(F.col(key), F.col("__salt")).drop("__salt").write.partitionBy(key).text(path)


def write_json_by_hash(df: DataFrame, path: str) -> None:
    """Each row as JSON, in a folder named by its hash."""
    df.select(stable_name(*df.columns).alias("name"), F.to_json(F.struct("*")).alias("value")).write.partitionBy("name").text(path)


def write_by_window(df: DataFrame, path: str, window: str, line: Column) -> None:
    """A folder of lines for each window, named by its bounds."""
    bound = lambda end: F.date_format(F.col(window)[end], "yyyy-MM-dd'T'HH-mm-ss")
    write_by_key(df.withColumn("window_label", F.concat_ws("_", bound("start"), bound("end"))), path, "window_label", line)


def rename_parts(spark: SparkSession, path: str, name: Callable[[str, int], str]) -> list[str]:
    """Move a keyed table's part files to names of the caller's, made of the key and the file's number among the key's.

    A driver loop over files, for tables of few keys.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    out = []
    for folder in fs.listStatus(root):
        if not folder.isDirectory():
            continue
        key = folder.getPath().getName().partition("=")[2]
        parts = sorted(str(f.getPath()) for f in fs.listStatus(folder.getPath()) if re.match("part-", f.getPath().getName()))
        for i, part in enumerate(parts):
            to = jvm.org.apache.hadoop.fs.Path(root, name(key, i))
            fs.rename(jvm.org.apache.hadoop.fs.Path(part), to)
            out.append(to.getName())
        fs.delete(folder.getPath(), True)
    return sorted(out)


def write_binary(df: DataFrame, folder: str, name: str, data: str) -> int:
    """A file for each row, of a binary column; returns how many. A task that runs again writes the same files again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(base, recursive=True)
        n = 0
        for b in batches:
            for file, content in zip(b[name], b[data], strict=True):
                with store.open_output_stream(f"{base}/{file}", compression=None) as f:  # as it is, whatever it is called
                    f.write(content)
                n += 1
        yield pd.DataFrame({"n": [n]})

    return df.select(name, data).mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def rastered(df: DataFrame, segments: str, name: str = "image", size: int = 64, top: int = 255) -> DataFrame:
    """df with a column of images: segments ((x0, y0), (x1, y1)) of 0..top drawn as a binary portable graymap."""
    import numpy as np
    from pyspark.sql import types as T

    def draw(row: list | None) -> bytes:
        image = np.zeros((size, size), np.uint8)
        for s in row if row is not None else ():
            n = 2 * max(abs(s["x1"] - s["x0"]), abs(s["y1"] - s["y0"]), 1)
            t = np.linspace(0, 1, n + 1)
            x, y = (np.clip(np.rint((s[a] + t * (s[b] - s[a])) * (size - 1) / top), 0, size - 1).astype(int) for a, b in (("x0", "x1"), ("y0", "y1")))
            image[y, x] = 255
        return b"P5 %d %d 255\n" % (size, size) + image.tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns=[segments]).assign(**{name: [draw(x) for x in b[segments]]})

    rest = df.drop(segments)
    return df.select(*rest.columns, segments).mapInPandas(run, T.StructType([*rest.schema.fields, T.StructField(name, T.BinaryType())]))
