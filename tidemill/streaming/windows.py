"""Windowed aggregates over streams. Event times are timestamps (UTC); only closed windows come out in append mode.

One delay says both how long a window waits and how late an event may be. Strict sessions end where the next event
begins one gap after the last: Spark would join them, so gaps are a microsecond shorter and ends are put right.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(stream: DataFrame, ts: str, size: str, delay: str, every: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """keys, window_start, window_end, n."""
    w = F.window(ts, size, every) if every else F.window(ts, size)
    return stream.withWatermark(ts, delay).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def counted_at_end(stream: DataFrame, ts: str, size: str, delay: str) -> DataFrame:
    """at, n: windows' counts stamped with the window's last moment, a microsecond before its end, as later windows see it."""
    grouped = stream.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(F.window_time("w").alias("at"), "n")


def sessions(stream: DataFrame, keys: Sequence[str], ts: str, gap_seconds: Column | float, delay: str, *measures: Column) -> DataFrame:
    """keys, session_start, session_end, n and measures; gap_seconds is a number or a column of each row's own, above 0."""
    gap = gap_seconds if isinstance(gap_seconds, Column) else F.lit(float(gap_seconds))
    micros = (gap.cast("double") * 1_000_000).cast("long") - 1
    w = F.session_window(ts, F.concat(micros.cast("string"), F.lit(" microseconds")))
    grouped = stream.withWatermark(ts, delay).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), *measures)
    rest = [c for c in grouped.columns if c not in ("w", *keys)]
    return grouped.select(*keys, F.col("w.start").alias("session_start"), (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("session_end"), *rest)


def lag_differences(stream: DataFrame, keys: Sequence[str], ts: str, value: str, size: str, delay: str) -> DataFrame:
    """keys, window_start, new, old, diff: each event also stands, as old, in the next window; one aggregate has both."""
    both = stream.select(*keys, F.col(ts), F.col(ts).alias("__at"), F.col(value).alias("__v"), F.explode(F.array(F.lit(False), F.lit(True))).alias("__old"))
    moved = both.withColumn(ts, F.when(F.col("__old"), F.col(ts) + F.expr(f"INTERVAL {size}")).otherwise(F.col(ts)))
    first = lambda old: F.min_by(F.when(F.col("__old") == old, F.col("__v")), F.when(F.col("__old") == old, F.struct("__at", "__v")))
    agg = moved.withWatermark(ts, delay).groupBy(*keys, F.window(ts, size).alias("w")).agg(first(False).alias("new"), first(True).alias("old"))
    return agg.select(*keys, F.col("w.start").alias("window_start"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("new", "old")]).withColumn("diff", F.col("new") - F.col("old"))


def rewindowed(counts: DataFrame, first_size: str, size: str, ts: str, delay: str, every: str | None = None) -> DataFrame:
    """window_start, n: events by fine windows, and those by coarser ones that hold their last moments."""
    w = F.window(ts, first_size, every) if every else F.window(ts, first_size)
    fine = counts.withWatermark(ts, delay).groupBy(w.alias("w")).agg(F.count("*").alias("n"))
    return fine.groupBy(F.window(F.window_time("w"), size).alias("w")).agg(F.sum("n").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def counted_with_beats(stream: DataFrame, beats: DataFrame, ts: str, size: str, delay: str) -> DataFrame:
    """window_start, n, also of windows that only a heartbeat (a stream with a column ts) fell into: n is 0 there."""
    both = stream.select(F.col(ts).alias("ts"), F.lit(1).alias("one")).unionByName(beats.select("ts", F.lit(0).alias("one")))
    return both.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w")).agg(F.sum("one").alias("n")).select(F.col("w.start").alias("window_start"), "n")
