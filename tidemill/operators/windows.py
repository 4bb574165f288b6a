"""Event-time windows, sessions, panes and keyed state over bounded tables; their streaming twins are in tidemill.streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.aggregates import top_per_key
from tidemill.operators.joins import numbered


def windowed(df: DataFrame, ts: str, size: str, every: str | None = None) -> DataFrame:
    """df with a column "window", a row for each window that a time is in."""
    return df.withColumn("window", F.window(ts, size, every) if every else F.window(ts, size))


def window_counts(df: DataFrame, ts: str, size: str, every: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """keys, window_start, window_end, n. A sliding window's count is a sum of its panes' counts: rows are combined
    before they are repeated."""
    if every is None:
        return df.groupBy(*keys, F.window(ts, size).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
    panes = df.groupBy(*keys, F.window(ts, every).alias("p")).agg(F.count("*").alias("n")).withColumn("__at", F.col("p.start"))
    return panes.groupBy(*keys, F.window("__at", size, every).alias("w")).agg(F.sum("n").alias("n")).select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def with_empty_windows(counts: DataFrame, every: str) -> DataFrame:
    """Counts by window_start of every window from the first to the last, 0 where there was none."""
    ends = counts.agg(F.min("window_start").alias("lo"), F.max("window_start").alias("hi")).filter("lo IS NOT NULL")
    spine = ends.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {every}"))).alias("window_start"))
    return spine.join(counts.select("window_start", "n"), "window_start", "left").select("window_start", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def day(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts))


def sessions(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: Column | float, *measures: Column, bucket: str | None = None) -> DataFrame:
    """keys, session_start, session_end, n and measures of each key's sessions.

    An event lasts gap_seconds, a number or a column of each row's own. Events belong together while one begins before
    the latest end so far; one that begins just then opens a session. Null keys are a key; null times go; gaps that are
    null or below 0 count as 0.

    With bucket, a length of time, a key's events are sorted by such stretches, each its own task's work, and only the
    stretches' latest ends and counts of sessions are carried on: for keys that hold much of the data. The result is
    the same.
    """
    gap = gap_seconds if isinstance(gap_seconds, Column) else F.lit(float(gap_seconds))
    micros = (F.greatest(F.coalesce(gap.cast("double"), F.lit(0.0)), F.lit(0.0)) * 1_000_000).cast("long")
    ended = df.filter(F.col(ts).isNotNull()).withColumn("__end", F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / 1_000_000).cast("decimal(18,6)")))
    by = list(keys)
    if bucket:
        by.append("__bucket")
        ended = ended.withColumn("__bucket", F.window(ts, bucket).start)
        before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        reached = ended.groupBy(*by).agg(F.max("__end").alias("__latest")).withColumn("__carried", F.max("__latest").over(before))
        ended = _beside(ended, reached.drop("__latest"), by)
    along = Window.partitionBy(*by).orderBy(ts, "__end")
    reach = F.max("__end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = ended.withColumn("__reach", F.greatest(reach, "__carried") if bucket else reach).withColumn("__new", (F.col("__reach").isNull() | (F.col(ts) >= F.col("__reach"))).cast("int"))
    islands = opened.withColumn("__session", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    if bucket:
        counted = islands.groupBy(*by).agg(F.sum("__new").alias("__many")).withColumn("__earlier", F.coalesce(F.sum("__many").over(before), F.lit(0)))
        islands = _beside(islands, counted.drop("__many"), by).withColumn("__session", F.col("__session") + F.col("__earlier"))
    return islands.groupBy(*keys, "__session").agg(F.min(ts).alias("session_start"), F.max("__end").alias("session_end"), F.count("*").alias("n"), *measures).drop("__session")


def _beside(df: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with more's other columns, by keys that may be null; each is in more once."""
    renamed = more.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in more.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return df.join(renamed, same).drop(*[f"__k{i}" for i in range(len(keys))])


def gap_or(value: Column, default: float) -> Column:
    """A row's own gap in seconds, or default where it is no number."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(float(default)))


def lag_differences(df: DataFrame, keys: Sequence[str], ts: str, value: str, size: str) -> DataFrame:
    """keys, window_start, new, old, diff: the first value of each window less that of the window before.

    A missing side counts as 0 and still gives a row, so that a value is also compared with a window that had none.
    """
    first = df.groupBy(*keys, F.window(ts, size).alias("w")).agg(F.min_by(value, F.struct(ts, value)).alias("v"))
    now = first.select(*keys, F.col("w.start").alias("window_start"), F.col("v").alias("new"))
    before = first.select(*keys, F.col("w.end").alias("window_start"), F.col("v").alias("old"))
    both = now.join(before, [*keys, "window_start"], "full")
    return both.select(*keys, "window_start", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("new", "old")]).withColumn("diff", F.col("new") - F.col("old"))


def late_time(ts: str, is_late: Column, by: str) -> Column:
    """The event time, earlier by an interval where is_late holds."""
    return F.when(is_late, F.col(ts) - F.expr(f"INTERVAL {by}")).otherwise(F.col(ts))


def count_panes(df: DataFrame, keys: Sequence[str], order: Sequence[Column], every: int, value: Column | None = None, spread: bool = False) -> DataFrame:
    """Firings of a trigger that fires after every so many rows of a key: pane_index, accumulated and discarded.

    accumulated counts (or sums value of) all rows so far, discarded those since the firing before. spread is for keys
    that hold much of the data: their rows are numbered by stretches.
    """
    rows = numbered(df.withColumn("__v", F.lit(1).cast("long") if value is None else value), *order, keys=keys, name="__row", spread=spread)
    panes = rows.withColumn("pane_index", F.floor(F.col("__row") / every)).groupBy(*keys, "pane_index").agg(F.count("*").alias("__n"), F.sum("__v").alias("discarded")).filter(F.col("__n") == every)
    so_far = Window.partitionBy(*keys).orderBy("pane_index").rowsBetween(Window.unboundedPreceding, 0)
    return panes.withColumn("accumulated", F.sum("discarded").over(so_far)).drop("__n")


def flush_after(df: DataFrame, keys: Sequence[str], order: str, n: int, is_error: Column, value: str) -> DataFrame:
    """keys and items: the first n rows of each key that has as many, in order, without the errors among them; once."""
    first = top_per_key(df.select(*keys, *[c for c in dict.fromkeys([order, value]) if c not in keys], F.coalesce(is_error, F.lit(False)).alias("__bad")), keys, n, F.asc(order))
    item = F.when(~F.col("__bad"), F.struct(F.col("rank").alias("at"), F.col(value).alias("value")))
    return first.groupBy(*keys).agg(F.count("*").alias("__n"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["value"]).alias("items")).filter(F.col("__n") == n).drop("__n")


def pairs(df: DataFrame, keys: Sequence[str], order: str, value: str, spread: bool = False) -> DataFrame:
    """keys, first, second: each two neighbouring values of a key; an odd last one goes. spread is for keys that hold
    much of the data."""
    rows = numbered(df.select(*keys, *[c for c in dict.fromkeys([order, value]) if c not in keys]), F.asc(order), keys=keys, name="__row", spread=spread)
    odd = lambda k: F.max(F.when(F.col("__row") % 2 == k, F.struct(F.col(value).alias("v"))))
    both = rows.groupBy(*keys, F.floor(F.col("__row") / 2).alias("__pair")).agg(F.count("*").alias("__n"), odd(0).alias("a"), odd(1).alias("b"))
    return both.filter("__n = 2").select(*keys, F.col("a.v").alias("first"), F.col("b.v").alias("second"))


def rewindowed(df: DataFrame, window: str, size: str) -> DataFrame:
    """df, whose column of windows is replaced by coarser ones that hold their last moments."""
    return df.withColumn(window, F.window(F.col(f"{window}.end") - F.expr("INTERVAL 1 MICROSECOND"), size))


