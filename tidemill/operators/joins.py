"""Joins and enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.text import glob_to_regex
from tidemill.operators.shape import flatten
from tidemill.scratch import scratch
from tidemill.sizes import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, measured, small_side

#: Patterns that are matched against all rows in one pass, and in one array of its plan.
PATTERN_BLOCK, PATTERN_CHUNK = 1000, 50
#: Ranges that an event is compared with one by one; more meet events in bins.
FEW_RANGES = 200


def cogroup(left: DataFrame, right: DataFrame, keys: Sequence[str], a: Column, b: Column) -> DataFrame:
    """keys, left_items, right_items: each side's values of a key, sorted; empty where a side has none. For groups of bounded size."""
    one = lambda df, c, name: df.groupBy(*keys).agg(F.sort_array(F.collect_list(c)).alias(name))
    both = one(left, a, "left_items").join(one(right, b, "right_items"), list(keys), "full")
    return both.withColumns({n: F.coalesce(n, F.array()) for n in ("left_items", "right_items")})


def cogroup_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, left_n, right_n: how many rows each side has of a key, 0 where none. No group is gathered."""
    counted = flatten(left.select(*keys, F.lit(1).alias("__l"), F.lit(0).alias("__r")), right.select(*keys, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    return counted.groupBy(*keys).agg(F.sum("__l").alias("left_n"), F.sum("__r").alias("right_n"))


def _as_number(df: DataFrame, c: str) -> Column:
    """A column of numbers or times as a double, times in seconds."""
    kind = df.schema[c].dataType
    return (F.col(c).cast("timestamp") if isinstance(kind, (T.TimestampNTZType, T.DateType)) else F.col(c)).cast("double")


def assign_ranges(events: DataFrame, ranges: DataFrame, at: str, start: str, stop: str, order: str, event_key: Sequence[str], bin_width: float | None = None, few: int = FEW_RANGES, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Each event with the first range, in the given order, that holds it, both ends included; others go.

    A few ranges are compared with every event. More are joined by bins: a range is repeated for each bin_width
    (seconds, for times; the ranges' mean length if not given, so that they have two bins each on average) that it
    touches, and an event meets those of its own bin; binned ranges of a small size are broadcast.
    """
    inside = (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(stop))
    held, n, size = measured(ranges)
    if n <= few:
        found = events.join(F.broadcast(held), inside)
    else:
        first, last = _as_number(held, start), _as_number(held, stop)
        if bin_width is None:
            mean = held.filter(first <= last).agg(F.avg(last - first)).first()[0]
            bin_width = mean or 1.0
        number = lambda c: F.floor(c / bin_width)
        binned = held.filter(first <= last).withColumn("__bin", F.explode(F.sequence(number(first), number(last))))
        binned = small_side(binned, max_rows) if size <= MAX_BROADCAST_BYTES else binned
        found = events.withColumn("__bin", number(_as_number(events, at))).join(binned, "__bin").filter(inside).drop("__bin")
    ranked = Window.partitionBy(*event_key).orderBy(order)
    return found.withColumn("__rank", F.row_number().over(ranked)).filter("__rank = 1").drop("__rank")


def tag_by_pattern(df: DataFrame, patterns: DataFrame, path: str, glob: str = "glob") -> DataFrame:
    """A row for each pattern that path matches as a whole.

    Patterns are literals of the plan, so that each is compiled once for a task, PATTERN_BLOCK of them in one pass over
    df; a row's matches are then joined to the patterns' rows by number.
    """
    held, n, _ = measured(patterns)
    listed = numbered(held, *[F.asc_nulls_first(c) for c in held.columns], name="__pattern").withColumn("__regex", glob_to_regex(glob))
    out = None
    for block in range(max(1, -(-n // PATTERN_BLOCK))):
        own = listed.filter(F.col("__pattern").between(block * PATTERN_BLOCK, (block + 1) * PATTERN_BLOCK - 1))
        regexes = [tuple(r) for r in own.filter("__regex IS NOT NULL").select("__pattern", "__regex").collect()]  # PATTERN_BLOCK at most
        hits = [F.array_compact(F.array(*[F.when(F.col(path).rlike(x), F.lit(i)) for i, x in regexes[a : a + PATTERN_CHUNK]])) for a in range(0, len(regexes), PATTERN_CHUNK)]
        found = F.flatten(F.array(*hits)) if hits else F.array().cast("array<bigint>")
        part = df.withColumn("__pattern", F.explode(found)).join(F.broadcast(own.drop("__regex")), "__pattern").drop("__pattern")
        out = part if out is None else out.unionByName(part)
    return out


def lookup(df: DataFrame, dim: DataFrame, key: str, values: dict[str, object]) -> DataFrame:
    """df with dim's values by key, or the given defaults. Of rows that repeat a key the least values count."""
    one = dim.groupBy(key).agg(*[F.min(v).alias(v) for v in values])
    return df.join(small_side(one), key, "left").withColumns({v: F.coalesce(v, F.lit(d)) for v, d in values.items() if d is not None})


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of a table of one row."""
    return df.crossJoin(F.broadcast(one_row.limit(1)))


def numbered(df: DataFrame, *order: Column, keys: Sequence[str] = (), name: str = "index", spread: bool = False) -> DataFrame:
    """df with 0, 1, 2... in an order, by key or over all.

    Over all rows, and by key with spread, for keys that hold much of the data, the order is a range partitioning: each
    partition numbers its own stretch of a key, from the count of those before. The partitioned rows are written once,
    as another run could be partitioned otherwise.
    """
    if keys and not spread:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    path, by = scratch(df.sparkSession, "numbered"), list(keys)
    df.orderBy(*by, *order).withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}).write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    # ids ascend in order within a partition, from partition << 33; a row for each stretch of a key in a partition
    counts = ranged.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).drop("__n", "__first")
    if not by:
        joined = ranged.join(F.broadcast(before), "__part")  # a row for each partition
    else:
        renamed = before.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], F.col("__part").alias("__p"), "__before")
        same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)]
        joined = ranged.join(renamed, [*same, F.col("__part") == F.col("__p")]).drop(*[f"__k{i}" for i in range(len(by))], "__p")
    return joined.withColumn(name, F.col("__before") + F.col("__id")).drop("__part", "__id", "__before")


def zip_tables(left: DataFrame, right: DataFrame, left_order: Sequence[Column], right_order: Sequence[Column]) -> DataFrame:
    """Rows of equal position in two orders, side by side, as far as both go."""
    return numbered(left, *left_order).join(numbered(right, *right_order), "index")


def upsert(full: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """full with its rows replaced by changes' of the same keys, and changes' other rows added."""
    rest = [c for c in full.columns if c not in keys]
    old, new = full.withColumn("__old", F.lit(True)), changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in rest], F.lit(True).alias("__new"))
    merged = old.join(new, list(keys), "full")
    return merged.select(*[c if c in keys else F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in full.columns])
