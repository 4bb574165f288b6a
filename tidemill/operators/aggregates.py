"""Keyed and global aggregates, skew-tolerant ones among them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.sizes import small_side


def group_collect(df: DataFrame, keys: Sequence[str], value: Column, name: str = "items") -> DataFrame:
    """Each key's values, sorted, as an array. For groups of bounded size; counts and sums need no arrays."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(name))


def group_concat(df: DataFrame, keys: Sequence[str], value: Column, separator: str = "\n", name: str = "text") -> DataFrame:
    """Each key's values, sorted and joined. For groups of bounded size: a group's text is one value."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(value)), separator).alias(name))


def count_per_key(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def globally(df: DataFrame, *measures: Column) -> DataFrame:
    """A global aggregate that gives no row for no rows."""
    return df.agg(*measures, F.count("*").alias("__rows")).filter("__rows > 0").drop("__rows")


def ratio_of(flag: Column) -> Column:
    """The share of rows for which flag holds."""
    return F.count_if(flag) / F.count("*")


def row_mean(value: Column) -> Column:
    """The mean over all rows, null counting as 0."""
    return F.sum(F.coalesce(value, F.lit(0))) / F.count("*")


def statistics(df: DataFrame, keys: Sequence[str], accepted: Column, measures: dict[str, Column]) -> DataFrame:
    """For each key: rows, the share for which accepted holds, and the mean over rows of each measure (avg_<name>)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), ratio_of(accepted).alias("accepted_ratio"), *[row_mean(c).alias(f"avg_{k}") for k, c in measures.items()])


def salted_statistics(df: DataFrame, keys: Sequence[str], accepted: Column, measures: dict[str, Column], salts: Column) -> DataFrame:
    """statistics() in two steps: by key and one of so many salts, a number from each row, then by key.

    salts is a column: 1 for cold keys and more for hot ones. The result is that of statistics().
    """
    salt = F.pmod(F.xxhash64(*df.columns), salts)
    first = df.withColumn("__salt", salt).groupBy(*keys, "__salt").agg(F.count("*").alias("__n"), F.count_if(accepted).alias("__ok"), *[F.sum(F.coalesce(c, F.lit(0))).alias(f"__{k}") for k, c in measures.items()])
    return first.groupBy(*keys).agg(F.sum("__n").alias("n"), (F.sum("__ok") / F.sum("__n")).alias("accepted_ratio"), *[(F.sum(f"__{k}") / F.sum("__n")).alias(f"avg_{k}") for k in measures])


def statistics_line(name: str) -> Column:
    """A statistics row as text, ratios as percentages."""
    return F.format_string("%s: %.1f%% accepted, %d rows", F.col(name), F.col("accepted_ratio") * 100, F.col("n"))


def hot_keys(df: DataFrame, key: str, more_than: int) -> DataFrame:
    """Keys of more than so many rows, with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > more_than)


def mark_hot(df: DataFrame, hot: DataFrame, key: str, name: str = "is_hot") -> DataFrame:
    """df with a column that says whether its key is among hot ones; df's side isn't shuffled for few of them."""
    marks = hot.select(F.col(key)).distinct().withColumn("__hot", F.lit(True))
    return df.join(small_side(marks), key, "left").withColumn(name, F.coalesce("__hot", F.lit(False))).drop("__hot")


def min_max(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("most"))


def normalize(df: DataFrame, key: str, value: str, name: str = "normalized") -> DataFrame:
    """value from 0 to 1 between its key's least and greatest; null where these are equal.

    The extremes are combined before they are shuffled and joined back, so that a hot key isn't sorted in one task.
    """
    scaled = F.try_divide(F.col(value) - F.col("least"), F.col("most") - F.col("least"))
    return df.join(small_side(min_max(df, key, value)), key).withColumn(name, scaled).drop("least", "most")


def sample_fixed(df: DataFrame, n: int, *by: str, seed: int = 42) -> DataFrame:
    """n rows drawn evenly, the same whenever run again: those with the least hash of by."""
    return df.orderBy(F.xxhash64(*[F.col(c) for c in by or df.columns], F.lit(seed)), *(by or df.columns)).limit(n)


def as_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row with a map; a repeated key is an error. For tables of bounded size."""
    return df.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("map"))


def combined(df: DataFrame, keys: Sequence[str], columns: Sequence[str], f: Callable, schema: str) -> DataFrame:
    """keys and f's row of each group, for aggregates that built-in functions can't say: f takes a pandas DataFrame of the
    columns and gives a tuple. A group is one task's; for groups of bounded size."""
    import pandas as pd

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *f(group[list(columns)]))])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [f.name for f in T._parse_datatype_string(f"{kinds}, {schema}").fields]
    return df.select(*keys, *[c for c in columns if c not in keys]).groupBy(*keys).applyInPandas(lambda key, group: run(key, group).set_axis(names, axis=1), f"{kinds}, {schema}")


def observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and metrics over its rows that are there once it has been run."""
    watch = Observation(name)
    return df.observe(watch, *metrics), watch


# top-k


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in an order that must be total."""
    return df.orderBy(*order).limit(n)


def top_per_key(df: DataFrame, keys: Sequence[str], n: int, *order: Column, salts: int = 16) -> DataFrame:
    """Each key's first n rows. Rows are first cut to n in each of so many parts of a key, so that a hot key is no
    single sort, be its rows alike or not."""
    salt = F.pmod(F.xxhash64(*df.columns, F.spark_partition_id()), F.lit(salts))
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    cut = df.withColumn("__salt", salt).withColumn("__rank", F.row_number().over(part)).filter(F.col("__rank") <= n).drop("__salt", "__rank")
    return cut.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= n)


def top_distinct(df: DataFrame, key: str, score: Column, arrival: Column, n: int = 10) -> DataFrame:
    """The n keys of highest score, where a key's score is its newest one, be it lower; ties by key."""
    return df.groupBy(key).agg(F.max_by(score, arrival).alias("score")).orderBy(F.desc("score"), key).limit(n)
