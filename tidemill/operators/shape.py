"""Projections that change a table's shape: exploding, keying, zipping, filtering, routing by tag."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import col, split_words


def explode_into(df: DataFrame, items: Column, name: str) -> DataFrame:
    """A row for each item of an array, in a column of that name; rows of empty and null arrays go."""
    return df.withColumn(name, F.explode(items))


def explode_delimited(df: DataFrame, text: str, delimiter: str, name: str) -> DataFrame:
    """A row for each non-empty part of text."""
    return explode_into(df, split_words(text, delimiter), name).filter(F.length(name) > 0)


def explode_numbers(df: DataFrame, json_array: str, name: str) -> DataFrame:
    """A row for each number of a JSON array, cut to a whole one; what is no array gives none."""
    return explode_into(df, F.from_json(col(json_array), "array<double>"), name).withColumn(name, F.col(name).cast("int"))


def keyed(df: DataFrame, key: Column, value: Column | None = None) -> DataFrame:
    """(key, value); value is the whole row if not given."""
    return df.select(key.alias("key"), (F.struct("*") if value is None else value).alias("value"))


def salted(df: DataFrame, n: int, *by: str, name: str = "salt") -> DataFrame:
    """A number below n from a hash of by, or of the whole row: the same for a row whenever it is computed again."""
    return df.withColumn(name, F.pmod(F.xxhash64(*(by or df.columns)), F.lit(n)).cast("int"))


def tagged(df: DataFrame, *rules: tuple[str, Column], otherwise: str) -> DataFrame:
    """A column "tag" with the name of the first rule that holds."""
    out = F
    for name, rule in rules:
        out = out.when(rule, name)
    return df.withColumn("tag", out.otherwise(otherwise))


def outputs(df: DataFrame, *tags: str) -> dict[str, DataFrame]:
    """A table for each tag of a tagged one."""
    return {t: df.filter(F.col("tag") == t).drop("tag") for t in tags}


def flatten(*tables: DataFrame, missing: bool = False) -> DataFrame:
    """All rows of tables of the same columns, in any order of columns; with missing, absent ones are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=missing)
    return out


def at_least(df: DataFrame, text: str, n: int, fail: bool = False) -> DataFrame:
    """Rows whose text has n characters; with fail, a shorter one ends the query with an error."""
    if fail:
        return df.filter(F.when(F.length(text) >= n, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("too short: "), F.col(text))).cast("boolean")))
    return df.filter(F.length(text) >= n)


def not_empty(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.col(text).isNotNull() & (F.col(text) != ""))


def without_header(df: DataFrame, text: str, header: str) -> DataFrame:
    return df.filter(F.lower(text) != header.lower())


def any_of(df: DataFrame, tags: Column, watched: list[str]) -> DataFrame:
    """Rows with a tag that is watched."""
    return df.filter(F.arrays_overlap(tags, F.array(*map(F.lit, watched))))


def thinned(df: DataFrame, index: str, first: int = 6, every: int = 6) -> DataFrame:
    """Rows whose index is below first, and then each every-th."""
    return df.filter((F.col(index) < first) | (F.col(index) % every == 0))


def per_partition(df: DataFrame, schema: str, setup: Callable[[], object], each: Callable, finish: Callable | None = None) -> DataFrame:
    """Rows of each(state, pandas DataFrame) for each batch of a task, between setup(), called once before the first, and
    finish(state), whose rows come last. For clients and the like that are dear to make; all three are pickled."""

    def run(batches: Iterator) -> Iterator:
        state = setup()
        for b in batches:
            yield each(state, b)
        if finish is not None:
            yield finish(state)

    return df.mapInPandas(run, schema)
