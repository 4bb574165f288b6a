"""Forms of operators for keys, sides and lists that are large give what the plain ones give."""

import hashlib
import hmac
import re

from pyspark.sql import functions as F

from tidemill import sizes
from tidemill.functions import text as X
from tidemill.operators import aggregates as A
from tidemill.operators import joins as J
from tidemill.operators import windows as W
from tidemill.scratch import scratch
from tidemill.sinks import files as K
from tidemill.sinks import tables as TB


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.select(*sorted(df.columns)).collect())


def hot(spark):
    """A key with most of the rows, equal rows, null keys."""
    return spark.range(900).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, F.concat(F.lit("k"), F.col("id") % 13)).alias("k"), (F.col("id") * 7919 % 900).alias("at"), F.col("id").alias("v")).repartition(5)


def test_numbering_by_stretches(spark):
    df = hot(spark)
    assert rows(J.numbered(df, F.asc("at"), keys=["k"], spread=True)) == rows(J.numbered(df, F.asc("at"), keys=["k"]))
    assert rows(W.count_panes(df, ["k"], [F.asc("at")], 7, F.col("v"), spread=True)) == rows(W.count_panes(df, ["k"], [F.asc("at")], 7, F.col("v")))
    assert rows(W.pairs(df, ["k"], "at", "v", spread=True)) == rows(W.pairs(df, ["k"], "at", "v"))
    assert J.numbered(df.limit(0), F.asc("at"), keys=["k"], spread=True).count() == 0


def test_pairs_and_flushes_of_null_values(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, 6), ("b", 1, 1)], "k string, at int, v int")
    assert rows(W.pairs(df, ["k"], "at", "v")) == [("None", "a", "5")]
    assert W.flush_after(df, ["k"], "at", 3, F.col("v") == 6, "v").first().asDict() == {"k": "a", "items": [None, 5]}


def test_equal_rows_of_a_hot_key(spark):
    df = spark.range(400).select(F.lit("k").alias("k"), F.lit(1).alias("v")).repartition(4)
    assert A.top_per_key(df, ["k"], 3, F.desc("v")).count() == 3
    path = scratch(spark, "spread")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are put together again
    try:
        K.write_by_key(df, path, "k", F.lit("line"), spread=8)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert spark.read.text(path).count() == 400 and len(set(spark.read.text(path).inputFiles())) > 1


def test_ranges_in_bins(spark):
    events = spark.range(500).select("id", (F.col("id") * 37 % 500 / 5.0).alias("at"))
    ranges = spark.createDataFrame([(f"r{i}", i, i * 1.7 - 3, i * 1.7 + (40 if i == 9 else 0.9)) for i in range(60)] + [("empty", 99, 5.0, 4.0), ("null", 98, None, 3.0)], "name string, ord int, lo double, hi double")
    plain = rows(J.assign_ranges(events, ranges, "at", "lo", "hi", "ord", ["id"], few=1000))
    assert plain and plain == rows(J.assign_ranges(events, ranges, "at", "lo", "hi", "ord", ["id"], few=0)) == rows(J.assign_ranges(events, ranges, "at", "lo", "hi", "ord", ["id"], few=0, max_rows=0, bin_width=3.0))
    assert J.assign_ranges(events, ranges.limit(0), "at", "lo", "hi", "ord", ["id"], few=-1).count() == 0


def test_patterns_in_blocks(spark, monkeypatch):
    paths = [f"/d{i % 4}/f{i}.{'csv' if i % 3 else 'x'}" for i in range(40)] + [None]
    globs = [f"/d{i}/*" for i in range(3)] + ["*.csv", "/d?/f1?.x", "nothing", "*", None]
    df, table = spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(g, i) for i, g in enumerate(globs)], "glob string, tag int")
    want = sorted((p, g) for p in paths for g in globs if p and g and re.fullmatch(g.replace(".", "\\.").replace("*", ".*").replace("?", "."), p))
    for block, chunk in ((1000, 50), (3, 2)):
        monkeypatch.setattr(J, "PATTERN_BLOCK", block)
        monkeypatch.setattr(J, "PATTERN_CHUNK", chunk)
        assert sorted((r.path, r.glob) for r in J.tag_by_pattern(df, table, "path").collect()) == want
    assert J.tag_by_pattern(df, table.limit(0), "path").count() == 0


def test_a_side_is_small_by_rows_and_bytes(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(x):
        runs.add(1)
        return x

    df = spark.range(10).select(F.udf(counted, "long")("id").alias("id"), F.lit("x" * 100).alias("t"))
    found, n, size = sizes.measured(df)
    assert n == 10 and size > 1000 and found.count() == 10 and runs.value == 10
    plan = lambda side: spark.range(10).join(side, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(sizes.small_side(df)) and "broadcast" not in plan(sizes.small_side(df, rows=9)) and "broadcast" not in plan(sizes.small_side(df, size=500))


def test_a_merge_that_ended_half_way_is_undone(spark):
    path = scratch(spark, "halfway")
    spark.range(3).withColumn("v", F.lit(1)).write.parquet(path)
    assert not TB.recovered(spark, path)
    TB._renamed(spark, path, f"{path}-old")  # as far as the merge came
    assert not TB.exists(spark, path)
    TB.merge_table(spark, path, spark.range(2, 4).withColumn("v", F.lit(2)), ["id"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(0, 1), (1, 1), (2, 2), (3, 2)] and not TB.exists(spark, f"{path}-old")


def test_words_and_signatures(spark):
    said = {0: "zero", 19: "nineteen", 80: "eighty", 101: "one hundred and one", 1000: "one thousand", 1005: "one thousand and five", 1234: "one thousand, two hundred and thirty-four", -42: "minus forty-two", 2_000_300: "two million, three hundred", 10**15: None, None: None}
    df = spark.createDataFrame([(n,) for n in said], "n long").select("n", X.in_words("n").alias("w"))
    assert {r.n: r.w for r in df.collect()} == said
    for key in (b"k", b"x" * 100):
        assert spark.range(1).select(X.signature(F.lit("é message"), key)).first()[0] == hmac.new(key, "é message".encode(), hashlib.sha256).hexdigest()
