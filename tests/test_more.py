import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from tidemill.functions.text import entity
from tidemill.operators import aggregates as A
from tidemill.operators.quality import parse_inferred
from tidemill.options import parse_options
from tidemill.streaming import run
from tidemill.streaming import windows as SW


def test_options():
    @dataclasses.dataclass
    class Job:
        """A job."""

        source: str
        shards: int = 3
        table: str | None = None
        dry: bool = False

    assert parse_options(Job, ["--source", "x", "--dry"]) == Job("x", 3, None, True)
    assert parse_options(Job, ["--source", "x", "--shards", "5", "--table", "t"]) == Job("x", 5, "t", False)
    with pytest.raises(SystemExit):
        parse_options(Job, [])


def test_own_aggregates_and_metrics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    got = A.combined(df, ["k"], ["v"], lambda g: (float(g["v"].median()), len(g)), "middle double, n long")
    assert sorted(map(tuple, got.collect())) == [("a", 2.0, 2), ("b", 5.0, 1)]
    watched, metrics = A.observed(df, "rows", F.count("*").alias("n"))
    watched.collect()
    assert metrics.get == {"n": 3}


def test_inferred_columns_and_entities(spark):
    df = spark.createDataFrame([(0, '{"a":"1","b":"x"}'), (1, '{"a":"z"}'), (2, "no json")], "ord int, p string")
    assert sorted((r.ord, r.a, r.b) for r in parse_inferred(df, "p", "ord").collect()) == [(0, 1, "x"), (1, None, None), (2, None, None)]
    text = spark.range(1).select(entity("User", F.lit("u1"), age=F.lit(3))).first()[0]
    assert json.loads(text) == {"key": {"kind": "User", "name": "u1"}, "properties": {"age": {"age": 3}}}


def test_heartbeats_fill_empty_windows(spark, tmp_path):
    for name, seconds in (("in", [1, 2, 31]), ("beat", [5, 15, 25, 35])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text("".join(json.dumps({"ts": f"2024-01-01 00:00:{s:02}"}) + "\n" for s in seconds))
    read = lambda name: spark.readStream.schema("ts timestamp").json(str(tmp_path / name))
    out = str(tmp_path / "out")
    run.available(SW.counted_with_beats(read("in"), read("beat"), "ts", "10 seconds", "1 minute"), lambda df: df.write.mode("overwrite").parquet(out), str(tmp_path / "cp"), "complete")
    assert [r.n for r in spark.read.parquet(out).orderBy("window_start").collect()] == [2, 0, 0, 1]
    run.sent(str(tmp_path / "topic"), "v")(spark.createDataFrame([("m",)], "v string"))
    assert spark.read.json(str(tmp_path / "topic")).first().payload == "m"
