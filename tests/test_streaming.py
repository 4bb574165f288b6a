import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemill.operators import windows as W
from tidemill.operators.quality import guarded
from tidemill.sources import streams
from tidemill.streaming import run, state
from tidemill.streaming import windows as SW

T0 = dt.datetime(2024, 1, 1)
FAR = "2031-01-01 00:00:00"


def put(folder, name, rows):
    """A file of a folder, each newer than the one before: streams take the oldest first."""
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    at = 1_700_000_000 + 10 * len(list(folder.iterdir()))
    os.utime(folder / name, (at, at))


def collected(spark, stream, tmp_path, mode="append", tag="q"):
    run.available(stream, run.appended(str(tmp_path / f"out-{tag}")), str(tmp_path / f"cp-{tag}"), mode)
    return spark.read.parquet(str(tmp_path / f"out-{tag}"))


@pytest.fixture
def events(tmp_path):
    rows = [{"user": u, "value": float(i), "gap": 3 + i % 4, "ts": str(T0 + dt.timedelta(seconds=7 * i * (1 + i % 3)))} for i in range(40) for u in ("a", "b")]
    put(tmp_path / "in", "1.json", rows)
    put(tmp_path / "in", "2.json", [{"user": "a", "value": 0.0, "gap": 5, "ts": FAR}])  # lets windows before it close
    return str(tmp_path / "in")


SCHEMA = "user string, value double, gap int, ts timestamp"


def same(stream, batch, at="window_start"):
    drop = f"{at} < TIMESTAMP '2030-01-01'"
    key = lambda df: sorted(tuple(str(x) for x in r) for r in df.filter(drop).select(*sorted(df.columns)).collect())
    assert key(stream) == key(batch) and key(stream)


def test_windows_match_their_batch_twins(spark, events, tmp_path):
    batch = spark.read.schema(SCHEMA).json(events)
    stream = lambda: streams.records(spark, events, SCHEMA, 1)
    same(collected(spark, SW.counted(stream(), "ts", "1 minute", "1 hour", keys=["user"]), tmp_path, tag="a"), W.window_counts(batch, "ts", "1 minute", keys=["user"]))
    same(collected(spark, SW.counted(stream(), "ts", "1 minute", "1 hour", every="15 seconds"), tmp_path, tag="b"), W.window_counts(batch, "ts", "1 minute", "15 seconds"))
    same(collected(spark, SW.lag_differences(stream(), ["user"], "ts", "value", "1 minute", "1 hour"), tmp_path, tag="c"), W.lag_differences(batch, ["user"], "ts", "value", "1 minute"))
    fine = W.window_counts(batch, "ts", "10 seconds").select(F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end")).alias("w"), "n")
    same(collected(spark, SW.rewindowed(stream(), "10 seconds", "1 minute", "ts", "1 hour"), tmp_path, tag="d"), W.rewindowed(fine, "w", "1 minute").groupBy(F.col("w.start").alias("window_start")).agg(F.sum("n").alias("n")))


def test_sessions_match_their_batch_twins(spark, events, tmp_path):
    batch = spark.read.schema(SCHEMA).json(events)
    for tag, gap in (("s", 14), ("d", F.col("gap") * 5)):
        got = collected(spark, SW.sessions(streams.records(spark, events, SCHEMA, 1), ["user"], "ts", gap, "1 hour"), tmp_path, tag=tag)
        same(got, W.sessions(batch, ["user"], "ts", gap), "session_start")


def test_keyed_state(spark, tmp_path):
    rows = [{"key": "k", "ord": i, "value": i, "is_error": i == 7} for i in range(1, 13)] + [{"key": "j", "ord": 1, "value": 5, "is_error": False}]
    schema = "key string, ord long, value long, is_error boolean"
    for i in range(0, len(rows), 4):
        put(tmp_path / "in", f"{i:02}.json", rows[i : i + 4])
    stream = lambda: streams.records(spark, str(tmp_path / "in"), schema, 1)
    assert [(r.key, json.loads(r["items"])) for r in collected(spark, state.flush_after(stream(), 10), tmp_path, tag="f").collect()] == [("k", [1, 2, 3, 4, 5, 6, 8, 9, 10])]
    got = collected(spark, state.pairs(stream()), tmp_path, tag="p").collect()
    assert sorted((r.key, r.first, r.second) for r in got) == [("k", i, i + 1) for i in range(1, 12, 2)]
    got = collected(spark, state.numbered(stream()), tmp_path, tag="n").collect()
    assert sorted((r.key, r["index"]) for r in got) == [("j", 0)] + [("k", i) for i in range(12)]
    got = collected(spark, state.panes(stream(), every=5), tmp_path, tag="t").collect()
    assert sorted((r.pane_index, r.timing, r.is_first, r.discarded, r.accumulated) for r in got) == [(0, "EARLY", True, 15.0, 15.0), (1, "EARLY", False, 40.0, 55.0)]


def test_fan_out_and_dead_letters(spark, tmp_path):
    put(tmp_path / "in", "1.json", [{"payload": p, "attributes": {"evId": "1234"}, "publish_time": str(T0)} for p in ('{"a": 1}', "{bad", '{"a": 2}', "")])
    stream = streams.messages(spark, str(tmp_path / "in")).withColumn("event", streams.attribute("evId"))
    seen = []
    write = run.json_to_tables("payload", "struct<a:int>", str(tmp_path / "t"))
    run.available(stream, run.fan_out(write, run.appended(str(tmp_path / "all")), run.logged(seen.append)), str(tmp_path / "cp"))
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2]
    assert sorted(r.payload for r in spark.read.parquet(str(tmp_path / "t_error_records")).collect()) == ["", "{bad"]
    assert spark.read.parquet(str(tmp_path / "all")).filter("event = '1234'").count() == 4 and len(seen) == 4
    f = guarded(lambda x: json.dumps({"a": json.loads(x)["a"] * 10}))
    again = streams.topics(spark, one=str(tmp_path / "in"), two=str(tmp_path / "in"))
    run.available(again, run.json_to_tables("payload", "struct<a:int>", str(tmp_path / "u"), transform=lambda df: df.withColumn("udf", f(F.col("payload")))), str(tmp_path / "cp2"))
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "u")).collect()) == [10, 10, 20, 20]
    assert spark.read.parquet(str(tmp_path / "u_error_records")).count() == 4


def test_polling_control_and_throttling(spark, tmp_path):
    (tmp_path / "2019" / "03").mkdir(parents=True)
    (tmp_path / "2019" / "03" / "f.txt").write_text("a\nb\n")
    assert collected(spark, streams.polled_lines(spark, str(tmp_path / "2019")), tmp_path, tag="x").count() == 2
    q = streams.heartbeat(spark, 1).writeStream.format("memory").queryName("beats").start()
    try:
        assert "beats" in run.active(spark)
    finally:
        assert run.stop(spark, "beats") and not run.stop(spark, "beats")
    got = run.throttled(spark.range(6).select(F.col("id").cast("string").alias("v")), lambda x: x + "!", "v", per_second=100, workers=2)
    assert sorted(r.result for r in got.collect()) == [f"{i}!" for i in range(6)]


def test_window_panes_without_lateness_and_early_ones(spark, tmp_path):
    rows = [{"key": "k", "ord": i, "value": float(i), "ts": str(T0 + dt.timedelta(seconds=s))} for i, s in enumerate((1, 2, 61, 3, 121, 62, 200))]
    for i, r in enumerate(rows):
        put(tmp_path / "in", f"{i}.json", [r])
    stream = lambda: streams.records(spark, str(tmp_path / "in"), "key string, ord long, value double, ts timestamp", 1)
    shown = lambda df: sorted(((r.window_end - T0).seconds, r.pane_index, r.timing, r.is_first, r.is_last, r.discarded, r.accumulated) for r in df.collect())
    got = shown(collected(spark, state.window_panes(stream(), "ts", "1 minute", "0 seconds", early=False), tmp_path, tag="n"))
    assert got == [(60, 0, "ON_TIME", True, True, 1.0, 1.0), (120, 0, "ON_TIME", True, True, 2.0, 2.0), (180, 0, "ON_TIME", True, True, 4.0, 4.0)]
    got = shown(collected(spark, state.window_panes(stream(), "ts", "1 minute", "2 minutes"), tmp_path, tag="l"))
    assert [g for g in got if g[0] == 60] == [(60, 0, "EARLY", True, False, 0.0, 0.0), (60, 1, "EARLY", False, False, 1.0, 1.0), (60, 2, "ON_TIME", False, False, 0.0, 1.0), (60, 3, "LATE", False, False, 3.0, 4.0)]
