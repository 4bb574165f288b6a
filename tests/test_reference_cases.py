"""Small literal inputs whose results are known."""

import datetime as dt
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import aggregates as A
from tidemill.operators import joins as J
from tidemill.operators import quality as Q
from tidemill.operators import shape as S
from tidemill.operators import windows as W

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_normalize(spark):
    df = spark.createDataFrame([("foo", 1), ("bar", 5), ("foo", 5), ("bar", 9), ("bar", 2), ("flat", -3), ("flat", -3)], "key string, value int")
    got = sorted(((r.key, r.value, r.normalized) for r in A.normalize(df, "key", "value").collect()), key=str)
    assert got == sorted([("bar", 2, 0.0), ("bar", 5, float(Fraction(3, 7))), ("bar", 9, 1.0), ("flat", -3, None), ("flat", -3, None), ("foo", 1, 0.0), ("foo", 5, 1.0)], key=str)


def test_static_sessions(spark):
    rows = [("north", at(s)) for s in (1, 2, 4, 8, 16)] + [("south", at(1 + s)) for s in (1, 3, 9)]
    got = W.sessions(spark.createDataFrame(rows, "sensor string, ts timestamp_ntz"), ["sensor"], "ts", 5).collect()
    assert sorted((r.sensor, r.n, (r.session_end - r.session_start).seconds) for r in got) == [("north", 1, 5), ("north", 4, 12), ("south", 1, 5), ("south", 2, 7)]


def test_dynamic_sessions_and_touching_ends(spark):
    rows = [("mobile", 12, "5", at(0)), ("mobile", -3, "5", at(2)), ("mobile", 2, "5", at(9)), ("mobile", 7, "5", at(12)), ("desktop", 4, None, at(0)), ("desktop", 10, "none", at(12))]
    df = spark.createDataFrame(rows, "user string, score int, gap string, ts timestamp_ntz")
    got = W.sessions(df, ["user"], "ts", W.gap_or(F.col("gap"), 10), F.sum("score").alias("score")).collect()
    assert sorted((r.user, r.score, (r.session_start - T0).seconds, (r.session_end - T0).seconds) for r in got) == [("desktop", 4, 0, 10), ("desktop", 10, 12, 22), ("mobile", 9, 0, 7), ("mobile", 9, 9, 17)]
    touching = W.sessions(spark.createDataFrame([(1, at(s)) for s in (0, 2, 7)], "k int, ts timestamp_ntz"), ["k"], "ts", 5).collect()
    assert sorted(((r.session_start - T0).seconds, (r.session_end - T0).seconds) for r in touching) == [(0, 7), (7, 12)]


def test_sessions_by_stretches_are_the_same(spark):
    import random

    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None]), at(r.randrange(0, 4000)), float(r.choice([0, 5, 60, 700]))) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, gap double")
    for gap in (F.col("gap"), 4):
        plain, cut = (sorted(map(str, W.sessions(df, ["k"], "ts", gap, F.sum("gap").alias("g"), bucket=b).collect())) for b in (None, "1 minute"))
        assert plain == cut and len(plain) > 3


@pytest.mark.parametrize("few", [True, False])
def test_first_range_that_holds_an_event(spark, few):
    ranges = spark.createDataFrame([("s1", 0, 100, 1), ("s2", 100, 200, 2), ("s3", 200, 300, 3)], "s string, start bigint, stop bigint, ord int")
    events = spark.createDataFrame([("e1", 20), ("e2", 60), ("e3", 120), ("e4", 160), ("e5", 210), ("e6", 290), ("edge", 100), ("out", 301)], "id string, ts bigint")
    got = J.assign_ranges(events, ranges, "ts", "start", "stop", "ord", ["id"], bin_width=70, max_rows=10 if few else 0).collect()
    assert sorted((r.s, r.id) for r in got) == [("s1", "e1"), ("s1", "e2"), ("s1", "edge"), ("s2", "e3"), ("s2", "e4"), ("s3", "e5"), ("s3", "e6")]


def test_lag_counts_missing_windows_as_zero(spark):
    df = spark.createDataFrame([("test", 120.0, at(0)), ("test", 40.0, at(12))], "key string, value double, ts timestamp_ntz")
    got = W.lag_differences(df, ["key"], "ts", "value", "10 seconds").orderBy("window_start").collect()
    assert [r["diff"] for r in got] == [120.0, -80.0, -40.0]


def test_flush_after_n(spark):
    df = spark.createDataFrame([(1, v) for v in range(1, 13)] + [(2, 1)], "key int, value int")
    error = (F.col("value") % 7 == 0) & (F.col("value") % 4 != 0) & (F.col("value") % 6 != 0)
    assert [(r.key, r["items"]) for r in W.flush_after(df, ["key"], "value", 10, error, "value").collect()] == [(1, [1, 2, 3, 4, 5, 6, 8, 9, 10])]


def test_inferred_schema(spark):
    lines = ['{"user":"a","age":"27","country":"x"}', '{"user":"b","income":"30000000000"}', '{"user":7,"blood":"A","food":"3 x"}', '{"user":"d","movie":"m","age":"old","n":12}']
    df = spark.createDataFrame(list(enumerate(lines)), "ord int, json string")
    got = {r.name: r.type for r in Q.inferred_fields(df, "json", "ord").collect()}
    assert got == {"user": "STRING", "age": "INTEGER", "country": "STRING", "income": "STRING", "blood": "STRING", "food": "STRING", "movie": "STRING", "n": "INTEGER"}
    assert Q.inferred_schema(df, "json", "ord")["age"].dataType.simpleString() == "bigint"


def test_bad_rows_are_split_off(spark):
    lines = [f"{i},good_line_{i}" for i in range(1, 11)] + ["this is a bad row"]
    parts = spark.createDataFrame([(x,) for x in lines], "line string").select(*X.fields_or_null(F.split("line", ","), ["index", "event"]))
    good, bad = Q.split_bad(Q.typed(parts, Q.schema_from_text("index:INTEGER,event:STRING")))
    assert good.count() == 10 and [(r["index"], r.event) for r in bad.collect()] == [("this is a bad row", None)]


def test_json_that_is_no_record(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("{",), ('{"a": "x"}',), (None,)], "payload string")
    got = {r.payload: (r.parsed.a if r.parsed else None, r.error_message is None) for r in Q.parse_json(df, "payload", "struct<a:int>").collect()}
    assert got == {'{"a": 1}': (1, True), "{": (None, False), '{"a": "x"}': (None, False), None: (None, False)}


def test_guarded_function(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    got = [tuple(r.r) for r in df.select(Q.guarded(lambda x: str(int(x) + 1))(F.col("v")).alias("r")).collect()]
    assert got[0] == (True, "2", None) and got[1][0] is False and got[1][2].startswith("ValueError")


def test_upsert(spark):
    full = spark.createDataFrame([("laptop", 20), ("tv", 3)], "name string, total bigint")
    got = J.upsert(full, spark.createDataFrame([("tv", 15), ("radio", None)], "name string, total bigint"), ["name"]).collect()
    assert sorted((r.name, r.total) for r in got if r.name != "radio") == [("laptop", 20), ("tv", 15)] and len(got) == 3


def test_side_outputs_and_union(spark):
    df = spark.createDataFrame([("good line",), ("bad line",)], "line string")
    parts = S.outputs(S.tagged(df, ("ok", F.col("line").contains("good")), otherwise="not_ok"), "ok", "not_ok")
    assert {k: v.count() for k, v in parts.items()} == {"ok": 1, "not_ok": 1} and S.flatten(*parts.values()).count() == 2
    assert S.flatten(df, df.withColumn("x", F.lit(1)), missing=True).filter("x IS NULL").count() == 2


def test_patterns_tag_every_match(spark):
    paths = spark.createDataFrame([(f"/in/{k}/f{i}.csv",) for k in ("sales", "events") for i in range(2)], "path string")
    globs = spark.createDataFrame([("*/sales/*", "Sales"), ("*/events/*", "Events"), ("*f0?csv", "never"), ("*/f1.cs?", "one")], "glob string, tag string")
    got = J.tag_by_pattern(paths, globs, "path").groupBy("tag").count().collect()
    assert sorted((r.tag, r["count"]) for r in got) == [("Events", 2), ("Sales", 2), ("never", 2), ("one", 2)]


def test_patterns_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "PATTERN_BLOCK", 2)
    paths = spark.createDataFrame([(f"p{i}",) for i in range(8)], "path string")
    globs = spark.createDataFrame([(f"p{i}",) for i in range(7)] + [("p*",)], "glob string")
    assert J.tag_by_pattern(paths, globs, "path").count() == 7 + 8


def test_path_times_and_names(spark):
    df = spark.createDataFrame([("store://b/2019/03/17/00/file1",), ("store://b/2019/03/18/22/file2.csv",), ("x",)], "p string")
    got = df.select(X.timestamp_from_path("p"), X.basename("p"), X.dirname("p"), X.extension("p")).collect()
    assert [r[0] for r in got] == [dt.datetime(2019, 3, 17), dt.datetime(2019, 3, 18, 22), None]
    assert got[1][1:] == ("file2.csv", "store://b/2019/03/18/22", "csv")


def test_lookups(spark):
    dim = spark.createDataFrame([("iron", "dull"), ("gold", "bright"), ("zinc", "pale"), ("zinc", "pale"), ("lead", "grey")], "metal string, look string")
    df = spark.createDataFrame([(n,) for n in ("iron", "gold", "zinc", "lead", "ivory")], "metal string")
    assert {r.metal: r.look for r in J.lookup(df, dim, "metal", {"look": ""}).collect()} == {"iron": "dull", "gold": "bright", "zinc": "pale", "lead": "grey", "ivory": ""}
    assert J.with_scalar(df, dim.limit(1)).count() == 5


def test_tags_in_both_spellings(spark):
    df = spark.createDataFrame([("a|b|c||", "<a><b><c>"), ("", "")], "p string, t string")
    got = df.select(X.pipe_tags("p"), X.angle_tags("t")).collect()
    assert got[0][0] == got[0][1] == ["a", "b", "c"] and got[1][1] == []
    assert S.explode_delimited(df, "p", "|", "x").count() == 3


def test_quoted_fields(spark):
    got = spark.createDataFrame([('"a, b",2,"c"',)], "line string").select(X.split_quoted("line").alias("f"), X.unquote("line").alias("u")).first()
    assert got.f == ['"a, b"', "2", '"c"'] and got.u == "a, b,2,c"


def test_top_distinct_takes_the_newest_score(spark):
    rows = [("oak", 9), ("elm", 8), ("fir", 1), ("ash", 10), ("yew", 8), ("oak", 11), ("ash", 7), ("box", 6)]
    df = spark.createDataFrame([(n, s, i) for i, (n, s) in enumerate(rows)], "tree string, score int, arrival int")
    got = [(r.tree, r.score) for r in A.top_distinct(df, "tree", F.col("score"), F.col("arrival"), 4).collect()]
    assert got == [("oak", 11), ("elm", 8), ("yew", 8), ("ash", 7)]


def test_hashes(spark):
    r = spark.createDataFrame([("hello\n", "Polygenelubricants", "")], "a string, b string, c string").select(X.sha256_text("a"), X.char_code_hash("b"), X.char_code_hash("c"), X.stable_name("a")).first()
    assert r[0] == "5891b5b522d5df086d0ff0b110fbd9d21bb4fc7163af34d08286a2e846f6be03" and r[2] == 0
    h = 0
    for c in "Polygenelubricants":
        h = (h * 31 + ord(c)) % 2**32
    assert r[1] == (h - 2**32 if h >= 2**31 else h)


def test_salted_equals_unsalted(spark):
    df = spark.createDataFrame([(f"k{i % 3 if i % 2 else 0}", i % 5 == 0, i % 7 if i % 11 else None, i) for i in range(500)], "k string, ok boolean, v int, i int")
    hot = A.hot_keys(df, "k", 200)
    marked = A.mark_hot(df, hot, "k")
    plain = A.statistics(df, ["k"], F.col("ok"), {"v": F.col("v")})
    salted = A.salted_statistics(marked, ["k"], F.col("ok"), {"v": F.col("v")}, F.when(F.col("is_hot"), 10).otherwise(1))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))
    assert {r.k for r in marked.filter("is_hot").select("k").distinct().collect()} == {"k0"}
    assert plain.filter("k = 'k1'").select(A.statistics_line("k")).first()[0].startswith("k1: ")


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], "k string, v int, ts timestamp_ntz")
    assert A.globally(none, F.sum("v")).count() == 0
    assert W.with_empty_windows(W.window_counts(none, "ts", "1 hour"), "1 HOUR").count() == 0
    assert W.sessions(none, ["k"], "ts", 5).count() == 0


def test_maps_and_samples(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert A.as_map(df, "k", "v").first()["map"] == {"a": 1, "b": 2}
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        A.as_map(df.union(df), "k", "v").collect()
    big = spark.range(1000)
    one, two = (sorted(r.id for r in A.sample_fixed(big.repartition(n), 20).collect()) for n in (3, 7))
    assert one == two and len(one) == 20
    assert A.top_per_key(big.withColumn("k", F.lit(1)), ["k"], 3, F.desc("id")).count() == 3


def test_numbering_and_zipping(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(5)
    assert all(r["index"] == r.v for r in J.numbered(df, F.asc("v")).collect())
    zipped = J.zip_tables(spark.createDataFrame([("x",), ("y",), ("z",)], "a string"), spark.range(2), [F.asc("a")], [F.asc("id")])
    assert sorted((r.a, r.id) for r in zipped.collect()) == [("x", 0), ("y", 1)]
    co = J.cogroup(spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, "b")], "k int, v string"), ["k"], F.col("v"), F.col("v")).orderBy("k").collect()
    assert [(r.k, r.left_items, r.right_items) for r in co] == [(1, ["a"], []), (2, [], ["b"])]


def test_filters(spark):
    df = spark.createDataFrame([("Header",), ("abc",), ("longer",), ("",), (None,)], "v string")
    assert S.at_least(df, "v", 5).count() == 2 and S.not_empty(df, "v").count() == 3 and S.without_header(df, "v", "HEADER").count() == 3
    with pytest.raises(Exception, match="too short"):
        S.at_least(df.filter("v IS NOT NULL"), "v", 5, fail=True).collect()
    assert [r.i for r in S.thinned(spark.range(20).withColumnRenamed("id", "i"), "i").collect()] == [0, 1, 2, 3, 4, 5, 6, 12, 18]
    assert S.salted(df, 4, "v").filter("salt < 4").count() == 5 and S.keyed(df, F.length("v")).columns == ["key", "value"]
    assert [r.n for r in S.explode_numbers(spark.createDataFrame([("[1, 2.5]",), ("no",)], "j string"), "j", "n").collect()] == [1, 2]


def test_schemas_and_zipping_names(spark):
    schema = Q.schema_from_json([{"name": "state", "type": "STRING", "mode": "REQUIRED", "description": "of the union"}, {"name": "number", "type": "INTEGER"}])
    assert schema["state"].metadata == {"description": "of the union"} and not schema["state"].nullable
    row = spark.range(1).select(X.zip_names(["a", "b", "c"], F.array(F.lit("1"), F.lit("2"))).alias("m")).first()
    assert row.m == {"a": "1", "b": "2"}
    bad = Q.typed(spark.createDataFrame([("CA", "5"), (None, "6")], "state string, number string"), schema)
    assert bad.filter("is_bad").count() == 1
    assert Q.error_table("t") == "t_error_records" and Q.error_table("t", "u") == "u"


def test_segments_of_strokes(spark):
    df = spark.createDataFrame([([[[0, 5, 9], [1, 2, 3]], [[7], [7]]],)], "drawing array<array<array<int>>>")
    assert [tuple(s) for s in df.select(X.stroke_segments("drawing").alias("s")).first().s] == [(0, 1, 5, 2), (5, 2, 9, 3)]


def test_panes_and_pairs(spark):
    df = spark.createDataFrame([("k", i, float(i)) for i in range(1, 8)], "k string, i int, v double")
    got = W.count_panes(df, ["k"], [F.asc("i")], 3, F.col("v")).orderBy("pane_index").collect()
    assert [(r.pane_index, r.discarded, r.accumulated) for r in got] == [(0, 6.0, 6.0), (1, 15.0, 21.0)]
    assert sorted((r.first, r.second) for r in W.pairs(df, ["k"], "i", "i").collect()) == [(1, 2), (3, 4), (5, 6)]
