import gzip
import os

import pytest
from pyspark.sql import functions as F

from tidemill.functions.text import stroke_segments
from tidemill.operators.quality import schema_from_text
from tidemill.sinks import files as K
from tidemill.sinks import tables as TB
from tidemill.sources import files as SRC


def names(folder):
    return sorted(x for x in os.listdir(folder) if not x.startswith((".", "_")))


def text_of(folder):
    return [open(f"{folder}/{x}").read() for x in names(folder)]


@pytest.fixture
def lines(tmp_path):
    for i in (1, 2):
        (tmp_path / f"file{i}.txt").write_text("".join(f"row {j}\n" for j in range(3)))
    return tmp_path


def test_sources(spark, lines):
    assert SRC.lines(spark, f"{lines}/*.txt").count() == 6
    assert SRC.lines(spark, f"{lines}/*.txt", with_path=True).select("path").distinct().count() == 2
    assert {r.value for r in SRC.whole_files(spark, f"{lines}/*.txt").collect()} == {"row 0\nrow 1\nrow 2\n"}
    assert SRC.matched(spark, f"{lines}/*1.txt", f"{lines}/*.txt").count() == 2
    listed = spark.createDataFrame([(f"{lines}/file1.txt",), (f"{lines}/file1.txt",)], "p string")
    assert SRC.lines_of(listed, "p").count() == 3 and SRC.lines_of(listed.limit(0), "p").count() == 0
    notes = spark.createDataFrame([('{"id": "bucket/dir/file/123"}',), ("x",)], "m string")
    assert [r.path for r in SRC.notified_paths(notes, "m", "store://").collect()] == ["store://bucket/dir/file"]
    assert SRC.starter(spark, bucket="b").first().bucket == "b"
    assert SRC.literal(spark, [(1,)], "a int").count() == 1 and SRC.generated(spark, 50).count() == 50
    assert SRC.query(spark, "SELECT count(*) AS n FROM numbers", numbers=spark.range(7)).first().n == 7


def test_pruned_reads(spark, tmp_path):
    spark.range(100).withColumn("x", F.lit("y")).write.parquet(f"{tmp_path}/t")
    plan = SRC.selected(spark, f"{tmp_path}/t", "id", where=F.col("id") > 90)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "GreaterThan(id,90)" in plan


def test_corrupt_files_are_rows(spark, tmp_path):
    (tmp_path / "good.gz").write_bytes(gzip.compress(b"fine"))
    (tmp_path / "bad.gz").write_bytes(b"not gzip")
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b"fine" * 100)[:-9])
    got = {os.path.basename(r.path): (r.ok, r.text) for r in SRC.gunzipped(spark, f"{tmp_path}/*.gz").collect()}
    assert got == {"good.gz": (True, "fine"), "bad.gz": (False, ""), "cut.gz": (False, "")}


def test_text_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(10)], "id int, v string")
    K.write_lines(df, f"{tmp_path}/one", F.concat_ws(",", "id", "v"), shards=1)
    K.write_lines(df.select("v"), f"{tmp_path}/many", shards=4)
    assert len(names(f"{tmp_path}/one")) == 1 and len(names(f"{tmp_path}/many")) == 4
    K.write_csv(df.orderBy("id").limit(2), f"{tmp_path}/csv")
    assert text_of(f"{tmp_path}/csv") == ['"id","v"\n"0","v0"\n"1","v1"\n']


def test_files_by_key_hash_and_window(spark, tmp_path):
    df = spark.createDataFrame([(k, f"this is row {i}") for i, k in enumerate(["one", "two", "three", "four"], 1)], "key string, value string")
    K.write_by_key(df, f"{tmp_path}/k", "key", F.col("value"))
    assert K.rename_parts(spark, f"{tmp_path}/k", lambda key, i: f"{key}-{i}.txt") == ["four-0.txt", "one-0.txt", "three-0.txt", "two-0.txt"]
    assert open(f"{tmp_path}/k/two-0.txt").read() == "this is row 2\n"
    K.write_json_by_hash(spark.createDataFrame([(0, "hello"), (1, "world")], "id long, message string"), f"{tmp_path}/h")
    assert sorted(x for d in names(f"{tmp_path}/h") for x in text_of(f"{tmp_path}/h/{d}")) == ['{"id":0,"message":"hello"}\n', '{"id":1,"message":"world"}\n']
    events = spark.createDataFrame([(f"e{i}", 1558465286.93 + 4 * i) for i in range(10)], "event string, t double").withColumn("window", F.window(F.timestamp_micros((F.col("t") * 1_000_000).cast("long")), "10 seconds"))
    K.write_by_window(events, f"{tmp_path}/w", "window", F.col("event"))
    assert [sum(x.count("\n") for x in text_of(f"{tmp_path}/w/{d}")) for d in names(f"{tmp_path}/w")] == [1, 3, 2, 3, 1]


def test_binary_files_and_rasters(spark, tmp_path):
    df = spark.createDataFrame([("k1", [[[0, 255], [0, 255]]]), ("k2", [[[9], [9]]])], "key_id string, drawing array<array<array<int>>>")
    drawn = K.rastered(df.select(F.concat("key_id", F.lit(".pgm")).alias("name"), stroke_segments("drawing").alias("s")), "s", "data", 8)
    assert K.write_binary(drawn, f"{tmp_path}/img", "name", "data") == 2
    image = (tmp_path / "img" / "k1.pgm").read_bytes()
    assert image[:11] == b"P5 8 8 255\n" and [image[11 + 9 * i] for i in range(8)] == [255] * 8 and sum(image[11:]) == 8 * 255


def test_tables_and_dispositions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    with pytest.raises(FileNotFoundError):
        TB.write_table(df, f"{tmp_path}/t", create=False)
    schema = schema_from_text("id:INTEGER,name:STRING,extra:FLOAT")
    for _ in range(2):
        TB.write_table(df, f"{tmp_path}/t", schema)
    got = spark.read.parquet(f"{tmp_path}/t")
    assert got.count() == 2 and got.dtypes == [("id", "bigint"), ("name", "string"), ("extra", "double")] and got.filter("extra IS NULL").count() == 2
    TB.write_table(df, f"{tmp_path}/t", schema, truncate=True)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1


def test_routing(spark, tmp_path):
    df = spark.createDataFrame([("b1", "a1", None, "book"), ("b2", "a2", None, "book"), ("m1", None, "d1", "movie")], "name string, author string, director string, type string")
    TB.route(df, F.col("type"), f"{tmp_path}/r")
    assert names(f"{tmp_path}/r") == ["destination=book", "destination=movie"] and spark.read.parquet(f"{tmp_path}/r").count() == 3
    out = TB.route_by_schema(df, F.col("type"), f"{tmp_path}/s", {"book": [F.col("name"), F.col("author")], "movie": [F.col("name"), F.col("director")]})
    assert spark.read.parquet(out["book"]).columns == ["name", "author"] and spark.read.parquet(out["movie"]).count() == 1


def test_dead_letters_and_merging(spark, tmp_path):
    df = spark.createDataFrame([("1", "x"), ("bad", "y")], "index string, event string")
    good, bad = TB.write_typed(df, schema_from_text("index:INTEGER,event:STRING"), f"{tmp_path}/d")
    assert spark.read.parquet(good).count() == 1 and spark.read.parquet(bad).first().original == '{"index":"bad","event":"y"}'
    new = lambda *rows: spark.createDataFrame(list(rows), "name string, total bigint")
    TB.merge_table(spark, f"{tmp_path}/m", new(("laptop", 20), ("tv", 1)), ["name"])
    TB.merge_table(spark, f"{tmp_path}/m", new(("tv", 15)), ["name"])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/m").collect())) == [("laptop", 20), ("tv", 15)] and names(tmp_path).count("m") == 1
