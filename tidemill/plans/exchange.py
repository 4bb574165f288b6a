"""Registered queries over sources, sinks, jobs and single functions: what is written is read back."""

from __future__ import annotations

import dataclasses
import datetime as dt
import gzip

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import aggregates as A
from tidemill.operators import joins as J
from tidemill.operators import quality as Q
from tidemill.operators import shape as S
from tidemill.options import parse_options
from tidemill.plans.catalogue import query, table
from tidemill.scratch import scratch
from tidemill.sinks import files as K
from tidemill.sinks import tables as TB
from tidemill.sources import files as SRC
from tidemill.streaming import run

# sources


@query("SELECT i AS id, TIMESTAMP '2024-01-01' + to_seconds(7 * i) AS ts FROM range(5) t(i)")
def timestamped_literals(spark, sf_dir):
    return SRC.literal(spark, [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * i)) for i in range(5)], "id long, ts timestamp_ntz")


@query("SELECT 'Start' AS word, n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def started_by_option(spark, sf_dir):
    """One row, that carries an option, starts the plan."""
    return J.with_scalar(table(spark, sf_dir, "nation"), SRC.starter(spark, word="Start", region=2)).filter("n_regionkey = region").select("word", "n_nationkey", "n_name")


@query("SELECT n_name AS line FROM nation")
def text_lines(spark, sf_dir):
    path = scratch(spark, "lines")
    K.write_lines(table(spark, sf_dir, "nation"), path, F.col("n_name"))
    return SRC.lines(spark, path).select(F.col("value").alias("line"))


def _by_region(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file of nations' names for each region."""
    path = scratch(spark, "regions")
    K.write_by_key(table(spark, sf_dir, "nation"), path, "n_regionkey", F.col("n_name"))
    return path


def _region(path: str):
    return F.regexp_extract(path, "n_regionkey=(\\d+)/", 1).cast("int")


@query("SELECT n_name AS line FROM nation WHERE n_regionkey IN (1, 3)")
def lines_of_listed_paths(spark, sf_dir):
    """The files to read are themselves rows of a table."""
    found = SRC.matched(spark, f"{_by_region(spark, sf_dir)}/*/part-*")
    return SRC.lines_of(found.filter(_region("path").isin(1, 3)), "path").select(F.col("value").alias("line"))


@query("SELECT n_regionkey AS region, sum(strlen(n_name) + 1)::BIGINT AS length FROM nation GROUP BY 1")
def matched_files(spark, sf_dir):
    return SRC.matched(spark, f"{_by_region(spark, sf_dir)}/*/part-*").select(_region("path").alias("region"), "length")


@query("SELECT n_regionkey AS region, 1::BIGINT AS files FROM nation WHERE n_regionkey IN (1, 4) GROUP BY 1")
def matched_by_patterns(spark, sf_dir):
    """The patterns to match are themselves rows of a table."""
    path = _by_region(spark, sf_dir)
    patterns = SRC.literal(spark, [(f"{path}/n_regionkey={k}/part-*",) for k in (1, 4, 4)], "pattern string")
    return SRC.matched(spark, *SRC.listed(patterns, "pattern")).groupBy(_region("path").alias("region")).agg(F.count("*").alias("files"))


@query("SELECT n_regionkey AS region, n_name AS line, true AS named FROM nation")
def file_of_each_line(spark, sf_dir):
    read = SRC.lines(spark, f"{_by_region(spark, sf_dir)}/*/part-*", with_path=True)
    return read.select(_region("path").alias("region"), F.col("value").alias("line"), X.basename("path").startswith("part-").alias("named"))


@query("SELECT r_regionkey::VARCHAR || '.gz' AS file, r_regionkey <> 2 AS ok, CASE WHEN r_regionkey = 2 THEN '' ELSE r_name END AS text, r_regionkey = 2 AS has_error FROM region")
def corrupt_gzip(spark, sf_dir):
    """Files, one of them cut short, that a task writes each and another one reads."""
    folder = scratch(spark, "zipped")
    packed = F.udf(lambda k, name: gzip.compress(name.encode())[: 12 if k == 2 else None], "binary")
    files = table(spark, sf_dir, "region").select(F.concat(F.col("r_regionkey").cast("string"), F.lit(".gz")).alias("file"), packed("r_regionkey", "r_name").alias("data"))
    K.write_binary(files, folder, "file", "data")
    return SRC.gunzipped(spark, f"{folder}/*.gz").select(X.basename("path").alias("file"), "ok", "text", F.col("error").isNotNull().alias("has_error"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_size > 40")
def selected_columns(spark, sf_dir):
    return SRC.selected(spark, f"{sf_dir}/part.parquet", "p_partkey", "p_brand", where=F.col("p_size") > 40)


@query("SELECT n_name AS line FROM nation WHERE n_regionkey <> 0")
def notified_files(spark, sf_dir):
    """Messages {"id": bucket/path/generation} name the files to read."""
    found = SRC.matched(spark, f"{_by_region(spark, sf_dir)}/*/part-*").filter(_region("path") != 0)
    scheme = F.regexp_extract("path", "^[a-z0-9]+:/+", 0)
    messages = found.select(scheme.alias("scheme"), F.to_json(F.struct(F.concat(F.expr("substring(path, 1 + length(regexp_extract(path, '^[a-z0-9]+:/+', 0)))"), F.lit("/1560000000")).alias("id"))).alias("payload"))
    prefix = messages.select("scheme").first()[0]
    return SRC.lines_of(SRC.notified_paths(messages, "payload", prefix), "path").select(F.col("value").alias("line"))


@query("SELECT 1000::BIGINT AS n, 10::BIGINT AS keys, true AS in_range, true AS again")
def generated_rows(spark, sf_dir):
    """Made rows, by their range and that the same seed makes the same ones."""
    made = SRC.generated(spark, 1000)
    twin = SRC.generated(spark, 1000).withColumnRenamed("value", "twin").select("id", "twin")
    return made.join(twin, "id").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.every(F.col("value").between(0, 100) & F.col("key").between(0, 9)).alias("in_range"), F.every(F.col("value") == F.col("twin")).alias("again"))


@query("SELECT item_id, 'len ' || length(text) AS result FROM benchmark")
def throttled_calls(spark, sf_dir):
    """A client is called for each row, so many times a second at most."""
    return run.throttled(table(spark, sf_dir, "benchmark"), lambda text: f"len {len(text)}", "text", per_second=2000, workers=2).select("item_id", "result")


# sinks


def _files(spark: SparkSession, path: str):
    return F.lit(SRC.matched(spark, f"{path}/part-*").count())


@query("SELECT 1::BIGINT AS files, count(*) AS lines, count(DISTINCT p_name) AS names FROM part")
def text_in_one_file(spark, sf_dir):
    path = scratch(spark, "one")
    K.write_lines(table(spark, sf_dir, "part"), path, F.col("p_name"), shards=1)
    return SRC.lines(spark, path).agg(F.count("*").alias("lines"), F.count_distinct("value").alias("names")).withColumn("files", _files(spark, path).cast("long"))


@query("SELECT 7::BIGINT AS files, count(*) AS lines FROM orders")
def text_in_shards(spark, sf_dir):
    path = scratch(spark, "shards")
    K.write_lines(table(spark, sf_dir, "orders"), path, F.col("o_orderkey").cast("string"), shards=7)
    return SRC.lines(spark, path).agg(F.count("*").alias("lines")).withColumn("files", _files(spark, path).cast("long"))


@query("SELECT n_nationkey, n_name, n_regionkey, true AS named_by_hash FROM nation")
def json_by_hash(spark, sf_dir):
    path = scratch(spark, "hashed")
    K.write_json_by_hash(table(spark, sf_dir, "nation"), path)
    read = SRC.lines(spark, f"{path}/*/part-*", with_path=True).select("path", F.from_json("value", "n_nationkey int, n_name string, n_regionkey int").alias("j"))
    named = F.regexp_extract("path", "name=([0-9A-F]+)/", 1) == X.stable_name("n_nationkey", "n_name", "n_regionkey")
    return read.select("path", "j.*").withColumn("named_by_hash", named).drop("path")


@query("SELECT s_suppkey, round(s_suppkey % 256 * 63 / 255)::BIGINT AS row, 64::BIGINT AS lit FROM supplier")
def binary_files(spark, sf_dir):
    """A level stroke for each supplier, drawn, written as a file each, and read back."""
    y = (F.col("s_suppkey") % 256).cast("int")
    strokes = F.array(F.array(F.array(F.lit(0), F.lit(255)), F.array(y, y)))
    folder = scratch(spark, "images")
    drawn = K.rastered(table(spark, sf_dir, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".pgm")).alias("file"), X.stroke_segments(strokes).alias("segments")), "segments")
    K.write_binary(drawn, folder, "file", "image")
    pixels = F.expr("substring(hex(content), 1 + 2 * length('P5 64 64 255\n'))")
    lit = (F.length(pixels) - F.length(F.replace(pixels, F.lit("FF"), F.lit("")))) / 2
    read = spark.read.format("binaryFile").load(folder)
    return read.select(F.split_part(X.basename("path"), F.lit("."), F.lit(1)).cast("long").alias("s_suppkey"), F.floor((F.instr(pixels, "FF") - 1) / 128).alias("row"), lit.cast("long").alias("lit"))


@query("SELECT i AS s, j AS x0, j AS y0, j + 1 AS x1, j + 1 AS y1 FROM (VALUES (0, 0), (0, 1), (1, 0)) t(i, j)")
def stroke_segments(spark, sf_dir):
    """Neighbouring points of strokes of three, two and one point."""
    line = lambda n: F.array(*[F.array(*[F.lit(k) for k in range(n)]) for _ in "xy"])
    drawings = spark.range(2).select(F.col("id").cast("int").alias("s"), F.when(F.col("id") == 0, F.array(line(3), line(1))).otherwise(F.array(line(2))).alias("drawing"))
    return drawings.select("s", F.explode(X.stroke_segments("drawing")).alias("p")).select("s", "p.*")


@query("SELECT * FROM (SELECT 'append' AS step, 2 * count(*) AS n FROM nation) UNION ALL SELECT 'truncate', count(*) FROM nation")
def table_dispositions(spark, sf_dir):
    path, nation = scratch(spark, "dispositions"), table(spark, sf_dir, "nation")
    count = lambda step: SRC.literal(spark, [(step, spark.read.parquet(path).count())], "step string, n long")
    TB.write_table(nation, path)
    TB.write_table(nation, path)
    appended = count("append")
    TB.write_table(nation, path, truncate=True)
    return S.flatten(appended, count("truncate"))


@query("SELECT true AS refused, count(*) AS n FROM region")
def never_created(spark, sf_dir):
    """A table that must be there is refused while it isn't, and written once it is."""
    path, region = scratch(spark, "never"), table(spark, sf_dir, "region")
    try:
        TB.write_table(region, path, create=False)
        refused = False
    except FileNotFoundError:
        refused = True
    TB.write_table(region.limit(0), path)
    TB.write_table(region, path, create=False)
    return spark.read.parquet(path).agg(F.lit(refused).alias("refused"), F.count("*").alias("n"))


@query("SELECT event_type AS destination, event_type = 'click' AS has_value, count(*) AS n, max(event_id) AS last FROM events WHERE event_type IN ('click', 'error') GROUP BY ALL")
def routed_by_schema(spark, sf_dir):
    """Each destination has columns of its own; rows of no destination are left out."""
    schemas = {"click": [F.col("event_id"), F.round("value", 2).alias("value")], "error": [F.col("event_id"), F.col("user_id")]}
    paths = TB.route_by_schema(table(spark, sf_dir, "events"), F.col("event_type"), scratch(spark, "schemas"), schemas)
    read = {name: spark.read.parquet(path) for name, path in paths.items()}
    return S.flatten(*[df.agg(F.lit(name).alias("destination"), F.lit("value" in df.columns).alias("has_value"), F.count("*").alias("n"), F.max("event_id").alias("last")) for name, df in read.items()])


@query("SELECT count(*) FILTER (event_id % 3 < 2) AS event_ids, count(*) FILTER (event_id % 3 <> 1) AS user_ids, count(*) FILTER (event_id % 3 = 1) AS event_types, sum(event_id) FILTER (event_id % 3 < 2)::BIGINT AS total FROM events")
def table_of_inferred_schema(spark, sf_dir):
    """The sink's columns are those that the rows themselves hold."""
    e = table(spark, sf_dir, "events")
    payload = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct("event_id", "user_id"))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct("event_id", "event_type"))).otherwise(F.to_json(F.struct("user_id")))
    path = scratch(spark, "inferred")
    TB.write_table(Q.parse_inferred(e.select(F.col("event_id").alias("ord"), payload.alias("payload")), "payload", "ord"), path)
    return spark.read.parquet(path).agg(F.count("event_id").alias("event_ids"), F.count("user_id").alias("user_ids"), F.count("event_type").alias("event_types"), F.sum("event_id").alias("total"))


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name, NULL::VARCHAR AS r_comment FROM region")
def null_columns(spark, sf_dir):
    """Fields that rows lack are null in the table."""
    path = scratch(spark, "nulls")
    TB.write_table(table(spark, sf_dir, "region"), path, Q.schema_from_text("r_regionkey:INTEGER,r_name:STRING,r_comment:STRING"))
    return spark.read.parquet(path)


# projections, filters, functions


@query("SELECT n_nationkey, n_name || '|Its weekend!' AS pair, 2 AS n FROM nation")
def map_to_list(spark, sf_dir):
    listed = table(spark, sf_dir, "nation").select("n_nationkey", F.array("n_name", F.lit("Its weekend!")).alias("l"))
    return listed.select("n_nationkey", F.array_join("l", "|").alias("pair"), F.size("l").alias("n"))


@query("SELECT n_regionkey AS key, n_name AS value FROM nation")
def keys_and_values(spark, sf_dir):
    return S.keyed(table(spark, sf_dir, "nation"), F.col("n_regionkey"), F.col("n_name")).select("key", "value")


@query("SELECT count(*) AS n, 4::BIGINT AS salts, true AS in_range, true AS again FROM events")
def dummy_key(spark, sf_dir):
    """Keys made for rows that have none, the same whenever they are made."""
    e = S.salted(table(spark, sf_dir, "events").select("event_id"), 4, "event_id")
    return S.salted(e, 4, "event_id", name="twin").agg(F.count("*").alias("n"), F.count_distinct("salt").alias("salts"), F.every(F.col("salt").between(0, 3)).alias("in_range"), F.every(F.col("salt") == F.col("twin")).alias("again"))


@query("SELECT count(*) AS n, true AS raised FROM nation WHERE length(n_name) >= 5")
def short_rows_raise(spark, sf_dir):
    """A short row ends the query with an error; the same without one goes through."""
    nation = table(spark, sf_dir, "nation")
    try:
        S.at_least(S.flatten(nation.select("n_name"), SRC.literal(spark, [("abc",)], "n_name string")), "n_name", 5, fail=True).count()
        raised = False
    except Exception as e:  # Spark's own kinds of error differ between versions
        raised = "too short: abc" in str(e)
    return S.at_least(S.at_least(nation, "n_name", 5), "n_name", 5, fail=True).agg(F.count("*").alias("n"), F.lit(raised).alias("raised"))


@query("SELECT n_name AS line FROM nation WHERE n_nationkey % 3 = 0")
def without_empty_lines(spark, sf_dir):
    line = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, F.lit(""))
    return S.not_empty(table(spark, sf_dir, "nation").select(line.alias("line")), "line")


@query("SELECT n_name AS line FROM nation")
def without_header(spark, sf_dir):
    lines = S.flatten(SRC.literal(spark, [("N_Name",), ("n_NAME",)], "line string"), table(spark, sf_dir, "nation").select(F.col("n_name").alias("line")))
    return S.without_header(lines, "line", "n_name")


@query("SELECT event_id, CASE WHEN event_id % 10 = 4 THEN 'skip' WHEN event_id % 10 = 6 THEN 'slow' WHEN event_id % 10 = 7 THEN 'error' ELSE 'ok' END AS tag FROM events")
def modulus_branches(spark, sf_dir):
    branch = lambda k: F.col("event_id") % 10 == k
    return S.tagged(table(spark, sf_dir, "events").select("event_id"), ("skip", branch(4)), ("slow", branch(6)), ("error", branch(7)), otherwise="ok")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'csv' ELSE 'xml' END AS kind FROM pages")
def by_extension(spark, sf_dir):
    path = F.concat(F.lit("/in.d/page-"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".csv").otherwise(".txt"))
    files = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return S.tagged(files, ("csv", X.extension("path") == "csv"), otherwise="xml").select("page_id", F.col("tag").alias("kind"))


@query("SELECT source, count(*) AS n, round(count(toxic) / count(*)::DOUBLE, 4) AS labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def non_null_share(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.round(A.ratio_of(F.col("toxic").isNotNull()), 4).alias("labelled"))


@query("SELECT o_orderkey, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 4) AS share FROM orders")
def scalar_side_input(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return J.with_scalar(orders, orders.agg(F.max("o_totalprice").alias("most"))).select("o_orderkey", F.round(F.col("o_totalprice") / F.col("most"), 4).alias("share"))


@query("SELECT 10::BIGINT AS n, 10::BIGINT AS ids, true AS known, true AS again")
def fixed_sample(spark, sf_dir):
    """Ten rows drawn evenly; the same ones when drawn again."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    drawn, twin = A.sample_fixed(orders, 10), A.sample_fixed(orders, 10).withColumn("again", F.lit(True))
    both = drawn.join(orders.withColumn("known", F.lit(True)), "o_orderkey", "left").join(twin, "o_orderkey", "left")
    return both.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("ids"), F.every(F.coalesce("known", F.lit(False))).alias("known"), F.every(F.coalesce("again", F.lit(False))).alias("again"))


@query("SELECT r_regionkey AS key, r_name AS value, true AS repeated_key_fails FROM region")
def key_map(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    try:
        A.as_map(S.flatten(region, region), "r_regionkey", "r_name").collect()
        fails = False
    except Exception as e:  # Spark's own kinds of error differ between versions
        fails = "DUPLICATED_MAP_KEY" in str(e)
    return A.as_map(region, "r_regionkey", "r_name").select(F.explode("map")).withColumn("repeated_key_fails", F.lit(fails))


@query("SELECT c_mktsegment, round(median(c_acctbal), 4) AS middle, count(*) AS n FROM customer GROUP BY 1")
def own_combiner(spark, sf_dir):
    """An aggregate in Python, of each group's rows."""
    got = A.combined(table(spark, sf_dir, "customer"), ["c_mktsegment"], ["c_acctbal"], lambda g: (float(g["c_acctbal"].median()), len(g)), "middle double, n long")
    return got.withColumn("middle", F.round("middle", 4))


@query("SELECT p_partkey, 'f' || p_partkey || '.tar.gz' AS base, 'gz' AS ext, '/d/' || p_size AS dir FROM part")
def paths_taken_apart(spark, sf_dir):
    path = F.concat(F.lit("/d/"), F.col("p_size").cast("string"), F.lit("/f"), F.col("p_partkey").cast("string"), F.lit(".tar.gz"))
    return table(spark, sf_dir, "part").select("p_partkey", X.basename(path).alias("base"), X.extension(path).alias("ext"), X.dirname(path).alias("dir"))


@query("SELECT p_brand, printf('%s: %.1f%% accepted, %d rows', p_brand, 100.0 * (count(*) FILTER (p_size > 25)) / count(*) + 0.0001, count(*)) AS line FROM part GROUP BY p_brand")
def formatted_lines(spark, sf_dir):
    """Ratios as percentages, moved off the halves that languages round differently."""
    found = A.statistics(table(spark, sf_dir, "part"), ["p_brand"], F.col("p_size") > 25, {})
    return found.withColumn("accepted_ratio", F.col("accepted_ratio") + 0.000001).select("p_brand", A.statistics_line("p_brand").alias("line"))


@query("SELECT n_name, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::INTEGER AS hash FROM (SELECT n_name, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n_name, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM nation)")
def char_code_hashes(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", X.char_code_hash("n_name").alias("hash"))


@query("SELECT event_id, to_timestamp(event_id * 86400 + 0.5)::TIMESTAMP AS at FROM events")
def epoch_times(spark, sf_dir):
    seconds = F.concat((F.col("event_id") * 86_400).cast("string"), F.lit(".5"))
    return table(spark, sf_dir, "events").select("event_id", X.epoch_time(seconds).cast("timestamp_ntz").alias("at"))


_ONES = str(["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"])
_TENS = str(["", "ten", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"])


@query(f"""WITH u AS (SELECT p_partkey, p_partkey % 1000 AS n FROM part), t AS (SELECT *, n % 100 AS r FROM u),
s AS (SELECT *, CASE WHEN r < 20 THEN {_ONES}[r + 1] ELSE {_TENS}[r // 10 + 1] || CASE WHEN r % 10 > 0 THEN '-' || {_ONES}[r % 10 + 1] ELSE '' END END AS small FROM t),
h AS (SELECT *, CASE WHEN n < 100 THEN small WHEN r = 0 THEN {_ONES}[n // 100 + 1] || ' hundred' ELSE {_ONES}[n // 100 + 1] || ' hundred and ' || small END AS w FROM s)
SELECT p_partkey, w AS low, CASE WHEN n = 0 THEN 'seven million' WHEN n < 100 THEN 'seven million and ' || w ELSE 'seven million, ' || w END AS high FROM h""")
def numbers_in_words(spark, sf_dir):
    n = F.col("p_partkey") % 1000
    return table(spark, sf_dir, "part").select("p_partkey", X.in_words(n).alias("low"), X.in_words(n + 7_000_000).alias("high"))


_KEY = b"a key that is known to all"


def _hmac_sql(key: bytes, message: str) -> str:
    pad = lambda x: f"unhex('{bytes(b ^ x for b in key.ljust(64, bytes(1))).hex()}')"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({message}))))"


@query(f"SELECT item_id, {_hmac_sql(_KEY, 'text')} AS signature FROM benchmark")
def signed_texts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.signature("text", _KEY).alias("signature"))


@query("SELECT r_regionkey, true AS now FROM region")
def processing_time(spark, sf_dir):
    """Rows stamped with the time at which they are handled."""
    began = dt.datetime.now(dt.UTC).timestamp()
    stamped = table(spark, sf_dir, "region").withColumn("at", F.current_timestamp().cast("double"))
    return stamped.select("r_regionkey", F.col("at").between(began - 60, began + 3600).alias("now"))


# functions of the caller's, options, jobs


@query("SELECT count(*) + 1 AS n, true AS set_up, count(*) AS last FROM part")
def per_partition_hooks(spark, sf_dir):
    """A task's state is made before its first batch and gives a row of its own after its last."""
    import pandas as pd

    def each(state: dict, batch: pd.DataFrame) -> pd.DataFrame:
        state["n"] += len(batch)
        return pd.DataFrame({"set_up": [state["ready"]] * len(batch), "seen": [0] * len(batch)})

    found = S.per_partition(table(spark, sf_dir, "part").select("p_partkey").coalesce(1), "set_up boolean, seen long", lambda: {"n": 0, "ready": True}, each, lambda state: pd.DataFrame({"set_up": [True], "seen": [state["n"]]}))
    return found.agg(F.count("*").alias("n"), F.every("set_up").alias("set_up"), F.max("seen").alias("last"))


@query("SELECT event_id, event_id % 5 <> 0 AS ok, CASE WHEN event_id % 5 <> 0 THEN (props->>'k')::BIGINT * 2 END AS doubled, CASE WHEN event_id % 5 = 0 THEN 'JSONDecodeError' END AS error FROM events")
def guarded_function(spark, sf_dir):
    """A caller's function on JSON text whose failures are rows, not the query's."""
    import json

    def doubled(text: str) -> str:
        return str(json.loads(text)["k"] * 2)

    raw = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "{bad").otherwise(F.col("props")).alias("p"))
    return raw.withColumn("u", Q.guarded(doubled)(F.col("p"))).select("event_id", "u.ok", F.col("u.value").cast("long").alias("doubled"), F.split_part("u.error", F.lit(":"), F.lit(1)).alias("error"))


@query("SELECT event_id, CASE WHEN (props->>'k')::BIGINT > 50 THEN 'high' ELSE 'low' END AS side FROM events")
def lambda_columns(spark, sf_dir):
    """A caller's function of batches of values as a column."""
    side = F.pandas_udf(lambda k: (k > 50).map({True: "high", False: "low"}), "string")
    return table(spark, sf_dir, "events").select("event_id", side(F.get_json_object("props", "$.k").cast("long")).alias("side"))


@dataclasses.dataclass
class ShareOptions:
    """Orders of a status, and which outputs are wanted."""

    status: str = dataclasses.field(metadata={"help": "the status kept"})
    multiple: float = 1.5
    counts: bool = True
    totals: bool = False


@query("SELECT 'counts' AS output, count(*)::DOUBLE AS x FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'totals', round(sum(o_totalprice * 2.5), 2) FROM orders WHERE o_orderstatus = 'F'")
def options_choose_outputs(spark, sf_dir):
    """A job's typed options: a required one, one that a function of rows reads, and switches of outputs."""
    o = parse_options(ShareOptions, ["--status", "F", "--multiple", "2.5", "--totals"])
    return _outputs(table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == o.status), o)


@query("SELECT 'counts' AS output, count(*)::DOUBLE AS x FROM orders WHERE o_orderstatus = 'O'")
def options_by_default(spark, sf_dir):
    o = parse_options(ShareOptions, ["--status", "O"])
    return _outputs(table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == o.status), o)


def _outputs(kept: DataFrame, o: ShareOptions) -> DataFrame:
    scaled = F.pandas_udf(lambda x: x * o.multiple, "double")  # read where rows are
    wanted = {"counts": (o.counts, F.count("*").cast("double")), "totals": (o.totals, F.round(F.sum("scaled"), 2))}
    rows = kept.withColumn("scaled", scaled(F.col("o_totalprice"))) if o.totals else kept
    return S.flatten(*[rows.agg(F.lit(name).alias("output"), c.alias("x")) for name, (on, c) in wanted.items() if on])


@query("SELECT count(*) AS seen, count(*) AS kept, true AS timed FROM lineitem WHERE l_quantity > 25")
def observed_metrics(spark, sf_dir):
    """Counts and times of a step, taken while it runs."""
    import time

    watched, metrics = A.observed(table(spark, sf_dir, "lineitem").filter("l_quantity > 25"), "step", F.count("*").alias("seen"), F.min(F.expr("now()")).alias("began"))
    began = time.monotonic()
    path = scratch(spark, "watched")
    watched.select("l_orderkey").write.parquet(path)
    got, wall = metrics.get, time.monotonic() - began
    return spark.read.parquet(path).agg(F.lit(got["seen"]).cast("long").alias("seen"), F.count("*").alias("kept"), F.lit(wall > 0 and got["began"] is not None).alias("timed"))
