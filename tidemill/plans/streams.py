"""Registered queries over streams: files that appear are read, handled batch by batch, and what came out is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.functions import text as X
from tidemill.operators.quality import guarded
from tidemill.plans.catalogue import _event_stream, _streamed, query, rounded, table
from tidemill.scratch import scratch
from tidemill.session import SETTINGS
from tidemill.sinks import files as K
from tidemill.sources import streams
from tidemill.streaming import run, state
from tidemill.streaming import windows as SW


def _ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def _in_turns(spark: SparkSession, *tables: DataFrame) -> DataFrame:
    """A stream that has one table's rows in each micro-batch."""
    path = scratch(spark, "turns")
    for t in tables:
        t.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _ticked(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream whose state goes by the clock gives until all there is was read: it never ends by itself."""
    for k, v in SETTINGS.items():
        if k.startswith("spark.sql.streaming."):
            spark.conf.set(k, v)
    path = scratch(spark, name)
    started = stream.writeStream.option("checkpointLocation", scratch(spark, f"{name}-checkpoint")).foreachBatch(lambda df, _: run.appended(path)(df)).start()
    _until(started, lambda p: p["batchId"] > 0 and p["numInputRows"] == 0)
    return spark.read.parquet(path)


def _until(started: StreamingQuery, done: Callable) -> None:
    """Stop a query once done(its last progress) holds; raise what it failed with."""
    try:
        while started.exception() is None and (started.lastProgress is None or not done(started.lastProgress)):
            started.awaitTermination(0.05)
    finally:
        started.stop()
    if started.exception() is not None:
        raise started.exception()


# messages


def _messages(events: DataFrame, payload=None) -> str:
    """Events as a folder of messages."""
    path = scratch(events.sparkSession, "messages")
    attributes = F.create_map(F.lit("evId"), F.col("event_id").cast("string"), F.lit("kind"), F.col("event_type"))
    events.select((F.to_json(F.struct("event_id", "user_id")) if payload is None else payload).alias("payload"), attributes.alias("attributes"), F.col("ts").alias("publish_time")).write.json(path)
    return path


@query("SELECT date_trunc('day', ts) AS window_start, count(*) AS n FROM events GROUP BY 1")
def stream_messages(spark, sf_dir):
    """Messages by the day on which they were published."""
    out = _streamed(spark, SW.counted(streams.messages(spark, _messages(_events(spark, sf_dir))), "publish_time", "1 day", "1 hour"), "published")
    return _ntz(out.select("window_start", "n"), "window_start")


@query("SELECT event_id::VARCHAR AS ev_id, event_type AS kind, true AS lacks FROM events")
def stream_attributes(spark, sf_dir):
    read = streams.messages(spark, _messages(_events(spark, sf_dir)))
    return _streamed(spark, read.select(streams.attribute("evId").alias("ev_id"), streams.attribute("kind").alias("kind"), streams.attribute("none").isNull().alias("lacks")), "attributes", "append")


@query("SELECT event_type AS topic, count(*) AS n, max(event_id) AS last FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def stream_topics(spark, sf_dir):
    """Two topics read in one job."""
    e = _events(spark, sf_dir)
    folders = {k: _messages(e.filter(F.col("event_type") == k)) for k in ("click", "view")}
    rows = _streamed(spark, streams.topics(spark, **folders).select("topic", F.get_json_object("payload", "$.event_id").cast("long").alias("id")), "topics", "append")
    return rows.groupBy("topic").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query("SELECT item_id, text, octet_length(encode(text)) AS n_bytes FROM benchmark")
def stream_decoded(spark, sf_dir):
    """Payloads as bytes, read as UTF-8."""
    path = scratch(spark, "bytes")
    table(spark, sf_dir, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("payload")).write.json(path)
    read = streams.records(spark, path, "item_id long, payload binary")
    return _streamed(spark, read.select("item_id", streams.decoded("payload").alias("text"), F.octet_length("payload").cast("long").alias("n_bytes")), "decoded", "append")


@query("SELECT n_regionkey AS region, n_name AS line FROM nation")
def stream_polled_lines(spark, sf_dir):
    """Lines of files below a watched folder, with the folder of each."""
    path = scratch(spark, "watched")
    K.write_by_key(table(spark, sf_dir, "nation"), path, "n_regionkey", F.col("n_name"))
    read = streams.polled_lines(spark, path, 2)
    return _streamed(spark, read.select(F.regexp_extract("path", "n_regionkey=(\\d+)/", 1).cast("int").alias("region"), F.col("value").alias("line")), "polled", "append")


@query("""SELECT CASE WHEN event_id % 10 = 3 THEN 'parse' WHEN event_id % 10 = 7 THEN 'function' ELSE 'good' END AS outcome, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY 1""")
def json_dead_letters(spark, sf_dir):
    """Messages go through a caller's function, are parsed, and land in a table; failures of both in its error table."""
    kind = F.col("event_id") % 10
    payload = F.when(kind == 3, F.concat(F.lit("{bad "), F.col("event_id").cast("string"))).when(kind == 7, F.to_json(F.struct(F.col("event_id"), F.lit(True).alias("fail")))).otherwise(F.to_json(F.struct("event_id")))
    stream = streams.messages(spark, _messages(_events(spark, sf_dir), payload))

    def checked(text: str) -> str:
        if '"fail"' in text:
            raise ValueError("told to fail")
        return text

    f, path = guarded(checked), scratch(spark, "parsed")
    write = run.json_to_tables("payload", "struct<event_id:long>", path, transform=lambda df: df.withColumn("udf", f(F.col("payload"))))
    run.available(stream, write, scratch(spark, "parsed-checkpoint"))
    good = spark.read.parquet(path).select(F.lit("good").alias("outcome"), "event_id")
    bad = spark.read.parquet(f"{path}_error_records").select(F.when(F.col("error_message").contains("told to fail"), "function").otherwise("parse").alias("outcome"), F.regexp_extract("payload", "([0-9]+)", 1).cast("long").alias("event_id"))
    return good.unionByName(bad).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query("SELECT event_id::VARCHAR AS payload, true AS stamped FROM events WHERE event_type = 'error'")
def sent_messages(spark, sf_dir):
    """A stream's rows sent on to a topic, and read from there."""
    topic = scratch(spark, "topic")
    errors = _event_stream(spark, sf_dir).filter("event_type = 'error'").select(F.col("event_id").alias("v"))
    run.available(errors, run.sent(topic, "v"), scratch(spark, "sent"))
    return _streamed(spark, streams.messages(spark, topic).select("payload", (F.col("publish_time") > F.lit("2024-01-01").cast("timestamp")).alias("stamped")), "resent", "append")


@query("SELECT 'a' AS copy, count(*) AS n, sum(event_id)::BIGINT AS total FROM events UNION ALL SELECT 'b', count(*), sum(event_id)::BIGINT FROM events")
def dual_sink(spark, sf_dir):
    """Each micro-batch is written to two tables."""
    paths = {k: scratch(spark, k) for k in "ab"}
    run.available(_event_stream(spark, sf_dir).select("event_id"), run.fan_out(*[run.appended(p) for p in paths.values()]), scratch(spark, "dual"))
    one = lambda k, p: spark.read.parquet(p).agg(F.lit(k).alias("copy"), F.count("*").alias("n"), F.sum("event_id").alias("total"))
    return one("a", paths["a"]).unionByName(one("b", paths["b"]))


@query("SELECT 'Row(r_name=''' || r_name || ''')' AS line FROM region")
def logged_rows(spark, sf_dir):
    seen: list[str] = []
    run.available(_in_turns(spark, table(spark, sf_dir, "region").select("r_name")), run.logged(seen.append), scratch(spark, "logged"))
    return spark.createDataFrame([(x,) for x in seen], "line string")


@query("SELECT way, count(*) AS n, sum(event_id)::BIGINT AS total FROM events, (VALUES ('load'), ('insert')) w(way) GROUP BY 1")
def loads_and_inserts(spark, sf_dir):
    """A stream's rows loaded batch by batch, and inserted by the file sink."""
    paths = {k: scratch(spark, k) for k in ("load", "insert")}
    rows = lambda: _event_stream(spark, sf_dir).select("event_id")
    run.available(rows(), run.appended(paths["load"]), scratch(spark, "loads"))
    run.inserted(rows(), paths["insert"], scratch(spark, "inserts"))
    read = {k: spark.read.parquet(p).withColumn("way", F.lit(k)) for k, p in paths.items()}
    return read["load"].unionByName(read["insert"]).groupBy("way").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


# beats and windows


@query("SELECT i AS beat, TIMESTAMP '2024-01-01' + to_seconds(5 * i) AS ts FROM range(3) t(i)")
def stream_heartbeat(spark, sf_dir):
    """The first beats of a source that ticks each five seconds of event time."""
    path = scratch(spark, "beats")
    started = streams.heartbeat(spark, 5, 1_704_067_200_000).writeStream.option("checkpointLocation", scratch(spark, "beating")).foreachBatch(lambda df, _: run.appended(path)(df)).start()
    _until(started, lambda p: p["batchId"] >= 3)
    return _ntz(spark.read.parquet(path).filter("beat < 3"), "ts").select("beat", F.col("ts"))


@query("WITH c AS (SELECT date_trunc('hour', ts) AS w, count(*) AS n FROM events WHERE hour(ts) % 3 > 0 GROUP BY 1) SELECT window_start, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31 23:00:00', INTERVAL 1 HOUR)) AS window_start) LEFT JOIN c ON w = window_start")
def stream_empty_windows(spark, sf_dir):
    """Hours without an event have a count of 0 by the beats that fall into them."""
    e = _events(spark, sf_dir).filter(F.hour("ts") % 3 > 0).select("ts")
    beats = spark.range(31 * 24).select(F.timestamp_seconds(F.col("id") * 3600 + 1_704_067_200 + 60).alias("ts"))
    out = _streamed(spark, SW.counted_with_beats(_in_turns(spark, e), _in_turns(spark, beats), "ts", "1 hour", "1 hour"), "beaten")
    return _ntz(out, "window_start").select("window_start", F.col("n").cast("long").alias("n"))


@query("SELECT * FROM (SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY ALL) WHERE window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 2 HOUR")
def stream_closed_windows(spark, sf_dir):
    """Windows come out once, when the watermark has passed their end; those still open, and empty ones, don't."""
    out = _streamed(spark, SW.counted(_in_turns(spark, _events(spark, sf_dir)), "ts", "1 hour", "2 hours", keys=["event_type"]), "closed", "append")
    return _ntz(out.select("event_type", "window_start", "n"), "window_start")


#: Events of the first half come first, those of its last day by themselves; then a tenth of them once more, late, then the
#: second half. What is late is judged by what was known before the micro-batch before.
_DAY, _HALF, _DELAY = "TIMESTAMP '2024-01-15'", "TIMESTAMP '2024-01-16'", "INTERVAL 3 DAY"


@query(f"""WITH m AS (SELECT date_trunc('millisecond', max(ts)) - {_DELAY} AS first FROM events WHERE ts < {_DAY}), z AS (SELECT date_trunc('millisecond', max(ts)) - {_DELAY} AS last FROM events),
late AS (SELECT ts FROM events, m WHERE ts < {_HALF} AND event_id % 10 = 0 AND date_trunc('hour', ts) + INTERVAL 1 HOUR > first),
every AS (SELECT ts FROM events UNION ALL SELECT ts FROM late)
SELECT date_trunc('hour', ts) AS window_start, count(*) AS n FROM every GROUP BY 1 HAVING window_start + INTERVAL 1 HOUR <= (SELECT last FROM z)""")
def stream_late_rows(spark, sf_dir):
    """Late rows count while their window is open, and are dropped once it has closed."""
    e = _events(spark, sf_dir).select("event_id", "ts")
    before = lambda t: F.col("ts") < F.expr(t)
    stream = _in_turns(spark, e.filter(before(_DAY)), e.filter(~before(_DAY) & before(_HALF)), e.filter(before(_HALF) & (F.col("event_id") % 10 == 0)), e.filter(~before(_HALF)))
    out = _streamed(spark, SW.counted(stream, "ts", "1 hour", "3 days"), "late", "append")
    return _ntz(out.select("window_start", "n"), "window_start")


@query("SELECT date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS at, count(*) AS n FROM events GROUP BY 1")
def stream_window_ends(spark, sf_dir):
    """Results carry the last moment of their window."""
    out = _streamed(spark, SW.counted_at_end(_event_stream(spark, sf_dir), "ts", "1 day", "1 hour"), "ends")
    return _ntz(out, "at")


#: Turns 0 to 3: quarters of the events by day of month; 4: late copies of some; 5: a last event far on.
_TURNS = """turns AS (SELECT event_type, event_id, ts, value, least((day(ts) - 1) // 8, 3) AS turn FROM events
UNION ALL SELECT event_type, event_id, ts, value, 4 AS turn FROM events WHERE event_id % 7 = 0 AND ts >= TIMESTAMP '2024-01-21'
UNION ALL SELECT 'end', 0, TIMESTAMP '2024-03-01', 1.0, 5)"""


@query(f"""WITH {_TURNS}, tops AS (SELECT turn, date_trunc('millisecond', max(ts)) AS top FROM turns GROUP BY turn),
latest AS (SELECT turn, max(top) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest, max(top) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS earlier FROM tops),
d AS (SELECT t.*, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, latest, earlier FROM turns t JOIN latest USING (turn) WHERE turn < 5),
r AS (SELECT * FROM d WHERE (latest IS NULL OR window_end > latest - INTERVAL 3 DAY) AND (earlier IS NULL OR ts > earlier - INTERVAL 3 DAY)),
f AS (SELECT event_type, window_end, turn, sum(value) AS part, late FROM (SELECT *, coalesce(latest >= window_end, false) AS late FROM r) GROUP BY event_type, window_end, turn, late),
p AS (SELECT event_type, window_end, turn, part, CASE WHEN late THEN 'LATE' ELSE 'EARLY' END AS timing, CASE WHEN late THEN 2 ELSE 0 END AS o FROM f
UNION ALL SELECT event_type, window_end, max(turn), 0, 'ON_TIME', 1 FROM f WHERE NOT late GROUP BY event_type, window_end)
SELECT event_type AS key, window_end, (row_number() OVER w - 1) AS pane_index, timing, row_number() OVER w = 1 AS is_first, false AS is_last, round(sum(part) OVER w, 4) AS accumulated, round(part, 4) AS discarded
FROM p WINDOW w AS (PARTITION BY event_type, window_end ORDER BY o, turn)""")
def stream_timed_panes(spark, sf_dir):
    """Early panes with each micro-batch, one on time at the window's end, and late ones within three days."""
    e = _events(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("event_id").alias("ord"), "value", "ts")
    turn = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    late = e.filter("ord % 7 = 0 AND ts >= TIMESTAMP '2024-01-21'")
    end = spark.range(1).select(F.lit("end").alias("key"), F.lit(0).cast("long").alias("ord"), F.lit(1.0).alias("value"), F.expr("TIMESTAMP '2024-03-01'").alias("ts"))
    stream = _in_turns(spark, *[e.filter(turn == k) for k in range(4)], late, end)
    out = _streamed(spark, state.window_panes(stream, "ts", "1 day", "3 days"), "timed", "append")
    return rounded(_ntz(out.filter("key <> 'end'"), "window_end"), "accumulated", "discarded")


@query("""WITH r AS (SELECT event_type, value, event_id % 4 AS pane FROM events), p AS (SELECT event_type, pane, sum(value) AS d FROM r GROUP BY ALL)
SELECT event_type AS key, pane AS pane_index, 'EARLY' AS timing, pane = 0 AS is_first, round(sum(d) OVER (PARTITION BY event_type ORDER BY pane), 4) AS accumulated, round(d, 4) AS discarded FROM p""")
def stream_delayed_panes(spark, sf_dir):
    """Panes that fire a set time after their first row: here none, so that each micro-batch is one."""
    e = _events(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("event_id").alias("ord"), "value")
    out = _ticked(spark, state.panes(_in_turns(spark, *[e.filter(f"ord % 4 = {k}") for k in range(4)]), seconds=0.0), "delayed")
    return rounded(out, "accumulated", "discarded")


@query("SELECT user_id::VARCHAR AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS index, event_id AS value FROM events")
def stream_numbered(spark, sf_dir):
    """Rows of a key numbered as they come, with state that would go a day after a key's last row."""
    e = _event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("ord"), F.col("event_id").alias("value"))
    return _ticked(spark, state.numbered(e, ttl_ms=86_400_000), "numbered")


@query("SELECT * FROM (VALUES ('event_id', 'INTEGER'), ('user_id', 'INTEGER'), ('event_type', 'STRING'), ('value', 'STRING')) t(name, type)")
def stream_schema_state(spark, sf_dir):
    """Fields of JSON objects, and their types by their first values, as they are first seen."""
    text = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct("event_id", "user_id"))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct("event_id", "event_type"))).otherwise(F.to_json(F.struct("user_id", "value")))
    stream = _event_stream(spark, sf_dir).select("event_id", text.alias("payload"))
    return _streamed(spark, state.first_types(stream, "payload", "event_id"), "fields", "append")


# control


@query("SELECT count(*) AS n, true AS ended FROM events")
def stream_then_act(spark, sf_dir):
    """What follows a stream is done once it has ended."""
    path = scratch(spark, "first")
    started = _event_stream(spark, sf_dir).select("event_id").writeStream.trigger(availableNow=True).option("checkpointLocation", scratch(spark, "acted")).foreachBatch(lambda df, _: run.appended(path)(df)).start()
    n = run.wait_then(started, lambda: spark.read.parquet(path).count())
    return spark.createDataFrame([(n, not started.isActive)], "n long, ended boolean")


@query("SELECT true AS listed, true AS stopped, false AS again, true AS labelled")
def job_control(spark, sf_dir):
    """A job is found by its name, stopped once, and batch work carries a label."""
    name = X.__name__ + "-beats"
    streams.heartbeat(spark, 1).writeStream.format("noop").option("checkpointLocation", scratch(spark, "control")).queryName(name).start()
    try:
        listed = name in run.active(spark)
        with run.labelled(spark, "nightly"):
            labelled = "nightly" in spark.sparkContext.getJobTags()
    finally:
        stopped = run.stop(spark, name)
    return spark.createDataFrame([(listed, stopped, run.stop(spark, name), labelled and "nightly" not in spark.sparkContext.getJobTags())], "listed boolean, stopped boolean, again boolean, labelled boolean")
