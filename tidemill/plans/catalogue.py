"""The registered queries over the driver's tables, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import aggregates as A
from tidemill.operators import joins as J
from tidemill.operators import quality as Q
from tidemill.operators import shape as S
from tidemill.operators import windows as W
from tidemill.scratch import scratch
from tidemill.session import SETTINGS
from tidemill.sinks import files as K
from tidemill.sinks import tables as TB
from tidemill.sources import files as SRC
from tidemill.streaming import run, state
from tidemill.streaming import windows as SW

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL of its rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# exploding, keys, filters


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w")
def tag_explode_counts(spark, sf_dir):
    return A.count_per_key(S.explode_into(table(spark, sf_dir, "part"), X.split_words("p_name"), "word"), "word")


@query("SELECT t AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS t FROM pages) GROUP BY t")
def regex_unnest(spark, sf_dir):
    views(spark, sf_dir, "pages")
    return spark.sql("SELECT tag, count(*) AS n FROM pages LATERAL VIEW explode(regexp_extract_all(html, '<([a-z0-9]+)', 1)) t AS tag GROUP BY tag")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY event_type")
def count_per_tag(spark, sf_dir):
    watched = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "purchase"))
    return A.count_per_key(watched, "event_type")


@query("SELECT p_partkey, p_name FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'blue', 'large', 'widget'])")
def watchlist_any(spark, sf_dir):
    return S.any_of(table(spark, sf_dir, "part"), X.split_words("p_name"), ["red", "blue", "large", "widget"]).select("p_partkey", "p_name")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR n_nationkey IN (1, 2, 3) AND char_length(n_name) > 3")
def sql_filter(spark, sf_dir):
    views(spark, sf_dir, "nation", "region")
    return spark.sql("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR n_nationkey IN (1, 2, 3) AND char_length(n_name) > 3")


@query("SELECT event_type, round(sum(value), 4) AS sum_value FROM events GROUP BY event_type")
def sql_group_sum(spark, sf_dir):
    views(spark, sf_dir, "events")
    return spark.sql("SELECT event_type, round(sum(value), 4) AS sum_value FROM events GROUP BY event_type")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 70")
def hot_tags_having(spark, sf_dir):
    views(spark, sf_dir, "events")
    return spark.sql("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 70")


@query("SELECT text AS sentence, len(string_split(text, ' '))::BIGINT AS n FROM conversations WHERE length(text) >= 40")
def filter_length(spark, sf_dir):
    return S.at_least(table(spark, sf_dir, "conversations"), "text", 40).select(F.col("text").alias("sentence"), X.word_count("text").alias("n"))


@query("SELECT n_nationkey, n_nationkey + 1 AS plus_one, n_nationkey + 2 AS plus_two FROM nation")
def map_vs_pardo(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") + 1).alias("plus_one"), (F.col("n_nationkey") + 2).alias("plus_two"))


@query("SELECT conv_id, turn, split_part(text, ' ', 1) AS first, split_part(text, ' ', -1) AS last FROM conversations")
def key_first_last_word(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.first_word("text").alias("first"), X.last_word("text").alias("last"))


@query("SELECT conv_id, turn, len(string_split(text, ' '))::BIGINT AS words FROM conversations")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.word_count("text").alias("words"))


@query("SELECT s_suppkey, w AS item FROM (SELECT s_suppkey, unnest(string_split(s_name || '~|~' || s_nationkey || '~|~~|~x~|~', '~|~')) AS w FROM supplier) WHERE w <> ''")
def custom_delimiter(spark, sf_dir):
    line = F.concat_ws("~|~", "s_name", F.col("s_nationkey").cast("string"), F.lit(""), F.lit("x"), F.lit(""))
    return S.explode_delimited(table(spark, sf_dir, "supplier").select("s_suppkey", line.alias("line")), "line", "~|~", "item").select("s_suppkey", "item")


@query("SELECT s_suppkey, '\"' || s_name || ', Ltd\"' AS name, s_nationkey::VARCHAR AS nation, s_name || ', Ltd' AS plain FROM supplier")
def quoted_csv_split(spark, sf_dir):
    line = F.concat(F.lit('"'), F.col("s_name"), F.lit(', Ltd",'), F.col("s_nationkey").cast("string"))
    parts = table(spark, sf_dir, "supplier").select("s_suppkey", X.split_quoted(line).alias("f"))
    return parts.select("s_suppkey", *X.fields_or_null(F.col("f"), ["name", "nation"])).withColumn("plain", X.unquote("name"))


@query("SELECT '\"' || s_suppkey || '\", \"' || s_name || '\", \"' || s_nationkey || '\"' AS line FROM supplier")
def csv_format(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(X.csv_line("s_suppkey", "s_name", "s_nationkey").alias("line"))


@query("SELECT item_id, sha256(text) AS digest FROM benchmark")
def sha256_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.sha256_text("text").alias("digest"))


@query("SELECT o_orderkey, date_trunc('hour', o_orderdate) AS at FROM orders")
def timestamps_in_path(spark, sf_dir):
    path = F.concat(F.lit("/in/"), F.date_format("o_orderdate", "yyyy/MM/dd/HH"), F.lit("/file"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.timestamp_from_path(path).alias("at"))


@query("SELECT r_regionkey, 'key' AS k1, r_regionkey::VARCHAR AS v1, 'name' AS k2, r_name AS v2 FROM region")
def schema_zip(spark, sf_dir):
    zipped = table(spark, sf_dir, "region").select("r_regionkey", F.map_entries(X.zip_names(["key", "name"], F.array(F.col("r_regionkey").cast("string"), F.col("r_name")))).alias("m"))
    return zipped.select("r_regionkey", F.col("m")[0]["key"].alias("k1"), F.col("m")[0]["value"].alias("v1"), F.col("m")[1]["key"].alias("k2"), F.col("m")[1]["value"].alias("v2"))


@query("SELECT event_id, v AS number FROM (SELECT event_id, unnest([event_id % 7, user_id, (props->>'k')::BIGINT])::INTEGER AS v FROM events)")
def json_array_explode(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit("["), F.concat_ws(", ", (F.col("event_id") % 7).cast("string"), F.col("user_id").cast("string"), k), F.lit("]"))
    return S.explode_numbers(table(spark, sf_dir, "events").select("event_id", text.alias("a")), "a", "number").select("event_id", "number")


@query("SELECT conv_id, turn, role, length(text)::BIGINT AS n FROM conversations")
def json_entity(spark, sf_dir):
    """Conversations as nested JSON entities, and their fields read back."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    wrapped = F.transform("turns", lambda t: F.struct(F.struct(t.turn.alias("integerValue")).alias("turn"), F.struct(t.role.alias("stringValue")).alias("role"), F.struct(t.text.alias("stringValue")).alias("text")))
    entity = turns.select(F.to_json(F.struct(F.struct(F.col("conv_id").alias("id")).alias("key"), F.struct(wrapped.alias("turns")).alias("properties"))).alias("entity"))
    value = "struct<turn:struct<integerValue:bigint>,role:struct<stringValue:string>,text:struct<stringValue:string>>"
    read = entity.select(F.from_json("entity", f"struct<key:struct<id:bigint>,properties:struct<turns:array<{value}>>>").alias("e")).select(F.col("e.key.id").alias("conv_id"), F.explode("e.properties.turns").alias("t"))
    return read.select("conv_id", F.col("t.turn.integerValue").alias("turn"), F.col("t.role.stringValue").alias("role"), F.length("t.text.stringValue").cast("long").alias("n"))


# grouping


@query("SELECT user_id, list(event_id ORDER BY event_id)::VARCHAR AS ids FROM events GROUP BY user_id")
def group_collect(spark, sf_dir):
    groups = A.group_collect(table(spark, sf_dir, "events"), ["user_id"], F.col("event_id"), "ids")
    return groups.select("user_id", F.concat(F.lit("["), F.array_join("ids", ", "), F.lit("]")).alias("ids"))


@query("SELECT user_id, string_agg(event_type, ';' ORDER BY event_type) AS types FROM events GROUP BY user_id")
def group_concat(spark, sf_dir):
    return A.group_concat(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type"), ";", "types")


_STATISTICS = """SELECT p_brand, count(*) AS n, round(count(*) FILTER (l_returnflag = 'R') / count(*)::DOUBLE, 4) AS accepted_ratio,
round(sum(coalesce(l_quantity, 0)) / count(*), 4) AS avg_quantity, round(sum(coalesce(l_extendedprice, 0)) / count(*), 4) AS avg_price, round(sum(coalesce(l_discount, 0)) / count(*), 4) AS avg_discount
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"""


def _measures():
    return {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice"), "discount": F.col("l_discount")}


def _lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_orderkey", "l_linenumber")
    return lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")


@query(_STATISTICS)
def tag_statistics(spark, sf_dir):
    out = A.statistics(_lines(spark, sf_dir), ["p_brand"], F.col("l_returnflag") == "R", _measures())
    return rounded(out, "accepted_ratio", "avg_quantity", "avg_price", "avg_discount")


@query(_STATISTICS)
def salted_agg(spark, sf_dir):
    out = A.salted_statistics(_lines(spark, sf_dir), ["p_brand"], F.col("l_returnflag") == "R", _measures(), F.lit(10))
    return rounded(out, "accepted_ratio", "avg_quantity", "avg_price", "avg_discount")


@query("""WITH hot AS (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(*) > 620)
SELECT l.l_suppkey, h.l_suppkey IS NOT NULL AS is_hot, count(*) AS n, round(count(*) FILTER (l_returnflag = 'R') / count(*)::DOUBLE, 4) AS accepted_ratio, round(sum(coalesce(l_quantity, 0)) / count(*), 4) AS avg_quantity
FROM lineitem l LEFT JOIN hot h ON l.l_suppkey = h.l_suppkey GROUP BY ALL""")
def dynamic_hot_mark(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", "l_orderkey", "l_linenumber")
    marked = A.mark_hot(lines, A.hot_keys(lines, "l_suppkey", 620), "l_suppkey")
    out = A.salted_statistics(marked, ["l_suppkey", "is_hot"], F.col("l_returnflag") == "R", {"quantity": F.col("l_quantity")}, F.when(F.col("is_hot"), 10).otherwise(1))
    return rounded(out, "accepted_ratio", "avg_quantity")


@query("SELECT array_to_string(list_sort(string_split(p_name, ' ')), '|') AS tags, count(*) AS n FROM part GROUP BY 1")
def combined_tags(spark, sf_dir):
    return A.count_per_key(table(spark, sf_dir, "part").withColumn("tags", X.combined_tags(X.split_words("p_name"))), "tags")


@query("""SELECT o_orderpriority || '|' || o_orderstatus || '|' || CASE WHEN o_totalprice > 400000 THEN 'HOT' WHEN o_totalprice > 200000 THEN 'HIGH' WHEN o_totalprice > 50000 THEN 'MEDIUM' ELSE 'LOW' END AS key, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def hierarchical_keys(spark, sf_dir):
    size = X.bucket("o_totalprice", [(400000, "HOT"), (200000, "HIGH"), (50000, "MEDIUM")], "LOW")
    key = F.concat_ws("|", "o_orderpriority", "o_orderstatus", size)
    return table(spark, sf_dir, "orders").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT count(*) AS n, round(sum(value), 4) AS total, max(length(event_type))::BIGINT AS longest FROM events HAVING count(*) > 0")
def global_sum(spark, sf_dir):
    return A.globally(table(spark, sf_dir, "events"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max(F.length("event_type")).cast("long").alias("longest"))


# top-k


@query("SELECT c_nationkey, c_custkey, c_acctbal, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rank FROM customer) WHERE rank <= 3")
def top_n_per_key(spark, sf_dir):
    return A.top_per_key(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], 3, F.desc("c_acctbal"), F.asc("c_custkey"))


@query("SELECT c_nationkey, c_custkey, c_acctbal, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)::INTEGER AS rank FROM customer) WHERE rank <= 2")
def smallest_per_key(spark, sf_dir):
    return A.top_per_key(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], 2, F.asc("c_acctbal"), F.asc("c_custkey"))


@query("SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def top10_scores(spark, sf_dir):
    return A.top(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), 10, F.desc("value"), F.asc("event_id"))


@query("SELECT user_id, arg_max(value, event_id) AS score FROM events GROUP BY user_id ORDER BY score DESC, user_id LIMIT 10")
def top10_distinct(spark, sf_dir):
    return A.top_distinct(table(spark, sf_dir, "events"), "user_id", F.col("value"), F.col("event_id"))


@query("SELECT conv_id, turn, len(string_split(text, ' '))::BIGINT AS words FROM conversations ORDER BY words DESC, conv_id, turn LIMIT 1")
def longest_row(spark, sf_dir):
    return A.top(table(spark, sf_dir, "conversations").select("conv_id", "turn", X.word_count("text").alias("words")), 1, F.desc("words"), F.asc("conv_id"), F.asc("turn"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def sql_order_limit(spark, sf_dir):
    views(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")


# joins


_RANGES = """WITH s(id, ord, start, stop) AS (SELECT 's' || i, i, TIMESTAMP '2024-01-01' + i * INTERVAL 1 DAY, TIMESTAMP '2024-01-02' + i * INTERVAL 1 DAY FROM range(0, 20) t(i))
SELECT id, count(*) AS n, min(event_id) AS first_event FROM (SELECT e.event_id, s.id, row_number() OVER (PARTITION BY event_id ORDER BY ord) AS r FROM events e JOIN s ON e.ts BETWEEN start AND stop) WHERE r = 1 GROUP BY id"""


def _assigned(spark, sf_dir):
    begin = F.lit("2024-01-01").cast("timestamp_ntz")
    shift = lambda k: begin + F.make_dt_interval((F.col("id") + k).cast("int"))
    ranges = spark.range(20).select(F.concat(F.lit("s"), F.col("id")).alias("session"), F.col("id").alias("ord"), shift(0).alias("start"), shift(1).alias("stop"))
    return ranges, table(spark, sf_dir, "events").select("event_id", "ts")


def _per_range(found):
    return found.groupBy(F.col("session").alias("id")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(_RANGES)
def assign_sessions(spark, sf_dir):
    ranges, events = _assigned(spark, sf_dir)
    return _per_range(J.assign_ranges(events, ranges, "ts", "start", "stop", "ord", ["event_id"]))


@query(_RANGES)
def assign_sessions_binned(spark, sf_dir):
    """As assign_sessions, for more ranges than are compared one by one, or can be broadcast: both sides meet in bins."""
    ranges, events = _assigned(spark, sf_dir)
    return _per_range(J.assign_ranges(events, ranges, "ts", "start", "stop", "ord", ["event_id"], few=0, max_rows=0))


_GLOBS = [("https://*", "secure"), ("*.example.org/*", "org"), ("*/en/*", "english"), ("http://?.*", "one letter host"), ("*#top", "top")]


@query("WITH g(pattern, tag) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _GLOBS) + ") SELECT page_id, tag FROM pages JOIN g ON regexp_full_match(url, replace(replace(replace(pattern, '.', '\\.'), '*', '.*'), '?', '.'))")
def regex_tag_join(spark, sf_dir):
    globs = spark.createDataFrame(_GLOBS, "pattern string, tag string")
    return J.tag_by_pattern(table(spark, sf_dir, "pages").select("page_id", "url"), globs, "url", "pattern").select("page_id", "tag")


@query("WITH g(pattern) AS (VALUES " + ", ".join(f"('{a}')" for a, _ in _GLOBS) + ") SELECT pattern, '^' || replace(replace(replace(pattern, '.', '\\.'), '*', '.*'), '?', '.') || '$' AS regex FROM g")
def glob_to_regex(spark, sf_dir):
    return spark.createDataFrame([(a,) for a, _ in _GLOBS], "pattern string").select("pattern", X.glob_to_regex("pattern").alias("regex"))


@query("SELECT d.doc_id, coalesce(l.toxic::VARCHAR, '') AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def enrich_lookup(spark, sf_dir):
    dim = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("toxic"))
    return J.lookup(table(spark, sf_dir, "documents").select("doc_id"), dim, "doc_id", {"toxic": ""})


@query("""WITH f AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), t AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(f.c_custkey, t.c_custkey) AS c_custkey, coalesce(t.c_acctbal, f.c_acctbal) AS c_acctbal FROM f FULL JOIN t ON f.c_custkey = t.c_custkey""")
def upsert_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return J.upsert(c.filter("c_custkey % 3 <> 0"), c.filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("SELECT c_custkey, c_mktsegment, round((c_acctbal - min(c_acctbal) OVER s) / nullif(max(c_acctbal) OVER s - min(c_acctbal) OVER s, 0), 4) AS normalized FROM customer WINDOW s AS (PARTITION BY c_mktsegment)")
def normalize_minmax(spark, sf_dir):
    out = A.normalize(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", "c_acctbal")
    return rounded(out, "normalized").select("c_custkey", "c_mktsegment", "normalized")


@query("SELECT a.r - 1 AS index, a.n_name AS by_name, b.n_name AS by_region FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS r FROM nation) a JOIN (SELECT n_name, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS r FROM nation) b USING (r)")
def zip_by_index(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return J.zip_tables(n.select(F.col("n_name").alias("by_name")), n.select(F.col("n_name").alias("by_region"), "n_regionkey", "n_nationkey"), [F.asc("by_name")], [F.asc("n_regionkey"), F.asc("n_nationkey")]).select("index", "by_name", "by_region")


@query("""SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS clicks, coalesce(b.n, 0) AS errors FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND value > 300 GROUP BY 1) b ON a.user_id = b.user_id""")
def cogroup_sizes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return J.cogroup_counts(e.filter("event_type = 'click'"), e.filter("event_type = 'error' AND value > 300"), ["user_id"]).select("user_id", F.col("left_n").alias("clicks"), F.col("right_n").alias("errors"))


# event time


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL")
def calendar_day_groups(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", W.day("ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    return W.window_counts(table(spark, sf_dir, "events"), "ts", "1 hour")


_SLIDING = "SELECT s AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE for k in [0, 1, 2, 3]]) AS s FROM events) GROUP BY s"


@query(f"SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, n FROM ({_SLIDING})")
def sliding_counts(spark, sf_dir):
    return W.window_counts(table(spark, sf_dir, "events"), "ts", "1 hour", "15 minutes")


@query(f"WITH c AS ({_SLIDING}) SELECT s.window_start, coalesce(c.n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(window_start) FROM c), (SELECT max(window_start) FROM c), INTERVAL 15 MINUTE)) AS window_start) s LEFT JOIN c USING (window_start)")
def empty_windows_sliding(spark, sf_dir):
    return W.with_empty_windows(W.window_counts(table(spark, sf_dir, "events"), "ts", "1 hour", "15 minutes"), "15 MINUTES")


@query("""WITH f AS (SELECT user_id, date_trunc('day', ts) AS d, arg_min(value, (ts, value)) AS v FROM events GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.d, b.d + INTERVAL 1 DAY) AS window_start, round(coalesce(a.v, 0), 4) AS new, round(coalesce(b.v, 0), 4) AS old, round(coalesce(a.v, 0) - coalesce(b.v, 0), 4) AS diff FROM f a FULL JOIN f b ON a.user_id = b.user_id AND a.d = b.d + INTERVAL 1 DAY""")
def lag_window_diff(spark, sf_dir):
    return rounded(W.lag_differences(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", "1 day"), "new", "old", "diff")


def _islands(gap: str) -> str:
    return f"""WITH e AS (SELECT user_id, event_type, ts, value, ts + {gap} AS e FROM events), o AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY ts, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
s AS (SELECT *, sum(CASE WHEN reach IS NULL OR ts >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, e ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS session_start, max(e) AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k"""


@query(_islands("INTERVAL 6 HOUR"))
def session_stats(spark, sf_dir):
    return W.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 6 * 3600, F.round(F.sum("value"), 4).alias("total"))


@query(_islands("INTERVAL 6 HOUR"))
def session_stats_by_stretch(spark, sf_dir):
    """As session_stats, for keys too large for one task."""
    return W.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 6 * 3600, F.round(F.sum("value"), 4).alias("total"), bucket="1 day")


@query(_islands("to_seconds(CASE WHEN event_type = 'view' THEN 3600 ELSE ((props->>'k')::INTEGER + 1) * 360 END)"))
def dynamic_sessions(spark, sf_dir):
    own = F.when(F.col("event_type") != "view", ((F.get_json_object("props", "$.k").cast("int") + 1) * 360).cast("string"))
    return W.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", W.gap_or(own, 3600), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT date_trunc('hour', CASE WHEN event_type = 'error' THEN ts - INTERVAL 2 MINUTE ELSE ts END) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def late_timestamps(spark, sf_dir):
    moved = table(spark, sf_dir, "events").withColumn("ts", W.late_time("ts", F.col("event_type") == "error", "2 MINUTES"))
    return W.window_counts(moved, "ts", "1 hour", None, ["event_type"]).select("window_start", "event_type", "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, s + INTERVAL 59 MINUTE + INTERVAL 59 SECOND) AS window_start, sum(n)::BIGINT AS n FROM (SELECT window_start AS s, n FROM (" + _SLIDING + ")) GROUP BY 1")
def rewindow(spark, sf_dir):
    counts = W.window_counts(table(spark, sf_dir, "events"), "ts", "1 hour", "15 minutes").select(F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end")).alias("window"), "n")
    return W.rewindowed(counts, "window", "1 hour").groupBy(F.col("window.start").alias("window_start")).agg(F.sum("n").alias("n"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events), p AS (SELECT event_type, (r - 1) // 50 AS pane_index, sum(value) AS d FROM r GROUP BY ALL HAVING count(*) = 50)
SELECT event_type, pane_index, round(d, 4) AS discarded, round(sum(d) OVER (PARTITION BY event_type ORDER BY pane_index), 4) AS accumulated FROM p""")
def aftercount_panes(spark, sf_dir):
    return rounded(W.count_panes(table(spark, sf_dir, "events"), ["event_type"], [F.asc("event_id")], 50, F.col("value"), spread=True), "discarded", "accumulated").select("event_type", "pane_index", "discarded", "accumulated")


@query("SELECT event_type, event_id, pane_index FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pane_index FROM events) WHERE pane_index < 6 OR pane_index % 6 = 0")
def adaptive_pane_filter(spark, sf_dir):
    return S.thinned(J.numbered(table(spark, sf_dir, "events").select("event_type", "event_id"), F.asc("event_id"), keys=["event_type"], name="pane_index", spread=True), "pane_index")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT o_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (o_orderstatus <> 'P'), '') AS items FROM r WHERE r <= 4 GROUP BY o_custkey HAVING count(*) = 4""")
def count_to_n_flush(spark, sf_dir):
    flushed = W.flush_after(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey", 4, F.col("o_orderstatus") == "P", "o_orderkey")
    return flushed.select("o_custkey", F.array_join("items", ",").alias("items"))


@query("SELECT o_custkey, max(o_orderkey) FILTER (r % 2 = 1) AS first, max(o_orderkey) FILTER (r % 2 = 0) AS second FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY o_custkey, (r - 1) // 2 HAVING count(*) = 2")
def pair_consecutive(spark, sf_dir):
    return W.pairs(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", "o_orderkey")


# quality and routing


@query("SELECT doc_id, contains(text, 'the') AS ok FROM documents")
def side_outputs_flatten(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = S.outputs(S.tagged(docs, ("ok", F.col("text").contains("the")), otherwise="not_ok"), "ok", "not_ok")
    return S.flatten(*[part.select("doc_id", F.lit(tag == "ok").alias("ok")) for tag, part in parts.items()])


@query("SELECT e.event_id, coalesce(try_cast(CASE WHEN event_id % 5 = 0 THEN 'this is a bad row' ELSE props->>'k' END AS BIGINT), -1) AS k, event_id % 5 = 0 AS is_bad FROM events e")
def dead_letter_split(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 5 == 0, "this is a bad row").otherwise(F.get_json_object("props", "$.k")).alias("k"))
    good, bad = Q.split_bad(Q.typed(raw, Q.schema_from_text("event_id:INTEGER,k:INTEGER")))
    return S.flatten(good.withColumn("is_bad", F.lit(False)), bad.select(F.col("event_id").cast("long").alias("event_id"), F.lit(-1).cast("long").alias("k"), F.lit(True).alias("is_bad")))


@query("SELECT * FROM (VALUES ('event_id', 'INTEGER'), ('user_id', 'INTEGER'), ('event_type', 'STRING'), ('value', 'STRING')) t(name, type)")
def schema_autodetect(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    text = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct("event_id", "user_id"))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct("event_id", "event_type"))).otherwise(F.to_json(F.struct("user_id", "value")))
    return Q.inferred_fields(e.select("event_id", text.alias("payload")), "payload", "event_id")


# sources and sinks, there and back


@query("SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    K.write_csv(table(spark, sf_dir, "supplier").withColumn("s_acctbal", F.round("s_acctbal", 2)), path, shards=None)
    return spark.read.option("header", True).schema("s_suppkey long, s_name string, s_nationkey int, s_acctbal double").csv(path)


@query("SELECT o_orderstatus AS status, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def files_by_key(spark, sf_dir):
    path = scratch(spark, "by-key")
    K.write_by_key(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey"), path, "o_orderstatus", F.col("o_orderkey").cast("string"), spread=4)
    read = spark.read.text(path)
    return read.groupBy(F.col("o_orderstatus").cast("string").alias("status")).agg(F.count("*").alias("n"), F.min(F.col("value").cast("long")).alias("first"))


@query("SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1")
def files_by_window(spark, sf_dir):
    path = scratch(spark, "by-window")
    K.write_by_window(W.windowed(table(spark, sf_dir, "events").select("ts", "event_id"), "ts", "1 day"), path, "window", F.col("event_id").cast("string"))
    day = F.to_timestamp_ntz(F.substring_index(F.col("window_label"), "_", 1), F.lit("yyyy-MM-dd'T'HH-mm-ss"))
    return spark.read.text(path).groupBy(day.alias("day")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS destination, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def routed_tables(spark, sf_dir):
    root = scratch(spark, "routed")
    TB.route(table(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_type"), root)
    return spark.read.parquet(root).groupBy(F.col("destination").cast("string").alias("destination")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("SELECT event_id % 4 = 0 AS bad, count(*) AS n FROM events GROUP BY 1")
def typed_table_errors(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 4 == 0, "no number").otherwise(F.col("event_id").cast("string")).alias("event_id"), "event_type")
    good, bad = TB.write_typed(raw, Q.schema_from_text("event_id:INTEGER,event_type:STRING"), scratch(spark, "typed"))
    count = lambda path, is_bad: spark.read.parquet(path).agg(F.lit(is_bad).alias("bad"), F.count("*").alias("n"))
    return S.flatten(count(good, False), count(bad, True))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def merged_table(spark, sf_dir):
    path, c = scratch(spark, "merged"), table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    TB.merge_table(spark, path, c.filter("c_custkey % 3 <> 0"), ["c_custkey"])
    changes = c.filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    TB.merge_table(spark, path, changes.unionByName(c.filter("c_custkey % 2 = 1 AND c_custkey % 3 = 0")), ["c_custkey"])
    return spark.read.parquet(path)


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def whole_file_per_key(spark, sf_dir):
    path = scratch(spark, "whole")
    K.write_by_key(table(spark, sf_dir, "nation"), path, "n_regionkey", F.col("n_name"))
    read = SRC.whole_files(spark, f"{path}/*/part-*")
    key = F.regexp_extract("path", "n_regionkey=(\\d+)/", 1).cast("int")
    return read.select(key.alias("n_regionkey"), F.array_join(F.array_sort(X.split_words("value", "\n")), ";").alias("names"))


# streams, run over what there is


def _event_stream(spark, sf_dir):
    """The events as a folder of files that appear to a stream."""
    events, path = table(spark, sf_dir, "events"), scratch(spark, "appearing")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _streamed(spark, stream, name, mode="complete"):
    """What a stream gives: its last complete result, or all appended rows."""
    for k, v in SETTINGS.items():
        if k.startswith("spark.sql.streaming."):
            spark.conf.set(k, v)
    path = scratch(spark, name)
    write = (lambda df: df.write.mode("overwrite").parquet(path)) if mode == "complete" else run.appended(path)
    run.available(stream, write, scratch(spark, f"{name}-checkpoint"), mode)
    return spark.read.parquet(path)


@query("SELECT event_type, date_trunc('day', ts) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def stream_day_counts(spark, sf_dir):
    out = _streamed(spark, SW.counted(_event_stream(spark, sf_dir), "ts", "1 day", "1 hour", keys=["event_type"]), "day-counts")
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query(_islands("INTERVAL 6 HOUR"))
def stream_sessions(spark, sf_dir):
    out = _streamed(spark, SW.sessions(_event_stream(spark, sf_dir), ["user_id"], "ts", 6 * 3600, "1 hour", F.round(F.sum("value"), 4).alias("total")), "sessions")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query(ORACLES["lag_window_diff"])
def stream_lag_diff(spark, sf_dir):
    out = _streamed(spark, SW.lag_differences(_event_stream(spark, sf_dir), ["user_id"], "ts", "value", "1 day", "1 hour"), "lag")
    return rounded(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), "new", "old", "diff")


@query("SELECT user_id::VARCHAR AS key, max(event_id) FILTER (r % 2 = 1) AS first, max(event_id) FILTER (r % 2 = 0) AS second FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) GROUP BY user_id, (r - 1) // 2 HAVING count(*) = 2")
def stream_pairs(spark, sf_dir):
    keyed = _event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("ord"), F.col("event_id").alias("value"))
    return _streamed(spark, state.pairs(keyed), "pairs", "append")


@query("SELECT user_id::VARCHAR AS key, '[' || string_agg(event_id::VARCHAR, ', ' ORDER BY event_id) FILTER (event_type <> 'error') || ']' AS items FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 20 GROUP BY user_id HAVING count(*) = 20")
def stream_flush_after(spark, sf_dir):
    keyed = _event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("ord"), F.col("event_id").alias("value"), (F.col("event_type") == "error").alias("is_error"))
    return _streamed(spark, state.flush_after(keyed, 20), "flushed", "append")


@query("SELECT event_type AS key, pane_index, 'EARLY' AS timing, pane_index = 0 AS is_first, accumulated, discarded FROM (" + ORACLES["aftercount_panes"] + ")")
def stream_count_panes(spark, sf_dir):
    keyed = _event_stream(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("event_id").alias("ord"), "value")
    return rounded(_streamed(spark, state.panes(keyed, every=50), "panes", "append"), "accumulated", "discarded")
