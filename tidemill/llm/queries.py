"""The registered queries of this subpackage: each applies one operator to its whole table, as its contract says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import langid, licenses, mixing, quality
from tidemill.llm.decontaminate import decontaminate
from tidemill.llm.exact_dedup import exact_duplicates
from tidemill.llm.html_extract import extract_main_text
from tidemill.llm.licenses import scan_licenses
from tidemill.llm.near_dedup import near_duplicates
from tidemill.llm.substrings import remove_repeats
from tidemill.llm.tokens import token_files_of

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op1_near_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * m >= 75 * (x.n + y.n - m)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON d.doc_id = c.a
"""

ORACLES["op5_decontaminate"] = rf"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
k AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS g FROM d, (SELECT DISTINCT size FROM k) z WHERE len(w) >= size),
h AS MATERIALIZED (SELECT doc_id, item_id, i, size FROM g JOIN k USING (size, g)),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLES["op6_substring_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM d)),
m AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
h AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL AS new FROM s JOIN m USING (g)),
v AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT *, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM h) GROUP BY doc_id, k),
q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM v),
k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS left_ FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_, x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

_TEMPLATES = ", ".join(f"({i}, '{label}', {base}, {text.split(' ')})" for base, group in ((True, licenses.BASE), (False, licenses.PASSAGES)) for i, (text, label) in enumerate(group.items()))

ORACLES["op4_license_scan"] = rf"""
WITH t(template, label, is_base, w) AS (VALUES {_TEMPLATES}),
k AS (SELECT template, label, is_base, len(w) AS size, unnest(range(0, len(w) - 2)) AS tp, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM t),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(w) - 2)) AS pos, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM d WHERE len(w) > 2),
v AS MATERIALIZED (SELECT doc_id, template, label, is_base, size, tp, pos, pos - tp AS dia FROM p JOIN k USING (g)),
b AS (SELECT doc_id, label, true AS is_base, dia AS first, 1.0::DOUBLE AS share FROM v WHERE is_base GROUP BY doc_id, template, label, size, dia HAVING count(*) = any_value(size) - 2),
l AS (SELECT *, coalesce((dia - lag(dia) OVER (PARTITION BY doc_id, template ORDER BY dia) > {licenses.NEAR})::INTEGER, 0) AS new FROM (SELECT doc_id, template, label, size, dia, list(tp) AS tps, min(pos) AS lo, max(pos) AS hi FROM v WHERE NOT is_base GROUP BY ALL)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY dia) AS run FROM l),
c AS (SELECT doc_id, label, false AS is_base, min(lo) AS first, len(list_distinct(flatten(list(tps))))::DOUBLE / (any_value(size) - 2) AS share, max(hi) + 3 - min(lo) AS span, any_value(size) AS size FROM r GROUP BY doc_id, template, label, run),
y AS MATERIALIZED (SELECT *, first + span AS stop FROM c WHERE share >= {licenses.LEAST_SHARE} AND span <= {licenses.STRETCH} * size),
f AS (SELECT * FROM b UNION ALL SELECT doc_id, label, is_base, first, share FROM y WHERE NOT EXISTS (SELECT 1 FROM y z WHERE z.doc_id = y.doc_id AND z.label <> y.label AND z.share > y.share AND z.first < y.stop AND y.first < z.stop)),
o AS (SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(first) FILTER (is_base) AS first_word, max(first) FILTER (is_base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN o USING (doc_id)
"""


@query
def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs), spans=False)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files_of(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


ORACLES["op3_exact_dedup"] = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM n WINDOW same AS (PARTITION BY t)
"""


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("places")


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), kept=False)


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


ORACLES["op7_mix_sources"] = mixing.mixing_sql()
