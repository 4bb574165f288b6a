"""Topics of documents, learned and assigned: clusters of hashed word counts.

A document's profile is the share of its words in each of 16 buckets, by a hash of the lower-cased word, less the mean of
its language, so that topics aren't languages. Four clusters begin with the signs of two fixed projections and are moved
to their members' mean a set number of times (Lloyd's rounds), over all documents; a document's topic is the nearest
cluster. Profiles are made in numpy, everything after them is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import bytewise as bw

BUCKETS, TOPICS, ROUNDS = 16, 4, 5
NO_TOPIC = "none"
#: The hash of a word's bytes b: the sum of (b + 1) * BASE**place, modulo 2**32; its bucket is by the upper bits of a multiple.
BASE, MULTIPLE = 31, 2654435761
#: Signs of the two projections that clusters begin with.
FIRST = [1.0 if i < BUCKETS // 2 else -1.0 for i in range(BUCKETS)]
SECOND = [1.0 if i % 2 == 0 else -1.0 for i in range(BUCKETS)]


def _powers(n: int, base: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def profiles_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, shares of its words by bucket)."""
    counts, shares = [], []
    for s in bw.slices(texts):
        w = bw.words(s, bw.NOT_SPACE, hashes=False)
        n = len(s.data)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((bw.LOWER[s.data].astype(np.uint64) + np.uint64(1)) * _powers(n, BASE), out=prefix[1:])
        h = (prefix[w.end] - prefix[w.start]) * _powers(n + 1, pow(BASE, -1, 2**64))[w.start]
        bucket = ((h & np.uint64(2**32 - 1)) * np.uint64(MULTIPLE) & np.uint64(2**32 - 1)) >> np.uint64(28)
        size = np.diff(w.first)
        found = np.bincount(w.row * BUCKETS + bucket.astype(np.int64), minlength=s.rows * BUCKETS).reshape(s.rows, BUCKETS)
        counts.append(size)
        shares.append(found / np.maximum(size, 1)[:, None])
    return (np.concatenate(counts), np.concatenate(shares)) if counts else (np.zeros(0, np.int64), np.zeros((0, BUCKETS)))


def profiled(rows: DataFrame, text: str) -> DataFrame:
    """rows with n_tokens and profile in place of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            count, share = profiles_of(b.column(at))
            rest = [i for i in range(b.num_columns) if i != at]
            profile = bw.list_array(share.ravel(), np.full(b.num_rows, BUCKETS), pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in rest], pa.array(count, pa.int64()), profile], [*[b.schema.names[i] for i in rest], "n_tokens", "profile"])

    kept = [f for f in rows.schema.fields if f.name != text]
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("profile", T.ArrayType(T.DoubleType()))]))


def means_of(rows: DataFrame, lang: str) -> DataFrame:
    """lang, mean: the mean profile of each language's documents that have words."""
    return rows.filter("n_tokens > 0").groupBy(lang).agg(F.array(*[F.avg(F.col("profile")[i]) for i in range(BUCKETS)]).alias("mean"))


def _centred(b: pa.RecordBatch) -> np.ndarray:
    """Profiles less their language's mean; a row's own without one."""
    profile, mean = (b.column(c) for c in ("profile", "mean"))
    own = profile.flatten().to_numpy().reshape(-1, BUCKETS)
    out, known = own.copy(), np.flatnonzero(mean.is_valid().to_numpy(zero_copy_only=False))
    out[known] -= mean.flatten().to_numpy().reshape(-1, BUCKETS)  # null ones have no numbers
    return out


def _cluster(x: np.ndarray, centres: dict[int, list[float]] | None) -> np.ndarray:
    """The number of each row's nearest cluster, the first of equally near ones; by the projections' signs without centres."""
    if centres is None:
        return (x @ np.array(FIRST) > 0) * 2 + (x @ np.array(SECOND) > 0)
    numbers = sorted(centres)
    away = np.stack([((x - np.array(centres[k])) ** 2).sum(axis=1) for k in numbers], axis=1)
    return np.array(numbers)[away.argmin(axis=1)]


def _sums(centres: dict[int, list[float]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch, every cluster's rows and the sum of their centred profiles."""
        for b in batches:
            x = _centred(b)
            k = _cluster(x, centres)
            found = np.unique(k)
            total = np.stack([x[k == i].sum(axis=0) for i in found]) if len(found) else np.zeros((0, BUCKETS))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([int((k == i).sum()) for i in found], pa.int64()), bw.list_array(total.ravel(), np.full(len(found), BUCKETS), pa.float64())], ["k", "n", "total"])

    return run


def learn(rows: DataFrame, rounds: int = ROUNDS) -> dict[int, list[float]]:
    """The clusters' centres, of rows with profile, n_tokens and mean; TOPICS of BUCKETS numbers at most."""
    known = rows.filter("n_tokens > 0").select("profile", "mean")
    centres: dict[int, list[float]] | None = None
    for _ in range(rounds):
        found = known.mapInArrow(_sums(centres), "k int, n long, total array<double>").groupBy("k").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(BUCKETS)]).alias("total")).collect()
        centres = {r["k"]: [x / r["n"] for x in r["total"]] for r in found}
        if not centres:
            break
    return centres or {}


def assigned(rows: DataFrame, centres: dict[int, list[float]]) -> DataFrame:
    """rows with a topic in place of profile and mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = _cluster(_centred(b), centres) if centres else np.zeros(b.num_rows, int)
            words = b.column("n_tokens").to_numpy()
            names = np.where((words > 0) & bool(centres), np.char.add("t", k.astype(str)), NO_TOPIC)
            rest = [i for i, c in enumerate(b.schema.names) if c not in ("profile", "mean")]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in rest], pa.array(names.tolist(), pa.string())], [*[b.schema.names[i] for i in rest], "topic"])

    kept = [f for f in rows.schema.fields if f.name not in ("profile", "mean")]
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("topic", T.StringType())]))


def labelled(rows: DataFrame, text: str, lang: str, means: dict[str, list[float]], centres: dict[int, list[float]]) -> DataFrame:
    """rows with n_tokens and topic in place of their text: profiled() and assigned() in one, so that a task has one
    Python worker, for means that were checked to be few."""
    known = {k: np.array(v) for k, v in means.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(BUCKETS)
        for b in batches:
            at = b.schema.get_field_index(text)
            count, share = profiles_of(b.column(at))
            mean = np.array([known.get(x, none) for x in b.column(lang).to_pylist()]).reshape(-1, BUCKETS)
            k = _cluster(share - mean, centres) if centres else np.zeros(b.num_rows, int)
            names = np.where((count > 0) & bool(centres), np.char.add("t", k.astype(str)), NO_TOPIC)
            rest = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in rest], pa.array(count, pa.int64()), pa.array(names.tolist(), pa.string())], [*[b.schema.names[i] for i in rest], "n_tokens", "topic"])

    kept = [f for f in rows.schema.fields if f.name != text]
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("topic", T.StringType())]))


def topics_sql(rounds: int = ROUNDS) -> list[str]:
    """DuckDB CTEs that give p (doc_id, source, lang, topic, n_tokens) of t (doc_id, source, lang, x, a text)."""
    each = lambda f: "[" + ", ".join(f(i + 1) for i in range(BUCKETS)) + "]"
    dot = lambda signs: " + ".join(f"{s} * c[{i + 1}]" for i, s in enumerate(signs))
    parts = [
        "wd AS MATERIALIZED (SELECT rowid_, w, count(*) AS n FROM (SELECT rowid_, unnest(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')) AS w FROM t) GROUP BY ALL)",
        f"wb AS MATERIALIZED (SELECT w, ((h * {MULTIPLE}) % 4294967296 // 268435456)::INTEGER AS bucket FROM (SELECT w, list_reduce(list_prepend(0::HUGEINT, list_reverse(list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::INTEGER::HUGEINT))), lambda a, b: (a * {BASE} + b + 1) % 4294967296) AS h FROM (SELECT DISTINCT w FROM wd)))",
        f"pf AS MATERIALIZED (SELECT rowid_, sum(n)::BIGINT AS n_tokens, {each(lambda i: f'coalesce(sum(n) FILTER (bucket = {i - 1}), 0)::DOUBLE / sum(n)')} AS profile FROM wd JOIN wb USING (w) GROUP BY rowid_)",
        f"me AS MATERIALIZED (SELECT lang, {each(lambda i: f'avg(profile[{i}])')} AS mean FROM pf JOIN t USING (rowid_) GROUP BY lang)",
        f"ce AS MATERIALIZED (SELECT rowid_, {each(lambda i: f'profile[{i}] - mean[{i}]')} AS c FROM pf JOIN t USING (rowid_) JOIN me USING (lang))",
        f"k0 AS MATERIALIZED (SELECT rowid_, c, (({dot(FIRST)}) > 0)::INTEGER * 2 + (({dot(SECOND)}) > 0)::INTEGER AS k FROM ce)",
    ]
    away = " + ".join(f"(c[{i + 1}] - m[{i + 1}]) * (c[{i + 1}] - m[{i + 1}])" for i in range(BUCKETS))
    for r in range(rounds):
        parts.append(f"m{r}_ AS MATERIALIZED (SELECT k, {each(lambda i: f'avg(c[{i}])')} AS m FROM k{r} GROUP BY k)")
        parts.append(f"k{r + 1} AS MATERIALIZED (SELECT rowid_, any_value(c) AS c, arg_min(k, (a, k)) AS k FROM (SELECT rowid_, c, k, {away} AS a FROM ce, m{r}_) GROUP BY rowid_)")
    parts.append(f"d AS MATERIALIZED (SELECT doc_id, source, lang, coalesce('t' || k, '{NO_TOPIC}') AS topic, coalesce(n_tokens, 0) AS n_tokens FROM t LEFT JOIN pf USING (rowid_) LEFT JOIN k{rounds} USING (rowid_))")
    return parts
