"""Mixing sources to target weights: iterative proportional fitting, then sampling by the calibrated probabilities.

Tokens are summed by cell, a combination of the categories of all dimensions. A sweep scales the cells' weights, one
dimension after the other, so that weighted tokens have that dimension's target shares. A document's probability is
its cell's weight over the largest weight; a hash of its doc_id decides. Topics, where no column gives them, are learned:
see topics.py.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import topics
from tidemill.llm.store import bounded_batches, cut

SWEEPS = 10
#: Without given targets, a category's share is its share of tokens to this power, normalised.
TEMPERATURE = 0.75
#: Cells that the driver rakes; more are raked as a table.
MAX_CELLS = 100_000
UNKNOWN = "unknown"


def uniform(key: Column) -> Column:
    """A number from 0 to 1, exclusive, by a hash of key's text; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def targets_of(cells: DataFrame, dim: str, given: Mapping[str, float] | None, temperature: float) -> DataFrame:
    """(dim, target) with shares that sum to 1 over the categories that have tokens."""
    margin = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("tokens")).filter("tokens > 0")
    if given is None:
        raw = margin.select(dim, F.pow("tokens", F.lit(temperature)).alias("raw"))
    else:
        shares = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in given.items()], f"{dim} string, raw double")
        raw = margin.join(F.broadcast(shares), dim, "left").select(dim, F.coalesce("raw", F.lit(0.0)).alias("raw"))  # as many rows as the mapping given
    return raw.crossJoin(raw.agg(F.sum("raw").alias("all"))).select(dim, F.try_divide("raw", "all").alias("target"))  # by one row


def rake(cells: DataFrame, dims: list[str], targets: Mapping[str, Mapping[str, float] | None] | None = None, temperature: float = TEMPERATURE, sweeps: int = SWEEPS, max_cells: int = MAX_CELLS) -> DataFrame:
    """dims, tokens, weight: weights of cells under which tokens have each dimension's target shares, the last exactly.

    Cells without tokens, or of categories whose target is 0, get 0; if targets contradict each other (a cell that must
    hold tokens has none), weights are what the sweeps come to.
    """
    spark = cells.sparkSession
    targets = targets or {}
    shares = {d: cut(targets_of(cells, d, targets.get(d), temperature), f"targets-{d}") for d in dims}
    if cells.limit(max_cells + 1).count() <= max_cells:
        rows = [tuple(r) for r in cells.select(*dims, F.col("tokens").cast("double")).orderBy(*dims).collect()]
        want = [{r[0]: r[1] or 0.0 for r in shares[d].collect()} for d in dims]  # no more than cells
        weight = [1.0] * len(rows)
        for _ in range(sweeps):
            for k in range(len(dims)):
                margin: dict = {}
                for r, w in zip(rows, weight, strict=True):
                    margin[r[k]] = margin.get(r[k], 0.0) + w * r[-1]
                total = sum(margin.values())
                weight = [w * want[k].get(r[k], 0.0) * total / margin[r[k]] if margin[r[k]] > 0 else 0.0 for r, w in zip(rows, weight, strict=True)]
        fields = ", ".join(f"`{d}` string" for d in dims)
        return spark.createDataFrame([(*r[:-1], int(r[-1]), w) for r, w in zip(rows, weight, strict=True)], f"{fields}, tokens long, weight double")
    now = cells.select(*dims, "tokens", F.lit(1.0).alias("weight"))
    for _ in range(sweeps):
        for d in dims:
            margin = now.groupBy(d).agg(F.sum(F.col("weight") * F.col("tokens")).alias("margin"))
            factor = margin.crossJoin(margin.agg(F.sum("margin").alias("all"))).join(shares[d], d).select(d, F.coalesce(F.try_divide(F.col("target") * F.col("all"), F.col("margin")), F.lit(0.0)).alias("factor"))
            now = cut(now.join(factor, d, "left").select(*dims, "tokens", (F.col("weight") * F.coalesce("factor", F.lit(0.0))).alias("weight")), "raked")
    return now


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | None] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, temperature: float = TEMPERATURE, sweeps: int = SWEEPS, max_cells: int = MAX_CELLS, keep_row: bool = False) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept and, if keep_row, row (docs' own columns).

    Tokens are runs without ASCII white space. targets maps source, lang and topic to shares of tokens by category (those
    left out have 0); without an entry, shares come from the corpus by temperature. topic is a column of docs, or else
    learned from all of them. Null categories are "unknown"; null and empty texts have no tokens and, if learned, the
    topic "none"; they take the largest weight's probability 1 where their cell has no tokens at all, as they change no
    share. A null doc_id is hashed as an empty text; rows that repeat a doc_id are kept or left together if in one cell.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    picked = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text_"), F.coalesce(F.col(source_col).cast("string"), F.lit(UNKNOWN)).alias("source"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang")]
    if keep_row:
        picked.append(F.struct("*").alias("row"))
    if topic is not None:
        picked.append(F.coalesce(topic.cast("string"), F.lit(UNKNOWN)).alias("topic"))
    texts = docs.select(*picked)
    dims = ["source", "lang", "topic"]
    # a row of numbers for each text: topics and cells come from these alone
    seen = cut(topics.profiled(texts.drop("doc_id", "row"), "text_"), "profiles")
    if topic is None:
        means = cut(topics.means_of(seen, "lang"), "means")
        few = means.limit(max_cells + 1).count() <= max_cells
        beside = lambda df: df.join(F.broadcast(means) if few else means, "lang", "left")
        centres = topics.learn(beside(seen))
        seen = topics.assigned(beside(seen), centres)
        if few:
            rows = topics.labelled(texts, "text_", "lang", {r["lang"]: list(r["mean"]) for r in means.collect()}, centres)
        else:
            rows = topics.assigned(beside(topics.profiled(texts, "text_")), centres)
    else:
        seen, rows = seen.drop("profile"), topics.profiled(texts, "text_").drop("profile")
    cells = cut(seen.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")), "cells")
    weights = cut(rake(cells, dims, targets, temperature, sweeps, max_cells), "weights")
    most = weights.agg(F.max("weight")).first()[0] or 1.0
    small = weights.limit(max_cells + 1).count() <= max_cells
    found = rows.join(F.broadcast(weights) if small else weights, dims, "left")  # beyond max_cells a shuffle, whose skewed cells Spark splits
    probability = F.when(F.col("tokens") > 0, F.col("weight") / F.lit(most)).otherwise(F.lit(1.0))
    columns = ["doc_id", *dims, "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), probability.alias("probability"), (uniform(F.col("doc_id")) < probability).alias("kept")]
    return found.select(*columns, *["row"] * keep_row)


def mixing_sql(sweeps: int = SWEEPS, temperature: float = TEMPERATURE) -> str:
    """DuckDB SQL for mix() with default targets and topics, weights and probabilities rounded to 6 decimals."""
    dims = ["source", "lang", "topic"]
    parts = [
        f"t AS MATERIALIZED (SELECT row_number() OVER () AS rowid_, doc_id, coalesce(source, '{UNKNOWN}') AS source, coalesce(lang, '{UNKNOWN}') AS lang, coalesce(text, '') AS x FROM documents)",
        *topics.topics_sql(),
        "c0 AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens, 1.0::DOUBLE AS w FROM d GROUP BY ALL)",
    ]
    for d in dims:
        parts.append(f"s_{d} AS MATERIALIZED (SELECT {d}, pow(sum(tokens)::DOUBLE, {temperature}) AS raw FROM c0 GROUP BY {d} HAVING sum(tokens) > 0)")
        parts.append(f"t_{d} AS MATERIALIZED (SELECT {d}, raw / (SELECT sum(raw) FROM s_{d}) AS target FROM s_{d})")
    at = 0
    for _ in range(sweeps):
        for d in dims:
            parts.append(f"m{at} AS MATERIALIZED (SELECT {d}, sum(w * tokens) AS margin FROM c{at} GROUP BY {d})")
            parts.append(f"c{at + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, CASE WHEN m.margin > 0 THEN c.w * t.target * (SELECT sum(margin) FROM m{at}) / m.margin ELSE 0 END AS w FROM c{at} c JOIN m{at} m USING ({d}) LEFT JOIN t_{d} t USING ({d}))")
            at += 1
    p = f"CASE WHEN c.tokens > 0 THEN c.w / (SELECT max(w) FROM c{at}) ELSE 1.0 END"
    return f"WITH {', '.join(parts)} SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(coalesce(c.w, 0), 6) AS weight, round({p}, 6) AS probability, ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < {p} AS kept FROM d JOIN c{at} c USING (source, lang, topic)"
