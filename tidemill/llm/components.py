"""Connected components of a graph whose edges are a DataFrame, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.store import cut, drop


#: Edges up to which a round's minima (a row of two numbers for each end of an edge, 32 MB at most) are broadcast.
SMALL = 1 << 20


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of an edge the smallest node that it reaches.

    Alternates the large-star and small-star steps: every step rewires each node's larger (or smaller) neighbours to
    the least one, by a keyed minimum, combined before it is shuffled, and a join with it. Minima of few edges, which
    each round counts, are broadcast; others are written, so that both sides of the join are plain tables, whose skewed
    side, a node of very many edges, Spark can split. Ends when a round leaves the edges as they were; a round is
    written to the shared folder, and the one before deleted. Self loops and null ends are ignored; no edges give no rows.
    """
    here = cut(
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    seen = _state(here)
    while seen[0]:
        few, written = seen[0] <= SMALL, []
        both = here.select("u", "v").union(here.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _held(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), few, written)
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_held(low, few, written), "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        before, here = here, cut(small, "edges")
        drop(before, *written)
        now = _state(here)
        if now == seen:
            break
        seen = now
    return here.select(F.col("u").alias("node"), F.col("v").alias("component")).union(here.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _held(minima: DataFrame, few: bool, written: list[DataFrame]) -> DataFrame:
    if few:
        return F.broadcast(minima)
    written.append(cut(minima, "minima"))
    return written[-1]


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
