"""Groups of any size as tasks of bounded size: blocks of a group, and all pairs of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.store import width


def block_pairs(df: DataFrame, blocks: str, by: list[str], *salt: str) -> DataFrame:
    """Deal each row, by a hash of salt, into one of so many blocks, and repeat it for each pair (i <= j) that has its block."""
    block = F.pmod(F.xxhash64(*salt, F.lit(3)), F.col(blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    df = df.withColumn("block", block)
    return (
        df.filter(f"{blocks} = 1").withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
        .unionByName(df.filter(f"{blocks} > 1").withColumn("x", other).withColumns({"i": F.least("block", "x"), "j": F.greatest("block", "x")}).drop("x"))
        .repartition(width(df.sparkSession), *by, "i", "j")
        .sortWithinPartitions(*by, "i", "j")
    )


def runs(batches: Iterator[pa.RecordBatch], n_keys: int, target: int = 1 << 15, weigh: Callable[[pa.Table], np.ndarray] | None = None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Gather sorted batches into tables that hold whole runs of equal keys, the first n_keys columns; with the runs' starts.

    A table holds rows of a total weight (by default 1 each) of at most target, or a single run.
    """
    held: list[pa.Table] = []
    mass, due = 0, target
    weights = weigh or (lambda t: np.ones(t.num_rows, np.int64))

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in range(n_keys):
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    def parts(t: pa.Table, s: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
        ends = np.append(s[1:], t.num_rows)
        weight = np.cumsum(weights(t))[ends - 1]
        a = 0
        while a < len(s):
            before = weight[a - 1] if a else 0
            z = max(a + 1, int(np.searchsorted(weight, before + target, "right")))
            yield t.slice(s[a], ends[z - 1] - s[a]), s[a:z] - s[a]
            a = z

    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(pa.Table.from_batches([b]))
        mass += int(weights(held[-1]).sum())
        if mass >= due:
            t = pa.concat_tables(held).combine_chunks()
            s = starts(t)
            if len(s) > 1:
                yield from parts(t.slice(0, s[-1]), s[:-1])
            held = [t.slice(s[-1])]
            mass = int(weights(held[0]).sum())
            due = max(target, 2 * mass)  # a long run is put together anew only as often as it doubles
    if held:
        t = pa.concat_tables(held).combine_chunks()
        yield from parts(t, starts(t))
