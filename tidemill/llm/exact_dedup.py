"""Exact duplicates by sorting content, with DataFrame operations only.

Sampled splitters range-partition the normalised texts, by their first characters and a hash; each partition is sorted
(and spills as it must), so that equal texts are neighbours, and a window over whole texts takes each run's size and
the document that stays. Runs of more than rows / (8 * partitions) rows, of which there are fewer than 8 * partitions,
are found by a count beforehand and salted by doc_id into parts; the parts' counts and maxima are then merged by
sha256 and length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.columns import ascii_lower
from tidemill.llm.store import cut, width

#: Rows of a run that are never split, however small a partition is; characters that splitters compare.
MIN_SPLIT, PREFIX = 128, 32


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the row with the
    smallest doc_id stays, or the largest; null doc_ids stay only among themselves. Of rows that repeat a doc_id and
    its text one is kept. text_sha256 is of the normalised text in UTF-8. Other columns aren't read; an empty table
    gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(keep)
    best = F.min if keep == "smallest" else F.max
    order = F.asc_nulls_last("doc_id") if keep == "smallest" else F.desc_nulls_last("doc_id")
    parts = width(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("norm"))
    rows = rows.withColumn("h", F.xxhash64("norm"))
    most = max(MIN_SPLIT, -(-docs.count() // (8 * parts)))
    large = rows.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("h", F.ceil(F.col("n") / most).alias("salts"))
    salted = rows.join(F.broadcast(cut(large, "large-groups")), "h", "left").withColumns({"salt": F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(-1)), "start": F.substring("norm", 1, PREFIX)})
    run = Window.partitionBy("start", "h", "salt", "norm")
    sorted_runs = salted.select("start", "h", "salt", "norm", "doc_id").repartitionByRange(parts, "start", "h", "salt").select(
        "doc_id", "salt", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("size"),
        best("doc_id").over(run).alias("best"), F.count("*").over(run).alias("n"), F.row_number().over(run.orderBy(order)).alias("rank"),
    )
    found = cut(sorted_runs, "runs")
    merged = found.filter("salt >= 0").groupBy("text_sha256", "size").agg(best("doc_id").alias("all_best"), F.count("*").alias("all_n"))  # fewer than 8 * parts rows
    return found.join(F.broadcast(merged), ["text_sha256", "size"], "left").select(
        "doc_id",
        F.coalesce("all_best", "best").alias("keep_id"),
        F.coalesce("all_n", "n").alias("group_size"),
        ((F.col("rank") == 1) & F.col("doc_id").eqNullSafe(F.coalesce("all_best", "best"))).alias("kept"),
        "text_sha256",
    )
