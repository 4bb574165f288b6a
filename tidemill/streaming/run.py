"""Running streams: fan-out of micro-batches, dead letters, throttling, job control."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemill.operators.quality import parse_json
from tidemill.sinks.tables import error_table

Writer = Callable[[DataFrame], None]


def available(stream: DataFrame, write: Writer, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Handle what there is now, batch by batch, and end. A batch's offsets are committed once write has returned."""
    started = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: write(df)).start()
    started.awaitTermination()
    return started


def fan_out(*writers: Writer) -> Writer:
    """Write each micro-batch several times; it is computed once."""

    def write(df: DataFrame) -> None:
        df.persist()
        try:
            for w in writers:
                w(df)
        finally:
            df.unpersist()

    return write


def appended(path: str) -> Writer:
    return lambda df: df.write.mode("append").parquet(path)


def inserted(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Handle what there is now by the file sink, row by row of each micro-batch and exactly once, and end: the other way
    than loading batches by available(stream, appended(path), ...)."""
    started = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    return started


def sent(folder: str, payload: str) -> Writer:
    """Messages to a topic's folder."""
    return lambda df: df.select(F.col(payload).cast("string").alias("payload"), F.current_timestamp().alias("publish_time")).write.mode("append").json(folder)


def logged(report: Callable[[str], None], rows: int = 20) -> Writer:
    """Report a batch's first rows."""
    return lambda df: [report(str(r)) for r in df.limit(rows).collect()] and None


def json_to_tables(payload: str, schema: T.StructType | str, path: str, errors: str | None = None, transform: Callable[[DataFrame], DataFrame] | None = None) -> Writer:
    """Parse messages into a table; those that fail, in transform (columns ok, value, error of a guarded function in
    "udf") or in parsing, go to its error table with payload and reason."""

    def write(df: DataFrame) -> None:
        if transform is not None:
            df = transform(df)
            failed = df.filter(~F.col("udf.ok")).select(payload, F.col("udf.error").alias("error_message"))
            parsed = parse_json(df.filter("udf.ok").withColumn("__original", F.col(payload)).withColumn(payload, F.col("udf.value")), payload, schema)
        else:
            failed = None
            parsed = parse_json(df.withColumn("__original", F.col(payload)), payload, schema)
        parsed.filter("error_message IS NULL").select("parsed.*").write.mode("append").parquet(path)
        bad = parsed.filter("error_message IS NOT NULL").select(F.col("__original").alias(payload), "error_message")
        (bad if failed is None else bad.unionByName(failed)).write.mode("append").parquet(error_table(path, errors))

    return fan_out(write)


def throttled(df: DataFrame, call: Callable[[str], str], column: str, per_second: float, workers: int) -> DataFrame:
    """df with "result", call's value for each row, at no more than so many calls a second over so many partitions.

    call is the caller's client: it is pickled to the workers and runs a batch at a time.
    """
    pause = workers / per_second

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b[column]:
                began = time.monotonic()
                out.append(call(x))
                time.sleep(max(0.0, pause - (time.monotonic() - began)))
            yield b.assign(result=out)

    schema = T.StructType([*df.schema.fields, T.StructField("result", T.StringType())])
    return df.repartition(workers).mapInPandas(run, schema)


def wait_then(query: StreamingQuery, act: Callable[[], object], seconds: float | None = None) -> object:
    """Act once a query has ended well."""
    query.awaitTermination(seconds)
    if query.exception() is not None:
        raise query.exception()
    return act()


@contextmanager
def labelled(spark: SparkSession, *labels: str) -> Iterator[None]:
    """Jobs that are started within carry these labels; cancel(spark, label) ends those of a label."""
    for x in labels:
        spark.sparkContext.addJobTag(x)
    try:
        yield
    finally:
        for x in labels:
            spark.sparkContext.removeJobTag(x)


def cancel(spark: SparkSession, label: str) -> None:
    spark.sparkContext.cancelJobsWithTag(label)


def active(spark: SparkSession) -> Mapping[str, StreamingQuery]:
    return {q.name or q.id: q for q in spark.streams.active}


def stop(spark: SparkSession, name: str) -> bool:
    """Stop a query by name; whether there was one."""
    found = active(spark).get(name)
    if found is None:
        return False
    found.stop()
    return True
