"""Typed reading of untyped rows: good and bad rows, dead letters, inferred schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of types in outside schemas, and their types here.
TYPE_NAMES = {"STRING": "string", "INTEGER": "bigint", "INT64": "bigint", "FLOAT": "double", "FLOAT64": "double", "BOOLEAN": "boolean", "BOOL": "boolean", "TIMESTAMP": "timestamp", "BYTES": "binary"}


def schema_from_text(text: str) -> T.StructType:
    """A schema of "name:TYPE,name:TYPE"."""
    parts = [p.strip().split(":") for p in text.split(",")]
    return T.StructType([T.StructField(n, T._parse_datatype_string(TYPE_NAMES[k.upper()])) for n, k in parts])


def schema_from_json(fields: list[dict]) -> T.StructType:
    """A schema of [{name, type, mode, description}]; REQUIRED ones aren't nullable, descriptions are kept."""
    return T.StructType([T.StructField(f["name"], T._parse_datatype_string(TYPE_NAMES[f["type"].upper()]), f.get("mode", "NULLABLE").upper() != "REQUIRED", {"description": f["description"]} if f.get("description") else None) for f in fields])


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df's string columns cast to a schema's, with "is_bad": whether a value that is there can't be cast or a required one is missing."""
    columns, bad = [], F.lit(False)
    for f in schema:
        have = F.col(f.name) if f.name in df.columns else F.lit(None).cast("string")
        value = have.try_cast(f.dataType)
        bad = bad | (have.isNotNull() & value.isNull()) | (value.isNull() if not f.nullable else F.lit(False))
        columns.append(value.alias(f.name))
    return df.select(*columns, bad.alias("is_bad"), F.struct(*df.columns).alias("original"))


def split_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, originals of bad ones) of a typed table."""
    return df.filter(~F.col("is_bad")).drop("is_bad", "original"), df.filter("is_bad").select("original.*")


def parse_json(df: DataFrame, payload: str, schema: T.StructType | str) -> DataFrame:
    """df with "parsed" and "error_message", null for good rows; bad ones keep their payload."""
    fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    whole = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = df.withColumn("parsed", F.from_json(payload, whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("parsed").isNull() | F.col("parsed._corrupt_record").isNotNull()
    return parsed.withColumn("error_message", F.when(bad, F.lit("not a record of the schema"))).withColumn("parsed", F.when(~bad, F.struct(*[F.col("parsed")[f.name].alias(f.name) for f in fields])))


def guarded(f: Callable[[str], str], kind: str = "struct<ok:boolean,value:string,error:string>") -> Callable[[Column], Column]:
    """A function of one text as a column function whose failures are values: ok, value, error."""
    import pandas as pd

    def one(x: str | None) -> tuple[bool, str | None, str | None]:
        try:
            return True, f(x), None
        except Exception as e:  # the caller's function may fail in any way; that is its output
            return False, None, f"{type(e).__name__}: {e}"

    def over(values):
        return pd.DataFrame([one(x) for x in values], columns=["ok", "value", "error"])

    over.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(over, kind)


def type_name(value: Column | str) -> Column:
    """INTEGER for text that is a 32-bit number, else STRING."""
    text = F.col(value) if isinstance(value, str) else value
    return F.when(F.coalesce(text.rlike("^[+-]?[0-9]+$") & text.try_cast("int").isNotNull(), F.lit(False)), "INTEGER").otherwise("STRING")


def inferred_fields(df: DataFrame, payload: str, arrival: str) -> DataFrame:
    """name, type of each top-level key of JSON objects: INTEGER if its first value is a 32-bit number, else STRING."""
    entries = df.select(arrival, F.explode(F.from_json(payload, "map<string,string>")).alias("name", "value"))
    return entries.groupBy("name").agg(F.min_by(type_name("value"), arrival).alias("type"))


def inferred_schema(df: DataFrame, payload: str, arrival: str, max_fields: int = 10_000) -> T.StructType:
    """The schema of inferred_fields(), sorted by name; more fields than max_fields are an error."""
    rows = inferred_fields(df, payload, arrival).orderBy("name").limit(max_fields + 1).collect()
    if len(rows) > max_fields:
        raise ValueError(f"more than {max_fields} fields")
    return T.StructType([T.StructField(r["name"], T._parse_datatype_string(TYPE_NAMES[r["type"]])) for r in rows])


def parse_inferred(df: DataFrame, payload: str, arrival: str) -> DataFrame:
    """JSON objects as columns of the schema that they themselves give; values that don't fit it are null."""
    schema = inferred_schema(df, payload, arrival)
    fields = F.from_json(payload, "map<string,string>")
    return df.select(arrival, *[F.try_element_at(fields, F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in schema])


def error_table(table: str, given: str | None = None) -> str:
    """Where rejected rows of a table go."""
    return given or f"{table}_error_records"
