"""Every operator's query with SQL gives that SQL's rows; so do near-copies of license passages, which the tables lack."""

import duckdb
import pandas as pd
import pytest

from tidemill.llm import licenses
from tidemill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def of_spark(df):
    return plain(df.columns, df.collect())


def of_duck(relation):
    return plain(relation.columns, relation.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_are_those_of_the_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), c.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns) and of_spark(got) == of_duck(want)


def test_license_sql_also_votes(spark):
    passages = [p.split() for p in licenses.PASSAGES]
    texts = [" ".join(p[:a] + ["x"] * b + p[a + c :]) for p in passages for a, b, c in ((0, 0, 0), (4, 1, 0), (5, 0, 2), (6, 5, 0), (0, 0, 6))] + [" ".join(passages[0] * 2)]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    got = licenses.scan_licenses(spark.createDataFrame(documents)).drop("places")
    assert of_spark(got) == of_duck(duckdb.sql(ORACLES["op4_license_scan"])) and got.filter("labels <> ''").count() > len(passages)
