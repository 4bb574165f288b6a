import os

from tidemill.llm.store import cut, drop


def test_tables_are_written_and_dropped(spark):
    found = cut(spark.range(5), "five")
    path = found._cut_path
    assert found.count() == 5 and path.startswith(spark.conf.get("spark.checkpoint.dir"))
    drop(found)
    assert not os.path.exists(path)
