import os
from types import SimpleNamespace

import pytest

from tidemill.scratch import clear, remove, scratch


def session(folder, app="app", master="local[2]"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(applicationId=app, master=master))


def test_the_named_folder_or_one_of_this_machine_alone():
    assert os.path.dirname(scratch(session("file:///shared/"), "x")) == "file:///shared/tidemill-app"
    assert scratch(session("/shared", master="yarn"), "x").startswith("/shared/tidemill-app/x-")
    one, two, other = (scratch(session(None, a), "x") for a in ("a", "a", "b"))
    assert one != two and os.path.dirname(one) == os.path.dirname(two) != os.path.dirname(other) and os.path.isdir(os.path.dirname(os.path.dirname(one)))
    for master in ("yarn", "spark://host:7077", "k8s://host"):
        with pytest.raises(ValueError, match="share"):
            scratch(session(None, "c", master), "x")


def test_what_was_written_can_go(spark):
    path = scratch(spark, "gone")
    spark.range(3).write.parquet(path)
    assert os.path.exists(path) and remove(spark, path) and not os.path.exists(path) and not remove(spark, path)
    other = scratch(spark, "all")
    spark.range(3).write.parquet(other)
    assert clear(spark) and not os.path.exists(os.path.dirname(other))
