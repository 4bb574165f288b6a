"""Folders for what a query writes on its way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Of applications of this machine alone whose session names no folder.
_own_folders: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset: a new one of this machine, gone when the process
    ends, if driver and executors are one process; else an error, as executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="tidemill-")
        atexit.register(shutil.rmtree, _own_folders[app], ignore_errors=True)
    return _own_folders[app]


def app_folder(spark: SparkSession) -> str:
    """The application's own folder below the shared one: once its results are read, it may go as a whole."""
    return f"{shared_root(spark)}/tidemill-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path, not yet there, in the application's folder."""
    return f"{app_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder, wherever Spark can; whether it was there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> bool:
    """Delete all that this application has written on its way; tables not yet read from there are lost."""
    return remove(spark, app_folder(spark))
