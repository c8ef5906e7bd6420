"""Fresh paths in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; below the machine's temporary folder only where a session names none, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (root or "file://" + os.path.join(tempfile.gettempdir(), "tidemark-shared")).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of this application; what is there goes when the driver ends, as lazy tables may be read till then."""
    base = f"{shared_root(spark)}/tidemark/{spark.sparkContext.applicationId}"
    if not _made:
        atexit.register(remove_scratch)
    _made[base] = spark
    return f"{base}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path that scratch() has given."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def remove_scratch() -> None:
    """Deletes all that scratch() has given paths for."""
    for base, spark in list(_made.items()):
        try:
            remove(spark, base)
        except Exception:  # the session has ended before: a folder on a disk can go without it
            shutil.rmtree(base.removeprefix("file://"), ignore_errors=True)
        _made.pop(base, None)
