"""The shared folder for tables that a computation writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

KEY = "spark.checkpoint.dir"
_local: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, without a trailing slash.

    Only a local session, where driver and executors are one machine, may go without: it gets a folder of its own.
    """
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {KEY} to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="seawake-")
        found = _local[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more; nothing happens if there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
