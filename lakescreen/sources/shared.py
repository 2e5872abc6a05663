"""The folder that driver and executors share, for what has to be written and read again."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; only a local session that names none gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lakescreen-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove what was written when the driver ends; results may be read lazily until then."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        with contextlib.suppress(Exception):  # the JVM may have ended first
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)

    atexit.register(remove)
