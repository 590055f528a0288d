"""The folder that driver and executors share, and tables written there once."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only a local session that names none gets a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return posixpath.join(folder(spark), f"{name}-{uuid.uuid4().hex}")


def once(rows: DataFrame, name: str) -> DataFrame:
    """Compute rows once, into a table in the shared folder, and read them from there."""
    out = place(rows.sparkSession, name)
    rows.write.parquet(out)
    return rows.sparkSession.read.schema(rows.schema).parquet(out)
