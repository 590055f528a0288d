"""Scanning files as they arrive in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import engine
from ..schemas import MAX_INPUT_BYTES

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def scan_arrivals(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], files_per_batch: int = 1000) -> StreamingQuery:
    """Scan each new file once and hand the reports of a batch to ``sink(reports, batch)``.

    The listing of files already seen is Spark's own, in ``checkpoint``; a batch that fails is scanned again.
    """
    source = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_batch).load(folder)
    files = source.filter(source["length"] <= MAX_INPUT_BYTES).select("path", "length", "content")
    return engine.scan(files).writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
