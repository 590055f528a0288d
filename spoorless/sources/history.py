"""Reading what was kept of earlier runs: broken entries become error rows, settings that are missing their defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import Options

RESULT = "struct<path: string, output_path: string, success: boolean, error: string>"
ENTRY = f"id string, created_at timestamp, mode string, results array<{RESULT}>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON lines ``id, created_at, mode, results``, with ``broken``: a line that is none, as it stands.

    Every line is a row. Of a broken one, and of one without them, ``results`` are empty and ``mode`` is 'copy';
    any other mode than 'replace' is 'copy', too. Blank lines are no rows. A line of another shape (a number, a
    list) is broken as well.
    """
    rows = spark.read.schema(f"{ENTRY}, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    mode = F.when(F.col("mode") == "replace", "replace").otherwise("copy")
    fine = F.col("broken").isNull()
    kept = lambda c: F.when(fine, F.col(c)).alias(c)  # noqa: E731  what was read of a broken line isn't trusted
    return rows.select(kept("id"), kept("created_at"), F.when(fine, mode).otherwise("copy").alias("mode"), F.when(fine & F.col("results").isNotNull(), F.col("results")).otherwise(F.array().cast(f"array<{RESULT}>")).alias("results"), "broken")


#: Each setting and its default; a setting is true or false by its default unless the text says the other.
_SWITCHES = {"preserve_timestamps": True, "preserve_orientation": True, "preserve_color_profile": True, "remove_extended_attributes": False}


def settings(rows: DataFrame) -> DataFrame:
    """``user, mode`` and the switches of :class:`schemas.Options`, of ``user, key, value`` rows of texts.

    A switch that is on by default is off only for 'false', one that is off only on for 'true'; a mode other
    than 'replace' is the default. Of several values of a key the greatest counts; unknown keys count for nothing.
    """
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    switch = lambda key, on: F.coalesce(value(key) != "false", F.lit(True)) if on else F.coalesce(value(key) == "true", F.lit(False))
    mode = F.when(value("mode") == "replace", "replace").otherwise(Options().mode)
    return rows.groupBy("user").agg(mode.alias("mode"), *[switch(k, on).alias(k) for k, on in _SWITCHES.items()])
