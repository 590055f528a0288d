"""Shared pieces of the corpus operators: table access, checkpoints and connected components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import folder as shared_folder

#: Edges of a task of :func:`components`.
EDGES = 50_000

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WORD = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Runs of letters of Unicode's letter categories. The pattern also takes other numerals, such as a half, for letters."""
    words = _WORD.findall(text)
    if all(map(str.isalpha, words)):
        return words
    return [run for word in words for run in "".join(c if c.isalpha() else " " for c in word).split(" ") if run]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def fleeting_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run in here delete the files of their shuffles when they end.

    Else those stay until the driver happens to collect its garbage, all of a long job's at once.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, in the shared folder, and cut its lineage; the shuffles it took are deleted."""
    shared_folder(df.sparkSession)
    with fleeting_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a query of its own, made under the setting


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that one wrote, wherever it is."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, count: int) -> list[str]:
    """Names for columns of one's own, which no column of ``df`` has, whatever the case."""
    taken, names, k = {c.lower() for c in df.columns}, [], 0
    while len(names) < count:
        if f"own_{k}" not in taken:
            names.append(f"own_{k}")
        k += 1
    return names


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], int(row["h"])


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star steps.

    Returns ``node, component`` (the smallest node reachable) for every node that has an edge to
    another node; loops, repeated edges and edges with a null end count for nothing. The steps are
    joins and grouped minima, so the star of a hot node is split by skew handling and never gathered;
    the driver reads one count and checksum a round. A small graph takes few tasks, whatever the number
    of shuffle partitions, as each task of a shuffle leaves files.
    """

    def star(e: DataFrame, larger_only: bool) -> DataFrame:
        if larger_only:  # each node's larger neighbours move to its smallest one
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
            moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # each node's smaller neighbours, and itself, move to the smallest of them
            least = e.groupBy("u").agg(F.min("v").alias("m"))
            moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            moved = moved.union(least.select("u", F.col("m").alias("v")))
        return moved.filter("u <> v").coalesce(tasks).distinct()

    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u > v").distinct()
    e = cut(e)
    before = _fingerprint(e)
    tasks = max(4, before[0] // EDGES)  # steps don't add edges to speak of
    e = e.coalesce(tasks)
    while before[0]:
        e = cut(star(star(e, True), False).coalesce(tasks))
        now = _fingerprint(e)
        if now == before:
            break
        before = now
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
