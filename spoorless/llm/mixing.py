"""Mixing sources to target weights (native): repetition rates by source, then hash-seeded copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free_names, load

#: Up to so many sources, their rates are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for a null text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_rates(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[int] = (3, 1, 2)) -> DataFrame:
    """Targets of each source, from rows of ``source, size``.

    Sources in code point order, null last, weigh ``weights`` in turn. They share ``share`` of all
    sizes by weight; a target stops at ``cap`` times its source's size and the excess goes to the others
    by weight until none is above. Returns ``source, source_size, target, rate``. The windows hold one
    row a source, not the documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(every) - 1) % len(weights)
    ranked = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    # in the order in which rising water reaches the tops: what is left over is shared by the others
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    found = ranked.withColumn("level", level).withColumn("place", F.row_number().over(filling))
    found = found.withColumn("free", F.when(F.col("most") > F.col("level") * F.col("weight"), F.struct("place", "level")))
    final = F.min("free").over(whole)["level"]
    target = F.when(final.isNull(), F.col("most")).otherwise(F.least(F.col("most"), final * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return found.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def copies(rate: Column, name: Column) -> Column:
    """floor(rate) copies and one more with the fraction's probability, drawn from a hash of a name."""
    draw = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")


def named(rows: DataFrame, name: str, text: Column, seed: str) -> DataFrame:
    """Add the name by which a row draws: of its doc_id; rows that share one, or have none, have a number of their own in it.

    Those are numbered apart by the hash ``text`` of their text and by source, so that neither one id nor
    rows without id are gathered; only rows alike in all of these are told apart by their order, which is any.
    """
    own, of, part = free_names(rows, 6)[3:]
    plain = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    repeated = cut(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias(of), F.lit(True).alias(own)))
    count = repeated.count()
    if not count:
        return rows.withColumn(name, plain)
    marked = rows.join(F.broadcast(repeated) if count <= BROADCAST_SOURCES else repeated, F.col("doc_id").eqNullSafe(F.col(of)), "left").drop(of)
    several = marked.filter(F.col(own)).withColumn(part, F.xxhash64(text, "source"))
    number = F.row_number().over(Window.partitionBy("doc_id", part).orderBy(F.lit(1)))
    several = several.withColumn(name, F.concat_ws(":", plain, F.col(part).cast("string"), number.cast("string"))).drop(own, part)
    return marked.filter(F.col(own).isNull()).drop(own).withColumn(name, plain).unionByName(several)


def _with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    (own,) = free_names(rows, 3)[2:]  # beside the names that a caller has taken
    rates = cut(rates.withColumnRenamed("source", own))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    return rows.join(rates, F.col("source").eqNullSafe(F.col(own))).drop(own)


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[int] = (3, 1, 2), seed: str = "mix") -> DataFrame:
    """Emit each document of ``doc_id, text, source, ...`` as often as its source's rate says.

    Null and empty texts have size 0 and follow their source's rate; a source whose sizes are all 0 has
    rate 0. Null sources form one source. Rows that share an id, or have none, draw each for itself. An empty
    table gives an empty one. Other columns, whatever their names, are kept as they are.
    """
    rates = source_rates(docs.select("source", size_of(F.col("text")).alias("size")), share, cap, weights)
    rate, copy = free_names(docs, 2)
    marked = _with_rates(docs, rates.select("source", F.col("rate").alias(rate)))
    times = F.array_repeat(F.lit(1), copies(F.col(rate), F.col(copy)).cast("int"))
    return named(marked, copy, F.xxhash64("text"), seed).withColumn(copy, F.explode(times)).select(*[F.col(f"`{c}`") for c in docs.columns])


def taken(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[int] = (3, 1, 2), seed: str = "mix") -> DataFrame:
    """What :func:`mix` takes of each document: ``doc_id, size, source_size, target, taken``."""
    sizes = cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("hash")))
    rated = named(_with_rates(sizes, source_rates(sizes, share, cap, weights)), "name", F.col("hash"), seed)
    return rated.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("name"))).alias("taken"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(load(spark, sf_dir, "documents"))


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, source_size * 2.0::DOUBLE AS most,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM totals),
levels AS (
  SELECT *, row_number() OVER f AS place,
    ((SELECT CAST(sum(source_size) AS DOUBLE) FROM totals) * 1.5::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / CAST(sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ranked WINDOW f AS (ORDER BY most / weight, source ASC NULLS LAST)),
final AS (SELECT arg_min(level, place) AS level FROM levels WHERE most > level * weight),
rates AS (
  SELECT source, source_size,
    CASE WHEN (SELECT level FROM final) IS NULL THEN most ELSE least(most, (SELECT level FROM final) * weight) END AS target FROM levels),
joined AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS draw
  FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  size * (CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM joined
"""
