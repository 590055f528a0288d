"""The queue's algebra: joins with reports and results, merging, totals, sorting and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions.scalars import natural_key


def last_by_path(rows: DataFrame, value: str, pos: str = "pos") -> DataFrame:
    """Of several rows of a path the last one counts."""
    return rows.groupBy("path").agg(F.max_by(value, pos).alias(value))


def with_reports(queue: DataFrame, reports: DataFrame) -> DataFrame:
    """``queue`` left join ``reports (path, report, pos)``; the status follows the report's error."""
    joined = queue.drop("report").join(last_by_path(reports, "report"), "path", "left")
    return joined.withColumn("status", F.when(F.col("report.error").isNotNull(), "error").otherwise("scanned"))


def with_results(queue: DataFrame, results: DataFrame) -> DataFrame:
    """``queue`` left join ``results (path, result, pos)``; rows without a result stay as they are."""
    joined = queue.drop("result").join(last_by_path(results, "result"), "path", "left")
    status = F.when(F.col("result.success"), "clean").when(F.col("result").isNotNull(), "error").otherwise(F.col("status"))
    return joined.withColumn("status", status)


def merge(queue: DataFrame, incoming: DataFrame) -> DataFrame:
    """The queue and the incoming rows whose id it doesn't have; repeats among these stay."""
    return queue.unionByName(incoming.join(queue.select("id"), "id", "left_anti"))


def without(queue: DataFrame, ident: str) -> DataFrame:
    return queue.filter(F.col("id") != ident)


def path_dedup(paths: DataFrame) -> DataFrame:
    return paths.dropDuplicates(["path"])


def actionable(findings: Column, preserve_color_profile: bool = True, remove_extended_attributes: bool = False) -> Column:
    """How many findings a clean under these options acts on."""
    def counts(f: Column) -> Column:
        profile = F.lit(not preserve_color_profile) | (f["category"] != "color_profile")
        return profile & (F.lit(remove_extended_attributes) | (f["category"] != "macos_xattr"))

    return F.aggregate(F.filter(findings, counts), F.lit(0).cast("long"), lambda total, f: total + f["count"])


def residual(findings: Column) -> Column:
    return F.aggregate(findings, F.lit(0).cast("long"), lambda total, f: total + f["count"])


def cleanable(queue: DataFrame, **options: bool) -> DataFrame:
    return queue.filter((F.col("status") == "scanned") & (actionable(F.col("report.findings"), **options) > 0))


def grand_total(reports: DataFrame) -> DataFrame:
    """All findings of all reports, whether actionable or not."""
    return reports.select(F.coalesce(F.sum(residual(F.col("findings"))), F.lit(0).cast("long")).alias("total"))


def batch_summary(results: DataFrame, *by: str) -> DataFrame:
    """``succeeded, failed, first_output`` of ``success, output_path, pos``, in all or by the given columns."""
    first = F.min_by("output_path", F.when(F.col("output_path").isNotNull(), F.col("pos")))
    return results.groupBy(*by).agg(F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), first.alias("first_output"))


def capped_issues(issues: DataFrame, most: int = 100) -> DataFrame:
    """One row: how many issues of ``path, reason`` there are, and the first ``most`` of them by path and reason."""
    first = issues.select("path", "reason").orderBy("path", "reason").limit(most)
    listed = first.agg(F.array_sort(F.collect_list(F.struct("path", "reason"))).alias("issues"))
    return issues.agg(F.count(F.lit(1)).alias("total")).join(F.broadcast(listed))


def all_done(queue: DataFrame, *by: str) -> DataFrame:
    done = F.col("status").isin("scanned", "clean", "error")
    return queue.groupBy(*by).agg((F.coalesce(F.bool_and(done), F.lit(False)) & (F.count(F.lit(1)) > 0)).alias("all_done"))


SORT_KEYS = ("name", "type", "source_size", "output_size", "findings")


def sort(queue: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Sort by one key; missing values last either way, ties by ``idx`` upwards either way."""
    column = natural_key(F.col(key)) if key in ("name", "type") else F.col(key)
    return queue.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_last(), F.col("idx").asc())


def history(entries: DataFrame, newest: int = 100) -> DataFrame:
    """The newest entries of ``id, created_at, ...``."""
    return entries.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(newest)


def history_ratio(results: DataFrame) -> DataFrame:
    """``id, succeeded, total`` of a row a result: ``id, success``; long histories are counted in parts."""
    return results.groupBy("id").agg(F.count_if("success").alias("succeeded"), F.count(F.lit(1)).alias("total"))


def ranked(rows: DataFrame, key: Column) -> DataFrame:
    """Rows with their ``place`` from 1 in the order of a key: a sort by range, and the ranges' counts before each.

    The sorted rows are numbered within their ranges and written once; counts and places are both read from
    there, so that they tell of the same ranges however often they are asked. Equal keys have places in any order.
    """
    names = rows.columns
    sorted_ = rows.withColumn("_key", key).orderBy("_key").select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], F.monotonically_increasing_id().alias("id"))
    ordered = shared.once(sorted_, "ranked")
    part = F.shiftright("id", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row a range
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ordered.join(F.broadcast(offsets), part == F.col("part"))
    return placed.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], (F.col("before") + own + 1).alias("place"))


def delivered(results: DataFrame) -> DataFrame:
    """Results in the order of ``pos``, with their ``place`` in it; repeated paths have a result each."""
    return ranked(results, F.col("pos")).orderBy("place")


def first_by_position(rows: DataFrame, most: int, *by: str, pos: str = "pos") -> DataFrame:
    """Of the rows of each group those at its first ``most`` positions, counted from 1 as given.

    It is a condition on the position, so a filter before it or after it leaves the same rows: what a later
    filter drops isn't made up for by later positions.
    """
    first = rows.groupBy(*by).agg(F.min(pos).alias("_first")) if by else rows.agg(F.min(pos).alias("_first"))
    joined = rows.join(first, list(by)) if by else rows.join(F.broadcast(first))  # one row
    return joined.filter(F.col(pos) < F.col("_first") + most).drop("_first")


def manifest_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """``value, problem``: repeated on the left, missing on the right, extra on the right."""
    value = F.col(column).alias("value")
    a, b = left.select(value), right.select(value)
    repeated = a.groupBy("value").count().filter("count > 1").select("value", F.lit("duplicate").alias("problem"))
    missing = a.distinct().exceptAll(b.distinct()).withColumn("problem", F.lit("missing"))
    return repeated.unionByName(missing).unionByName(b.distinct().exceptAll(a.distinct()).withColumn("problem", F.lit("extra")))


def labels(findings: DataFrame, names: DataFrame) -> DataFrame:
    """Labels by category from ``names (category, shown)``, a table of one row a category; else the finding's own."""
    return findings.join(names, "category", "left").withColumn("label", F.coalesce("shown", "label")).drop("shown")
