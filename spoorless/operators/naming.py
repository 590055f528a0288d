"""Names of rows, and free names for files as a set operation: wanted against taken, all at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats

#: The highest number that is tried behind a name.
MAX_SUFFIX = 9_999
UNKNOWN_NAME = "未知文件"
#: Parts of a group of equal wanted names that are numbered apart at first.
_SALTS = 64


def path_row(path: Column) -> Column:
    """``id, name, kind`` of a row known by its path: the last segment names it, or the path if that is empty."""
    name = formats.file_name(path)
    return F.struct(path.alias("id"), name.alias("name"), formats.kind(name).alias("kind"))


def file_row(name: Column, size: Column, modified: Column) -> Column:
    """``id, name, kind`` of a row known by name, size and time."""
    ident = F.concat_ws(":", name, size.cast("string"), modified.cast("string"))
    return F.struct(ident.alias("id"), name.alias("name"), formats.kind(name).alias("kind"))


def report_name(path: Column) -> Column:
    """Name in a report: the last segment, separators at the end aside; a fixed one for paths without, and for null."""
    bare = F.regexp_replace(path, "(?<=.)/+$", "")
    last = F.element_at(F.split(bare, "/"), -1)
    return F.when(path.isNull() | last.isin("", "..", "."), UNKNOWN_NAME).otherwise(last)


def parts(name: Column) -> Column:
    """``stem, ext`` of a name: ext with its dot, and none for names whose only dot comes first."""
    ext = F.regexp_extract(name, r"(?s)^.+([.][^.]*)$", 1)
    return F.struct(F.substring(name, F.lit(1), F.length(name) - F.length(ext)).alias("stem"), F.when(ext == ".", "").otherwise(ext).alias("ext"))


def cleaned_name(name: Column) -> Column:
    """``stem.cleaned.ext``."""
    own = parts(name)
    return F.concat(own["stem"], F.lit(".cleaned"), own["ext"])


def backup_name(name: Column) -> Column:
    return F.concat(name, F.lit(".bak"))


def _numbers(taken: DataFrame, most: int) -> DataFrame:
    """Taken names as ``folder, stem, ext, number``: the name itself is number 1, ``stem-k.ext`` k; a name may be both."""
    own = taken.select("folder", "name", parts(F.col("name")).alias("p")).select("folder", F.col("p.stem").alias("stem"), F.col("p.ext").alias("ext"))
    behind = own.select("folder", F.regexp_extract("stem", r"(?s)^(.*)-([1-9][0-9]{0,3})$", 1).alias("stem"), "ext", F.regexp_extract("stem", r"(?s)^(.*)-([1-9][0-9]{0,3})$", 2).alias("number")).filter("number <> ''")
    numbered = behind.select("folder", "stem", "ext", F.col("number").try_cast("int").alias("number")).filter((F.col("number") >= 2) & (F.col("number") <= most))
    return own.withColumn("number", F.lit(1)).unionByName(numbered)


def assigned(wanted: DataFrame, taken: DataFrame, most: int = MAX_SUFFIX) -> DataFrame:
    """Give each row of ``wanted (pos, folder, name, ...)`` a free name, as ``given``.

    The name itself, else ``stem-2.ext`` to ``stem-9999.ext``, in the order of ``pos``; when all of these are
    taken, the name itself. ``taken (folder, name)`` are names that exist. So the k-th row that wants a name
    gets its k-th free number: k and as many more as taken numbers have fewer than k free ones before them.
    A wanted name counts as taken for the numbers of others, so no two rows get the same, but for those that
    find all taken. Rows of equal pos are in any order. Of a name that many rows want, only the first rows can
    get numbers: parts of the group are numbered apart, and only as many of each meet.
    """
    rows = wanted.withColumn("_p", parts(F.col("name")))
    rows = rows.select(*wanted.columns, F.col("_p.stem").alias("_stem"), F.col("_p.ext").alias("_ext"))
    group = ["folder", "_stem", "_ext"]
    salted = rows.select("pos", "folder", "name", "_stem", "_ext").withColumn("_salt", F.pmod(F.xxhash64("pos", "folder"), F.lit(_SALTS)))
    own = salted.withColumn("_own", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy("pos"))).filter(F.col("_own") <= most)
    first = own.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy("pos", "_salt", "_own"))).filter(F.col("_rank") <= most)

    names = rows.select("folder", "_stem", "_ext").distinct()
    others = rows.select("folder", "name").distinct()
    held = _numbers(taken.select("folder", "name").distinct(), most).unionByName(_numbers(others, most).filter("number > 1")).distinct()
    held = held.withColumnsRenamed({"stem": "_stem", "ext": "_ext"})
    sets = names.join(held, group, "left").groupBy(*group).agg(F.sort_array(F.collect_set("number")).alias("_taken"))  # at most 9999 numbers
    gaps = F.transform("_taken", lambda t, i: t - i - 1)  # free numbers before each taken one
    ranked = first.join(sets.withColumn("_gaps", gaps), group)
    number = F.col("_rank") + F.size(F.filter("_gaps", lambda g: g < F.col("_rank")))
    given = ranked.select("pos", "folder", "name", F.when(number <= most, number).alias("_number"))
    # rows of the same pos, folder and name are alike but for their number: each has its own
    same = Window.partitionBy("folder", "name", "pos").orderBy("_number")
    given = given.withColumn("_twin", F.row_number().over(same))
    mine = rows.withColumn("_twin", F.row_number().over(Window.partitionBy("folder", "name", "pos").orderBy(F.lit(1))))
    joined = mine.join(given, ["folder", "name", "pos", "_twin"], "left")
    full = F.when(F.col("_number") > 1, F.concat("_stem", F.lit("-"), F.col("_number").cast("string"), "_ext")).otherwise(F.col("name"))
    return joined.select(*wanted.columns, full.alias("given"))
