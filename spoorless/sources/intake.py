"""Discovery of files and reading them as rows."""

from __future__ import annotations

import os
import stat
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..schemas import ERRORS, MAX_INPUT_BYTES

# Bounds of one intake and the reasons it gives.
MAX_FILES, MAX_DEPTH, MAX_ISSUES, MAX_LAUNCH = 10_000, 64, 100, 100
REASONS = {
    "full": "已达到单次导入 10000 个文件的安全上限",
    "deep": "目录层级超过 64 层安全上限",
    "unreadable": "无法读取：",
    "unlistable": "无法读取目录：",
    "link": "跳过符号链接",
    "extension": "暂不支持此扩展名",
    "special": "不是常规文件或目录",
}


@dataclass
class Intake:
    files: list[str] = field(default_factory=list)
    skipped_count: int = 0
    issues: list[tuple[str, str]] = field(default_factory=list)
    limit_reached: bool = False

    def skip(self, path: str, reason: str) -> None:
        self.skipped_count += 1
        if len(self.issues) < MAX_ISSUES:
            self.issues.append((path, reason))

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Files, issues and a one-row summary."""
        files = spark.createDataFrame([(f,) for f in self.files], "path string")
        issues = spark.createDataFrame(self.issues, "path string, reason string")
        return files, issues, spark.createDataFrame([(self.skipped_count, self.limit_reached)], "skipped_count bigint, limit_reached boolean")


def _has_extension(path: str) -> bool:
    suffix = Path(path).suffix
    return bool(suffix) and suffix[1:].lower() in formats.SUPPORTED


def expand(paths: list[str]) -> Intake:
    """Files named by ``paths`` or found below them, sorted, each once; at most MAX_FILES, as one intake takes no more.

    A file that is named is taken whatever it is; one that is found needs a supported extension. Links are refused.
    """
    out = Intake()
    todo = [(p, False, 0) for p in reversed(paths)]
    while todo and not out.limit_reached:
        path, found, depth = todo.pop()
        if len(out.files) >= MAX_FILES:
            out.limit_reached = True
            out.skip(path, REASONS["full"])
            continue
        if depth > MAX_DEPTH:
            out.skip(path, REASONS["deep"])
            continue
        try:
            mode = os.lstat(path).st_mode
        except OSError as error:
            out.skip(path, f"{REASONS['unreadable']}{error}")
            continue
        if stat.S_ISDIR(mode):
            try:
                children = sorted((os.path.join(path, c) for c in os.listdir(path)), key=os.fsencode)
            except OSError as error:
                out.skip(path, f"{REASONS['unlistable']}{error}")
                continue
            todo += [(c, True, depth + 1) for c in reversed(children)]
        elif stat.S_ISLNK(mode):
            out.skip(path, REASONS["link"])
        elif not stat.S_ISREG(mode):
            out.skip(path, REASONS["special"])
        elif found and not _has_extension(path):
            out.skip(path, REASONS["extension"])
        else:
            out.files.append(path)
    out.files = sorted(set(out.files), key=os.fsencode)
    return out


def launch_paths(arguments: list[str]) -> list[str]:
    """Of the first hundred arguments those that are files."""
    return [a for a in arguments[:MAX_LAUNCH] if os.path.isfile(a)]


def local_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``pos, path, length, content, error_code, error``: a row a path, in order, repeats kept.

    Sizes are gated before anything is read: the bound is a filter of the file scan. Paths that are
    missing, links, folders or too large give rows with an error.
    """
    rows = []
    for pos, path in enumerate(paths):
        try:
            s = os.lstat(path)
        except OSError as error:
            rows.append((pos, path, 0, "Io", f"{ERRORS['Io']}{error}"))
            continue
        if stat.S_ISLNK(s.st_mode):
            rows.append((pos, path, 0, "Symlink", ERRORS["Symlink"] + path))
        elif not stat.S_ISREG(s.st_mode):
            rows.append((pos, path, 0, "InvalidFormat", ERRORS["InvalidFormat"] + "输入不是普通文件"))
        elif s.st_size > MAX_INPUT_BYTES:
            rows.append((pos, path, 0, "TooLarge", ERRORS["TooLarge"] + path))
        else:
            rows.append((pos, path, s.st_size, None, None))
    listed = spark.createDataFrame(rows, "pos bigint, path string, length bigint, error_code string, error string")
    good = sorted({r[1] for r in rows if r[3] is None})
    if not good:
        return listed.withColumn("content", F.lit(None).cast("binary"))
    found = spark.read.format("binaryFile").load([Path(p).absolute().as_uri().replace("[", "\\[").replace("{", "\\{").replace("*", "\\*") if set(p) & set("[{*") else Path(p).absolute().as_uri() for p in good])
    found = found.filter(F.col("length") <= MAX_INPUT_BYTES).select(local_path(F.col("path")).alias("absolute"), "content")
    names = spark.createDataFrame([(p, unquote(Path(p).absolute().as_posix())) for p in good], "path string, absolute string")
    return listed.join(names.join(found, "absolute").drop("absolute"), "path", "left")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """All supported files below a folder of any file system Spark reads, for corpora beyond one intake's bounds.

    Unlike :func:`expand` this follows links and leaves hidden names out, as Spark's listing does.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(F.col("length") <= MAX_INPUT_BYTES)
    return files.filter(formats.supported(formats.extension(formats.file_name(F.col("path"))))).select("path", "length", "content")
