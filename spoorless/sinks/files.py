"""Writing cleaned files: names, collisions, backups and atomic replacement."""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ERRORS, PRIVATE_XATTRS, Options, Refused

RESULT = "path string, output_path string, backup_path string, source_size bigint, output_size bigint, success boolean, error_code string, error string"
MAX_SUFFIX = 9_999


def cleaned_path(source: Path) -> Path:
    """``name.cleaned.ext`` beside the source."""
    return source.with_name(f"{source.stem or 'cleaned'}.cleaned{source.suffix if source.suffix != '.' else ''}")


def backup_path(source: Path) -> Path:
    return source.with_name(f"{source.name or 'backup'}.bak")


def unique_path(preferred: Path) -> Path:
    """The path, or the first of ``stem-2.ext`` to ``stem-9999.ext`` that isn't there; else the path."""
    if not preferred.exists():
        return preferred
    others = (preferred.with_name(f"{preferred.stem}-{k}{preferred.suffix}") for k in range(2, MAX_SUFFIX + 1))
    return next((p for p in others if not p.exists()), preferred)


def copy_xattrs(source: Path, target: str, private: bool) -> None:
    """Give a file the source's extended attributes, where both file systems have such; the private ones only if told to."""
    with contextlib.suppress(OSError, AttributeError):
        for name in os.listxattr(source):
            if private or name.removeprefix("user.") not in PRIVATE_XATTRS:
                with contextlib.suppress(OSError):
                    os.setxattr(target, name, os.getxattr(source, name))


def write_atomically(path: Path, data: bytes, source: os.stat_result | None, keep_times: bool, like: Path | None = None, keep_private: bool = True) -> None:
    """Write beside the target, then put it in its place; a link is refused. ``like`` gives extended attributes."""
    if path.is_symlink():
        raise Refused("Symlink", str(path))
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if like is not None:
            copy_xattrs(like, name, keep_private)
        if source and keep_times:
            os.utime(name, ns=(source.st_atime_ns, source.st_mtime_ns))
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    if source:
        os.chmod(path, source.st_mode & 0o7777)


def deliver(path: str, cleaned: bytes, options: Options) -> tuple:
    source = Path(path)
    backup = None
    try:
        was = os.lstat(source)
        if options.mode == "replace":
            backup = unique_path(backup_path(source))
            try:
                write_atomically(backup, source.read_bytes(), was, True, source)
            except (OSError, Refused) as error:
                return path, None, None, None, None, False, "Io", f"创建备份失败：{error}"
            target = source
        else:
            target = unique_path(cleaned_path(source))
    except OSError as error:
        return path, None, None, None, None, False, "Io", f"{ERRORS['Io']}{error}"
    try:
        write_atomically(target, cleaned, was, options.preserve_timestamps, source, not options.remove_extended_attributes)
    except (OSError, Refused) as error:
        code, text = (error.code, error.text) if isinstance(error, Refused) else ("Io", f"{ERRORS['Io']}{error}")
        return path, None, str(backup) if backup else None, was.st_size, None, False, code, text
    return path, str(target), str(backup) if backup else None, was.st_size, len(cleaned), True, None, None


def write(candidates: DataFrame, options: Options = Options()) -> DataFrame:
    """Write the verified candidates of :func:`operators.engine.clean`; a result a row.

    Files of one folder and stem are written by one task, in order, so that their names can't collide.
    The paths must be reachable from every executor. Run it once, with speculation off, and keep what
    it returns: a second evaluation would write second copies.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [deliver(p.as_py(), c.as_py(), options) for p, c in zip(batch.column("path"), batch.column("cleaned"), strict=True)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string())
            names = [f.split()[0] for f in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    good = candidates.filter("success").select("path", "cleaned")
    group = F.regexp_replace("path", r"[.][^./\\]*$", "")
    written = good.repartition(F.xxhash64(group)).sortWithinPartitions("path").mapInArrow(run, RESULT)
    failed = candidates.filter("NOT success").select("path", *[F.lit(None).cast("string").alias(c) for c in ("output_path", "backup_path")], *[F.lit(None).cast("bigint").alias(c) for c in ("source_size", "output_size")], "success", "error_code", "error")
    return written.unionByName(failed)
