"""A sink with a commit protocol: files are staged by tasks, become visible as one, and are put in place after that.

``candidates.write.format("spoorless_files").option("folder", ...).mode("append").save()`` stages bytes. A task
that fails, runs twice or is never committed leaves nothing that :func:`listing` tells of. :func:`publish` moves
what is committed to its places; it may run again, wholly or in part, and never writes second copies.
"""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..schemas import ERRORS, Options, Refused
from . import files

#: What a committed folder tells of each file.
LISTING = "pos bigint, path string, output_path string, backup_path string, staged string, output_size bigint, sha256 string"
PUBLISHED = "pos bigint, path string, output_path string, backup_path string, output_size bigint, success boolean, error_code string, error string"


def local(folder: str) -> str:
    """A folder as the file system of all machines knows it."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"files are written to a shared file system, not to {folder}")
    return "/" + folder.removeprefix("file:").lstrip("/")


@dataclass
class Staged(WriterCommitMessage):
    """The manifest of one task."""

    manifest: str


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = local(folder), uuid.uuid4().hex
        self.staging = posixpath.join(self.folder, "staging", self.job)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        """Stage each row's bytes in a file of this attempt's own, and tell of them in its manifest at the end."""
        task = TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}"
        os.makedirs(self.staging, exist_ok=True)
        manifest = posixpath.join(self.staging, f"{attempt}.json")
        with open(manifest, "w", encoding="utf-8") as told:
            k = 0
            for batch in iterator:
                for row in batch.to_pylist():
                    staged, data = posixpath.join(self.staging, f"{attempt}-{k}"), row["cleaned"]
                    with open(staged, "wb") as f:
                        f.write(data)
                        f.flush()
                        os.fsync(f.fileno())
                    k += 1
                    line = {c: row.get(c) for c in ("pos", "path", "output_path", "backup_path")} | {"staged": staged, "output_size": len(data), "sha256": hashlib.sha256(data).hexdigest()}
                    told.write(json.dumps(line) + "\n")
        return Staged(manifest)

    def commit(self, messages: list) -> None:
        """Gather the manifests of the attempts that count, a file a task, and show them by one rename."""
        hidden, shown = (posixpath.join(self.folder, "committed", f"{dot}{self.job}") for dot in (".", ""))
        os.makedirs(hidden)
        for message in messages:
            if message is not None:
                os.rename(message.manifest, posixpath.join(hidden, os.path.basename(message.manifest)))
        os.rename(hidden, shown)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class FilesSource(DataSource):
    """Rows of ``pos, path, output_path, backup_path, cleaned``; only ``output_path`` and ``cleaned`` must be there."""

    @classmethod
    def name(cls) -> str:
        return "spoorless_files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if missing := {"output_path", "cleaned"}.difference(schema.fieldNames()):
            raise ValueError(f"columns are missing: {sorted(missing)}")
        if overwrite:
            raise ValueError("files are added: mode('append')")
        return FilesWriter(self.options["folder"])


def stage(candidates: DataFrame, folder: str) -> None:
    """Write candidates and commit them, all or none."""
    candidates.sparkSession.dataSource.register(FilesSource)
    candidates.write.format("spoorless_files").option("folder", folder).mode("append").save()


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """All committed files of a folder; no rows if there are none."""
    committed = posixpath.join(local(folder), "committed")
    os.makedirs(committed, exist_ok=True)
    jobs = [e.path for e in os.scandir(committed) if not e.name.startswith(".")]  # an entry a commit
    return spark.read.schema(LISTING).json(jobs) if jobs else spark.createDataFrame([], LISTING)


def put(row: dict, options: Options) -> dict:
    """Move one staged file to its place, once: a file that isn't staged any more has been moved by an earlier run."""
    target, staged, source = Path(row["output_path"]), Path(row["staged"]), Path(row["path"] or row["output_path"])
    try:
        if staged.exists():
            if target.is_symlink():
                raise Refused("Symlink", str(target))
            target.parent.mkdir(parents=True, exist_ok=True)
            was = os.lstat(source) if source.exists() else None
            if was and row["backup_path"]:  # the source is still the old one, as long as its successor is staged
                files.write_atomically(Path(row["backup_path"]), source.read_bytes(), was, True, source)
            if was:
                files.copy_xattrs(source, str(staged), not options.remove_extended_attributes)
                if options.preserve_timestamps:
                    os.utime(staged, ns=(was.st_atime_ns, was.st_mtime_ns))
                os.chmod(staged, was.st_mode & 0o7777)
            os.replace(staged, target)
        elif not target.exists():
            return {"success": False, "error_code": "Io", "error": f"{ERRORS['Io']}{staged}"}
        return {"success": True, "error_code": None, "error": None}
    except Refused as refused:
        return {"success": False, "error_code": refused.code, "error": refused.text}
    except OSError as error:
        return {"success": False, "error_code": "Io", "error": f"{ERRORS['Io']}{error}"}


def publish(listed: DataFrame, options: Options = Options()) -> DataFrame:
    """Put committed files in their places, on the executors; a result a row, and the same if it runs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row | put(row, options) for row in batch.to_pylist()]
            kinds = {"pos": pa.int64(), "output_size": pa.int64(), "success": pa.bool_()}
            names = [f.split()[0] for f in PUBLISHED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)

    return listed.mapInArrow(run, PUBLISHED)
