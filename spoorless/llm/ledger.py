"""Documents in bounded blocks whose different keys are looked up in corpus-wide totals once a block.

A task tells, of a block of documents, a row a document (``what`` is 'document') and a row for each of the block's
different keys with its slot and count (``what`` is 'entry'). Totals are grouped over blocks, and each block gets those of its own keys back. So a key that all
documents hold comes once a block, not once a document, and nothing is broadcast.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import shared_folder

#: Characters and documents of a block, about; a longer document is a block of its own.
BLOCK_CHARS, BLOCK_DOCUMENTS = 4_000_000, 20_000


def blocks(batches: Iterator[pa.RecordBatch], column: int, chars: int = BLOCK_CHARS) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a task in blocks, each with a number of its own, by the size of a column of texts."""
    number, held, size, rows = TaskContext.get().partitionId() << 32, [], 0, 0

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        lengths = np.nan_to_num(pc.utf8_length(batch.column(column)).to_numpy(zero_copy_only=False)).astype(np.int64)
        begin = 0
        for k, length in enumerate(lengths.tolist()):
            if size and (size + length > chars or rows >= BLOCK_DOCUMENTS):
                if k > begin:
                    held.append(batch.slice(begin, k - begin))
                yield number, whole()
                number, held, size, rows, begin = number + 1, [], 0, 0, k
            size += length
            rows += 1
        if len(lengths) > begin:
            held.append(batch.slice(begin))
    if held:
        yield number, whole()


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on as bytes, of the width that the largest needs, which is the first byte."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or values.max() < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def written(rows: DataFrame) -> DataFrame:
    """Write rows once, as a compressed table in the shared folder, and read them from there."""
    out = posixpath.join(shared_folder(rows.sparkSession), f"blocks-{uuid.uuid4().hex}.parquet")
    rows.write.option("compression", "zstd").parquet(out)
    return rows.sparkSession.read.schema(rows.schema).parquet(out)


def batch(what: str, size: int, columns: dict, fields: list[pa.Field]) -> pa.RecordBatch:
    """Rows of one kind; columns that the kind doesn't have are null."""
    columns = {"what": pa.array([what] * size, pa.string()), **columns}
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in fields], names=[f.name for f in fields])


def fields_of(schema: str) -> list[pa.Field]:
    return list(to_arrow_schema(StructType.fromDDL(schema)))


def entries(told: DataFrame, *more: str) -> DataFrame:
    """``block, slot, key, n`` of the different keys of all blocks, and more columns that keys have."""
    return told.filter("what = 'entry'").select("block", "slot", "key", "n", *more)


def looked_up(told: DataFrame, found: DataFrame, finish, schema: str) -> DataFrame:
    """Give ``finish(documents, found)`` each block's documents and what was found for its keys, as tables."""
    documents = told.filter("what = 'document'").drop("what", "slot", "key", "n")
    found = found.select(*[F.col(c).alias("of_block" if c == "block" else c) for c in found.columns])  # another column than the documents'
    return documents.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(finish, schema)
