"""Comparing the rows of buckets piece by piece, each pair once, inside sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width

_BIG = np.iinfo(np.int64).max


def deal(members: DataFrame, sizes: DataFrame, piece: int) -> DataFrame:
    """Deal ``bucket, rid`` rows, with ``bucket, size``, over cells of two chunks of about ``piece`` rows.

    A bucket of one chunk has one cell. Each row of a larger one goes to the cells of its chunk with every
    chunk, so each pair stands in exactly one cell, and no cell grows with the bucket.
    """
    chunks = sizes.select("bucket", F.ceil(F.col("size") / piece).cast("int").alias("chunks"))
    dealt = members.join(chunks, "bucket").withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cell = F.least("chunk", "_other").cast("long") * (1 << 20) + F.greatest("chunk", "_other")
    return dealt.withColumn("cell", cell).drop("chunks", "_other")


def in_groups(rows: DataFrame) -> DataFrame:
    keys = ("bucket", "cell")
    return rows.repartition(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of equal keys of a sorted partition, one table each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys])
        starts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *starts], [*starts, batch.num_rows], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def lists(table: pa.Table, name: str) -> list[np.ndarray]:
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def own_pairs(close: np.ndarray, chunk: np.ndarray, cell: int, buckets: list[np.ndarray], this: int) -> np.ndarray:
    """Of the close pairs those of this cell that share no smaller bucket, where they count already."""
    np.fill_diagonal(close, False)
    left, right = divmod(cell, 1 << 20)
    if left != right:
        close &= chunk[:, None] != chunk[None, :]
    used = np.flatnonzero(close.any(1))
    lower = [np.sort(buckets[i]) for i in used]
    lower = [b[: np.searchsorted(b, this)] for b in lower]
    if used.size and sum(map(len, lower)):
        pool, place = np.unique(np.concatenate(lower), return_inverse=True)
        member = np.zeros((len(used), len(pool)), np.float32)
        member[np.repeat(np.arange(len(used)), [len(x) for x in lower]), place] = 1
        close[np.ix_(used, used)] &= (member @ member.T) == 0
    return close


def roots(close: np.ndarray, rid: np.ndarray) -> np.ndarray:
    """The smallest rid that each row reaches over close pairs."""
    root = rid.copy()
    while True:
        new = np.minimum(root, np.where(close, root[None, :], _BIG).min(1, initial=_BIG))
        if (new == root).all():
            return root
        root = new


def marked(rows: DataFrame, likely: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """``bucket, rid`` of the rows for which ``likely`` holds with another one of their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for table in groups(batches, ("bucket", "cell")):
            if table.num_rows > 1 and (some := likely(table).any(1)).any():
                found.append((table.column("bucket").to_numpy()[some], table.column("rid").to_numpy()[some]))
            if len(found) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["bucket", "rid"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["bucket", "rid"])

    return in_groups(rows).mapInArrow(run, "bucket long, rid long")


def compare(rows: DataFrame, closeness: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """``rid, links, root`` of rows linked inside a cell, from ``bucket, cell, chunk, rid, n, buckets, ...``.

    ``closeness`` gives the matrix of pairs of a cell that are to be linked. ``links`` counts each
    partner with its ``n`` copies, and ``root`` is the smallest rid reached inside the cell. A pair is
    counted only in the smallest of the ``buckets`` that both share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        for table in groups(batches, ("bucket", "cell")):
            if table.num_rows < 2:
                continue
            this, cell = table.column("bucket")[0].as_py(), table.column("cell")[0].as_py()
            close = own_pairs(closeness(table), table.column("chunk").to_numpy(), cell, lists(table, "buckets"), this)
            if not close.any():
                continue
            rid = table.column("rid").to_numpy()
            some = close.any(1)
            found.append((rid[some], (close @ table.column("n").to_numpy())[some], roots(close, rid)[some]))
            if len(found) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], names=["rid", "links", "root"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], names=["rid", "links", "root"])

    return in_groups(rows).mapInArrow(run, "rid long, links long, root long")
