"""Work in blocks: texts are read in batches of bounded size, and batches ask hash buckets for what they can't know alone.

A batch sends each bucket one row with the different keys that it holds; the bucket's task sees the keys of all batches and sends
one row back. Keys that a batch holds often travel once, so a frequent key costs a bucket a row from each batch, never more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import SparkSession

from tessera.llm.text import SLICE_BYTES, release, slices

#: Buckets for each shuffle partition: more, so that the partitions even out.
BUCKETS_PER_PARTITION = 4


def bucket_count(spark: SparkSession) -> int:
    return BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of bounded size with numbers that rise in the order of reading: the partition's number first, then the slice's."""
    part = TaskContext.get().partitionId()
    for number, rows in enumerate(slices(batches, text, size)):
        yield (part << 32) + number, rows


def released(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """f of one table or two, after which freed memory goes back to the system."""

    def one(rows: pa.Table) -> pa.Table:
        out = f(rows)
        release()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        release()
        return out

    return one if f.__code__.co_argcount == 1 else two


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """The array's bytes, low ones of all values first, compressed; of ascending whole numbers the differences."""
    values = np.ascontiguousarray(values)
    if ascending and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T if len(values) else np.zeros((0, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind: type | np.dtype, ascending: bool = False) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    values = np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind) if len(raw) else np.zeros(0, kind)
    return np.cumsum(values, dtype=kind) if ascending else values


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns, and their length as the last entry."""
    count = len(columns[0])
    new = np.zeros(count, bool)
    if count:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), count)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then those from starts[1] on, and so forth."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def lists(values: pa.Array) -> pa.Array:
    """One list that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
