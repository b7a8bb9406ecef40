"""Words, hashes and byte tables over Arrow columns: the small vectorised helpers that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a helper works on at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system: workers live on from task to task, and would keep what their largest task took."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def byte_table(lower: bool = True, separators: bytes = b"") -> np.ndarray:
    """256 bytes: A-Z become a-z when lower is set, and the separators become blanks; all others map to themselves."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 32
    return table


def utf8(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array with offsets from 0; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.string()), "")
    if not len(column):
        return column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = (column.buffers()[2] or pa.py_buffer(b""))[int(offsets[0]) : int(offsets[-1])]
    return pa.Array.from_buffers(pa.string(), len(column), [None, pa.py_buffer(offsets - offsets[0]), data])


def offsets_of(strings: pa.Array) -> np.ndarray:
    return np.frombuffer(strings.buffers()[1], dtype=np.int32)[: len(strings) + 1] if len(strings) else np.zeros(1, np.int32)


def bytes_of(strings: pa.Array) -> np.ndarray:
    """All bytes of the strings in a row, as the offsets count them."""
    data = strings.buffers()[2] if len(strings) else None
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def mapped(strings: pa.Array, table: np.ndarray) -> pa.Array:
    """The strings with each byte replaced by the table's; tables here change ASCII bytes only, so it stays UTF-8."""
    if not len(strings):
        return strings
    return pa.Array.from_buffers(pa.string(), len(strings), [None, strings.buffers()[1], pa.py_buffer(table[bytes_of(strings)])])


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches whose texts together take about `size` bytes."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        edges = np.flatnonzero(np.diff(np.cumsum(sizes) // size)) + 1
        for start, end in zip([0, *edges], [*edges, batch.num_rows]):
            if end > start:
                yield batch.slice(start, end - start)
                release()


def words(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words between blanks of ASCII (0x20, 0x09-0x0D): where each row's words begin (and the end), and the words."""
    if not len(strings):
        return np.zeros(1, np.int64), pa.array([], pa.string())
    found = pc.ascii_split_whitespace(strings)
    starts, flat = np.asarray(found.offsets, dtype=np.int64) - found.offsets[0].as_py(), found.flatten()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if full.all():
        return starts, flat
    before = np.concatenate([[0], np.cumsum(full)])
    return before[starts], flat.filter(pa.array(full))


def hashed(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process; each different string is hashed once."""
    coded = strings if pa.types.is_dictionary(strings.type) else strings.dictionary_encode()
    own = coded.dictionary.to_numpy(zero_copy_only=False)
    values = pd.util.hash_array(own, categorize=False).astype(np.uint64) if len(own) else np.zeros(0, np.uint64)
    return values[np.asarray(coded.indices)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rows_of(starts: np.ndarray) -> np.ndarray:
    """The row number of each item, from where each row's items begin."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def shingles(starts: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed shingles of `size` words of each row, in ascending order; a shorter row is one shingle, an empty row has none."""
    if len(hashes) == 0:
        return np.zeros(len(starts), np.int64), np.zeros(0, np.uint64)
    row, lengths = rows_of(starts), np.diff(starts)
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashes), np.uint64)
        for k in range(size):
            step = np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64)
            reach = len(hashes) - k
            if reach > 0:
                term = mixed(hashes[k:] + step)
                inside = (np.arange(reach) + k) < starts[row[:reach] + 1]
                total[:reach] += np.where(inside, term, np.uint64(0))
        total = mixed(total ^ np.uint64(size))
    position = np.arange(len(hashes)) - starts[row]
    keep = (position + size <= lengths[row]) | (position == 0)
    row, total = row[keep], total[keep]
    order = np.lexsort((total, row))
    row, total = row[order], total[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (total[1:] != total[:-1])
    row, total = row[first], total[first]
    return np.searchsorted(row, np.arange(len(starts))), total
