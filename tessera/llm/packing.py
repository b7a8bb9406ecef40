"""Concatenate and cut: token sequences of one fixed length, with a record at every boundary."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.encoding import WORD_BPE, encoder
from tessera.llm.scratch import materialize
from tessera.llm.text import slices, utf8

SEQUENCE = 2048
END_ID = 1


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = WORD_BPE, end_id: int = END_ID) -> DataFrame:
    """First pass. Each row's ids (end_id last) as little-endian bytes, its partition, and the ids before it in that partition.

    Null and empty texts have end_id alone. Repeated keys stay separate rows. Only key and text are kept of the columns.
    The table is written once: both passes then see one order, whatever is computed again later.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for rows in slices(batches):
            use = encoder(tokenizer)
            starts, ids = use.encode(utf8(rows.column("text")))
            ids = np.insert(ids, starts[1:], use.dtype.type(end_id))
            starts = starts + np.arange(len(starts))
            width, count = use.dtype.itemsize, rows.num_rows
            packed = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer((starts * width).astype(np.int32)), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [rows.column("key"), pa.array(np.full(count, part, np.int32)), pa.array(before + starts[:-1]), pa.array(np.diff(starts)), pa.array(np.full(count, width, np.int32)), packed],
                names=["key", "part", "before", "n_ids", "width", "ids"],
            )
            before += int(starts[-1])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(encode, f"key {rows.schema['key'].dataType.simpleString()}, part int, before long, n_ids long, width int, ids binary"), "packing-ids")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, tokenizer: str = WORD_BPE, end_id: int = END_ID) -> DataFrame:
    """Pieces of all texts in fixed sequences: sequence g // L at offset g % L holds the id with global number g.

    A row for each piece: key, start (its document's ids before it), length, ids (array), doc_tokens, sequence_id, offset.
    Second pass: sums over the partitions' totals say where each partition begins, and each text is cut at multiples of L.
    The totals are one small row for each partition of the first pass; no text or id leaves its partition.
    An empty table gives no pieces; a very long text is encoded whole, in a slice of its own. key may have any name but those of the
    other columns here. All sequences but the last are full, so padding is under one sequence in all.
    """
    rows = encoded(docs, key, text, tokenizer, end_id)
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "ids"):
                begin, count = np.asarray(part.column("begin")), np.asarray(part.column("n_ids"))
                first, last = begin // sequence, (begin + count - 1) // sequence
                pieces = last - first + 1
                row = np.repeat(np.arange(len(begin)), pieces)
                number = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                low, high = np.maximum(begin[row], number * sequence), np.minimum((begin + count)[row], (number + 1) * sequence)
                width = int(part.column("width")[0].as_py())
                data = np.frombuffer(b"".join(part.column("ids").to_pylist()), f"<u{width}").astype("<u4")
                at = (np.cumsum(count) - count)[row] + low - begin[row]
                ends = np.cumsum(high - low)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(row)), pa.array(low - begin[row]), pa.array(high - low),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(data.view("<i4"))),
                     pa.array([zlib.crc32(data[s : s + n].data) for s, n in zip(at.tolist(), (high - low).tolist())], pa.int64()),
                     pa.array(count[row]), pa.array(number), pa.array(low - number * sequence)],
                    names=[key, "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    # one row for each partition of the first pass: their number is the bound on what is broadcast
    placed = rows.join(F.broadcast(bases), "part").select("key", (F.col("base") + F.col("before")).alias("begin"), "n_ids", "width", "ids")
    kind = rows.schema["key"].dataType.simpleString()
    return placed.mapInArrow(cut, f"`{key}` {kind}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long")


def sequences(pieces: DataFrame, sequence: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """The padded sequences themselves: sequence_id, ids (array of L ints). At most L pieces meet in a group."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(ordered, lambda p: p["ids"]))
    return pieces.groupBy("sequence_id").agg(ids.alias("ids")).select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(sequence) - F.size("ids"))).alias("ids"))
