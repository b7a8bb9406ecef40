"""Grades of texts by ordinal regression: training on a bounded labelled sample, scoring of all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import ordinal
from tessera.llm.blocks import lists, pack, unpack
from tessera.llm.labelled import labelled_texts
from tessera.llm.text import slices, utf8

#: Turns texts into entries (row, column, value) of a sparse matrix; None for values that are all 1.
Features = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray | None]]


def train(docs: DataFrame, labels: DataFrame, grade: Column, features: Features, width: int, most: int, key: str = "doc_id", text: str = "text", **settings) -> ordinal.OrdinalModel:
    """Fits on the entries of at most `most` labelled documents, made on the executors.

    They come to the driver packed, a row for each batch, and are put in the order of the keys' hashes, so that the fit doesn't
    depend on how the rows are dealt.
    """
    sample = labelled_texts(docs, labels, grade, key, text, most).select("place.*", "grade", "text")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            row, column, value = features(utf8(part.column("text")))
            order = np.lexsort((column, row))
            sizes = np.bincount(row, minlength=part.num_rows).astype(np.uint32)
            packed = [pack(sizes), pack(column[order].astype(np.int32)), None if value is None else pack(value[order].astype(np.float32))]
            yield pa.RecordBatch.from_arrays([lists(part.column(c)) for c in ("hash", "key", "grade")] + [pa.array([x], pa.binary()) for x in packed], ["hash", "key", "grade", "sizes", "columns", "values"])

    rows = sample.mapInArrow(entries, "hash array<long>, key array<string>, grade array<int>, sizes binary, columns binary, `values` binary").collect()
    places = [(h, k, at, own, g) for at, r in enumerate(rows) for own, (h, k, g) in enumerate(zip(r.hash, r.key, r.grade))]
    sizes = [unpack(r.sizes, np.uint32).astype(np.int64) for r in rows]
    ends = [np.cumsum(s) for s in sizes]
    places.sort()
    starts = np.concatenate([[0], np.cumsum([sizes[at][own] for _, _, at, own, _ in places])]).astype(np.int64)
    columns = np.empty(starts[-1], np.int32)
    values = np.empty(starts[-1], np.float32) if any(r["values"] is not None for r in rows) else None
    to = {(at, own): n for n, (_, _, at, own, _) in enumerate(places)}
    for at, r in enumerate(rows):  # one batch unpacked at a time
        for held, name, kind in ((columns, "columns", np.int32), (values, "values", np.float32)):
            if held is not None:
                part = unpack(r[name], kind)
                for own, (end, size) in enumerate(zip(ends[at], sizes[at])):
                    n = to[at, own]
                    held[starts[n] : starts[n + 1]] = part[end - size : end]
    return ordinal.fit(starts, columns, values, np.array([g for *_, g in places], np.int64), width, **settings)


def grade(docs: DataFrame, model: ordinal.OrdinalModel, features: Features, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, score, tails (array: P(grade > k)) and expected (their sum). Null texts count as empty; repeated rows stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            row, column, value = features(utf8(part.column("text")))
            found = sent.value.scores(row, column, value, part.num_rows)
            tails = sent.value.tails(found)
            ends = pa.array((np.arange(part.num_rows + 1) * tails.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found), pa.ListArray.from_arrays(ends, pa.array(tails.ravel())), pa.array(tails.sum(axis=1))], ["key", "score", "tails", "expected"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(score, f"key {rows.schema['key'].dataType.simpleString()}, score double, tails array<double>, expected double").withColumnRenamed("key", key)
