"""Approximate nearest vectors by cells: vectors lie with the nearest of some centres, and a query looks into a few cells only.

The centres are fitted on a bounded sample; every vector is indexed. Distances within the cells that are looked into are exact, and
with all cells the result is `vectors.nearest`'s. How many cells are enough is measured against that, not guessed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import vectors as exact
from tessera.sources.tables import new_path, written

#: Vectors for each centre that are fitted, rounds of fitting, and the most centres.
SAMPLE, ROUNDS, MOST_CELLS = 64, 12, 16_384
#: Folders that the cells are dealt over, and queries that all tasks get at once.
SHARDS, QUERY_BLOCK = 32, 10_000
#: Distances between points and centres that are held at once.
TABLE = 1 << 21


@dataclass
class Index:
    """rows: (shard, cell, key, vector); centres: one row for each cell."""

    rows: DataFrame
    centres: np.ndarray
    key: str


def _distances(one: np.ndarray, two: np.ndarray, product: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.matmul) -> np.ndarray:
    """Squared distances of all pairs, good enough to tell cells by."""
    return np.maximum((one * one).sum(axis=1)[:, None] - 2 * product(one, two.T) + (two * two).sum(axis=1), 0)


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of a sample: its first vectors, moved to the means of those nearest to them. A centre without vectors stays."""
    at = sample[:cells].copy()
    for _ in range(ROUNDS):
        own = nearest_centre(sample, at)
        order = np.argsort(own, kind="stable")
        held, begin, count = np.unique(own[order], return_index=True, return_counts=True)
        at[held] = np.add.reduceat(sample[order], begin) / count[:, None]
    return at


def nearest_centre(points: np.ndarray, centres: np.ndarray, product: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.matmul) -> np.ndarray:
    """The centre of each point; so many points at once that their table of distances stays small."""
    some = max(1, TABLE // max(len(centres), 1))
    return np.concatenate([_distances(points[p : p + some], centres, product).argmin(axis=1) for p in range(0, len(points), some)] or [np.zeros(0, np.int64)])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, size)


def build(vectors: DataFrame, size: int, cells: int | None = None, key: str = "vec_id", vector: str = "embedding", path: str | None = None) -> Index:
    """Fits centres on SAMPLE * cells vectors, the first by a hash of the key, and writes every vector of `size` finite components with its cell.

    cells: four times the root of the vectors' number, MOST_CELLS at most. Vectors that are null, of another size or hold a null or
    a component that isn't finite have no distances and are not indexed. The centres go to all tasks.
    """
    spark, path = vectors.sparkSession, path or new_path(vectors.sparkSession, "cells")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where((F.size("vector") == size) & ~F.coalesce(odd, F.lit(True)))
    count = rows.count()
    cells = min(cells or 4 * int(np.sqrt(max(count, 1))), MOST_CELLS, max(count, 1))
    first = rows.orderBy(F.xxhash64(F.col("key")), "key").limit(SAMPLE * cells).select("vector").toArrow()
    centres = fit(_matrix(first["vector"].combine_chunks(), size), cells) if first.num_rows else np.zeros((0, size))
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = nearest_centre(_matrix(batch.column("vector"), size), sent.value, exact.product)
            yield pa.RecordBatch.from_arrays([pa.array(cell % SHARDS, pa.int32()), pa.array(cell, pa.int32()), batch.column("key"), batch.column("vector")], ["shard", "cell", "key", "vector"])

    kind = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("cell", T.IntegerType()), *rows.schema.fields])
    rows.repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(assign, kind).sortWithinPartitions("shard", "cell").write.partitionBy("shard").parquet(f"{path}/rows")
    spark.createDataFrame([(n, c.tolist()) for n, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    return load(spark, path, key)


def load(spark: SparkSession, path: str, key: str = "vec_id") -> Index:
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").toPandas()["centre"]
    rows = spark.read.parquet(f"{path}/rows") if len(centres) else None
    return Index(rows, np.array(centres.tolist(), float), key)


def nearest(queries: DataFrame, index: Index, k: int, probes: int, query_id: str = "query_id") -> DataFrame:
    """(query_id, key, distance, rank): the k nearest vectors in the `probes` cells that are nearest to each query (query_id, qvec); ties by key.

    Queries are a stated set: QUERY_BLOCK of them come to the driver and go to all tasks at once. Only folders of cells that some
    query looks into are read; vectors stay where they are, and each task sends k of a query at most. Queries of another size or
    with a component that isn't finite find nothing.
    """
    spark, count = queries.sparkSession, queries.count()
    passes = 1 if count <= QUERY_BLOCK else -(-2 * count // QUERY_BLOCK)
    found = None
    for p in range(passes):
        part = queries if passes == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(passes)) == p)
        one = _nearest(part, index, k, probes, query_id, spark)
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy(query_id).orderBy(F.round("distance", 9), index.key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def _nearest(queries: DataFrame, index: Index, k: int, probes: int, query_id: str, spark: SparkSession) -> DataFrame:
    asked = queries.select(query_id, "qvec").toArrow()
    size = index.centres.shape[1] if index.centres.ndim == 2 else 0
    kept = [n for n, v in enumerate(asked["qvec"].to_pylist()) if v is not None and len(v) == size and None not in v and np.isfinite(v).all()]
    ids, own = asked[query_id].combine_chunks().take(pa.array(kept, pa.int64())), asked["qvec"].combine_chunks().take(pa.array(kept, pa.int64()))
    key_type = index.rows.schema["key"].dataType if index.rows is not None else T.LongType()
    kind = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(index.key, key_type), T.StructField("distance", T.DoubleType())])
    if not kept or index.rows is None:
        return spark.createDataFrame([], kind)
    points = _matrix(own, size)
    probes = min(probes, len(index.centres))
    bits = None if probes == len(index.centres) else _looked(points, index.centres, probes)
    sent, name = spark.sparkContext.broadcast((points, bits, ids)), index.key

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, bits, ids = sent.value
        best, every = exact.Best(len(points), k), np.arange(len(points))
        for batch in batches:
            cell = np.asarray(batch.column("cell")) if bits is not None else np.zeros(batch.num_rows, np.int64)  # all cells are as one
            order = np.argsort(cell, kind="stable")
            edges = np.flatnonzero(np.diff(cell[order], prepend=-1))
            matrix = _matrix(batch.column("vector"), size)
            for begin, end in zip(edges, [*edges[1:], len(order)]):
                rows = order[begin:end]
                own = every if bits is None else np.flatnonzero(np.unpackbits(bits[cell[rows[0]]], count=len(points)))
                if len(own):
                    best.add(own, points[own], np.zeros(len(own), bool), matrix[rows], np.zeros(len(rows), bool), batch.column("key").take(pa.array(rows)))
        found = best.cut()
        if found is not None:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(found[0])), found[2], pa.array(found[1])], [query_id, name, "distance"])

    shards = sorted({int(c) % SHARDS for c in (range(len(index.centres)) if bits is None else np.flatnonzero(bits.any(axis=1)))})
    return index.rows.where(F.col("shard").isin(shards)).select("cell", "key", "vector").mapInArrow(look, kind)


def _looked(points: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """For each cell, a bit for each point that looks into it."""
    bits, some = np.zeros((len(centres), -(-len(points) // 8)), np.uint8), max(8, TABLE // len(centres) // 8 * 8)
    for p in range(0, len(points), some):
        near = np.argpartition(_distances(points[p : p + some], centres), probes - 1, axis=1)[:, :probes]
        held = np.zeros((len(centres), len(near)), bool)
        held[near, np.arange(len(near))[:, None]] = True
        packed = np.packbits(held, axis=1)
        bits[:, p // 8 : p // 8 + packed.shape[1]] = packed
    return bits


def recall(found: DataFrame, right: DataFrame, key: str = "vec_id", query_id: str = "query_id") -> float:
    """The share of the right rows (query_id, key) that were found; 1 for none."""
    row = right.select(query_id, key).join(found.select(query_id, key, F.lit(1).alias("hit")), [query_id, key], "left").agg(F.count("*").alias("n"), F.count("hit").alias("h")).first()
    return row.h / row.n if row.n else 1.0


def probes_for(queries: DataFrame, index: Index, vectors: DataFrame, k: int, least: float = 0.9, vector: str = "embedding", query_id: str = "query_id", right: DataFrame | None = None) -> tuple[int, float]:
    """The smallest power of two of cells (all at most) with which the queries' measured recall is `least` or more, and that recall.

    right: what `vectors.nearest` gave for these queries, if it is there already.
    """
    right = written(exact.nearest(queries, vectors, k, key=index.key, query_id=query_id, vector=vector), "right") if right is None else right
    probes = 1
    while True:
        told = recall(nearest(queries, index, k, probes, query_id), right, index.key, query_id)
        if told >= least or probes >= len(index.centres):
            return min(probes, max(len(index.centres), 1)), told
        probes *= 2
