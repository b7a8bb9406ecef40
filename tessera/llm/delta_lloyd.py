"""Centroid clustering by delta Lloyd: exact k-means in integers that redoes only what a moved centroid can change.

Assignments (owner and distance of every vector) are kept as a table, and the sums of each cluster on the driver. A round compares a
vector whose owner stayed with the centroids that moved, and a vector whose owner moved with all of them. Only vectors that change
hands are summed: what they take from one cluster and bring to another, as signed integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize, new_path, removed

RESULT = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
_NONE = -1


@dataclass
class Centroids:
    """k rows of whole numbers; moved: which of them differ from the round before."""

    at: np.ndarray
    moved: np.ndarray


def most(size: int) -> int:
    """The largest component for which squared distances of `size` components fit in 63 bits; 2**27 for 64 of them."""
    return min(math.isqrt((2**63 - 1) // (4 * size)), 2**27)


def integers(vector: Column, size: int, scale: int = 64) -> Column:
    """floor(scale * x) of each component x as double. One past `most` is an error: distances would not fit."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    error = F.raise_error(F.lit(f"a component times {scale} is over {most(size)}")).cast("int")
    return F.transform(vector, lambda x: F.when(F.abs(scaled(x)) > most(size), error).otherwise(F.floor(scaled(x)).cast("int")))


def whole(vector: Column, size: int) -> Column:
    """Whether the vector has `size` components, none null, infinite or not a number."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(vector) == size) & ~F.exists(vector, odd), F.lit(False))


def nearest(vectors: np.ndarray, owner: np.ndarray, distance: np.ndarray, now: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid and squared distance, the smaller number of two that are as near.

    What owner and distance tell of the centroids that stayed is used, not computed again; owner _NONE knows nothing.
    """
    owner, distance = owner.copy(), distance.copy()
    fresh = (owner == _NONE) | now.moved[owner]
    distance[fresh], owner[fresh] = np.iinfo(np.int64).max, _NONE
    all_rows = np.arange(len(vectors))
    for k in range(len(now.at)):
        rows = all_rows if now.moved[k] else np.flatnonzero(fresh)  # a vector whose owner stayed needs only those that moved
        if not len(rows):
            continue
        gap = vectors[rows] - now.at[k]
        found = np.einsum("ij,ij->i", gap, gap)
        better = (found < distance[rows]) | ((found == distance[rows]) & (k < owner[rows]))
        distance[rows[better]], owner[rows[better]] = found[better], k
    return owner, distance


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, size)


def _assigned(state: DataFrame, now: Centroids, size: int) -> DataFrame:
    """state with each row's owner and distance brought up to date, and the owner before."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            before = np.asarray(rows.column("owner")).astype(np.int64)
            owner, distance = nearest(_matrix(rows.column("v"), size), before, np.asarray(rows.column("distance")), now)
            columns = {"key": rows.column("key"), "v": rows.column("v"), "owner": pa.array(owner, pa.int32()), "before": pa.array(before, pa.int32()), "changed": pa.array(owner != before), "distance": pa.array(distance)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = state.select("key", "v", "owner", "before", F.lit(False).alias("changed"), "distance").schema
    return state.mapInArrow(assign, kind)


def _transfers(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed hands bring to each cluster, less what they take: sums of components, and numbers of vectors.

    Each task sends a row for each cluster; k * (size + 1) numbers come to the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, size + 1), np.int64)
        for rows in batches:
            own = np.hstack([_matrix(rows.column("v"), size), np.ones((rows.num_rows, 1), np.int64)])
            for side, sign in (("owner", 1), ("before", -1)):
                at = np.asarray(rows.column(side))
                for c in np.unique(at[at != _NONE]):
                    sums[c] += sign * own[at == c].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = state.where("changed").select("v", "owner", "before").mapInArrow(add, "cluster int, sums array<long>")
    total = parts.select("cluster", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = np.zeros((k, size + 1), object)
    for row in total.collect():
        out[row.cluster, row.place] = int(row.total)
    return out[:, :-1], out[:, -1]


def start(state: DataFrame, k: int, seed: int, name: str) -> np.ndarray:
    """The k vectors with the smallest hashes of `seed:name`, in ascending order; those with a null name can't be taken. Ties go by components."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key")[name].cast("string")), 256)
    first = state.select(hashed.alias("h"), "v").where("h is not null").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def cluster(vectors: DataFrame, name: str = "vec_id", vector: str = "embedding", size: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> DataFrame:
    """The other columns of each kept row with cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Rows whose vector is null, of another size, or holds a null or a component that isn't finite are left out. Components become
    floor(scale * x). Each round assigns every vector to the nearest centroid and moves every centroid that has vectors to the floor
    of their mean; after the rounds the vectors are assigned once more. Repeated rows are vectors of their own, and may start two
    centroids. A null name never starts one. With fewer than k names there are so many centroids; an empty table, or one without a
    name, gives no rows. A column of the input that is named like one of the result gives way to it. A component past 2**27 / scale
    (less for more than 127 components) is an error: squared distances would not fit. k * size numbers are sent to the tasks and come back; nothing else is collected.
    """
    spark = vectors.sparkSession
    others = [c for c in vectors.columns if c != vector and (c not in RESULT or c == name)]
    held = vectors.where(whole(F.col(f"`{vector}`"), size))
    none = F.lit(_NONE)
    state = held.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("key"), integers(F.col(f"`{vector}`"), size, scale).alias("v"), none.alias("owner"), none.alias("before"), F.lit(0).cast("long").alias("distance"))
    state = materialize(state, "lloyd-vectors")
    at = start(state, k, seed, name)
    now, sums, counts, path = Centroids(at, np.ones(len(at), bool)), np.zeros((len(at), size), object), np.zeros(len(at), object), None
    out = [F.col("key")[c].alias(c) for c in others if c not in RESULT or c == name]
    if not len(at):
        return state.limit(0).select(*out, F.lit(0).alias("cluster"), "distance", *[F.lit(0).cast("long").alias(c) for c in RESULT[2:4]], F.lit("").alias(RESULT[4]))
    for turn in range(rounds + 1):
        last, path = path, new_path(spark, "lloyd")
        state = materialize(_assigned(state, now, size), "lloyd", path=path)
        if last:
            removed(spark, last)
        if turn == rounds:
            break
        moved_sums, moved_counts = _transfers(state, len(at), size)
        sums, counts = sums + moved_sums, counts + moved_counts
        new = np.array([[s // n for s in row] if n else now.at[c].tolist() for c, (row, n) in enumerate(zip(sums.tolist(), counts.tolist()))], np.int64)
        now = Centroids(new, (new != now.at).any(axis=1))
    names = F.array(*[F.lit(hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for row in now.at.tolist()])
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    each = state.groupBy("owner").agg(total("distance").alias("cluster_inertia"))
    whole_ = each.agg(total("cluster_inertia").cast("long").alias("inertia"))
    facts = F.broadcast(each.withColumn("cluster_inertia", F.col("cluster_inertia").cast("long")).crossJoin(F.broadcast(whole_)))  # k rows at most, beside one
    return state.join(facts, "owner").select(*out, F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", names[F.col("owner")].alias("centroid_sha256"))
