"""Exact nearest vectors for a stated set of queries, and content filters that give way when they leave nothing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query vectors, and bytes of them, that are held against all rows at once. More queries go in several blocks.
QUERY_BLOCK, BLOCK_BYTES = 20_000, 64 << 20
#: Queries, or rows, of one product of matrices, and pairs whose differences are summed at once.
SIDE, PAIRS = 1024, 65_536


def squared_distance(one: Column, two: Column) -> Column:
    """Sum of squared differences as double; null where the lengths differ."""
    gap = F.zip_with(one, two, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(one) == F.size(two), F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))


def matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of the lists: their places and a matrix of them, with NaN for null. Null lists are left out."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), -1)).astype(np.int64)
    out = {}
    for n in np.unique(size[size >= 0]):
        at = np.flatnonzero(size == n)
        values = pc.cast(column.take(pa.array(at)).flatten(), pa.float64()).to_numpy(zero_copy_only=False)
        out[int(n)] = at, values.reshape(len(at), n)
    return out


def holes(column: pa.Array) -> np.ndarray:
    """Which lists hold a null."""
    out = np.zeros(len(column), bool)
    gone = np.asarray(pc.is_null(column.flatten()))
    if gone.any():
        out[np.unique(np.asarray(pc.list_parent_indices(column))[gone])] = True
    return out


def product(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """one @ two without BLAS: every core has a task of its own, and BLAS would start threads for each of them, which get in each other's way."""
    return np.einsum("ij,kj->ik", one, np.ascontiguousarray(two.T))


class Best:
    """The k nearest rows that a task has met for each of its queries, by distance (to nine places), then key.

    A product of matrices tells which pairs can be among them; for those alone the differences are squared and summed, in order. A
    pair with a null component is nearer than all others, as null sorts first; its distance here is minus infinity.
    """

    def __init__(self, count: int, k: int):
        self.k, self.worst = k, np.full(count, np.inf)
        self.query, self.distance, self.keys, self.size = [], [], [], 0

    def add(self, queries: np.ndarray, points: np.ndarray, open_: np.ndarray, rows: np.ndarray, open_rows: np.ndarray, keys: pa.Array) -> None:
        """queries: numbers of the points, each once. open_ and open_rows: which of the points and of the rows hold a null."""
        with np.errstate(all="ignore"):
            for r in range(0, len(rows), SIDE):
                part = slice(r, r + SIDE)
                lengths = (rows[part] * rows[part]).sum(axis=1)
                for q in range(0, len(queries), SIDE):
                    own = slice(q, q + SIDE)
                    self._add(queries[own], points[own], open_[own], rows[part], open_rows[part], lengths, keys.slice(r, SIDE))

    def _add(self, queries: np.ndarray, points: np.ndarray, open_: np.ndarray, rows: np.ndarray, open_rows: np.ndarray, lengths: np.ndarray, keys: pa.Array) -> None:
        error = 1e-15 * (points.shape[1] + 8)  # of a sum of products, in units of the lengths
        own = (points * points).sum(axis=1)
        low = product(points, -2 * rows.T)
        low += lengths * (1 - error)
        low += (own * (1 - error))[:, None]
        low[:, open_rows] = -np.inf
        low[open_] = -np.inf
        near = ~(low > self.worst[queries, None] + 2e-9)  # what isn't a number goes on
        if np.count_nonzero(near) > 4 * self.k * len(queries) and len(rows) > self.k:
            most = np.partition(low, self.k - 1, axis=1)[:, self.k - 1] + 2 * error * (own + lengths.max()) + 2e-9
            self.worst[queries] = np.fmin(self.worst[queries], most)
            near = ~(low > self.worst[queries, None] + 2e-9)
        a, b = np.nonzero(near)
        for begin in range(0, len(a), PAIRS):
            one, two = a[begin : begin + PAIRS], b[begin : begin + PAIRS]
            gap = rows[two] - points[one]
            distance = (gap * gap).cumsum(axis=1)[:, -1] if gap.shape[1] else np.zeros(len(one))
            distance[open_[one] | open_rows[two]] = -np.inf
            good = ~(distance > self.worst[queries[one]] + 2e-9)
            self.query.append(queries[one[good]])
            self.distance.append(distance[good])
            self.keys.append(keys.take(pa.array(two[good])))
            self.size += int(good.sum())
            if self.size > 3 * self.k * len(self.worst) + 2 * PAIRS:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        """Drops all but the best, and tells them: queries, distances and keys."""
        if not self.query:
            return None
        query, distance, keys = np.concatenate(self.query), np.concatenate(self.distance), pa.concat_arrays(self.keys)
        by_key = np.empty(len(keys), np.int64)
        by_key[np.asarray(pc.sort_indices(keys))] = np.arange(len(keys))
        order = np.lexsort((by_key, np.round(distance, 9), query))
        first = np.searchsorted(query[order], query[order])
        place = np.arange(len(order)) - first
        last = order[place == self.k - 1]
        self.worst[query[last]] = np.fmin(self.worst[query[last]], distance[last] + 1e-9)
        order = order[place < self.k]
        query, distance, keys = query[order], distance[order], keys.take(pa.array(order))
        self.query, self.distance, self.keys, self.size = [query], [distance], [keys], len(query)
        return query, distance, keys


def shown(distance: np.ndarray) -> pa.Array:
    return pa.array(distance, pa.float64(), mask=np.isneginf(distance), from_pandas=False)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", allowed: Column | None = None, prefer: Column | None = None, flag: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, key, distance, rank): the k nearest rows of each query, ties (to nine places) by key. queries: query_id and qvec.

    The queries are a stated set, sent to all tasks; the vectors are dealt over all cores once, and each task sends k rows of a query
    at most (of either kind, with flag). Queries are counted first; more than QUERY_BLOCK of them, or BLOCK_BYTES, go in blocks by
    the hash of query_id, each of which reads the vectors once; one query_id with more rows than that is an error.
    allowed: a filter over columns of vectors and queries (all columns of queries can be used). prefer: such a condition that gives
    way: a query gets the nearest of the rows that meet it, or, where none does, of all rows; null is not met. Both are judged for
    each pair. flag: a preference that isn't: an array<boolean> of vectors, and a number of queries that says which of its places must hold.
    """
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * F.greatest(F.size("qvec"), F.lit(0))), F.lit(0)).alias("b")).first()
    blocks = max(-(-2 * size.n // QUERY_BLOCK), -(-2 * size.b // BLOCK_BYTES))  # about half full, for hashes are uneven
    pairs = allowed is not None or prefer is not None
    one = (lambda p: _nearest(p, vectors, k, key, query_id, vector, allowed, prefer)) if pairs else (lambda p: _by_products(p, vectors, k, key, query_id, vector, flag))
    if blocks > 2:
        return reduce(DataFrame.unionByName, [one(queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)) for b in range(blocks)])
    return one(queries)


def _by_products(queries: DataFrame, vectors: DataFrame, k: int, key: str, query_id: str, vector: str, flag: tuple[str, str] | None) -> DataFrame:
    spark = queries.sparkSession
    place = F.col(flag[1]).cast("int") if flag else F.lit(None).cast("int")
    rows = queries.select(query_id, "qvec", F.coalesce(place, F.lit(-1)).alias("place")).limit(QUERY_BLOCK + 1).toArrow()
    if len(rows) > QUERY_BLOCK:
        raise ValueError(f"more than {QUERY_BLOCK} queries at once")
    ids, asked = rows[query_id].combine_chunks(), rows["qvec"].combine_chunks()
    sent = spark.sparkContext.broadcast((ids, matrices(asked), holes(asked), np.asarray(rows["place"]).astype(np.int64)))
    flags = F.col(flag[0]) if flag else F.lit(None).cast("array<boolean>")
    dealt = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"), flags.alias("flags")).repartition(2 * spark.sparkContext.defaultParallelism)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, open_, place = sent.value
        met, all_ = Best(len(ids), k), Best(len(ids), k)
        some = np.zeros(len(ids), bool)  # queries whose flag some row has
        for batch in batches:
            gone = holes(batch.column("vector"))
            for size, (at, matrix) in matrices(batch.column("vector")).items():
                own, points = asked.get(size, (np.zeros(0, np.int64), None))
                for p in np.unique(place[own]):
                    here = np.flatnonzero(place[own] == p)
                    held = np.zeros(len(at), bool) if p < 0 else np.asarray(pc.fill_null(pc.list_element(_full(batch.column("flags").take(pa.array(at)), int(p)), int(p)), False))
                    for best, which in ((met, held), (all_, ~held)):
                        if best is met:
                            some[own[here]] |= bool(held.any())
                        else:
                            here = here[~some[own[here]]]
                        r = np.flatnonzero(which)
                        if len(r) and len(here):
                            best.add(own[here], points[here], open_[own[here]], matrix[r], gone[at[r]], batch.column("key").take(pa.array(at[r])))
        for best, kind in ((met, True), (all_, False)):
            found = best.cut()
            if found is not None:
                stays = np.flatnonzero(kind | ~some[found[0]])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(found[0][stays])), found[2].take(pa.array(stays)), pa.array(np.full(len(stays), kind)), shown(found[1][stays])], [query_id, key, "met", "distance"])

    kind = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("met", T.BooleanType()), T.StructField("distance", T.DoubleType())])
    return _ordered(dealt.mapInArrow(look, kind), k, key, query_id, flag is not None)


def _full(flags: pa.Array, place: int) -> pa.Array:
    """The lists, with one of nulls for each that is null or too short to have that place."""
    short = pc.less_equal(pc.fill_null(pc.list_value_length(flags), 0), place)
    return pc.if_else(short, pa.scalar([None] * (place + 1), flags.type), flags) if pc.any(short).as_py() else flags


def _ordered(found: DataFrame, k: int, key: str, query_id: str, either: bool) -> DataFrame:
    order = Window.partitionBy(query_id, "met").orderBy(F.round("distance", 9), key)
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
    if either:  # k rows of either kind at most are left
        found = found.withColumn("any_met", F.max("met").over(Window.partitionBy(query_id))).where("met = any_met")
    return found.select(query_id, key, "distance", "rank")


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str, query_id: str, vector: str, allowed: Column | None, prefer: Column | None) -> DataFrame:
    extra = [c for c in queries.columns if c not in (query_id, "qvec")]
    packed = queries.agg(F.collect_list(F.struct(query_id, "qvec", *extra)).alias("packed"))
    packed = packed.withColumn("packed", F.when(F.size("packed") <= QUERY_BLOCK, F.col("packed")).otherwise(F.raise_error(F.lit(f"more than {QUERY_BLOCK} queries at once"))))
    each = vectors.crossJoin(F.broadcast(packed)).select(*vectors.columns, F.explode("packed").alias("q")).select(*vectors.columns, "q.*")
    each = each.where(allowed) if allowed is not None else each
    each = each.where(F.size("qvec") == F.size(vector))  # before the distance, which is then computed once
    met = F.lit(True) if prefer is None else F.coalesce(prefer, F.lit(False))
    found = each.select(query_id, key, met.alias("met"), squared_distance(F.col("qvec"), F.col(vector)).alias("distance"))
    return _ordered(found, k, key, query_id, prefer is not None)


def unless_empty(rows: DataFrame, holds: Column, group: str) -> DataFrame:
    """The rows of each group that hold the condition; all rows of a group where none does, or where the condition is null."""
    any_ = rows.groupBy(group).agg(F.max(F.coalesce(holds, F.lit(False))).alias("any_holds"))
    return rows.join(any_, group).where(F.coalesce(holds, F.lit(False)) | ~F.col("any_holds")).drop("any_holds")
