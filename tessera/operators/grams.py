"""Substring search by an index of characters, pairs and triples: candidates from bitmaps, texts opened for those only.

Documents lie in blocks. A block has, for every gram in its lower-case texts, the documents that hold it; grams are dealt over
buckets, so a search reads its own grams' buckets only. A keyword of three characters or fewer is a gram: it needs no text. A longer
one has all its triples in every text that holds it, so the documents that lack one are out, and the others' texts are opened, the
first ones by key, until a query has its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.sources.tables import exists, new_path, snapshot, written

#: Documents and characters of a block, and buckets of grams.
BLOCK, BLOCK_CHARACTERS, BUCKETS = 1024, 4_000_000, 64
#: Queries that go to all tasks at once; more go in several passes over their grams.
QUERY_BLOCK = 10_000
_NAMES = -1
_BITS = 21


@dataclass
class Index:
    """rows: (bucket, block, keys, folders, grams, counts, at); bucket -1 has each block's keys and folders."""

    rows: DataFrame
    key: str


def grams(text: str) -> np.ndarray:
    """The different grams of a text: up to three characters, each as its number and one, in 21 bits."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    return np.unique(np.concatenate([c, c[:-1] | c[1:] << _BITS, c[:-2] | c[1:-1] << _BITS | c[2:] << 2 * _BITS]))


def of_keyword(keyword: str) -> np.ndarray:
    """The grams that decide (a keyword of up to three characters) or bound (a longer one) where the keyword stands."""
    c = np.frombuffer(keyword.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    if len(c) <= 3:
        return np.array([sum(int(x) << _BITS * k for k, x in enumerate(c))], np.int64)
    return np.unique(c[:-2] | c[1:-1] << _BITS | c[2:] << 2 * _BITS)


def bucket_of(gram: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(40)).astype(np.int64) % BUCKETS


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, path: str | None = None) -> Index:
    """Reads the texts once and writes the index. Null texts count as empty. folder: a column that searches can be held to."""
    spark, path = docs.sparkSession, path or new_path(docs.sparkSession, "grams")
    kind = _kind(docs, key)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, schema = TaskContext.get().partitionId() << 32, to_arrow_schema(kind)
        held, size = [], 0

        def block() -> pa.RecordBatch:
            keys, folders, own = zip(*held)
            doc = np.repeat(np.arange(len(own)), [len(g) for g in own])
            of, names = pd.factorize(np.concatenate(own))
            pairs = np.sort(of << 10 | doc)
            count = np.bincount(of, minlength=len(names))
            ends = np.cumsum(count)
            rows = {"bucket": [_NAMES], "block": [number], "keys": [list(keys)], "folders": [list(folders)], "grams": [None], "counts": [None], "at": [None]}
            bucket = bucket_of(names)
            for b in np.unique(bucket):
                some = np.flatnonzero(bucket == b)
                at = np.concatenate([pairs[ends[g] - count[g] : ends[g]] for g in some]) & 1023
                for c, v in zip(rows, (int(b), number, None, None, names[some], count[some], at)):
                    rows[c].append(v)
            return pa.RecordBatch.from_arrays([pa.array(v, schema.field(c).type) for c, v in rows.items()], list(rows))

        for batch in batches:
            names, folders, texts = (batch.column(k) for k in range(3))
            for k in range(batch.num_rows):
                t = texts[k].as_py()
                held.append((names[k].as_py(), folders[k].as_py(), grams(t)))
                size += len(t)
                if len(held) >= BLOCK or size >= BLOCK_CHARACTERS:
                    yield block()
                    held, size, number = [], 0, number + 1
        if held:
            yield block()

    cores = spark.sparkContext.defaultParallelism
    rows = docs.select(F.col(key), (F.col(folder).cast("string") if folder else F.lit(None).cast("string")).alias("folder"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    rows = rows.repartition(cores) if docs.rdd.getNumPartitions() < cores else rows
    rows.mapInArrow(read, kind).write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(path)
    return Index(spark.read.schema(kind).parquet(path), key)


def kept(docs: DataFrame, place: str, key: str = "doc_id", text: str = "text", folder: str | None = None) -> Index:
    """The index of these very files, built if it isn't there."""
    path = f"{place.rstrip('/')}/grams-1-{snapshot(docs)}-{key}-{text}-{folder}"
    if exists(docs.sparkSession, f"{path}/_SUCCESS"):
        return Index(docs.sparkSession.read.schema(_kind(docs, key)).parquet(path), key)
    return build(docs, key, text, folder, path)


def _kind(docs: DataFrame, key: str) -> T.StructType:
    lists = T.StructType.fromDDL("folders array<string>, grams array<long>, counts array<int>, at array<int>").fields
    return T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(docs.schema[key].dataType)), *lists])


def candidates(index: Index, asked: list, after: dict, most: int) -> DataFrame:
    """(query, key, sure): for each asked (id, keywords, mode, folders) by number, the first `most` keys beyond `after` that may match.

    sure: they do, by grams alone. Keywords are in lower case. Only the asked grams' bitmaps move, to their blocks' keys.
    """
    wanted = np.unique(np.concatenate([np.zeros(0, np.int64), *[of_keyword(k) for _, keywords, _, _ in asked for k in keywords]]))
    buckets = [int(b) for b in np.unique(bucket_of(wanted))]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                own, count, at = (np.asarray(batch.column(c)[n].values).astype(np.int64) for c in ("grams", "counts", "at"))
                ends, found, maps = np.cumsum(count), [], []
                for g in np.flatnonzero(np.isin(own, wanted)):
                    bits = np.zeros(BLOCK, bool)
                    bits[at[ends[g] - count[g] : ends[g]]] = True
                    found.append(int(own[g]))
                    maps.append(np.packbits(bits).tobytes())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("block")[n].as_py()] * len(found)), pa.array(found), pa.array(maps, pa.binary())], ["block", "gram", "bits"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                keys = batch.column("keys")[n].values
                size, maps = len(keys), {p["gram"]: np.unpackbits(np.frombuffer(p["bits"], np.uint8)).astype(bool) for p in batch.column("maps")[n].as_py() or []}
                folders, names, none = np.array(batch.column("folders")[n].as_py(), object), keys.to_pylist(), np.zeros(BLOCK, bool)
                for q, (_, keywords, mode, scope) in enumerate(asked):
                    each = [np.logical_and.reduce([maps.get(int(g), none) for g in of_keyword(k)])[:size] for k in keywords]
                    short = [len(k) <= 3 for k in keywords]
                    if not each:
                        continue
                    may = np.logical_or.reduce(each) if mode == "OR" else np.logical_and.reduce(each)
                    sure = np.logical_or.reduce([e for e, s in zip(each, short) if s] or [none[:size]]) if mode == "OR" else np.full(size, all(short))
                    if scope is not None:
                        may = may & np.isin(folders, scope)
                    last = after.get(q)
                    hits = sorted((names[k], bool(sure[k])) for k in np.flatnonzero(may) if names[k] is not None and (last is None or names[k] > last))[:most]
                    if hits:
                        own, told = zip(*hits)
                        yield pa.RecordBatch.from_arrays([pa.array([q] * len(hits), pa.int32()), pa.array(own, keys.type), pa.array(told)], ["query", "key", "sure"])

    own = index.rows.schema["keys"].dataType.elementType
    bits = index.rows.where(F.col("bucket").isin(buckets)).select("block", "grams", "counts", "at").mapInArrow(pick, "block long, gram long, bits binary")
    maps = bits.groupBy("block").agg(F.collect_list(F.struct("gram", "bits")).alias("maps"))  # the asked grams, one bitmap each
    blocks = index.rows.where(F.col("bucket") == _NAMES).select("block", "keys", "folders").join(maps, "block")
    found = blocks.select("keys", "folders", "maps").mapInArrow(judge, T.StructType([T.StructField("query", T.IntegerType()), T.StructField("key", own), T.StructField("sure", T.BooleanType())]))
    place = F.row_number().over(Window.partitionBy("query").orderBy("key"))
    return found.withColumn("place", place).where(F.col("place") <= most).drop("place")


def search(index: Index, docs: DataFrame, queries: DataFrame, limit: int, text: str = "text", query_id: str = "query_id") -> DataFrame:
    """(query_id, key, rank): the first `limit` documents by key that match each query (query_id, keywords, mode, and folders if any).

    The same rows as `grep.search`, which reads every text. folders: an array of folder names that a query is held to, null for all.
    Queries are a stated set that comes to the driver QUERY_BLOCK at a time. Candidates come by key, twice the limit first, then four
    times as many in each round, and only for queries that still lack rows. docs: the documents of the index. Null keys never match.
    """
    columns = [F.transform("keywords", lambda k: F.lower(k)).alias("keywords"), "mode", (F.col("folders") if "folders" in queries.columns else F.lit(None).cast("array<string>")).alias("folders")]
    rows = written(queries.select(query_id, *columns), "asked")
    count = rows.count()
    passes = 1 if count <= QUERY_BLOCK else -(-2 * count // QUERY_BLOCK)
    found = None
    for p in range(passes):
        part = rows if passes == 1 else rows.where(F.pmod(F.xxhash64(query_id), F.lit(passes)) == p)
        one = _search(index, docs, [tuple(r) for r in part.collect()], limit, text, query_id, queries)
        found = one if found is None else found.unionByName(one)
    return found


def _search(index: Index, docs: DataFrame, asked: list, limit: int, text: str, query_id: str, queries: DataFrame) -> DataFrame:
    spark, key, most = docs.sparkSession, index.key, 2 * limit
    names = spark.createDataFrame([(n, q[0], list(q[1]), q[2]) for n, q in enumerate(asked)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField(query_id, queries.schema[query_id].dataType), T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("mode", T.StringType())]))
    parts, after, have, open_ = [], {}, {}, set(range(len(asked)))
    while open_:
        some = [q if n in open_ else (q[0], [], q[2], q[3]) for n, q in enumerate(asked)]
        held = written(candidates(index, some, after, most), "candidates")
        unsure = held.where(~F.col("sure"))
        span = unsure.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
        good = held.where("sure").select("query", "key")
        if span.low is not None:
            texts = docs.where(F.col(key).between(span.low, span.high)).select(F.col(key).alias("key"), F.col(text).alias("text"))  # pages beyond are not read
            low = F.lower(F.coalesce(F.col("text"), F.lit("")))
            opened = unsure.join(texts, "key").select("query", "key", low.alias("low")).join(names, "query")
            holds = lambda k: F.col("low").contains(k)
            good = good.unionByName(opened.where(F.when(F.col("mode") == "OR", F.exists("keywords", holds)).otherwise(F.forall("keywords", holds))).select("query", "key").distinct())
        good = written(good, "found")
        parts.append(good)
        told = {r.query: r for r in held.groupBy("query").agg(F.count("*").alias("n"), F.max("key").alias("last")).collect()}
        for r in good.groupBy("query").agg(F.count("*").alias("n")).collect():
            have[r.query] = have.get(r.query, 0) + r.n
        after |= {q: r.last for q, r in told.items()}
        open_ = {q for q in open_ if q in told and told[q].n >= most and have.get(q, 0) < limit}
        most *= 4
    rows = parts[0] if parts else spark.createDataFrame([], T.StructType([T.StructField("query", T.IntegerType()), T.StructField("key", docs.schema[key].dataType)]))
    for more in parts[1:]:
        rows = rows.unionByName(more)
    place = F.row_number().over(Window.partitionBy("query").orderBy("key")) - 1
    return rows.withColumn("rank", place).where(F.col("rank") < limit).join(names.select("query", query_id), "query").select(query_id, F.col("key").alias(key), "rank")
