"""BM25 over blocks of documents: an index of segments that follows changes, and the best documents of many queries.

A block holds a hundred or so documents of like lengths with their postings by term. A query's terms give a block a bound: the sum
of the largest weights that they have in it. Blocks under the query's threshold are skipped; in the others the terms with the
largest bounds are added up first, and documents that can't reach the threshold any more are dropped on the way.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import EMPTY_TOKEN, TOKEN, tokenize, words
from tessera.sources.tables import batches_of, exists, new_path, snapshot, written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries without enough hits that are sent to all tasks; more are an error.
MOST_SHORT = 100_000
#: Documents of a block, and documents and words among which a task looks for those of like lengths.
BLOCK, SORTED, SORTED_TOKENS = 128, 4096, 1_000_000
#: Queries, and terms of them, that all tasks get at once. More go in several passes over the blocks.
QUERY_BLOCK, QUERY_TERMS = 20_000, 4_000_000
#: Of so many blocks one is searched first: the k-th best score in it is the others' threshold.
FIRST = 16
#: Blocks that a task holds at once, in a file's row group and in a batch for Python, and documents in a batch that become blocks.
HELD, DOCUMENTS_HELD = 4, 256
#: Documents whose words are numbered at once, and shingles that are spelled out at once; a document stays whole.
ENCODED, SPELLED = 256, 1 << 18
#: Terms that are added up between two looks at what is left.
STEP = 8
#: Segments of about one size that become one, and the share of dead documents from which a segment is written anew.
MERGED, DEAD = 4, 0.25
#: Changes with what `tokenize` does: an index of another tokenizer is another index.
TOKENIZER = format(zlib.crc32(f"words and pairs 1 {TOKEN} {EMPTY_TOKEN}".encode()), "08x")


@dataclass
class Index:
    """blocks: (segment, block, keys, dl, facets, terms, counts, at, tf) without dead documents, which `dead` names; terms: (term, df);
    segments: their documents and tokens; and three numbers of the whole collection."""

    path: str
    key: str
    version: int
    segments: dict[str, tuple[int, int]]
    blocks: DataFrame
    terms: DataFrame
    documents: int
    mean_length: float
    mean_idf: float

    @property
    def postings(self) -> DataFrame:
        """(key, term, tf, dl) of all documents."""
        return self.blocks.mapInArrow(_spelled, self.blocks.select(F.explode("keys").alias("key"), F.lit("").alias("term"), F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("dl")).schema).withColumnRenamed("key", self.key)


def _raw_idf(documents: int) -> Column:
    return F.log(F.lit(documents) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def busy(docs: DataFrame) -> DataFrame:
    """docs over all cores, where a small input comes in fewer partitions than that: making tokens is the work."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


# ---- blocks


def _lists(*columns: pa.Array) -> list[pa.Array]:
    """Each array as the one entry of a column of lists."""
    return [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]


_NAMES = ["block", "keys", "dl", "facets", "terms", "counts", "at", "tf"]


def cut(keys: pa.Array, facets: pa.Array, doc: np.ndarray, codes: np.ndarray, times: np.ndarray, terms: pa.Array, number: Callable[[], int]) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents in the order of their lengths. doc, codes, times: postings, codes of the terms; each pair of the first two stands once."""
    size = np.bincount(doc, times, len(keys)).astype(np.int64)
    order = np.argsort(size, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by = np.lexsort((place[doc], codes, place[doc] // BLOCK))
    doc, codes, times = place[doc][by], codes[by], times[by]
    edges = np.searchsorted(doc // BLOCK, np.arange(-(-len(keys) // BLOCK) + 1))
    for k, (begin, end) in enumerate(zip(edges[:-1], edges[1:])):
        own = order[k * BLOCK : (k + 1) * BLOCK]
        held, counts = np.unique(codes[begin:end], return_counts=True)
        columns = _lists(keys.take(pa.array(own)), pa.array(size[own]), facets.take(pa.array(own)), terms.take(pa.array(held)), pa.array(counts.astype(np.int32)), pa.array((doc[begin:end] % BLOCK).astype(np.int32)), pa.array(times[begin:end].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array([number()], pa.int64()), *columns], _NAMES)


def _numbers() -> Callable[[], int]:
    count = [TaskContext.get().partitionId() << 32]

    def number() -> int:
        count[0] += 1
        return count[0]

    return number


def _gathered(rows: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.Table]:
    """The rows in groups of at most about SORTED documents and SORTED_TOKENS of size."""
    held, docs, tokens = [], 0, 0
    for batch in rows:
        sizes = np.cumsum(size(batch))
        step, begin = np.arange(len(sizes)) // SORTED + sizes // SORTED_TOKENS, 0
        for end in [*(np.flatnonzero(np.diff(step)) + 1), len(sizes)]:
            if end > begin:
                held.append(batch.slice(begin, end - begin))
                docs, tokens = docs + end - begin, tokens + int(sizes[end - 1] - (sizes[begin - 1] if begin else 0))
            begin = end
            if docs >= SORTED or tokens >= SORTED_TOKENS:
                full, held, docs, tokens = [pa.Table.from_batches(held)], [], 0, 0
                yield full.pop()  # nothing here holds it any longer
    if held:
        yield pa.Table.from_batches(held)


def _shingles(words: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """What `tokenize` makes of each word: where its terms begin (and the end), their numbers, and the terms."""
    numbers: dict[str, int] = {}
    flat, begin = [], [0]
    for w in words:
        flat.append(numbers.setdefault(w, len(numbers)))
        flat.extend(numbers.setdefault(w[k : k + 2], len(numbers)) for k in range(len(w) - 1))
        begin.append(len(flat))
    return np.array(begin), np.array(flat, np.int64), pa.array(list(numbers), pa.string())


def _coded(batch: pa.RecordBatch, number: dict[str, int], base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's words (word << 32 | document, counted from base), how often each stands there, and the documents' words. number: of the words so far; it gets the new ones."""
    held = batch.column("words")
    size = np.asarray(pc.list_value_length(held)).astype(np.int64)
    coded = held.flatten().dictionary_encode()
    to = np.array([number.setdefault(w, len(number)) for w in coded.dictionary.to_pylist()], np.int64)
    pairs = to[np.asarray(coded.indices)]
    pairs <<= 32
    pairs |= np.repeat(np.arange(base, base + len(size)), size)
    pairs, times = np.unique(pairs, return_counts=True)
    return pairs, times.astype(np.int32), size


def _pieces(pairs: np.ndarray, times: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """pairs and times, ordered by document, in pieces of whole documents with about SPELLED shingles."""
    count = begin[(pairs >> 32) + 1] - begin[pairs >> 32]
    starts = np.flatnonzero(np.diff(pairs & 0xFFFFFFFF, prepend=-1))
    piece = (np.cumsum(count) - count)[starts] // SPELLED
    edges = [*starts[np.flatnonzero(np.diff(piece, prepend=-1))], len(pairs)]
    for low, high in zip(edges[:-1], edges[1:]):
        yield pairs[low:high], times[low:high]


def _words_to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents given by their words. Shingles are made once for each different word of a group; its texts go as soon as their words are counted."""
    number = _numbers()
    for rows in _gathered(batches, lambda b: np.asarray(pc.list_value_length(b.column("words"))).astype(np.int64)):
        known: dict[str, int] = {}
        parts, base = [], 0
        for batch in rows.to_batches(max_chunksize=ENCODED):
            parts.append(_coded(batch, known, base))
            base += batch.num_rows
        keys, facets = rows["key"].combine_chunks(), rows["facets"].combine_chunks()
        del rows, batch
        pairs, times, size = (np.concatenate(x) for x in zip(*parts))
        del parts
        begin, flat, terms = _shingles([*known])
        del known
        terms, none = pa.concat_arrays([terms, pa.array([EMPTY_TOKEN])]), len(terms)  # documents without a word have one term that says so
        length = np.bincount(pairs & 0xFFFFFFFF, times * (begin[(pairs >> 32) + 1] - begin[pairs >> 32]), len(size)).astype(np.int64)
        order = np.argsort(np.maximum(length, 1), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.argsort(place[pairs & 0xFFFFFFFF], kind="stable")
        pairs, times = pairs[by], times[by]
        edges = np.searchsorted(place[pairs & 0xFFFFFFFF] // BLOCK, np.arange(-(-len(size) // BLOCK) + 1))
        del by
        for n, (low, high) in enumerate(zip(edges[:-1], edges[1:])):  # a word's shingles are spelled out for some documents of one block at a time
            own, bare = order[n * BLOCK : (n + 1) * BLOCK], np.flatnonzero(size[order[n * BLOCK : (n + 1) * BLOCK]] == 0)
            found, tf = [none << 32 | bare], [np.ones(len(bare), np.int64)]
            for some, often in _pieces(pairs[low:high], times[low:high], begin):
                first, count = begin[some >> 32], begin[(some >> 32) + 1] - begin[some >> 32]
                at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                one, of = np.unique(flat[at] << 32 | np.repeat(place[some & 0xFFFFFFFF] % BLOCK, count), return_inverse=True)
                found.append(one)
                tf.append(np.bincount(of, np.repeat(often, count), len(one)).astype(np.int64))
                del at, of, one
            found, tf = np.concatenate(found), np.concatenate(tf)
            yield from cut(keys.take(pa.array(own)), facets.take(pa.array(own)), found & 0xFFFFFFFF, found >> 32, tf, terms, number)
        del pairs, times, size, keys, facets, begin, flat, terms, found, tf
        pa.default_memory_pool().release_unused()


def _live(row: dict, dead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, number of the term and frequency of a block's postings, without dead documents."""
    term = np.repeat(np.arange(len(row["counts"])), row["counts"])
    alive = ~np.isin(row["at"], dead)
    return row["at"][alive], term[alive], row["tf"][alive]


def _row(batch: pa.RecordBatch, k: int) -> dict:
    """Row k of a batch of blocks: numbers as numpy arrays, all else as Arrow arrays."""
    one = {c: batch.column(c)[k].values for c in batch.schema.names if c not in ("segment", "block", "dead", "some")}
    for c in ("dl", "counts", "at", "tf"):
        one[c] = np.asarray(one[c]).astype(np.int64)
    own = batch.column("dead")[k].values
    return one | {"dead": np.zeros(0, np.int64) if own is None else np.asarray(own).astype(np.int64)}


def _blocks_to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks again, of documents that live, without a look at their texts."""
    number = _numbers()
    for rows in _gathered(batches, lambda b: np.asarray(pc.list_value_length(b.column("tf"))).astype(np.int64)):
        parts, keys, facets, base = [], [], [], 0
        for batch in rows.to_batches():
            for k in range(batch.num_rows):
                row = _row(batch, k)
                stays = np.setdiff1d(np.arange(len(row["dl"])), row["dead"])
                to = np.full(len(row["dl"]), -1)
                to[stays] = base + np.arange(len(stays))
                doc, term, tf = _live(row, row["dead"])
                parts.append((to[doc], row["terms"].take(pa.array(term)), tf))
                keys.append(row["keys"].take(pa.array(stays)))
                facets.append(row["facets"].take(pa.array(stays)))
                base += len(stays)
        if base:
            coded = pa.concat_arrays([p[1] for p in parts]).dictionary_encode()
            yield from cut(pa.concat_arrays(keys), pa.concat_arrays(facets), np.concatenate([p[0] for p in parts]), np.asarray(coded.indices).astype(np.int64), np.concatenate([p[2] for p in parts]), coded.dictionary, number)


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = _row(batch, k)
            doc, term, tf = _live(row, row["dead"])
            yield pa.RecordBatch.from_arrays([row["keys"].take(pa.array(doc)), row["terms"].take(pa.array(term)), pa.array(tf), pa.array(row["dl"][doc])], ["key", "term", "tf", "dl"])


# ---- segments


def _segment(path: str, blocks: DataFrame, held: int = DOCUMENTS_HELD) -> str:
    """Writes a segment: its blocks, and how many documents hold each term. held: rows, of what becomes blocks, in a batch."""
    name = uuid.uuid4().hex
    with batches_of(blocks.sparkSession, held):
        blocks.write.options(**{"compression": "zstd", "parquet.block.row.count.limit": HELD}).parquet(f"{path}/segments/{name}/blocks")
    held = blocks.sparkSession.read.parquet(f"{path}/segments/{name}/blocks")
    pairs = held.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("x.terms", "x.counts")
    pairs.groupBy(F.col("terms").alias("term")).agg(F.sum("counts").alias("df")).write.option("compression", "zstd").parquet(f"{path}/segments/{name}/terms")
    return name


def _numbers_of(spark: SparkSession, path: str, name: str) -> tuple[int, int]:
    total = F.aggregate("dl", F.lit(0).cast("long"), lambda s, x: s + x)
    row = spark.read.parquet(f"{path}/segments/{name}/blocks").agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n"), F.coalesce(F.sum(total), F.lit(0)).alias("t")).first()
    return int(row.n), int(row.t)


_DEAD, _STATE = "segment string, block long, at int", "segment string, documents long, tokens long, mean_idf double"


def _publish(spark: SparkSession, path: str, version: int, segments: dict[str, tuple[int, int]], dead: DataFrame | None, gone: DataFrame | None) -> None:
    """Writes a version: dead documents, the terms that went with them, and, last, the segments. A version with segments is whole."""
    if dead is not None:
        dead.write.mode("overwrite").parquet(f"{path}/dead/version={version}")
        gone.write.mode("overwrite").parquet(f"{path}/gone/version={version}")
    terms, n = _terms(spark, path, list(segments), version if dead is not None else None), sum(d for d, _ in segments.values())
    mean = terms.agg(F.coalesce(F.avg(_raw_idf(n)), F.lit(0.0)).alias("m")).first().m
    rows = [(s, d, t, float(mean)) for s, (d, t) in segments.items()] or [(None, 0, 0, 0.0)]
    spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/state/version={version}")


def _terms(spark: SparkSession, path: str, segments: list[str], version: int | None) -> DataFrame:
    """(term, df) summed over segments, less what dead documents held."""
    parts = [spark.read.parquet(f"{path}/segments/{s}/terms") for s in segments]
    if version is not None:
        parts.append(spark.read.parquet(f"{path}/gone/version={version}"))
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return spark.createDataFrame([], "term string, df long")
    return reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def _read_blocks(spark: SparkSession, path: str, segments: list[str], dead: DataFrame | None) -> DataFrame:
    """The segments' blocks, each with the places of its dead documents (null: none). Only segments with such are joined with them."""
    hit = {r.segment for r in dead.select("segment").distinct().collect()} if dead is not None else set()
    parts = []
    for s in segments:
        rows = spark.read.parquet(f"{path}/segments/{s}/blocks").withColumn("segment", F.lit(s))
        if s in hit:
            places = dead.where(F.col("segment") == s).groupBy("block").agg(F.collect_list("at").alias("dead"))  # a block's documents at most
            rows = rows.join(places, "block", "left")
        else:
            rows = rows.withColumn("dead", F.lit(None).cast("array<int>"))
        parts.append(rows.select("segment", *_NAMES, "dead"))
    return reduce(DataFrame.unionByName, parts)


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, facets: list[str] | tuple[str, ...] = ()) -> Index:
    """Tokenizes once and writes an index of one segment. path: where, else a new folder. facets: columns that searches filter by."""
    path = path or new_path(docs.sparkSession, "bm25")
    name = _segment(path, _fresh(docs, key, text, facets))
    _publish(docs.sparkSession, path, 0, {name: _numbers_of(docs.sparkSession, path, name)}, None, None)
    return load(docs.sparkSession, path, key)


def _fresh(docs: DataFrame, key: str, text: str, facets: list[str] | tuple[str, ...]) -> DataFrame:
    kept = F.struct(*[F.col(c) for c in facets]) if facets else F.struct(F.lit(0).alias("none"))
    rows = busy(docs.select(F.col(key).alias("key"), kept.alias("facets"), F.col(text).alias("text"))).select("key", "facets", words(F.col("text")).alias("words"))
    kind = rows.select(F.lit(0).cast("long").alias("block"), F.array("key").alias("keys"), F.array(F.lit(0).cast("long")).alias("dl"), F.array("facets").alias("facets"), F.array(F.lit("")).alias("terms"), *[F.array(F.lit(0)).alias(c) for c in ("counts", "at", "tf")]).schema
    return rows.mapInArrow(_words_to_blocks, kind)


def load(spark: SparkSession, path: str, key: str = "doc_id") -> Index:
    """The last whole version of an index that `build` or `update` has written."""
    state = spark.read.parquet(f"{path}/state")
    rows = state.where(F.col("version") == state.agg(F.max("version")).first()[0]).collect()
    version, segments = rows[0].version, {r.segment: (r.documents, r.tokens) for r in rows if r.segment}
    dead = spark.read.parquet(f"{path}/dead/version={version}") if exists(spark, f"{path}/dead/version={version}") else None
    n, tokens = (sum(x) for x in zip(*segments.values())) if segments else (0, 0)
    terms = _terms(spark, path, list(segments), version if dead is not None else None)
    return Index(path, key, version, segments, _read_blocks(spark, path, list(segments), dead), terms, n, tokens / max(n, 1), rows[0].mean_idf)


def kept(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", facets: list[str] | tuple[str, ...] = ()) -> Index:
    """The index of these very files in the folder, built if it isn't there: named by the tokenizer and the files' sizes and times, never by a count of rows."""
    path = f"{folder.rstrip('/')}/bm25-{TOKENIZER}-{snapshot(docs)}-{'-'.join([key, text, *facets])}"
    return load(docs.sparkSession, path, key) if exists(docs.sparkSession, f"{path}/state/version=0/_SUCCESS") else build(docs, key, text, path, facets)


def update(index: Index, changed: DataFrame, gone: DataFrame | None = None, text: str = "text", facets: list[str] | tuple[str, ...] = ()) -> Index:
    """The index with the changed documents in place of those with their keys, and without the keys of gone (one column named as the key).

    The changed ones become a segment; what they replace dies in its segment, which is not written again until DEAD of it is dead.
    MERGED segments of about one size become one. Scores are those of a new index: lengths and frequencies are the living documents'.
    """
    spark, path, key = changed.sparkSession, index.path, index.key
    keys = changed.select(F.col(key).alias("key"))
    keys = written((keys if gone is None else keys.unionByName(gone.select(F.col(key).alias("key")))).distinct(), "changed")
    old = index.blocks
    places = old.select("segment", "block", F.posexplode("keys").alias("at", "key"), "dead", "dl").where(~F.coalesce(F.array_contains("dead", F.col("at")), F.lit(False)))
    hit = written(places.join(keys, "key", "left_semi").select("segment", "block", "at", F.get("dl", F.col("at")).alias("dl")), "dead")
    newly = hit.groupBy("segment", "block").agg(F.collect_list("at").alias("some"))
    held = old.join(newly, ["segment", "block"]).mapInArrow(_terms_of_some, "term string, df long")
    before = _dead_before(spark, index)
    dead = hit.select("segment", "block", "at") if before is None else before[0].unionByName(hit.select("segment", "block", "at"))
    lost = held.groupBy("term").agg((-F.sum("df")).alias("df"))
    lost = lost if before is None else lost.unionByName(before[1]).groupBy("term").agg(F.sum("df").alias("df"))
    segments = dict(index.segments)
    for r in hit.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("t")).collect():
        segments[r.segment] = (segments[r.segment][0] - r.n, segments[r.segment][1] - r.t)
    name = _segment(path, _fresh(changed, key, text, facets))
    segments[name] = _numbers_of(spark, path, name)
    _publish(spark, path, index.version + 1, segments, written(dead, "dead"), written(lost, "gone", batch=HELD))
    return _merged(load(spark, path, key))


def _dead_before(spark: SparkSession, index: Index) -> tuple[DataFrame, DataFrame] | None:
    if not exists(spark, f"{index.path}/dead/version={index.version}"):
        return None
    return spark.read.parquet(f"{index.path}/dead/version={index.version}"), spark.read.parquet(f"{index.path}/gone/version={index.version}")


def _terms_of_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of the documents at the places `some` of each block, once for each document."""
    for batch in batches:
        for k in range(batch.num_rows):
            row, some = _row(batch, k), np.asarray(batch.column("some")[k].values)
            term = np.repeat(np.arange(len(row["counts"])), row["counts"])[np.isin(row["at"], some)]
            own, df = np.unique(term, return_counts=True)
            yield pa.RecordBatch.from_arrays([row["terms"].take(pa.array(own)), pa.array(df)], ["term", "df"])


def _merged(index: Index) -> Index:
    """The index with its crowded and its half dead segments written anew as one; the others stay as they are."""
    spark = index.blocks.sparkSession
    before = _dead_before(spark, index)
    if before is None:
        return index
    dead, gone = before
    died = {r.segment: r.n for r in dead.groupBy("segment").agg(F.count("*").alias("n")).collect()}
    tiers: dict[int, list[str]] = {}
    for s, (n, _) in index.segments.items():
        tiers.setdefault(int(np.log(max(n, 1)) / np.log(MERGED)), []).append(s)
    anew = {s for group in tiers.values() if len(group) >= MERGED for s in group}
    anew |= {s for s, (n, _) in index.segments.items() if died.get(s, 0) > DEAD * (n + died.get(s, 0))}
    if not anew:
        return index
    kind = index.blocks.select(*_NAMES).schema
    some = index.blocks.where(F.col("segment").isin(sorted(anew)))
    name = _segment(index.path, some.mapInArrow(_blocks_to_blocks, kind), HELD)
    back = written(some.where(F.size("dead") > 0).withColumn("some", F.col("dead")).mapInArrow(_terms_of_some, "term string, df long"), "back", batch=HELD)
    gone = gone.unionByName(back).groupBy("term").agg(F.sum("df").alias("df")).where("df != 0")
    segments = {s: v for s, v in index.segments.items() if s not in anew} | {name: _numbers_of(spark, index.path, name)}
    _publish(spark, index.path, index.version + 1, segments, written(dead.where(~F.col("segment").isin(sorted(anew))), "dead"), written(gone, "gone"))
    return load(spark, index.path, index.key)


# ---- searches


@dataclass
class Asked:
    """A set of queries: the different terms, and one after the other the terms' numbers and weights of each query."""

    terms: pa.Array
    begin: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    want: list | None
    least: np.ndarray


def best_of(row: dict, asked: Asked, k: int, mean_length: float, best: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], int]:
    """(query, places, scores) of the documents of a block that may be among the k best, and the number of pairs scored to the end.

    best: for each query the k best scores so far, ascending; it is brought up to date.
    """
    docs = np.setdiff1d(np.flatnonzero(row["ok"]), row["dead"])
    number = np.asarray(pc.fill_null(pc.index_in(row["terms"], value_set=asked.terms), -1)).astype(np.int64)
    held = np.flatnonzero(number >= 0)
    ends = np.cumsum(row["counts"])
    line = np.repeat(np.arange(len(held)), row["counts"][held])
    at = np.repeat(ends[held] - np.cumsum(row["counts"][held]), row["counts"][held]) + np.arange(len(line))
    doc, tf = row["at"][at], row["tf"][at]
    weights = np.zeros((len(held) + 1, len(row["dl"])))
    weights[line, doc] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * row["dl"][doc] / mean_length))
    place = np.full(len(asked.terms), len(held))
    place[number[held]] = np.arange(len(held))  # a term that the block lacks has a last line of zeros
    top = weights.max(axis=1, initial=0)
    own = place[asked.term]
    bound = np.maximum(asked.weight, 0) * top[own]
    total = np.concatenate([[0], np.cumsum(bound)])
    total = total[asked.begin[1:]] - total[asked.begin[:-1]]
    found, scored = [], 0
    for q in np.flatnonzero(total >= np.maximum(asked.least, best[:, 0]) - 1e-7):
        span, least = slice(asked.begin[q], asked.begin[q + 1]), max(asked.least[q], best[q, 0]) - 1e-7
        act = docs if asked.want is None or asked.want[q] is None else docs[row["same"][docs] == asked.want[q]]
        order = np.argsort(-bound[span], kind="stable")
        lines, factor, bounds = own[span][order], asked.weight[span][order], bound[span][order]
        rest, score = bounds.sum(), np.zeros(len(row["dl"]))
        for begin in range(0, len(lines), STEP):
            part = slice(begin, begin + STEP)
            score[act] += factor[part] @ weights[lines[part]][:, act]
            rest -= bounds[part].sum()
            if begin + STEP < len(lines):
                if len(act) > k and not (factor < 0).any():  # what is added from here on can only raise scores: the k-th best sum so far is a threshold
                    least = max(least, np.partition(score[act], -k)[-k] - 1e-7)
                act = act[score[act] + rest >= least]
            if not len(act):
                break
        scored += len(act)
        act = act[score[act] >= least]
        act = act[np.lexsort((row["order"][act], -np.round(score[act], 9)))[:k]]
        if len(act):
            found.append((int(q), act, score[act]))
            best[q] = np.sort(np.concatenate([best[q], score[act]]))[-k:]
    return found, scored


def _asked(known: DataFrame, least: dict) -> tuple[list, Asked]:
    rows = known.toArrow()
    ids = rows["query_id"].to_pylist()
    coded = rows["terms"].combine_chunks().flatten().dictionary_encode()
    begin = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(rows["terms"])))])
    want = rows["want"].to_pylist() if "want" in rows.column_names else None
    return ids, Asked(coded.dictionary, begin, np.asarray(coded.indices).astype(np.int64), np.asarray(rows["weights"].combine_chunks().flatten()).astype(float), want, np.array([least.get(x, -np.inf) for x in ids], float))


def _searched(blocks: DataFrame, known: DataFrame, k: int, mean_length: float, query_kind, equal: str | None, where: Callable[[Column], Column] | None, least: dict) -> DataFrame:
    """The k best of each task for each query. The queries of `known`, a bounded set, go to all tasks."""
    spark = blocks.sparkSession
    ids, asked = _asked(known, least)
    sent = spark.sparkContext.broadcast((ids, asked))
    ok = F.transform("facets", lambda f: F.coalesce(where(f), F.lit(False))) if where is not None else F.transform("keys", lambda x: F.lit(True))
    rows = blocks.select("keys", "dl", "terms", "counts", "at", "tf", "dead", ok.alias("ok"), F.transform("facets", lambda f: f[equal]).alias("same") if equal else F.lit(None).cast("array<string>").alias("same"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = sent.value
        best = np.full((len(ids), k), -np.inf)
        names = pa.array(ids, query_kind)
        for batch in batches:
            for n in range(batch.num_rows):
                row = _row(batch, n)
                row["ok"] = np.asarray(row["ok"])
                row["same"] = None if row["same"] is None else np.array(row["same"].to_pylist(), object)
                row["order"] = np.empty(len(row["dl"]), np.int64)
                row["order"][np.asarray(pc.sort_indices(row["keys"]))] = np.arange(len(row["dl"]))
                found, _ = best_of(row, asked, k, mean_length, best)
                if found:
                    at, sizes = np.concatenate([f[1] for f in found]), [len(f[1]) for f in found]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat([f[0] for f in found], sizes))), row["keys"].take(pa.array(at)), pa.array(np.concatenate([f[2] for f in found]))], ["query_id", "key", "score"])

    kind = blocks.select(F.explode("keys").alias("key")).schema["key"].dataType
    return rows.mapInArrow(search, T.StructType([T.StructField("query_id", known.schema["query_id"].dataType), T.StructField("key", kind), T.StructField("score", T.DoubleType())]))


def top(queries: DataFrame, index: Index, k: int, query_id: str = "query_id", text: str = "query", equal: tuple[str, str] | None = None, where: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, key, score, rank): BM25's k best documents of each query, those without a shared term (score 0) among them.

    equal: a facet of the index and a column of queries that must be the same; null asks for any. where: a condition on the struct
    of facets. Statistics stay the whole collection's. Queries are a stated set, sent to all tasks in passes of QUERY_BLOCK queries
    or QUERY_TERMS terms at most; documents meet them in their blocks, and k rows of a query leave a task's block at most. Ties (to
    nine places) go by key. Null queries hold the one token of empty texts; repeated query ids are one query with all their terms.
    """
    spark, key = queries.sparkSession, index.key
    want = F.first(F.col(equal[1])).alias("want") if equal else F.lit(None).cast("string").alias("want")
    asked = queries.groupBy(query_id).agg(F.flatten(F.collect_list(tokenize(F.col(text)))).alias("tokens"), want)  # a stated set of queries
    each = asked.select(query_id, F.explode("tokens").alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("times"))
    raw = _raw_idf(index.documents)
    weight = F.col("times") * F.when(raw < 0, EPSILON * index.mean_idf).otherwise(raw)
    own = each.join(index.terms, "term").groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("w")))).alias("x"))
    known = asked.select(F.col(query_id).alias("query_id"), "want").join(own.withColumnRenamed(query_id, "query_id"), "query_id", "left")
    none = F.array().cast("array<struct<term:string,w:double>>")
    known = written(known.select("query_id", "want", F.coalesce("x", none)["term"].alias("terms"), F.coalesce("x", none)["w"].alias("weights")), "asked")
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("t")).first()
    passes = max(1, -(-2 * size.n // QUERY_BLOCK), -(-2 * size.t // QUERY_TERMS)) if size.n > QUERY_BLOCK or size.t > QUERY_TERMS else 1
    kind, found = _arrow_type(known), []
    for p in range(passes):
        part = known if passes == 1 else known.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)
        part = part if equal else part.drop("want")
        look = lambda some, least: ranked(_searched(some, part, k, index.mean_length, kind, equal[0] if equal else None, where, least), k, "query_id", "key")  # noqa: B023, E731
        first = written(look(index.blocks.where(F.pmod(F.xxhash64("segment", "block"), F.lit(FIRST)) == 0), {}), "first", batch=HELD)
        least = {r.query_id: r.score for r in first.where(F.col("rank") == k - 1).select("query_id", "score").collect()}
        found += [first, written(look(index.blocks.where(F.pmod(F.xxhash64("segment", "block"), F.lit(FIRST)) != 0), least), "others", batch=HELD)]
    rows = reduce(DataFrame.unionByName, [f.select("query_id", "key", "score") for f in found])
    rows = ranked(rows, k, "query_id", "key")
    return rows.select(F.col("query_id").alias(query_id), F.col("key").alias(key), "score", "rank")


def _arrow_type(known: DataFrame) -> pa.DataType:
    return known.select("query_id").limit(0).toArrow().schema.field("query_id").type


def scores(queries: DataFrame, index: Index, key: str = "doc_id", query_id: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, key, score) of every document that shares a term with the query; a query's repeated terms count as often.

    A negative idf is replaced by EPSILON times the mean idf of the whole vocabulary, negatives included. Queries come first: only
    postings of their terms are joined, and sums are made before anything is ordered.
    """
    asked = queries.select(query_id, F.explode(tokenize(F.col(text))).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("times"))
    raw = _raw_idf(index.documents)
    known = asked.join(index.terms, "term").select(query_id, "term", "times", F.when(raw < 0, EPSILON * index.mean_idf).otherwise(raw).alias("idf"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(index.mean_length)))
    return index.postings.join(known, "term").groupBy(query_id, key).agg(F.sum(F.col("times") * F.col("idf") * weight).alias("score"))


def ranked(scored: DataFrame, k: int, group: str = "query_id", key: str = "doc_id", by: Column | None = None) -> DataFrame:
    """The k best rows of each query with rank from 0; equal scores (to nine places) go by key."""
    order = Window.partitionBy(group).orderBy(F.desc(F.round("score", 9)) if by is None else by, key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def filled(scored: DataFrame, queries: DataFrame, docs: DataFrame, k: int, key: str = "doc_id", query_id: str = "query_id", allowed: Column | None = None) -> DataFrame:
    """scored, and with score 0, for each query with fewer than k rows of no negative score, the first k documents by key that it lacks.

    Only such queries meet the documents again, by key alone; each task keeps so many documents of a query before anything moves
    that k are left whichever of them have a score. A stated set of MOST_SHORT queries at most goes to all tasks.
    """
    counts = scored.groupBy(query_id).agg(F.count("*").alias("held"), F.count_if(F.col("score") >= 0).alias("good"))
    short = queries.drop("query").join(counts, query_id, "left").where(F.coalesce("good", F.lit(0)) < k).withColumn("held", F.coalesce("held", F.lit(0)))
    size = short.agg(F.count("*").alias("n"), F.max("held").alias("m")).first()
    if not size.n:
        return scored
    if size.n > MOST_SHORT:
        raise ValueError(f"more than {MOST_SHORT} queries without {k} hits at once")
    pairs = docs.drop("text").crossJoin(F.broadcast(short.drop("good", "held")))
    pairs = (pairs if allowed is None else pairs.where(allowed)).select(query_id, key)
    first = pairs.withColumn("n", F.row_number().over(Window.partitionBy(query_id).orderBy(key))).where(F.col("n") <= k + size.m).drop("n")
    return scored.unionByName(first.join(scored.select(query_id, key), [query_id, key], "left_anti").withColumn("score", F.lit(0.0)))


def search(queries: DataFrame, docs: DataFrame, k: int, key: str = "doc_id", query_id: str = "query_id", allowed: Column | None = None, index: Index | None = None, scored: DataFrame | None = None) -> DataFrame:
    """BM25's k best documents of each query; allowed (any condition over columns of docs and queries) filters after global statistics.

    Documents without a shared term score 0, and follow by key where a query has too few others. Without an index of docs one is
    built. This is `top`, but for allowed: such a condition is judged for each pair that shares a term, so all of them are scored;
    filters by facets, in `top`, need no such thing. scored: what `scores` gave for these queries, if it is there already.
    """
    if allowed is None and scored is None:
        return top(queries, index or build(docs, key), k, query_id)
    found = scores(queries, index or build(docs, key), key, query_id) if scored is None else scored
    if allowed is not None:
        extra = [c for c in docs.columns if c not in (key, "text")]
        found = found.join(docs.select(key, *extra), key).join(queries.drop("query"), query_id).where(allowed).select(query_id, key, "score")
    found = written(found, "scored") if scored is None or allowed is not None else found
    return ranked(filled(found, queries, docs, k, key, query_id, allowed), k, query_id, key)


def with_fallback(filtered: DataFrame, unfiltered: DataFrame, least: int = 5, key: str = "doc_id", query_id: str = "query_id") -> DataFrame:
    """filtered (query_id, key, score, rank), and after it, where it has fewer than `least` rows, those of unfiltered that it lacks."""
    counts = filtered.groupBy(query_id).agg(F.count("*").alias("held"))
    more = unfiltered.join(filtered.select(query_id, key), [query_id, key], "left_anti").join(counts, query_id, "left").where(F.coalesce("held", F.lit(0)) < least)
    both = filtered.withColumn("part", F.lit(0)).unionByName(more.drop("held").withColumn("part", F.lit(1)))
    order = Window.partitionBy(query_id).orderBy("part", "rank")
    return both.select(query_id, key, "score", (F.row_number().over(order) - 1).alias("rank"))
