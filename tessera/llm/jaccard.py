"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, through trees over vectors of group counts.

Candidates meet in cells: pairs that link must share one of their first shingles in the order of hashes (prefix filter). In a cell
the documents are points, the counts of their shingles in hashed groups, and a tree of counts bounds the overlap of pairs by the
summed minima. What survives forms clusters; in a cluster the same tree finds the pairs again, and their sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.blocks import bucket_count, lists, numbered, pack, released, runs, spread, unpack
from tessera.llm.components import components
from tessera.llm.count_tree import CountTree, needed
from tessera.llm.scratch import materialize
from tessera.llm.text import byte_table, bytes_of, hashed, mapped, mixed, offsets_of, rows_of, shingles, utf8, words

SHINGLE, PERCENT = 4, 85
#: A shingle that starts more documents than this is left to those that have little else to start with.
FREQUENT = 256
#: Documents of a cell come in blocks of about this size; each two blocks are a cell of their own.
BLOCK = 1024
#: Bytes of vectors that go through a tree at once, or those of one cell.
BOUND_BYTES = 16 << 20
_LOWER = byte_table(lower=True)
#: Bits of a shingle's hash that candidates are found by; the sets themselves are compared by all 64.
_SHORT = np.uint64(16)


def _slack(n: np.ndarray) -> np.ndarray:
    return 2 + 3 * n // 100


def _least_partner(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """So many of its first shingles a document shows: two that link share more of these than their slack."""
    return np.minimum(n, n - _least_partner(n, percent) + 1 + _slack(n))


def _width(n: np.ndarray) -> np.ndarray:
    """The power of two of groups for sets of so many shingles: documents that share by chance alone then stay well below the bound."""
    return np.maximum(4, np.ceil(np.log2(3.7 * np.sqrt(np.maximum(n, 1))))).astype(np.int64)


def _sets(strings: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    starts, flat = words(mapped(strings, _LOWER))
    return shingles(starts, hashed(flat), size)


def _set_hashes(starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    with np.errstate(over="ignore"):
        found = mixed((total[starts[1:]] - total[starts[:-1]]) ^ (np.diff(starts).astype(np.uint64) << np.uint64(1)))
    return np.where(np.diff(starts) > 0, np.maximum(found, np.uint64(1)), np.uint64(0))


def _grouped(row: np.ndarray, hashes: np.ndarray, count: int, width: int, kind: type = np.uint16) -> np.ndarray:
    """How many of each row's shingles fall in each of 2**width groups."""
    return np.bincount((row << width) | (hashes >> np.uint64(64 - width)).astype(np.int64), minlength=count << width).reshape(count, 1 << width).astype(kind)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(key) >> np.uint64(11)) % np.uint64(buckets)


def _read(docs: DataFrame, size: int, percent: int, buckets: int) -> DataFrame:
    """Rows of kind `text` (a batch: keys, set sizes and hashes, and of each different set the first shingles and the vector) and `ask`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in numbered(batches):
            strings = utf8(rows.column("text"))
            starts, hashes = _sets(strings, size)
            n, own = np.diff(starts), _set_hashes(starts, hashes)
            _, lead = np.unique(own, return_index=True)
            lead = np.sort(lead[own[lead] > 0])
            shown = _prefix(n[lead], percent)
            token = hashes[spread(starts[lead], shown)] >> _SHORT
            width = _width(n[lead])
            vectors = [_grouped(np.repeat(np.arange(int((width == w).sum())), n[lead][width == w]), hashes[spread(starts[lead][width == w], n[lead][width == w])], int((width == w).sum()), int(w)).ravel() for w in np.unique(width)]
            out = [("text", None, number, pack(n.astype(np.uint32)), pack(own), pack(lead.astype(np.uint32), True), pack(token, True), pack(np.concatenate(vectors) if vectors else np.zeros(0, np.uint16)), zstandard.ZstdCompressor(level=3).compress(bytes_of(strings).tobytes()), pack(np.diff(offsets_of(strings)).astype(np.uint32)))]
            for kind, key, times in (("token", *np.unique(token, return_counts=True)), ("set", own[lead], np.ones(len(lead)))):
                bucket = _bucket(key, buckets)
                order = np.lexsort((key, bucket))
                edges = runs(bucket[order])
                for begin, end in zip(edges[:-1], edges[1:]):
                    some = order[begin:end]
                    out.append((kind, int(bucket[some[0]]), number, pack(key[some], True), pack(times[some].astype(np.uint32)), *[None] * 5))
            columns = list(zip(*out))
            keys = rows.column("key")
            both = pa.concat_arrays([lists(keys), pa.nulls(len(out) - 1, pa.list_(keys.type))])
            kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 7]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), both], [*names, "keys"])

    names = ["kind", "bucket", "batch", "a", "b", "c", "d", "e", "body", "sizes"]
    out = T.StructType.fromDDL("kind string, bucket int, batch long, a binary, b binary, c binary, d binary, e binary, body binary, sizes binary").add("keys", T.ArrayType(docs.schema["key"].dataType))
    return materialize(docs.mapInArrow(read, out), "jaccard", by="kind")


def _answer(asked: pa.Table) -> pa.Table:
    """Of each shingle that a batch asks for, how many documents show it (0 for one alone); of each set, whether the batch is its first."""
    out = {c: [] for c in ("batch", "bucket", "kind", "told")}
    for kind in ("token", "set"):
        rows = asked.filter(pa.compute.equal(asked["kind"], kind)).sort_by("batch")
        if not rows.num_rows:
            continue
        parts = [unpack(x, np.uint64, True) for x in rows["a"].to_pylist()]
        key, times = np.concatenate(parts), np.concatenate([unpack(x, np.uint32) for x in rows["b"].to_pylist()]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        edges = runs(key[order])
        total = np.add.reduceat(times[order], edges[:-1])
        told = np.empty(len(key), np.uint32)
        if kind == "token":
            told[order] = np.repeat(np.where(total > 1, total, 0), np.diff(edges))
        else:
            first = np.zeros(len(key), np.uint32)
            first[edges[:-1]] = 1
            told[order] = first
        ends = np.cumsum([len(p) for p in parts])
        for batch, bucket, end, part in zip(rows["batch"].to_pylist(), rows["bucket"].to_pylist(), ends, parts):
            for c, v in zip(out, (batch, bucket, kind, pack(told[end - len(part) : end]))):
                out[c].append(v)
    return pa.table({"batch": pa.array(out["batch"], pa.int64()), "bucket": pa.array(out["bucket"], pa.int32()), "kind": pa.array(out["kind"], pa.string()), "told": pa.array(out["told"], pa.binary())})


def _told(told: pa.Table, kind: str, key: np.ndarray, buckets: int) -> np.ndarray:
    rows = told.filter(pa.compute.equal(told["kind"], kind)).sort_by("bucket")
    out = np.zeros(len(key), np.int64)
    out[np.lexsort((key, _bucket(key, buckets)))] = np.concatenate([unpack(x, np.uint32) for x in rows["told"].to_pylist()] or [np.zeros(0, np.uint32)])
    return out


def _in_cells(cell: np.ndarray, node: np.ndarray, members: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries (index, cell): cells of more members than a block become a cell for each two of their blocks."""
    blocks = -(-members // block)
    index = np.repeat(np.arange(len(cell)), blocks)
    count, other = blocks[index], spread(np.zeros(len(cell), np.int64), blocks)
    with np.errstate(over="ignore"):
        own = (mixed(node[index] ^ mixed(cell[index])) % count.astype(np.uint64)).astype(np.int64)
        two = np.minimum(own, other) * count + np.maximum(own, other)
        return index, np.where(count > 1, mixed(cell[index] + mixed(two.astype(np.uint64) + np.uint64(1))), cell[index])


_CELLS = "bucket int, a binary, b binary, c binary, d binary, e binary"
_POINTS = f"{_CELLS}, f binary"


def _show(percent: int, buckets: int, frequent: int, block: int):
    def show(row: pa.Table, told: pa.Table) -> pa.Table:
        """The batch's different documents as points, in the cells of those of their first shingles that others show too."""
        out: list[tuple] = []
        if row.num_rows:
            n, own, lead, token, vectors = (unpack(row[c][0].as_py(), t, up) for c, t, up in (("a", np.uint32, False), ("b", np.uint64, False), ("c", np.uint32, True), ("d", np.uint64, True), ("e", np.uint16, False)))
            n, own = n[lead].astype(np.int64), own[lead]
            shown, width = _prefix(n, percent), _width(n)
            doc = np.repeat(np.arange(len(n)), shown)
            key, at = np.unique(token, return_inverse=True)
            seen = _told(told, "token", key, buckets)[at]
            first = _told(told, "set", own, buckets) > 0
            partner = _least_partner(n, percent)
            spare = np.minimum(_slack(partner), partner - 1)
            rich = np.bincount(doc[seen > frequent], minlength=len(n)) <= spare
            use = (seen > 0) & first[doc] & ~((seen > frequent) & rich[doc])
            doc, token, seen = doc[use], token[use], seen[use]
            position = np.empty(len(n), np.int64)  # where each document's vector begins: they stand by width
            by_width = np.argsort(width, kind="stable")
            position[by_width] = np.cumsum(1 << width[by_width]) - (1 << width[by_width])
            below = _width(partner)
            for lower in (False, True):  # in the cell of its own width, and of the one below if a partner may be there
                some = np.flatnonzero(below[doc] < width[doc]) if lower else np.arange(len(doc))
                level = width[doc[some]] - lower
                cell = mixed(token[some] + (level.astype(np.uint64) << np.uint64(56)))
                index, cell = _in_cells(cell, own[doc[some]], seen[some], block)
                some, level = some[index], level[index]
                bucket = _bucket(cell, buckets)
                order = np.lexsort((level, bucket))
                edges = runs(bucket[order], level[order])
                for begin, end in zip(edges[:-1], edges[1:]):
                    part = order[begin:end]
                    part = part[np.argsort(doc[some[part]], kind="stable")]
                    w = int(level[part[0]])
                    who, which = np.unique(doc[some[part]], return_inverse=True)  # a document's vector goes once, however many cells here it is in
                    each = vectors[(position[who][:, None] + np.arange(1 << (w + lower))[None, :])]
                    each = each.reshape(len(who), 1 << w, -1).sum(axis=2).astype(np.uint16)
                    out.append((int(bucket[part[0]]), pack(cell[part]), pack(own[who]), pack(n[who].astype(np.uint32)), pack(np.array([w], np.uint8)), pack(each.ravel()), pack(which.astype(np.uint32), True)))
        columns = list(zip(*out)) or [()] * 7
        return pa.table([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(columns)], ["bucket", "a", "b", "c", "d", "e", "f"])

    return released(show)


def _edges(own: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    moved = np.flatnonzero(label != np.arange(len(label)))
    pairs = np.unique(np.stack([own[label[moved]].view(np.int64), own[moved].view(np.int64)], axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


def _different(edges: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Numbers of the runs of members, one of each kind: runs of the same members are compared one by one, not by hashes alone."""
    sizes = np.diff(edges)
    if not len(sizes):
        return sizes
    sign = np.add.reduceat(mixed(members.astype(np.uint64) + np.uint64(1)), edges[:-1])
    by = np.lexsort((sign, sizes))
    like = np.flatnonzero((sizes[by][1:] == sizes[by][:-1]) & (sign[by][1:] == sign[by][:-1])) + 1
    if not len(like):
        return by
    one, two = by[like], by[like - 1]
    differ = members[spread(edges[one], sizes[one])] != members[spread(edges[two], sizes[two])]
    same = np.zeros(len(by), bool)
    same[like] = np.add.reduceat(differ, np.cumsum(sizes[one]) - sizes[one], dtype=np.int64) == 0
    return by[~same]


def _bound(percent: int, most: int = BOUND_BYTES):
    def bound(rows: pa.Table) -> pa.Table:
        """Links that span, in each cell, the documents whose overlap may be large enough by their vectors.

        Long near copies meet in very many cells: cells of the same documents are searched once, and cells go through the tree some
        at a time, so that a document's vector is repeated within `most` bytes, or those of one cell.
        """
        found = []
        width = np.array([int(unpack(x, np.uint8)[0]) for x in rows["d"].to_pylist()])
        for w in np.unique(width):
            held = rows.filter(pa.array(width == w))
            owns = [unpack(x, np.uint64) for x in held["b"].to_pylist()]
            own, first = np.concatenate(owns), np.cumsum([0, *(len(x) for x in owns[:-1])])
            n = np.concatenate([unpack(x, np.uint32) for x in held["c"].to_pylist()]).astype(np.int64)
            counts = np.concatenate([unpack(x, np.uint16) for x in held["e"].to_pylist()]).reshape(len(n), -1)
            cell = np.concatenate([unpack(x, np.uint64) for x in held["a"].to_pylist()])
            doc = np.concatenate([unpack(x, np.uint32, True).astype(np.int64) + k for x, k in zip(held["f"].to_pylist(), first)])
            order = np.lexsort((own[doc], n[doc], cell))
            edges = runs(cell[order])
            order = order[np.repeat(np.diff(edges) > 1, np.diff(edges))]
            cell, doc = cell[order], doc[order]
            edges = runs(cell)
            kept = np.sort(_different(edges, doc))
            sizes = np.diff(edges)[kept]
            turn = np.cumsum(sizes * counts.shape[1] * counts.itemsize) // most
            for some in np.split(kept, np.flatnonzero(np.diff(turn)) + 1):
                if not len(some):
                    continue
                at = spread(edges[some], np.diff(edges)[some])
                d = doc[at]
                found.append(_edges(own[d], CountTree(counts[d], n[d], cell[at], percent).connect()))
        one, two = (np.unique(np.stack([np.concatenate(x) for x in zip(*found)], axis=1), axis=0).T if found else np.zeros((2, 0), np.int64))
        return pa.table({"one": pa.array(np.ascontiguousarray(one)), "two": pa.array(np.ascontiguousarray(two))})

    return released(bound)


def _spell(size: int, buckets: int, block: int):
    def spell(row: pa.Table, told: pa.Table) -> pa.Table:
        """The whole sets of those documents of a batch that are in a cluster."""
        out: list[tuple] = []
        if row.num_rows and told.num_rows:
            own, lead, sizes = (unpack(row[c][0].as_py(), t, up) for c, t, up in (("b", np.uint64, False), ("c", np.uint32, True), ("sizes", np.uint32, False)))
            own = own[lead]
            wanted, cluster, members = (np.asarray(told[c].combine_chunks()) for c in ("node", "component", "members"))
            order = np.argsort(own)
            doc = order[np.searchsorted(own[order], wanted.view(np.uint64))]
            ends = np.cumsum(sizes.astype(np.int64))
            data = zstandard.ZstdDecompressor().decompress(row["body"][0].as_py())
            texts = pa.array([data[ends[k] - sizes[k] : ends[k]].decode() for k in lead[doc].tolist()], pa.string())
            starts, hashes = _sets(texts, size)
            n = np.diff(starts)
            index, cell = _in_cells(mixed(cluster.view(np.uint64)), own[doc], members, block)
            bucket = _bucket(cell, buckets)
            order = np.argsort(bucket, kind="stable")
            edges = runs(bucket[order])
            for begin, end in zip(edges[:-1], edges[1:]):
                part = order[begin:end]
                who = index[part]
                out.append((int(bucket[part[0]]), pack(cell[part]), pack(own[doc[who]]), pack(n[who].astype(np.uint32)), pack(hashes[spread(starts[who], n[who])], True), None))
        columns = list(zip(*out)) or [()] * 6
        return pa.table([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(columns)], ["bucket", "a", "b", "c", "d", "e"])

    return released(spell)


def overlaps(starts: np.ndarray, hashes: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many items the sets one and two share, pair by pair; each set's items are different ones."""
    out, n = np.zeros(len(one), np.int64), np.diff(starts)
    total = np.cumsum(n[one] + n[two])
    edges = [0, *(np.flatnonzero(np.diff(total // 2_000_000)) + 1).tolist(), len(one)]
    for begin, end in zip(edges[:-1], edges[1:]):
        a, b = one[begin:end], two[begin:end]
        pair = np.concatenate([np.repeat(np.arange(len(a)), n[a]), np.repeat(np.arange(len(b)), n[b])])
        item = np.concatenate([hashes[spread(starts[a], n[a])], hashes[spread(starts[b], n[b])]])
        order = np.lexsort((item, pair))
        pair, item = pair[order], item[order]
        same = (pair[1:] == pair[:-1]) & (item[1:] == item[:-1])
        out[begin:end] = np.bincount(pair[1:][same], minlength=len(a))
    return out


def _verify(percent: int):
    def check(rows: pa.Table) -> pa.Table:
        """Links that span, in each cluster's cell, the documents whose sets do overlap enough."""
        cell, own = (np.concatenate([unpack(x, np.uint64) for x in rows[c].to_pylist()]) for c in "ab")
        n = np.concatenate([unpack(x, np.uint32) for x in rows["c"].to_pylist()]).astype(np.int64)
        hashes = np.concatenate([unpack(x, np.uint64, True) for x in rows["d"].to_pylist()])
        starts = np.cumsum(n) - n
        order = np.lexsort((own, n, cell))
        hashes, cell, own, n = hashes[spread(starts[order], n[order])], cell[order], own[order], n[order]
        starts = np.concatenate([[0], np.cumsum(n)])
        counts = _grouped(np.repeat(np.arange(len(n)), n), hashes, len(n), 7, np.uint32)  # sets of any size in few groups
        label = CountTree(counts, n, cell, percent).connect(lambda one, two: overlaps(starts, hashes, one, two) >= needed(n[one], n[two], percent))
        one, two = _edges(own, label)
        return pa.table({"one": pa.array(one), "two": pa.array(two)})

    return released(check)


def _listed(key: str | None):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                keys = rows.column("keys").slice(k, 1).flatten()
                n, own = unpack(rows.column("a")[k].as_py(), np.uint32), unpack(rows.column("b")[k].as_py(), np.uint64)
                yield pa.RecordBatch.from_arrays([keys.field(key), pa.array(n, pa.int64()), pa.array(own.view(np.int64)), pa.array(np.full(len(n), rows.column("batch")[k].as_py())), pa.array(np.arange(len(n)))], ["key", "n_shingles", "node", "batch", "at"])

    return listed


def _join(docs: DataFrame, key: str, text: str, size: int, percent: int, frequent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The table of batches, and a row for each document: key, n_shingles, node (its set), component (null: alone), batch, at."""
    spark = docs.sparkSession
    buckets = bucket_count(spark)
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("key"), F.col(f"`{text}`").alias("text"))
    table = _read(rows, size, percent, buckets)
    told = materialize(table.where("kind != 'text'").select("kind", "bucket", "batch", "a", "b").groupBy("bucket").applyInArrow(_answer, "batch long, bucket int, kind string, told binary"), "jaccard-told")
    texts = table.where("kind = 'text'")
    cells = texts.select("batch", "a", "b", "c", "d", "e").groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_show(percent, buckets, frequent, block), _POINTS)
    maybe = cells.groupBy("bucket").applyInArrow(_bound(percent), "one long, two long")
    clusters = components(maybe)
    # written first, so that the join stands alone in its stage and a large cluster's rows can be split
    members = materialize(clusters.groupBy("component").agg(F.count("*").alias("members")), "jaccard-members")
    clusters = clusters.join(members, "component")
    kind = docs.schema[key].dataType
    out = T.StructType([T.StructField("key", kind), *T.StructType.fromDDL("n_shingles long, node long, batch long, at long").fields])
    listed = texts.select("batch", "keys", "a", "b").mapInArrow(_listed(key), out)
    first = listed.groupBy("node").agg(F.min("batch").alias("batch"))
    wanted = clusters.join(first, "node").select("batch", "node", "component", "members")
    spelled = texts.select("batch", "b", "c", "sizes", "body").groupBy("batch").cogroup(wanted.groupBy("batch")).applyInArrow(_spell(size, buckets, block), _CELLS)
    links = components(spelled.groupBy("bucket").applyInArrow(_verify(percent), "one long, two long"))
    return table, listed.join(links, "node", "left")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """For each row: key, n_shingles and component_id, the smallest key that links lead to, its own included.

    Two rows link if 100 * overlap >= percent * union of their sets of `size`-word shingles (a text of fewer words is one shingle).
    Null and empty texts have no shingles and no links. Repeated rows stay, and link with each other. Null keys are never the
    smallest, unless there is no other. Other columns go, whatever their names. An empty table gives no rows. A very long text is a
    batch of its own. Shingles stand for themselves by hashes of 64 bits.
    """
    _, found = _join(docs.select(key, text), key, text, size, percent, frequent, block)
    found = found.withColumn("component", F.coalesce("component", "node"))
    least = materialize(found.where("n_shingles > 0").groupBy("component").agg(F.min("key").alias("least")), "jaccard-least")
    whole = found.join(least, "component", "left")
    return whole.select(F.col("key").alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"))


def distinct(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """docs without near copies: of each group that links lead through, the row with the smallest key stays (of equal keys, the one read first).

    All columns stay; null texts become empty. Rows without words link with nothing and stay.
    """
    table, found = _join(docs, key, text, size, percent, frequent, block)
    found = found.withColumn("component", F.coalesce("component", "node"))
    place = F.struct(F.col("key").isNull(), "key", "batch", "at")
    kept = found.where("n_shingles > 0").groupBy("component").agg(F.min(place).alias("p")).select("p.batch", "p.at")
    kept = kept.union(found.where("n_shingles = 0").select("batch", "at"))

    def take(row: pa.Table, wanted: pa.Table) -> pa.Table:
        keys = row["keys"].combine_chunks()
        if not row.num_rows or not wanted.num_rows:
            return pa.table([keys.values[:0], pa.array([], pa.string())], ["key", "text"])
        at = np.sort(np.asarray(wanted["at"].combine_chunks()))
        sizes = unpack(row["sizes"][0].as_py(), np.uint32)
        strings = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(zstandard.ZstdDecompressor().decompress(row["body"][0].as_py()))])
        return pa.table([keys.flatten().take(pa.array(at)), strings.take(pa.array(at))], ["key", "text"])

    texts = table.where("kind = 'text'").select("batch", "keys", "sizes", "body")
    out = T.StructType([T.StructField("key", texts.schema["keys"].dataType.elementType), T.StructField("text", T.StringType())])
    rows = texts.groupBy("batch").cogroup(kept.groupBy("batch")).applyInArrow(take, out)
    return rows.select(*[F.col("text").alias(c) if c == text else F.col("key")[c].alias(c) for c in docs.columns])
