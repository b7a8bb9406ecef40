"""Repeated passages: every byte string of a fixed length that the corpus holds twice, found in suffix order around shared anchors.

Each window of `length` bytes has an anchor: its 32-byte gram with the smallest hash. Equal windows have equal anchors at equal
offsets, so windows are compared only with those whose anchor is the same gram. The windows of one anchor overlap, and travel as
one stretch of text. Stretches that are equal as a whole are known by their hashes; where the stretches around one gram differ,
one of each kind is brought together, and their suffixes' longest previous factors tell which windows occur again. Where very many
differ around one gram, stretches are cut in parts that go by a longer gram: the bytes that all windows of a part have in common.
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
from tessera.llm.scratch import materialize
from tessera.llm.suffixes import longest_previous_factor
from tessera.llm.text import bytes_of, mixed, offsets_of, utf8

LENGTH, GRAM = 200, 32
#: Different stretches around one gram that go to the gram's bucket whole. Of more, parts go to the buckets of their longer grams.
SUFFIX_GROUP = 256
#: Parts that a whole stretch is cut in then: the longer gram is so much of a window that parts are its windows' bytes and few others.
PARTS = 8
#: Bytes of text that are brought in suffix order at once: about 80 times as much memory.
SUFFIX_BYTES = 2 << 20
#: Bytes of text in a batch: a task needs about 80 times as much for the hashes of all places.
BATCH_BYTES = 2 << 20
REPEATED, OWNER, SHARED, CROWDED = 1, 2, 4, 8
_PLACE_BITS = np.uint64(28)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _words(data: np.ndarray, at: np.ndarray | None) -> np.ndarray:
    view = np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))
    return view.astype(np.uint64) if at is None else view[at].astype(np.uint64)


def gram_hashes(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the 32 bytes from each place on, for all places or the given ones."""
    with np.errstate(over="ignore"):
        if at is not None:
            eight = [mixed(_words(data, at + k) + _ODD) for k in (0, 8, 16, 24)]
            first, second = eight[0] * _ODD + eight[1], eight[2] * _ODD + eight[3]
            return mixed(mixed(first) * _ODD + mixed(second))
        eight = mixed(_words(data, None) + _ODD)
        sixteen = mixed(eight[:-8] * _ODD + eight[8:])
        return mixed(sixteen[:-16] * _ODD + sixteen[16:])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    count = len(values)
    padded = np.full(-(-count // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:count] = values
    square = padded.reshape(-1, width)
    forward = np.minimum.accumulate(square, axis=1).ravel()
    backward = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: count - width + 1], forward[width - 1 : count])


def stretches(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the anchor's place, the first window's place, and the number of windows. None crosses texts."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none
    place = np.arange(len(hashes), dtype=np.uint64)
    key = (hashes >> _PLACE_BITS << _PLACE_BITS) | place
    anchor = (_sliding_least(key, length - GRAM + 1) & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    first = spread(offsets[:-1].astype(np.int64), np.maximum(np.diff(offsets).astype(np.int64) - length + 1, 0))
    if not len(first):
        return none, none, none
    anchor = anchor[first]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(first) != 1)])
    begin = np.flatnonzero(new)
    return anchor[begin], first[begin], np.diff(np.append(begin, len(first)))


def _content_hashes(hashes: np.ndarray, anchor: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """A hash of each stretch's bytes, its extent and where its anchor stands."""
    size = count + length - 1
    total = mixed((size.astype(np.uint64) << np.uint64(20)) + (anchor - first).astype(np.uint64) + _ODD)
    with np.errstate(over="ignore"):
        for k in range(0, int(size.max(initial=0)) - GRAM + 1, GRAM):
            inside = k + GRAM <= size
            total = np.where(inside, mixed(total * _ODD + hashes[np.where(inside, first + k, first)]), total)
        return mixed(total * _ODD + hashes[first + size - GRAM])


def _wide_hashes(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each place on."""
    total = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in [*range(0, size - GRAM, GRAM), size - GRAM]:
            total = mixed(total * _ODD + gram_hashes(data, starts + k))
    return total


def _read(docs: DataFrame, length: int, buckets: int, batch_bytes: int) -> DataFrame:
    """Rows of kind `text` (a batch's keys, texts and stretches) and `ask` (its different stretches in a bucket, by two hashes)."""
    kind = T.StructType.fromDDL("kind string, bucket int, batch long, a binary, b binary, c binary").add("keys", T.ArrayType(docs.schema["key"].dataType)).add("body", T.BinaryType()).add("d", T.BinaryType()).add("e", T.BinaryType())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in numbered(batches, size=batch_bytes):
            strings = utf8(rows.column("text"))
            data, offsets = np.ascontiguousarray(bytes_of(strings)), offsets_of(strings).astype(np.int64)
            if len(data) >> int(_PLACE_BITS):
                raise ValueError(f"a text of more than {1 << int(_PLACE_BITS)} bytes")
            hashes = gram_hashes(data) if len(data) >= length else np.zeros(0, np.uint64)
            anchor, first, count = stretches(data, offsets, hashes, length)
            own, content = hashes[anchor], _content_hashes(hashes, anchor, first, count, length) if len(anchor) else hashes[:0]
            bucket = (own & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
            order = np.lexsort((content, own, bucket))
            edges = runs(bucket[order], own[order], content[order])
            kinds, times = np.empty(len(order), np.int64), np.diff(edges)
            kinds[order] = np.repeat(np.arange(len(times)), times)
            lead = order[edges[:-1]]  # sorting is stable: the first stretch of its kind
            asked = runs(bucket[lead])
            keys = rows.column("key")
            out = [("text", None, number, pack(np.diff(anchor, prepend=0)), pack(first, True), pack(count.astype(np.uint16)), pack(np.diff(offsets).astype(np.uint32)), pack(kinds.astype(np.uint32)), zstandard.ZstdCompressor(level=3).compress(data.tobytes()))]
            for begin, end in zip(asked[:-1], asked[1:]):
                some = lead[begin:end]
                out.append(("ask", int(bucket[some[0]]), number, pack(own[some], True), pack(content[some]), pack((times[begin:end] > 1).astype(np.uint8)), None, None, None))
            columns = list(zip(*out))
            both = pa.concat_arrays([lists(keys), pa.nulls(len(out) - 1, pa.list_(keys.type))])
            texts = [pa.array(columns[k], t) for k, t in ((0, pa.string()), (1, pa.int32()), (2, pa.int64()), (3, pa.binary()), (4, pa.binary()), (5, pa.binary()))]
            yield pa.RecordBatch.from_arrays([*texts, both, pa.array(columns[8], pa.binary()), pa.array(columns[6], pa.binary()), pa.array(columns[7], pa.binary())], ["kind", "bucket", "batch", "a", "b", "c", "keys", "body", "d", "e"])

    return materialize(docs.mapInArrow(read, kind), "repeats", by="kind")


def _answer(asked: pa.Table, suffix_group: int) -> pa.Table:
    """For each batch's stretches in a bucket: whether they occur again, whether this batch holds the first, and whether others share the gram."""
    asked = asked.sort_by("batch")
    own, content, many = ([unpack(x, t, up) for x in asked[c].to_pylist()] for c, t, up in (("a", np.uint64, True), ("b", np.uint64, False), ("c", np.uint8, False)))
    sizes = [len(x) for x in own]
    own, content, many = np.concatenate(own), np.concatenate(content), np.concatenate(many)
    order = np.lexsort((content, own))  # stable: earlier batches first
    edges = runs(own[order], content[order])
    times, lead = np.diff(edges), edges[:-1]
    grams = runs(own[order][lead])
    crowd = np.repeat(np.diff(grams), np.diff(grams))
    again = (times > 1) | (np.add.reduceat(many[order], lead) > 0 if len(lead) else False)
    state = np.repeat(again * REPEATED + (crowd > 1) * SHARED + (crowd > suffix_group) * CROWDED, times)
    state[lead] += OWNER
    found = np.empty(len(own), np.uint8)
    found[order] = state
    ends = np.cumsum(sizes)
    return pa.table({"batch": asked["batch"], "bucket": asked["bucket"], "state": pa.array([pack(found[e - n : e]) for e, n in zip(ends, sizes)], pa.binary())})


def _states(suffix_group: int):
    def states(asked: pa.Table) -> pa.Table:
        return _answer(asked, suffix_group)

    return released(states)


class _Batch:
    """A batch's row of kind `text` with the states of its stretches, as the buckets have told."""

    def __init__(self, row: pa.Table, answers: pa.Table):
        one = {c: row[c][0].as_py() for c in ("a", "b", "c", "d", "e", "body")}
        self.anchor, self.first = np.cumsum(unpack(one["a"], np.int64)), unpack(one["b"], np.int64, True)
        self.count, self.kind = unpack(one["c"], np.uint16).astype(np.int64), unpack(one["e"], np.uint32).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(unpack(one["d"], np.uint32).astype(np.int64))])
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(one["body"]), np.uint8)
        states = [unpack(x, np.uint8) for x in answers.sort_by("bucket")["state"].to_pylist()]
        self.state = np.concatenate(states) if states else np.zeros(0, np.uint8)
        self.lead = np.full(len(self.state), len(self.kind))
        np.minimum.at(self.lead, self.kind, np.arange(len(self.kind)))


_TOLD = "batch long, kinds binary, places binary"


def _parts(anchor: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Stretches cut in parts by where the anchor is in their windows, so that equal windows are in equal parts.

    For each part: the stretch's number, the first window's place, the number of windows, and where the bytes begin that all
    windows of a part have in common; at last their size.
    """
    wide = max(1, (length - GRAM) // PARTS)
    least, most = (anchor - first - count + 1) // wide, (anchor - first) // wide
    stretch = np.repeat(np.arange(len(first)), most - least + 1)
    core = anchor[stretch] - wide * spread(least, most - least + 1)
    low = np.maximum(first[stretch], core - wide + 1)
    return stretch, low, np.minimum((first + count)[stretch] - 1, core) - low + 1, core, length - wide + 1


def _questions(buckets: int, length: int):
    def ask(row: pa.Table, answers: pa.Table) -> pa.Table:
        """The first of each kind of stretch whose gram others share: its bytes, or those of its parts where the gram has too many kinds."""
        out = {c: [] for c in ("bucket", "batch", "a", "b", "c", "d", "e")}
        if row.num_rows:
            x = _Batch(row, answers)
            held, crowd = (np.sort(x.lead[np.flatnonzero((x.state & (OWNER | SHARED | CROWDED)) == wanted)]) for wanted in (OWNER | SHARED, OWNER | SHARED | CROWDED))
            part, low, count, core, size = _parts(x.anchor[crowd], x.first[crowd], x.count[crowd], length)
            key = np.concatenate([gram_hashes(x.data, x.anchor[held]), _wide_hashes(x.data, core, size)])
            own = np.concatenate([held, crowd[part]])
            first, count = np.concatenate([x.first[held], low]), np.concatenate([x.count[held], count])
            bucket = (key & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            edges = runs(bucket[order])
            for begin, end in zip(edges[:-1], edges[1:]):
                some = order[begin:end]
                text = x.data[spread(first[some], count[some] + length - 1)]
                parts = [pack(x.kind[own[some]].astype(np.uint32)), pack((first[some] - x.first[own[some]]).astype(np.uint16)), pack(count[some].astype(np.uint16)), pack(key[some]), zstandard.ZstdCompressor(level=1).compress(text.tobytes())]
                for c, v in zip(out, (int(bucket[some[0]]), row["batch"][0].as_py(), *parts)):
                    out[c].append(v)
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "batch": pa.array(out["batch"], pa.int64()), **{c: pa.array(out[c], pa.binary()) for c in "abcde"}})

    return released(ask)


def _again(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows have an equal one before them, and which have one anywhere, by longest previous factors."""
    shared, source = longest_previous_factor(data, starts, length)
    later = shared >= length
    either = later.copy()
    either[np.searchsorted(starts, source[later])] = True
    return later, either


def _again_by_pieces(data: np.ndarray, starts: np.ndarray, length: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for more windows than go in suffix order at once.

    A hash deals the windows over pieces, so that equal ones meet; a piece takes its windows in turns, and only those without an
    equal one before them stay for the next turn. Their bytes decide, in suffix order, as ever.
    """
    later, either = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    piece = _wide_hashes(data, starts, length) % np.uint64(-(-len(starts) * length // most))
    order, step = np.argsort(piece, kind="stable"), max(1, most // length)
    edges = runs(piece[order])
    for begin, end in zip(edges[:-1], edges[1:]):
        alone = order[:0]
        for k in range(begin, end, step):
            some = np.concatenate([alone, order[k : min(k + step, end)]])
            text = data[spread(starts[some], np.full(len(some), length))]
            after, any_ = _again(text, np.arange(len(some)) * length, length)
            later[some[after]] = True
            either[some[any_]] = True
            alone = some[~after]
    return later, either


def _settle(length: int, keep_first: bool, most: int):
    def settle(asked: pa.Table) -> pa.Table:
        """Windows that stand elsewhere too (or earlier, if the first is kept), among different stretches around the same grams."""
        asked = asked.sort_by("batch")
        held = [unpack(v, np.uint32) for v in asked["a"].to_pylist()]
        batch = np.repeat(np.asarray(asked["batch"]), [len(h) for h in held])
        kinds, key = np.concatenate(held), np.concatenate([unpack(v, np.uint64) for v in asked["d"].to_pylist()])
        place, count = (np.concatenate([unpack(v, np.uint16) for v in asked[c].to_pylist()]).astype(np.int64) for c in "bc")
        data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(v) for v in asked["e"].to_pylist()), np.uint8)
        size = count + length - 1
        begin = np.cumsum(size) - size
        order = np.argsort(key, kind="stable")  # earlier batches first
        edges = runs(key[order])
        turn = (np.cumsum(np.add.reduceat(size[order], edges[:-1])) if len(order) else edges[:-1]) // most
        flagged = [(batch[:0], kinds[:0], place[:0])]
        for groups in np.split(np.arange(len(turn)), np.flatnonzero(np.diff(turn)) + 1):
            some = order[edges[groups[0]] : edges[groups[-1] + 1]] if len(groups) else order[:0]
            if not len(some):
                continue
            if size[some].sum() <= 2 * most:
                text = data[spread(begin[some], size[some])]
                later, either = _again(text, spread(np.cumsum(size[some]) - size[some], count[some]), length)
            else:
                later, either = _again_by_pieces(data, spread(begin[some], count[some]), length, most)
            again = later if keep_first else either
            flagged.append((np.repeat(batch[some], count[some])[again], np.repeat(kinds[some], count[some])[again], spread(place[some], count[some])[again]))
        batch, kinds, place = (np.concatenate(x) for x in zip(*flagged))
        order = np.argsort(batch, kind="stable")
        edges = runs(batch[order])
        parts = [order[b:e] for b, e in zip(edges[:-1], edges[1:])]
        return pa.table({
            "batch": pa.array([int(batch[p[0]]) for p in parts], pa.int64()),
            "kinds": pa.array([pack(kinds[p].astype(np.uint32)) for p in parts], pa.binary()), "places": pa.array([pack(place[p].astype(np.uint16)) for p in parts], pa.binary()),
        })

    return released(settle)


def _joined(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges without overlaps or touching ends, ascending."""
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > reach[:-1]])
    return low[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)]


def _cut(length: int, keep_first: bool, whole_characters: bool):
    def cut(row: pa.Table, told: pa.Table) -> pa.Table:
        """Each text of a batch with the ranges that its repeated windows cover, and the bytes beyond them."""
        keys = row["keys"].combine_chunks().flatten() if row.num_rows else row["keys"].combine_chunks().values[:0]
        if not row.num_rows:
            offsets, low, high, data = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        else:
            x = _Batch(row, told.filter(pa.compute.is_valid(told["state"])))
            lead = np.zeros(len(x.kind), bool)
            lead[x.lead] = True
            state = x.state[x.kind]
            whole = ((state & OWNER) == 0) | ~lead if keep_first else (state & REPEATED) > 0
            low, high = [x.first[whole]], [(x.first + x.count)[whole] + length - 1]
            more = told.filter(pa.compute.is_valid(told["kinds"]))
            for kinds, places in zip(more["kinds"].to_pylist(), more["places"].to_pylist()):
                start = x.first[x.lead[unpack(kinds, np.uint32)]] + unpack(places, np.uint16)
                low.append(start)
                high.append(start + length)
            low, high = np.concatenate(low), np.concatenate(high)
            offsets, data = x.offsets, x.data
            gap = np.searchsorted(offsets, low, side="right") - 1  # a gap between texts, so that ranges of two never touch
            low, high = _joined(low + gap, high + gap)
            gap = np.searchsorted(offsets + np.arange(len(offsets)), low, side="right") - 1
            low, high = low - gap, high - gap
        text = np.searchsorted(offsets, low, side="right") - 1
        kept = np.ones(len(data), np.int8)
        kept[spread(low, high - low)] = 0
        if whole_characters and len(data):
            begin = np.flatnonzero(data & 0xC0 != 0x80)
            kept = np.repeat(np.minimum.reduceat(kept, begin), np.diff(np.append(begin, len(data))))
        sizes = np.diff(offsets)
        left = np.diff(np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[offsets])
        pairs = pa.StructArray.from_arrays([pa.array(low - offsets[text], pa.int64()), pa.array(high - offsets[text], pa.int64())], ["begin", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32()), pairs)
        rest = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(left)]).astype(np.int32)), pa.py_buffer(data[kept > 0].tobytes())])
        return pa.table({"key": keys, "n_bytes": pa.array(sizes, pa.int64()), "spans": spans, "kept": rest})

    return released(cut)


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, keep_first: bool = False, whole_characters: bool = False, suffix_group: int = SUFFIX_GROUP, batch_bytes: int = BATCH_BYTES, suffix_bytes: int = SUFFIX_BYTES) -> DataFrame:
    """Each row's other columns with n_bytes, spans (array of byte ranges, ends excluded) and kept (the bytes beyond the spans).

    The spans are all bytes covered by a string of `length` bytes that also starts elsewhere in any text, the same included;
    overlapping occurrences count, and none crosses texts. With keep_first, the occurrence that is read first stays: then
    strings with an earlier one are removed. With whole_characters, kept also lacks the characters that lose a byte. Null and short texts have no spans, repeated rows repeat each other's strings, an
    empty table gives no rows. A very long text is a batch of its own; one of more than 2**28 bytes is an error. length is over 64 and under 60,000. Columns named n_bytes, spans or kept are not allowed.
    """
    if not 2 * GRAM < length < 60_000:
        raise ValueError("length must be over 64 and under 60,000 bytes")
    others = [c for c in docs.columns if c != text]
    if {"n_bytes", "spans", "kept"} & set(others):
        raise ValueError("columns n_bytes, spans and kept would clash with the result's")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("key") if others else F.lit(0).alias("key"), F.col(f"`{text}`").alias("text"))
    buckets = bucket_count(docs.sparkSession)
    table = _read(rows, length, buckets, batch_bytes)
    asked = table.where("kind = 'ask'").select("bucket", "batch", "a", "b", "c")
    answers = materialize(asked.groupBy("bucket").applyInArrow(_states(suffix_group), "batch long, bucket int, state binary"), "repeats-states")
    texts = table.where("kind = 'text'").select("batch", "keys", "a", "b", "c", "d", "e", "body")
    questions = texts.drop("keys").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_questions(buckets, length), "bucket int, batch long, a binary, b binary, c binary, d binary, e binary")
    settled = materialize(questions.groupBy("bucket").applyInArrow(_settle(length, keep_first, suffix_bytes), _TOLD), "repeats-windows")
    told = answers.select("batch", "bucket", "state", F.lit(None).cast("binary").alias("kinds"), F.lit(None).cast("binary").alias("places"))
    told = told.unionByName(settled.select("batch", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("state"), "kinds", "places"))
    out = T.StructType([T.StructField("key", rows.schema["key"].dataType), *T.StructType.fromDDL("n_bytes long, spans array<struct<begin:long,end:long>>, kept binary").fields])
    found = texts.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_cut(length, keep_first, whole_characters), out)
    return found.select(*[F.col("key")[c].alias(c) for c in others], "n_bytes", "spans", "kept")


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """docs with the repeated passages cut out of their texts, by whole characters. Rows and other columns stay, whatever their names; null texts become empty."""
    names = {c: f"c{n}" for n, c in enumerate(docs.columns) if c != text}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(f"`{text}`").alias("text"))
    found = repeated_spans(plain, "text", length, keep_first, whole_characters=True)
    return found.select(*[F.col("kept").cast("string").alias(c) if c == text else F.col(names[c]).alias(c) for c in docs.columns])
