"""Repeated passages of words by recompression: rounds that name runs and pairs of symbols, the same names in all texts.

Words get numbers, equal ones for equal words. A round cuts the symbols of every text into runs of one symbol, then several times
joins neighbours of which the first is of the left and the second of the right half of the alphabet. The halves follow from what a
symbol stands for, so equal passages are cut alike but for a few symbols at their ends. Buckets compare what the new symbols stand
for, name those that two documents share, and tell the least document of each. A window whose inner symbols aren't shared stands
nowhere else; a shared symbol as long as a window that an earlier document holds too is a repeated passage as it is. What is left,
windows at the ends of repeated passages, is compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.blocks import bucket_count, lists, numbered, pack, released, runs, spread, unpack
from tessera.llm.scratch import materialize, new_path, removed
from tessera.llm.text import bytes_of, hashed, mixed, offsets_of, utf8, words

WINDOW, ROUNDS, STEPS = 13, 3, 3
RESULT = ["n_words", "n_removed", "kept"]
_ODD, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NEVER = np.iinfo(np.int64).min
#: An element of a symbol: a name, and how often it stands in a row.
_ELEMENT = np.dtype([("name", "<u8"), ("times", "<u4")])
_ROW = "kind string, bucket int, batch long, parts array<binary>"


def _none(kind: type) -> np.ndarray:
    return field(default_factory=lambda: np.zeros(0, kind))


@dataclass
class State:
    """What is still open of a batch. Places count words, with a gap of one between documents."""

    doc_at: np.ndarray = _none(np.int64)  # the place of each document's first word
    doc_id: np.ndarray = _none(np.int64)
    word_at: np.ndarray = _none(np.int64)  # words that an open window covers, and their names
    word: np.ndarray = _none(np.uint64)
    start: np.ndarray = _none(np.int64)  # symbols over these words, in order
    size: np.ndarray = _none(np.int64)
    name: np.ndarray = _none(np.uint64)
    ref: np.ndarray = _none(np.int64)  # which ask will name the symbol; -1 where it has a name
    win: np.ndarray = _none(np.int64)  # open windows, and the part of each whose symbols any equal window has too
    low: np.ndarray = _none(np.uint16)
    high: np.ndarray = _none(np.uint16)
    asks: np.ndarray = _none(np.bool_)  # whether all its symbols so far stand in an earlier document
    begin: np.ndarray = _none(np.int64)  # ranges of places that are to go
    end: np.ndarray = _none(np.int64)

    def parts(self) -> list[bytes]:
        return [_coded(getattr(self, f.name)) if f.name in _REPEATED else pack(getattr(self, f.name), f.name in _ASCENDING) for f in fields(self)]

    @staticmethod
    def of(parts: list[bytes]) -> State:
        read = lambda p, f: _decoded(p, f.default_factory().dtype) if f.name in _REPEATED else unpack(p, f.default_factory().dtype, f.name in _ASCENDING).copy()
        return State(*[read(p, f) for p, f in zip(parts, fields(State))])

    def documents(self, places: np.ndarray) -> np.ndarray:
        return self.doc_id[np.searchsorted(self.doc_at, places, side="right") - 1]


_ASCENDING = {"doc_at", "word_at", "start", "win", "begin", "end"}
_REPEATED = {"word", "name", "ref"}


def _coded(values: np.ndarray) -> bytes:
    """The different values, the most frequent first, and for each value its number among them: small ones, that compress well."""
    of, own = pd.factorize(values)
    order = np.lexsort((own, -np.bincount(of, minlength=len(own))))
    rank = np.empty(len(own), np.uint32)
    rank[order] = np.arange(len(own))
    table = pack(own[order])
    return len(table).to_bytes(4, "little") + table + pack(rank[of])


def _decoded(data: bytes, kind: np.dtype) -> np.ndarray:
    size = int.from_bytes(data[:4], "little")
    return unpack(data[4 : 4 + size], kind)[unpack(data[4 + size :], np.uint32)]


def union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges' union as ascending ranges that don't touch."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    return begin[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)]


def _meets(begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether each of the places low to high meets one of the separate, ascending ranges."""
    if not len(begin):
        return np.zeros(len(low), bool)
    at = np.searchsorted(end, low, side="right")
    return (at < len(begin)) & (begin[np.minimum(at, len(begin) - 1)] < high)


def _inside(begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether each of the ranges low to high lies within one of the separate, ascending ranges."""
    if not len(begin):
        return np.zeros(len(low), bool)
    at = np.searchsorted(begin, low, side="right") - 1
    return (at >= 0) & (end[np.maximum(at, 0)] >= high)


def narrowed(x: State, window: int) -> State:
    """x without the words and symbols that no open window covers, and without symbols of one document: they end where equal windows differ."""
    begin, end = union(x.win, x.win + window)
    held, near = _meets(begin, end, x.word_at, x.word_at + 1), _meets(begin, end, x.start, x.start + x.size) & (x.name > 0)
    x.word_at, x.word = x.word_at[held], x.word[held]
    x.start, x.size, x.name, x.ref = x.start[near], x.size[near], x.name[near], x.ref[near]
    return x


def settled(x: State, name: np.ndarray, least: np.ndarray, window: int) -> State:
    """x after its asks were answered: their names (0: one document alone has it) and the least documents that hold them."""
    asked = x.ref >= 0
    at = x.ref[asked]
    alone, late = asked.copy(), asked.copy()
    x.name[asked] = name[at]
    alone[asked] = name[at] == 0
    late[asked] = (name[at] == 0) | (least[at] >= x.documents(x.start[asked]))
    first, last = np.searchsorted(x.start, x.win + x.low), np.searchsorted(x.start, x.win + x.high)
    count = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    total, lates = count(alone), count(late)
    alive = total[last] == total[first]
    x.asks &= lates[last] == lates[first]
    gone = asked & ~late & (x.size >= window)
    x.begin, x.end = union(np.concatenate([x.begin, x.start[gone]]), np.concatenate([x.end, (x.start + x.size)[gone]]))
    x.win, x.low, x.high, x.asks = x.win[alive], x.low[alive], x.high[alive], x.asks[alive]
    x.ref[:] = -1
    return narrowed(x, window)


def compressed(x: State, turn: int, steps: int) -> tuple[State, tuple[np.ndarray, ...]]:
    """x with one round's runs (not in the first round) and pairs; and each new symbol's hash, width, elements and least and last document."""
    start, size, name = x.start, x.size, x.name
    sym, own = pd.factorize(name)
    content = mixed(own + _ODD)  # what decides over halves: the same for the same symbol everywhere
    i, j = np.searchsorted(start, x.win + x.low), np.searchsorted(start, x.win + x.high)

    def moved(new: np.ndarray) -> None:
        """The windows' symbols by new numbers; new has one entry more than there are symbols."""
        nonlocal i, j
        j = np.maximum(i, j)
        i, j = new[i], new[j]

    times, first = np.ones(len(start), np.int64), np.arange(len(start))
    if turn and len(start):
        new = np.concatenate([[True], (sym[1:] != sym[:-1]) | (start[1:] != start[:-1] + size[:-1])])
        first, number = np.flatnonzero(new), np.cumsum(new) - 1
        open_ = j > i  # the runs at both ends may go on beyond the window
        i, j = np.where(open_, number[np.minimum(i, len(start) - 1)] + 1, 0), np.where(open_, number[np.maximum(j, 1) - 1], 0)
        j = np.maximum(i, j)
        times = np.diff(np.append(first, len(start)))
        size, start, name, sym = np.add.reduceat(size, first), start[first], name[first], sym[first]
        with np.errstate(over="ignore"):
            sym, held = pd.factorize(sym.astype(np.uint64) << np.uint64(32) | times.astype(np.uint64))
            content = mixed(content[(held >> np.uint64(32)).astype(np.int64)] * _ODD + (held & np.uint64(0xFFFFFFFF)))
    elements = np.empty(len(start), _ELEMENT)
    elements["name"], elements["times"] = name, times
    base, width = np.arange(len(start)), np.ones(len(start), np.int64)
    for step in range(steps):
        if len(start) < 2:
            break
        left = (mixed(content + np.uint64((1 + turn * steps + step) * int(_MORE) % 2**64)) & np.uint64(1) == 0)[sym]
        pair = left[:-1] & ~left[1:] & (start[1:] == start[:-1] + size[:-1])
        open_ = j > i  # a right half at the start, a left half at the end may belong to a neighbour outside
        i = i + (open_ & ~left[np.minimum(i, len(start) - 1)])
        j = j - ((j > i) & left[np.maximum(j, 1) - 1])
        keep = np.concatenate([[True], ~pair])
        moved(np.append(np.cumsum(keep) - 1, keep.sum()))
        one = np.flatnonzero(pair)
        with np.errstate(over="ignore"):
            joint, held = pd.factorize(sym[one].astype(np.uint64) << np.uint64(32) | sym[one + 1].astype(np.uint64))
            more = mixed(content[(held >> np.uint64(32)).astype(np.int64)] * _ODD + content[(held & np.uint64(0xFFFFFFFF)).astype(np.int64)] * _MORE)
        sym[one] = len(content) + joint
        size[one] += size[one + 1]
        width[one] += width[one + 1]
        content = np.concatenate([content, more])
        start, size, sym, base, width = start[keep], size[keep], sym[keep], base[keep], width[keep]
    full = j > i
    last_ = max(len(start) - 1, 0)
    low = np.where(full, start[np.minimum(i, last_)] - x.win, 0) if len(start) else i
    high = np.where(full, (start + size)[np.maximum(j, 1) - 1] - x.win, 0) if len(start) else i
    x.low, x.high = low.astype(np.uint16), high.astype(np.uint16)
    new = (width > 1) | (elements["times"][base] > 1) if len(start) else np.zeros(0, bool)
    rows = np.flatnonzero(new)
    of, kinds = pd.factorize(sym[rows])
    lead = np.empty(len(kinds), np.int64)
    lead[of[::-1]] = np.arange(len(rows))[::-1]  # the first of each kind is written last
    x.start, x.size, x.name, x.ref = start, size, np.where(new, np.uint64(0), elements["name"][base] if len(start) else np.uint64(0)).astype(np.uint64), np.full(len(start), -1)
    x.ref[rows] = of
    least, last = _extremes(of, x.documents(start[rows]), len(kinds))
    some = rows[lead]
    return x, (content[kinds], width[some], elements[spread(base[some], width[some])], least, last)


def _extremes(of: np.ndarray, values: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the last value of each group 0 to count - 1; all have one."""
    least, last = np.full(count, np.iinfo(np.int64).max), np.full(count, _NEVER)
    np.minimum.at(least, of, values)
    np.maximum.at(last, of, values)
    return least, last


# ---- rows that travel


def _bundle(*columns: np.ndarray) -> bytes:
    """Arrays as one compressed piece, low bytes of all values first: a bucket's asks are few, so that pieces of their own would cost more than they hold."""
    head = np.array([len(columns), *[len(c) for c in columns]], np.uint32).tobytes()
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns if len(c)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *planes]))


def _unbundle(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes, at, out = raw[4 : 4 + 4 * len(kinds)].view(np.uint32), 4 + 4 * len(kinds), []
    for size, kind in zip(sizes, map(np.dtype, kinds)):
        end = at + int(size) * kind.itemsize
        out.append(np.ascontiguousarray(raw[at:end].reshape(kind.itemsize, -1).T).reshape(-1).view(kind) if size else np.zeros(0, kind))
        at = end
    return out


class Rows:
    """Rows for the next table: one state and the asks of a batch."""

    def __init__(self, batch: int):
        self.batch, self.rows = batch, []

    def state(self, x: State, more: list[bytes] | None = None) -> None:
        self.rows.append(("state", None, [*x.parts(), *(more or [])]))

    def asks(self, bucket: np.ndarray, parts: Callable[[np.ndarray], list[bytes]]) -> np.ndarray:
        """A row for each bucket with what parts makes of its asks; the place of each ask in the order of the answers."""
        order = np.argsort(bucket, kind="stable")
        edges = runs(bucket[order])
        for b, e in zip(edges[:-1], edges[1:]):
            self.rows.append(("ask", int(bucket[order[b]]), parts(order[b:e])))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return place

    def table(self) -> pa.Table:
        kind, bucket, parts = zip(*self.rows) if self.rows else ((), (), ())
        return pa.table({"kind": pa.array(kind, pa.string()), "bucket": pa.array(bucket, pa.int32()), "batch": pa.array([self.batch] * len(kind), pa.int64()), "parts": pa.array(parts, pa.list_(pa.binary()))})


def _symbol_parts(width: np.ndarray, elements: np.ndarray, least: np.ndarray, last: np.ndarray) -> Callable[[np.ndarray], list[bytes]]:
    begin = np.cumsum(width) - width

    def parts(some: np.ndarray) -> list[bytes]:
        held = elements[spread(begin[some], width[some])]
        return [_bundle(width[some].astype(np.uint32), held["name"], held["times"], least[some], last[some] - least[some])]

    return parts


def _keys(parts: list[list[bytes]]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The keys of all asks as bytes, the number of asks of each row, and their least and last documents. Words come with their bytes, symbols with elements."""
    found = []
    for p in parts:
        if len(p) == 1:
            width, name, times, least, more = _unbundle(p[0], np.uint32, np.uint64, np.uint32, np.int64, np.int64)
            held = np.empty(len(name), _ELEMENT)
            held["name"], held["times"] = name, times
            found.append((width.astype(np.int64) * _ELEMENT.itemsize, held.tobytes(), least, least + more))
        else:
            width, least, more = _unbundle(p[0], np.uint32, np.int64, np.int64)
            found.append((width.astype(np.int64), zstandard.ZstdDecompressor().decompress(p[1]), least, least + more))
    sizes, bodies, least, last = zip(*found)
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    keys = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(bodies))])
    return keys, np.array([len(x) for x in sizes]), np.concatenate(least), np.concatenate(last)


def _name(level: int):
    def name(asked: pa.Table) -> pa.Table:
        """A number for each different key of the bucket that two documents share, 0 for others, and the least document."""
        asked = asked.sort_by("batch")
        parts = asked["parts"].to_pylist()
        keys, counts, least, last = _keys(parts)
        coded = keys.dictionary_encode()
        of, count = np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)
        least, last = _extremes(of, least, count)[0], _extremes(of, last, count)[1]
        shared = least < last
        names = np.where(shared, (level << 58) + (asked["bucket"][0].as_py() << 34) + np.cumsum(shared), 0).astype(np.uint64)
        least = np.where(shared, least, 0)
        ends = np.cumsum(counts)
        out = [[_bundle(names[of[e - n : e]], least[of[e - n : e]])] for e, n in zip(ends, counts)]
        return pa.table({"batch": asked["batch"], "bucket": asked["bucket"], "parts": pa.array(out, pa.list_(pa.binary()))})

    return released(name)


def _wanted(asked: pa.Table) -> pa.Table:
    """For each batch's windows by hash: whether a later document asks for a window with this hash that an earlier one has."""
    asked = asked.sort_by("batch")
    parts = asked["parts"].to_pylist()
    own, least, asks = zip(*[_unbundle(p[0], np.uint64, np.int64, np.int64) for p in parts])
    sizes = [len(x) for x in own]
    of, _ = pd.factorize(np.concatenate(own))
    first, last = _extremes(of, np.concatenate(least), int(of.max(initial=-1)) + 1)[0], _extremes(of, np.concatenate(asks), int(of.max(initial=-1)) + 1)[1]
    told = (last > first)[of]
    ends = np.cumsum(sizes)
    out = [[_bundle(told[e - n : e].astype(np.uint8))] for e, n in zip(ends, sizes)]
    return pa.table({"batch": asked["batch"], "bucket": asked["bucket"], "parts": pa.array(out, pa.list_(pa.binary()))})


def _told(answers: pa.Table, *kinds: type) -> list[np.ndarray]:
    parts = [_unbundle(p[0], *kinds) for p in answers.sort_by("bucket")["parts"].to_pylist()]
    return [np.concatenate([np.zeros(0, kind), *[p[k] for p in parts]]) for k, kind in enumerate(kinds)]


# ---- steps of a batch


def _read(docs: DataFrame, window: int, buckets: int, path: str) -> DataFrame:
    """Rows of kind `text` (a batch's keys and texts), `state` and `ask`; words are asked for."""
    kind = T.StructType.fromDDL(_ROW).add("keys", T.ArrayType(docs.schema["key"].dataType))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in numbered(batches):
            strings = utf8(rows.column("text"))
            starts, flat = words(strings)
            id_, count = rows.column("id"), np.diff(starts)
            named = np.asarray(pc.is_valid(id_))
            x = State(doc_at=starts[:-1] + np.arange(len(count)), doc_id=np.asarray(pc.fill_null(id_, 0)).astype(np.int64))
            doc = np.repeat(np.arange(len(count)), count)
            held = (named & (count >= window))[doc]
            place = np.arange(len(doc)) + doc
            out, texts = Rows(number), zstandard.ZstdCompressor(level=3)
            coded = flat.filter(pa.array(held)).dictionary_encode()
            sym, own = np.asarray(coded.indices).astype(np.int64), coded.dictionary
            x.word_at = x.start = place[held]
            x.size, x.name, x.word = np.ones(len(sym), np.int64), np.zeros(len(sym), np.uint64), np.zeros(len(sym), np.uint64)
            x.win = place[held & (np.arange(len(doc)) + window <= starts[1:][doc])]
            x.low, x.high, x.asks = np.zeros(len(x.win), np.uint16), np.full(len(x.win), window, np.uint16), np.ones(len(x.win), bool)
            least, last = _extremes(sym, x.doc_id[doc[held]], len(own))
            sizes, begin, body = np.diff(offsets_of(own)).astype(np.int64), offsets_of(own)[:-1].astype(np.int64), bytes_of(own)
            parts = lambda some: [_bundle(sizes[some].astype(np.uint32), least[some], last[some] - least[some]), zstandard.ZstdCompressor(level=1).compress(body[spread(begin[some], sizes[some])].tobytes())]
            x.ref = out.asks((mixed(hashed(own)) % np.uint64(buckets)).astype(np.int64), parts)[sym] if len(own) else np.zeros(0, np.int64)
            out.state(x)
            table = out.table().append_column("keys", pa.nulls(len(out.rows), pa.list_(rows.column("key").type)))
            text = [pack(offsets_of(strings).astype(np.int64), True), texts.compress(bytes_of(strings).tobytes())]
            first = pa.table({"kind": ["text"], "bucket": pa.array([None], pa.int32()), "batch": pa.array([number], pa.int64()), "parts": pa.array([text], pa.list_(pa.binary())), "keys": lists(rows.column("key"))})
            yield from pa.concat_tables([first, table]).combine_chunks().to_batches()

    return materialize(docs.mapInArrow(read, kind), "", by="kind", path=path)


def _round(turn: int, steps: int, window: int, buckets: int):
    def act(row: pa.Table, answers: pa.Table) -> pa.Table:
        """One batch: the last asks' answers are taken in, and the next round's symbols are asked for."""
        if not row.num_rows:
            return Rows(0).table()
        x, out = State.of(row["parts"][0].as_py()), Rows(row["batch"][0].as_py())
        x = settled(x, *_told(answers, np.uint64, np.int64), window)
        if not turn:
            x.word = x.name.copy()
        x, (content, *asked) = compressed(x, turn, steps)
        place = out.asks((mixed(content) % np.uint64(buckets)).astype(np.int64), _symbol_parts(*asked))
        some = x.ref >= 0
        x.ref[some] = place[x.ref[some]]
        out.state(x)
        return out.table()

    return released(act)


def _windows(x: State, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each open window's words begin among x.word, and a hash of its words."""
    at = np.searchsorted(x.word_at, x.win)
    total, own = np.zeros(len(at), np.uint64), mixed(x.word + _ODD)
    with np.errstate(over="ignore"):
        for k in range(window):
            total = (total ^ own[at + k]) * _ODD
            total ^= total >> np.uint64(29)
    return at, total


def _candidates(window: int, buckets: int):
    def act(row: pa.Table, answers: pa.Table) -> pa.Table:
        """The open windows by hash: the first document that has one, and the last that asks for it."""
        if not row.num_rows:
            return Rows(0).table()
        x, out = State.of(row["parts"][0].as_py()), Rows(row["batch"][0].as_py())
        x = settled(x, *_told(answers, np.uint64, np.int64), window)
        x.asks &= ~_inside(x.begin, x.end, x.win, x.win + window)
        of, own = pd.factorize(_windows(x, window)[1])
        doc = x.documents(x.win)
        least, asks = _extremes(of, doc, len(own))[0], _extremes(of, np.where(x.asks, doc, _NEVER), len(own))[1]
        place = out.asks((own % np.uint64(buckets)).astype(np.int64), lambda some: [_bundle(own[some], least[some], asks[some])])
        out.state(x, [pack(place[of])])
        return out.table()

    return released(act)


def _verified(window: int, buckets: int):
    def act(row: pa.Table, answers: pa.Table) -> pa.Table:
        """The words of the windows that are wanted, each different window once."""
        if not row.num_rows:
            return Rows(0).table()
        parts = row["parts"][0].as_py()
        x, out = State.of(parts[:-1]), Rows(row["batch"][0].as_py())
        wanted = _told(answers, np.uint8)[0][unpack(parts[-1], np.int64)] > 0
        x.win, x.low, x.high, x.asks = (v[wanted] for v in (x.win, x.low, x.high, x.asks))
        at, own = _windows(x, window)
        rows = x.word[at[:, None] + np.arange(window)]
        kinds, lead, of = np.unique(rows, axis=0, return_index=True, return_inverse=True) if len(rows) else (rows, at, at)
        of = of.reshape(-1)
        elements = np.empty(len(kinds) * window, _ELEMENT)
        elements["name"], elements["times"] = kinds.reshape(-1), 1
        doc = x.documents(x.win)
        least, last = _extremes(of, doc, len(kinds))
        place = out.asks((own[lead] % np.uint64(buckets)).astype(np.int64), _symbol_parts(np.full(len(kinds), window), elements, least, last))
        keep = State(doc_at=x.doc_at, doc_id=x.doc_id, win=x.win, asks=x.asks, begin=x.begin, end=x.end)
        out.state(keep, [pack(place[of])])
        return out.table()

    return released(act)


def _spans(window: int):
    def act(row: pa.Table, answers: pa.Table) -> pa.Table:
        """The ranges of a batch's places that are to go."""
        if not row.num_rows:
            return Rows(0).table()
        parts = row["parts"][0].as_py()
        x, out = State.of(parts[:-1]), Rows(row["batch"][0].as_py())
        name, least = _told(answers, np.uint64, np.int64)
        of = unpack(parts[-1], np.int64)
        gone = x.win[(name[of] > 0) & (least[of] < x.documents(x.win))]
        begin, end = union(np.concatenate([x.begin, gone]), np.concatenate([x.end, gone + window]))
        out.rows.append(("spans", None, [pack(begin, True), pack(end, True)]))
        return out.table()

    return released(act)


def _cut(row: pa.Table, spans: pa.Table) -> pa.Table:
    """Each text's words outside its batch's ranges."""
    keys = row["keys"].combine_chunks().flatten() if row.num_rows else row["keys"].combine_chunks().values[:0]
    count, gone, kept = np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    if row.num_rows:
        offsets, body = row["parts"][0].as_py()
        offsets = unpack(offsets, np.int64, True).astype(np.int32)
        starts, flat = words(pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(zstandard.ZstdDecompressor().decompress(body))]))
        count = np.diff(starts)
        place = np.arange(len(flat)) + np.repeat(np.arange(len(count)), count)
        begin, end = (unpack(p, np.int64, True) for p in spans["parts"][0].as_py()) if spans.num_rows else (count[:0], count[:0])
        stays = ~_meets(begin, end, place, place + 1)
        before = np.concatenate([[0], np.cumsum(stays)])
        left = before[starts]
        gone = count - np.diff(left)
        kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(stays))), " ")
    return pa.table({"key": keys, "n_words": pa.array(count, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": kept})


def without_earlier(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS, steps: int = STEPS) -> DataFrame:
    """Each row's other columns with n_words, n_removed and kept: the text's words, joined by blanks, less those that an earlier text has.

    A word goes if a window of `window` words over it also stands in a row with a smaller key (a whole number); windows are judged
    on all texts as they come. Words stand between ASCII blanks. Rows with a null key stay whole, and no other row loses words to
    them; rows with one key lose nothing to each other. Null and short texts lose nothing, an empty table gives no rows, a very long
    text is a batch of its own. An input column that is named like a result gives way to it. rounds and steps (pairs joined in a
    round) change what is compared, not the result.
    """
    if not (2 <= window < 60_000 and 1 <= rounds < 28 and steps >= 1):
        raise ValueError("a window has 2 words or more, under 60,000; there are 1 to 27 rounds of 1 step or more")
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != text and (c not in RESULT or c == key)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("key"), F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    buckets = bucket_count(spark)
    path = new_path(spark, "recompression")
    table = _read(rows, window, buckets, path)
    texts, now = table.where("kind = 'text'").select("batch", "keys", "parts"), table.select(*[c for c in table.columns if c != "keys"])
    turns = [*((_name(t), _round(t, steps, window, buckets)) for t in range(rounds)), (_name(rounds), _candidates(window, buckets)), (released(_wanted), _verified(window, buckets)), (_name(rounds + 1), _spans(window))]
    for answer, act in turns:
        # what a step has read goes when the next one is written, so that only the texts and one round are held
        told = new_path(spark, "recompression-names")
        answers = materialize(now.where("kind = 'ask'").select("bucket", "batch", "parts").groupBy("bucket").applyInArrow(answer, "batch long, bucket int, parts array<binary>"), "", path=told)
        removed(spark, f"{path}/kind=ask")
        state, last = now.where("kind = 'state'").select("batch", "parts"), path
        path = new_path(spark, "recompression-round")
        now = materialize(state.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(act, _ROW), "", by="kind", path=path)
        removed(spark, f"{last}/kind=state")
        removed(spark, told)
    out = T.StructType([T.StructField("key", rows.schema["key"].dataType), *T.StructType.fromDDL("n_words long, n_removed long, kept string").fields])
    spans = now.where("kind = 'spans'").select("batch", "parts")
    found = texts.groupBy("batch").cogroup(spans.groupBy("batch")).applyInArrow(released(_cut), out)
    return found.select(*[F.col("key")[c].alias(c) for c in others], "n_words", "n_removed", "kept")
