"""Benchmark passages in documents: a prefix-filtered join of item windows, verified where they would stand."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize
from tessera.llm.text import byte_table, hashed, mapped, mixed, rows_of, slices, utf8, words

WINDOW = 10
#: Windows that are sent to the executors at once; a larger benchmark goes in several blocks of about this size.
BLOCK_WINDOWS = 200_000
#: Words are counted in so many slots (two to this power), by the first bits of their hashes.
SLOT_BITS = 20
#: Blocks that one stage holds against the texts, a Python worker each; their result is written before the next ones start.
BLOCKS_AT_ONCE = 4
#: Everything of ASCII but digits and letters parts words.
WORD_BYTES = byte_table(lower=True, separators=bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def item_words(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's words begin, and their hashes: a-z, digits and all beyond ASCII, with A-Z lowered."""
    starts, flat = words(mapped(strings, WORD_BYTES))
    return starts, hashed(flat)


def sequence_hash(hashes: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the `length` words from each place on."""
    one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            word = hashes[at + k]
            one = one * np.uint64(0x9E3779B97F4A7C15) + mixed(word + np.uint64(k + 1))
            two = two * np.uint64(0xC2B2AE3D27D4EB4F) + mixed(word ^ np.uint64(0xA5A5A5A5 + k))
    return one, two


@dataclass
class Block:
    """Windows of some items, ready to be looked for."""

    tokens: np.ndarray  # prefix tokens, ascending
    first: np.ndarray  # where each token's places begin in offset and length
    offset: np.ndarray
    length: np.ndarray
    keys: np.ndarray  # hashes of the windows, ascending, with a second hash and where the window's items begin
    second: np.ndarray
    items_from: np.ndarray
    items: np.ndarray  # numbers in ids
    ids: list[str]


def item_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item string, window array<long>): all windows of each item's words; an item of fewer words is one window, one without words none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            starts, hashes = item_words(utf8(part.column("text")))
            size = np.minimum(np.diff(starts), window)
            count = np.where(size > 0, np.diff(starts) - size + 1, 0)
            row = np.repeat(np.arange(len(count)), count)
            begin = starts[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            each = size[row]
            ends = np.cumsum(each)
            flat = hashes[np.repeat(begin - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(row)), lists], ["item", "window"])

    rows = benchmark.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "item string, window array<long>")


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slot_counts(docs: DataFrame, wanted: np.ndarray, text: str = "text") -> np.ndarray:
    """How many words of all documents fall in each slot, for the wanted slots (flags), one pass for the whole benchmark."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.unpackbits(sent.value)
        totals = np.zeros(len(own), np.int64)
        for part in slices(batches):
            _, flat = words(mapped(utf8(part.column("text")), WORD_BYTES))
            coded = flat.dictionary_encode()
            each = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary)) if len(flat) else np.zeros(0, np.int64)
            np.add.at(totals, _slot(hashed(coded.dictionary)), each)
        full = np.flatnonzero(totals * own)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(totals[full])], ["slot", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << SLOT_BITS, np.int64)
    found = rows.toPandas()  # a row for each slot at most
    out[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _block(rows: list, counts: np.ndarray) -> Block:
    """Windows with items, ready to be looked for by their rarest words."""
    joined: dict[tuple[int, int], tuple[np.ndarray, list[int]]] = {}
    ids = sorted({r.item for r in rows if r.item is not None})
    number_of = {x: k for k, x in enumerate(ids)}
    for r in rows:
        own = np.asarray(r.window, np.int64).view(np.uint64)
        one, two = sequence_hash(own, np.zeros(1, np.int64), len(own))
        entry = joined.setdefault((int(one[0]), int(two[0])), (own, []))
        if r.item is not None:
            entry[1].append(number_of[r.item])
    places = set()
    for own, _ in joined.values():
        rare = int(np.argmin(counts[_slot(own)]))
        places.add((int(own[rare]), rare, len(own)))
    placed, ordered = sorted(places), sorted(joined.items())
    tokens, first = np.unique(np.array([p[0] for p in placed], np.uint64), return_index=True)
    return Block(
        tokens, np.append(first, len(placed)), np.array([p[1] for p in placed]), np.array([p[2] for p in placed]),
        np.array([k[0] for k, _ in ordered], np.uint64), np.array([k[1] for k, _ in ordered], np.uint64),
        np.concatenate([[0], np.cumsum([len(v[1]) for _, v in ordered])]).astype(np.int64), np.array([i for _, v in ordered for i in v[1]], np.int64), ids,
    )


def blocks(docs: DataFrame, benchmark: DataFrame, key: str = "item_id", text: str = "text", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> Iterator[Block]:
    """The benchmark in blocks of about block_windows windows: a stated query set that is held against all rows, block by block.

    A window's words are ordered by how often words of their slot occur in the documents. A document that contains the window
    contains all of its words, so the necessary prefix is its rarest word; any word would do, so slots that words share cost no
    result. Pairs of a window and an item are dealt by the hash of both: neither a very long item nor one that stands in very many
    rows makes a block larger, and the hits of all blocks are joined.
    """
    found = materialize(item_windows(benchmark, key, item_text, window).distinct(), "benchmark-windows")
    total = found.count()
    if not total:
        return
    slots = found.select(F.explode("window").alias("w")).select(F.shiftrightunsigned("w", 64 - SLOT_BITS).alias("slot")).distinct().toPandas()["slot"]  # 2 ** SLOT_BITS rows at most
    wanted = np.zeros(1 << SLOT_BITS, bool)
    wanted[slots.to_numpy(np.int64)] = True
    counts = slot_counts(docs, wanted, text)
    n_blocks = math.ceil(total / block_windows)
    for number in range(n_blocks):
        rows = found.where(F.pmod(F.xxhash64("item", "window"), F.lit(n_blocks)) == number).collect()  # about block_windows rows
        if rows:
            yield _block(rows, counts)


def occurrences(block: Block, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified windows in the texts: the place of the first word, the length, and the number of the window."""
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(hashes):
        return empty
    at = np.minimum(np.searchsorted(block.tokens, hashes), len(block.tokens) - 1)
    places = np.flatnonzero(block.tokens[at] == hashes)
    token = at[places]
    tries = block.first[token + 1] - block.first[token]
    place = np.repeat(places, tries)
    entry = np.repeat(block.first[token], tries) + np.arange(len(place)) - np.repeat(np.cumsum(tries) - tries, tries)
    begin, length = place - block.offset[entry], block.length[entry]
    row = np.searchsorted(starts, place, side="right") - 1
    inside = (begin >= starts[row]) & (begin + length <= starts[row + 1])  # bounds by position and length
    begin, length = begin[inside], length[inside]
    found = []
    for n in np.unique(length):
        own = np.unique(begin[length == n])
        one, two = sequence_hash(hashes, own, int(n))
        low, high = np.searchsorted(block.keys, one), np.searchsorted(block.keys, one, side="right")
        for step in range(int((high - low).max(initial=0))):  # windows that share the first hash: one but for chance
            which = np.minimum(low + step, len(block.keys) - 1)
            same = (low + step < high) & (block.second[which] == two)
            found.append((own[same], np.full(int(same.sum()), n), which[same]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else empty


def _hits(block: Block, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (row, begin, end) for the covered words, and rows (row, number of an item) without repeats."""
    begin, length, number = occurrences(block, starts, hashes)
    row = np.searchsorted(starts, begin, side="right") - 1
    spans = np.stack([row, begin - starts[row], begin - starts[row] + length], axis=1)
    each = block.items_from[number + 1] - block.items_from[number]
    item = block.items[np.repeat(block.items_from[number], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
    return spans, np.unique(np.stack([np.repeat(row, each), item], axis=1), axis=0)


def _joined(spans: np.ndarray) -> np.ndarray:
    """Spans (row, begin, end) without overlaps or touching ends."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    shift = np.int64(1 << 40)
    low, high = spans[:, 0] * shift + spans[:, 1], spans[:, 0] * shift + spans[:, 2]
    reach = np.maximum.accumulate(high)
    new = np.concatenate([[True], low[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack([spans[new, 0], spans[new, 1], reach[last] - spans[new, 0] * shift], axis=1)


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """For each row: key, n_words, spans (array of word ranges that benchmark windows cover, ends excluded), items (ids as sorted strings).

    Null and empty texts have no words and no hits. A null item id is never listed, yet its windows count. Repeated rows of either
    table give repeated rows or count once, in turn. An empty benchmark hits nothing. Other columns of the tables are left out,
    whatever their names. A very long text is searched whole, in a slice of its own; windows of a very long item are dealt over blocks.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = f"key {rows.schema['key'].dataType.simpleString()}, text string, n_words long, spans array<struct<begin:long,end:long>>, items array<string>"
    found = None
    for number, block in enumerate(blocks(docs, benchmark, item_key, text, item_text, window, block_windows)):
        found = materialize(found, "benchmark-found") if number and number % BLOCKS_AT_ONCE == 0 else found
        found = (rows if found is None else found).mapInArrow(_searched(docs.sparkSession.sparkContext.broadcast(block)), out)
    found = rows.mapInArrow(_searched(None), out) if found is None else found
    return found.select(F.col("key").alias(key), "n_words", "spans", "items")


def _lists(rows: np.ndarray, count: int) -> pa.Array:
    return pa.array(np.searchsorted(rows, np.arange(count + 1)).astype(np.int32))


def _searched(sent):
    """Adds a block's hits to what the blocks before it have found; sent is None where there are no windows."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            starts, hashes = item_words(utf8(part.column("text")))
            spans, pairs = _hits(sent.value, starts, hashes) if sent else (np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64))
            items: list[list[str]] = [[] for _ in range(part.num_rows)]
            if "spans" in part.schema.names:
                old = part.column("spans")
                ends, fields = np.asarray(old.offsets), old.values
                before = [np.asarray(fields.field(x))[ends[0] : ends[-1]] for x in ("begin", "end")]
                spans = np.concatenate([np.stack([rows_of(ends - ends[0]), *before], axis=1), spans])
                items = part.column("items").to_pylist()
            spans = _joined(spans)
            for row, item in pairs.tolist():
                items[row].append(sent.value.ids[item])
            ranges = pa.StructArray.from_arrays([pa.array(spans[:, 1], pa.int64()), pa.array(spans[:, 2], pa.int64())], ["begin", "end"])
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("text"), pa.array(np.diff(starts), pa.int64()),
                 pa.ListArray.from_arrays(_lists(spans[:, 0], part.num_rows), ranges), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))],
                ["key", "text", "n_words", "spans", "items"],
            )

    return search


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark window occurs. Cases are those of `contamination`."""
    kept = docs
    for number, block in enumerate(blocks(docs, benchmark, item_key, text, item_text, window, block_windows)):
        kept = materialize(kept, "benchmark-kept") if number and number % BLOCKS_AT_ONCE == 0 else kept
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text):
                starts, hashes = item_words(utf8(part.column(text)))
                begin, _, _ = occurrences(sent.value, starts, hashes)
                whole = np.ones(part.num_rows, bool)
                whole[np.searchsorted(starts, begin, side="right") - 1] = False
                yield part.filter(pa.array(whole))

        kept = kept.mapInArrow(keep, docs.schema)
    return kept
