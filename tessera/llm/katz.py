"""Katz backoff: Good-Turing discounted n-gram counts over exact word counts, with backoff weights that normalise exactly.

Texts are read once, in batches that keep their words as numbers of the batch's own vocabulary. Counts live in hash buckets, a table
for each order: each batch asks a bucket once for each different n-gram, and gets the corpus counts back, with what it needs to know
of the words before the last (the history). The orders are asked one after the other, for an n-gram of a history that only one batch
holds is known there, and isn't asked for. Words are numbered by their buckets, n-grams are keyed by these numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.blocks import bucket_count, lists, numbered, pack, runs, spread, unpack
from tessera.llm.scratch import materialize, new_path, removed
from tessera.llm.text import byte_table, hashed, mapped, mixed, utf8, words

ORDER = 3
#: N-grams whose history has this share of the training tokens or more (wide ones) are dealt over a bucket for each such share, those of
#: other histories stand together. Shares sum to 1, so there are 16,384 wide histories of each order at most.
WIDE_SHARE = 2.0**-14
#: Counts up to this one are discounted.
DISCOUNTED = 5
#: Bytes of text in a batch.
BATCH_BYTES = 5 << 20
END = np.uint64(0)  # stands for the end of a text, and before its first word
NONE = (1 << 32) - 1  # the number of words that no training text holds
_LOWER = byte_table(lower=True)
_RATIO = np.arange(1, DISCOUNTED + 1)


def _word_bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(word) >> np.uint64(16)) % np.uint64(buckets)


def _read(docs: DataFrame, buckets: int, path: str) -> DataFrame:
    """Rows of kind `text` (a batch's tokens as numbers of its vocabulary, sizes, training flags, keys) and `ask` (its different words in a bucket, ascending, and how often its training texts hold them).

    The vocabulary stands in the order of buckets, so answers that are put in that order are the vocabulary's.
    """
    names = ["kind", "bucket", "batch", "a", "b", "c", "keys"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in numbered(batches, size=BATCH_BYTES):
            starts, flat = words(mapped(utf8(rows.column("text")), _LOWER))
            coded = flat.dictionary_encode()
            own = np.maximum(hashed(coded.dictionary), np.uint64(1)) if len(flat) else np.zeros(0, np.uint64)
            vocabulary, local = np.unique(np.append(own, END), return_inverse=True)
            order = np.lexsort((vocabulary, _word_bucket(vocabulary, buckets)))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            local, vocabulary = place[local], vocabulary[order]
            token = np.insert(local[:-1][np.asarray(coded.indices)] if len(flat) else np.zeros(0, np.int64), starts[1:], local[-1])
            size = np.diff(starts) + 1
            train = np.asarray(rows.column("train").fill_null(True)).astype(bool)
            out = [("text", None, number, pack(token.astype(np.uint32)), pack(size.astype(np.uint32)), pack(train.astype(np.uint8)))]
            times = np.bincount(token[np.repeat(train, size)], minlength=len(vocabulary)).astype(np.uint32)
            bucket = _word_bucket(vocabulary, buckets)
            edges = runs(bucket)
            out += [("ask", int(bucket[i]), number, pack(vocabulary[i:j], True), pack(times[i:j]), None) for i, j in zip(edges[:-1], edges[1:])]
            keys = rows.column("key")
            columns = [pa.array(c, k) for c, k in zip(zip(*out), [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 3])]
            yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([lists(keys), pa.nulls(len(out) - 1, pa.list_(keys.type))])], names)

    out = T.StructType.fromDDL("kind string, bucket int, batch long, a binary, b binary, c binary").add("keys", T.ArrayType(docs.schema["key"].dataType))
    return materialize(docs.mapInArrow(read, out), "katz-texts", by="kind", path=path)


_WORDS = "kind string, bucket int, batch long, a binary, b binary, n long, v long"


def _count_words(buckets: int):
    """A bucket's size (kind `table`), and what each batch asked for: counts, doubled, plus 1 where other batches ask too, and the words' numbers."""

    def count(asked: pa.Table) -> pa.Table:
        bucket = asked["bucket"][0].as_py()
        parts = [unpack(x, np.uint64, True) for x in asked["a"].to_pylist()]
        times = np.concatenate([unpack(x, np.uint32) for x in asked["b"].to_pylist()]).astype(np.int64)
        known, at = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, at, times)
        order = np.lexsort((known, -total))
        seen = int((total > 0).sum())
        if seen * buckets >= NONE:
            raise ValueError(f"more than {NONE // buckets} different words in one of {buckets} buckets: numbers of words have 32 bits")
        number = np.full(len(known), NONE, np.int64)
        number[order[:seen]] = np.arange(seen) * buckets + bucket
        counts = 2 * total + (np.bincount(at) > 1)
        ends = np.cumsum([len(p) for p in parts])
        told = [at[e - len(p) : e] for e, p in zip(ends, parts)]
        size = len(parts)
        return pa.table({
            "kind": pa.array(["table", *["told"] * size]), "bucket": pa.array([bucket] * (size + 1), pa.int32()), "batch": pa.array([None, *asked["batch"].to_pylist()], pa.int64()),
            "a": pa.array([None, *(pack(counts[x]) for x in told)], pa.binary()), "b": pa.array([None, *(pack(number[x].astype(np.uint32)) for x in told)], pa.binary()),
            "n": pa.array([int(total.sum()), *[None] * size], pa.int64()), "v": pa.array([seen, *[None] * size], pa.int64()),
        })

    return count


def discounts(bins: np.ndarray) -> np.ndarray:
    """Katz's discount ratios for the counts 1 .. DISCOUNTED from how many pairs have each count up to DISCOUNTED + 1; 1 where that gives none in (0, 1)."""
    n = np.concatenate([[0.0], np.asarray(bins, float)])
    out = np.ones(DISCOUNTED + 1)
    if n[1] > 0:
        tail = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
        for r in range(1, DISCOUNTED + 1):
            if n[r] > 0 and tail < 1:
                ratio = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
                out[r] = ratio if 0 < ratio < 1 else 1.0
    return out


@dataclass
class Sums:
    """Of histories: how many n-grams with each count up to DISCOUNTED begin with them (a column for each), and the lower order's probability of all words seen after them."""

    times: np.ndarray
    lower: np.ndarray

    @staticmethod
    def of(group: np.ndarray, count: int, total: np.ndarray, lower: np.ndarray) -> Sums:
        """group: the history, of `count`, of each n-gram; total: its training count; lower: its probability by the lower order."""
        times = np.stack([np.bincount(group[total == r], minlength=count) for r in _RATIO], axis=1)
        return Sums(times, np.bincount(group, np.where(total > 0, lower, 0.0), count))

    def take(self, at: np.ndarray) -> Sums:
        return Sums(self.times[at], self.lower[at])

    @property
    def held(self) -> np.ndarray:
        """A bit for each count that any n-gram has."""
        return ((self.times > 0) << np.arange(DISCOUNTED)).sum(axis=1).astype(np.uint8)


@dataclass
class Katz:
    """What all executors know of the model: sizes, discounts by order, and sums of the wide histories by order (16,384 of each at most)."""

    tokens: int
    types: int
    buckets: int
    wide: float
    discount: dict[int, np.ndarray] = field(default_factory=dict)
    wide_sums: dict[int, tuple[np.ndarray, Sums]] = field(default_factory=dict)  # keys, ascending

    def word_probability(self, count: np.ndarray) -> np.ndarray:
        """One is added to each count; what no training text holds counts as one word more."""
        return (np.asarray(count, float) + 1) / (self.tokens + self.types + 1)

    def taken(self, order: int, count: np.ndarray) -> np.ndarray:
        """Discounted counts of n-grams."""
        return np.where(count > DISCOUNTED, 1.0, self.discount[order][np.minimum(count, DISCOUNTED)]) * count

    def below(self, order: int, count: np.ndarray, held: np.ndarray) -> np.ndarray:
        """What discounted counts after a history are divided by: its count, or, where nothing after it is discounted, one more, so that something is left for what was not seen."""
        bits = int(((self.discount[order][1:] < 1) << np.arange(DISCOUNTED)).sum())
        return count + ((held & bits) == 0)

    def backoff(self, order: int, count: np.ndarray, sums: Sums) -> np.ndarray:
        """What is left for words not seen after a history, over what the lower order gives them."""
        below = self.below(order, count, sums.held)
        left = np.where(below > count, 1 / below, (sums.times * _RATIO * (1 - self.discount[order][1:])).sum(axis=1) / np.maximum(count, 1))
        return left / (1 - sums.lower)


def _ids(parts: list[np.ndarray]) -> np.ndarray:
    """A number for each different row of 32-bit columns, in their order."""
    ids = parts[0].astype(np.uint64)
    for more in parts[1:]:
        ids = np.unique((np.unique(ids, return_inverse=True)[1].astype(np.uint64) << np.uint64(32)) | more.astype(np.uint64), return_inverse=True)[1]
    return np.unique(ids, return_inverse=True)[1]


def _key(parts: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key of each row of numbers; one and two numbers are the key themselves."""
    key = parts[0].astype(np.uint64)
    for more in parts[1:]:
        key = (key << np.uint64(32)) | more.astype(np.uint64) if len(parts) == 2 else mixed(mixed(key + np.uint64(1)) + more.astype(np.uint64))
    return key


def _sorted(code: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each different code (from 0 to top), in ascending order of codes, and for each place which of them stands there."""
    if top.bit_length() + len(code).bit_length() > 63:
        _, first, place = np.unique(code, return_index=True, return_inverse=True)
        return first, place
    shift = len(code).bit_length()
    both = np.sort((code << shift) | np.arange(len(code)))  # codes with their places: one sort of numbers
    at, both = both & ((1 << shift) - 1), both >> shift
    new = np.ones(len(code), bool)
    new[1:] = both[1:] != both[:-1]
    place = np.empty(len(code), np.int64)
    place[at] = np.cumsum(new) - 1
    return at[new], place


class _Grams:
    """A batch's different n-grams of one order after known histories: `place` of each token in `tokens`, `rep` one token of each."""

    def __init__(self, batch: _Batch, order: int):
        model, self.order = batch.model, order
        history, count, shared = batch.history(order)
        self.tokens = np.flatnonzero(count > 0)
        code = history[self.tokens].astype(np.int64) * batch.vocabulary + batch.token[self.tokens]
        first, self.place = _sorted(code, len(batch.token) * batch.vocabulary)
        self.rep = self.tokens[first]
        edges = runs(history[self.rep])  # codes ascend, and histories with them
        lead, sizes = self.rep[edges[:-1]], np.diff(edges)
        self.group = np.repeat(np.arange(len(lead)), sizes)
        self.count, self.asked = count[lead], shared[lead]
        self.wide = self.count >= model.wide
        self.parts = [batch.before(lead, k) for k in range(order - 1, 0, -1)]
        self.last = batch.number[batch.token[self.rep]]
        self.times = np.bincount(self.place, batch.train[self.tokens], len(self.rep)).astype(np.int64)
        self.low = batch.count[self.rep]  # of the n-gram without its first word
        self.low_below = None if order == 2 else batch.below[lead]
        key = _key(self.parts)
        bucket = _word_bucket(key, model.buckets).astype(np.int64)
        order_ = np.lexsort(self.parts[::-1]) if order > 3 else np.argsort(key, kind="stable")
        order_ = order_[np.argsort(bucket[order_], kind="stable")]
        narrow, wide = (order_[self.asked[order_] & (self.wide[order_] == w)] for w in (False, True))
        # a wide history stands in as many buckets as its count is times the limit
        some = spread(edges[:-1][wide], sizes[wide])
        own = self.group[some]
        ways = np.minimum(np.ceil(self.count[own] / model.wide).astype(np.uint64), np.uint64(model.buckets))
        dealt = (bucket[own] + ((mixed(key[own] ^ mixed(self.last[some].astype(np.uint64))) >> np.uint64(8)) % ways).astype(np.int64)) % model.buckets
        sent = np.concatenate([spread(edges[:-1][narrow], sizes[narrow]), some])
        dealt = np.concatenate([np.repeat(bucket[narrow], sizes[narrow]), dealt])
        order_ = np.argsort(dealt, kind="stable")  # histories stay together in a bucket, the narrow ones first
        self.sent, self.bucket = sent[order_], dealt[order_]  # the n-grams asked for, in the order of asking

    def local(self, model: Katz) -> Sums:
        """Sums as far as this batch alone knows them: whole ones for histories that it doesn't share."""
        return Sums.of(self.group, len(self.count), self.times, _lower(model, self.order, self.low, None if self.low_below is None else self.low_below[self.group]))


def _lower(model: Katz, order: int, low: np.ndarray, below: np.ndarray | None) -> np.ndarray:
    """Probability of n-grams' last words by the order below, from the counts without the first word."""
    return model.word_probability(low) if order == 2 else model.taken(order - 1, low) / below


class _Batch:
    """A batch's tokens with what the tables of the orders up to `known` have told of them."""

    def __init__(self, row: pa.Table, told: pa.Table, model: Katz, known: int):
        self.model = model
        token, size, self.trains = (unpack(row[c][0].as_py(), t) for c, t in (("a", np.uint32), ("b", np.uint32), ("c", np.uint8)))
        self.token, self.size = token.astype(np.int64), size.astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.at = np.arange(len(token)) - np.repeat(self.begin, self.size)
        self.train = np.repeat(self.trains, self.size)
        counts, number = _told(told, 1, "a", np.int64), _told(told, 1, "b", np.uint32).astype(np.int64)
        self.vocabulary, self.number, self.end = len(counts), number, self.token[-1]  # the last of all tokens is an end
        self.words = counts >> 1, (counts & 1) > 0
        self.grams, self.count, self.shared, self.below = self.token, self.words[0][self.token], self.words[1][self.token], None
        self.base = self.chance = model.word_probability(self.count)
        for order in range(2, known + 1):
            self._learn(_Grams(self, order), told)

    def before(self, tokens: np.ndarray, k: int) -> np.ndarray:
        """Numbers of the words k before these tokens; before a text stands its end."""
        return self.number[np.where(self.at[tokens] >= k, self.token[np.maximum(tokens - k, 0)], self.end)]

    def history(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token the words before it: their number among the batch's n-grams, training count (0: not known, or the text is too short), and whether other batches hold them."""
        moved = lambda x: np.concatenate([x[-1:], x[:-1]])
        if order == 2:
            first = self.at == 0
            word = np.where(first, self.end, moved(self.token))
            return word, self.words[0][word], self.words[1][word]
        there = self.at >= order - 2
        return moved(self.grams), np.where(there, moved(self.count), 0), moved(self.shared)

    def _learn(self, g: _Grams, told: pa.Table) -> None:
        model, order = self.model, g.order
        sums, total, shared = g.local(model), g.times.copy(), np.zeros(len(g.rep), bool)
        answer = _told(told, order, "a", np.int64)
        total[g.sent], shared[g.sent] = answer >> 1, (answer & 1) > 0
        group = g.group[g.sent]
        edges = runs(g.bucket, group)
        asked = group[edges[:-1]]
        narrow = ~g.wide[asked]
        held = sums.held
        held[asked[narrow]] = _told(told, order, "b", np.uint8)[narrow]
        zero = np.minimum.reduceat(total[g.sent], edges[:-1]) == 0 if len(asked) else narrow
        lacking = asked[narrow & zero]
        sums.times[lacking] = _told(told, order, "c", np.int64).reshape(-1, DISCOUNTED)
        sums.lower[lacking] = _told(told, order, "d", np.float64)
        wide = np.flatnonzero(g.wide & g.asked)
        if len(wide):
            keys, known = model.wide_sums[order]
            whole = known.take(np.searchsorted(keys, _key([p[wide] for p in g.parts])))
            sums.times[wide], sums.lower[wide], held[wide] = whole.times, whole.lower, whole.held
        below = model.below(order, g.count, held)
        backoff = np.ones(len(below))
        open_ = np.unique(g.group[total == 0])  # only there the sums are needed, and whole
        backoff[open_] = model.backoff(order, g.count[open_], sums.take(open_))
        seen = total[g.place] > 0
        self.chance = self.chance.copy()
        own = g.group[g.place]
        self.chance[g.tokens] = np.where(seen, model.taken(order, total[g.place]) / below[own], backoff[own] * self.chance[g.tokens])
        count, shares, divided, grams = np.zeros(len(self.token), np.int64), np.zeros(len(self.token), bool), np.ones(len(self.token), np.int64), np.zeros(len(self.token), np.int64)
        count[g.tokens], shares[g.tokens], divided[g.tokens], grams[g.tokens] = total[g.place], shared[g.place], below[own], g.place
        self.count, self.shared, self.below, self.grams = count, shares, divided, grams


def _told(told: pa.Table, order: int, column: str, kind: type) -> np.ndarray:
    """A batch's answers, in the order of buckets."""
    rows = told.filter(pc.equal(told["order"], order)).sort_by("bucket")
    return np.concatenate([unpack(x, kind) for x in rows[column].to_pylist()] or [np.zeros(0, kind)])


def _bins(total: np.ndarray) -> np.ndarray:
    """How many n-grams have each count from 1 to DISCOUNTED + 1."""
    return np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]


_ASKS = "bucket int, batch long, h binary, p binary, l binary, w binary, t binary, o binary, d binary, x binary, bins array<long>"


def _asks(sent, order: int):
    def ask(row: pa.Table, told: pa.Table) -> pa.Table:
        """What a batch asks each bucket: histories (first words, the others), how many n-grams each has here, and of these the last words, training counts and counts without the first word."""
        out: list[tuple] = []
        if row.num_rows:
            batch = _Batch(row, told, sent.value, order - 1)
            g = _Grams(batch, order)
            bins = _bins(g.times[~g.asked[g.group]]).tolist()  # those that no bucket sees
            edges = runs(g.bucket) if len(g.sent) else np.zeros(1, np.int64)
            for i, j in zip(edges[:-1], edges[1:]):
                some = g.sent[i:j]
                starts = runs(g.group[some])
                lead = g.group[some[starts[:-1]]]
                parts = [p[lead].astype(np.uint32) for p in g.parts]
                out.append((int(g.bucket[i]), row["batch"][0].as_py(), pack(parts[0], True), pack(np.concatenate(parts[1:])) if order > 2 else None, pack(np.diff(starts).astype(np.uint32)), pack(g.last[some].astype(np.uint32)),
                            pack(g.times[some].astype(np.uint32)), pack(g.low[some]), None if order == 2 else pack(g.low_below[lead]), pack(g.wide[lead].astype(np.uint8)), bins))
                bins = None
            if bins is not None:  # nothing to ask for, or no bucket: the counts go alone
                out.append((0, row["batch"][0].as_py(), *[None] * 8, bins))
        columns = list(zip(*out)) or [()] * 11
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 8, pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _ASKS.split(", ")])

    return ask


_ANSWERS = "kind string, bucket int, batch long, a binary, b binary, c binary, d binary, bins array<long>"


def _count(sent, order: int):
    def count(asked: pa.Table) -> pa.Table:
        """A bucket's counts of counts and sums of wide histories (kind `table`), and for each batch: counts, doubled, plus 1 where other batches ask too; the counts held after each history; and sums of histories after which it lacks an n-gram."""
        model, bucket = sent.value, asked["bucket"][0].as_py()
        given = np.array([b for b in asked["bins"].to_pylist() if b is not None], np.int64).reshape(-1, DISCOUNTED + 1).sum(axis=0)
        asked = asked.filter(pc.is_valid(asked["h"]))
        get = lambda c, kind, up=False: [unpack(x, kind, up) for x in asked[c].to_pylist()]
        first, lengths, last, times, low, wide = get("h", np.uint32, True), [x.astype(np.int64) for x in get("l", np.uint32)], get("w", np.uint32), get("t", np.uint32), get("o", np.int64), get("x", np.uint8)
        rows = [("table", bucket, None, None, None, None, None, given.tolist())]
        if len(first):
            parts = [np.concatenate(first)]
            if order > 2:
                rest = [x.reshape(order - 2, -1) for x in get("p", np.uint32)]
                parts += [np.concatenate([x[k] for x in rest]) for k in range(order - 2)]
            history = _ids(parts)
            known, some, at = np.unique((np.repeat(history, np.concatenate(lengths)).astype(np.uint64) << np.uint64(32)) | np.concatenate(last).astype(np.uint64), return_index=True, return_inverse=True)
            total = np.zeros(len(known), np.int64)
            np.add.at(total, at, np.concatenate(times).astype(np.int64))
            group = (known >> np.uint64(32)).astype(np.int64)
            n = int(history.max()) + 1
            below = None
            if order > 2:
                below = np.ones(n, np.int64)
                below[history] = np.concatenate(get("d", np.int64))
                below = below[group]
            sums = Sums.of(group, n, total, _lower(model, order, np.concatenate(low)[some], below))
            answer, held = 2 * total + (np.bincount(at) > 1), sums.held
            lead = np.zeros(n, np.int64)
            lead[history] = np.arange(len(history))
            wide_ = np.concatenate(wide) > 0
            apart = np.flatnonzero(wide_[lead])
            rows[0] = ("table", bucket, None, pack(_key([p[lead[apart]] for p in parts])), pack(sums.times[apart].ravel()), pack(sums.lower[apart]), None, (given + _bins(total)).tolist())
            end = begin = 0
            for batch, own in zip(asked["batch"].to_pylist(), lengths):
                here = slice(begin, begin + len(own))
                begin += len(own)
                entries = at[end : end + int(own.sum())]
                end += len(entries)
                ids = history[here]
                zero = np.minimum.reduceat(total[entries], np.cumsum(own) - own) == 0
                lacking = sums.take(ids[zero & ~wide_[here]])
                rows.append(("told", bucket, batch, pack(answer[entries]), pack(held[ids]), pack(lacking.times.ravel()), pack(lacking.lower), None))
        kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in _ANSWERS.split(", ")])

    return count


def _wide_sums(table: DataFrame) -> tuple[np.ndarray, Sums]:
    """Sums of the wide histories over all buckets, 1 / WIDE_SHARE at most."""
    names = [f"n{r}" for r in _RATIO]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, b, c in zip(*(rows.column(x).to_pylist() for x in "abc")):
                if a is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(unpack(a, np.uint64).view(np.int64)), *(pa.array(x) for x in np.ascontiguousarray(unpack(b, np.int64).reshape(-1, DISCOUNTED).T)), pa.array(unpack(c, np.float64))], ["key", *names, "lower"])

    rows = table.select("a", "b", "c").mapInArrow(parts, "key long, " + ", ".join(f"{n} long" for n in names) + ", lower double")
    found = rows.groupBy("key").agg(*(F.sum(n).alias(n) for n in names), F.sum("lower").alias("lower")).toPandas()
    keys = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], Sums(found[names].to_numpy(np.int64)[order], found["lower"].to_numpy(float)[order])


def _scores(sent, order: int):
    names = ["n_tokens", "n_known", "base_score", "score"]

    def score(row: pa.Table, told: pa.Table) -> pa.Table:
        if not row.num_rows:
            values = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
            return pa.table([row["keys"].combine_chunks().values[:0], *(pa.array(v) for v in values)], ["key", *names])
        batch = _Batch(row, told, sent.value, order)
        known = batch.words[0][batch.token] > 0
        values = [batch.size, *(np.add.reduceat(v, batch.begin) for v in (known.astype(np.int64), np.log10(batch.base), np.log10(batch.chance)))]
        return pa.table([row["keys"].combine_chunks().flatten(), *(pa.array(v) for v in values)], ["key", *names])

    return score


def score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, wide_share: float = WIDE_SHARE) -> DataFrame:
    """For each row: key, n_tokens, n_known (tokens that training texts hold), train_tokens, base_score and score (sums of log10).

    An n-gram that training texts hold has its discounted count over its history's; another the history's backoff weight times its
    probability without the first word, and so on down to single words. Before a text stands its end, once: the first word's
    history is one word long, the second's two. All n-grams up to `order` count.

    training tells the rows that the model learns from; null counts as true. Null and empty texts are their end alone. Repeated
    rows stay, and learn as often as they stand there. Without training rows every word has the same probability, 1. Other
    columns go, whatever their names; an empty table gives no rows. A very long text is a batch of its own, and must fit in a task.
    """
    spark = docs.sparkSession
    buckets = bucket_count(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), training.alias("train"))
    path = new_path(spark, "katz-texts")
    texts = _read(rows, buckets, path)
    asked = texts.where("kind = 'ask'").select("bucket", "batch", "a", "b")
    unigrams = materialize(asked.groupBy("bucket").applyInArrow(_count_words(buckets), _WORDS), "katz-words", by="kind")
    removed(spark, f"{path}/kind=ask")  # answered, and not read again
    size = unigrams.where("kind = 'table'").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    tokens, types = int(size.n or 0), int(size.v or 0)
    model = Katz(tokens, types, buckets, max(1.0, wide_share * tokens))
    none = F.lit(None).cast("binary")
    told = unigrams.where("kind = 'told'").select("batch", "bucket", "a", "b", none.alias("c"), none.alias("d"), F.lit(1).alias("order"))
    batches = texts.where("kind = 'text'").select("batch", "keys", "a", "b", "c")
    for n in range(2, order + 1):
        sent = spark.sparkContext.broadcast(model)
        asked = batches.drop("keys").groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_asks(sent, n), _ASKS)
        answers = materialize(asked.groupBy("bucket").applyInArrow(_count(sent, n), _ANSWERS), f"katz-{n}", by="kind")
        table = answers.where("kind = 'table'")
        bins = table.agg(*(F.sum(F.col("bins")[r]).alias(f"n{r}") for r in range(DISCOUNTED + 1))).first()
        model = Katz(tokens, types, buckets, model.wide, {**model.discount, n: discounts(np.array([b or 0 for b in bins]))}, {**model.wide_sums, n: _wide_sums(table)})
        told = told.unionByName(answers.where("kind = 'told'").select("batch", "bucket", "a", "b", "c", "d", F.lit(n).alias("order")))
    sent = spark.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("key", rows.schema["key"].dataType), *T.StructType.fromDDL("n_tokens long, n_known long, base_score double, score double").fields])
    found = batches.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_scores(sent, order), out)
    return found.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
