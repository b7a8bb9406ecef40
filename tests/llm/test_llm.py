"""The operators against brute force, on small tables that hold the awkward cases."""

import hashlib
import math
import random
import re
import threading
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from oracle import connection, rows_of, rows_of_sql
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import encoding, boosted_trees, components, count_tree, decontaminate, jaccard, katz, labelled, length_histogram, ordinal, packing, quality_classifier, quality_rules, queries, repeats, revisits, statistics, suffixes, toxicity
from tessera.llm.encoding import encoder

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else text or "")


def awkward():
    """Null and empty texts, ties, repeated rows, near and exact copies, characters of several bytes, one very long text."""
    rng = random.Random(5)
    vocabulary = ["ba", "Öl", "zé", "tion", "und", "the", "한국", "x1", "gra.", "né,"] + [f"w{k}" for k in range(60)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = prose(120), prose(70)
    near = base.split()
    near[60] = "changed"
    rows = [(1, base), (2, " ".join(near)), (3, base), (3, base), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "ONE Two"), (9, prose(90) + " " + passage + " " + prose(20)), (10, passage + "\n" + prose(60)), (11, prose(9000)), (12, "a b " * 400), (None, prose(55)), (13, "é" * 300), (14, "é" * 150)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", 1, "clash", "clash") for k, t in awkward()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, batch string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


# ---- 1


def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for a, (k, _) in enumerate(rows):
        least[find(a)].append(k)
    smallest = {r: min((k for k in v if k is not None), default=None) for r, v in least.items()}
    return sorted(((k, len(sets[a]), smallest[find(a)] if sets[a] else k) for a, (k, _) in enumerate(rows)), key=repr), len(least)


@pytest.mark.parametrize("size,percent,frequent,block", [(4, 85, 256, 1024), (4, 85, 1, 2), (2, 40, 2, 3)])
def test_jaccard_components(docs, size, percent, frequent, block):
    found = jaccard.join(docs, size=size, percent=percent, frequent=frequent, block=block)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=repr) == brute_components(awkward(), size, percent)[0]


def test_jaccard_on_driver_rows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = queries.op1_count_tree_join(spark, SF)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=repr) == brute_components(rows, 4, 85)[0]


def test_distinct_keeps_one_of_each_group(docs, none):
    kept = jaccard.distinct(docs)
    assert kept.columns == docs.columns and kept.count() == brute_components(awkward(), 5, 80)[1]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id in (1, 2, 3)) == [1]
    assert jaccard.distinct(none).count() == 0 and jaccard.join(none).count() == 0


@pytest.mark.parametrize("cells,percent", [(3, 85), (1, 85), (150, 60)])
def test_no_pair_is_lost_by_the_tree(cells, percent):
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (300, 16)).astype(np.uint16)
    counts[150:] = counts[:150]
    counts[150:, 0] += rng.integers(0, 2, 150).astype(np.uint16)
    sizes, cells = counts.sum(axis=1).astype(np.int64), np.tile(rng.integers(0, cells, 150), 2)
    order = np.argsort(cells, kind="stable")
    counts, sizes, cells = counts[order], sizes[order], cells[order]
    tree = count_tree.CountTree(counts, sizes, cells, percent)
    label = tree.connect()
    one, two = np.triu_indices(300, 1)
    close = (np.minimum(counts[one], counts[two]).sum(axis=1) >= count_tree.needed(sizes[one], sizes[two], percent)) & (cells[one] == cells[two])
    assert (label == count_tree.merged(300, one[close], two[close])).all() and close.sum() > 20
    only = tree.connect(lambda a, b: (a + b) % 2 == 0)
    some = close & ((one + two) % 2 == 0)
    assert (only == count_tree.merged(300, one[some], two[some])).all()


def test_boxes_of_the_tree_are_nested():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 50, (3000, 8)).astype(np.uint16)
    counts[:500] = 7  # no coordinate parts them
    tree = count_tree.CountTree(counts, counts.sum(axis=1), np.repeat([0, 1, 2], [500, 2490, 10]), 85)
    assert len(tree.children) >= 6 and (np.diff(tree.edges[-1]) <= count_tree.LEAF).all() and (np.sort(tree.order) == np.arange(3000)).all()
    for level, first in enumerate(tree.children):
        for node in range(len(first) - 1):
            below = slice(first[node], first[node + 1])
            assert (tree.top[level + 1][below].max(axis=0) == tree.top[level][node]).all() and tree.low[level + 1][below].min() == tree.low[level][node]
            assert tree.edges[level][node] == tree.edges[level + 1][first[node]] and tree.edges[level][node + 1] == tree.edges[level + 1][first[node + 1]]


def test_long_sets_are_verified_with_whole_counts():
    import pyarrow as pa
    from tessera.llm.blocks import pack

    one = np.arange(70_000, dtype=np.uint64)  # all in one group
    columns = [np.ones(2, np.uint64), np.array([5, 6], np.uint64), np.array([len(one)] * 2, np.uint32)]
    rows = pa.table({**{c: [pack(v)] for c, v in zip("abc", columns)}, "d": [pack(np.concatenate([one, one]), True)]})
    assert jaccard._verify(85)(rows).num_rows == 1


def test_components_of_paths_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (500, 500), (None, 3)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "one long, two long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 500: 500}


# ---- 2


def test_revisits_match_sql(spark):
    con = connection(SF)
    assert rows_of(queries.op2_not_modified(spark, SF)) == rows_of_sql(con, queries.ORACLE_SQL["op2_not_modified"])


def test_revisit_cases(spark):
    h = {"etag": "x", "server": "s", "date": "1"}
    rows = [
        (1, "http://A.org/p/", 10, True, "e1", "m1", h, "d1"), (2, "https://a.org:443/p#frag", 20, True, "e2", "m1", h, "d2"), (3, "a.org/p?utm_source=q", 15, False, 'W/e1', None, {"date": "2", "server": "t"}, None),
        (4, "http://a.org/p", 20, False, "e1", None, None, None), (5, "http://a.org/p", 30, False, "e1", "m1", {"expires": "9"}, None), (6, "http://a.org/p", 5, False, "e1", None, {}, None),
        (7, "http://b.org", 9, False, "e1", None, {}, None), (8, None, 9, False, "e1", None, {}, None), (9, "http://a.org/p", None, False, "e1", None, {}, None), (10, "http://a.org/p", 40, False, None, "m1", {}, None), (11, "http://a.org/p", 20, None, None, None, None, None),
    ]
    records = spark.createDataFrame([(*r, "extra") for r in rows], "record_id long, url string, ts long, full boolean, etag string, last_modified string, headers map<string,string>, digest string, part string").repartition(4)
    found = {r.record_id: r for r in revisits.resolve(records).collect()}
    told = {k: (r.response_id, r.outcome) for k, r in found.items()}
    assert told == {3: (1, "resolved"), 4: (1, "resolved"), 5: (2, "mismatch"), 6: (None, "missing"), 7: (None, "missing"), 8: (None, "missing"), 9: (None, "missing"), 10: (2, "resolved"), 11: (1, "mismatch")}
    assert found[3].headers == {"etag": "x", "server": "s", "date": "2"} and found[3].digest == "d1" and found[5].headers is None
    assert revisits.resolve(records.limit(0)).count() == 0


# ---- 3, 4


def ids_of(text, tokenizer=Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["Ab. cd, e.f", "it's. don't,", "…, ok.", "a,. b.,", "É. é,\x01 x.", "12. 1a, ..", ".", "İSTANBUL. DŽ,", "n°. ，", "a\x01b."])
def test_words_encode_as_the_whole_text(text):
    import pyarrow as pa

    starts, ids = encoder().encode(pa.array([text, "", text]))
    assert ids[starts[0] : starts[1]].tolist() == ids_of(text) == ids[starts[2] : starts[3]].tolist() and starts[1] == starts[2]


@pytest.mark.parametrize("text", ["x <|ENDOFTEXT|> y", "x <|EndOfText|>. Y", "a<|endoftext|>B. <|endoftext|>, C", "H\u0331 a", "xJ\u030c, W\u030a. T\u0308", "ÉA. The END, <| Of.", "<",
    "Né! né; ÀB:a ×. ÷, é×! ë-mail@Mail1.Com x's. it's'll a'S. b'.", "a## b!! $$$ c$$$ d&&&e (F) [g] h/i/J k=\u0338 L=\u0338 m>\u0338.", "a<|endoftext|>. É<|endoftext|>! x|> <|y", "µ. ªº! ĳ. İ! Ωσ. ΑΣ. aΣ. bΣ! 한글. 中文, e\u0301. e\u0301!", "a1.b2, 3.c 4!d É1. é.é"])
def test_capitals_encode_as_in_the_whole_text(text):
    import pyarrow as pa

    assert encoder().apart
    starts, ids = encoder().encode(pa.array([text, "|", text, "The. END,"]))
    assert [ids[i:j].tolist() for i, j in zip(starts[:-1], starts[1:])] == [ids_of(x) for x in (text, "|", text, "The. END,")]


def test_forgotten_words_encode_as_before():
    """A memory of few words, in two generations, gives the ids of a large one."""
    import pyarrow as pa

    small, texts = encoding.WordEncoder(remembered=3, words_per_call=2), ["Sun moon. STAR!", "moon tide", "star é1 sun, Tide", "sun moon star tide wave", "wave", ""]
    for _ in range(3):
        for group in (texts, texts[::-1], texts[2:4]):
            starts, ids = small.encode(pa.array(group))
            assert [ids[i:j].tolist() for i, j in zip(starts[:-1], starts[1:])] == [ids_of(x) for x in group]


def test_histogram_answers_for_every_limit(docs, none):
    lengths = [len(ids_of(t)) for _, t in awkward()]
    table = length_histogram.length_histogram(length_histogram.encoded_lengths(docs))
    for r in table.collect():
        n = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.docs_below, r.tokens_below, r.truncated_tokens) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), sum(x < n for x in lengths), sum(x for x in lengths if x < n), sum(min(x, n) for x in lengths))
    assert {r.n_tokens for r in table.collect()} == set(lengths)
    r = length_histogram.totals_at(table, [100]).collect()[0]
    assert (r.docs_over, r.truncated_tokens) == (sum(x > 100 for x in lengths), sum(min(x, 100) for x in lengths))
    assert length_histogram.quantile_lengths(table, [0.5]).collect()[0].n_tokens == sorted(lengths)[math.ceil(len(lengths) / 2) - 1]
    assert length_histogram.length_histogram(length_histogram.encoded_lengths(none)).count() == 0


def test_packing_is_a_round_trip(docs, none):
    pieces = packing.pack(docs, sequence=128).collect()
    want = Counter((k, tuple(ids_of(t) + [1])) for k, t in awkward())
    whole = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    place, texts, current = 0, Counter(), []
    for p in whole:
        assert p.sequence_id * 128 + p.offset == place and p.length <= 128 and len(p.ids) == p.length and p.offset + p.length <= 128
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        place += p.length
        current += p.ids
        if p.start + p.length == p.doc_tokens:
            texts[(p.doc_id, tuple(current))] += 1
            current = []
    assert texts == want and place == sum(len(i) * n for (_, i), n in want.items())
    assert {len(r.ids) for r in packing.sequences(packing.pack(docs, sequence=128), 128).collect()} == {128}
    assert packing.pack(none).count() == 0


def test_packing_query_on_driver_rows(spark):
    texts = {r.doc_id: ids_of(r.text) + [1] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    place = 0
    for p in sorted(queries.op4_concat_and_cut(spark, SF).collect(), key=lambda p: (p.sequence_id, p.offset)):
        assert p.sequence_id * 2048 + p.offset == place and p.offset + p.length <= 2048 and p.doc_tokens == len(texts[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(texts[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        place += p.length
    assert place == sum(map(len, texts.values()))


# ---- 5


class BruteKatz:
    """The model by its definition, over lists of tokens."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = {n: Counter() for n in range(1, order + 1)}
        for t in texts:
            padded = [None, *t]
            for i in range(len(t)):
                for n in range(1, order + 1):
                    if i + 2 >= n:
                        self.counts[n][tuple(padded[i + 2 - n : i + 2])] += 1
        self.total, self.types = sum(self.counts[1].values()), len(self.counts[1])
        self.discount, self.after = {}, {}
        for n in range(2, order + 1):
            self.discount[n] = katz.discounts(np.array([sum(c == r for c in self.counts[n].values()) for r in range(1, katz.DISCOUNTED + 2)]))
            self.after[n] = defaultdict(dict)
            for g, c in self.counts[n].items():
                self.after[n][g[:-1]][g[-1]] = c
        self.weights = {}

    def taken(self, n, c):
        return c * (self.discount[n][c] if c <= katz.DISCOUNTED else 1)

    def weight(self, h):
        if h not in self.weights:
            n, after = len(h) + 1, self.after[len(h) + 1][h]
            count, mass = sum(after.values()), sum(self.taken(n, c) for c in after.values())
            below = count if mass < count - 1e-9 else count + 1
            self.weights[h] = below, (1 - mass / below) / (1 - sum(self.p(h[1:], w) for w in after))
        return self.weights[h]

    def p(self, h, w):
        if not h:
            return (self.counts[1][(w,)] + 1) / (self.total + self.types + 1)
        after = self.after[len(h) + 1].get(h)
        if not after:
            return self.p(h[1:], w)
        below, backoff = self.weight(h)
        return self.taken(len(h) + 1, after[w]) / below if w in after else backoff * self.p(h[1:], w)

    def score(self, t):
        padded = [None, *t]
        return sum(math.log10(self.p(tuple(padded[max(0, i + 2 - self.order) : i + 1]), w)) for i, w in enumerate(t))


@pytest.mark.parametrize("order,wide_share", [(2, 1.0), (3, katz.WIDE_SHARE), (3, 1 / 100), (3, 2.0), (4, 1 / 300)])
def test_katz_is_exact_and_normalised(spark, docs, none, order, wide_share):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = awkward()
    out = [zlib.crc32(str(k).encode()) % 7 == 2 if k is not None else False for k, _ in rows]
    tokens = [[*words(t), None] for _, t in rows]
    model = BruteKatz([t for t, o in zip(tokens, out) if not o], order)
    for h in [(), *list(model.after[2])[:40], *list(model.after[order])[:40]]:
        assert abs(sum(model.p(h, w) for (w,) in model.counts[1]) + model.p(h, "never seen") - 1) < 1e-9
    one = model.counts[1]
    want = sorted((repr(k), len(t), sum(one[(w,)] > 0 for w in t), model.total, round(sum(math.log10(model.p((), w)) for w in t), 6), round(model.score(t), 6)) for (k, _), t in zip(rows, tokens))
    found = katz.score(docs, ~held, order=order, wide_share=wide_share)
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found.collect()) == want
    assert katz.score(none, ~held).count() == 0
    untrained = katz.score(docs, F.lit(False)).collect()
    assert all(r.score == r.base_score == 0.0 and r.n_known == 0 for r in untrained)


def test_katz_query_on_driver_rows(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens = {k: [*words(t), None] for k, t in rows.items()}
    model = BruteKatz([t for k, t in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2], katz.ORDER)
    for r in queries.op5_katz_backoff(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score == pytest.approx(model.score(tokens[r.doc_id]), abs=1e-6) and r.n_tokens == len(tokens[r.doc_id])


def test_katz_counts_pairs_of_words_of_any_share(spark):
    many = [(k, " ".join(f"v{k}x{j}" for j in range(60_000))) for k in range(20)]
    rows = [*many, (100, "rare once"), (101, "rare once"), (102, "new words")]
    found = {r.doc_id: r for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") != 101).where("doc_id > 99").collect()}
    assert found[100].train_tokens * 2.0**-20 > 1 and found[101].n_known == 3
    model = BruteKatz([[*t.split(), None] for k, t in rows if k != 101], katz.ORDER)
    for k, text in rows[-3:]:
        assert found[k].score == pytest.approx(model.score([*text.split(), None]), abs=1e-9)


def test_pairs_beat_words_on_held_out_text(spark):
    rows = queries.op5_katz_backoff(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).collect()[0]
    assert rows.s > rows.b


# ---- 6


def brute_cut(texts, length, first):
    data = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out, seen = [], set()
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if (s in seen) if first else times[s] > 1:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        out.append(bytes(gone))
    return data, out


def whole_characters(data, gone):
    """The text without the characters that lose a byte."""
    out, place = [], 0
    for c in data.decode():
        size = len(c.encode())
        if not any(gone[place : place + size]):
            out.append(c)
        place += size
    return "".join(out)


def spans_of(gone):
    return [(m.start(), m.end()) for m in re.finditer(b"\1+", gone)]


@pytest.mark.parametrize("group,batch_bytes", [(256, 4 << 20), (1, 3000), (2, 1)])
def test_repeats(docs, group, batch_bytes):
    data, gone = brute_cut([t for _, t in awkward()], 200, False)
    want = sorted(((k, len(b), spans_of(g), bytes(x for x, y in zip(b, g) if not y)) for (k, _), b, g in zip(awkward(), data, gone)), key=repr)
    found = repeats.repeated_spans(docs.select("doc_id", "text"), suffix_group=group, batch_bytes=batch_bytes)
    assert sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in found.collect()), key=repr) == want


@pytest.mark.parametrize("group", [256, 1])
def test_the_first_occurrence_stays(spark, group):
    rows = awkward()
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    data, gone = brute_cut([t for _, t in rows], 200, True)
    found = repeats.repeated_spans(table, keep_first=True, suffix_group=group, batch_bytes=5000).collect()
    want = sorted((repr(k), bytes(x for x, y in zip(b, g) if not y)) for (k, _), b, g in zip(rows, data, gone))
    assert sorted((repr(r.doc_id), bytes(r.kept)) for r in found) == want


@pytest.mark.parametrize("keep_first,suffix_bytes", [(False, repeats.SUFFIX_BYTES), (True, repeats.SUFFIX_BYTES), (False, 30_000), (True, 5_000)])
def test_more_stretches_round_one_gram_than_go_whole(spark, keep_first, suffix_bytes):
    rng = random.Random(4)

    def some(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    commons, left, right = [some(140) for _ in range(2)], [some(60) for _ in range(40)], [some(60) for _ in range(30)]
    texts = [some(150) + rng.choice(left) + commons[k % 2] + rng.choice(right) + some(150) for k in range(900)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    hashes = repeats.gram_hashes(data)
    anchor, first, count = repeats.stretches(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), hashes, 200)
    kinds = defaultdict(set)
    for a, b, n in zip(hashes[anchor].tolist(), first.tolist(), count.tolist()):
        kinds[a].add(data[b : b + n + 199].tobytes())
    assert max(map(len, kinds.values())) > repeats.SUFFIX_GROUP
    whole, gone = brute_cut(texts, 200, keep_first)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: [tuple(x) for x in r.spans] for r in repeats.repeated_spans(table, keep_first=keep_first, batch_bytes=100_000, suffix_bytes=suffix_bytes).collect()}
    assert found == {k: spans_of(g) for k, g in enumerate(gone)} and sum(map(bool, found.values())) > 100


def test_repeats_query_and_whole_characters(spark, docs, none):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    data, gone = brute_cut([t for _, t in rows], 200, False)
    want = {k: (len(b), sum(g), len(spans_of(g)), hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()) for (k, _), b, g in zip(rows, data, gone)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op6_previous_factors(spark, SF).collect()} == want
    cut = repeats.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count() and all("�" not in r.text for r in cut.collect())
    assert repeats.without_repeats(none).count() == 0
    with pytest.raises(ValueError):
        repeats.repeated_spans(docs.withColumn("kept", F.lit(1)))


@pytest.mark.parametrize("seed", range(5))
def test_longest_previous_factors(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 99 if seed % 2 else 101, 400).astype(np.uint8)
    data[250:350] = data[20:120]
    starts = np.arange(len(data)) if seed < 3 else np.sort(rng.choice(400, 150, replace=False))
    length, source = suffixes.longest_previous_factor(data, starts, 40)
    raw = data.tobytes()
    for k, s in enumerate(starts):
        shared = [next((n for n in range(40) if max(s, e) + n >= 400 or raw[s + n] != raw[e + n]), 40) for e in starts[:k]]
        assert length[k] == max(shared, default=0)
        assert length[k] == 0 or shared[list(starts[:k]).index(source[k])] == length[k]


# ---- 7, 8, 9


def test_quality_counts_and_limits(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (12, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    found = {repr(r.doc_id) + r.base_failed.__repr__(): r for r in quality_rules.judge(docs, labels).collect()}
    for k, t in awkward():
        w = words(t, lower=False)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        r = found[repr(k) + repr(failed)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))
        assert not (failed and r.kept)
    empty = labels.limit(0)
    assert quality_rules.judge(docs, empty).where("kept").count() == quality_rules.judge(docs, empty).where("not base_failed").count()
    assert quality_rules.keep(docs.limit(0), labels).count() == 0 and quality_rules.keep(docs, labels).columns == docs.columns


def test_verdicts_follow_from_counts_and_trees(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    forest, rows = quality_rules.train(docs, labels), queries.op7_boosted_quality(spark, SF).collect()
    counted = {r.doc_id: r for r in statistics.document_counts(docs).collect()}
    x, _ = statistics.features({c: np.array([counted[r.doc_id][c] for r in rows]) for c in statistics.COUNTS})

    def walk(row):
        odds = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (row[feature[node]] > threshold[node])
            odds += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-odds))

    for r, own in zip(rows, x):
        assert r.p_good == pytest.approx(walk(own), abs=1e-9) and r.kept == (not r.base_failed and r.p_good >= 0.5)
    good = {r.doc_id: r.quality for r in labels.collect()}
    known = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(r.kept == (good[r.doc_id] > 0) for r in known) / len(known) > 0.9


def test_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] + 0.3 * rng.random(2000) > 0.6) ^ (x[:, 1] > 0.9)).astype(float)
    forest = boosted_trees.fit(x, y, np.array([1, 0, -1]))
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.85
    line = np.repeat(x[:50], 21, axis=0)
    for feature, sign in ((0, 1), (2, -1)):
        moved = line.copy()
        moved[:, feature] = np.tile(np.linspace(0, 1, 21), 50)
        assert (sign * np.diff(forest.log_odds(moved).reshape(50, 21), axis=1) >= -1e-12).all()
    assert np.allclose(boosted_trees.fit(x, np.ones(2000), np.zeros(3)).probability(x[:2]), 0.999)


@pytest.mark.parametrize("presence", [False, True])
def test_ordinal_grades(presence):
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 900)
    column = np.stack([grades * 10 + rng.integers(0, 10, 900), 30 + rng.integers(0, 30, 900)], axis=1).ravel()
    value = None if presence else np.ones(1800, np.float32)
    model = ordinal.fit(np.arange(901) * 2, column, value, grades, 64)
    tails = model.tails(model.scores(np.repeat(np.arange(900), 2), column, value, 900))
    assert (np.diff(model.thresholds) >= 0).all() and (tails[:, 0] >= tails[:, 1] - 1e-12).all()
    assert (np.round(tails.sum(axis=1)) == grades).mean() > 0.9


def test_sums_over_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    starts = np.concatenate([[0], np.cumsum(rng.integers(0, 9, 50))])
    column, value = rng.integers(0, 12, starts[-1]).astype(np.int32), rng.random(starts[-1])
    dense = np.zeros((50, 12))
    np.add.at(dense, (np.repeat(np.arange(50), np.diff(starts)), column), value)
    for piece in (1, 7, 1 << 20):
        monkeypatch.setattr(ordinal._Entries, "PIECE", piece)
        held = ordinal._Entries(starts, column, value, 12)
        assert np.allclose(held.by_row(np.arange(12.0)), dense @ np.arange(12.0)) and np.allclose(held.by_column(np.arange(50.0)), np.arange(50.0) @ dense)


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifiers_on_held_out_labels(spark, which):
    """Each class by itself: a constant answer is right for all of one and none of the other."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    odd = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    module, column, chance = (quality_classifier, "selected", "p_good") if which == "quality" else (toxicity, "toxic", "p_toxic")
    found = module.classify(docs, labels.where(~odd)).select("doc_id", F.col(column).alias("f"), F.col(chance).alias("p"))
    rows = found.join(labels.where(odd), "doc_id").select("f", "p", (F.col(which) > 0).alias("y")).collect()
    ours, theirs = [r for r in rows if r.y], [r for r in rows if not r.y]
    right, left = sum(r.f for r in ours) / len(ours), sum(not r.f for r in theirs) / len(theirs)
    above = sum((a.p > b.p) + (a.p == b.p) / 2 for a in ours for b in theirs) / len(ours) / len(theirs)
    assert right > 0.7 and left > 0.8 and above > 0.9, (right, left, above)


def test_a_sample_is_bounded_by_keys_and_bytes(spark):
    docs = spark.createDataFrame([(k, "x" * 100, "clash") for k in range(40)] + [(7, "y" * 500, "clash")] * 300 + [(None, "n", "clash")], "doc_id long, text string, grade string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)] + [(7, 0, 0)] * 9 + [(None, 1, 0), (3, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    whole = labelled.labelled_texts(docs, labels, F.col("quality")).select("place.key", "grade", F.length("text").alias("n")).collect()
    assert sorted((int(r.key), r.grade, r.n) for r in whole) == [(k, 0 if k == 7 else k % 2, 100) for k in range(20)]
    assert labelled.labelled_texts(docs, labels, F.col("quality"), most=5).count() <= 5
    some = {r.key for r in labelled.labelled_texts(docs, labels, F.col("quality"), most_bytes=650).select("place.key").collect()}
    assert some == {r.key for r in sorted(labelled.labelled_texts(docs, labels, F.col("quality")).select("place.*").collect())[:6]}
    assert labelled.labelled_texts(docs.limit(0), labels, F.col("quality")).count() == 0
    repeated = quality_classifier.classify(docs, labels).collect()
    assert len(repeated) == 341 and len({r.p_good for r in repeated if r.doc_id != 7}) <= 2


def test_classifiers_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(docs, labels).count() == len(awkward()) == toxicity.classify(docs, labels).count()
    assert toxicity.classify(docs.limit(0), labels).count() == 0


# ---- 10


ITEM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_hits(rows, items):
    split = lambda t: re.findall(ITEM, (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for d, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= {str(i) for i in own if i is not None}
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_windows", [200_000, 3])
def test_benchmark_windows(spark, docs, block_windows):
    texts = dict(awkward()[::-1])
    items = [(1, " ".join(words(texts[9])[20:45])), (2, "One, two!"), (3, None), (4, ""), (5, "not there at all in any of these texts here"), (5, " ".join(words(texts[11])[4000:4012])), (None, " ".join(words(texts[10])[:11])), (2, "One, two!")]
    benchmark = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, window string")
    found = decontaminate.contamination(docs, benchmark, block_windows=block_windows).collect()
    assert sorted(((r.doc_id, r.n_words, sum(s.end - s.begin for s in r.spans), list(r["items"])) for r in found), key=repr) == brute_hits(awkward(), items)
    bad = Counter(repr(d) for d, _, h, _ in brute_hits(awkward(), items) if h)
    clean = decontaminate.clean(docs, benchmark, block_windows=block_windows)
    assert Counter(repr(k) for k, _ in awkward()) - Counter(repr(r.doc_id) for r in clean.collect()) == bad and clean.columns == docs.columns
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == len(awkward()) and decontaminate.contamination(docs.limit(0), benchmark).count() == 0


def test_blocks_of_a_benchmark_are_bounded(docs, spark):
    """Neither a long item nor one id with most rows makes a block larger."""
    rng = random.Random(3)
    items = [(1, " ".join(f"u{rng.randrange(10**6)}" for _ in range(3000)))] + [(2, " ".join(f"v{k}x{j}" for j in range(12))) for k in range(900)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    sizes = [len(b.keys) for b in decontaminate.blocks(docs, benchmark, block_windows=500)]
    assert sum(sizes) == 2991 + 2700 and len(sizes) == 12 and max(sizes) < 700


def test_benchmark_query_matches_sql(spark):
    assert rows_of(queries.op10_prefix_containment(spark, SF)) == rows_of_sql(connection(SF), queries.ORACLE_SQL["op10_prefix_containment"])


# ---- the pipeline


def test_every_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = quality_rules.judge(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in judged.where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs.coalesce(1), SF)
        if number < 4:
            from tessera.llm.scratch import materialize

            docs = materialize(docs, "test")
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            rows = docs.coalesce(1).collect()
        if number == 0:
            assert {r.doc_id for r in rows} == want and len(rows) == len(want)
        elif number == 1:
            parted = brute_components([(k, texts[k]) for k in sorted(want)], 5, 80)[0]
            want = {c for _, _, c in parted}
            assert {r.doc_id for r in rows} == want
        elif number == 2:
            assert {r.doc_id for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
            data, gone = brute_cut([r.text for r in before_rows], 200, True)  # rows in the order in which they were read
            assert {r.doc_id: r.text for r in rows} == {r.doc_id: whole_characters(b, g) for r, b, g in zip(before_rows, data, gone)}
        elif number == 3:
            before = {d: h for d, _, h, _ in brute_hits([(k, t) for k, t in zip([x.doc_id for x in before_rows], [x.text for x in before_rows])], benchmark)}
            assert {r.doc_id for r in rows} == {d for d, h in before.items() if not h}
        before_rows = rows if number < 4 else before_rows
    want = Counter((r.doc_id, len(ids_of(r.text)) + 1) for r in before_rows)
    assert Counter((r.doc_id, r.doc_tokens) for r in docs.where("start = 0").collect()) == want
    run = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in run if r.start == 0) == want and sum(r.length for r in run) == sum(n * k for (_, n), k in want.items())


# ---- one text that is longer than a slice


def _largest_worker(stop, out):
    """The most memory that one Python worker has taken, in MB, looked at until stop is set."""
    while not stop.wait(0.05):
        for status in Path("/proc").glob("[0-9]*/status"):
            try:
                if b"pyspark" in (status.parent / "cmdline").read_bytes() and b"java" not in (status.parent / "cmdline").read_bytes():
                    peak = next(x for x in status.read_text().splitlines() if x.startswith("VmRSS"))
                    out[0] = max(out[0], int(peak.split()[1]) / 1024)
            except (OSError, StopIteration):
                continue


def test_long_near_copies_take_little_memory(spark):
    rng = random.Random(3)
    one = [f"w{rng.randrange(50_000)}" for _ in range(600_000)]
    two = [*one[:300_000], "another", *one[300_001:]]
    docs = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(one[::-1]))], "doc_id long, text string")
    stop, peak = threading.Event(), [0.0]
    watch = threading.Thread(target=_largest_worker, args=(stop, peak))
    watch.start()
    found = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    stop.set()
    watch.join()
    print("MB", peak[0])
    assert found == {1: 1, 2: 1, 3: 3} and 0 < peak[0] < 1000


def test_cells_of_the_same_members_are_searched_once():
    members = np.array([1, 2, 3, 1, 2, 2, 3, 1, 2, 1, 2, 3])
    edges = np.array([0, 3, 5, 7, 9, 12])  # 123, 12, 23, 12, 123
    kept = jaccard._different(edges, members)
    assert sorted(tuple(members[edges[k] : edges[k + 1]].tolist()) for k in kept) == [(1, 2), (1, 2, 3), (2, 3)]
    assert len(jaccard._different(np.zeros(1, np.int64), members[:0])) == 0


def test_a_text_longer_than_a_slice(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(900_000))
    short = " ".join(long.split()[500_000:500_200])
    assert len(long) > 4 << 20
    docs = spark.createDataFrame([(1, long, "clash"), (2, short, "clash"), (3, long, "clash"), (4, None, "clash")], "doc_id long, text string, key string").repartition(2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()} == {1: (899_997, 1), 2: (197, 2), 3: (899_997, 1), 4: (0, 4)}
    pieces = packing.pack(docs).where("doc_id = 1").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()[0]
    assert pieces.n == pieces.m == len(ids_of(long)) + 1
    cut = {r.doc_id: r for r in repeats.repeated_spans(docs.select("doc_id", "text")).collect()}
    assert [len(cut[k].kept) for k in (1, 2, 3, 4)] == [0, 0, 0, 0] and cut[1].n_bytes == len(long)
    found = {r.doc_id: r for r in katz.score(docs, F.col("doc_id") != 2).collect()}
    assert found[1].n_tokens == 900_001 == found[1].n_known and found[1].score == pytest.approx(found[3].score) and found[2].n_known == 201
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.n_words for r in quality_rules.judge(docs, labels).collect()} == {1: 900_000, 2: 200, 3: 900_000, 4: 0}
    assert quality_classifier.classify(docs, labels).count() == toxicity.classify(docs, labels).count() == 4
    benchmark = spark.createDataFrame([(1, short), (2, " ".join(long.split()[:2000]))], "item_id long, text string")
    hit = {r.doc_id: r for r in decontaminate.contamination(docs, benchmark).collect()}
    assert [sum(x.end - x.begin for x in hit[k].spans) for k in (1, 2)] == [2200, 200] and list(hit[1]["items"]) == ["1", "2"]
