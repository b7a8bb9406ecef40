"""Recompression, filter orders and delta Lloyd against brute force, on small tables with the awkward cases."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import connection, rows_of, rows_of_sql
from pyspark.sql import functions as F

from tessera.llm import delta_lloyd, filter_audit, queries, recompression

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", ["op11_recompression", "op12_filter_orders", "op13_delta_lloyd"])
def test_queries_against_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == rows_of_sql(connection(SF), queries.ORACLE_SQL[name])


# ---- 11


def brute_earlier(rows, window):
    first = {}
    for k, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1) if k is not None else ():
            first[tuple(w[p : p + window])] = min(first.get(tuple(w[p : p + window]), k), k)
    out = []
    for k, t in rows:
        w, gone = words(t), set()
        for p in range(len(w) - window + 1) if k is not None else ():
            if first[tuple(w[p : p + window])] < k:
                gone |= set(range(p, p + window))
        out.append((k, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    return sorted(out, key=repr)


def copied(seed):
    """Texts of few words with copies, edits, shifts, joints and runs; null and repeated keys, null and empty texts, blanks of every kind."""
    rng = random.Random(seed)
    vocabulary = ["a", "b", "A", "Öl", "né,"][: 2 + seed % 4] + [f"w{k}" for k in range([0, 3, 30][seed % 3])]
    base, rows = [[rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))] for _ in range(6)], []
    for k in range(30):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(3) if t else 0):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            t = t[rng.randrange(0, 60) :] + rng.choice(base)[:40]
        if rng.random() < 0.2:
            t = ["a"] * rng.randrange(0, 90) + t
        rows.append((None if k == 7 else k // 2 if k < 8 else 100 - k, rng.choice([" ", "\n", "\t \r", " \x0b\x0c"]).join(t)))
    long = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(20_000)]
    return [*rows, (50, None), (51, ""), (52, " \n "), (60, " ".join(long)), (61, " ".join(long[:9000] + ["x"] + long[9000:])), (61, "u+3000　is no blank")]


@pytest.mark.parametrize("seed,window,rounds,steps", [(0, 13, 4, 3), (1, 5, 2, 2), (2, 3, 3, 1), (3, 13, 1, 4), (4, 13, 5, 3), (5, 2, 2, 3)])
def test_words_of_earlier_texts_go(spark, seed, window, rounds, steps):
    rows = copied(seed)
    found = recompression.without_earlier(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=window, rounds=rounds, steps=steps)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_earlier(rows, window)


def test_columns_of_recompression(spark):
    docs = spark.createDataFrame([(2, "a b c d", "x", 7), (1, "b c d", "y", 8)], "n_words int, text string, kept string, bucket int")
    found = recompression.without_earlier(docs, key="n_words", window=2)  # the key stays, other names of the result give way
    assert found.columns == ["n_words", "bucket", "n_words", "n_removed", "kept"]
    assert sorted(map(tuple, found.collect())) == [(1, 8, 3, 0, "b c d"), (2, 7, 4, 3, "a")]
    assert recompression.without_earlier(docs.limit(0), key="n_words").count() == 0
    with pytest.raises(ValueError):
        recompression.without_earlier(docs, key="n_words", window=1)


def test_equal_windows_have_equal_inner_symbols():
    """What a window is judged by must not depend on its neighbours: the same passage in two texts, names by content."""
    rng = random.Random(9)
    passage = [rng.choice("abc") for _ in range(40)]
    texts = [[rng.choice("abc") for _ in range(25)] + passage + [rng.choice("abc") for _ in range(25)] for _ in range(2)]
    seen = []
    for t in texts:
        x = recompression.State(doc_at=np.zeros(1, np.int64), doc_id=np.ones(1, np.int64))
        x.word_at = x.start = np.arange(len(t))
        x.size, x.name, x.ref, x.win = np.ones(len(t), np.int64), np.array([ord(c) for c in t], np.uint64), np.full(len(t), -1), np.arange(len(t) - 12)
        x.low, x.high = np.zeros(len(x.win), np.uint16), np.full(len(x.win), 13, np.uint16)
        inner = []
        for turn in range(2):
            x, (content, *_) = recompression.compressed(x, turn, 2)
            x.name = np.where(x.ref >= 0, content[x.ref], x.name) if len(content) else x.name
            first, last = np.searchsorted(x.start, x.win + x.low), np.searchsorted(x.start, x.win + x.high)
            inner.append([(x.low[p], x.high[p], x.name[first[p] : last[p]].tolist()) for p in range(25, 25 + 28)])
        seen.append(inner)
    assert seen[0] == seen[1] and any(high > low for low, high, _ in seen[0][0])


# ---- 12


def brute_orders(rows, labels):
    good, toxic = ({k for k, q, t in labels if v(q, t) == 1 and k is not None} for v in (lambda q, t: q, lambda q, t: t))
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(least.get(t or "", k), k)
    docs = []
    for k, t, part in rows:
        t = t or ""
        w = words(t)
        fails = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (k is not None and least[t] < k)
        docs.append((part or "", fails, k in good, k in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone, stay = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                over = sum(d[0] == part and f in d[1] for d in docs) - len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), over, sum(d[0] == part and d[1] == f for d in docs), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, f] += len(gone)
                left = stay
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_orders_of_filters(spark):
    rng = random.Random(3)
    texts = [None, "", "a b", "AB" * 40, "one two " * 40, " ".join(f"w{k}" for k in range(60)), " ".join(f"W{k}" for k in range(60)) + " #", "é" * 300, "x\t\n " * 50 + "%"]
    rows = [(rng.choice([None, *range(12)]), rng.choice(texts), rng.choice(["s", "t", None, ""])) for _ in range(80)]
    rows += [(3, texts[5], "s")] * 5 + [(40, " ".join(f"v{k}" for k in range(30_000)), "long")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in [None, 0, 1, 2, 2, 3, 3, 5, 40, 99] * 2]
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, source string, good int, mask string").repartition(3)
    found = filter_audit.interactions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in found.collect()) == brute_orders(rows, labels)
    assert filter_audit.interactions(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("count", [1, 2, 3, 5])
def test_plain_changes_visit_every_order_once(count):
    order, seen = list(range(count)), {tuple(range(count))}
    for at in filter_audit.plain_changes(count):
        order[at], order[at + 1] = order[at + 1], order[at]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(count)))


# ---- 13


def brute_lloyd(rows, k, rounds, size):
    kept = [(n, [int(np.floor(64 * float(x))) for x in v]) for n, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{n}".encode()).hexdigest(), v) for n, v in kept if n is not None)[:k]
    at = [v for _, v in first]
    for turn in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at)) for _, v in kept]
        if turn < rounds:
            own = defaultdict(list)
            for (_, v), (_, j) in zip(kept, best):
                own[j].append(v)
            at = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(at)]
    sums = Counter()
    for d, j in best:
        sums[j] += d
    return sorted(((n, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for (n, _), (d, j) in zip(kept, best)), key=repr)


@pytest.mark.parametrize("k,rounds", [(4, 3), (40, 6), (1, 0)])
def test_delta_lloyd(spark, k, rounds):
    rng = random.Random(k)
    rows = [(n // 2 if n % 9 == 0 else n, [float(rng.randrange(-3, 4)) + (rng.random() if n % 2 else 0) for _ in range(5)]) for n in range(200)]
    rows += [(None, [0.5] * 5), (7, None), (8, [1.0] * 4), (9, [1.0, None, 0.0, 0.0, 0.0]), (10, [float("nan")] * 5), (11, [float("inf")] + [0.0] * 4), *[(500 + n, [2.0] * 5) for n in range(40)]]
    table = spark.createDataFrame([(*r, 5, "clash") for r in rows], "vec_id long, embedding array<float>, cluster int, v string").repartition(3)
    rows = [(n, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for n, v in rows]
    found = delta_lloyd.cluster(table, size=5, k=k, rounds=rounds)
    assert found.columns == ["vec_id", "v", *delta_lloyd.RESULT]
    assert sorted((tuple(r) for r in found.drop("v").collect()), key=repr) == brute_lloyd(rows, k, rounds, 5)


def test_rounds_compare_only_what_moved():
    rng = np.random.default_rng(1)
    vectors, at = rng.integers(-9, 9, (300, 4)), rng.integers(-9, 9, (6, 4))
    whole = delta_lloyd.nearest(vectors, np.full(300, -1), np.zeros(300, np.int64), delta_lloyd.Centroids(at, np.ones(6, bool)))
    after = at.copy()
    after[[1, 4]] += 2
    delta = delta_lloyd.nearest(vectors, *whole, delta_lloyd.Centroids(after, (after != at).any(axis=1)))
    again = delta_lloyd.nearest(vectors, np.full(300, -1), np.zeros(300, np.int64), delta_lloyd.Centroids(after, np.ones(6, bool)))
    assert all((a == b).all() for a, b in zip(delta, again))


def test_lloyd_without_rows_and_out_of_range(spark):
    none = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert delta_lloyd.cluster(none).count() == 0 and delta_lloyd.cluster(none.limit(0)).count() == 0
    assert delta_lloyd.cluster(none.withColumn("vec_id", F.lit(None).cast("long")), size=1).count() == 0
    with pytest.raises(Exception, match="is over"):
        delta_lloyd.cluster(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>"), size=1).collect()
