"""The block index of BM25: what it skips, how it follows changes, and filters by facets, against scoring everything."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25
from tessera.plans import queries

FOLDER = "/root/testdata/sf0.01"


def best(rows, k):
    """The k best of scored rows by the rule of `ranked`."""
    out = {}
    for q, d, s in sorted(rows, key=lambda r: (r[0], -round(r[2], 9), r[1])):
        out.setdefault(q, []).append((d, round(s, 9)))
    return {q: v[:k] for q, v in out.items()}


def ranks(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 9)))
    return out


def texts(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('abcdefg')}{rng.choice('hijk')}{k}" for k in range(words)]
    return [" ".join(vocabulary[min(int(rng.expovariate(1 / (words / 6))), words - 1)] for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_few_pairs_are_scored_to_the_end(spark, tmp_path):
    """The whole benchmark against the whole documents: under a tenth of all pairs, and the same hits as from all scores."""
    docs, asked = queries.table(spark, FOLDER, "documents").select("doc_id", "text"), queries._asked(spark, FOLDER)
    index = bm25.build(docs, path=str(tmp_path / "index"))
    every = [(r.query_id, r.doc_id, r.score) for r in bm25.scores(asked, index).collect()]
    assert len(every) > 0.99 * docs.count() * asked.count()  # what scoring by shared terms costs
    assert {q: [d for d, _ in v] for q, v in ranks(bm25.top(asked, index, 5)).items()} == {q: [d for d, _ in v] for q, v in best(every, 5).items()}
    known = asked.select("query_id", F.explode(bm25.tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")).join(index.terms, "term")
    raw = bm25._raw_idf(index.documents)
    known = known.withColumn("w", F.col("times") * F.when(raw < 0, bm25.EPSILON * index.mean_idf).otherwise(raw)).groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights"))
    ids, what = bm25._asked(known, {})
    scored, held = 0, np.full((len(ids), 5), -np.inf)
    for batch in index.blocks.drop("segment").withColumn("ok", F.transform("keys", lambda x: F.lit(True))).toArrow().to_batches():
        for n in range(batch.num_rows):
            row = bm25._row(batch, n)
            row["ok"], row["order"] = np.asarray(row["ok"]), np.arange(len(row["dl"]))
            scored += bm25.best_of(row, what, 5, index.mean_length, held)[1]
    assert scored < 0.1 * len(every)


def test_nothing_as_large_as_all_pairs_is_written(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(texts(1, 3000, 50))), "doc_id long, text string").repartition(2)
    index = bm25.build(docs, path=str(tmp_path / "index"))
    found = bm25.top(spark.createDataFrame(list(enumerate(texts(2, 30, 50))), "query_id long, query string"), index, 3)
    assert found.count() == 90
    assert not any(x in found._jdf.queryExecution().executedPlan().toString() for x in ("SortMergeJoin", "BroadcastNestedLoop", "Cartesian"))


@pytest.mark.parametrize("k", [1, 7, 5000])
def test_blocks_give_what_all_scores_give(spark, tmp_path, k):
    """More documents than a block holds, k beyond them, terms of negative weight, unknown terms, null texts and queries."""
    rows = [(n, t if n % 50 else None, f"f{n % 3}", n) for n, t in enumerate(texts(3, 900, 12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f string, n int").repartition(3)
    asked = spark.createDataFrame([(n, q, None if n % 4 == 0 else f"f{n % 4}") for n, q in enumerate([*texts(4, 12, 20), None, "", "zz"])], "query_id int, query string, wanted string")
    index = bm25.build(docs, path=str(tmp_path / "index"), facets=["f", "n"])
    held = {(r.query_id, r.doc_id): r.score for r in bm25.scores(asked, index).collect()}
    wanted = {r.query_id: r.wanted for r in asked.collect()}
    every = [(q, d, held.get((q, d), 0.0)) for q in wanted for d, *_ in rows]
    assert ranks(bm25.top(asked, index, k)) == best(every, k)
    some = [(q, d, s) for q, d, s in every if wanted[q] in (None, f"f{d % 3}") and d > 20]
    assert ranks(bm25.top(asked, index, k, equal=("f", "wanted"), where=lambda f: f["n"] > 20)) == best(some, k)


def test_more_queries_than_a_pass_takes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 6)
    docs = spark.createDataFrame(list(enumerate(texts(5, 40, 12))), "doc_id long, text string")
    index = bm25.build(docs, path=str(tmp_path / "index"))
    asked = spark.createDataFrame(list(enumerate(texts(6, 25, 12))), "query_id long, query string")
    assert ranks(bm25.top(asked, index, 2)) == best([(r.query_id, r.doc_id, r.score) for r in bm25.scores(asked, index).collect()] + [(q, d, 0.0) for q in range(25) for d in range(40)], 2)


def stamps(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.glob("segments/*/*/*.parquet")}


def test_an_updated_index_is_a_new_one(spark, tmp_path):
    """Rounds of changed, added and removed documents: scores, statistics and terms equal a new index's; segments that didn't change stay."""
    rng, now = random.Random(7), dict(enumerate(texts(7, 400, 40)))
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(texts(8, 10, 40))), "query_id long, query string")
    index = bm25.build(frame(now), path=str(tmp_path / "index"))
    kept = False
    for turn in range(3):
        changed = {k: t for k, t in zip([*rng.sample(sorted(now), 9), 1000 + turn, 2000 + turn], texts(20 + turn, 11, 45))}
        gone = [k for k in rng.sample(sorted(now), 3 if turn < 2 else 150) if k not in changed]
        before = stamps(tmp_path / "index")
        index = bm25.update(index, frame(changed), spark.createDataFrame([(k,) for k in [*gone, 77_777]], "doc_id long"))
        now = {k: t for k, t in {**now, **changed}.items() if k not in gone}
        after = stamps(tmp_path / "index")
        assert all(after[f] == t for f, t in before.items())  # no file of an old segment is written again
        kept |= len(index.segments) > 1
        fresh = bm25.build(frame(now), path=str(tmp_path / f"fresh-{turn}"))
        assert (index.documents, index.mean_length) == (fresh.documents, fresh.mean_length) and abs(index.mean_idf - fresh.mean_idf) < 1e-9
        assert {r.term: r.df for r in index.terms.collect()} == {r.term: r.df for r in fresh.terms.collect()}
        assert ranks(bm25.top(asked, index, 6)) == ranks(bm25.top(asked, fresh, 6))
    assert kept and len(index.segments) <= 2  # over a quarter of the first one died: it was written anew
    assert {r.doc_id for r in bm25.load(spark, index.path).postings.collect()} == set(now)


def test_the_tokenizer_is_part_of_a_kept_index(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "aa")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    first = bm25.kept(docs, str(tmp_path / "kept"))
    assert bm25.kept(docs, str(tmp_path / "kept")).path == first.path
    monkeypatch.setattr(bm25, "TOKENIZER", "other")
    assert bm25.kept(docs, str(tmp_path / "kept")).path != first.path


def test_blocks_are_made_and_held_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """Many words of many shingles in one batch: what they come to is spelled out for one block at a time, and no file's row group holds more than a few blocks."""
    rng = np.random.default_rng(7)
    vocabulary = np.array([f"{chr(97 + n % 26)}{n:011d}" for n in range(3000)])
    own = pa.array([vocabulary[rng.integers(0, 3000, 300)] for _ in range(3000)], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([{"none": 0}] * 3000), own], ["key", "facets", "words"])
    with monkeypatch.context() as alone:
        alone.setattr(bm25, "_numbers", lambda: iter(range(1 << 30)).__next__)
        tracemalloc.start()
        blocks = sum(b.num_rows for b in bm25._words_to_blocks(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert blocks == -(-3000 // bm25.BLOCK) and most < 150 << 20
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text")).coalesce(1)
    monkeypatch.setattr(bm25, "busy", lambda rows: rows)
    index = bm25.build(docs, path=str(tmp_path / "index"))
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.blocks.inputFiles()]
    sizes = [m.row_group(n).num_rows for m in files for n in range(m.num_row_groups)]
    assert sum(sizes) >= 40 and max(sizes) <= bm25.HELD


def test_long_documents_of_one_block_are_spelled_out_apart(monkeypatch):
    """The longest documents of a group share a block: their shingles are made for some of them at a time, and what comes out doesn't depend on how many."""
    monkeypatch.setattr(bm25, "_numbers", lambda: iter(range(1 << 30)).__next__)
    rng = np.random.default_rng(11)
    vocabulary = np.array([f"{chr(97 + n % 26)}{n:011d}" for n in range(3000)])

    def batch(sizes):
        own = pa.array([vocabulary[rng.integers(0, 3000, n)] for n in sizes], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([{"none": 0}] * len(sizes)), own], ["key", "facets", "words"])

    long = batch([20] * 500 + [6000] * 128)
    tracemalloc.start()
    assert sum(b.num_rows for b in bm25._words_to_blocks(iter([long]))) == 5
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20
    mixed = batch([*rng.integers(0, 40, 300)])
    whole = [b.to_pylist() for b in bm25._words_to_blocks(iter([mixed]))]
    monkeypatch.setattr(bm25, "ENCODED", 7)
    monkeypatch.setattr(bm25, "SPELLED", 50)
    assert [b.to_pylist() for b in bm25._words_to_blocks(iter([mixed]))] == whole
    words = {k: w for k, w in zip(mixed["key"].to_pylist(), mixed["words"].to_pylist())}
    for row in (b[0] for b in whole):
        counted = [Counter() for _ in row["keys"]]
        begin = 0
        for term, n in zip(row["terms"], row["counts"]):
            for k in range(begin, begin + n):
                counted[row["at"][k]][term] += row["tf"][k]
            begin += n
        for key, found in zip(row["keys"], counted):
            assert found == (Counter([t for w in words[key] for t in [w, *(w[k : k + 2] for k in range(len(w) - 1))]]) or Counter(["_empty_"]))
