"""Grams and cells against searches that read everything; functions by name; counts of an insert; wide blanks."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import blanks, documents, named
from tessera.operators import cells, grams, grep, ingest, trees, vectors
from tessera.plans.registry import table
from tessera.sources import envelopes

FOLDER = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    words = ["법률", "a", "AbC", "İx", "the", "tion", "헌법재판소", "x y", "Straße", "ΣΑΣ", "𝒳yz", "longer word"]
    held = [(k, None if k == 5 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))), rng.choice(["f1", "f2", None])) for k in range(300)]
    held += [(None, "the tion", "f1"), (400, "헌법재판소" * 3, "f2")]
    return spark.createDataFrame(held, "doc_id long, text string, folder string").repartition(3)


def asked(spark):
    plain = [(1, ["THE"], "AND", None), (2, ["tion", "헌법재판소"], "AND", None), (3, ["straße", "σας", "법"], "OR", None), (4, ["nothing here"], "OR", None), (5, [], "AND", None), (6, ["longer word", "a"], "AND", ["f2"]), (7, ["재판소헌법"], "AND", None), (8, ["𝒳y", "ion"], "OR", ["f1", "none"]), (9, ["a"], "AND", [])]
    return spark.createDataFrame(plain, "query_id int, keywords array<string>, mode string, folders array<string>")


@pytest.mark.parametrize("limit,block", [(3, 1024), (40, 16), (1000, 1024)])
def test_grams_find_what_reading_all_finds(spark, corpus, tmp_path, monkeypatch, limit, block):
    monkeypatch.setattr(grams, "BLOCK", 1024)
    monkeypatch.setattr(grams, "BLOCK_CHARACTERS", 4_000_000 if block == 1024 else 400)
    index = grams.build(corpus, folder="folder", path=str(tmp_path / "grams"))
    right = grep.search(corpus.where("doc_id is not null"), asked(spark), limit, folder="folder")
    assert rows(grams.search(index, corpus, asked(spark), limit)) == rows(right)
    monkeypatch.setattr(grams, "QUERY_BLOCK", 4)
    assert rows(grams.search(index, corpus, asked(spark), limit)) == rows(right)


def test_candidates_that_fail_are_followed_by_more(spark, tmp_path):
    """Texts with all triples of a keyword, but not the keyword, before those that have it."""
    docs = spark.createDataFrame([(k, "abcx bcd" if k < 90 else "abcd") for k in range(100)], "doc_id long, text string")
    index = grams.build(docs, path=str(tmp_path / "grams"))
    found = grams.search(index, docs, spark.createDataFrame([(1, ["ABCD"], "AND")], "query_id int, keywords array<string>, mode string"), 2)
    assert rows(found) == [(1, 90, 0), (1, 91, 1)]


def test_few_texts_are_opened(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    index = grams.build(docs, path=str(tmp_path / "grams"))
    questions = [(1, ["the", "casino"], "AND", None), (2, ["der", "keit", "und"], "AND", None), (3, ["stupid", "de", "tion"], "AND", None)]
    opened = grams.candidates(index, questions, {}, 10_000).where("not sure")
    assert opened.select("key").distinct().count() < 0.2 * docs.count()  # all matches of all three, without a limit
    first = grams.candidates(index, questions, {}, 20).where("not sure")
    assert first.select("key").distinct().count() < 0.05 * docs.count()  # for a page of ten hits
    assert rows(grams.candidates(index, [(1, ["the", "de"], "AND", None)], {}, 10_000).where("not sure")) == []


def test_an_empty_corpus_has_no_hits(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    index = grams.build(docs, path=str(tmp_path / "grams"))
    assert grams.search(index, docs, asked(spark).drop("folders"), 3).count() == 0


def test_an_index_of_grams_is_kept(spark, corpus, tmp_path):
    corpus.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    grams.kept(docs, str(tmp_path / "kept"))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "kept").rglob("*.parquet")}
    index = grams.kept(docs, str(tmp_path / "kept"))
    assert before and before == {f: f.stat().st_mtime_ns for f in (tmp_path / "kept").rglob("*.parquet")}
    assert grams.search(index, docs, asked(spark), 3).count() > 0


def test_more_keyword_queries_than_a_pass_takes(spark, corpus, monkeypatch):
    right = rows(grep.search(corpus, asked(spark), 5, folder="folder"))
    monkeypatch.setattr(grep, "MOST_QUERIES", 2)
    assert rows(grep.search(corpus, asked(spark), 5, folder="folder")) == right


# ---- cells


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(4)
    held = [(k, [rng.gauss(k % 7, 1.0) for _ in range(6)]) for k in range(900)] + [(k, [1.0] * 6) for k in range(900, 1000)]
    held += [(2000, None), (2001, [1.0]), (2002, [float("nan")] * 6), (2003, [None] + [0.0] * 5)]
    return spark.createDataFrame(held, "vec_id long, embedding array<float>").repartition(3)


def test_all_cells_are_exact_and_few_are_enough(spark, points, tmp_path):
    asked_ = points.where("vec_id % 50 = 0 and vec_id < 2000").selectExpr("vec_id AS query_id", "embedding AS qvec")
    index = cells.build(points, 6, path=str(tmp_path / "cells"))
    good = points.where("vec_id < 2000")
    right = vectors.nearest(asked_, good, 7)
    assert index.rows.count() == 1000  # every vector with distances
    assert rows(cells.nearest(asked_, index, 7, len(index.centres)).select("query_id", "vec_id", "rank")) == rows(right.select("query_id", "vec_id", "rank"))
    probes, told = cells.probes_for(asked_, index, good, 7)
    assert told >= 0.9 and probes < len(index.centres)
    assert cells.recall(cells.nearest(asked_, index, 7, probes), right) == told
    again = cells.load(spark, str(tmp_path / "cells"))
    assert rows(cells.nearest(asked_, again, 7, probes)) == rows(cells.nearest(asked_, index, 7, probes))


def test_cells_of_odd_queries_and_empty_tables(spark, points, tmp_path, monkeypatch):
    index = cells.build(points, 6, path=str(tmp_path / "cells"))
    odd = spark.createDataFrame([(1, [1.0]), (2, None), (3, [float("nan")] * 6), (4, [0.0] * 6)], "query_id int, qvec array<float>")
    assert {r.query_id for r in cells.nearest(odd, index, 2, 3).collect()} == {4}
    monkeypatch.setattr(cells, "QUERY_BLOCK", 2)
    assert {r.query_id for r in cells.nearest(odd, index, 2, 3).collect()} == {4}
    none = cells.build(points.limit(0), 6, path=str(tmp_path / "none"))
    assert cells.nearest(odd, none, 2, 3).count() == 0


# ---- the rest


def test_an_insert_counts_while_it_writes(spark, tmp_path):
    old = spark.createDataFrame([(1,), (2,)], "k long")
    new = spark.createDataFrame([(2,), (3,), (3,), (4,), (None,)], "k long")
    told = ingest.insert(new, old, "k", F.col("k"), str(tmp_path / "out"))
    assert told == one(ingest.ingest_counts(new, old, "k")).asDict() == {"ingested": 2, "skipped": 2}
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(3,), (4,)]
    assert ingest.insert(new.limit(0), old, "k", F.col("k"), str(tmp_path / "none")) == {"ingested": 0, "skipped": 0}


def one(df):
    return df.collect()[0]


def test_functions_by_name(spark):
    docs = spark.createDataFrame([(1, "# é　\rbody ## b"), (2, None)], "k int, text string")
    found = named.rows(spark, "headings_of", docs, "text", "k").select("k", named.call("nfc", F.col("title")).alias("t"), "body")
    assert rows(found) == [(1, "b", ""), (1, "é", "body")]
    assert one(named.register(spark).sql("SELECT nfc('é') AS x")).x == "é"
    for bad in (lambda: named.call("unknown", "k"), lambda: named.rows(spark, "unknown", docs, "text", "k")):
        with pytest.raises(ValueError, match="unknown"):
            bad()
    with pytest.raises(TypeError):
        named.add("x", 3)


def test_blanks_are_the_whole_of_unicode(spark):
    assert set(blanks.SPACES) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    text = "".join(f"a{c}b" for c in blanks.SPACES + "​") + "\r\n"
    got = one(spark.createDataFrame([(text, f"{blanks.SPACES}x y{blanks.SPACES}", "", None)], "t string, s string, e string, n string").select(blanks.lines(F.col("t")).alias("lines"), blanks.strip(F.col("s")).alias("s"), blanks.lines(F.col("e")).alias("none"), blanks.lines(F.col("n")).alias("null")))
    assert got.lines == text.splitlines() and got.s == "x y" and got.none == [] and got.null is None


def test_trees_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "---\na: b\n---\nlost\n### deep\n# one\r\ntext ## two\n###### six\n# again"), (None, "# x"), (2, "#no blank\n####### seven"), (3, None)], "doc_id long, text string")
    plan = trees.tree(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert [(r.node_id, r.parent_id, r.body) for r in trees.tree(docs).where("doc_id = 1").orderBy("preorder").collect()] == [("1.section1", "1", ""), ("1.law1", "1", "text"), ("1.law1.chapter1", "1.law1", ""), ("1.law1.chapter1.h61", "1.law1.chapter1", ""), ("1.law2", "1", "")]
    assert trees.tree(docs).where("doc_id = 2 or doc_id = 3").count() == 0


def test_payloads_of_every_shape(spark):
    shapes = ['{"a": {"b": {"x": 1}}}', '{"a": {"b": [{"x": "s"}, {"y": 2}]}}', '{"a": {"b": "text"}}', '{"a": null}', "{cut", None, '{"b": [{"x": 1}]}', '{"a": {"b": []}}']
    got = spark.createDataFrame([(k, s) for k, s in enumerate(shapes)], "k int, p string").select("k", envelopes.variant_items(F.try_parse_json("p"), ("a", "b"), "struct<x:string>").alias("v")).orderBy("k").collect()
    assert [[x.x for x in r.v] for r in got] == [["1"], ["s", None], [], [], [], [], [], []]


def test_bodies_of_articles(spark):
    law = "# law\n##### 제1조의2 (b)\nother\n##### 제1조 (a)\ntext 　\n\nmore\n## chapter\n##### 제2조\nlast"
    hits = spark.createDataFrame([(law, [("l", "제1조"), ("l", "제2조"), ("l", "제3조"), ("m", "제1조")]), (law, []), (None, [("l", "제1조")])], T.StructType([T.StructField("law", T.StringType()), T.StructField("hits", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("article", T.StringType())])))]))
    got = [r.x for r in hits.select(documents.article_bodies(F.col("hits"), F.create_map(F.lit("l"), F.col("law"))).alias("x")).collect()]
    assert got == ["[l 제1조]\n##### 제1조 (a)\ntext 　\n\nmore\n\n---\n\n[l 제2조]\n##### 제2조\nlast", "", ""]


def test_products_of_matrices_give_what_pairs_give(spark, monkeypatch):
    """Copies, other lengths, nulls, NaN and infinite components, in pieces of a few rows: as the differences of each pair give it, and as a flag prefers."""
    monkeypatch.setattr(vectors, "SIDE", 16)
    monkeypatch.setattr(vectors, "PAIRS", 64)
    rng = random.Random(5)
    held = [(f"v{n:04d}", [float(rng.choice([0, 1, 2, 7])) for _ in range(3)], [n % 3 == 0, False, None]) for n in range(400)]
    held += [("w1", None, None), ("w2", [1.0], [True]), ("w3", [None, 1.0, 2.0], [False]), ("w4", [float("nan"), 1.0, 2.0], []), ("w5", [float("inf"), 1.0, 2.0], [True, True, True]), ("w6", [], None)]
    rows = spark.createDataFrame(held, "vec_id string, embedding array<double>, flags array<boolean>")
    asked = [(n, [float(rng.choice([0, 1, 5])) for _ in range(3)], n % 4) for n in range(40)] + [(50, None, 0), (51, [1.0], 0), (52, [1.0, None, 0.0], 0), (53, [float("nan"), 1.0, 1.0], 1), (54, [], 0), (55, [2.0, 2.0, 2.0], None)]
    asked = spark.createDataFrame(asked, "query_id int, qvec array<double>, place int")
    shown = lambda df: sorted((r.query_id, r.vec_id, r["rank"], repr(r.distance)) for r in df.collect())
    assert shown(vectors.nearest(asked, rows, 5)) == shown(vectors.nearest(asked, rows, 5, prefer=F.lit(True)))
    assert shown(vectors.nearest(asked, rows, 5, flag=("flags", "place"))) == shown(vectors.nearest(asked, rows, 5, prefer=F.get("flags", F.col("place"))))


def test_tables_of_distances_stay_small(monkeypatch):
    """Many points and many cells: what is fitted, and which cells are looked into, is found a piece at a time."""
    points, most = np.random.default_rng(3).random((20_000, 4)), 300 * 20_000 * 8
    tracemalloc.start()
    centres = cells.fit(points, 300)
    bits = cells._looked(points, centres, 150)
    assert tracemalloc.get_traced_memory()[1] < 2 * most
    tracemalloc.stop()
    own = cells._distances(points[:50], centres).argsort(axis=1)[:, :150]
    assert all(set(np.flatnonzero(np.unpackbits(bits, axis=1)[:, q])) == set(own[q]) for q in range(50))
