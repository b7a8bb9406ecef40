"""Each stage of the pipeline over the awkward cases: nulls, empty and long texts, repeated rows, clashing and missing columns, empty tables."""

import random

import pytest
from test_llm import awkward

import corpus_pipeline

SF = "/root/testdata/sf0.001"
FUNCTIONS = dict(corpus_pipeline.STAGES)
CLASHES = ["kept", "spans", "n_bytes", "key", "batch", "bucket", "row"]


@pytest.fixture(scope="module")
def docs(spark):
    """Those rows beside the driver's own, so that labels and benchmark items meet something; without n_chars, with names that operators use inside."""
    own = [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows = [(k, t, *[f"{c}{n}" for c in CLASHES]) for n, (k, t) in enumerate([*awkward(), *own])]
    return spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{c} string' for c in CLASHES)}").repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES][:-1])
def test_a_stage_keeps_columns_and_rows_as_it_says(spark, docs, name):
    found = FUNCTIONS[name](spark, docs, SF)
    assert found.columns == docs.columns
    before = {(r.doc_id, *[r[c] for c in CLASHES]): r.text for r in docs.collect()}
    after = {(r.doc_id, *[r[c] for c in CLASHES]): r.text for r in found.collect()}
    assert after.keys() <= before.keys()
    lost = {k[0] for k in before.keys() - after.keys()}
    if name == "suffix-array dedup":
        assert not lost and all(t == "" for k, t in after.items() if before[k] is None)
    elif name == "n-gram Jaccard join":
        assert 4 not in lost and 5 not in lost and 6 not in lost and {2, 3} <= lost and 1 not in lost
    elif name == "benchmark decontamination":
        assert all(k >= 1000 for k in lost if k is not None) and all(before[k] == t for k, t in after.items())
    else:
        assert {4, 5, 6, 7, 8} <= lost and all(before[k] == t for k, t in after.items())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_a_stage_over_an_empty_table(spark, docs, name):
    assert FUNCTIONS[name](spark, docs.limit(0), SF).count() == 0


def test_packing_of_awkward_rows(spark, docs):
    pieces = FUNCTIONS["packing"](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    assert sum(r.length for r in pieces) == max(r.sequence_id * 2048 + r.offset + r.length for r in pieces)


def test_all_stages_in_turn(spark, docs, tmp_path):
    rng = random.Random(1)
    good = [" ".join(f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(40)}" for _ in range(200)) for _ in range(3)]
    rows = spark.createDataFrame([(k, t, *["x"] * len(CLASHES)) for k, t in enumerate(good, 5000)], docs.schema)
    now = docs.unionByName(rows)
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert now.count() > 0
