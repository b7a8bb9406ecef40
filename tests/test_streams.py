"""Streams with state and the keyset source: repeated and late batches, stops and restarts between pages."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.sources import keyset
from tessera.streaming import state


def test_the_first_row_of_a_key_is_kept_without_reading_the_target(spark, tmp_path):
    put = lambda name, rows: spark.createDataFrame(rows, "id long, v string").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    source = lambda: spark.readStream.schema("id long, v string").parquet(str(tmp_path / "in" / "*"))
    run = lambda: state.unseen_into(source(), str(tmp_path / "out"), str(tmp_path / "check"), "id").awaitTermination()
    held = lambda: Counter(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    put("a", [(1, "x"), (2, "x"), (2, "y"), (None, "z")])
    run()
    assert held() == {1: 1, 2: 1}
    run()  # again, with nothing new
    put("b", [(2, "late"), (3, "new"), (1, "again")])
    run()
    assert held() == {1: 1, 2: 1, 3: 1}
    (tmp_path / "out").rename(tmp_path / "elsewhere")  # the table may even be gone: what was seen is the stream's own
    put("c", [(3, "again"), (4, "new")])
    (tmp_path / "out").mkdir()
    run()
    files = [f for f in (tmp_path / "out").glob("*.parquet")]
    assert sorted(r.id for f in files for r in spark.read.parquet(str(f)).collect()) == [4]


def test_marks_rise_with_each_batch(spark, tmp_path):
    put = lambda name, rows: spark.createDataFrame(rows, "agent string, s int").withColumn("at", F.timestamp_seconds(F.lit(1_800_000_000) + F.col("s"))).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    source = lambda: spark.readStream.schema("agent string, s int, at timestamp").parquet(str(tmp_path / "in" / "*"))
    marks = spark.createDataFrame([("a", 10), ("c", 1)], "agent string, s int").select("agent", F.timestamp_seconds(F.lit(1_800_000_000) + F.col("s")).alias("mark"))
    run = lambda: state.start_newer(source(), "agent", "at", str(tmp_path / "out"), str(tmp_path / "check"), marks).awaitTermination()
    held = lambda: sorted((r.agent, r.s) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    put("1", [("a", 9), ("a", 10), ("a", 11), ("a", 11), ("b", 3), ("b", 1)])
    run()
    assert held() == [("a", 11), ("a", 11), ("b", 1), ("b", 3)]
    put("2", [("a", 11), ("a", 10), ("b", 2), ("b", 4), ("c", 1), ("c", 2)])  # repeated, late, new
    run()
    run()
    assert held() == [("a", 11), ("a", 11), ("b", 1), ("b", 3), ("b", 4), ("c", 2)]


@pytest.fixture
def service(tmp_path):
    """(keys, add): the keys of three channels, and what puts messages into one."""
    path = tmp_path / "service.json"
    path.write_text(json.dumps({"x": [{"id": str(n), "t": f"m{n}"} for n in range(95, 106)], "y": [{"id": "7"}], "z": []}))

    def add(name, *ids):
        now = json.loads(path.read_text())
        now[name] += [{"id": str(n), "t": "later"} for n in ids]
        path.write_text(json.dumps(now))

    return [f"{path}#{c}" for c in "xyz"], add


def counted(x, y=(7,), z=()):
    return Counter({(name, str(n)): 1 for name, ids in zip("xyz", (x, y, z)) for n in ids})


def test_stops_between_pages_lose_and_double_nothing(spark, tmp_path, service):
    keys, add = service
    go = lambda most=None: keyset.backfill_into(spark, "tests.paged_service:fetch", keys, str(tmp_path / "out"), str(tmp_path / "check"), size=3, most=most)
    held = lambda: Counter((r.key[-1], r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    go(2)
    assert 0 < sum(held().values()) < 12
    add("x", 106)  # came while the backfill stood still
    go()
    assert held() == counted(range(95, 107))
    add("x", *range(107, 112))
    add("z", 1)
    go()
    go()
    assert held() == counted(range(95, 112), z=[1])


def test_a_batch_that_failed_is_read_again_as_it_was(service):
    keys, add = service
    reader = keyset.KeysetReader({"fetch": "tests.paged_service:fetch", "keys": json.dumps(keys), "size": "3"})
    at, taken = reader.initialOffset(), []
    for turn in range(12):
        rows, to = reader.read(at)
        rows = list(rows)
        if turn == 1:
            add("x", 300)  # what comes after the batch was planned is not in it
        assert list(reader.readBetweenOffsets(at, to)) == rows
        taken += rows
        if to == at:
            break
        at = json.loads(json.dumps(to))
    assert Counter((k[-1], n) for k, n, _ in taken) == counted([*range(95, 106), 300])
