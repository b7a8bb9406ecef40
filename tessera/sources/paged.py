"""Paged services as a Spark source: pages are partitions, a fetch function is the port."""

from __future__ import annotations

import importlib
import itertools
import json
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedSource(DataSource):
    """format("paged"): rows (page, position, payload) from `fetch`, the name module:function of (page, size) -> list of objects.

    Options: pages (1 by default), size (100), from (first page, 1), per_second (0: no limit, else requests a second in all, which
    then come from one task). A page that is shorter than size ends its partition's pages, which come in ranges. fetch may also
    return (total, list): a page that reaches the total ends them too.
    With the option keyset, the name of a field, pages are asked for by key instead: fetch(before, size) gets that field of the last
    object so far, None at first, until a page is short. keys, a JSON list, makes a partition of each key: fetch(key, before, size).
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, position int, payload string" if "keys" not in self.options else "key string, page int, position int, payload string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.fetch, self.size = options["fetch"], int(options.get("size", 100))
        self.first, self.pages = int(options.get("from", 1)), int(options.get("pages", 1))
        self.rate, self.ranges = float(options.get("per_second", 0)), int(options.get("partitions", 8))
        self.keyset, self.keys = options.get("keyset"), json.loads(options["keys"]) if "keys" in options else None

    def partitions(self) -> list[InputPartition]:
        if self.keyset is not None:
            return [InputPartition((k,)) for k in self.keys] if self.keys is not None else [InputPartition(())]
        count = 1 if self.rate > 0 else max(1, min(self.ranges, self.pages))
        edges = [self.first + self.pages * k // count for k in range(count + 1)]
        return [InputPartition((a, b)) for a, b in zip(edges[:-1], edges[1:])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.fetch.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        due = time.monotonic()
        by_key = self.keyset is not None
        key, before = partition.value if by_key else (), None
        for page in itertools.count(1) if by_key else range(*partition.value):
            if self.rate > 0:
                time.sleep(max(0.0, due - time.monotonic()))
                due = time.monotonic() + 1 / self.rate
            found = fetch(*key, before, self.size) if by_key else fetch(page, self.size)
            total, items = found if isinstance(found, tuple) else (None, found)
            for position, item in enumerate(items):
                yield *key, page, position, json.dumps(item, ensure_ascii=False)
            if len(items) < self.size or (total is not None and page * self.size >= total):
                return
            before = items[-1][self.keyset] if by_key else None


def read_pages(spark: SparkSession, fetch: str, pages: int, size: int = 100, most: int | None = None, **options) -> DataFrame:
    """All items of the pages in order of page and position; only the first `most` if given."""
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged").option("fetch", fetch).option("pages", pages).option("size", size)
    for name, value in options.items():
        reader = reader.option(name, value)
    rows = reader.load()
    return rows.orderBy("page", "position").limit(most) if most is not None else rows


def read_messages(spark: SparkSession, fetch: str, keys: list[str], keyset: str = "id", size: int = 100) -> DataFrame:
    """(key, page, position, payload) of all keys' objects, newest first as the service gives them; order by page and position, descending, for the oldest first."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").option("fetch", fetch).option("keyset", keyset).option("keys", json.dumps(keys)).option("size", size).load()


def post(rows: DataFrame, send: str, size: int = 100) -> DataFrame:
    """(inserted): one row for each batch of `size` rows at most that `send`, module:function of a list of dicts, was called with.

    It is called on the executors, and again where a task is repeated: the service must take a row twice without harm, as inserts by key do.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, _, name = send.partition(":")
        call = getattr(importlib.import_module(module), name)
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                yield pa.RecordBatch.from_arrays([pa.array([int(call(batch.slice(start, size).to_pylist()))], pa.int64())], ["inserted"])

    return rows.mapInArrow(sent, "inserted long")


def read_array(spark: SparkSession, path: str, item: str, most: int | None = None, missing_ok: bool = False) -> DataFrame:
    """A JSON file that is one array of objects (schema: item), in its order; the first `most` objects if given. A missing file is an error, or has no rows where missing_ok."""
    try:
        lines = spark.read.text(path, wholetext=True)
    except AnalysisException as missing:
        if not missing_ok or missing.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string")
    rows = lines.select(F.posexplode(F.from_json("value", f"array<{item}>")).alias("position", "x")).select("position", "x.*")
    return rows.orderBy("position").limit(most) if most is not None else rows
