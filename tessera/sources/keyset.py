"""Services that page by key as a stream: the offset is the place in each key's pages, so a stopped backfill goes on where it was."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery


def _order(value: str) -> tuple[int, str]:
    """Identifiers are numbers that may be longer than any integer type: the longer one is the later."""
    return len(str(value)), str(value)


class KeysetSource(DataSource):
    """format("keyset"): rows (key, id, payload) of a service that gives each key's objects newest first.

    Options: fetch, the name module:function of (key, before, size) -> list of objects, those older than `before` (None: the newest);
    keys, a JSON list; field, the identifier's name (id); size (100). Each batch takes a page of every key. A short page ends a
    key's cycle; the next batch begins a new one, which ends at the newest object of the cycle before.
    """

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self) -> str:
        return "key string, id string, payload string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return KeysetReader(dict(self.options))


class KeysetReader(SimpleDataSourceStreamReader):
    """Offsets: for each key, before (the last object that was taken in this cycle; None: none), top (the cycle's newest), until (the
    newest of the last whole cycle) and open (whether the cycle goes on)."""

    def __init__(self, options: dict[str, str]):
        self.name, self.keys, self.field, self.size = options["fetch"], json.loads(options["keys"]), options.get("field", "id"), int(options.get("size", 100))

    @property
    def fetch(self) -> Callable[..., list[dict]]:
        module, _, name = self.name.partition(":")
        return getattr(importlib.import_module(module), name)

    def initialOffset(self) -> dict:
        return {k: {"before": None, "top": None, "until": None, "open": True} for k in self.keys}

    def _row(self, key: str, item: dict) -> tuple[str, str, str]:
        return key, str(item[self.field]), json.dumps(item, ensure_ascii=False)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], {}
        for key in self.keys:
            at = start.get(key) or self.initialOffset()[key]
            if not at["open"]:
                at = {"before": None, "top": None, "until": at["until"], "open": True}
            page = self.fetch(key, at["before"], self.size)
            fresh = [x for x in page if at["until"] is None or _order(x[self.field]) > _order(at["until"])]
            rows += [self._row(key, x) for x in fresh]
            top = at["top"] or (str(fresh[0][self.field]) if fresh else None)
            if len(page) < self.size or len(fresh) < len(page):  # the end of the pages, or what is known from before
                end[key] = {"before": None, "top": None, "until": top or at["until"], "open": False}
                if not fresh and not start.get(key, at)["open"]:
                    end[key] = start[key]  # nothing new: the offset stays, and so no batch is made
            else:
                end[key] = {"before": str(page[-1][self.field]), "top": top, "until": at["until"], "open": True}
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The rows of a batch that was planned before: pages are asked for again, and what came to the service since is left out."""
        for key in self.keys:
            at, to = start.get(key) or self.initialOffset()[key], end[key]
            if at == to:
                continue
            before, until = (at["before"], at["until"])
            top, last = (to["top"], to["before"]) if to["open"] else (to["until"], None)
            while True:
                page = self.fetch(key, before, self.size)
                for x in page:
                    own = _order(x[self.field])
                    if (until is None or own > _order(until)) and (last is None or own >= _order(last)) and (top is None or own <= _order(top)):
                        yield self._row(key, x)
                if len(page) < self.size or (last is not None and _order(page[-1][self.field]) <= _order(last)) or (until is not None and _order(page[-1][self.field]) <= _order(until)):
                    break
                before = str(page[-1][self.field])

    def commit(self, end: dict) -> None:
        """Nothing is held at the service."""


def stream_messages(spark: SparkSession, fetch: str, keys: list[str], field: str = "id", size: int = 100) -> DataFrame:
    """(key, id, payload) of all keys' objects as a stream."""
    spark.dataSource.register(KeysetSource)
    return spark.readStream.format("keyset").option("fetch", fetch).option("keys", json.dumps(keys)).option("field", field).option("size", size).load()


def backfill_into(spark: SparkSession, fetch: str, keys: list[str], path: str, checkpoint: str, field: str = "id", size: int = 100, most: int | None = None) -> int:
    """Takes pages into the Parquet table at path until a round finds nothing new, or `most` rounds; the number of rounds.

    Each round is a run of the stream over its checkpoint, which can end anywhere: the next one goes on with the page after.
    """
    rounds = 0
    while most is None or rounds < most:
        rows = stream_messages(spark, fetch, keys, field, size)
        query: StreamingQuery = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        rounds += 1
        if not any(p["numInputRows"] for p in query.recentProgress):
            break
    return rounds
