"""Streams that remember by themselves: keys seen and high-water marks live in the state store, so no target is ever read again."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Spark's setting for the state store, and the store on the executors' disks, whose changes go to the checkpoint.
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before is not None else spark.conf.unset(PROVIDER)


def unseen_into(source: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Appends the first row of each key that the stream ever has to the Parquet table at path, over what there is now.

    The keys are the stream's state, by Spark's own removal of duplicates: the table is not read, however large it has become. A
    batch that is repeated, late or run again adds nothing, and started again with its checkpoint the stream goes on where it
    stopped. Rows without a key are left out.
    """
    with _rocks(source.sparkSession):
        rows = source.where(F.col(key).isNotNull()).dropDuplicates([key])
        return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class _Marks(StatefulProcessor):
    """For each key the latest time so far; rows later than what it was before their batch pass."""

    def __init__(self, key: str, time: str):
        self.key, self.time = key, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "mark timestamp")

    def handleInitialState(self, key, initial: pd.DataFrame, timer) -> None:
        times = initial["mark"].dropna()
        if len(times):
            self.mark.update((times.max().to_pydatetime(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        before = self.mark.get()[0] if self.mark.exists() else None
        latest = before
        for batch in rows:
            times = batch[self.time]
            passed = batch[times > pd.Timestamp(before)] if before is not None else batch
            if len(passed):
                top = passed[self.time].max()
                if not pd.isna(top) and (latest is None or top > pd.Timestamp(latest)):
                    latest = top.to_pydatetime()
                yield passed
        if latest is not None and latest != before:
            self.mark.update((latest,))

    def close(self) -> None:
        pass


def newer(source: DataFrame, key: str, time: str, marks: DataFrame | None = None) -> DataFrame:
    """The rows of a stream that are strictly later than their key's mark; each batch raises the marks for those after it.

    marks: (key, mark), what the stream starts from, read once with the first batch; keys without a mark pass all rows. A late row
    and a batch that comes again pass nothing. Rows without a time pass only while their key has no mark. Start it with `start_newer`.
    """
    grouped = source.groupBy(key)
    initial = marks.select(F.col(key), F.col("mark")).groupBy(key) if marks is not None else None
    return grouped.transformWithStateInPandas(_Marks(key, time), outputStructType=T.StructType(source.schema.fields), outputMode="append", timeMode="none", initialState=initial)


def start_newer(source: DataFrame, key: str, time: str, path: str, checkpoint: str, marks: DataFrame | None = None) -> StreamingQuery:
    """Runs `newer` over what the stream has now into the Parquet table at path, which is not read."""
    with _rocks(source.sparkSession):
        rows = newer(source, key, time, marks)
        return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
