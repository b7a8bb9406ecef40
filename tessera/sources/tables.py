"""Tables written between the steps of a job, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting for removing the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Its setting for the most rows of a batch that goes to Python.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tessera/{label}-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """What is run inside hands Python at most so many rows at once: for rows that are large. None leaves it as it is."""
    before = spark.conf.get(BATCH)
    if rows is not None and not 0 < int(before) <= rows:
        spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def written(df: DataFrame, label: str, by: str | None = None, path: str | None = None, batch: int | None = None) -> DataFrame:
    """df written once as Parquet and read back: lineage ends here, and a lost executor costs no recomputation beyond it.

    by: a column with few values; rows with another value are not read when it is filtered for one.
    path: where, else a new folder. batch: the most rows that Python gets at once. The write's own shuffle files go when it is done: nothing reads them after that.
    """
    conf, path = df.sparkSession.conf, path or new_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        with batches_of(df.sparkSession, batch):
            (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def removed(spark: SparkSession, path: str) -> bool:
    """Deletes a written table, or the part of one value of its `by` column, that no later step reads; whether anything was there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True))


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there))


def snapshot(df: DataFrame) -> str:
    """A checksum of the files that df is read from, their sizes and times; a new one for a table that has no files.

    It changes when any file does, also where the number of rows stays. Folders are listed; no file is opened.
    """
    spark, found = df.sparkSession, []
    files = set(df.inputFiles())
    if not files:
        return uuid.uuid4().hex
    for folder in sorted({f.rpartition("/")[0] for f in files}):
        there = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        for s in there.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(there):
            if s.isFile():
                found.append((s.getPath().toUri().toString(), s.getLen(), s.getModificationTime()))
    own = [f for f in found if f[0] in files] or found
    return format(zlib.crc32(repr(sorted(own)).encode()), "08x") + format(zlib.adler32(repr(sorted(own)).encode()), "08x")


def publish(spark: SparkSession, name: str, path: str, least: int = 1) -> DataFrame:
    """Makes the view `name` read the table at path, if it holds `least` rows or more; else the view stays as it was, and ValueError is raised."""
    rows = spark.read.parquet(path)
    if rows.limit(least).count() < least:
        raise ValueError(f"{path} has fewer than {least} rows")
    rows.createOrReplaceTempView(name)
    return rows
