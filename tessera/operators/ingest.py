"""Keeping tables: insert what is new, replace by key, delete by predicate, refresh changed groups."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.functions.blanks import strip


def first_of_each(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row for each key, the first by order; null keys go."""
    return rows.where(F.col(key).isNotNull()).withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_place = 1").drop("_place")


def new_rows(incoming: DataFrame, existing: DataFrame, key: str, order: Column) -> DataFrame:
    """What an insert adds: the first incoming row of each key that the table lacks. Repeating it adds nothing."""
    return first_of_each(incoming.join(existing.select(key), key, "left_anti"), key, order)


def ingest_counts(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """One row: ingested and skipped, of all incoming rows with a key."""
    marked = incoming.where(F.col(key).isNotNull()).join(existing.select(key).distinct().withColumn("there", F.lit(True)), key, "left")
    fresh = F.count_distinct(F.when(F.col("there").isNull(), F.col(key)))
    return marked.agg(fresh.alias("ingested"), (F.count("*") - fresh).alias("skipped"))


def insert(incoming: DataFrame, existing: DataFrame, key: str, order: Column, path: str) -> dict[str, int]:
    """Appends what `new_rows` gives to the Parquet table at path, and tells ingested and skipped, as `ingest_counts` does.

    The counts are observed on the way of the one write: nothing is joined or read a second time. existing must not be that table
    while it is written: Spark refuses to read what it overwrites, but not what it appends to, so give it a version that stays.
    """
    offered, added = Observation(), Observation()
    rows = incoming.where(F.col(key).isNotNull()).observe(offered, F.count(F.lit(1)).alias("n"))
    new_rows(rows, existing, key, order).observe(added, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    ingested = _observed(added)
    return {"ingested": ingested, "skipped": _observed(offered) - ingested}


def _observed(rows: Observation) -> int:
    """The observed number; 0 where Spark saw before it ran that there are no rows, and so observed none."""
    try:
        return rows.get["n"]
    except Py4JJavaError as none:
        if "AssertionError" not in str(none.java_exception):
            raise
        return 0


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: Column) -> DataFrame:
    """existing with the rows of incoming in place of those with the same key; of repeated keys the first by order."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(first_of_each(incoming, key, order))


def deleted(existing: DataFrame, predicate: Column) -> DataFrame:
    """The table without rows for which the predicate is true; null is not true."""
    return existing.where(~F.coalesce(predicate, F.lit(False)))


def fingerprints(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """(group, n, mark): a checksum of each group's rows that doesn't depend on their order."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("mark"))


def changed_groups(old: DataFrame, new: DataFrame, group: str, *columns: str) -> DataFrame:
    """(group, change) with change in added, removed, changed: a full outer join of both sides' fingerprints."""
    a, b = fingerprints(old, group, *columns), fingerprints(new, group, *columns)
    both = a.select(group, "n", "mark").join(b.select(group, F.col("n").alias("n2"), F.col("mark").alias("mark2")), group, "full_outer")
    change = F.when(F.col("n").isNull(), "added").when(F.col("n2").isNull(), "removed").when((F.col("n") != F.col("n2")) | (F.col("mark") != F.col("mark2")), "changed")
    return both.select(group, change.alias("change")).where("change is not null")


def refreshed(old: DataFrame, new: DataFrame, group: str, *columns: str) -> DataFrame:
    """old with all changed groups deleted and taken from new; groups without a change keep their old rows."""
    touched = changed_groups(old, new, group, *columns)
    return old.join(touched.select(group), group, "left_anti").unionByName(new.join(touched.where("change != 'removed'").select(group), group, "left_semi"))


def write_groups(rows: DataFrame, path: str, group: str) -> None:
    """Replaces only the partitions of the groups that rows hold."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)


def newest(rows: DataFrame, keep: int, time: str, *keys: str) -> DataFrame:
    """The `keep` newest rows of each key (of all, without keys); of equal times those with the smallest other columns, in their order."""
    order = [F.desc(time), *[c for c in rows.columns if c != time and c not in keys]]
    if not keys:
        return rows.orderBy(*order).limit(keep)
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= keep).drop("_place")


def changed_folders(paths: DataFrame, folders: DataFrame, path: str = "path", folder: str = "folder", root: str = "kr", suffix: str = ".md") -> DataFrame:
    """(folder), each once: of changed paths like root/folder/file.md the folders that are there."""
    clean = strip(F.col(path))
    parts = F.split(F.regexp_replace(clean, "/+", "/"), "/")
    named = paths.where(F.endswith(clean, F.lit(suffix)) & (parts[0] == root) & (F.size(parts) >= 2)).select(parts[1].alias(folder)).distinct()
    return named.join(folders.select(folder), folder, "left_semi")
