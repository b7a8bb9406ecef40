"""Markdown corpora on any file system that Spark reads: folder/kind.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_folders(spark: SparkSession, root: str) -> DataFrame:
    """(folder, kind, path, text) of every root/folder/kind.md. Files of the root itself are not among them; without any file it is an error."""
    files = spark.read.text(f"{root.rstrip('/')}/*/*.md", wholetext=True)
    parts = F.split(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "/")
    return files.select(F.element_at(parts, -2).alias("folder"), F.regexp_replace(F.element_at(parts, -1), r"\.md$", "").alias("kind"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def folders(spark: SparkSession, root: str) -> DataFrame:
    """(folder) of every folder below root that holds a Markdown file; no file is opened. Without any it is an error, as in read_folders."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*.md")
    return files.select(F.element_at(F.split(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "/"), -2).alias("folder")).distinct()


def preferred(files: DataFrame, folder: str, kind: str = "법률") -> DataFrame:
    """The one file of a folder that is of the kind; without one the first by kind; no row for an unknown folder."""
    order = Window.partitionBy("folder").orderBy((F.col("kind") != kind).cast("int"), "kind", "path")
    return files.where(F.col("folder") == folder).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def largest(files: DataFrame) -> DataFrame:
    """Of files that share folder and kind, the longest text; of equal ones the first path."""
    order = Window.partitionBy("folder", "kind").orderBy(F.desc(F.length("text")), "path")
    return files.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
