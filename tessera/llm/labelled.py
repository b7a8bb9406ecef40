"""The labelled texts that a model is fitted on: a sample of bounded size, one row for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize

#: Bytes of text that a sample may hold, so that neither repeated rows nor long texts make it larger than a driver can fit.
MAX_BYTES = 128 << 20


def labelled_texts(docs: DataFrame, labels: DataFrame, grade: Column, key: str = "doc_id", text: str = "text", most: int = 20_000, most_bytes: int = MAX_BYTES) -> DataFrame:
    """(place, grade, text) of at most `most` labelled keys and about `most_bytes` of text, in the order of their keys' hashes.

    Labels without key or grade don't count; of several grades of a key the lowest does, and of several texts the least one, so each
    key weighs the same however often it stands there. Labels without a document give no row. The sample is written once: documents
    are read once for it. place: the hash, ties told apart by the key's text.
    """
    graded = labels.select(F.col(key).alias("key"), grade.cast("int").alias("grade")).where("key is not null and grade is not null")
    chosen = graded.groupBy("key").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("key"), "key").limit(most)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")  # `most` rows at most
    place = F.struct(F.xxhash64("key").alias("hash"), F.col("key").cast("string").alias("key"))
    rows = materialize(rows.groupBy("key", "grade").agg(F.min("text").alias("text")).select(place.alias("place"), "grade", "text"), "labelled")
    sizes = sorted((r.hash, r.key, r.n) for r in rows.select("place.*", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).toLocalIterator())  # `most` rows at most
    total = 0
    for at, (hash_, own, n) in enumerate(sizes):
        total += n
        if total > most_bytes and at:
            return rows.where(F.col("place") < F.struct(F.lit(hash_).cast("long").alias("hash"), F.lit(own).alias("key")))
    return rows
