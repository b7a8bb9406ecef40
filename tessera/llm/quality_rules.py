"""Quality verdicts: fixed limits first, then boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import boosted_trees
from tessera.llm.labelled import labelled_texts
from tessera.llm.statistics import COUNTS, counts, document_counts, features
from tessera.llm.text import slices, utf8

#: The score may only fall as these grow.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "pipe_share")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_LABELLED = 20_000


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = MAX_LABELLED) -> boosted_trees.Forest:
    """Fits the trees on at most `most` labelled documents: only their statistics come to the driver, and are put in order there."""
    sample = labelled_texts(docs, labels, F.col("quality"), key, text, most)
    found = document_counts(sample.withColumn("place", F.struct("place", "grade")), "place").select("place.place.*", "place.grade", *COUNTS).toPandas().sort_values(["hash", "key"])
    x, names = features({c: found[c].to_numpy() for c in COUNTS})
    return boosted_trees.fit(x, (found["grade"].to_numpy() > 0).astype(float), np.array([-1 if n in FALLING else 0 for n in names]))


def verdicts(forest: boosted_trees.Forest, strings: pa.Array, least: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts, whether the fixed limits fail, the trees' probability of good quality, and the verdict."""
    found = counts(strings)
    failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])
    good = forest.probability(features(found)[0])
    return found, failed, good, ~failed & (good >= least)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """For each row: key, the statistics, base_failed, p_good and kept.

    Null and empty texts have no words and fail. Repeated rows stay; other columns go, whatever their names; an empty table gives no
    rows, a very long text is judged whole. Repeated labels of a key count as the lowest. Without labels of both classes the trees
    are constant: their share of good labels (one half without any) then decides for all that pass the limits.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, text))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found, failed, good, kept = verdicts(sent.value, utf8(part.column("text")), least)
            yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(found[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(good), pa.array(kept)], ["key", *COUNTS, "base_failed", "p_good", "kept"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = f"key {rows.schema['key'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, p_good double, kept boolean"
    return rows.mapInArrow(score, out).withColumnRenamed("key", key)


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, text))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield part.filter(pa.array(verdicts(sent.value, utf8(part.column(text)), least)[3]))

    return docs.mapInArrow(choose, docs.schema)
