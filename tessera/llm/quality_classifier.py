"""Quality grades: ordinal regression over hashed words, their shapes and endings, and how often words and lines repeat."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import graded_text
from tessera.llm.statistics import counts, features as ratios
from tessera.llm.text import hashed, mixed, rows_of, utf8, words

WIDTH = 1 << 16
MAX_LABELLED = 8_000


def rating():
    """The grades in `labels`: 0 poor, 1 good text that is toxic, 2 good text."""
    return F.col("quality") + F.when((F.col("quality") > 0) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)


def _kinds(strings: pa.Array) -> pa.Array:
    """A word's shape: runs of upper case, lower case and digits become one letter each; other ASCII stays."""
    out = strings
    for pattern, letter in ((r"[A-Z]+", "A"), (r"[a-z]+|[^\x00-\x7F]+", "a"), (r"a+", "a"), (r"[0-9]+", "0")):
        out = pc.replace_substring_regex(out, pattern, letter)
    return out


def quality_features(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Square roots of the shares of hashed words and shapes in each text, and ten steps of each of its ratios."""
    starts, flat = words(strings)
    count = len(strings)
    coded = flat.dictionary_encode()
    index = np.asarray(coded.indices) if len(flat) else np.zeros(0, np.int64)
    row = rows_of(starts)
    groups = []
    for seed, own in ((1, pc.utf8_lower(coded.dictionary)), (2, _kinds(coded.dictionary))):
        column = (mixed(hashed(own) + np.uint64(seed)) % np.uint64(WIDTH)).astype(np.int64)[index] if len(flat) else index
        cell, n = np.unique(row * WIDTH + column, return_counts=True)
        groups.append((cell // WIDTH, cell % WIDTH, np.sqrt(n / np.maximum(np.diff(starts), 1)[cell // WIDTH])))
    x, names = ratios(counts(strings))
    for f, name in enumerate(names):
        step = np.clip(np.round(x[:, f] * 20) if name.endswith("share") else np.round(2 * np.log1p(x[:, f])), 0, 20)
        column = mixed(np.uint64(1000 + 50 * f) + step.astype(np.uint64)) % np.uint64(WIDTH)
        groups.append((np.arange(count), column.astype(np.int64), np.full(count, 0.5)))
    return tuple(np.concatenate(g) for g in zip(*groups))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = MAX_LABELLED, least: float = 0.5) -> DataFrame:
    """For each row: key, expected_grade, p_good (P(grade > 0)), p_top (P(grade > 1), null with two grades only) and selected (p_good >= least).

    Null and empty texts are graded by their zero counts, very long ones whole. Repeated rows stay, other columns go, whatever their
    names; an empty table gives no rows. Repeated labels of a key count as the lowest. Without labels of two grades the model is constant.
    """
    model = graded_text.train(docs, labels, rating(), quality_features, WIDTH, most, key, text)
    found = graded_text.grade(docs, model, quality_features, key, text)
    return found.select(key, F.col("expected").alias("expected_grade"), F.col("tails")[0].alias("p_good"), F.get("tails", F.lit(1)).alias("p_top"), (F.col("tails")[0] >= least).alias("selected"))
