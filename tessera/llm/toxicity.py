"""Toxicity: ordinal regression of severity over the words that a text holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import graded_text
from tessera.llm.decontaminate import WORD_BYTES
from tessera.llm.text import hashed, mapped, mixed, rows_of, words

WIDTH = 1 << 18
MAX_LABELLED = 20_000
#: Characters of the beginnings that count as features of longer words.
PREFIXES = (5, 6, 7, 8)


def severity():
    """The grades in `labels`: 0 not toxic, 1 toxic in good text, 2 toxic in poor text."""
    return F.col("toxic") + F.when((F.col("toxic") > 0) & (F.coalesce("quality", F.lit(1)) == 0), 1).otherwise(0)


def toxicity_features(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, None]:
    """1 for each hashed word, and each beginning of a longer word, that a text holds, however often; upper and lower case are alike."""
    starts, flat = words(mapped(strings, WORD_BYTES))
    coded, row = flat.dictionary_encode(), rows_of(starts)
    index, count = np.asarray(coded.indices), len(coded.dictionary)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), None
    lengths = np.asarray(pc.utf8_length(coded.dictionary))
    held = np.unique(row.astype(np.int64) * count + index)  # a text's different words
    row, index = held // count, held % count
    cells = []
    for size in (0, *PREFIXES):
        own = coded.dictionary if not size else pc.utf8_slice_codeunits(coded.dictionary, 0, size)
        column = (mixed(hashed(own) + np.uint64(77 + size)) % np.uint64(WIDTH)).astype(np.int64)
        long = (lengths > size)[index]
        cells.append(row[long] * WIDTH + column[index[long]])
    cell = np.unique(np.concatenate(cells))
    return cell // WIDTH, cell % WIDTH, None


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = MAX_LABELLED, least: float = 0.5) -> DataFrame:
    """For each row: key, expected_severity, p_toxic (P(severity > 0)), p_severe (P(severity > 1), null with two grades only) and toxic.

    Null and empty texts hold no word and get the thresholds' own probabilities; very long ones are graded whole. Repeated rows stay,
    other columns go, whatever their names; an empty table gives no rows. Repeated labels of a key count as the lowest. Without labels of two grades the model is constant.
    """
    model = graded_text.train(docs, labels, severity(), toxicity_features, WIDTH, most, key, text, sparsity=3e-4)
    found = graded_text.grade(docs, model, toxicity_features, key, text)
    return found.select(key, F.col("expected").alias("expected_severity"), F.col("tails")[0].alias("p_toxic"), F.get("tails", F.lit(1)).alias("p_severe"), (F.col("tails")[0] >= least).alias("toxic"))
