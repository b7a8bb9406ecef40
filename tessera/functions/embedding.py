"""Offline default of the embedding port: hashed term frequencies, by built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokenize

#: Turns a text column into a vector column (array<float>). A model goes in as a pandas UDF of the same kind.
Embedder = Callable[[Column], Column]


def hashed_frequencies(size: int = 64) -> Embedder:
    """Unit vectors of how often tokens fall in each of `size` groups. They know words, not meanings."""

    def embed(text: Column) -> Column:
        groups = F.transform(tokenize(text), lambda t: F.pmod(F.xxhash64(t), F.lit(size)))
        counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda g: F.size(F.filter(groups, lambda x: x == g)).cast("double"))
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(counts, lambda x: (x / norm).cast("float"))

    return embed


def embedded(rows: DataFrame, embed: Embedder, text: str = "text", vector: str = "embedding") -> DataFrame:
    return rows.withColumn(vector, embed(F.col(text)))
