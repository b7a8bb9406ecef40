"""Exact histogram of encoded lengths, with suffix sums that answer for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.encoding import WORD_BPE, encoder
from tessera.llm.scratch import materialize
from tessera.llm.text import slices, utf8

#: Lengths that share a block: sums go by block first, so that no task gets more rows than there are blocks or lengths in one.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, text: str = "text", tokenizer: str = WORD_BPE) -> DataFrame:
    """n_tokens (long) of each row's whole text; null and empty texts have 0. Repeated rows count as often as they stand there, a very
    long text is encoded whole. Other columns go, so clashing names don't matter."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            starts, _ = encoder(tokenizer).encode(utf8(part.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(starts), pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(measure, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length that occurs; an empty table gives no rows, and rows whose length is null don't count.

    n_docs: documents of this length. docs_at_least, tokens_at_least: documents of this length or more, and their tokens.
    docs_below, tokens_below: the others. truncated_tokens: all tokens left when each document is cut at this length.
    """
    counts = lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    counts = materialize(counts, "lengths")  # a row for each length: texts are encoded once, though the sums below read it twice
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))  # a row for each 1024 lengths at most
    blocks = blocks.select(
        "block", F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"),
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.join(blocks, "block").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens",
        (F.sum("n_docs").over(inside) + F.col("docs_after")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("tokens_after")).alias("tokens_at_least"),
    )
    below = F.col("all_tokens") - F.col("tokens_at_least")
    return summed.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_docs") - F.col("docs_at_least")).alias("docs_below"), below.alias("tokens_below"),
        (below + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents over it, all tokens, and the tokens left when documents are cut there. An empty histogram gives null sums."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    rows = [F.struct(F.lit(int(k)).cast("long").alias("context_limit"), F.sum(F.when(n > k, d).otherwise(0)).alias("docs_over"), F.sum(n * d).alias("all_tokens"), F.sum(F.least(n, F.lit(int(k))) * d).alias("truncated_tokens")) for k in limits]
    return histogram.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def quantile_lengths(histogram: DataFrame, quantiles: list[float]) -> DataFrame:
    """For each q in [0, 1]: the smallest length that at least a share q of the documents doesn't exceed. An empty histogram gives null."""
    wanted = [F.struct(F.lit(float(q)).alias("quantile"), F.min(F.when(F.col("docs_below") + F.col("n_docs") >= F.lit(float(q)) * (F.col("docs_below") + F.col("docs_at_least")), F.col("n_tokens"))).alias("n_tokens")) for q in quantiles]
    return histogram.agg(F.array(*wanted).alias("rows")).select(F.inline("rows"))
