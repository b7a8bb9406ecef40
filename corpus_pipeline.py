"""From raw documents to packed training sequences: quality, near copies, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, packing, quality_rules, repeats
from tessera.llm.scratch import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the fixed limits and the boosted trees; all others go.

    Null, empty and short texts fail the limits and go. Repeated rows are judged alike, each by itself; a text of any length is
    judged whole; other columns stay, whatever their names; an empty table stays empty. Without a labelled document in docs the
    limits alone judge.
    """
    return quality_rules.keep(docs, _table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    The smallest doc_id of a group stays; of equal ones (repeated rows, ties) the row that is read first, and null ones give way to
    any other. Rows with a null, empty or blank text link with nothing and stay. Texts of any length are compared whole; other
    columns stay, whatever their names; an empty table stays empty.
    """
    return jaccard.distinct(docs, size=5, percent=80)


def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of passages of 200 bytes or more; n_chars follows the text where it is there. No row goes.

    The copy that is read first stays, in the same text too, so of repeated rows one keeps its text. Null texts become empty, short
    ones stay; a text of any length up to 2**28 bytes is compared whole; other columns stay, whatever their names; an empty table
    stays empty.
    """
    found = repeats.without_repeats(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of ten words of a benchmark item.

    Null and empty texts hold none and stay; repeated rows stay or go alike; a text of any length is searched whole; other columns
    stay, whatever their names; without documents or items nothing changes.
    """
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts' ids in sequences of 2048.

    A null or empty text is the end id alone; each repeated row has its own pieces; a text of any length is encoded whole and cut
    where sequences end; only doc_id is kept of the columns; an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("suffix-array dedup", distinct_passages),
    ("benchmark decontamination", clean_documents),
    ("packing", packed_sequences),
]

#: No SQL expresses the boosted trees or the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that the one before it kept, each written as Parquet and read again as the next one's documents."""
    docs = _table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{number}")
    return docs
