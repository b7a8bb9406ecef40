"""Incremental work on streams and batches: high-water marks, message rows, idempotent appends."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.blanks import strip


def above_mark(rows: DataFrame, marks: DataFrame, key: str, time: str) -> DataFrame:
    """Rows strictly later than their key's mark (marks: key, mark); keys without a mark keep all rows. Null times go where a mark is."""
    return rows.join(marks.select(key, "mark"), key, "left").where(F.col("mark").isNull() | (F.col(time) > F.col("mark"))).drop("mark")


def marks_of(rows: DataFrame, key: str, time: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(time).alias("mark"))


def message_content(content: Column, attachments: Column, embeds: Column) -> Column:
    """The stripped content, `Attachments:` with an address on each line, and lines for the embeds' titles and descriptions, with a blank line
    between these three parts; what is empty goes."""
    clean = lambda x: strip(F.coalesce(x, F.lit("")))
    full = lambda values: F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    labelled = lambda label, x: F.when(clean(x) != "", F.concat(F.lit(label), clean(x))).otherwise("")
    urls = full(F.transform(attachments, lambda a: clean(a["url"])))
    lines = full(F.flatten(F.transform(embeds, lambda e: F.array(labelled("Embed title: ", e["title"]), labelled("Embed description: ", e["description"])))))
    parts = F.array(clean(content), F.when(F.size(urls) > 0, F.concat(F.lit("Attachments:\n"), F.concat_ws("\n", urls))), F.concat_ws("\n", lines))
    return clean(F.concat_ws("\n\n", full(parts)))


def message_rows(messages: DataFrame, agent: Column) -> DataFrame:
    """(agent_id, role, content, created_at) of messages that say anything and have a time; bots are assistants."""
    rows = messages.select(
        agent.alias("agent_id"), F.when(F.coalesce(F.col("author.bot"), F.lit(False)), "assistant").otherwise("user").alias("role"),
        message_content(F.col("content"), F.col("attachments"), F.col("embeds")).alias("content"), F.try_to_timestamp("timestamp").alias("created_at"),
    )
    return rows.where("content != '' and created_at is not null")


def append_new(batch: DataFrame, path: str, key: str) -> None:
    """Appends the batch's first row of each key that the Parquet table at path lacks; a replayed batch adds nothing."""
    rows = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
    try:
        rows = rows.join(batch.sparkSession.read.parquet(path).select(key), key, "left_anti")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    rows.write.mode("append").parquet(path)


def stream_into(source: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Runs over what the stream has now, each batch appended by `append_new`; started again, it goes on where it stopped."""
    return source.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
