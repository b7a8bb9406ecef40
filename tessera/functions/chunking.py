"""Structured Markdown to chunks: one row for each article, with identifiers that stay unique inside a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.blanks import strip
from tessera.functions.text import frontmatter

#: An article heading (fixed value).
HEADING = r"(?mU)^#{1,6}\s*(제\d+조(?:의\d+)?(?:\s*\([^)]+\))?)"
NUMBER, TITLE = r"^(제\d+조(?:의\d+)?)", r"\(([^)]+)\)$"
WHOLE = "전문"


def articles(text: Column, keep_empty: bool = False, whole_limit: int | None = 4000) -> Column:
    """array<struct<number,title,content>> of a text's articles in order.

    keep_empty keeps headings without a body. Without any heading: one entry `전문` with the first whole_limit characters, or
    no entry where whole_limit is None. The title keeps its brackets; without one it is empty.
    """
    heads = F.regexp_extract_all(text, F.lit(HEADING), F.lit(1))
    bodies = F.slice(F.split(text, HEADING), 2, F.greatest(F.size(heads), F.lit(1)))
    entries = F.zip_with(heads, bodies, lambda h, b: F.struct(
        F.regexp_extract(h, NUMBER, 1).alias("number"), F.regexp_extract(h, r"(\([^)]+\))$", 1).alias("title"), strip(F.coalesce(b, F.lit(""))).alias("content")))
    entries = entries if keep_empty else F.filter(entries, lambda e: e["content"] != "")
    none = F.array().cast("array<struct<number:string,title:string,content:string>>")
    whole = F.array(F.struct(F.lit(WHOLE).alias("number"), F.lit("").alias("title"), F.substring(strip(text), 1, whole_limit).alias("content"))) if whole_limit is not None else none
    return F.when(F.size(heads) > 0, entries).otherwise(whole)


def chunks(files: DataFrame, ingested_at: str, limit: int = 8000) -> DataFrame:
    """One row for each article of files (folder, kind, path, text): doc_id, metadata columns and the document with its head.

    Identifiers are number_folder_kind_article; a repeated article gets _2, _3 ... in the order of the file. A file without an
    identifier in its front matter takes a checksum of its folder, the same in every run. Null text gives no row.
    """
    rows = files.where("text is not null").withColumn("meta", frontmatter(F.col("text")))
    given = F.coalesce(F.col("meta")["법령ID"], F.lit(""))
    rows = rows.select(
        "folder", "kind", "path",
        F.when(given != "", given).otherwise(F.concat(F.lit("folder_"), F.lpad(F.lower(F.hex(F.crc32("folder") % (1 << 24))), 6, "0"))).alias("law_id"),
        F.coalesce(F.col("meta")["제목"], F.col("folder")).alias("law_name"),
        F.translate(F.coalesce(F.col("meta")["시행일자"], F.lit("")), "-", "").alias("enforcement_date"),
        F.posexplode(articles(F.col("text"))).alias("position", "part"),
    )
    slug = F.translate(F.substring("folder", 1, 20), " ", "_")
    base = F.concat_ws("_", "law_id", slug, "kind", "part.number")
    again = F.row_number().over(Window.partitionBy("path", "base").orderBy("position"))
    rows = rows.withColumn("base", base).withColumn("again", again)
    title = F.when(F.col("part.title") != "", F.concat(F.lit(" "), F.col("part.title"))).otherwise("")
    head = F.concat(F.lit("["), F.col("law_name"), F.lit(" "), F.col("part.number"), title, F.lit("] "))
    return rows.select(
        F.when(F.col("again") > 1, F.concat_ws("_", "base", F.col("again").cast("string"))).otherwise(F.col("base")).alias("doc_id"),
        "law_id", "law_name", F.col("folder").alias("law_folder"), F.col("kind").alias("file_type"), F.col("part.number").alias("article"), F.col("part.title").alias("article_title"),
        F.col("path").alias("source_file"), "enforcement_date", F.lit(ingested_at).alias("ingested_at"), F.substring(F.concat(head, F.col("part.content")), 1, limit).alias("document"),
    )
