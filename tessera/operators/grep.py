"""Keyword search in whole texts: AND and OR queries, matching documents, and excerpts of lines in context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.blanks import SPACE, strip

#: Queries that are sent to all tasks at once.
MOST_QUERIES = 10_000
#: What stands for OR, and what a query may hold.
OR_MARK = rf"(?i){SPACE}+(?:OR|또는){SPACE}+|{SPACE}*\|{SPACE}*"
VALID = r"(?U)^[\w\s가-힣\-|]{1,200}$"


def parse(query: Column) -> Column:
    """struct<cleaned,mode,keywords,error>: OR markers become blanks; an invalid query has an error and no keywords."""
    either = query.rlike(OR_MARK)
    cleaned = strip(F.when(either, F.regexp_replace(query, OR_MARK, " ")).otherwise(query))
    valid = F.coalesce(query.rlike(VALID), F.lit(False))
    words = F.filter(F.split(cleaned, f"{SPACE}+"), lambda w: w != "")
    return F.struct(cleaned.alias("cleaned"), F.when(either, "OR").otherwise("AND").alias("mode"), F.when(valid, words).otherwise(F.array().cast("array<string>")).alias("keywords"), F.when(~valid, "invalid query").alias("error"))


def matches(text: Column, keywords: Column, mode: Column) -> Column:
    """Whether all keywords (AND) or any (OR) stand in the text, upper and lower case alike; no keywords match nothing."""
    return _holds(F.lower(F.coalesce(text, F.lit(""))), F.transform(keywords, lambda k: F.lower(k)), mode)


def _holds(low: Column, keywords: Column, mode: Column) -> Column:
    """`matches` of what is in lower case already."""
    holds = lambda k: low.contains(k)
    return (F.size(keywords) > 0) & F.when(mode == "OR", F.exists(keywords, holds)).otherwise(F.forall(keywords, holds))


def search(docs: DataFrame, queries: DataFrame, limit: int, key: str = "doc_id", text: str = "text", query_id: str = "query_id", folder: str | None = None) -> DataFrame:
    """(query_id, key, rank): the first `limit` documents by key that match each query (query_id, keywords, mode).

    The queries are a stated set: an array row of MOST_QUERIES at most goes to all tasks, and more queries go in several passes.
    Documents are read once for each pass and made lower case once, and each task keeps `limit` rows of a query before anything
    moves. folder: a column of docs; queries then have `folders`, an array of those that they are held to, null for all. `grams`
    finds the same rows without reading every text.
    """
    count = queries.count()
    passes = 1 if count <= MOST_QUERIES else -(-2 * count // MOST_QUERIES)
    parts = [queries if passes == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(passes)) == p) for p in range(passes)]
    return reduce(DataFrame.unionByName, [_search(docs, p, limit, key, text, query_id, folder) for p in parts])


def _search(docs: DataFrame, queries: DataFrame, limit: int, key: str, text: str, query_id: str, folder: str | None) -> DataFrame:
    scope = F.col("folders") if folder else F.lit(None).cast("array<string>")
    own = F.struct(query_id, F.transform("keywords", lambda k: F.lower(k)).alias("keywords"), "mode", scope.alias("folders"))
    packed = queries.agg(F.collect_list(own).alias("packed"))
    low = docs.select(key, (F.col(folder) if folder else F.lit(None).cast("string")).alias("_folder"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    inside = lambda q: q["folders"].isNull() | F.coalesce(F.array_contains(q["folders"], F.col("_folder")), F.lit(False))
    found = F.filter("packed", lambda q: inside(q) & _holds(F.col("_low"), q["keywords"], q["mode"]))
    hits = low.crossJoin(F.broadcast(packed)).select(key, F.explode(found[query_id]).alias(query_id))
    order = Window.partitionBy(query_id).orderBy(key)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(query_id, key, (F.col("rank") - 1).alias("rank"))


def context(docs: DataFrame, keywords: Column, key: str = "doc_id", text: str = "text", around: int = 2, lines: int = 25, characters: int = 1500, name: Column | None = None) -> DataFrame:
    """(key, excerpt): lines with a keyword and `around` lines on each side, numbered; `--` stands between groups.

    12: marks a line with a keyword, 12- one around it; with a name `name:12:` and `name-12-`. At most `lines` lines and so many characters. Documents without a hit
    have no row. All happens inside a row, in arrays.
    """
    low = lambda x: F.lower(x)
    all_lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    rows = docs.select(key, all_lines.alias("ls"), keywords.alias("ks"), (F.lit("") if name is None else name).alias("name")).withColumn("hit", F.transform("ls", lambda x: F.exists(F.col("ks"), lambda k: low(x).contains(low(k)))))
    rows = rows.where(F.exists("hit", lambda h: h))
    near = F.transform("hit", lambda _, i: F.exists(F.slice("hit", F.greatest(F.lit(1), i + 1 - around), F.least(F.lit(2 * around + 1), i + 1 + around)), lambda h: h))
    rows = rows.withColumn("near", near)
    shown = F.transform("ls", lambda x, i: F.when(F.get("near", i), F.concat(
        F.when((i > 0) & ~F.get("near", i - 1) & F.exists(F.slice("near", 1, i), lambda n: n), "--\n").otherwise(""), F.when(F.col("name") != "", F.concat("name", F.when(F.get("hit", i), ":").otherwise("-"))).otherwise(""), (i + 1).cast("string"), F.when(F.get("hit", i), ":").otherwise("-"), x)))
    text_lines = F.split(F.concat_ws("\n", F.filter(shown, lambda s: s.isNotNull())), "\n")
    return rows.select(key, F.substring(F.concat_ws("\n", F.slice(text_lines, 1, lines)), 1, characters).alias("excerpt"))
