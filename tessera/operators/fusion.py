"""Ranked lists into one: reciprocal ranks, boosts, given permutations, verdicts and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import article_reference, excerpt, joined_excerpt

RRF_K, BOOST, FULL_SCORE = 60, 0.3, 0.033


def reciprocal_ranks(first: DataFrame, second: DataFrame, top: int = 20, k: float = RRF_K, key: str = "doc_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, key, score, rank): the sum of 1 / (k + rank + 1) over both lists (rank from 0); ties: the first list's order, then the second's."""
    part = lambda rows, n: rows.select(query_id, key, (1 / (F.lit(k) + F.col("rank") + 1)).alias("s"), F.struct(F.lit(n).alias("list"), F.col("rank").alias("at")).alias("place"))
    fused = part(first, 0).unionByName(part(second, 1)).groupBy(query_id, key).agg(F.sum("s").alias("score"), F.min("place").alias("place"))
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 12)), "place", key)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("rank", F.col("rank") - 1).drop("place")


def name_matches(name: Column, folder: Column, wanted: Column, aliases: Column | None = None) -> Column:
    """Whether a document's name or folder is the wanted name, or starts with it and a blank, or one of the aliases stands in its name."""
    start = F.concat(wanted, F.lit(" "))
    found = (folder == wanted) | (name == wanted) | name.startswith(start) | folder.startswith(start)
    return found if aliases is None else found | alias_in_name(name, aliases)


def boosted(hits: DataFrame, matches: Column, amount: float | Column = BOOST, query_id: str = "query_id", key: str = "doc_id") -> DataFrame:
    """hits with amount added to the score where matches holds, in the new order; ties keep the old one."""
    raised = hits.withColumn("score", F.col("score") + F.when(matches, amount).otherwise(0.0))
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 12)), F.col("rank"), key)
    return raised.withColumn("rank", F.row_number().over(order) - 1)


def alias_in_name(name: Column, aliases: Column, least: int = 4) -> Column:
    """Whether any alias of `least` characters or more stands in the name; without aliases none does."""
    return F.exists(aliases, lambda a: (F.length(a) >= least) & F.coalesce(name, F.lit("")).contains(a))


def permuted(hits: DataFrame, orders: DataFrame, top: int, candidates: int, query_id: str = "query_id") -> DataFrame:
    """The first `candidates` hits of each query in a given order: orders has query_id and `order`, array<int> of places from 1.

    Places out of range or repeated don't count; hits without a place follow in their own order; a query without an order keeps
    it. Scores stay with their hits. The first `top` remain, ranked anew from 0.
    """
    clipped = hits.where(F.col("rank") < candidates)
    places = orders.select(query_id, F.posexplode("order").alias("place", "one")).where("one is not null").groupBy(query_id, "one").agg(F.min("place").alias("place"))
    joined = clipped.join(places.select(query_id, (F.col("one") - 1).alias("rank"), "place"), [query_id, "rank"], "left")
    order = Window.partitionBy(query_id).orderBy(F.col("place").asc_nulls_last(), "rank")
    return joined.withColumn("new", F.row_number().over(order)).where(F.col("new") <= top).drop("rank", "place").withColumn("rank", F.col("new") - 1).drop("new")


def confidence(score: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0)) / FULL_SCORE), 3)


def verdict(value: Column) -> Column:
    return F.when(value >= 0.7, "applies").when(value >= 0.4, "ambiguous").otherwise("does_not_apply")


def verdicts(queries: DataFrame, hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query_id, confidence, verdict) by each query's first hit; without hits 0 and does_not_apply."""
    first = hits.where("rank = 0").select(query_id, "score")
    rows = queries.select(query_id).join(first, query_id, "left").withColumn("confidence", confidence(F.col("score")))
    return rows.select(query_id, "confidence", verdict(F.col("confidence")).alias("verdict"))


def fallback_confidence(hits: Column) -> Column:
    """Of a keyword search with so many hits."""
    return F.round(F.when(hits > 0, F.least(F.lit(0.95), 0.6 + 0.04 * hits)).otherwise(0.0), 3)


def fallback(queries: DataFrame, hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query_id, confidence, verdict, citations) of a keyword search: hits has query_id, rank, name, kind and excerpt (lines as found).

    citations: array<struct> in the order of rank, `법령` for a hit without a kind; a query without hits has none, and confidence 0.
    """
    cited = F.struct("rank", F.struct(F.coalesce("name", F.lit("")).alias("law_id"), F.coalesce("name", F.lit("")).alias("law_name"), F.coalesce(F.nullif("kind", F.lit("")), F.lit("법령")).alias("article"), F.lit("").alias("version"), joined_excerpt(F.col("excerpt")).alias("excerpt")).alias("c"))
    each = hits.groupBy(query_id).agg(F.transform(F.array_sort(F.collect_list(cited)), lambda x: x["c"]).alias("citations"))
    rows = queries.select(query_id).join(each, query_id, "left")
    sure = fallback_confidence(F.coalesce(F.size("citations"), F.lit(0)))
    none = F.array().cast(each.schema["citations"].dataType)
    return rows.select(query_id, sure.alias("confidence"), verdict(sure).alias("verdict"), F.coalesce("citations", none).alias("citations"))


def citation(law_id: Column, name: Column, article: Column, date: Column, document: Column, size: int = 400) -> Column:
    """struct<law_id,law_name,article,version,excerpt> of a hit; missing metadata become empty, a missing identifier `unknown`."""
    none = F.lit("")
    return F.struct(
        F.coalesce(law_id, F.lit("unknown")).alias("law_id"), F.coalesce(name, none).alias("law_name"), article_reference(F.coalesce(article, none)).alias("article"),
        F.translate(F.coalesce(date, none), "-", "").alias("version"), excerpt(document, size).alias("excerpt"),
    )
