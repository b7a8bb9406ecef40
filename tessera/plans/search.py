"""The whole retrieval plan for a table of queries: vectors and BM25, fusion, boost, order, citations and verdicts, in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import bm25, fusion

PULL, TOP = 20, 5


def fused_hits(queries: DataFrame, docs: DataFrame, vector_hits: DataFrame, index: bm25.Index | None = None, equal: tuple[str, str] | None = None, k: float = fusion.RRF_K, key: str = "doc_id") -> DataFrame:
    """(query_id, key, score, rank): the PULL best of the vectors' and BM25's lists together.

    equal: a facet of the documents and a column of queries, the name that filters; where it leaves BM25 fewer than five, documents
    without it follow. Null, for queries without a name, is no filter.
    """
    index = index or bm25.build(docs, key, facets=[equal[0]] if equal else [])
    lexical = bm25.top(queries, index, PULL)
    if equal is not None:
        lexical = bm25.with_fallback(bm25.top(queries, index, PULL, equal=equal), lexical, key=key)
    return fusion.reciprocal_ranks(vector_hits, lexical, PULL, k, key)


def boosted_hits(hits: DataFrame, queries: DataFrame, docs: DataFrame, matches: Column, boost: float | Column = fusion.BOOST, key: str = "doc_id") -> DataFrame:
    """hits in the order of their scores, raised where `matches`, a boolean over columns of queries and docs, holds."""
    extra = [c for c in docs.columns if c not in (key, "text")]
    joined = hits.join(docs.select(key, *extra), key).join(queries.drop("query"), "query_id")
    return fusion.boosted(joined, F.coalesce(matches, F.lit(False)), boost, key=key).select("query_id", key, "score", "rank")


def hybrid(queries: DataFrame, docs: DataFrame, vector_hits: DataFrame, matches: Column | None = None, orders: DataFrame | None = None, top: int = TOP, candidates: int = TOP, k: float = fusion.RRF_K, boost: float = fusion.BOOST, key: str = "doc_id", index: bm25.Index | None = None, equal: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, key, score, rank): the `top` documents of each query.

    queries: query_id, query and whatever `matches` uses (a boolean over columns of queries and docs that earns the boost).
    vector_hits: (query_id, key, rank) by any vector search, filtered by a keyword or not. orders: (query_id, order) from a reranker;
    none keeps the order. equal: see `fused_hits`.
    """
    hits = fused_hits(queries, docs, vector_hits, index, equal, k, key)
    if matches is not None:
        hits = boosted_hits(hits, queries, docs, matches, boost, key)
    if orders is not None:
        return fusion.permuted(hits, orders, top, candidates)
    return hits.where(F.col("rank") < min(top, candidates))


def boost_sweep(hits: DataFrame, queries: DataFrame, docs: DataFrame, matches: Column, boosts: list[float], top: int = TOP, key: str = "doc_id") -> DataFrame:
    """(boost, query_id, key, score, rank) for every boost: fused hits meet queries and documents once, then all boosts order them in one plan."""
    extra = [c for c in docs.columns if c not in (key, "text")]
    joined = hits.join(docs.select(key, *extra), key).join(queries.drop("query"), "query_id").withColumn("boost", F.explode(F.array(*[F.lit(float(b)) for b in boosts])))
    raised = joined.withColumn("score", F.col("score") + F.when(F.coalesce(matches, F.lit(False)), F.col("boost")).otherwise(0.0))
    order = Window.partitionBy("boost", "query_id").orderBy(F.desc(F.round("score", 12)), "rank", key)
    return raised.withColumn("new", F.row_number().over(order)).where(F.col("new") <= top).select("boost", "query_id", key, "score", (F.col("new") - 1).alias("rank"))


def law_texts(hits: DataFrame, docs: DataFrame, articles: DataFrame, most: int = 12, characters: int = 1000, key: str = "doc_id") -> DataFrame:
    """(query_id, name, article, content): the first articles of the laws that a query's hits name, each law once, by its first hit.

    hits: query_id, key, rank. docs: key, name, folder and text of what was hit. articles: folder, law, position, article, content of
    whole laws. A law without articles gives the hit's own text as `전문`; so does a hit without a name, as unnamed_<number>, where
    the number counts the laws before it.
    """
    named = hits.join(docs.select(key, "name", "folder", "text"), key).withColumn("bare", F.coalesce("name", F.lit("")) == "")
    own = F.row_number().over(Window.partitionBy("query_id", F.when(F.col("bare"), F.col(key).cast("string")).otherwise(F.col("name")), "bare").orderBy("rank"))
    first = named.withColumn("own", own).where("own = 1")
    number = (F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1).cast("string")
    first = first.withColumn("law_name", F.when(F.col("bare"), F.concat(F.lit("unnamed_"), number)).otherwise(F.col("name")))
    first = first.withColumn("from_folder", F.when(~F.col("bare"), F.coalesce(F.nullif("folder", F.lit("")), F.col("name"))))
    heads = articles.where(F.col("position") < most).select(F.col("folder").alias("from_folder"), "law", "position", "article", F.substring("content", 1, characters).alias("content"))
    joined = first.join(heads, "from_folder", "left")
    return joined.select("query_id", F.coalesce("law", "law_name").alias("name"), F.coalesce("article", F.lit("전문")).alias("article"), F.coalesce("content", F.substring(F.coalesce("text", F.lit("")), 1, characters)).alias("content"))


def sweep(first: DataFrame, second: DataFrame, ks: list[float], top: int = TOP, key: str = "doc_id") -> DataFrame:
    """(k, query_id, key, score, rank) of the fused lists for every constant k, in one plan."""
    found = [fusion.reciprocal_ranks(first, second, top, k, key).withColumn("k", F.lit(float(k))) for k in ks]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def regression(runs: dict[str, DataFrame], queries: DataFrame, docs: DataFrame, hit: Column, cuts: tuple[int, ...] = (1, 3), key: str = "doc_id", query_id: str = "query_id") -> DataFrame:
    """(mode, n, hits_at_1 ...): of all queries, how many have a hit among each mode's first hits (query_id, key, rank from 0).

    hit is a column of a query joined with a document. Queries that a mode finds nothing for count as missed. Only hits within the
    last cut meet their texts, so the documents move no more than once for all modes.
    """
    first = None
    for mode, hits in runs.items():
        rows = hits.where(F.col("rank") < max(cuts)).select(F.lit(mode).alias("mode"), query_id, key, "rank")
        first = rows if first is None else first.unionByName(rows)
    judged = first.join(docs, key).join(queries, query_id).select("mode", query_id, "rank", F.coalesce(hit, F.lit(False)).alias("hit"))
    best = judged.where("hit").groupBy("mode", query_id).agg(F.min("rank").alias("best"))
    asked = queries.select(query_id, F.explode(F.array(*[F.lit(m) for m in runs])).alias("mode"))
    return asked.join(best, ["mode", query_id], "left").groupBy("mode").agg(F.count("*").alias("n"), *[F.count_if(F.col("best") < k).alias(f"hits_at_{k}") for k in cuts])
