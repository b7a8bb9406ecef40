"""Reports on retrieval and answers: hit rates, sweeps, multi-level averages, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strict_hit(name: Column, text: Column, wanted_name: Column, keywords: Column) -> Column:
    """The wanted name (or one that starts with it and a blank), and all keywords in the text."""
    named = (name == wanted_name) | name.startswith(F.concat(wanted_name, F.lit(" ")))
    return F.coalesce(named & F.forall(keywords, lambda k: F.coalesce(text, F.lit("")).contains(k)), F.lit(False))


def loose_hit(text: Column, keywords: Column) -> Column:
    """Any keyword in the text."""
    return F.coalesce(F.exists(keywords, lambda k: text.contains(k)), F.lit(False))


def hits_at(ranked: DataFrame, queries: DataFrame, hit: str, cuts: list[int], query_id: str = "query_id") -> DataFrame:
    """(query_id, hit_at_1 ...): whether a hit stands among the first rows; queries without rows have none."""
    found = ranked.groupBy(query_id).agg(*[F.max(F.when(F.col("rank") < k, F.col(hit)).otherwise(False)).alias(f"hit_at_{k}") for k in cuts])
    return queries.select(query_id).join(found, query_id, "left").na.fill(False)


def rate_by_mode(results: DataFrame, mode: str = "mode") -> DataFrame:
    """(mode, n, hits_at_1, hits_at_3, mean_latency)."""
    return results.groupBy(mode).agg(F.count("*").alias("n"), F.count_if("hit_at_1").alias("hits_at_1"), F.count_if("hit_at_3").alias("hits_at_3"), F.avg("latency_ms").alias("mean_latency"))


def averages(scores: DataFrame, groups: list[str], values: list[str], places: int = 2) -> DataFrame:
    """Means of the values over each single group column and over all rows, in one pass of grouping sets.

    Columns of the other groups are null; `level` names the column a row is for, or `all`. Every mean is over rows.
    """
    sets = [[F.col(g)] for g in groups] + [[]]
    named = F.coalesce(*[F.when(F.grouping(g) == 0, F.lit(g)) for g in groups], F.lit("all"))
    return scores.groupingSets(sets, *groups).agg(named.alias("level"), F.count("*").alias("n"), *[F.round(F.avg(v), places).alias(v) for v in values])


def ledger(calls: DataFrame, by: str, sums: list[str]) -> DataFrame:
    """(by, calls, sums...)."""
    return calls.groupBy(by).agg(F.count("*").alias("calls"), *[F.sum(s).alias(s) for s in sums])


def sums_where(rows: DataFrame, value: Column, conditions: dict[str, Column]) -> DataFrame:
    """One row: a sum for each named condition."""
    return rows.agg(*[F.coalesce(F.sum(F.when(c, value)), F.lit(0)).alias(n) for n, c in conditions.items()])


def floor_average(total: Column, count: Column) -> Column:
    """The whole part of a mean, rounded down; 0 for a count of 0."""
    return F.when(count > 0, F.floor(total / count)).otherwise(0).cast("long")


def all_ok(checks: DataFrame, ok: str = "ok") -> DataFrame:
    """One row: whether every check holds; null is a check that doesn't, and without checks all do."""
    return checks.agg(F.coalesce(F.every(F.coalesce(F.col(ok), F.lit(False))), F.lit(True)).alias("ok"))


def smallest_enough(rows: DataFrame, parameter: str, measure: str, least: float, default: float) -> DataFrame:
    """One row: the smallest parameter whose measure comes to `least`, or the default."""
    return rows.agg(F.coalesce(F.min(F.when(F.col(measure) >= least, F.col(parameter))), F.lit(default)).alias(parameter))


def compared(questions: DataFrame, one: DataFrame, two: DataFrame, scores: DataFrame, key: str, names: tuple[str, str] = ("one", "two")) -> DataFrame:
    """questions with the answers of two systems and the scores of both by key; what is missing is null. Columns get the systems' names before them."""
    out = questions
    for name, table in zip(names, (one, two)):
        out = out.join(table.select(key, *[F.col(c).alias(f"{name}_{c}") for c in table.columns if c != key]), key, "left")
    return out.join(scores, key, "left")


def best(rows: DataFrame, parameter: str, *measures: str) -> DataFrame:
    """The parameter with the largest measures, compared in turn; of equal ones the smallest parameter."""
    return rows.orderBy(*[F.desc(m) for m in measures], parameter).limit(1).select(parameter, *measures)


def answered(questions: DataFrame, answers: DataFrame, key: str, answer: str, default: str = "(missing)") -> DataFrame:
    """questions with their answers, or the default."""
    return questions.join(answers, key, "left").withColumn(answer, F.coalesce(answer, F.lit(default)))


def first_per_group(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def distribution(rows: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(column, n), most frequent first; the `top` first of them if given."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return counts.limit(top) if top is not None else counts
