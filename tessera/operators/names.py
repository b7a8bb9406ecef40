"""Recognising names in queries: the first alias that a query holds, and explicit overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Aliases that are sent to all tasks; more are an error.
MOST_ALIASES = 10_000

# What the well-known names are recognised by, in the order in which they are tried, and the names of corpus folders.
ALIASES = {
    "의료법": ["의료법"], "근로기준법": ["근로기준법"], "민법": ["민법"], "형법": ["형법"], "상법": ["상법"], "행정소송법": ["행정소송법"], "행정절차법": ["행정절차법"],
    "국가공무원법": ["국가공무원법"], "소득세법": ["소득세법"], "법인세법": ["법인세법"], "부가가치세법": ["부가가치세법"], "국민건강보험법": ["국민건강보험법"],
    "산업재해보상보험법": ["산업재해보상보험법"], "고용보험법": ["고용보험법"], "국민연금법": ["국민연금법"], "정보통신망법": ["정보통신망법"], "개인정보보호법": ["개인정보보호법"],
    "수소법": ["수소경제", "수소 안전"], "고압가스법": ["고압가스"], "국가계약법": ["국가계약"], "전자조달법": ["전자조달"], "의료기기법": ["의료기기"], "약사법": ["약사"],
    "자본시장법": ["자본시장"], "가사소송법": ["가사소송"], "부동산등기법": ["부동산등기"], "신탁법": ["신탁"], "형사소송법": ["형사소송법", "형소법"],
}
FOLDERS = {
    "uirobub": "의료법", "yaksabub": "약사법", "minbub": "민법", "hyungbub": "형법", "labor": "근로기준법", "jabonsijang": "자본시장법", "suso": "수소법", "gpgas": "고압가스법",
    "가사소송법": "가사소송법", "부동산등기법": "부동산등기법", "신탁법": "신탁법", "상법": "상법", "형사소송법": "형사소송법",
}


def alias_table(spark: SparkSession, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """(name, ordinal, aliases) for `detect` and boosts."""
    return spark.createDataFrame([(n, k, a) for k, (n, a) in enumerate(aliases.items())], "name string, ordinal int, aliases array<string>")


def folder_map(folders: dict[str, str] = FOLDERS) -> Column:
    return F.create_map(*[F.lit(x) for pair in folders.items() for x in pair])


def detect(queries: DataFrame, aliases: DataFrame, text: str = "query", name: str = "name", ordinal: str = "ordinal") -> DataFrame:
    """queries with `detected`: of the names that the text holds as a substring the one with the smallest ordinal, or null.

    The alias table is packed into one sorted array, of MOST_ALIASES names at most.
    """
    packed = aliases.agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(name).alias("n")))).alias("alias_list"))
    packed = packed.withColumn("alias_list", F.when(F.size("alias_list") <= MOST_ALIASES, F.col("alias_list")).otherwise(F.raise_error(F.lit(f"more than {MOST_ALIASES} aliases"))))
    held = F.filter("alias_list", lambda a: F.coalesce(F.col(text).contains(a["n"]), F.lit(False)))
    return queries.crossJoin(F.broadcast(packed)).withColumn("detected", F.get(held, F.lit(0))["n"]).drop("alias_list")


def override(detected: Column, laws: Column, mapping: Column) -> Column:
    """The first of the given names that the map (or its values) knows; else what was detected."""
    known = F.filter(F.transform(laws, lambda x: F.coalesce(F.try_element_at(mapping, x), F.when(F.array_contains(F.map_values(mapping), x), x))), lambda x: x.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), detected)


# Words that make a query one about the constitution.
CONSTITUTION = ["헌법", "헌재", "위헌", "합헌", "헌법불합치", "한정합헌", "한정위헌", "헌법소원", "기본권", "탄핵", "정당해산", "권한쟁의"]


def is_constitutional(query: Column) -> Column:
    """Whether a query should go to the constitutional court's service too; null should not."""
    return holds_any(query, CONSTITUTION)


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether any of the words stands in the text; null text holds none."""
    return F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w)), F.lit(False))
