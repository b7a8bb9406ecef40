"""Functions by name: Python code that SQL can call, registered once for a session."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from tessera.operators.trees import _sections


@pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Characters composed (NFC), so that equal looking texts are equal; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@udtf(returnType=T.StructType([T.StructField("line", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("body", T.StringType())]))
class Headings:
    """A text's headings with the text up to the next one, as `trees.headings` has them."""

    def eval(self, text: str):
        marks, bodies = _sections(text or "")
        for (line, level, title), body in zip(marks, bodies):
            yield line, level, title, body


#: Names for SQL, in every session that `register` was called with.
FUNCTIONS: dict[str, Callable] = {"nfc": nfc}
TABLES: dict[str, type] = {"headings_of": Headings}


def add(name: str, function: Callable) -> None:
    """Binds a pandas UDF (or any function that `spark.udf.register` takes) to a name. Something that can't be called is a TypeError."""
    if not callable(function):
        raise TypeError(f"{name} must be a function, not {type(function).__name__}")
    FUNCTIONS[name] = function


def register(spark: SparkSession) -> SparkSession:
    """Makes all names known to the session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    for name, table in TABLES.items():
        spark.udtf.register(name, table)
    return spark


def call(name: str, *columns: Column | str) -> Column:
    """The named function of the columns; ValueError for a name that nothing is bound to."""
    if name not in FUNCTIONS:
        raise ValueError(f"no function {name!r}; known: {', '.join(sorted(FUNCTIONS))}")
    return FUNCTIONS[name](*columns)


def rows(spark: SparkSession, name: str, docs: DataFrame, column: str, *keep: str) -> DataFrame:
    """The columns `keep` of docs beside each row that the named table function makes of the column; ValueError for an unknown name."""
    if name not in TABLES:
        raise ValueError(f"no table function {name!r}; known: {', '.join(sorted(TABLES))}")
    register(spark)
    docs.createOrReplaceTempView("_rows_of")
    return spark.sql(f"SELECT {', '.join(f'd.`{k}`' for k in keep)}, h.* FROM _rows_of d, LATERAL {name}(d.`{column}`) h")
