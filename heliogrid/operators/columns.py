"""Adding named expressions to a DataFrame, and to a SQL text alike."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_columns(df: DataFrame, named: Iterable[tuple[str, str]]) -> DataFrame:
    """Add expressions one after another; each may use the ones before."""
    for name, text in named:
        df = df.withColumn(name, F.expr(text))
    return df


def sql_columns(source: str, named: Iterable[tuple[str, str]]) -> str:
    """The same as nested SELECTs over a table or subquery."""
    for name, text in named:
        source = f"(SELECT *, {text} AS {name} FROM {source})"
    return source
