"""Comparing tables as multisets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """columns and surplus: how many times more often a row occurs in ``a`` than in ``b``, where that is not 0.

    Nulls equal nulls.  Counts are partial before the one shuffle, so repeated rows cost little.
    """
    signed = lambda df, n: df.select(*columns, F.lit(n).cast("long").alias("n_"))
    both = signed(a, 1).unionByName(signed(b, -1))
    return both.groupBy(*columns).agg(F.sum("n_").alias("surplus")).filter("surplus <> 0")
