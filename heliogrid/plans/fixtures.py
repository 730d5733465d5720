"""Deterministic scenes and facts derived from the star-schema tables, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SCENE = """(SELECT CAST(floor(p_partkey / 50) AS INTEGER) AS row, CAST(p_partkey % 50 AS INTEGER) AS col,
 CAST((p_partkey * 7) % 5 AS DOUBLE) AS dem,
 CAST((p_partkey * 7) % 5 + CASE WHEN p_size > 35 THEN p_size ELSE 0 END AS DOUBLE) AS dsm,
 CAST(CASE WHEN p_size BETWEEN 10 AND 14 THEN p_size WHEN p_size = 9 THEN -1 ELSE 0 END AS DOUBLE) AS tree,
 CAST(p_size % 10 AS INTEGER) AS lc FROM part)"""

FACTS = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity - 5e0 AS ta, 20e0 + 600e0 * l_discount AS rh,
 0.5e0 + 100e0 * l_tax AS va, l_quantity - 5e0 + 20e0 * (l_linenumber - 1) / 6e0 AS tmrt,
 95000e0 + 10e0 * (l_suppkey % 1000) AS press FROM lineitem)"""


def _view(spark: SparkSession, sf_dir: str, name: str, text: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {text.replace('FROM ' + name, 'FROM {t}')}", t=table(spark, sf_dir, name))


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a scene 50 wide, from part."""
    return _view(spark, sf_dir, "part", SCENE)


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, for work that costs much a row; a file of few row groups is a scan of few tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather at pixels and times, from lineitem: ta, rh, va, tmrt, press."""
    return spread(_view(spark, sf_dir, "lineitem", FACTS))


HOURLY = """(SELECT date_trunc('hour', ts) AS hour, CAST(user_id % 8 AS INTEGER) AS cell, avg(value) AS v, max(value) AS vmax, count(*) AS n
 FROM events GROUP BY date_trunc('hour', ts), CAST(user_id % 8 AS INTEGER))"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means per grid cell, from events."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), (F.col("user_id") % 8).cast("int").alias("cell")).agg(F.avg("value").alias("v"), F.max("value").alias("vmax"), F.count(F.lit(1)).alias("n"))


def rounded(df: DataFrame, digits: int = 6, **only: int) -> DataFrame:
    """Round the double columns, so that engines whose libraries differ in the last bit agree."""
    return df.select(*[F.round(f.name, only.get(f.name, digits)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])
