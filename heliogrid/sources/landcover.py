"""Land-cover tables as text: white-space separated, one header line, a name and six numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns after the name, by position.
COLUMNS = ("code", "albedo", "emissivity", "tgk", "tstart", "tmaxlst")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The classes of one or more files, in the form of ``scene.land_cover_table``; blank lines are no rows."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    parts = lines.filter((F.col("n") > 0) & (F.trim("line") != "")).select(F.split(F.trim("line"), r"\s+").alias("p"))
    numbers = [F.try_element_at("p", F.lit(i + 2)).cast("double").cast("int" if c == "code" else "double").alias(c) for i, c in enumerate(COLUMNS)]
    return parts.select(F.col("p")[0].alias("name"), *numbers)
