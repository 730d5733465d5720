"""Finding input files.  Listings are tables; contents are not read."""

from __future__ import annotations

from fnmatch import translate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIRECTIONS = tuple(range(0, 360, 30))
WIND_NAME = r"WindCoeff_dir(\d{3})\.tif$"


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and name of the files of a folder, of a glob or of one file, whose names match ``pattern``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


def wind_rasters(files: DataFrame) -> DataFrame:
    """name, path and direction of the wind rasters of a listing.

    If any name holds a direction, only such files count, and all twelve directions are needed.
    If none does, all files of the listing are given, with a null direction.
    """
    found = files.withColumn("direction", F.when(F.col("name").rlike(WIND_NAME), F.regexp_extract("name", WIND_NAME, 1).cast("int")))
    have = {r["direction"] for r in found.select("direction").distinct().limit(1001).collect()}  # three digits, or none
    if not have:
        raise FileNotFoundError("no wind coefficient files")
    if have == {None}:
        return found
    if missing := [d for d in DIRECTIONS if d not in have]:
        raise FileNotFoundError("missing wind coefficients: " + ", ".join(f"WindCoeff_dir{d:03d}.tif" for d in missing))
    return found.filter("direction IS NOT NULL")


def _whole(pattern: str) -> str:
    """A glob pattern as a regular expression of whole names."""
    return "^" + translate(pattern).removesuffix("\\Z").removesuffix("\\z") + "$"


def first_match(files: DataFrame, patterns: list[str]) -> str | None:
    """The path that matches the earliest of the ``patterns``, of several the first by name; None if there is none."""
    rank = F.coalesce(*[F.when(F.col("name").rlike(_whole(p)), F.lit(i)) for i, p in enumerate(patterns)])
    return files.withColumn("rank", rank).filter("rank IS NOT NULL").agg(F.min_by("path", F.struct("rank", "name"))).first()[0]
