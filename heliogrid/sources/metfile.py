"""Own-met text files: white-space separated, one header line, positional columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a met file, by position.
COLUMNS = ["iy", "id", "it", "imin", "Q", "QH", "QE", "Qs", "Qf", "Wind", "RH", "Td", "press", "rain", "Kdn", "snow", "ldown", "fcld", "wuh", "xsmd", "lai_hr", "Kdiff", "Kdir", "Wd", "uhii"]
INTEGERS = ("iy", "id", "it", "imin")
MISSING = -999.0
FORMAT = "%d %d %d %d " + " ".join(["%.2f"] * 5) + " %.5f %.2f %.2f %.2f %.2f %.2f " + " ".join(["%.2f"] * 9) + " %.2f"


def parse(lines: DataFrame, line: str = "value", keep: list[str] = ()) -> DataFrame:
    """Parse text lines by position.  Columns that a line lacks are null; n_fields counts those it has."""
    parts = F.split(F.trim(line), r"\s+")
    at = lambda i: F.try_element_at(F.col("p_"), F.lit(i + 1))
    typed = [at(i).cast("int" if c in INTEGERS else "double").alias(c) for i, c in enumerate(COLUMNS)]
    return lines.select(*keep, parts.alias("p_")).select(*keep, *typed, F.size("p_").alias("n_fields"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Read met files, each with one header line (recognised by its position in the file), adding file."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "value"))
    return parse(raw.filter((F.col("n") > 0) & (F.trim("value") != "")), keep=["file", "n"])


def validate(df: DataFrame) -> DataFrame:
    """The rows, or an error if there is fewer than two in a file."""
    counts = df.groupBy("file").agg(F.count(F.lit(1)).alias("rows")).filter("rows < 2")
    if counts.limit(1).count():
        raise ValueError("a met file needs two rows at least")
    return df


def missing(value: Column) -> Column:
    return value <= MISSING


def format_line(columns: list[str] = COLUMNS[:24]) -> Column:
    """A row as a line of fixed print formats."""
    spec = " ".join("%d" if c in INTEGERS else "%.5f" if c == "Wind" else "%.2f" for c in columns)
    return F.format_string(spec, *[F.coalesce(F.col(c), F.lit(-999)).cast("int") if c in INTEGERS else F.coalesce(F.col(c), F.lit(MISSING)).cast("double") for c in columns])


def write(df: DataFrame, path: str, columns: list[str] = COLUMNS[:24]) -> None:
    """One text file of lines in time order, with the header."""
    header = df.sparkSession.createDataFrame([(" ".join(columns),)], "value string")
    body = df.orderBy("iy", "id", "it", "imin").select(format_line(columns).alias("value"))
    header.union(body).coalesce(1).write.mode("overwrite").text(path)


def for_tiles(met: DataFrame, tiles: DataFrame) -> DataFrame:
    """The met table once per tile; a met table is a timeline of bounded length."""
    return tiles.select("tile").distinct().join(F.broadcast(met), F.lit(True))
