"""Running tile kernels over many tiles: pixels are gathered per tile, as blocks of arrays.

A tile is a logical unit of a bounded size (see ``grid.tiles``), so a group is bounded too.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .rays import COUNTS

SVF_FIELDS = [n + q for n in ("svf", "svfveg", "svfaveg") for q in ("", "E", "S", "W", "N")]


def to_array(table: pa.Table, value: str, fill: float = 0.0) -> np.ndarray:
    row, col = table["row"].to_numpy(), table["col"].to_numpy()
    out = np.full((row.max() + 1, col.max() + 1), fill)
    out[row, col] = table[value].to_numpy()
    return out


def map_tiles(df: DataFrame, kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], inputs: list[str], outputs: list[str], key: str = "tile") -> DataFrame:
    """Apply an array kernel per tile; rows and columns count from each tile's corner.

    Returns key, row, col and the outputs at the tile's pixels.
    """

    def run(group: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        made = kernel({n: to_array(table, n) for n in inputs})
        row, col = table["row"].to_numpy(), table["col"].to_numpy()
        return pa.table({key: table[key], "row": table["row"], "col": table["col"], **{n: pa.array(np.asarray(made[n], np.float64)[row, col]) for n in outputs}})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "row", "col", *inputs).groupBy(key).applyInArrow(run, f"{key} {kind}, row int, col int, " + ", ".join(f"{n} double" for n in outputs))


def sky_view_factors(df: DataFrame, key: str = "tile", option: int = 2, scale: float = 1.0, chunks: int = 8) -> DataFrame:
    """The 15 sky-view fields and svftotal of every pixel.

    Tiles are multiplied by chunks of patches: each (tile, chunk) is a task's unit, and the
    partial sums, which add up, are aggregated per pixel.
    """
    total = sum(COUNTS[option])
    inputs = ["dsm", "dem", "tree"]

    def partial(group: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dsm, dem, tree = (to_array(table, n) for n in inputs)
        canopy, trunk, bush, amax = vegetation(dsm, dem, tree)
        k = group[1].as_py()
        made = kernels.sky_view(dsm, canopy, trunk, bush, amax, option, scale, range(k, total, chunks))
        row, col = table["row"].to_numpy(), table["col"].to_numpy()
        return pa.table({key: table[key], "row": table["row"], "col": table["col"], "trunk": pa.array(trunk[row, col]), **{n: pa.array(made[n][row, col]) for n in SVF_FIELDS}})

    kind = df.schema[key].dataType.simpleString()
    dealt = df.select(key, "row", "col", *[F.col(c).cast("double").alias(c) for c in inputs], F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    parts = dealt.groupBy(key, "chunk").applyInArrow(partial, f"{key} {kind}, row int, col int, trunk double, " + ", ".join(f"{n} double" for n in SVF_FIELDS))
    sums = parts.groupBy(key, "row", "col").agg(F.first("trunk").alias("trunk"), *[F.sum(n).alias(n) for n in SVF_FIELDS])

    def closed(n: str):
        tail = kernels.TAIL if n.endswith(("S", "W")) else 0.0
        if not n.startswith("svf" + n[-1]) and tail:
            return F.least(F.col(n) + F.when(F.col("trunk") == 0, tail).otherwise(0.0), F.lit(1.0)).alias(n)
        return F.least(F.col(n) + tail, F.lit(1.0)).alias(n)

    out = sums.select(key, "row", "col", *[closed(n) for n in SVF_FIELDS])
    return out.withColumn("svftotal", F.col("svf") - (1 - F.col("svfveg")) * (1 - kernels.TRANSMISSIVITY))


def vegetation(dsm: np.ndarray, dem: np.ndarray, tree: np.ndarray, ratio: float = 0.25):
    """(canopy, trunk, bush, amax) of a tile, as ``scene.normalize`` has them."""
    tree = np.maximum(tree, 0)
    over = lambda h: np.where(h + dsm == dsm, 0.0, h + dsm)
    height, low = tree + dem, tree * ratio + dem
    return over(tree), over(tree * ratio), np.where(height * low == 0, height, 0.0), float(max(dsm.max(), height.max()))


def wall_aspects(df: DataFrame, key: str = "tile", scale: float = 1.0) -> DataFrame:
    """Aspect (degrees) of wall pixels; inputs wall and dsm."""
    return map_tiles(df, lambda a: {"aspect": kernels.goodwin_aspect(a["wall"], a["dsm"], scale)}, ["wall", "dsm"], ["aspect"], key)


def wake_coefficients(df: DataFrame, directions: list[int], key: str = "tile", pixel: float = 1.0) -> DataFrame:
    """Directional wind coefficients of every pixel: one (tile, direction) is a task's unit."""

    def run(group: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        out = kernels.building_wake(to_array(table, "h"), float(group[1].as_py()), pixel)
        row, col = table["row"].to_numpy(), table["col"].to_numpy()
        return pa.table({key: table[key], "dir": table["dir"], "row": table["row"], "col": table["col"], "coef": pa.array(out[row, col])})

    kind = df.schema[key].dataType.simpleString()
    dealt = df.select(key, "row", "col", F.col("h").cast("double").alias("h"), F.explode(F.array(*map(F.lit, directions))).alias("dir"))
    return dealt.groupBy(key, "dir").applyInArrow(run, f"{key} {kind}, dir int, row int, col int, coef double")


def wind_coefficients(df: DataFrame, directions: list[int], key: str = "tile", pixel: float = 1.0, z0_ref: float = 0.03, least: float = 0.1, most: float = 1.0) -> DataFrame:
    """Directional wind coefficients of buildings (h) and trees (tree), smoothed; NaN on buildings."""

    def run(group: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        out = kernels.wind_coefficient(to_array(table, "h"), to_array(table, "tree"), float(group[1].as_py()), pixel, z0_ref, least, most)
        row, col = table["row"].to_numpy(), table["col"].to_numpy()
        return pa.table({key: table[key], "dir": table["dir"], "row": table["row"], "col": table["col"], "coef": pa.array(out[row, col])})

    kind = df.schema[key].dataType.simpleString()
    dealt = df.select(key, "row", "col", *[F.col(c).cast("double").alias(c) for c in ("h", "tree")], F.explode(F.array(*map(F.lit, directions))).alias("dir"))
    return dealt.groupBy(key, "dir").applyInArrow(run, f"{key} {kind}, dir int, row int, col int, coef double")
