"""Pixel-wise scene operators: normalisation, masks, classes, materials.

A scene is a table of pixels: row, col, dem, dsm, tree, lc, and a tile or scene key where
there are several.  All are column expressions; only the domain statistics aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Land-cover classes: name, code, albedo, emissivity, TgK, Tstart, time of maximum.
LAND_COVER = [
    ("Roofs(buildings)", 2, 0.18, 0.95, 0.58, -9.78, 15.0),
    ("Dark_asphalt", 1, 0.18, 0.95, 0.58, -9.78, 15.0),
    ("Cobble_stone_2014a", 0, 0.20, 0.95, 0.37, -3.41, 15.0),
    ("Water", 7, 0.05, 0.98, 0.00, 0.00, 12.0),
    ("Grass_unmanaged", 5, 0.16, 0.94, 0.21, -3.38, 14.0),
    ("bare_soil", 6, 0.25, 0.94, 0.33, -3.01, 14.0),
    ("Walls", 99, 0.20, 0.90, 0.58, -3.41, 15.0),
]

# Land-cover codes of the world map by our class.
WORLD_COVER = {10: 4, 20: 3, 30: 5, 40: 5, 50: 1, 60: 6, 70: 6, 80: 7, 90: 5, 95: 3, 100: 6}


def normalize(df: DataFrame, trunk_ratio: float = 0.25) -> DataFrame:
    """Elevations of canopy and trunk tops over the surface model, 0 where no tree stands.

    Adds tree (clamped at 0), canopy, trunk, and bush: the height above the datum where that
    of canopy or trunk is 0.
    """
    tree = F.greatest(F.col("tree"), F.lit(0.0))
    height, low = tree + F.col("dem"), tree * trunk_ratio + F.col("dem")
    over = lambda x: F.when(x + F.col("dsm") == F.col("dsm"), 0.0).otherwise(x + F.col("dsm"))
    return df.withColumns({"tree": tree, "canopy": over(tree), "trunk": over(tree * trunk_ratio), "bush": F.when(height * low == 0, height).otherwise(0.0)})


def building_mask(df: DataFrame, least: float = 2.0) -> DataFrame:
    """buildings: 1 on the ground (height below ``least``), 0 on buildings; valid: not a building."""
    ground = (F.col("dsm") - F.col("dem")) < least
    return df.withColumns({"buildings": F.when(ground, 1.0).otherwise(0.0), "valid": ground})


def land_cover_class(code: Column) -> Column:
    """Classes outside 1..7 become bare soil (6); 3 and 4 become grass (5)."""
    return F.when((code < 1) | (code > 7) | code.isNull(), 6).when(code.isin(3, 4), 5).otherwise(code).cast("int")


def world_cover_class(code: Column, height: Column) -> Column:
    """Map codes to classes; buildings (height above 1 m) are class 2."""
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in WORLD_COVER.items() for x in kv]), code)
    return F.when(height > 1, 2).otherwise(F.coalesce(mapped, F.lit(0))).cast("int")


def land_cover_table(spark, rows=LAND_COVER) -> DataFrame:
    return spark.createDataFrame(rows, "name string, code int, albedo double, emissivity double, tgk double, tstart double, tmaxlst double")


def materials(df: DataFrame, table: DataFrame, code: str = "lc") -> DataFrame:
    """Join material properties by class; the class table is a dimension of a few rows.

    Unknown classes keep null properties.
    """
    t = F.broadcast(table.select(F.col("code").alias(code), "albedo", "emissivity", "tgk", "tstart", "tmaxlst"))
    return df.join(t, code, "left")


def domain_maximum(df: DataFrame) -> DataFrame:
    """One row: the highest of the surface model and of trees over the ground."""
    return df.agg(F.greatest(F.max("dsm"), F.max(F.col("tree") + F.col("dem"))).alias("amax"))


def lower_median(df: DataFrame, value: str = "dem", floor: float = 3.0) -> DataFrame:
    """One row: the lower median, NaN if any value is NaN; a positive one is replaced by ``floor``."""
    out = df.agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("m"), F.bool_or(F.isnan(value)).alias("bad"))
    m = F.when(F.col("bad"), F.lit(float("nan"))).otherwise(F.col("m"))
    return out.select(m.cast("double").alias("median"), F.when(F.col("bad"), m).when(F.col("m") > 0, F.lit(floor)).otherwise(m).cast("double").alias("altitude"))


def mask_invalid(value: Column, valid: Column) -> Column:
    return F.when(valid, value).otherwise(F.lit(float("nan")))


def transmissivity(doy: Column) -> Column:
    """Canopy transmissivity: leaves are on for 97 < day < 300."""
    return F.when((doy > 97) & (doy < 300), 0.03).otherwise(0.5)


def sky_terms(df: DataFrame) -> DataFrame:
    """svfbuveg, asvf and svfalfa from svf and svfveg; the logarithm's argument is guarded."""
    combined = F.col("svf") + F.col("svfveg") - 1
    rest = F.greatest(1 - F.greatest(combined, F.lit(0.0)), F.lit(0.0))
    return df.withColumns({
        "svfbuveg": F.col("svf") - (1 - F.col("svfveg")) * (1 - 0.03),
        "asvf": F.acos(F.sqrt(F.greatest(F.least(F.col("svf"), F.lit(1.0)), F.lit(0.0)))),
        "svfalfa": F.when(rest > 0, F.asin(F.sqrt(rest))).otherwise(0.0),
    })


def paint_trees(scene: DataFrame, trees: DataFrame, rise: float = 1.0, value: str = "tree") -> DataFrame:
    """Paint discs of trees (row, col, height, crown_radius) over a canopy raster.

    Each tree is exploded to the rows its crown spans, so the join to pixels is an equality on
    row with a range on col, and the trees' side is aggregated before it meets the raster.
    """
    r = F.col("crown_radius") / rise
    span = lambda x: F.explode(F.sequence(F.floor(x - r).cast("int") - 1, F.ceil(x + r).cast("int")))
    discs = trees.withColumns({"tr": F.col("row"), "tc": F.col("col"), "r": r}).withColumn("row", span(F.col("tr"))).withColumn("col", span(F.col("tc")))
    inside = F.pow(F.col("row") - F.col("tr") + 0.5, F.lit(2.0)) + F.pow(F.col("col") - F.col("tc") + 0.5, F.lit(2.0)) <= F.col("r") * F.col("r")
    best = discs.filter(inside).groupBy("row", "col").agg(F.max("height").alias("painted"))
    return scene.join(best, ["row", "col"], "left").withColumn(value, F.greatest(F.col(value), F.coalesce("painted", F.lit(0.0)))).drop("painted")


def difference(scenario: DataFrame, baseline: DataFrame, keys: list[str], value: str, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Per group of ``by``: mean, least and greatest of scenario - baseline, and changed pixels.  NaN is skipped."""
    both = scenario.select(*keys, F.col(value).alias("s")).join(baseline.select(*keys, F.col(value).alias("b")), keys)
    d = F.nanvl(F.col("s") - F.col("b"), F.lit(None))
    return both.withColumn("d", d).groupBy(*by).agg(F.avg("d").alias("mean"), F.min("d").alias("min"), F.max("d").alias("max"), F.count_if(F.abs("d") > threshold).alias("changed"))


def hourly_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, least and greatest per group, skipping NaN."""
    v = F.nanvl(F.col(value), F.lit(None))
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))


def place_buildings(df: DataFrame, height: str = "height", least: float = 1.0) -> DataFrame:
    """Trees make way for buildings above ``least``; dsm becomes the terrain plus the buildings."""
    return df.withColumns({"tree": F.when(F.col(height) > least, 0.0).otherwise(F.col("tree")), "dsm": F.col("dem") + F.col(height)})
