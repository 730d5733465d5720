"""The public interface: scene and weather in, comfort out.

``thermal_comfort`` runs the whole workflow; its parts are usable on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import grid, scene, simulation, tiles
from .sources import geotiff, metfile

LAYERS = {"dsm": "Building_DSM", "dem": "DEM", "tree": "Trees"}


def read_layer(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The first band of a raster as pixels (row, col, name)."""
    return geotiff.pixels(spark.read.format("geotiff").load(path).filter("band = 1"), name).select("row", "col", F.col(name).cast("double").alias(name))


def check_alignment(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Raster dimensions and geotransforms; an error if they differ."""
    rows = None
    for name, path in paths.items():
        meta = spark.read.format("geotiff").option("metadataOnly", "true").load(path).filter("band = 1").select(F.lit(name).alias("layer"), "rows", "cols", "gt")
        rows = meta if rows is None else rows.union(meta)
    if rows.select("rows", "cols", "gt").distinct().count() != 1:
        raise ValueError("rasters differ in size or position")
    return rows


def build_inputs(spark: SparkSession, folder: str, landcover: bool = False) -> DataFrame:
    """Join the layers of a folder into one scene of pixels."""
    paths = {k: f"{folder}/{v}.tif" for k, v in LAYERS.items()} | ({"lc": f"{folder}/Landcover.tif"} if landcover else {})
    check_alignment(spark, paths)
    out = None
    for name, path in paths.items():
        layer = read_layer(spark, path, name)
        out = layer if out is None else out.join(layer, ["row", "col"])
    return out


def preprocess(pixels: DataFrame, tile_size: int = 1000, overlap: int = 20) -> DataFrame:
    """Cut a scene into overlapping tiles; rows and columns count from each tile's corner."""
    size = pixels.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    dealt = grid.tiles(pixels, tile_size, overlap, size["r"] + 1, size["c"] + 1)
    return dealt.withColumns({"row": (F.col("row") - F.col("tj")).cast("int"), "col": (F.col("col") - F.col("ti")).cast("int")})


def run_walls_aspect(tiled: DataFrame, scale: float = 1.0) -> DataFrame:
    """Wall heights and aspects of every tile: tile, row, col, wall, aspect."""
    walls = grid.wall_heights(tiled, keys=["tile"])
    return walls.select("tile", "row", "col", "wall").join(tiles.wall_aspects(walls, scale=scale), ["tile", "row", "col"])


def calculate_svf(tiled: DataFrame, patch_option: int = 2, scale: float = 1.0) -> DataFrame:
    """Sky-view factors of every tile."""
    return tiles.sky_view_factors(tiled, option=patch_option, scale=scale)


def build_wind_ext_coeff(tiled: DataFrame, pixel: float = 1.0, directions: tuple[int, ...] = tuple(range(0, 360, 30)), z0: float = 0.03, coeff_min: float = 0.1, coeff_max: float = 1.0) -> DataFrame:
    """Directional wind coefficients of every tile: wakes of buildings and trees of 1 m or more, smoothed over two scales."""
    def tall(h):
        return F.when(h >= 1, h).otherwise(0.0)

    heights = tiled.withColumns({"h": tall(F.col("dsm") - F.col("dem")), "tree": tall(F.col("tree"))})
    return tiles.wind_coefficients(heights, list(directions), pixel=pixel, z0_ref=z0, least=coeff_min, most=coeff_max)


def run_utci_tiles(tiled: DataFrame, met: DataFrame, lat: float, lon: float, utc_offset: float = 0.0, outputs: tuple[str, ...] = ("utci",), landcover: bool = False, scale: float = 1.0, coefficients: DataFrame | None = None) -> DataFrame:
    """Simulate the timeline of a met table on every tile, at full wind speed unless coefficients are given."""
    return simulation.simulate(tiled, simulation.weather(met, lat, lon, utc_offset), outputs, landcover=landcover, scale=scale, coefficients=coefficients)


def thermal_comfort(spark: SparkSession, folder: str, met_path: str, lat: float, lon: float, utc_offset: float = 0.0, tile_size: int = 1000, overlap: int = 20, outputs: tuple[str, ...] = ("utci",), landcover: bool = False, scale: float = 1.0, out: str | None = None, z0: float | None = None) -> DataFrame:
    """From rasters and a met file to comfort per tile, step and pixel; written as Parquet by tile if ``out`` is given.

    Given a roughness length ``z0`` (m), wind coefficients are built and used.
    """
    met = metfile.validate(metfile.read(spark, met_path))
    tiled = preprocess(build_inputs(spark, folder, landcover), tile_size, overlap)
    coefficients = None if z0 is None else build_wind_ext_coeff(tiled, 1 / scale, z0=z0)
    result = run_utci_tiles(tiled, met, lat, lon, utc_offset, outputs, landcover, scale, coefficients)
    if out:
        result.repartitionByRange("tile").sortWithinPartitions("tile", "step").write.mode("overwrite").partitionBy("tile").parquet(out)
        return spark.read.parquet(out)
    return result


def scenario(tiled: DataFrame, trees: DataFrame, met: DataFrame, lat: float, lon: float, utc_offset: float = 0.0, outputs: tuple[str, ...] = ("utci",)) -> DataFrame:
    """What trees would change: statistics per tile and step of the scenario less the baseline."""
    if trees.count() > 200:
        raise ValueError("a scenario has 200 trees at most")
    painted = scene.paint_trees(tiled, trees)
    before, after = (run_utci_tiles(t, met, lat, lon, utc_offset, outputs) for t in (tiled, painted))
    parts = [scene.difference(after, before, ["tile", "step", "row", "col"], v, ["tile", "step"]).withColumn("variable", F.lit(v)) for v in outputs]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
