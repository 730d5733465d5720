"""Polygon features: reading, filtering, clipping to boxes, rasterising.

A feature is (idx, value, ring): the outer ring as an array of struct<x, y>.  All are column
expressions; a polygon is exploded to the raster rows it spans and to the cells of its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_HEIGHT = 10.0


def from_geojson(df: DataFrame, json: str = "json", height: str = "height") -> DataFrame:
    """Polygon features of GeoJSON texts: idx (of the text), value (the height, or 10), ring.

    Multi-polygons give a feature per part; other geometries are dropped.
    """
    schema = "type string, features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    f = df.select(F.posexplode(F.from_json(json, schema)["features"]).alias("idx", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>"))
    value = F.coalesce(F.expr(f"try_cast(f.properties['{height}'] AS DOUBLE)"), F.lit(DEFAULT_HEIGHT))
    out = f.select("idx", value.alias("value"), F.explode(parts).alias("p"))
    return out.select("idx", "value", F.transform(F.col("p")[0], lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))).alias("ring"))


def bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)


def intersecting(features: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Features whose bounding box meets a box (min x, min y, max x, max y)."""
    x0, y0, x1, y1 = bounds(F.col("ring"))
    return features.filter((x0 <= box[2]) & (x1 >= box[0]) & (y0 <= box[3]) & (y1 >= box[1]))


def _cut_side(ring: Column, axis: str, other: str, limit: float, above: bool) -> Column:
    """A ring cut at one side: of every edge, what it adds to the cut ring."""

    def inside(p):
        return p[axis] >= limit if above else p[axis] <= limit

    def crossing(p, q):
        t = (F.lit(float(limit)) - p[axis]) / (q[axis] - p[axis])
        at = {axis: F.lit(float(limit)), other: p[other] + t * (q[other] - p[other])}
        return F.struct(at["x"].alias("x"), at["y"].alias("y"))

    def added(p, q):
        return F.when(inside(p) & inside(q), F.array(q)).when(inside(p), F.array(crossing(p, q))).when(inside(q), F.array(crossing(p, q), q)).otherwise(F.slice(F.array(q), 1, 0))

    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.flatten(F.zip_with(ring, after, added))


def clip_to_box(features: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rings cut at the four sides of a box, one side after another; empty ones are dropped."""
    for axis, other, limit, above in (("x", "y", box[0], True), ("x", "y", box[2], False), ("y", "x", box[1], True), ("y", "x", box[3], False)):
        features = features.withColumn("ring", _cut_side(F.col("ring"), axis, other, limit, above)).filter(F.size("ring") > 2)
    return features


def rasterize(features: DataFrame, gt: list[float], rows: int, cols: int) -> DataFrame:
    """(row, col, value) of the cells whose centres lie in a polygon; the feature of the highest idx wins.

    ``gt`` is a north-up geotransform.  Centres on a left or upper edge are inside.
    """
    x0, y0, x1, y1 = bounds(F.col("ring"))
    to_row = lambda y: (y - gt[3]) / gt[5]
    first = F.greatest(F.floor(F.least(to_row(y0), to_row(y1))).cast("int"), F.lit(0))
    last = F.least(F.floor(F.greatest(to_row(y0), to_row(y1))).cast("int"), F.lit(rows - 1))
    lines = features.filter(first <= last).select("idx", "value", "ring", F.explode(F.sequence(first, last)).alias("row"))
    y = F.lit(gt[3]) + (F.col("row") + 0.5) * gt[5]
    after = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    crossing = F.zip_with("ring", after, lambda p, q: F.when((p["y"] <= y) != (q["y"] <= y), p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"])))
    lines = lines.withColumn("xs", F.array_sort(F.array_compact(crossing))).filter(F.size("xs") > 1)
    spans = lines.select("idx", "value", "row", "xs", F.explode(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2))).alias("k"))
    col = lambda k: F.ceil((F.element_at("xs", k) - gt[0]) / gt[1] - 0.5).cast("int")
    a, b = F.greatest(col(F.col("k")), F.lit(0)), F.least(col(F.col("k") + 1) - 1, F.lit(cols - 1))
    cells = spans.filter(a <= b).select("idx", "value", "row", F.explode(F.sequence(a, b)).alias("col"))
    return cells.groupBy("row", "col").agg(F.max_by("value", "idx").alias("value"))


def distinct_shapes(features: DataFrame) -> DataFrame:
    """One feature of each ring, that of the smallest idx."""
    first = features.groupBy("ring").agg(F.min(F.struct("idx", "value")).alias("f"))
    return first.select("f.idx", "f.value", "ring")


def to_geojson(features: DataFrame, height: str = "height") -> DataFrame:
    """A GeoJSON text (a collection of one polygon) per feature, which ``from_geojson`` reads."""
    point = lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", point)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("value").alias(height)).alias("properties"), shape.alias("geometry"))
    return features.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("json"))


def write_geojson(features: DataFrame, path: str) -> None:
    """A collection per line of text files, so that any number of features is written by all tasks."""
    to_geojson(features).write.text(path)
