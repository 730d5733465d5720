"""Queries over pixel scenes."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import compare, grid, scene, vector
from .fixtures import SCENE, rounded, table
from .fixtures import scene as scene_table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_NORMAL = f"""(SELECT row, col, dem, dsm, lc, greatest(tree, 0e0) AS tree,
 CASE WHEN greatest(tree, 0e0) + dsm = dsm THEN 0e0 ELSE greatest(tree, 0e0) + dsm END AS canopy,
 CASE WHEN greatest(tree, 0e0) * 0.25e0 + dsm = dsm THEN 0e0 ELSE greatest(tree, 0e0) * 0.25e0 + dsm END AS trunk,
 CASE WHEN (greatest(tree, 0e0) + dem) * (greatest(tree, 0e0) * 0.25e0 + dem) = 0 THEN greatest(tree, 0e0) + dem ELSE 0e0 END AS bush FROM {SCENE})"""


@query(f"SELECT row, col, tree, canopy, trunk, bush FROM {_NORMAL}")
def scene_normalize(spark, sf_dir):
    return scene.normalize(scene_table(spark, sf_dir)).select("row", "col", "tree", "canopy", "trunk", "bush")


@query(f"SELECT row, col, CASE WHEN dsm - dem < 2 THEN 1e0 ELSE 0e0 END AS buildings, dsm - dem < 2 AS valid FROM {SCENE}")
def building_mask(spark, sf_dir):
    return scene.building_mask(scene_table(spark, sf_dir)).select("row", "col", "buildings", "valid")


@query(f"SELECT row, col, CAST(CASE WHEN lc < 1 OR lc > 7 THEN 6 WHEN lc IN (3, 4) THEN 5 ELSE lc END AS INTEGER) AS lc FROM {SCENE}")
def landcover_remap(spark, sf_dir):
    return scene_table(spark, sf_dir).select("row", "col", scene.land_cover_class(F.col("lc")).alias("lc"))


@query(f"""SELECT row, col, CAST(CASE WHEN dsm - dem > 1 THEN 2 WHEN c = 50 THEN 1 WHEN c IN (20, 95) THEN 3 WHEN c = 10 THEN 4
 WHEN c IN (30, 40, 90) THEN 5 WHEN c IN (60, 70, 100) THEN 6 WHEN c = 80 THEN 7 ELSE 0 END AS INTEGER) AS lc
 FROM (SELECT *, (lc + 1) * 10 AS c FROM {SCENE})""")
def world_cover_remap(spark, sf_dir):
    s = scene_table(spark, sf_dir)
    return s.select("row", "col", scene.world_cover_class((F.col("lc") + 1) * 10, F.col("dsm") - F.col("dem")).alias("lc"))


@query(f"""SELECT s.row, s.col, s.code, m.albedo, m.emissivity, m.tgk, m.tstart, m.tmaxlst
 FROM (SELECT row, col, CAST(CASE WHEN lc < 1 OR lc > 7 THEN 6 WHEN lc IN (3, 4) THEN 5 ELSE lc END AS INTEGER) AS code FROM {SCENE}) s
 LEFT JOIN (VALUES (2, 0.18e0, 0.95e0, 0.58e0, -9.78e0, 15e0), (1, 0.18e0, 0.95e0, 0.58e0, -9.78e0, 15e0), (0, 0.2e0, 0.95e0, 0.37e0, -3.41e0, 15e0),
 (7, 0.05e0, 0.98e0, 0e0, 0e0, 12e0), (5, 0.16e0, 0.94e0, 0.21e0, -3.38e0, 14e0), (6, 0.25e0, 0.94e0, 0.33e0, -3.01e0, 14e0), (99, 0.2e0, 0.9e0, 0.58e0, -3.41e0, 15e0))
 m(code, albedo, emissivity, tgk, tstart, tmaxlst) ON s.code = m.code""")
def material_lookup_join(spark, sf_dir):
    s = scene_table(spark, sf_dir).select("row", "col", scene.land_cover_class(F.col("lc")).alias("code"))
    return scene.materials(s, scene.land_cover_table(spark), "code").select("row", "col", "code", "albedo", "emissivity", "tgk", "tstart", "tmaxlst")


@query(f"SELECT greatest(max(dsm), max(tree + dem)) AS amax FROM {_NORMAL}")
def domain_maximum(spark, sf_dir):
    return scene.domain_maximum(scene.normalize(scene_table(spark, sf_dir)))


@query(f"SELECT m AS median, CASE WHEN m > 0 THEN 3e0 ELSE m END AS altitude FROM (SELECT quantile_disc(dem, 0.5) AS m FROM {SCENE})")
def dem_lower_median(spark, sf_dir):
    return scene.lower_median(scene_table(spark, sf_dir))


_NEAR = f"""(SELECT *, lag(dsm) OVER (PARTITION BY row ORDER BY col) AS w, lead(dsm) OVER (PARTITION BY row ORDER BY col) AS e,
 lag(dsm) OVER (PARTITION BY col ORDER BY row) AS n, lead(dsm) OVER (PARTITION BY col ORDER BY row) AS s FROM {SCENE})"""


@query(f"""SELECT row, col, CASE WHEN n IS NULL OR s IS NULL OR e IS NULL OR w IS NULL OR greatest(n, s, e, w) - dsm < 3 THEN 0e0
 ELSE greatest(n, s, e, w) - dsm END AS wall FROM {_NEAR}""")
def wall_height_stencil(spark, sf_dir):
    return grid.wall_heights(scene_table(spark, sf_dir)).select("row", "col", "wall")


@query(f"""SELECT row, col, round(atan(sqrt(fx * fx + fy * fy)), 6) AS slope, round(CASE WHEN a < 0 THEN a + 2e0 * pi() ELSE a END, 6) AS aspect
 FROM (SELECT *, -atan2(fx, fy) AS a FROM (SELECT row, col, coalesce((s - n) / 2e0, s - dsm, dsm - n) AS fy, coalesce((e - w) / 2e0, e - dsm, dsm - w) AS fx FROM {_NEAR}))""")
def slope_aspect_gradient(spark, sf_dir):
    return rounded(grid.slope_aspect(scene_table(spark, sf_dir)).select("row", "col", "slope", "aspect"))


@query(f"""SELECT s.row, s.col, t.i * 16 AS ti, u.j * 16 AS tj, concat(t.i * 16, '_', u.j * 16) AS tile FROM {SCENE} s
 JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(0, 5000)) t ON s.col >= t.i * 16 AND s.col < t.i * 16 + 20
 JOIN (SELECT CAST(range AS INTEGER) AS j FROM range(0, 5000)) u ON s.row >= u.j * 16 AND s.row < u.j * 16 + 20""")
def tile_explode_overlap(spark, sf_dir):
    s = scene_table(spark, sf_dir)
    size = s.agg(F.max("row"), F.max("col")).first()
    return grid.tiles(s, 16, 4, size[0] + 1, size[1] + 1).select("row", "col", "ti", "tj", "tile")


def _keys(spark, sf_dir):
    s = scene_table(spark, sf_dir)
    key = F.concat_ws("_", (F.floor(F.col("col") / 4) * 4).cast("string"), (F.floor(F.col("row") / 4) * 4).cast("string")).alias("tile")
    return s.filter("dsm > dem").select(key).distinct(), s.filter("tree > 0").select(key).distinct(), s.filter("lc = 7").select(key).distinct()


_KEY = "concat(CAST(floor(col / 4) * 4 AS INTEGER), '_', CAST(floor(row / 4) * 4 AS INTEGER))"


@query(f"""SELECT tile, CAST(split_part(tile, '_', 1) AS INTEGER) AS ti, CAST(split_part(tile, '_', 2) AS INTEGER) AS tj FROM (
 SELECT {_KEY} AS tile FROM {SCENE} WHERE dsm > dem INTERSECT SELECT {_KEY} FROM {SCENE} WHERE tree > 0 INTERSECT SELECT {_KEY} FROM {SCENE} WHERE lc = 7)""")
def tile_key_intersection(spark, sf_dir):
    a, b, c = _keys(spark, sf_dir)
    out = a.intersect(b).intersect(c)
    return out.select("tile", F.split("tile", "_")[0].cast("int").alias("ti"), F.split("tile", "_")[1].cast("int").alias("tj")).orderBy("ti", "tj")


@query(f"SELECT {_KEY} AS tile FROM {SCENE} WHERE dsm > dem EXCEPT SELECT {_KEY} FROM {SCENE} WHERE tree > 0")
def missing_tiles_anti(spark, sf_dir):
    a, b, _ = _keys(spark, sf_dir)
    return a.join(b, "tile", "left_anti")


@query(f"SELECT row - 5 AS row, col - 10 AS col, dsm FROM {SCENE} WHERE row BETWEEN 5 AND 24 AND col BETWEEN 10 AND 29")
def crop_window(spark, sf_dir):
    return grid.crop(scene_table(spark, sf_dir), 10, 5, 20, 20).select("row", "col", "dsm")


@query(f"""WITH s AS (SELECT row, col, dsm - dem AS h FROM {SCENE})
SELECT a.row, a.col, round(avg(b.h), 6) AS mean_all, round(avg(b.h) FILTER (b.h > 0), 6) AS mean_above, round(CAST(count(*) FILTER (b.h > 0) AS DOUBLE) / count(*), 6) AS fraction
FROM s a JOIN s b ON b.row BETWEEN a.row - 3 AND a.row + 3 AND b.col BETWEEN a.col - 3 AND a.col + 3 GROUP BY a.row, a.col""")
def box_filter_plan_fraction(spark, sf_dir):
    s = scene_table(spark, sf_dir).withColumn("h", F.col("dsm") - F.col("dem"))
    return rounded(grid.box_stats(s, "h", 3).select("row", "col", "mean_all", "mean_above", "fraction"))


_G = grid.gaussian_weights(1.5)


@query(f"""WITH s AS (SELECT row, col, CASE WHEN tree > 0 THEN NULL ELSE dsm END AS v FROM {SCENE}),
w(k, w) AS (VALUES {', '.join(f'({k - len(_G) // 2}, {x!r}e0)' if 'e' not in repr(x) else f'({k - len(_G) // 2}, {x!r})' for k, x in enumerate(_G))})
SELECT a.row, a.col, round(sum(b.v * x.w * y.w) / sum(CASE WHEN b.v IS NOT NULL THEN x.w * y.w END), 6) AS smooth
FROM s a CROSS JOIN w x CROSS JOIN w y JOIN s b ON b.row = a.row + y.k AND b.col = a.col + x.k GROUP BY a.row, a.col""")
def gaussian_smooth_masked(spark, sf_dir):
    s = scene_table(spark, sf_dir).withColumn("v", F.when(F.col("tree") > 0, F.lit(float("nan"))).otherwise(F.col("dsm")))
    return rounded(grid.gaussian_smooth(s, "v", 1.5).select("row", "col", "smooth"))


@query(f"""WITH s AS {SCENE} SELECT a.row, a.col, min(b.dsm) AS eroded FROM s a JOIN s b
 ON (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= 4 GROUP BY a.row, a.col""")
def grey_erosion_disc(spark, sf_dir):
    return grid.grey_erosion(scene_table(spark, sf_dir), "dsm", 2)


@query(f"""WITH RECURSIVE s AS (SELECT row, col, dsm - dem AS h FROM {SCENE} WHERE dsm > dem),
r AS (SELECT row, col, h, row * 2147483648 + col AS id FROM s),
reach AS (SELECT id, row, col, id AS other FROM r UNION SELECT reach.id, b.row, b.col, b.row * 2147483648 + b.col FROM reach JOIN s b ON abs(reach.row - b.row) + abs(reach.col - b.col) = 1),
l AS (SELECT id, min(other) AS label FROM reach GROUP BY id)
SELECT label, CAST(count(*) AS BIGINT) AS pixels, round(avg(h), 6) AS mean_height, count(DISTINCT col) AS width, count(DISTINCT row) AS depth FROM r JOIN l USING (id) GROUP BY label""")
def component_label_stats(spark, sf_dir):
    s = scene_table(spark, sf_dir).withColumns({"h": F.col("dsm") - F.col("dem"), "on": F.col("dsm") > F.col("dem")})
    labelled = grid.component_labels(s, "on").filter("label IS NOT NULL")
    return rounded(labelled.groupBy("label").agg(F.count(F.lit(1)).alias("pixels"), F.avg("h").alias("mean_height"), F.countDistinct("col").alias("width"), F.countDistinct("row").alias("depth")))


_TREES = "(SELECT CAST(s_suppkey % 40 AS DOUBLE) AS row, CAST((s_suppkey * 7) % 50 AS DOUBLE) AS col, CAST(2 + s_suppkey % 20 AS DOUBLE) AS height, CAST(1 + s_suppkey % 4 AS DOUBLE) AS crown_radius FROM supplier)"
_PAINTED = f"""(SELECT s.row, s.col, greatest(s.tree, coalesce(max(t.height), 0e0)) AS tree FROM {SCENE} s
 LEFT JOIN {_TREES} t ON power(s.row - t.row + 0.5e0, 2) + power(s.col - t.col + 0.5e0, 2) <= t.crown_radius * t.crown_radius GROUP BY s.row, s.col, s.tree)"""


def _painted(spark, sf_dir):
    n = F.col("s_suppkey")
    trees = table(spark, sf_dir, "supplier").select((n % 40).cast("double").alias("row"), ((n * 7) % 50).cast("double").alias("col"), (2 + n % 20).cast("double").alias("height"), (1 + n % 4).cast("double").alias("crown_radius"))
    return scene.paint_trees(scene_table(spark, sf_dir), trees).select("row", "col", "tree")


@query(f"SELECT * FROM {_PAINTED}")
def scenario_tree_paint(spark, sf_dir):
    return _painted(spark, sf_dir)


@query(f"""SELECT a.row, round(avg(a.tree - b.tree), 6) AS mean, min(a.tree - b.tree) AS min, max(a.tree - b.tree) AS max,
 CAST(count(*) FILTER (abs(a.tree - b.tree) > 0.5) AS BIGINT) AS changed FROM {_PAINTED} a JOIN {SCENE} b ON a.row = b.row AND a.col = b.col GROUP BY a.row""")
def scenario_diff_stats(spark, sf_dir):
    return rounded(scene.difference(_painted(spark, sf_dir), scene_table(spark, sf_dir), ["row", "col"], "tree", ["row"]))


@query(f"SELECT CAST(count(*) FILTER (a.tree <> b.tree) AS BIGINT) AS changed FROM {_PAINTED} a JOIN {SCENE} b ON a.row = b.row AND a.col = b.col")
def changed_pixels(spark, sf_dir):
    both = _painted(spark, sf_dir).join(scene_table(spark, sf_dir).select("row", "col", F.col("tree").alias("was")), ["row", "col"])
    return both.agg(F.count_if(F.col("tree") != F.col("was")).alias("changed"))


@query(f"""WITH n AS (SELECT CAST(ceil((max(row) + 1) / 1.5e0) AS BIGINT) AS r, CAST(ceil((max(col) + 1) / 1.5e0) AS BIGINT) AS c FROM {SCENE}),
 t AS (SELECT CAST(row AS INTEGER) AS row, CAST(unnest(range(0, c)) AS INTEGER) AS col FROM (SELECT unnest(range(0, r)) AS row, c FROM n))
SELECT t.row, t.col, s.dsm FROM t LEFT JOIN {SCENE} s ON s.row = CAST(floor((t.row + 0.5e0) * 1.5e0) AS INTEGER) AND s.col = CAST(floor((t.col + 0.5e0) * 1.5e0) AS INTEGER)""")
def resample_nearest(spark, sf_dir):
    """The whole scene on a grid of 1.5 m."""
    pixels = scene_table(spark, sf_dir)
    last = pixels.agg(F.max("row").alias("row"), F.max("col").alias("col")).first()
    rows, cols = (math.ceil((last[n] + 1) / 1.5) for n in ("row", "col"))
    target = spark.range(rows).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))
    return grid.resample_nearest(pixels, [100.0, 1.0, 0.0, 500.0, 0.0, -1.0], target, [100.0, 1.5, 0.0, 500.0, 0.0, -1.5], "dsm").select("row", "col", "dsm")


@query(f"""SELECT lc AS altitude_class, count(*) AS n, round(min(svf), 6) AS least, round(avg(acos(sqrt(svf))), 6) AS mean_asvf, round(avg(CASE WHEN 1 - greatest(svf + sv - 1, 0) > 0 THEN asin(sqrt(1 - greatest(svf + sv - 1, 0))) ELSE 0 END), 6) AS mean_alfa,
 round(avg(svf - (1 - sv) * (1 - 0.03e0)), 6) AS mean_bu FROM (SELECT lc, 1e0 / (1e0 + dem) AS svf, 1e0 - tree / 30e0 AS sv FROM {_NORMAL}) GROUP BY lc""")
def sky_view_terms(spark, sf_dir):
    s = scene.normalize(scene_table(spark, sf_dir)).select("lc", (1 / (1 + F.col("dem"))).alias("svf"), (1 - F.col("tree") / 30).alias("svfveg"))
    t = scene.sky_terms(s).groupBy(F.col("lc").alias("altitude_class"))
    return rounded(t.agg(F.count(F.lit(1)).alias("n"), F.min("svf").alias("least"), F.avg("asvf").alias("mean_asvf"), F.avg("svfalfa").alias("mean_alfa"), F.avg("svfbuveg").alias("mean_bu")))


@query(f"""WITH o AS (SELECT row, col, max(dsm) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS horizon,
 CAST(row_number() OVER (PARTITION BY row ORDER BY dsm DESC, col) AS INTEGER) AS rank FROM {SCENE}) SELECT * FROM o WHERE rank <= 3""")
def running_horizon_top3(spark, sf_dir):
    w = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    r = Window.partitionBy("row").orderBy(F.desc("dsm"), "col")
    s = scene_table(spark, sf_dir)
    return s.select("row", "col", F.max("dsm").over(w).alias("horizon"), F.row_number().over(r).alias("rank")).filter("rank <= 3")


@query(f"""WITH s AS (SELECT row, col, dsm - dem AS h FROM {SCENE}), m AS (SELECT max(row) AS r, max(col) AS c FROM s),
e AS (SELECT s.row, s.col, CASE WHEN s.h > 0 THEN s.h * (SELECT count(*) FROM s n WHERE n.h <= 0 AND abs(n.row - s.row) + abs(n.col - s.col) = 1) ELSE 0 END AS a FROM s)
SELECT s.row, s.col, round(sum(e.a) / 25e0 / pi(), 6) AS frontal FROM s CROSS JOIN m CROSS JOIN range(-2, 3) i CROSS JOIN range(-2, 3) j
 JOIN e ON e.row = least(greatest(s.row + i.range, 0), m.r) AND e.col = least(greatest(s.col + j.range, 0), m.c) GROUP BY s.row, s.col""")
def frontal_area_index(spark, sf_dir):
    s = scene_table(spark, sf_dir).withColumn("h", F.col("dsm") - F.col("dem"))
    return rounded(grid.frontal_area(s, "h", 2).select("row", "col", "frontal"))


_RECT = "(SELECT n_nationkey AS idx, 5e0 + n_nationkey AS value, n_nationkey * 3 % 40 + 0.2e0 AS x0, n_nationkey * 3 % 40 + 6.7e0 AS x1, n_nationkey * 5 % 30 + 0.1e0 AS y0, n_nationkey * 5 % 30 + 4.9e0 AS y1 FROM nation)"


@query(f"""SELECT CAST(r.range AS INTEGER) AS row, CAST(c.range AS INTEGER) AS col, max_by(value, idx) AS value FROM {_RECT}, range(0, 40) r, range(0, 50) c
 WHERE c.range + 0.5e0 >= x0 AND c.range + 0.5e0 < x1 AND 40e0 - r.range - 0.5e0 >= y0 AND 40e0 - r.range - 0.5e0 < y1 GROUP BY r.range, c.range""")
def rasterize_polygons(spark, sf_dir):
    k = F.col("n_nationkey")
    x0, x1, y0, y1 = k * 3 % 40 + F.lit(0.2), k * 3 % 40 + F.lit(6.7), k * 5 % 30 + F.lit(0.1), k * 5 % 30 + F.lit(4.9)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rects = table(spark, sf_dir, "nation").select(k.alias("idx"), (5.0 + k).alias("value"), F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("ring"))
    return vector.rasterize(rects, [0.0, 1.0, 0.0, 40.0, 0.0, -1.0], 40, 50)


@query(f"SELECT idx, value, round((least(x1, 30e0) - greatest(x0, 10e0)) * (least(y1, 25e0) - greatest(y0, 5e0)), 6) AS area FROM {_RECT} WHERE least(x1, 30e0) > greatest(x0, 10e0) AND least(y1, 25e0) > greatest(y0, 5e0)")
def clip_polygons(spark, sf_dir):
    k = F.col("n_nationkey")
    x0, x1, y0, y1 = k * 3 % 40 + F.lit(0.2), k * 3 % 40 + F.lit(6.7), k * 5 % 30 + F.lit(0.1), k * 5 % 30 + F.lit(4.9)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rects = table(spark, sf_dir, "nation").select(k.alias("idx"), (5.0 + k).alias("value"), F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("ring"))
    box = (10.0, 5.0, 30.0, 25.0)
    c = vector.clip_to_box(vector.intersecting(rects, box), box)
    after = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    twice = F.aggregate(F.zip_with("ring", after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda t, x: t + x)
    return rounded(c.select("idx", "value", (twice / 2).alias("area")))


@query(f"""SELECT row, col, CASE WHEN dsm - dem > 1 THEN 0e0 ELSE tree END AS tree, dem + (dsm - dem) AS dsm FROM {SCENE}""")
def building_surface(spark, sf_dir):
    s = scene_table(spark, sf_dir).withColumn("height", F.col("dsm") - F.col("dem"))
    return scene.place_buildings(s).select("row", "col", "tree", "dsm")


@query(f"""WITH a AS (SELECT *, unnest(generate_series(CAST(greatest(ceil((col - 24) / 20e0), 0) AS BIGINT), CAST(floor(col / 20e0) AS BIGINT))) * 20 AS ti FROM {SCENE}),
t AS (SELECT *, unnest(generate_series(CAST(greatest(ceil((row - 24) / 20e0), 0) AS BIGINT), CAST(floor(row / 20e0) AS BIGINT))) * 20 AS tj FROM a)
SELECT row, col, arg_min(v, tile) FILTER (v IS NOT NULL) AS v FROM (SELECT row, col, ti || '_' || tj AS tile, CASE WHEN tree > 0 AND ti % 40 = 0 THEN NULL ELSE dsm + ti + tj END AS v FROM t) GROUP BY row, col""")
def mosaic_overlap(spark, sf_dir):
    s = scene_table(spark, sf_dir)
    t = grid.tiles(s, 20, 5, 1 << 30, 50).withColumn("v", F.when((F.col("tree") > 0) & (F.col("ti") % 40 == 0), None).otherwise(F.col("dsm") + F.col("ti") + F.col("tj")))
    return grid.mosaic(t, "v", "tile")


def _haversine(a: str, b: str) -> str:
    return f"2 * 6371000e0 * asin(sqrt(least(power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2), 1e0)))"


@query(f"""WITH c AS (SELECT row, col, 40e0 + row / 100e0 + col / 2000e0 AS lat, -74e0 + col / 80e0 + row / 3000e0 AS lon FROM {SCENE}),
d AS (SELECT a.row, a.col, median({_haversine('a', 'b')}) FILTER (b.row = a.row) AS w, median({_haversine('a', 'b')}) FILTER (b.col = a.col) AS h
 FROM c a LEFT JOIN c b ON (b.row = a.row AND abs(b.col - a.col) = 1) OR (b.col = a.col AND abs(b.row - a.row) = 1) GROUP BY a.row, a.col)
SELECT row, col, round(coalesce(w, h, 1e30), 4) AS width, round(coalesce(h, w, 1e30), 4) AS height FROM d""")
def median_cell_size(spark, sf_dir):
    lat, lon = 40 + F.col("row") / 100 + F.col("col") / 2000, -74 + F.col("col") / 80 + F.col("row") / 3000
    c = scene_table(spark, sf_dir).select("row", "col", lat.alias("lat"), lon.alias("lon"))
    return rounded(grid.cell_size(c).select("row", "col", "width", "height"), 4)


@query(f"""WITH a AS (SELECT lc, tree FROM {SCENE}), b AS (SELECT CASE WHEN lc < 1 OR lc > 7 THEN 6 WHEN lc IN (3, 4) THEN 5 ELSE lc END AS lc, greatest(tree, 0e0) AS tree FROM {SCENE})
SELECT lc, tree, CAST(count(*) AS BIGINT) AS surplus FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY lc, tree
UNION ALL SELECT lc, tree, CAST(-count(*) AS BIGINT) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY lc, tree""")
def artifact_multiset_difference(spark, sf_dir):
    s = scene_table(spark, sf_dir)
    clean = scene.normalize(s).withColumn("lc", scene.land_cover_class(F.col("lc")))
    return compare.multiset_difference(s, clean, ["lc", "tree"])


def _squares(s):
    """A square around each building pixel, by its place in blocks of 7 rows."""
    x, y = F.col("col").cast("double"), (F.col("row") % 7).cast("double")
    ring = F.array(*[F.struct((x + i).alias("x"), (y + j).alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    return s.filter("dsm > dem").select((F.col("row") * 50 + F.col("col")).alias("idx"), (F.col("dsm") - F.col("dem")).alias("value"), ring.alias("ring"))


@query(f"""SELECT min(row * 50 + col) AS idx, arg_min(dsm - dem, row * 50 + col) AS value, CAST(col AS DOUBLE) AS x, CAST(row % 7 AS DOUBLE) AS y FROM {SCENE} WHERE dsm > dem GROUP BY col, row % 7""")
def distinct_shapes(spark, sf_dir):
    out = vector.distinct_shapes(_squares(scene_table(spark, sf_dir)))
    return out.select("idx", "value", F.col("ring")[0]["x"].alias("x"), F.col("ring")[0]["y"].alias("y"))


@query(f"""SELECT CAST(dsm - dem AS DOUBLE) AS value, CAST(col AS DOUBLE) AS x, CAST(row % 7 AS DOUBLE) AS y, 5 AS points FROM {SCENE} WHERE dsm > dem""")
def geojson_round_trip(spark, sf_dir):
    back = vector.from_geojson(vector.to_geojson(_squares(scene_table(spark, sf_dir))))
    return back.select("value", F.col("ring")[0]["x"].alias("x"), F.col("ring")[0]["y"].alias("y"), F.size("ring").alias("points"))


@query(f"""WITH s AS (SELECT row, col, CASE WHEN tree > 0 THEN NULL ELSE dsm END AS v FROM {SCENE}),
n AS (SELECT CAST(ceil((max(row) + 1) / 0.8e0) AS BIGINT) AS r, CAST(ceil((max(col) + 1) / 0.8e0) AS BIGINT) AS c FROM s),
t AS (SELECT CAST(row AS INTEGER) AS row, CAST(unnest(range(0, c)) AS INTEGER) AS col FROM (SELECT unnest(range(0, r)) AS row, c FROM n)),
p AS (SELECT row, col, (row + 0.5e0) * 0.8e0 AS y, (col + 0.5e0) * 0.8e0 AS x FROM t),
k AS (SELECT p.*, CAST(floor(y - 0.5e0) + i AS INTEGER) AS sr, CAST(floor(x - 0.5e0) + j AS INTEGER) AS sc, (1 - abs(y - 0.5e0 - (floor(y - 0.5e0) + i))) * (1 - abs(x - 0.5e0 - (floor(x - 0.5e0) + j))) AS w
 FROM p, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT k.row, k.col, CASE WHEN bool_or(k.sr = floor(y) AND k.sc = floor(x) AND s.v IS NOT NULL) THEN round(sum(w * s.v) / sum(CASE WHEN s.v IS NOT NULL THEN w END), 5) END AS v
 FROM k LEFT JOIN s ON s.row = k.sr AND s.col = k.sc GROUP BY k.row, k.col""")
def resample_bilinear(spark, sf_dir):
    """The whole scene, without the pixels of trees, on a grid of 0.8 m."""
    pixels = scene_table(spark, sf_dir).select("row", "col", F.when(~(F.col("tree") > 0), F.col("dsm")).alias("v"))
    last = pixels.agg(F.max("row").alias("row"), F.max("col").alias("col")).first()
    rows, cols = (math.ceil((last[n] + 1) / 0.8) for n in ("row", "col"))
    target = spark.range(rows).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))
    return rounded(grid.resample_bilinear(pixels, [0.0, 1.0, 0.0, 0.0, 0.0, 1.0], target, [0.0, 0.8, 0.0, 0.0, 0.0, 0.8], "v"), 5)
