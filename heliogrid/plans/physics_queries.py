"""Queries of radiation, comfort, shadows and sky view."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import comfort, humidity, radiation, solar
from ..functions.expr import column, num
from ..operators import grid, rays, simulation
from ..operators.columns import sql_columns, with_columns
from .fixtures import FACTS, SCENE, facts, rounded, scene, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEY = ", ".join(_KEYS)
_UTCI = [
    ("pa", comfort.vapour_kpa("ta", "rh")),
    ("d", "tmrt - ta"),
    ("utci", f"CASE WHEN {comfort.missing('ta', 'rh', 'tmrt', 'va')} THEN -999e0 ELSE ta + {comfort.polynomial('ta', 'va', 'd', 'pa')} END"),
]
_HOURS = sql_columns(f"(SELECT *, CAST(l_suppkey % 16 AS INTEGER) AS tile, CAST(l_orderkey % 24 AS INTEGER) AS hour FROM {FACTS})", _UTCI)


@query(f"SELECT tile, hour, round(avg(utci), 4) AS mean, round(min(utci), 4) AS min, round(max(utci), 4) AS max, count(*) AS n FROM {_HOURS} GROUP BY tile, hour")
def utci_hourly_stats(spark, sf_dir):
    """Hourly thermal comfort per tile."""
    f = facts(spark, sf_dir).withColumns({"tile": (F.col("l_suppkey") % 16).cast("int"), "hour": (F.col("l_orderkey") % 24).cast("int")})
    u = with_columns(f, _UTCI).groupBy("tile", "hour").agg(F.avg("utci").alias("mean"), F.min("utci").alias("min"), F.max("utci").alias("max"), F.count(F.lit(1)).alias("n"))
    return rounded(u, 4)


@query(f"SELECT {_KEY}, round(utci, 4) AS utci FROM {sql_columns(FACTS, _UTCI)}")
def utci_pixelwise(spark, sf_dir):
    return rounded(with_columns(facts(spark, sf_dir), _UTCI).select(*_KEYS, "utci"), 4)


_WET = [("t", "ta + 273.15e0"), ("q", humidity.humidity_from_rh("press", "t", "rh")), *humidity.wet_bulb_columns("press", "t", "q")]


@query(f"SELECT {_KEY}, round(q, 8) AS q, round(td, 5) AS td, round(tw, 5) AS tw FROM {sql_columns(FACTS, _WET)}")
def wetbulb_newton(spark, sf_dir):
    return rounded(with_columns(facts(spark, sf_dir), _WET).select(*_KEYS, "q", "td", "tw"), 5, q=8)


_GLOBE = [("tg", comfort.globe(comfort.globe_coefficient("va"), "tmrt", "ta")), ("wb", comfort.wbgt("ta - 3e0", "tg", "ta", "(l_linenumber / 7e0)"))]


@query(f"SELECT {_KEY}, round(tg, 5) AS tg, round(wb, 5) AS wb FROM {sql_columns(FACTS, _GLOBE)}")
def globe_temperature_wbgt(spark, sf_dir):
    return rounded(with_columns(facts(spark, sf_dir), _GLOBE).select(*_KEYS, "tg", "wb"), 5)


_MOIST = [
    ("t", "ta + 273.15e0"),
    ("q", "rh / 10000e0"),
    ("om", humidity.ice_fraction("t")),
    ("dom", humidity.ice_fraction_slope("t")),
    ("cp", humidity.specific_heat("q")),
    ("cpc", humidity.specific_heat_condensed("q", "(q * 1.2e0)", "om")),
    ("lv", humidity.latent_vaporisation("t")),
    ("ls", humidity.latent_sublimation("t")),
    ("lx", humidity.latent_mixed("t", "om")),
    ("e", humidity.vapour_pressure("press", "q")),
    ("esl", humidity.saturation_pressure("t")),
    ("esi", humidity.saturation_pressure("t", "ice")),
    ("esm", humidity.saturation_pressure("t", "mixed", "om")),
    ("qs", humidity.saturation_humidity("press", "t")),
    ("rhf", humidity.relative_humidity("press", "t", "q")),
]
_MOIST_OUT = [n for n, _ in _MOIST[2:]]


@query(f"SELECT {_KEY}, {', '.join(f'round({n}, 5) AS {n}' for n in _MOIST_OUT)} FROM {sql_columns(FACTS, _MOIST)}")
def moist_thermodynamics(spark, sf_dir):
    return rounded(with_columns(facts(spark, sf_dir), _MOIST).select(*_KEYS, *_MOIST_OUT), 5)


_CLEAR = [
    ("alt", "1.5e0 + rh"),
    ("zen", "(90e0 - alt) * pi() / 180e0"),
    ("doy", "CAST(1 + l_partkey % 365 AS DOUBLE)"),
    ("lat", "CAST(l_suppkey % 90 AS DOUBLE)"),
    ("rad_g", "100e0 + 80e0 * va"),
    ("p", "press / 1000e0"),
    *solar.clearness_columns("zen", "doy", "ta", "(rh / 100e0)", "rad_g", "lat", "p"),
    *solar.diffuse_columns("rad_g", "alt", "kt", "ta", "rh"),
    ("dayl", solar.day_length("doy", "lat")),
    ("up", solar.sunrise("doy", "lat")),
]
_CLEAR_OUT = ["i0", "ci", "kt", "i0et", "rad_i", "rad_d", "dayl", "up"]


@query(f"SELECT {_KEY}, {', '.join(f'round({n}, 5) AS {n}' for n in _CLEAR_OUT)} FROM {sql_columns(FACTS, _CLEAR)}")
def clearness_and_diffuse(spark, sf_dir):
    return rounded(with_columns(facts(spark, sf_dir), _CLEAR).select(*_KEYS, *_CLEAR_OUT), 5)


_PATCHES = f"(VALUES {', '.join(f'({i}, {b}, {num(a)}, {num(z)})' for i, b, a, z in rays.patches(2))}) AS p(patch_id, band, altitude, azimuth)"
_SKIES = "(SELECT o_orderkey, 5e0 + o_orderkey % 80 AS zen, CAST(o_custkey % 360 AS DOUBLE) AS sun_azi, 20e0 + o_totalprice / 2000e0 AS rad_d, 50e0 + o_custkey % 700 AS rad_i, CAST(1 + o_orderkey % 365 AS DOUBLE) AS doy FROM orders)"
_STATE = solar.perez_columns("zen", "rad_d", "rad_i", "doy")
_LV = solar.patch_luminance("altitude", "azimuth", "sun_azi")
_LVS = f"(SELECT o_orderkey, patch_id, altitude, azimuth, pz_clear, pz_bright, {_LV} AS l FROM {sql_columns(_SKIES, _STATE)}, {_PATCHES})"


@query(f"""SELECT o_orderkey, round(max(pz_clear), 5) AS clearness, round(max(pz_bright), 5) AS brightness, round(max(l) / sum(l), 6) AS peak,
 round(sum(CASE WHEN azimuth >= 0 AND azimuth < 180 THEN l ELSE 0 END) / sum(l), 6) AS east FROM {_LVS} GROUP BY o_orderkey""")
def perez_luminance(spark, sf_dir):
    """All-weather sky luminance of each sky (order), over the patches of a division, an array of 153 constants.

    Skies are dealt by key first, so that the sums over a sky's patches need no further shuffle.
    """
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "5e0 + o_orderkey % 80 AS zen", "CAST(o_custkey % 360 AS DOUBLE) AS azimuth", "20e0 + o_totalprice / 2000e0 AS rad_d", "50e0 + o_custkey % 700 AS rad_i", "CAST(1 + o_orderkey % 365 AS DOUBLE) AS doy")
    state = with_columns(o.repartition("o_orderkey"), [*_STATE, *simulation.SUN_TERMS])
    lv = state.withColumn("p", F.explode(simulation.sky_patches(2)))
    lv = lv.withColumns({"toward": simulation.toward_sun(F.col("p")), "z": F.col("p.z"), "path": F.col("p.path")})
    lv = lv.withColumn("l", simulation.patch_luminance(F.col("path"), F.col("toward")))
    east = F.sum(F.when((F.col("z") >= 0) & (F.col("z") < 180), F.col("l")).otherwise(0.0))
    out = lv.groupBy("o_orderkey").agg(F.max("pz_clear").alias("clearness"), F.max("pz_bright").alias("brightness"), (F.max("l") / F.sum("l")).alias("peak"), (east / F.sum("l")).alias("east"))
    return rounded(out, 6, clearness=5, brightness=5)


_SR = rays.steradians(2)


@query(f"""SELECT p.altitude, count(*) AS n, round(sum(s.sr), 6) AS steradian, round({solar.band_emissivity('0.8e0', 'p.altitude', 1)}, 6) AS e1, round({solar.band_emissivity('0.8e0', 'p.altitude', 2)}, 6) AS e2, round({solar.band_emissivity('0.8e0', 'p.altitude', 3)}, 6) AS e3
 FROM {_PATCHES} JOIN (VALUES {', '.join(f'({i}, {num(x)})' for i, x in enumerate(_SR))}) AS s(patch_id, sr) ON p.patch_id = s.patch_id GROUP BY p.altitude""")
def sky_emissivity_bands(spark, sf_dir):
    p = rays.patch_table(spark)
    n = F.count(F.lit(1)).over(Window.partitionBy("altitude"))
    half = rays.patches(2)[0][2]
    a = F.radians("altitude")
    cap = F.sin(a) - F.sin(F.radians(F.lag("altitude").over(Window.orderBy("patch_id"))) + F.radians(F.lit(half)))
    ring = F.sin(a + F.radians(F.lit(half))) - F.sin(a - F.radians(F.lit(half)))
    s = p.withColumn("n", n).withColumn("sr", 2 * 3.141592653589793 / F.col("n") * F.when(F.col("n") > 1, ring).otherwise(cap))
    bands = s.groupBy("altitude").agg(F.count(F.lit(1)).alias("n"), F.sum("sr").alias("steradian"))
    return rounded(bands.select("altitude", "n", "steradian", *[column(solar.band_emissivity("0.8e0", "altitude", m)).alias(f"e{m}") for m in (1, 2, 3)]))


_RAYS = {k: rays.ray_schedule(60, 50, 55.0, azi, alt) for k, (azi, alt) in enumerate([(30.0, 40.0), (135.0, 25.0), (250.0, 60.0)])}
_STEPS = f"(VALUES {', '.join(f'({k}, {dr}, {dc}, {num(dz)})' for k, s in _RAYS.items() for _, dr, dc, dz in s)}) AS r(ray, drow, dcol, dz)"


@query(f"""WITH s AS {SCENE}, g AS (SELECT r.ray, s.row - r.drow AS row, s.col - r.dcol AS col, max(s.dsm - r.dz) AS f FROM s, {_STEPS} GROUP BY ALL)
SELECT a.row, a.col, q.ray, CASE WHEN coalesce(g.f, a.dsm) > a.dsm THEN 0 ELSE 1 END AS sunlit FROM s a CROSS JOIN (VALUES (0), (1), (2)) q(ray) LEFT JOIN g ON g.ray = q.ray AND g.row = a.row AND g.col = a.col""")
def building_shadow_ray(spark, sf_dir):
    return rays.building_shadow(scene(spark, sf_dir), rays.schedule_table(spark, _RAYS)).select("row", "col", "ray", "sunlit")


_WEIGHTS = f"(VALUES {', '.join(f'({i}, {num(z)}, {num(w[0])}, {num(w[1])})' for i, (z, w) in enumerate(zip(rays.sky_azimuths(2), rays.patch_weights(2))))}) AS w(patch_id, azimuth, w, wd)"
_SEEN = "(SELECT vec_id, CAST(k.range AS INTEGER) AS patch_id, embedding[CAST(k.range % 64 AS INTEGER) + 1] - (k.range // 64) / 20e0 AS x FROM embeddings, range(0, 153) k)"


def _seen(spark, sf_dir):
    """x of every patch of every pixel: a component of the vector, less a twentieth for each time it was used before."""
    patch = F.explode(F.sequence(F.lit(0), F.lit(len(rays.patches(2)) - 1))).alias("patch_id")
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", patch)
    x = F.col("embedding")[F.col("patch_id") % 64] - F.floor(F.col("patch_id") / 64) / 20
    return v.select("vec_id", "patch_id", x.alias("x"))


@query(f"""WITH v AS (SELECT vec_id, patch_id, CASE WHEN x > 0 THEN 1 ELSE 0 END AS visible FROM {_SEEN})
SELECT vec_id, round(least(sum(visible * w), 1e0), 6) AS svf, round(least(sum(CASE WHEN azimuth >= 0 AND azimuth < 180 THEN visible * wd ELSE 0 END), 1e0), 6) AS svf_e,
 round(least(sum(CASE WHEN azimuth >= 90 AND azimuth < 270 THEN visible * wd ELSE 0 END), 1e0), 6) AS svf_s, round(least(sum(CASE WHEN azimuth >= 180 AND azimuth < 360 THEN visible * wd ELSE 0 END), 1e0), 6) AS svf_w,
 round(least(sum(CASE WHEN azimuth >= 270 OR azimuth < 90 THEN visible * wd ELSE 0 END), 1e0), 6) AS svf_n FROM v JOIN {_WEIGHTS} USING (patch_id) GROUP BY vec_id""")
def svf_weighted_patches(spark, sf_dir):
    v = _seen(spark, sf_dir).select("vec_id", "patch_id", (F.col("x") > 0).cast("int").alias("visible"))
    w = spark.createDataFrame([(i, z, *ww) for i, (z, ww) in enumerate(zip(rays.sky_azimuths(2), rays.patch_weights(2)))], "patch_id int, azimuth double, w double, wd double")
    return rounded(rays.visible_fraction(v, w, ["vec_id"]))


@query(f"""WITH s AS (SELECT row, col, CASE WHEN dsm - dem < 2 THEN 1e0 ELSE 0e0 END AS b, dem AS v FROM {SCENE}),
j AS (SELECT a.row, a.col, k.range AS step, b.b, b.v FROM s a, range(0, 22) k JOIN s b ON b.row = a.row AND b.col = a.col + k.range),
f AS (SELECT *, min(b) OVER (PARTITION BY row, col ORDER BY step ROWS UNBOUNDED PRECEDING) AS f FROM j)
SELECT row, col, sum(CASE WHEN step < 5 THEN f * v ELSE 0 END) AS near, sum(f * v) AS far, sum(f) AS seen FROM f GROUP BY row, col""")
def ground_view_cummin(spark, sf_dir):
    """Ground seen eastwards until a building blocks the way: a running minimum along the row, then sums."""
    s = scene(spark, sf_dir).select("row", "col", F.when(F.col("dsm") - F.col("dem") < 2, 1.0).otherwise(0.0).alias("b"), F.col("dem").alias("v"))
    ray = Window.partitionBy("row").orderBy("col").rowsBetween(0, 21)
    seen = s.withColumn("ahead", F.collect_list(F.struct("b", "v")).over(ray))
    start = F.struct(F.lit(1.0).alias("f"), F.lit(0.0).alias("near"), F.lit(0.0).alias("far"), F.lit(0.0).alias("seen"), F.lit(0).alias("n"))

    def step(t, x):
        f = F.least(t["f"], x["b"])
        return F.struct(f.alias("f"), (t["near"] + F.when(t["n"] < 5, f * x["v"]).otherwise(0.0)).alias("near"), (t["far"] + f * x["v"]).alias("far"), (t["seen"] + f).alias("seen"), (t["n"] + 1).alias("n"))

    return seen.select("row", "col", F.aggregate("ahead", start, step).alias("t")).select("row", "col", "t.near", "t.far", "t.seen")


_FLUX = [
    ("svf", "rh / 100e0"),
    ("sv", "1e0 - l_tax_ / 2e0"),
    ("f_sh", radiation.wedge_shadow("(0.3e0 + rh / 100e0)", "(0.2e0 + l_tax_ * 5e0)")),
    ("esky", solar.sky_emissivity("ta", "rh")),
    ("bu", "svf - (1e0 - sv) * 0.97e0"),
    ("kdown", radiation.kdown("(10e0 * va)", "1e0", "45e0", "(5e0 * va)", "(15e0 * va)", "(5e0 * va)", "bu", "f_sh", "0.2e0")),
    ("kup", radiation.kup("(10e0 * va)", "(5e0 * va)", "(15e0 * va)", "45e0", "bu", "f_sh", "0.15e0", "0.1e0", "0.2e0")),
    ("ldown", radiation.ldown_isotropic("svf", "sv", "sv", "esky", "ta", "(ta + 2e0)", "0.9e0", "(svf / 2e0)")),
    ("wv", radiation.longwave_weights("svf", "sv", "sv")["veg"]),
    ("ww", radiation.longwave_weights("svf", "sv", "sv")["wall"]),
    ("ws", radiation.longwave_weights("svf", "sv", "sv")["sky"]),
    ("wr", radiation.longwave_weights("svf", "sv", "sv")["reflected"]),
    ("sstr", radiation.absorbed("(8e0 * va)", "kdown", "kup", "(4e0 * kup)", "ldown", "(0.95e0 * ldown)", "(ldown * 0.9e0)", "(ldown * 1.9e0)")),
    ("mrt", radiation.tmrt("sstr")),
]
_FLUX_FROM = f"(SELECT *, va / 10e0 AS l_tax_ FROM {FACTS})"
_FLUX_OUT = [n for n, _ in _FLUX]


@query(f"SELECT {_KEY}, {', '.join(f'round({n}, 5) AS {n}' for n in _FLUX_OUT)} FROM {sql_columns(_FLUX_FROM, _FLUX)}")
def tmrt_from_fluxes(spark, sf_dir):
    return rounded(with_columns(facts(spark, sf_dir).withColumn("l_tax_", F.col("va") / 10), _FLUX).select(*_KEYS, *_FLUX_OUT), 5)


_P153 = f"(VALUES {', '.join(f'({i}, {num(a)}, {num(z)}, {num(_SR[i])})' for i, _, a, z in rays.patches(2))}) AS p(patch_id, altitude, azimuth, sr)"
_SUNLIT = radiation.sunlit("50e0", "140e0", "altitude", "azimuth", "0.7e0")


@query(f"""SELECT vec_id, round(sum(CASE WHEN x > 0 THEN sr * cos(radians(altitude)) END), 6) AS sky, count(*) FILTER (x <= 0 AND {_SUNLIT[0]}) AS sunlit, count(*) FILTER (x <= 0 AND {_SUNLIT[1]}) AS shaded,
 round(sum(CASE WHEN x <= 0 THEN sr * cos(radians(altitude)) END) * 0.5e0 / pi() * (sum(CASE WHEN x > 0 THEN sr * sin(radians(altitude)) END) + 300e0) * 0.1e0, 6) AS reflected
 FROM {_SEEN} JOIN {_P153} USING (patch_id) GROUP BY vec_id""")
def patch_longwave_two_pass(spark, sf_dir):
    """Longwave over patches: the reflected part uses the first pass's sky total, which factors out of the second."""
    v = _seen(spark, sf_dir)
    p = spark.createDataFrame([(i, a, z, _SR[i]) for i, _, a, z in rays.patches(2)], "patch_id int, altitude double, azimuth double, sr double")
    sky, cosine = F.col("x") > 0, F.col("sr") * F.cos(F.radians("altitude"))
    g = v.join(F.broadcast(p), "patch_id").groupBy("vec_id").agg(
        F.sum(F.when(sky, cosine)).alias("sky"),
        F.count_if(~sky & column(_SUNLIT[0])).alias("sunlit"),
        F.count_if(~sky & column(_SUNLIT[1])).alias("shaded"),
        F.sum(F.when(~sky, cosine)).alias("m"),
        F.sum(F.when(sky, F.col("sr") * F.sin(F.radians("altitude")))).alias("down"),
    )
    return rounded(g.select("vec_id", "sky", "sunlit", "shaded", (F.col("m") * 0.5 / 3.141592653589793 * (F.col("down") + 300.0) * 0.1).alias("reflected")))


TILE, OVERLAP = 1000, 20


def _tiled(pixels, size: int = TILE, overlap: int = OVERLAP):
    """The scene in overlapping tiles, numbered downwards: it is no wider than one."""
    last = pixels.agg(F.coalesce(F.max("row"), F.lit(0)).alias("row"), F.coalesce(F.max("col"), F.lit(0)).alias("col")).first()
    dealt = grid.tiles(pixels, size, overlap, last["row"] + 1, last["col"] + 1)
    return dealt.withColumns({"tile": (F.col("tj") / size).cast("int"), "row": (F.col("row") - F.col("tj")).cast("int")}).drop("ti", "tj")


def _own(df, size: int = TILE):
    """Each pixel once: from the tile that it is in, not from an overlap."""
    return df.filter(F.col("row") < size)


@query()
def simulation_day(spark, sf_dir):
    """A day of 24 steps on the scene, in tiles of 1000 rows and an overlap of 20: mean Tmrt and UTCI by tile and step."""
    from ..sources import metfile

    hours = spark.range(24).select(F.col("id").alias("h"))
    sun = F.greatest(F.sin((F.col("h") - 6) / 12 * 3.141592653589793), F.lit(0.0)) * 900
    line = F.format_string("2009 223 %d 0 -999 -999 -999 -999 -999 1.5 60 %.2f 101.3 0 %.2f -999 -999 -999 -999 -999 -999 -999 -999 -999", "h", 20 + 6 * F.sin((F.col("h") - 8) / 12 * 3.141592653589793), sun)
    weather = simulation.weather(metfile.parse(hours.select(line.alias("value"))), 40.0, -74.0, -5.0)
    tiled = _tiled(scene(spark, sf_dir))
    out = _own(simulation.simulate(tiled, weather, ("utci", "tmrt")))
    utci = F.nanvl("utci", F.lit(None))
    return rounded(out.groupBy("tile", "step").agg(F.avg("tmrt").alias("tmrt"), F.avg(utci).alias("utci"), F.count(F.lit(1)).alias("pixels")), 4)


@query()
def sky_view_factors(spark, sf_dir):
    """All sky-view fields, by (tile, chunk of patches) tasks."""
    from ..operators import tiles

    tiled = _tiled(scene(spark, sf_dir))
    return rounded(_own(tiles.sky_view_factors(tiled)))


@query()
def wall_aspect_filter(spark, sf_dir):
    from ..operators import tiles

    tiled = scene(spark, sf_dir).withColumn("tile", F.lit("a"))
    return rounded(tiles.wall_aspects(grid.wall_heights(tiled, keys=["tile"])))


@query()
def wake_coefficients(spark, sf_dir):
    from ..operators import tiles

    tiled = _tiled(scene(spark, sf_dir)).select("tile", "row", "col", (F.col("dsm") - F.col("dem")).alias("h"))
    return rounded(_own(tiles.wake_coefficients(tiled, [0, 90, 180, 270])))
