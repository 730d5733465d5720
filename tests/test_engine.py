"""Formulas and kernels against published values, invariants and plain loops."""

import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogrid import api, cli, session
from heliogrid.functions import comfort, humidity, radiation, solar, wind
from heliogrid.functions.expr import column
from heliogrid.operators import compare, grid, kernels, rays, scene, tiles, timeline, vector
from heliogrid.operators.columns import with_columns
from heliogrid.sources import archives, discovery, geotiff, images, landcover, metfile, netcdf3


def value(spark, text):
    return spark.range(1).select(column(text)).first()[0]


def test_utci_matches_arrays_and_published_cases(spark):
    # Operational procedure: reference conditions are neutral, and a hot sunny case.
    assert comfort.utci_array(20.0, 50.0, 20.0, 0.5) == pytest.approx(20.0, abs=1.0)
    assert comfort.utci_array(25.0, 50.0, 25.0, 1.0) == pytest.approx(25.0, abs=0.8)
    assert comfort.utci_array(-999.0, 50.0, 20.0, 1.0) == -999
    rng = np.random.default_rng(0)
    rows = [(float(a), float(r), float(a + d), float(v)) for a, r, d, v in zip(rng.uniform(-20, 45, 50), rng.uniform(5, 100, 50), rng.uniform(-20, 60, 50), rng.uniform(0.5, 17, 50))]
    df = spark.createDataFrame(rows, "ta double, rh double, tmrt double, va double")
    out = with_columns(df, [("pa", comfort.vapour_kpa("ta", "rh")), ("d", "tmrt - ta"), ("u", f"ta + {comfort.polynomial('ta', 'va', 'd', 'pa')}")]).toPandas()
    assert np.allclose(out.u, comfort.utci_array(out.ta, out.rh, out.tmrt, out.va), atol=1e-6)


def test_wet_bulb_closes_the_energy_balance(spark):
    df = spark.createDataFrame([(95000.0, t, rh) for t in (263.0, 283.0, 303.0, 313.0) for rh in (5.0, 40.0, 99.0)], "p double, t double, rh double")
    out = with_columns(df, [("q", humidity.humidity_from_rh("p", "t", "rh")), *humidity.wet_bulb_columns("p", "t", "q")]).toPandas()
    assert np.allclose(out.tw, humidity.wet_bulb_array(out.p, out.t, out.q), atol=1e-4)
    assert ((out.td <= out.tw + 1e-9) & (out.tw <= out.t + 1e-9)).all()
    es = humidity.saturation_pressure("td")
    back = spark.createDataFrame(out[["p", "t", "q", "td"]]).select(column(es).alias("a"), column(humidity.vapour_pressure("p", "q")).alias("b")).toPandas()
    assert np.allclose(back.a, back.b, rtol=1e-6)


def test_globe_solves_its_balance(spark):
    a, b = 20.0, 55.0
    hcg = 6.3 / 0.46821 * 2**0.6
    tg = value(spark, comfort.globe("(%r)" % hcg, f"{b}e0", f"{a}e0"))
    lost = hcg * (tg - a) - 0.95 * comfort.SIGMA_GLOBE * ((b + 273.15) ** 4 - (tg + 273.15) ** 4)
    assert abs(lost) < 0.5
    assert value(spark, comfort.wbgt("10e0", "30e0", "20e0", "0e0")) == pytest.approx(16)
    assert value(spark, comfort.wbgt("10e0", "30e0", "20e0", "1e0")) == pytest.approx(15)


def test_solar_position_against_almanac(spark):
    # 2003-10-17 12:30:30 at UTC-7, Golden (Colorado): zenith 50.11, azimuth 194.34.
    days = (1066419030 - 946728000) / 86400
    r = with_columns(spark.createDataFrame([(days, 39.742476, -105.1786)], "days double, lat double, lon double"), solar.position_columns("days", "lat", "lon")).first()
    assert r.sun_zenith == pytest.approx(50.11, abs=0.02) and r.sun_azimuth == pytest.approx(194.34, abs=0.02)


def test_wind_and_small_formulas(spark):
    assert [value(spark, wind.direction(f"{u}e0", f"{v}e0")) for u, v in ((0, -5), (-5, 0), (0, 5), (5, 0), (0, 0))] == pytest.approx([0, 90, 180, 270, 0])
    assert [value(spark, wind.direction_bin(f"{d}e0")) for d in (0, 14.9, 15, 344.9, 345, 359, -20)] == [0, 0, 30, 330, 0, 0, 330]
    assert value(spark, wind.tree_coefficient("0e0", "0e0")) == 1
    assert value(spark, humidity.magnus_rh("20e0", "20e0")) == pytest.approx(100)
    assert value(spark, radiation.tmrt(f"{0.95 * solar.SIGMA * 300**4!r}")) == pytest.approx(26.8)
    assert value(spark, solar.day_length("81e0", "0e0")) == pytest.approx(12, abs=0.01)
    weights = radiation.longwave_weights("1e0", "1e0", "1e0")
    assert value(spark, weights["sky"]) == pytest.approx(1, abs=1e-3) and value(spark, weights["wall"]) == pytest.approx(0, abs=1e-9)


def test_sky_division_and_weights():
    for option, n in ((1, 145), (2, 153), (3, 305), (4, 266 + 339 - 0)):
        assert len(rays.patches(option)) == sum(rays.COUNTS[option])
    assert sum(rays.steradians(2)) == pytest.approx(2 * math.pi, rel=0.02)
    assert sum(w for w, _ in rays.patch_weights(2)) == pytest.approx(1, abs=2e-3)
    with pytest.raises(ValueError):
        rays.patches(5)


def test_shadow_kernel_and_relation_agree(spark):
    rng = np.random.default_rng(4)
    dsm = rng.integers(0, 3, (20, 24)) + 12.0 * (rng.random((20, 24)) > 0.93)
    zero = np.zeros_like(dsm)
    for azi, alt in ((33.0, 25.0), (120.0, 50.0), (271.0, 18.0)):
        amax = float(dsm.max())
        steps = rays.ray_schedule(*dsm.shape, amax, azi, alt)
        seen = np.ones_like(dsm)
        for r in range(20):
            for c in range(24):
                for _, dr, dc, dz in steps:
                    z = dsm[r + dr, c + dc] if 0 <= r + dr < 20 and 0 <= c + dc < 24 else 0
                    if z - dz > dsm[r, c]:
                        seen[r, c] = 0
        assert (kernels.sky_shadow(dsm, zero, zero, zero, azi, alt, amax)[0] == seen).all()
        df = spark.createDataFrame([(r, c, float(dsm[r, c])) for r in range(20) for c in range(24)], "row int, col int, dsm double")
        out = rays.building_shadow(df, rays.schedule_table(spark, {0: steps})).toPandas()
        assert (out.sort_values(["row", "col"]).sunlit.to_numpy().reshape(20, 24) == seen).all()


def test_sky_view_of_open_ground_and_chunks(spark):
    flat = np.zeros((9, 9))
    canopy, trunk, bush, amax = tiles.vegetation(flat, flat + 1, flat)
    out = kernels.finish_sky_view(kernels.sky_view(flat, canopy, trunk, bush, amax), trunk)
    assert out["svf"].min() > 0.99 and (out["svfveg"] > 0.99).all()
    rng = np.random.default_rng(1)
    rows = [("t", r, c, 10.0 * ((r in (3, 4)) and c in (4, 5)), 0.0, 6.0 * (r == 8)) for r in range(12) for c in range(10)]
    df = spark.createDataFrame(rows, "tile string, row int, col int, dsm double, dem double, tree double")
    many = tiles.sky_view_factors(df, chunks=5).orderBy("row", "col").toPandas()
    dsm, tree = np.array([r[3] for r in rows]).reshape(12, 10), np.array([r[5] for r in rows]).reshape(12, 10)
    canopy, trunk, bush, amax = tiles.vegetation(dsm, dsm * 0, tree)
    one = kernels.finish_sky_view(kernels.sky_view(dsm, canopy, trunk, bush, amax), trunk)
    for n in ("svf", "svfS", "svfvegW", "svfaveg", "svfavegN", "svftotal"):
        assert np.allclose(many[n].to_numpy().reshape(12, 10), one[n]), n
    assert rng is not None


def test_labels_fill_rotation_and_wakes():
    mask = np.array([[1, 1, 0, 1], [0, 1, 0, 1], [1, 0, 0, 0]], bool)
    assert kernels.label(mask).tolist() == [[1, 1, 0, 2], [0, 1, 0, 2], [3, 0, 0, 0]]
    assert kernels.nearest_fill(np.array([[1.0, np.nan, np.nan, 4.0]])).tolist() == [[1, 1, 4, 4]]
    a = np.arange(12.0).reshape(3, 4)
    assert (kernels.rotate(kernels.rotate(a, 90), -90) == a).all()
    h = np.zeros((40, 21))
    h[10:13, 8:12] = 10
    w = kernels.building_wake(h, 0.0)
    assert w[13, 9] == 0 and 0 < w[16, 9] < w[20, 9] <= 1 and w[20, 1] == 1


def test_wind_coefficients_reach_the_simulation(spark):
    h = np.zeros((30, 40))
    h[12:18, 18:22] = 10
    w = kernels.building_wake(h, 90.0)  # wind from the east: the long wake lies to the west
    assert w[14, 17] == 0 and w[14, 10] < w[14, 29]
    assert np.allclose(kernels.building_wake(h[:, ::-1], 270.0)[:, ::-1], w)
    one = np.ones((30, 40))
    assert np.allclose(kernels.gaussian(one, 20.0), 1) and kernels.gaussian(np.eye(9), 1.0).sum() > 8.9
    trees = np.zeros((30, 40))
    trees[12:18, 18:22] = 8
    c = kernels.wind_coefficient(h * 0, trees, 0.0)
    assert c.min() >= 0.1 and c.max() <= 1 and c[15, 20] < c[0, 0]
    rows = [("t", r, k, float(h[r, k]), 0.0, 6.0 * (r == 2 and k == 3)) for r in range(30) for k in range(40)]
    df = spark.createDataFrame(rows, "tile string, row int, col int, dsm double, dem double, tree double")
    coef = api.build_wind_ext_coeff(df)
    line = "2009 223 %d 0 -999 -999 -999 -999 -999 3.0 60 20 101.3 0 0 -999 -999 -999 -999 -999 -999 -999 -999 {}"
    for wd, bin_ in (("350", 0), ("-999", None)):
        met = metfile.parse(spark.createDataFrame([(line.format(wd) % k,) for k in (0, 1)], "value string"))
        got = api.run_utci_tiles(df, met, 40.0, -74.0, outputs=("wind",), coefficients=coef).filter("step = 1").join(coef.filter(F.col("dir") == (bin_ or 0)), ["tile", "row", "col"]).toPandas()
        open_ = got.coef.notna()
        want = np.maximum(3 * got.coef, 0.15) if bin_ is not None else 3.0 + 0 * got.coef
        assert len(got) == 1200 and open_.sum() == 1200 - 24 and np.allclose(got.wind[open_], want[open_]) and got.coef[open_].min() < 0.97


def test_components_match_kernel(spark):
    rng = np.random.default_rng(6)
    mask = rng.random((15, 18)) > 0.5
    df = spark.createDataFrame([("a", r, c, bool(mask[r, c])) for r in range(15) for c in range(18)], "tile string, row int, col int, on boolean")
    out = grid.component_labels(df, "on", ["tile"]).orderBy("row", "col").toPandas()
    names = {}
    got = [0 if x != x else names.setdefault(x, len(names) + 1) for x in out.label]
    assert got == kernels.label(mask).ravel().tolist()


def test_components_of_long_arms(spark):
    cells = [("u", r, c) for r in range(200) for c in (0, 2)] + [("u", 199, 1)]
    cells += [("comb", r, c) for r in range(120) for c in range(0, 12, 3)] + [("comb", 120, c) for c in range(12)] + [("comb", 122, 0)]
    df = spark.createDataFrame([(*x, True) for x in cells], "tile string, row int, col int, on boolean")
    out = grid.component_labels(df, "on", ["tile"]).groupBy("tile", "label").count().collect()
    assert {tuple(r) for r in out} == {("u", 0, 401), ("comb", 0, 4 * 120 + 12), ("comb", 122 << 31, 1)}


def test_rasters_round_trip(spark, tmp_path):
    session.register(spark)
    rng = np.random.default_rng(2)
    bands = rng.normal(size=(3, 70, 33)).astype(np.float32)
    for compress in (True, False):
        r = geotiff.decode(geotiff.encode(geotiff.Raster(bands, [100, 2, 0, 500, 0, -2], ["a", "b", "c"]), compress))
        assert (r.bands == bands).all() and r.gt == [100, 2, 0, 500, 0, -2] and r.times == ["a", "b", "c"]
    rows = [("x.tif", b + 1, f"t{b}", i, j, float(bands[b, i, j])) for b in range(2) for i in range(70) for j in range(33)]
    px = spark.createDataFrame(rows, "file string, band int, time string, row int, col int, v double")
    geotiff.blocks(px, "v", [100.0, 2.0, 0.0, 500.0, 0.0, -2.0]).write.format("geotiff").mode("append").save(str(tmp_path / "r"))
    back = geotiff.pixels(spark.read.format("geotiff").load(str(tmp_path / "r")))
    assert back.count() == 2 * 70 * 33
    assert back.filter("band = 2 AND row = 69 AND col = 32").first().value == pytest.approx(float(bands[1, 69, 32]))
    assert spark.read.format("geotiff").option("metadataOnly", "true").load(str(tmp_path / "r")).select("rows", "cols").distinct().collect()[0] == (70, 33)


def test_netcdf_round_trip(spark, tmp_path):
    t2 = np.arange(24, dtype="f4").reshape(2, 3, 4)
    data = netcdf3.encode({"time": (["time"], np.array([0.0, 1.0]), {"units": "hours since 2024-01-01 00:00:00"}), "latitude": (["latitude"], np.array([1.0, 2.0, 3.0]), {}), "longitude": (["longitude"], np.array([5.0, 6.0, 7.0, 8.0]), {}), "t2m": (["time", "latitude", "longitude"], t2, {})})
    assert (netcdf3.decode(data)["t2m"]["data"] == t2).all()
    (tmp_path / "a.nc").write_bytes(data)
    out = netcdf3.with_time(netcdf3.read_grid(spark, str(tmp_path / "a.nc"), ["t2m"]))
    r = out.filter("iy = 2 AND ix = 3 AND t = 1").first()
    assert (r.t2m, r.lat, r.lon, str(r.time)) == (23.0, 3.0, 8.0, "2024-01-01 01:00:00")
    names = spark.createDataFrame([("x/wrfout_d02_2020-01-02_03:04:05",), ("wrfout_d01_2020-01-02_030405",), ("other",)], "p string").select(*netcdf3.wrf_name(F.col("p"))).collect()
    assert [(r[0], str(r[1])) for r in names] == [("d02", "2020-01-02 03:04:05"), ("d01", "2020-01-02 03:04:05"), (None, "None")]


def test_met_file_and_whole_workflow(spark, tmp_path):
    session.register(spark)
    rows = ["header"] + [f"2009 223 {h} 0 -999 -999 -999 -999 -999 1.5 60 {20 + h / 4:.2f} 101.3 0 {max(0, 800 * math.sin((h - 6) / 12 * math.pi)):.2f} -999 -999 -999 -999 -999 -999 -999 -999 -999" for h in range(0, 24, 6)]
    (tmp_path / "met.txt").write_text("\n".join(rows))
    met = metfile.read(spark, str(tmp_path / "met.txt"))
    assert met.count() == 4 and met.filter("it = 12").first().Kdn == 800
    with pytest.raises(ValueError):
        metfile.validate(met.limit(1))
    dsm = np.zeros((1, 12, 14), np.float32)
    dsm[0, 4:7, 5:8] = 9
    for name, a in (("Building_DSM", dsm), ("DEM", dsm * 0), ("Trees", dsm * 0)):
        (tmp_path / f"{name}.tif").write_bytes(geotiff.encode(geotiff.Raster(a)))
    cli.main(["--scene", str(tmp_path), "--met", str(tmp_path / "met.txt"), "--lat", "40", "--lon", "-74", "--utc-offset", "-5", "--outputs", "utci,tmrt,shadow", "--out", str(tmp_path / "out")])
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 4 * 12 * 14
    by = {r.step: r for r in out.groupBy("step").agg(F.avg("tmrt").alias("tmrt"), F.count_if(F.isnan("utci")).alias("none")).collect()}
    assert by[2].tmrt > by[0].tmrt + 15 and by[0].none == 9
    (tmp_path / "DEM.tif").write_bytes(geotiff.encode(geotiff.Raster(dsm[:, :5])))
    with pytest.raises(ValueError):
        api.build_inputs(spark, str(tmp_path))
    with pytest.raises(SystemExit):
        cli.main(["--scene", "x"])
    assert cli.boolean("Yes") and not cli.boolean("0")


def test_tiling_covers_and_overlaps(spark):
    df = spark.createDataFrame([(r, c) for r in range(10) for c in range(7)], "row int, col int")
    out = grid.tiles(df, 4, 2, 10, 7).groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("r0"), F.max("row").alias("r1")).toPandas().set_index("tile")
    assert set(out.index) == {"0_0", "0_4", "0_8", "4_0", "4_4", "4_8"}
    assert out.loc["0_0"].tolist() == [36, 0, 5] and out.loc["4_8"].tolist() == [6, 8, 9]
    assert {r.tile for r in grid.tiles(df, 10, 2, 10, 7).select("tile").distinct().collect()} == {"0_0"}


def test_query_tiles_overlap(spark):
    from heliogrid.plans import physics_queries as q

    rows = [(r, c, 20.0 * (20 <= r < 24 and 3 <= c < 6)) for r in range(40) for c in range(8)]
    df = spark.createDataFrame(rows, "row int, col int, h double")
    small = q._own(tiles.wake_coefficients(q._tiled(df, 20, 12), [180]), 20).withColumn("row", F.col("row") + 20 * F.col("tile"))
    whole = q._own(tiles.wake_coefficients(q._tiled(df), [180]))
    a, b = ({(r.row, r.col): r.coef for r in x.collect()} for x in (small, whole))
    assert len(a) == small.count() == 320 and a.keys() == b.keys()
    assert b[19, 4] < 0.1 and all(abs(a[k] - b[k]) < 1e-9 for k in a if k[0] < 20)
    assert {r.tile for r in q._tiled(df.withColumn("row", F.col("row") * 10)).select("tile").distinct().collect()} == {0}


def test_images_and_json():
    rgba = images.ramp(np.array([[0.0, 1.0, np.nan]]), 0, 1)
    assert rgba[0, 0, :3].tolist() == [49, 54, 149] and rgba[0, 2, 3] == 0
    assert images.png(rgba)[:8] == b"\x89PNG\r\n\x1a\n"
    assert images.canonical_json({"b": 1, "a": [1.5]}) == '{"a":[1.5],"b":1}'
    with pytest.raises(ValueError):
        images.canonical_json({"a": float("nan")})
    with pytest.raises(TypeError):
        images.canonical_json({1: 2})
    assert json.loads(images.canonical_json({"x": None})) == {"x": None}


def test_materials_and_median(spark):
    df = spark.createDataFrame([(7,), (5,), (42,)], "lc int")
    out = {r.lc: r for r in scene.materials(df, scene.land_cover_table(spark)).collect()}
    assert out[7].emissivity == 0.98 and out[5].albedo == 0.16 and out[42].albedo is None
    assert scene.lower_median(spark.createDataFrame([(1.0,), (2.0,), (9.0,), (10.0,)], "dem double")).first() == (2.0, 3.0)
    assert math.isnan(scene.lower_median(spark.createDataFrame([(1.0,), (float("nan"),)], "dem double")).first()[0])


def test_delay_stream_equals_batch(spark, tmp_path):
    from heliogrid.streaming import fold

    rows = [(k, s, 300.0 + 50 * math.sin(s / 5 + ord(k)), 2 <= s % 24 < 20, s % 24 == 2, 1 / 24) for k in "ab" for s in range(48)]
    schema = "tile string, step long, t0 double, day boolean, first boolean, dt double"
    df = spark.createDataFrame(rows, schema)
    for part in range(2):
        df.filter(F.floor(F.col("step") / 24) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = fold.publish(fold.thermal_delay(stream, "tile"), str(tmp_path / "out"), str(tmp_path / "cp"), {"v": 1}, ["tile"])
    q.awaitTermination()
    got = {(r.tile, r.step): r.delayed for r in spark.read.parquet(str(tmp_path / "out/data")).collect()}
    want = {(r.tile, r.step): r.delayed for r in timeline.thermal_delay(df, ["tile"], "step", "t0", "day", "first", "dt").collect()}
    assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (got[k] is None or abs(got[k] - want[k]) < 1e-9) for k in got)
    with pytest.raises(ValueError):
        fold.publish(fold.thermal_delay(stream, "tile"), str(tmp_path / "out"), str(tmp_path / "cp2"), {"v": 2}, ["tile"])


def _small_scene():
    rng = np.random.default_rng(8)
    dem = np.zeros((24, 20))
    dsm = dem.copy()
    dsm[8:13, 6:11] = 12.0
    tree = np.zeros_like(dem)
    tree[16, 4:8], tree[4, 15] = 9.0, 6.0
    return dsm + 0.01 * rng.random(dsm.shape), dem, tree


def test_patch_sums_match_loops_over_patches():
    """Long and short wave of a tile, against loops over the visibility cubes with arctangents."""
    from heliogrid.operators import kernels, simulation

    dsm, dem, tree = _small_scene()
    g = simulation.Geometry(dsm, dem, tree)
    sky = kernels.sky_view(dsm, g.canopy, g.trunk, g.bush, g.amax)
    sh, veg, behind = (sky[n].astype(float) for n in ("shmat", "vegshmat", "vbshvegshmat"))
    lv = np.linspace(1, 2, len(g.patches))
    lv /= lv.sum()
    met = {"altitude": 40.0, "azimuth": 130.0, "rad_i": 600.0, "rad_d": 120.0, "ta": 22.0}
    esky, t_wall, lup = 0.8, 6.0, np.full(dsm.shape, 420.0)
    walls = g.lit_walls(met)
    sr, air = g.steradian, simulation.SIGMA * (22.0 + 273.15) ** 4
    chi = lv * 120.0 / sum(x * s * np.sin(np.radians(p[2])) for x, s, p in zip(lv, sr, g.patches))
    _, sky_side = g.patch_sums(simulation._DIFFUSE, np.stack([lv, chi * g.side], 1))
    sun, shade = (0.2 * 600 * np.cos(np.radians(40)) + 60) / np.pi, 0.2 * 60 / np.pi
    leaf, warm = 0.9 * air / np.pi, 0.9 * simulation.SIGMA * (28.0 + 273.15) ** 4 / np.pi
    k_side = np.full(dsm.shape, 600 * np.cos(np.radians(40)))
    l_side, l_down, from_sky, blocked_side, blocked_down = (np.zeros(dsm.shape) for _ in range(5))
    for k, (_, _, alt, azi) in enumerate(g.patches):
        side, down = sr[k] * np.cos(np.radians(alt)), sr[k] * np.sin(np.radians(alt))
        edge = np.degrees(np.arctan(np.tan(g.asvf) + min(2 * np.cos(abs(np.radians(azi - 130.0))) * np.tan(np.radians(40)), 0)))
        v, b = veg[..., k], behind[..., k]
        wall = (sh[..., k] == 0) & (b == 1)
        leafy = (v == 0) | (b == 0)
        k_side += (sh[..., k] - (1 - v) * 0.97) * chi[k] * side + shade * leafy * side + wall * ((edge < alt) * sun + (edge > alt) * shade) * side
        flux = ((sh[..., k] == 1) & (v == 1)) * (1 - (1 - esky) * np.exp(0.308 * (1.7 - 1 / np.cos(np.radians(90 - alt))))) * air / np.pi
        from_sky += flux * down
        flux = flux + leafy * leaf + wall * ((edge < alt) * warm + (edge > alt) * leaf)
        l_side, l_down = l_side + flux * side, l_down + flux * down
        hidden = (sh[..., k] == 0) | (v == 0) | (b == 0)
        blocked_side, blocked_down = blocked_side + hidden * side, blocked_down + hidden * down
    bounce = (from_sky + lup) * 0.1 * 0.5 / np.pi
    assert kernels.TRANSMISSIVITY == pytest.approx(0.03)
    assert np.allclose(simulation._side_shortwave(g, met, np.ones(dsm.shape), sky_side, walls), k_side, rtol=1e-5)
    down_, side_ = simulation._longwave(g, met, esky, t_wall, lup, walls)
    assert np.allclose(down_, l_down + bounce * blocked_down, rtol=1e-5) and np.allclose(side_, l_side + bounce * blocked_side, rtol=1e-5)


def test_a_bush_leaves_its_own_pixel_open():
    from heliogrid.operators import kernels

    z = np.zeros((9, 9))
    bush = z.copy()
    bush[4, 4], bush[4, 6] = 3.0, 8.0
    canopy, trunk = bush.copy(), z.copy()
    _, veg, _ = kernels.sky_shadow(z, canopy, trunk, bush, 90.0, 60.0, 8.0)
    assert veg[4, 6] == 1 and veg[4, 4] == 0  # the taller one, to the east, hides the sun from the lower
    _, high, _ = kernels.sky_shadow(z, canopy, trunk, bush, 90.0, 85.0, 8.0)
    assert high[4, 4] == 1


def test_clearness_starts_anew_at_midnight():
    from heliogrid.operators import simulation

    g = simulation.Geometry(*_small_scene())
    night = {"ta": 15.0, "rh": 60.0, "altitude": -20.0, "azimuth": 0.0, "esky": 0.75, "dectime": 10.9, "va": 1.0, "wd": -999.0, "press": 101.3, "wanted": ("tmrt",)}
    state = simulation.State(clearness=0.5)
    cloudy = simulation.step(g, night, state)["ldown"]
    clear = simulation.step(g, night | {"dectime": 11.0}, state)["ldown"]
    assert state.clearness == 1.0 and (clear < cloudy).all()


def test_highest_sun_is_searched_in_quarters_of_an_hour(spark):
    from heliogrid.operators import simulation
    from heliogrid.sources import metfile

    rows = [("2009 223 %d 0 -999 -999 -999 -999 -999 1.5 60 20 101.3 0 %d -999 -999 -999 -999 -999 -999 -999 -999 -999" % (h, 300 if 6 < h < 18 else 0),) for h in range(0, 24, 4)]
    out = simulation.weather(metfile.parse(spark.createDataFrame(rows, "value string")), 40.0, -74.0, -5.0).collect()
    # At 40 N on 11 August the sun culminates near 90 - 40 + 15.1 degrees, between two rows of this timeline.
    assert {round(r.altmax, 6) for r in out} == {round(out[0].altmax, 6)} and out[0].altmax == pytest.approx(65.09, abs=0.05)
    assert max(r.altitude for r in out) < out[0].altmax


def test_land_cover_table_of_a_file(spark, tmp_path):
    (tmp_path / "lc.txt").write_text("Name Code Alb Emis Ts Tstart Tmax\nRoof 2 0.18 0.95 0.58 -9.78 15.0\r\n\n Water  7 0.05 0.98 0 0 12\n")
    rows = [tuple(r) for r in landcover.read(spark, str(tmp_path / "lc.txt")).orderBy("code").collect()]
    assert rows == [("Roof", 2, 0.18, 0.95, 0.58, -9.78, 15.0), ("Water", 7, 0.05, 0.98, 0.0, 0.0, 12.0)]


def test_tiles_sort_as_numbers_or_texts(spark):
    df = spark.createDataFrame([("100_0",), ("20_0",), ("20_100",), ("20_9",)], "tile string")
    assert [r[0] for r in grid.by_tile(df).collect()] == ["20_0", "20_9", "20_100", "100_0"]
    assert [r[0] for r in grid.by_tile(df, numeric=False).collect()] == ["100_0", "20_0", "20_100", "20_9"]


def test_multisets_differ_by_counts_and_nulls(spark):
    a = spark.createDataFrame([(1,), (1,), (None,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert {tuple(r) for r in compare.multiset_difference(a, b, ["x"]).collect()} == {(1, 1), (2, 1), (3, -1)}
    assert compare.multiset_difference(a, a, ["x"]).count() == 0


def test_cell_without_neighbours(spark):
    one = spark.createDataFrame([(0, 0, 40.0, -74.0), (0, 2, 40.0, -73.0)], "row int, col int, lat double, lon double")
    assert {tuple(r) for r in grid.cell_size(one).select("width", "height").collect()} == {(1e30, 1e30)}


def test_geojson_files_round_trip(spark, tmp_path):
    ring = [(0.0, 0.0), (2.5, 0.0), (2.5, 1.0), (0.0, 0.0)]
    f = spark.createDataFrame([(0, 12.5, ring), (1, 7.0, ring)], "idx int, value double, ring array<struct<x: double, y: double>>")
    vector.write_geojson(f, str(tmp_path / "g"))
    back = vector.from_geojson(spark.read.text(str(tmp_path / "g")), json="value").collect()
    assert {(r["value"], tuple(map(tuple, r["ring"]))) for r in back} == {(12.5, tuple(ring)), (7.0, tuple(ring))}


def test_files_are_found_by_direction_and_by_order(spark, tmp_path):
    for d in range(0, 360, 30):
        (tmp_path / f"WindCoeff_dir{d:03d}.tif").write_bytes(b"x")
    (tmp_path / "other.tif").write_bytes(b"x")
    files = discovery.listing(spark, str(tmp_path), "*.tif")
    assert sorted(r["direction"] for r in discovery.wind_rasters(files).collect()) == list(range(0, 360, 30))
    one = discovery.wind_rasters(discovery.listing(spark, str(tmp_path / "other.tif"))).collect()
    assert [(r["name"], r["direction"]) for r in one] == [("other.tif", None)]
    assert discovery.first_match(files, ["Building*.tif", "o*.tif", "*.tif"]).endswith("/other.tif")
    assert discovery.first_match(files, ["Wind*.tif"]).endswith("/WindCoeff_dir000.tif")
    assert discovery.first_match(files, ["none"]) is None
    (tmp_path / "WindCoeff_dir030.tif").unlink()
    with pytest.raises(FileNotFoundError, match="dir030"):
        discovery.wind_rasters(discovery.listing(spark, str(tmp_path), "*.tif"))


def test_archives_of_rasters_and_cubes(spark, tmp_path):
    a = np.arange(24, dtype=np.float32).reshape(4, 6)
    r = geotiff.Raster(bands=a[None], gt=[0.0, 1.0, 0.0, 0.0, 0.0, -1.0])
    with zipfile.ZipFile(tmp_path / "svfs.zip", "w") as z:
        z.writestr("svf.tif", geotiff.encode(r))
        z.writestr("note.txt", "no raster")
    rows = archives.read_rasters(spark, str(tmp_path / "svfs.zip")).orderBy("row").collect()
    assert np.array_equal([x["values"] for x in rows], a) and {(x["member"], x["band"]) for x in rows} == {("svf.tif", 0)}
    cube = np.arange(30, dtype=np.uint8).reshape(2, 3, 5)
    np.savez_compressed(tmp_path / "c.npz", shmat=cube, turned=np.asfortranarray(cube), one=np.float64(2.5))
    got = archives.read_cubes(spark, str(tmp_path / "c.npz")).orderBy("member", "row").collect()
    for name in ("shmat", "turned"):
        mine = [x for x in got if x["member"] == name]
        assert mine[0]["shape"] == [2, 3, 5] and np.array_equal(np.array([x["values"] for x in mine]).reshape(2, 3, 5), cube)
    assert [x["values"] for x in got if x["member"] == "one"] == [[2.5]]


def test_nearest_cell_of_odd_rows_copies_and_several_trees(spark):
    rng = np.random.default_rng(4)
    xy = np.r_[rng.integers(0, 40, (600, 2)) / 2, rng.normal(500, 1e-3, (60, 2))]  # copies, exact ties, a far cluster
    cells = [(int(k), float(x), float(y)) for k, (x, y) in zip(rng.permutation(len(xy)), xy)]
    odd = [(-1, None, 1.0), (-2, math.nan, 1.0), (None, 3.25, 3.25)]
    points = [(int(k), float(x), float(y)) for k, (x, y) in enumerate(np.r_[rng.integers(-20, 120, (300, 2)) / 4, rng.uniform(-900, 900, (200, 2))])]
    want = {}
    for k, x, y in points:
        d2, cell = min((float((x - a) ** 2 + (y - b) ** 2), c) for c, a, b in cells)
        want[k] = (cell, pytest.approx(d2))
    p = spark.createDataFrame([*points, (1000, None, 1.0), (1001, math.nan, 1.0)], "k long, lon double, lat double")
    c = spark.createDataFrame(cells + odd, "cell_id long, lon double, lat double")
    for bound in (100_000, 150):
        out = {r.k: (r.cell_id, r.d2) for r in grid.nearest_cell(p, c, "k", bound).collect()}
        assert out == want | {1000: (None, None), 1001: (None, None)}
    one = grid.nearest_cell(p, c.filter("cell_id < 0"), "k").filter("cell_id IS NULL AND d2 IS NULL")
    assert one.count() == len(points) + 2
    assert grid.nearest_cell(p, c.limit(0), "k").count() == 0


def test_nearest_grid_cell_makes_no_table_of_pairs(spark):
    from heliogrid.plans import met_queries

    plan = met_queries.nearest_grid_cell(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_cell_spacing_matches_all_pairs(spark):
    rng = np.random.default_rng(5)
    at = np.r_[rng.uniform([-180, -90], [180, 90], (80, 2)), rng.uniform(0, 1e-4, (40, 2)) + [10, 50], [[-170, -50]] * 2]  # a dense cluster, its antipode
    at = np.r_[at, at[rng.integers(0, 120, 60)]]  # copies of places
    cells = [(k, float(x), float(y)) for k, (x, y) in enumerate(at)]
    cells += cells[:7]  # repeated rows
    odd = [(None, 1.0, 1.0), (900, None, 3.0), (901, math.nan, 3.0)]
    schema = "cell_id long, lon double, lat double"
    c = spark.createDataFrame(cells, schema)
    m = grid.haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("m")
    pairs = c.alias("a").join(c.alias("b"), F.col("a.cell_id") != F.col("b.cell_id")).select("a.cell_id", m)
    want = {r.cell_id: (pytest.approx(r.x, abs=1e-6), pytest.approx(r.y, abs=0.2)) for r in pairs.groupBy("cell_id").agg(F.min("m").alias("x"), F.median("m").alias("y")).collect()}
    out = grid.cell_spacing(spark.createDataFrame(cells + odd, schema))
    assert {r.cell_id: (r.nearest_m, r.median_m) for r in out.collect()} == want | {900: (None, None), 901: (None, None)}
    assert grid.cell_spacing(c.filter("cell_id = 3")).count() == 0
    two = grid.cell_spacing(spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0)], schema)).collect()
    assert sorted(tuple(r) for r in two) == [(1, None, None), (2, None, None)]


def test_haversine_cell_size_makes_no_table_of_pairs(spark):
    from heliogrid.plans import met_queries

    plan = met_queries.haversine_cell_size(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
