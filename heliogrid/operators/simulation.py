"""The time-stepped comfort simulation over tiles.

Geometry (sky-view factors, cubes) is a tile's own and is computed once; weather is a timeline
of a few hundred rows, joined to every tile; the state carried from step to step are six
surface-flux maps and their clock.  A tile is one group: its steps run in time order within
one task, tiles run in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import comfort, humidity, solar
from ..functions.radiation import ABS_K, ABS_L, F_CYL, F_SIDE, F_UP
from ..functions.solar import SIGMA
from . import kernels, rays
from .columns import with_columns
from .scene import LAND_COVER
from .tiles import to_array, vegetation
from .timeline import daily_maximum_altitude

OUTPUTS = ("utci", "tmrt", "kdown", "kup", "ldown", "lup", "shadow", "wbgt", "ta", "wind")
ALBEDO_WALL, EMISSIVITY_WALL = 0.2, 0.9
_DIRS = "ESWN"
#: Pixels whose patches are summed at once, and wall patches that are compared at once.
_BLOCK, _ENTRIES = 8192, 2_000_000

# What a patch's code (see kernels.sky_view) means.
_SUN, _VEG, _BEHIND = np.arange(12) & 1, np.arange(12) >> 1 & 1, np.arange(12) >> 2
_DIFFUSE = _SUN - (1 - _VEG) * (1 - kernels.TRANSMISSIVITY)
_IS_SKY = (_SUN == 1) & (_VEG == 1)
_IS_VEG = (_VEG == 0) | (_BEHIND == 0)
_IS_WALL = (_SUN == 0) & (_BEHIND == 1)
_IS_BLOCKED = (_SUN == 0) | (_VEG == 0) | (_BEHIND == 0)


@dataclass
class State:
    """What a step hands to the next: flux maps, their clock, and the day flag."""

    maps: dict[str, np.ndarray] = field(default_factory=dict)
    clock: float = 0.0
    first_of_day: bool = True
    clearness: float = 1.0

    def delay(self, fluxes: dict[str, np.ndarray], dt: float) -> dict[str, np.ndarray]:
        """The thermal-wave delay of every map; all see the same clock."""
        limit, out = 59 / 1440, {}
        if self.first_of_day:
            self.maps = {k: v.copy() for k, v in fluxes.items()}
        long = self.clock >= limit
        k = math.exp(-33.27 * (self.clock if long else self.clock + dt))
        for name, now in fluxes.items():
            out[name] = now * (1 - k) + self.maps[name] * k
            if long:
                self.maps[name] = out[name]
        self.clock = (dt if dt > limit else 0.0) if long else self.clock + dt
        self.first_of_day = False
        return out

    def night(self) -> None:
        self.clock, self.first_of_day = 0.0, True


class Geometry:
    """A tile's fixed fields: surface, vegetation, walls, sky view and patch visibility."""

    def __init__(self, dsm, dem, tree, lc=None, option: int = 2, scale: float = 1.0, coefficients=None):
        self.scale, self.option = scale, option
        self.coefficients = coefficients or {}  # wind, by direction bin
        self.dsm = dsm
        self.canopy, self.trunk, self.bush, self.amax = vegetation(dsm, dem, tree)
        self.ground = (dsm - dem < 2).astype(float)
        rise = np.zeros_like(dsm)
        rise[1:-1, 1:-1] = np.maximum.reduce([dsm[:-2, 1:-1], dsm[2:, 1:-1], dsm[1:-1, :-2], dsm[1:-1, 2:]]) - dsm[1:-1, 1:-1]
        self.walls = np.where(rise < 3, 0.0, rise)
        self.aspect = np.radians(kernels.goodwin_aspect(self.walls, dsm, scale))
        sky = kernels.sky_view(dsm, self.canopy, self.trunk, self.bush, self.amax, option, scale, coded=True)
        self.code = sky.pop("code").reshape(dsm.size, -1)
        self.sky = kernels.finish_sky_view(sky, self.trunk)
        self.patches = rays.patches(option)
        self.steradian = np.array(rays.steradians(option))
        altitudes = np.radians([p[2] for p in self.patches])
        self.side, self.down = self.steradian * np.cos(altitudes), self.steradian * np.sin(altitudes)
        svf, svfveg = self.sky["svf"], self.sky["svfveg"]
        self.svfbuveg = svf - (1 - svfveg) * (1 - kernels.TRANSMISSIVITY)
        self.asvf = np.arccos(np.sqrt(np.clip(svf, 0, 1)))
        self.edge = np.tan(self.asvf).ravel()
        self.wall_px, self.wall_end = self._wall_pixels()
        fixed = np.stack([self.side, self.down], 1)
        self.veg_side, self.veg_down = self.patch_sums(_IS_VEG, fixed)
        self.blocked_side, self.blocked_down = self.patch_sums(_IS_BLOCKED, fixed)
        self.wall_side, self.wall_down = self.patch_sums(_IS_WALL, fixed)
        self.svfalfa = np.arcsin(np.sqrt(np.clip(1 - np.maximum(svf + svfveg - 1, 0), 0, 1)))
        props = {code: row for row in LAND_COVER for code in [row[1]]}
        shape = dsm.shape
        self.albedo, self.emissivity = np.full(shape, 0.15), np.full(shape, 0.95)
        self.tgk, self.tstart, self.tmax = np.full(shape, 0.37), np.full(shape, -3.41), np.full(shape, 15.0)
        if lc is not None:
            code = np.where((lc < 1) | (lc > 7), 6, np.where((lc == 3) | (lc == 4), 5, lc)).astype(int)
            for c in np.unique(code):
                _, _, alb, emis, k, start, latest = props[int(c)]
                at = code == c
                self.albedo[at], self.emissivity[at], self.tgk[at], self.tstart[at], self.tmax[at] = alb, emis, k, start, latest
        self.landcover = lc is not None

    def patch_sums(self, meaning: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """Per pixel, the sums over patches of what a code means, times each column of weights."""
        out = np.empty((len(self.code), weights.shape[1]), np.float32)
        meaning, weights = meaning.astype(np.float32), weights.astype(np.float32)
        for lo in range(0, len(out), _BLOCK):
            np.matmul(meaning[self.code[lo : lo + _BLOCK]], weights, out=out[lo : lo + _BLOCK])
        return [x.astype(float).reshape(self.dsm.shape) for x in out.T]

    def _wall_pixels(self) -> tuple[np.ndarray, np.ndarray]:
        """The pixels that see a wall, patch by patch, and where each patch's end."""
        at = [np.flatnonzero(_IS_WALL[self.code[:, k]]).astype(np.int32) for k in range(self.code.shape[1])]
        return np.concatenate(at), np.cumsum([len(x) for x in at])

    def lit_walls(self, met: dict) -> dict[str, np.ndarray]:
        """Per pixel, the weights of sunlit and of shaded wall patches, on the side and from above.

        A wall's edge is at arctan(edge + c) for a patch's c, so it is compared by its tangent.
        """
        alt = np.radians([p[2] for p in self.patches])
        turn = np.cos(np.abs(np.radians([p[3] - met["azimuth"] for p in self.patches])))
        limit = np.tan(alt) - np.minimum(2 * turn * math.tan(math.radians(met["altitude"])), 0)
        lit, even = np.zeros((2, self.dsm.size)), np.zeros((2, self.dsm.size))
        lo = 0
        starts = np.append(0, self.wall_end[:-1])
        while lo < len(limit):  # patches together, up to a bounded number of entries
            most = max(lo + 1, int(np.searchsorted(self.wall_end, starts[lo] + _ENTRIES, "right")))
            px = self.wall_px[starts[lo] : self.wall_end[most - 1]]
            k = np.repeat(np.arange(lo, most), self.wall_end[lo:most] - starts[lo:most])
            edge, at = self.edge[px], limit[k]
            for sums, hit in ((lit, np.flatnonzero(edge < at)), (even, np.flatnonzero(edge == at))):
                for total, weight in zip(sums, (self.side, self.down)):
                    if len(hit):
                        total += np.bincount(px[hit], weight[k[hit]], self.dsm.size)
            lo = most
        lit, even = lit.reshape(2, *self.dsm.shape), even.reshape(2, *self.dsm.shape)
        # A wall just at its edge is neither.
        return {"side_lit": lit[0], "down_lit": lit[1], "side_dark": self.wall_side - lit[0] - even[0], "down_dark": self.wall_down - lit[1] - even[1]}


def _ground_view(g: Geometry, shadow, t_ground, t_wall, ta, sun_wall):
    """Ground-view albedo and emission, in all and in the four directions."""
    emitted = SIGMA * g.emissivity * (ta + 273.15 + t_ground * shadow) ** 4 - SIGMA * g.emissivity * (ta + 273.15) ** 4
    wall_flux = SIGMA * EMISSIVITY_WALL * (ta + 273.15 + t_wall) ** 4 - SIGMA * EMISSIVITY_WALL * (ta + 273.15) ** 4
    names = ("lup", "alb", "albno")
    sums = {n + d: np.zeros_like(g.dsm) for n in names for d in ("", *_DIRS)}
    sunny = (sun_wall > 0).astype(float)
    spans = {"E": (0, 180), "S": (90, 270), "W": (180, 360), "N": (270, 90)}
    for azimuth in range(5, 360, 20):
        near, far = kernels.ground_view_gather(g.ground, shadow, g.albedo, emitted, sunny, float(azimuth), g.scale)
        parts = []
        for (s, wall), steps in ((near, 1), (far, int(22 * g.scale))):
            n_wall = steps - s[0]
            hit = wall.astype(float)
            count = steps + hit
            lup = (s[4] + wall_flux * n_wall * hit) / count
            parts.append((lup, (s[2] + ALBEDO_WALL * n_wall * hit) / count, (s[3] + ALBEDO_WALL * n_wall) / steps))
        mixed = [(0.5 * a + 0.4 * b) / 0.9 for a, b in zip(*parts)]
        for n, v in zip(names, mixed):
            sums[n] += v
            for d, (lo, hi) in spans.items():
                if (lo <= azimuth < hi) if lo < hi else (azimuth >= lo or azimuth < hi):
                    sums[n + d] += v
    base = SIGMA * g.emissivity * (ta + 273.15) ** 4
    out = {}
    for d in ("", *_DIRS):
        k = 18 if not d else 9
        out["lup" + d] = sums["lup" + d] / k + base
        out["alb" + d] = sums["alb" + d] / k
        out["albno" + d] = sums["albno" + d] / k
    return out


def step(g: Geometry, met: dict, state: State) -> dict[str, np.ndarray]:
    """One time step: fluxes, Tmrt and comfort of a tile.  ``met`` is a row of ``weather``."""
    ta, rh, altitude, azimuth = met["ta"], met["rh"], met["altitude"], met["azimuth"]
    svf, svfveg = g.sky["svf"], g.sky["svfveg"]
    shape = g.dsm.shape
    esky = met["esky"]
    if met["dectime"] % 1 == 0:  # a new day: nothing is known of the sky
        state.clearness = 1.0
    walls = g.lit_walls(met) if altitude > 0 else None
    if altitude > 0:
        rad_i, rad_d, rad_g = met["rad_i"], met["rad_d"], met["rad_g"]
        state.clearness = min(met["ci"], 1.0)
        visible, veg, _, _, wall_sun, _, _, _ = kernels.wall_shadow(g.dsm, g.walls, g.aspect, azimuth, altitude, g.scale, g.canopy, g.trunk, g.bush, g.amax)
        shadow = visible - (1 - veg) * (1 - met["psi"])
        day = met["dectime"] % 1 - met["sunrise"] / 24
        wave = lambda k, s, latest: (k * met["altmax"] + s) * np.sin(day / (latest / 24 - met["sunrise"] / 24) * math.pi / 2)
        t_ground = wave(g.tgk, g.tstart, g.tmax) * met["ci_tg"]
        t_ground = np.maximum(t_ground, 0) if g.landcover else t_ground
        t_wall = max(float(wave(0.58, -3.41, 15.0)), 0.0) * met["ci_tg"]
        view = _ground_view(g, shadow, t_ground, t_wall, ta, wall_sun)
        fluxes = state.delay({"lup" + d: view["lup" + d] for d in ("", *_DIRS)}, met["dt"])
        zen = math.radians(90 - altitude)
        f_sh = _wedge(zen, g.svfalfa)
        lv = np.array(met["luminance"])
        chi = lv * rad_d / (lv * g.down).sum()
        through, sky_side = g.patch_sums(_DIFFUSE, np.stack([lv, chi * g.side], 1))
        d_rad = rad_d * through
        bounce = ALBEDO_WALL * (1 - g.svfbuveg) * (rad_g * (1 - f_sh) + rad_d * f_sh)
        sin_a = math.sin(math.radians(altitude))
        kdown = rad_i * shadow * sin_a + d_rad + bounce
        kup = {d: view["alb" + d] * rad_i * sin_a + (rad_d * g.svfbuveg + bounce) * view["albno" + d] for d in ("", *_DIRS)}
        kside = _side_shortwave(g, met, shadow, sky_side, walls)
        k_sides = 0.5 * sum(kup[d] for d in _DIRS)
    else:
        state.night()
        t_wall, shadow = 0.0, np.zeros(shape)
        kdown = kside = k_sides = np.zeros(shape)
        kup = {"": np.zeros(shape)}
        base = SIGMA * g.emissivity * (ta + 273.15) ** 4
        fluxes = {"lup" + d: base for d in ("", *_DIRS)}
    if state.clearness < 0.95:
        esky = state.clearness * esky + (1 - state.clearness)
    ldown, lside = _longwave(g, met, esky, t_wall, fluxes["lup"], walls)
    l_sides = 0.5 * sum(fluxes["lup" + d] for d in _DIRS)
    absorbed = ABS_K * (kside * F_CYL + (kdown + kup[""]) * F_UP + k_sides * F_SIDE) + ABS_L * ((ldown + fluxes["lup"]) * F_UP + lside * F_CYL + l_sides * F_SIDE)
    tmrt = np.sqrt(np.sqrt(absorbed / (ABS_L * SIGMA))) - 273.2
    from_ = int((met["wd"] % 360 + 15) // 30 * 30) % 360 if met["wd"] >= 0 else None
    wind = np.maximum(g.coefficients.get(from_, 1.0) * met["va"] * np.ones(shape), 0.15)
    air = ta + met.get("uhi", 0.0)
    ground = g.ground > 0
    out = {"tmrt": tmrt, "kdown": kdown, "kup": kup[""], "ldown": ldown, "lup": fluxes["lup"], "shadow": shadow, "wind": wind, "ta": np.full(shape, air)}
    out["utci"] = np.where(ground, comfort.utci_array(air, rh, tmrt, wind), np.nan)
    if "wbgt" in met.get("wanted", OUTPUTS):
        p = (met["press"] if met["press"] > -999 else 101.3) * 1000
        t = air + 273.15
        e = rh / 100 * humidity.ES0 * (humidity.T0 / t) ** ((humidity.CPL - humidity.CPV) / humidity.RV) * math.exp(humidity.LV0 / (humidity.RV * humidity.T0) - (humidity.LV0 + (humidity.CPV - humidity.CPL) * (t - humidity.T0)) / (humidity.RV * t))
        tw = humidity.wet_bulb_array(p, t, humidity.EPS * e / (p - (1 - humidity.EPS) * e)) - 273.15
        tg = _globe(6.3 / 0.46821 * wind**0.6, tmrt, air)
        out["wbgt"] = np.where(shadow < 0.1, 0.7 * tw + 0.3 * tg, 0.7 * tw + 0.2 * tg + 0.1 * air)
    return out


def _globe(hcg, tmrt, ta, emissivity: float = 0.95):
    a = hcg / (emissivity * comfort.SIGMA_GLOBE)
    b = (tmrt + 273.15) ** 4 + a * (ta + 273.15)
    e = (9 * a**2 + 1.73205 * np.sqrt(27 * a**4 + 256 * b**3)) ** (1 / 3)
    k = 0.381571 * e - 3.4943 * b / e
    inner = np.maximum(2 * a / np.sqrt(np.maximum(k, np.finfo(float).tiny)) - k, 0)
    return 0.5 * np.sqrt(inner) - 0.5 * np.sqrt(np.maximum(k, 0)) - 273.15


def _wedge(zen: float, alfa: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        ta, tb = np.tan(alfa), math.tan(zen)
        ha, ba, qa = 2 / (ta * tb), 1 / ta, tb / 2
        xa = 1 - ha
        phi = np.arctan(np.sqrt(np.maximum(ba**2 - qa**2 / 4, 0)) / qa)
        a = (np.sin(phi) - phi * np.cos(phi)) / (1 - np.cos(phi))
        out = (2 * math.pi * ba - 2 * ba * ha - np.where(xa < 0, 2 * ba * xa * a, 0)) / (2 * math.pi * ba)
    return np.where(np.isfinite(out), out, 0.5)


def _side_shortwave(g: Geometry, met: dict, shadow, sky_side, walls: dict[str, np.ndarray]) -> np.ndarray:
    """Short-wave on the side of a cylinder: sun, anisotropic sky, sunlit and shaded walls, vegetation."""
    cos_alt = math.cos(math.radians(met["altitude"]))
    sun_wall = (ALBEDO_WALL * met["rad_i"] * cos_alt + 0.5 * met["rad_d"]) / math.pi
    shade_wall = ALBEDO_WALL * met["rad_d"] * 0.5 / math.pi
    return shadow * met["rad_i"] * cos_alt + sky_side + shade_wall * (g.veg_side + walls["side_dark"]) + sun_wall * walls["side_lit"]


def _longwave(g: Geometry, met: dict, esky: float, t_wall: float, lup, walls: dict[str, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Long-wave from above and on the side: sky, vegetation, walls, and what those reflect of the first pass."""
    zen = np.radians(90 - np.array([p[2] for p in g.patches]))
    emis = 1 - (1 - esky) * np.exp(0.308 * (1.7 - 1 / np.cos(zen)))
    air = SIGMA * (met["ta"] + 273.15) ** 4
    sky = emis * air / math.pi
    l_side, from_sky = g.patch_sums(_IS_SKY, np.stack([sky * g.side, sky * g.down], 1))
    leaf = EMISSIVITY_WALL * air / math.pi
    warm = EMISSIVITY_WALL * SIGMA * (met["ta"] + t_wall + 273.15) ** 4 / math.pi
    l_side, l_down = l_side + leaf * g.veg_side, from_sky + leaf * g.veg_down
    if walls is None:
        l_side, l_down = l_side + leaf * g.wall_side, l_down + leaf * g.wall_down
    else:
        l_side = l_side + warm * walls["side_lit"] + leaf * walls["side_dark"]
        l_down = l_down + warm * walls["down_lit"] + leaf * walls["down_dark"]
    reflected = (from_sky + lup) * (1 - EMISSIVITY_WALL) * 0.5 / math.pi
    return l_down + reflected * g.blocked_down, l_side + reflected * g.blocked_side


def weather(met: DataFrame, lat: float, lon: float, utc_offset: float = 0.0, option: int = 2) -> DataFrame:
    """The timeline with sun position, partition of radiation, clearness and patch luminance.

    ``met`` has the columns of a met file.  Solar time is half a step before the row's time.
    A timeline is small, and its windows run over one partition.
    """
    from pyspark.sql import Window

    w = Window.orderBy("dectime")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = met.select(*[F.col(c).cast("double").alias(c) for c in ("iy", "id", "it", "imin")], F.col("Td").alias("ta"), F.col("RH").alias("rh"), F.col("press").alias("press"), F.col("Kdn").alias("rad_g"), F.col("Wind").alias("va"), F.coalesce("Wd", F.lit(-999.0)).alias("wd"), F.coalesce("uhii", F.lit(0.0)).alias("uhi"))
    m = m.withColumn("dectime", F.col("id") + F.col("it") / 24 + F.col("imin") / 1440)
    m = m.withColumn("dt", F.coalesce(F.nth_value("dectime", 2).over(whole) - F.first("dectime").over(whole), F.lit(1 / 24)))
    j2000 = F.datediff(F.make_date(F.col("iy").cast("int"), F.lit(1), F.lit(1)), F.lit("2000-01-01").cast("date"))
    m = m.withColumns({"lat": F.lit(lat), "lon": F.lit(lon), "doy": F.col("id")})
    m = m.withColumn("days", j2000 + F.col("dectime") - 1 - F.col("dt") / 2 - 0.5 - utc_offset / 24)
    m = with_columns(m, solar.position_columns("days", "lat", "lon"))
    m = m.withColumn("zenith", F.when((F.col("sun_zenith") > 89) & (F.col("sun_zenith") <= 90), 89.0).otherwise(F.col("sun_zenith")))
    m = m.withColumns({"altitude": 90 - F.col("zenith"), "azimuth": F.col("sun_azimuth"), "zen": F.radians("zenith")})
    # The day's highest sun, searched in steps of 15 minutes; it is renewed at midnight and in the first row.
    quarters = m.select("iy", "id", "lat", "lon").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(95))))
    quarters = quarters.withColumn("days", j2000 + F.col("id") + F.col("k") / 96 - 1 - 0.5 - utc_offset / 24)
    quarters = with_columns(quarters, solar.position_columns("days", "lat", "lon"))
    quarters = quarters.select("iy", "id", (90 - F.col("sun_zenith")).alias("alt"), F.to_timestamp(F.format_string("2001-01-01 %02d:%02d:00", F.floor(F.col("k") / 4), F.col("k") % 4 * 15)).alias("ts"))
    m = m.join(F.broadcast(daily_maximum_altitude(quarters, "alt", ["iy", "id"], "ts")), ["iy", "id"], "left")  # a row a day
    renewed = (F.row_number().over(w) == 1) | (F.col("dectime") % 1 == 0)
    m = m.withColumn("altmax_", F.when(renewed, F.greatest("max_altitude", F.lit(0.0))))
    m = m.withColumn("altmax", F.last("altmax_", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    m = with_columns(m, solar.clearness_columns("zen", "doy", "ta", "(rh / 100e0)", "rad_g", "lat", "press"))
    m = with_columns(m, solar.diffuse_columns("rad_g", "altitude", "kt", "ta", "rh"))
    m = with_columns(m, [("esky", solar.sky_emissivity("ta", "rh")), ("sunrise", solar.sunrise("doy", "lat"))])
    clear = [(n.replace("rad_", "r0_").replace("df_", "r0_f"), t.replace("df_", "r0_f")) for n, t in solar.diffuse_columns("i0", "altitude", "1e0", "ta", "rh")]
    m = with_columns(m, clear)
    m = m.withColumn("ci_tg", F.least(F.coalesce(F.try_divide("rad_g", F.col("r0_i") * F.sin(F.radians("altitude")) + F.col("r0_d")) + (1 - F.col("ci_corr")), F.lit(0.0)), F.lit(1.0)))
    m = with_columns(m, solar.perez_columns("least(zenith, 90e0)", "rad_d", "rad_i", "doy"))
    m = with_columns(m, SUN_TERMS).withColumn("lv_", F.when(F.col("altitude") > 0, F.transform(sky_patches(option), lambda p: patch_luminance(p["path"], toward_sun(p)))))
    m = m.withColumn("s_", F.aggregate("lv_", F.lit(0.0), lambda t, x: t + x))
    m = m.withColumn("luminance", F.transform("lv_", lambda x: x / F.col("s_")))
    m = m.withColumn("psi", F.when((F.col("doy") > 97) & (F.col("doy") < 300), 0.03).otherwise(0.5)).withColumn("step", F.row_number().over(w) - 1)
    keep = ["step", "iy", "doy", "it", "imin", "dectime", "dt", "ta", "rh", "press", "va", "wd", "uhi", "altitude", "azimuth", "altmax", "rad_g", "rad_i", "rad_d", "ci", "ci_tg", "esky", "sunrise", "psi", "luminance"]
    return m.select(*keep)


def sky_patches(option: int = 2):
    """The patches of a division as an array of constants: azimuth z and the direction (east, north, up), path."""
    rad = math.radians
    fixed = [(z, math.cos(rad(a)) * math.sin(rad(z)), math.cos(rad(a)) * math.cos(rad(z)), math.sin(rad(a)), 1 / math.cos(rad(90 - a))) for _, _, a, z in rays.patches(option)]
    return F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("z", "east", "north", "up", "path"), p)]) for p in fixed])


#: The sun's direction, from pz_alt and azimuth.
SUN_TERMS = [("east_", "cos(pz_alt) * sin(radians(azimuth))"), ("north_", "cos(pz_alt) * cos(radians(azimuth))"), ("up_", "sin(pz_alt)")]


def toward_sun(p):
    """The cosine of the angle between a patch of ``sky_patches`` and the sun."""
    return p["east"] * F.col("east_") + p["north"] * F.col("north_") + p["up"] * F.col("up_")


def patch_luminance(path, toward):
    """Relative luminance of a patch under the sky of ``solar.perez_columns``."""
    g = F.acos(F.least(F.greatest(toward, F.lit(-1.0)), F.lit(1.0)))
    return (1 + F.col("pz_a") * F.exp(F.col("pz_b") * path)) * (1 + F.col("pz_c") * F.exp(F.col("pz_d") * g) + F.col("pz_e") * toward * toward)


def simulate(scene: DataFrame, timeline: DataFrame, outputs: tuple[str, ...] = ("utci",), key: str = "tile", landcover: bool = False, scale: float = 1.0, option: int = 2, coefficients: DataFrame | None = None) -> DataFrame:
    """Run all steps on every tile: key, step, row, col and the requested outputs.

    coefficients (key, dir, row, col, coef) scale the wind by its direction's bin of 30 degrees; 1 where none is given.

    The timeline is broadcast to tasks as plain rows: its length is a number of hours.
    """
    rows = [r.asDict() for r in timeline.orderBy("step").collect()]
    shared = scene.sparkSession.sparkContext.broadcast(rows)
    bins = range(0, 360, 30) if coefficients is not None else ()
    unknown = set(outputs) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"no such outputs: {sorted(unknown)}")

    def run(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        g = Geometry(*(to_array(table, n) for n in ("dsm", "dem", "tree")), to_array(table, "lc") if landcover else None, option, scale, {d: to_array(table, f"coef{d}", 1.0) for d in bins})
        at = table.select([key, "row", "col"]).to_batches()
        del table
        state = State()
        for met in shared.value:  # a step is given out before the next is computed
            made = step(g, {k: (0.0 if v is None else v) for k, v in met.items()} | {"wanted": outputs}, state)
            for b in at:
                row, col = b.column(1).to_numpy(), b.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(b), met["step"], np.int32)), b.column(1), b.column(2), *(pa.array(made[n][row, col]) for n in outputs)], names=[key, "step", "row", "col", *outputs])

    kind = scene.schema[key].dataType.simpleString()
    inputs = [F.col(c).cast("double").alias(c) for c in ("dsm", "dem", "tree", *(["lc"] if landcover else []))]
    picked = scene.select(key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *inputs)
    if coefficients is not None:
        wide = coefficients.groupBy(key, "row", "col").agg(*[F.first(F.when(F.col("dir") == d, F.col("coef")), True).alias(f"coef{d}") for d in bins])
        picked = picked.join(wide, [key, "row", "col"], "left")
        picked = picked.withColumns({f"coef{d}": F.when(F.col(f"coef{d}").isNull(), 1.0).otherwise(F.col(f"coef{d}")) for d in bins})
    return picked.groupBy(key).applyInArrow(run, f"{key} {kind}, step int, row int, col int, " + ", ".join(f"{n} double" for n in outputs))
