"""Sun geometry and short-wave partition.

The solar position uses the apparent ecliptic longitude from the sun's mean elements with
nutation and aberration, sidereal time, topocentric parallax and refraction; it stays
within about 0.01 degrees of the full periodic-term series between 1950 and 2050.
"""

from __future__ import annotations

from .expr import case, clip, horner, num, rad, ratio, wrap

ITOA = 1370.0
ITOA_PEREZ = 1367.0
SIGMA = 5.67051e-8

# Precipitable-water parameter by latitude band (0-10, ..., 80-90) and season
# (days 336-60, 61-152, 153-244, 245-335).
SEASON_G = [
    [3.37, 2.85, 2.8, 2.64],
    [2.99, 3.02, 2.7, 2.93],
    [3.6, 3.0, 2.98, 2.93],
    [3.04, 3.11, 2.92, 2.94],
    [2.7, 2.95, 2.77, 2.71],
    [2.52, 3.07, 2.67, 2.93],
    [1.76, 2.69, 2.61, 2.61],
    [1.6, 1.67, 2.24, 2.63],
    [1.11, 1.44, 1.94, 2.02],
]

# All-weather sky luminance, rows a1..a4, b1..b4, c1..c4, d1..d4, e1..e4, by clearness bin.
PEREZ = [
    [1.3525, -1.2219, -1.1, -0.5484, -0.6, -1.0156, -1.0, -1.05],
    [-0.2576, -0.773, -0.2515, -0.6654, -0.3566, -0.367, 0.0211, 0.0289],
    [-0.269, 1.4148, 0.8952, -0.2672, -2.5, 1.0078, 0.5025, 0.426],
    [-1.4366, 1.1016, 0.0156, 0.7117, 2.325, 1.4051, -0.5119, 0.359],
    [-0.767, -0.2054, 0.2782, 0.7234, 0.2937, 0.2875, -0.3, -0.325],
    [0.0007, 0.0367, -0.1812, -0.6219, 0.0496, -0.5328, 0.1922, 0.1156],
    [1.2734, -3.9128, -4.5, -5.6812, -5.6812, -3.85, 0.7023, 0.7781],
    [-0.1233, 0.9156, 1.1766, 2.6297, 1.8415, 3.375, -1.6317, 0.0025],
    [2.8, 6.975, 24.7219, 33.3389, 21.0, 14.0, 19.0, 31.0625],
    [0.6004, 0.1774, -13.0812, -18.3, -4.7656, -0.9999, -5.0, -14.5],
    [1.2375, 6.4477, -37.7, -62.25, -21.5906, -7.1406, 1.2438, -46.1148],
    [1.0, -0.1239, 34.8438, 52.0781, 7.2492, 7.5469, -1.9094, 55.375],
    [1.8734, -1.5798, -5.0, -3.5, -3.5, -3.4, -4.0, -7.2312],
    [0.6297, -0.5081, 1.5218, 0.0016, -0.1554, -0.1078, 0.025, 0.405],
    [0.9738, -1.7812, 3.9229, 1.1477, 1.4062, -1.075, 0.3844, 13.35],
    [0.2809, 0.108, -2.6204, 0.1062, 0.3988, 1.5702, 0.2656, 0.6234],
    [0.0356, 0.2624, -0.0156, 0.4659, 0.0032, -0.0672, 1.0468, 1.5],
    [-0.1246, 0.0672, 0.1597, -0.3296, 0.0766, 0.4016, -0.3788, -0.6426],
    [-0.5718, -0.219, 0.4199, -0.0876, -0.0656, 0.3017, -2.4517, 1.8564],
    [0.9938, -0.4285, -0.5562, -0.0329, -0.1294, -0.4844, 1.4656, 0.5636],
]
PEREZ_BINS = [1.065, 1.23, 1.5, 1.95, 2.8, 4.5, 6.2]


def declination(doy: str) -> str:
    """Degrees, by the day-length model."""
    return f"(-23.45e0 * cos(2e0 * pi() * ({doy} + 10e0) / 365e0))"


def day_length(doy: str, lat: str) -> str:
    """Hours of daylight."""
    soc = clip(f"(tan({rad(declination(doy))}) * tan({rad(lat)}))", -1, 1)
    return f"(12e0 + 24e0 * asin({soc}) / pi())"


def sunrise(doy: str, lat: str) -> str:
    return f"(12e0 - {day_length(doy, lat)} / 2e0)"


def sun_distance(doy: str) -> str:
    b = f"(2e0 * pi() * {doy} / 365e0)"
    return f"sqrt(1.00011e0 + 0.034221e0 * cos({b}) + 0.00128e0 * sin({b}) + 0.000719e0 * cos(2e0 * {b}) + 0.000077e0 * sin(2e0 * {b}))"


def position_columns(days: str, lat: str, lon: str) -> list[tuple[str, str]]:
    """Named expressions, each using the ones before, up to sun_zenith and sun_azimuth (degrees).

    ``days`` are days (UT) since 2000-01-01 12:00.
    """
    t = f"({days} / 36525e0)"
    return [
        ("sp_t", t),
        ("sp_m", rad(horner("sp_t", [357.52911, 35999.05029, -0.0001537]))),
        ("sp_c", f"({horner('sp_t', [1.914602, -0.004817, -0.000014])} * sin(sp_m) + (0.019993e0 - 0.000101e0 * sp_t) * sin(2e0 * sp_m) + 0.000289e0 * sin(3e0 * sp_m))"),
        ("sp_e", horner("sp_t", [0.016708634, -0.000042037, -0.0000001267])),
        ("sp_r", f"(1.000001018e0 * (1e0 - sp_e * sp_e) / (1e0 + sp_e * cos(sp_m + {rad('sp_c')})))"),
        ("sp_om", rad("(125.04e0 - 1934.136e0 * sp_t)")),
        ("sp_lam", rad(f"({horner('sp_t', [280.46646, 36000.76983, 0.0003032])} + sp_c - 0.00569e0 - 0.00478e0 * sin(sp_om))")),
        ("sp_eps", rad(f"({horner('sp_t', [23.439291, -0.0130042])} + 0.00256e0 * cos(sp_om))")),
        ("sp_ra", "atan2(cos(sp_eps) * sin(sp_lam), cos(sp_lam))"),
        ("sp_dec", "asin(sin(sp_eps) * sin(sp_lam))"),
        ("sp_st", rad(wrap(f"280.46061837e0 + 360.98564736629e0 * {days} - 0.00478e0 * sin(sp_om) * cos(sp_eps)", 360))),
        ("sp_h", f"(sp_st + {rad(lon)} - sp_ra)"),
        ("sp_par", f"({rad('(8.794e0 / 3600e0)')} / sp_r)"),
        ("sp_dh", f"atan2(-cos({rad(lat)}) * sin(sp_par) * sin(sp_h), cos(sp_dec) - cos({rad(lat)}) * sin(sp_par) * cos(sp_h))"),
        ("sp_dec2", f"atan2((sin(sp_dec) - sin({rad(lat)}) * sin(sp_par)) * cos(sp_dh), cos(sp_dec) - cos({rad(lat)}) * sin(sp_par) * cos(sp_h))"),
        ("sp_h2", "(sp_h - sp_dh)"),
        ("sp_e0", f"degrees(asin(sin({rad(lat)}) * sin(sp_dec2) + cos({rad(lat)}) * cos(sp_dec2) * cos(sp_h2)))"),
        ("sp_ref", case(("sp_e0 >= -0.26667e0 - 0.5667e0", f"1.02e0 / (60e0 * tan({rad('(sp_e0 + 10.3e0 / (sp_e0 + 5.11e0))')}))"), other="0e0")),
        ("sun_zenith", "(90e0 - sp_e0 - sp_ref)"),
        ("sun_azimuth", wrap(f"degrees(atan2(sin(sp_h2), cos(sp_h2) * sin({rad(lat)}) - tan(sp_dec2) * cos({rad(lat)}))) + 180e0", 360)),
    ]


def season_parameter(lat: str, doy: str) -> str:
    def by_season(g: list[float]) -> str:
        return case((f"{doy} > 335e0 OR {doy} <= 60e0", num(g[0])), (f"{doy} <= 152e0", num(g[1])), (f"{doy} <= 244e0", num(g[2])), other=num(g[3]))

    return case(*[(f"{lat} < {num(10 * (k + 1))}", by_season(g)) for k, g in enumerate(SEASON_G)], other="CAST(NULL AS DOUBLE)")


def clearness_columns(zen: str, doy: str, ta: str, rh: str, rad_g: str, lat: str, press_kpa: str) -> list[tuple[str, str]]:
    """Named expressions up to i0, ci, kt, i0et, ci_raw.  zen in radians, rh as fraction."""
    return [
        ("ci_p", case((f"{press_kpa} = -999e0", "1013e0"), other=f"{press_kpa} * 10e0")),
        ("ci_d", sun_distance(doy)),
        ("ci_m", f"(35e0 * cos({zen}) / sqrt(1224e0 * cos({zen}) * cos({zen}) + 1e0))"),
        ("ci_trpg", "(1.021e0 - 0.084e0 * sqrt(ci_m * (0.000949e0 * ci_p + 0.051e0)))"),
        ("ci_g", season_parameter(lat, doy)),
        ("ci_a", f"(17.27e0 * {ta} / (237.7e0 + {ta}) + ln({rh}))"),
        ("ci_td", "(237.7e0 * ci_a / (17.27e0 - ci_a) * 1.8e0 + 32e0)"),
        ("ci_u", "exp(0.1133e0 - ln(ci_g + 1e0) + 0.0393e0 * ci_td)"),
        ("ci_tw", "(1e0 - 0.077e0 * power(ci_u * ci_m, 0.3e0))"),
        ("i0", case((f"abs({zen}) > pi() / 2e0", "0e0"), other=f"coalesce({num(ITOA)} * cos({zen}) * ci_trpg * ci_tw * ci_d * power(0.935e0, ci_m), 0e0)")),
        ("ci_corr", f"(0.1473e0 * ln(90e0 - {zen} / pi() * 180e0) + 0.3454e0)"),
        ("ci_raw", ratio(rad_g, "i0")),
        ("ci", "(ci_raw + (1e0 - ci_corr))"),
        ("i0et", f"({num(ITOA)} * cos({zen}) * ci_d)"),
        ("kt", ratio(rad_g, "i0et")),
    ]


def diffuse_columns(rad_g: str, altitude: str, kt: str, ta: str, rh: str) -> list[tuple[str, str]]:
    """Named expressions up to rad_i (direct) and rad_d (diffuse).  altitude in degrees, rh in %."""
    sin_a = f"sin({rad(altitude)})"
    plain = case((f"{kt} <= 0.3e0", f"1.02e0 - 0.248e0 * {kt}"), (f"{kt} < 0.78e0", f"1.45e0 - 1.67e0 * {kt}"), other="0.147e0")
    full = case(
        (f"{kt} <= 0.3e0", f"1e0 - 0.232e0 * {kt} + 0.0239e0 * {sin_a} - 0.000682e0 * {ta} + 0.0195e0 * ({rh} / 100e0)"),
        (f"{kt} < 0.78e0", f"1.329e0 - 1.716e0 * {kt} + 0.267e0 * {sin_a} - 0.00357e0 * {ta} + 0.106e0 * ({rh} / 100e0)"),
        other=f"0.426e0 * {kt} - 0.256e0 * {sin_a} + 0.00349e0 * {ta} + 0.0734e0 * ({rh} / 100e0)",
    )
    share = case((f"{ta} IS NULL OR {rh} IS NULL OR {ta} <= -999e0 OR {rh} <= -999e0 OR isnan({ta}) OR isnan({rh})", plain), other=full)
    return [
        ("df_d", f"({rad_g} * ({share}))"),
        ("df_i", f"greatest(({rad_g} - df_d) / nullif({sin_a}, 0e0), 0e0)"),
        ("rad_i", case((f"{altitude} < 1e0 AND df_i > {rad_g}", rad_g), other="df_i")),
        ("rad_d", f"least(df_d, {rad_g})"),
    ]


def perez_columns(zen: str, rad_d: str, rad_i: str, doy: str) -> list[tuple[str, str]]:
    """Named expressions of the sky state at a solar zenith (degrees): pz_a .. pz_e and pz_alt."""
    z3 = "1.041e0 * power(pz_z, 3e0)"
    b = f"({doy} * 2e0 * pi() / 365e0)"
    mass = f"1e0 / sin(pz_alt) + 0.50572e0 * power(180e0 * pz_alt / pi() + 6.07995e0, -1.6364e0)"
    bins = case(*[(f"pz_clear < {num(x)}", str(k)) for k, x in enumerate(PEREZ_BINS)], other="7")

    def pick(row: int) -> str:
        return case(*[(f"pz_bin = {k}", num(PEREZ[row][k])) for k in range(7)], other=num(PEREZ[row][7]))

    def linear(name: str, row: int) -> list[tuple[str, str]]:
        return [(f"pz_{name}", f"({pick(row)} + {pick(row + 1)} * pz_z + pz_bright * ({pick(row + 2)} + {pick(row + 3)} * pz_z))")]

    c1, c2, c3 = (num(PEREZ[r][0]) for r in range(8, 11))
    d1, d2, d3, d4 = (num(PEREZ[r][0]) for r in range(12, 16))
    c_low = f"exp(power(pz_bright * ({c1} + {c2} * pz_z), {c3})) - 1e0"
    d_low = f"-exp(pz_bright * ({d1} + {d2} * pz_z)) + {d3} + pz_bright * {d4} * pz_bright"
    return [
        ("pz_z", rad(zen)),
        ("pz_alt", rad(f"(90e0 - {zen})")),
        ("pz_clear", f"((({rad_d} + {rad_i}) / ({rad_d} + {z3})) / (1e0 + {z3}))"),
        ("pz_i0", f"({num(ITOA_PEREZ)} * (1.00011e0 + 0.034221e0 * cos({b}) + 0.00128e0 * sin({b}) + 0.000719e0 * cos(2e0 * {b}) + 0.000077e0 * sin(2e0 * {b})))"),
        ("pz_mass", case((f"pz_alt >= {num(3.141592653589793 / 18)}", "1e0 / sin(pz_alt)"), other=mass)),
        ("pz_bright", case((f"{rad_d} <= 10e0", "0e0"), other=f"pz_mass * {rad_d} / pz_i0")),
        ("pz_bin", f"CAST({bins} AS INTEGER)"),
        *linear("a", 0),
        *linear("b", 4),
        *linear("e", 16),
        ("pz_c", case(("pz_bin > 0", linear("c", 8)[0][1]), other=c_low)),
        ("pz_d", case(("pz_bin > 0", linear("d", 12)[0][1]), other=d_low)),
    ]


def patch_luminance(patch_alt: str, patch_azi: str, sun_azi: str) -> str:
    """Relative luminance of a sky patch (degrees) under the sky of perez_columns; divide by the sum over patches."""
    cos_g = f"(sin({rad(patch_alt)}) * sin(pz_alt) + cos(pz_alt) * cos({rad(patch_alt)}) * cos(abs({rad(patch_azi)} - {rad(sun_azi)})))"
    g = f"acos({clip(cos_g, -1, 1)})"
    return f"((1e0 + pz_a * exp(pz_b / cos({rad(f'(90e0 - {patch_alt})')}))) * (1e0 + pz_c * exp(pz_d * {g}) + pz_e * {cos_g} * {cos_g}))"


def vapour_hpa(ta: str, rh: str) -> str:
    return f"(6.107e0 * power(10e0, 7.5e0 * {ta} / (237.3e0 + {ta})) * {rh} / 100e0)"


def sky_emissivity(ta: str, rh: str, offset: float = 0.0) -> str:
    """Clear-sky emissivity from precipitable water."""
    w = f"(46.5e0 * {vapour_hpa(ta, rh)} / ({ta} + 273.15e0))"
    return f"(1e0 - (1e0 + {w}) * exp(-sqrt(1.2e0 + 3e0 * {w})) + {num(offset)})"


def cloudy_emissivity(esky: str, ci: str) -> str:
    return case((f"{ci} < 0.95e0", f"{ci} * {esky} + (1e0 - {ci})"), other=esky)


def band_emissivity(esky: str, altitude: str, model: int = 2) -> str:
    """Emissivity of the sky at an altitude (degrees), by one of three models."""
    zen = rad(f"(90e0 - {altitude})")
    if model == 1:
        return f"(0.67e0 + 0.094e0 * ln(exp({esky} / 0.094e0 - 0.67e0 / 0.094e0 - 0.5e0) / cos({zen})))"
    if model == 2:
        return f"(1e0 - (1e0 - {esky}) * exp(0.308e0 * (1.7e0 - 1e0 / cos({zen}))))"
    if model == 3:
        return f"(1e0 - power(1e0 - {esky}, 1e0 / (1.8e0 * cos({zen}))))"
    raise ValueError("model must be 1, 2 or 3")
