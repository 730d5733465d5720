"""Short- and long-wave balance of a pixel, and mean radiant temperature."""

from __future__ import annotations

from .expr import case, num, rad
from .solar import SIGMA

# Sky-view weight polynomial, from the constant upwards, and its whole.
WEIGHT = [0.0, -0.4863, 16.773, -70.424, 156.91, -161.51, 63.227]
WEIGHT_TOTAL = 4.4897
# A standing person as a cylinder.
ABS_K, ABS_L, F_SIDE, F_UP, F_CYL = 0.7, 0.95, 0.22, 0.06, 0.28


def _poly(x: str) -> str:
    terms = [f"{num(c)} * power({x}, {num(k)})" for k, c in enumerate(WEIGHT) if k]
    return "(" + " + ".join(terms) + ")"


def shortwave_weights(svf: str, svfveg: str) -> dict[str, str]:
    """Weights of walls and vegetation in the side short-wave fluxes."""
    only = f"(({num(WEIGHT_TOTAL)} - {_poly(svf)}) / {num(WEIGHT_TOTAL)})"
    both = f"(({num(WEIGHT_TOTAL)} - {_poly(f'({svfveg} + {svf} - 1e0)')}) / {num(WEIGHT_TOTAL)})"
    return {"wall": only, "veg": f"({both} - {only})"}


def longwave_weights(svf: str, svfveg: str, svfaveg: str) -> dict[str, str]:
    """Weights of vegetation, wall, sky and reflection in the side long-wave fluxes."""
    t = num(WEIGHT_TOTAL)
    bu = f"({svfveg} + {svf} - 1e0)"
    only = f"(({t} - {_poly(svf)}) / {t})"
    aveg = f"(({t} - {_poly(svfaveg)}) / {t})"
    refl = f"(({t} - {_poly(bu)}) / {t})"
    wall = f"({only} - {aveg})"
    return {"veg": f"({refl} - {wall})", "wall": wall, "sky": f"({_poly(bu)} / {t})", "reflected": refl}


def wedge_shadow(zen: str, svfalfa: str) -> str:
    """Shaded fraction of a cylindric wedge (zen, svfalfa in radians); 0.5 where undefined."""
    ta, tb = f"tan({svfalfa})", f"tan({zen})"
    ha = f"(2e0 / nullif({ta} * {tb}, 0e0))"
    xa, ba = f"(1e0 - {ha})", f"(1e0 / nullif({ta}, 0e0))"
    qa = f"({tb} / 2e0)"
    phi = f"atan(sqrt(greatest({ba} * {ba} - {qa} * {qa} / 4e0, 0e0)) / nullif({qa}, 0e0))"
    a = f"((sin({phi}) - {phi} * cos({phi})) / nullif(1e0 - cos({phi}), 0e0))"
    ukil = case((f"{xa} < 0e0", f"2e0 * {ba} * {xa} * {a}"), other="0e0")
    surface = f"(2e0 * {ba} * {ha} + {ukil})"
    return f"coalesce((2e0 * pi() * {ba} - {surface}) / (2e0 * pi() * {ba}), 0.5e0)"


def kdown(rad_i: str, shadow: str, altitude: str, d_rad: str, rad_g: str, rad_d: str, svfbuveg: str, f_sh: str, albedo: str) -> str:
    """Short-wave from above; d_rad is the diffuse part on the horizontal."""
    return f"({rad_i} * {shadow} * sin({rad(altitude)}) + {d_rad} + {albedo} * (1e0 - {svfbuveg}) * ({rad_g} * (1e0 - {f_sh}) + {rad_d} * {f_sh}))"


def kup(rad_i: str, rad_d: str, rad_g: str, altitude: str, svfbuveg: str, f_sh: str, gvf_albedo: str, gvf_albedo_open: str, albedo: str) -> str:
    """Short-wave from below: the same for each direction with its ground-view fields."""
    return f"({gvf_albedo} * {rad_i} * sin({rad(altitude)}) + ({rad_d} * {svfbuveg} + {albedo} * (1e0 - {svfbuveg}) * ({rad_g} * (1e0 - {f_sh}) + {rad_d} * {f_sh})) * {gvf_albedo_open})"


def _emit(t: str) -> str:
    return f"{num(SIGMA)} * power({t} + 273.15e0, 4e0)"


def ldown_isotropic(svf: str, svfveg: str, svfaveg: str, esky: str, ta: str, tg_wall: str, ewall: str, ci: str = "1e0") -> str:
    """Long-wave from an isotropic sky, vegetation and walls; below a clearness of 0.95 mixed with an overcast sky."""

    def sky(emissivity: str) -> str:
        walls = f"(2e0 - {svfveg} - {svfaveg}) * {ewall} * {_emit(ta)} + ({svfaveg} - {svf}) * {ewall} * {num(SIGMA)} * power({ta} + 273.15e0 + {tg_wall}, 4e0)"
        return f"(({svf} + {svfveg} - 1e0) * {emissivity} * {_emit(ta)} + {walls} + (2e0 - {svf} - {svfveg}) * (1e0 - {ewall}) * {emissivity} * {_emit(ta)})"

    return case((f"{ci} < 0.95e0", f"{sky(esky)} * {ci} + (1e0 - {ci}) * {sky('1e0')}"), other=sky(esky))


def sunlit(sun_alt: str, sun_azi: str, patch_alt: str, patch_azi: str, asvf: str) -> tuple[str, str]:
    """(sunlit, shaded): whether a wall patch lies below or above the sun's edge; on it, neither."""
    y = f"least(2e0 * cos(abs({rad(patch_azi)} - {rad(sun_azi)})) * tan({rad(sun_alt)}), 0e0)"
    edge = f"degrees(atan(tan({asvf}) + {y}))"
    return f"({edge} < {patch_alt})", f"({edge} > {patch_alt})"


def patch_surface(rad_i: str, rad_d: str, altitude: str, albedo: str) -> tuple[str, str]:
    """Radiance of sunlit and of shaded walls."""
    return f"(({albedo} * {rad_i} * cos({rad(altitude)}) + 0.5e0 * {rad_d}) / pi())", f"({albedo} * {rad_d} * 0.5e0 / pi())"


def absorbed(kside: str, k_down: str, k_up: str, k_sides: str, l_down: str, l_up: str, lside: str, l_sides: str) -> str:
    """Absorbed radiation of a standing cylinder; k_sides and l_sides are sums over the four directions."""
    short = f"{kside} * {num(F_CYL)} + ({k_down} + {k_up}) * {num(F_UP)} + {k_sides} * {num(F_SIDE)}"
    long = f"({l_down} + {l_up}) * {num(F_UP)} + {lside} * {num(F_CYL)} + {l_sides} * {num(F_SIDE)}"
    return f"({num(ABS_K)} * ({short}) + {num(ABS_L)} * ({long}))"


def tmrt(absorbed_flux: str) -> str:
    """Mean radiant temperature (deg C); the offset is 273.2 by convention."""
    return f"(sqrt(sqrt({absorbed_flux} / {num(ABS_L * SIGMA)})) - 273.2e0)"


def ground_temperature(tgk: str, tstart: str, tmaxlst: str, altmax: str, dectime: str, sunrise: str) -> str:
    """The day's temperature wave of a surface above air temperature (K)."""
    day = f"({dectime} - CAST(floor({dectime}) AS DOUBLE) - {sunrise} / 24e0)"
    return f"(({tgk} * {altmax} + {tstart}) * sin({day} / ({tmaxlst} / 24e0 - {sunrise} / 24e0) * pi() / 2e0))"
