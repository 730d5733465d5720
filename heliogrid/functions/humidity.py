"""Moisture thermodynamics: humidity measures, dew point, wet-bulb temperature.

Temperatures are in K, pressures in Pa, specific humidities in kg/kg unless said.
"""

from __future__ import annotations

import numpy as np

from .expr import case, clip, horner, num

# Thermodynamic constants.
RD, RV = 287.0, 461.5
EPS = RD / RV
CPD, CPV, CPL, CPI = 1005.0, 2040.0, 4220.0, 2097.0
T0, ES0 = 273.16, 611.657
LV0, LF0 = 2.501e6, 0.333e6
LS0 = LV0 + LF0
T_LIQUID, T_ICE = 273.15, 253.15


def magnus_rh(t: str, td: str, a: float = 17.67, b: float = 243.5) -> str:
    """Relative humidity (%) from temperature and dew point (deg C), clipped to 0-100."""
    es = lambda x: f"exp(({num(a)} * ({x})) / (({x}) + {num(b)}))"
    return clip(f"(100e0 * {es(td)} / {es(t)})", 0, 100)


def magnus_rh_builder(t: str, td: str) -> str:
    """The same with the constants of the reanalysis builder."""
    return magnus_rh(t, td, 17.625, 243.04)


def mixing_ratio_rh(t2: str, q2: str, psfc: str) -> str:
    """Relative humidity (%) from temperature (K), mixing ratio and surface pressure."""
    eps = num(287.05 / 461.5)
    es = f"(611.2e0 * exp((17.67e0 * ({t2} - 273.15e0)) / (({t2} - 273.15e0) + 243.5e0)))"
    return clip(f"(({q2} * {psfc} / ({eps} + {q2})) / {es} * 100e0)", 0, 100)


def specific_heat(q: str) -> str:
    return f"((1e0 - {q}) * {num(CPD)} + {q} * {num(CPV)})"


def specific_heat_condensed(q: str, qt: str, omega: str) -> str:
    """With condensate: total water qt, of whose condensed part omega is ice."""
    return f"((1e0 - {qt}) * {num(CPD)} + {q} * {num(CPV)} + (1e0 - {omega}) * ({qt} - {q}) * {num(CPL)} + {omega} * ({qt} - {q}) * {num(CPI)})"


def latent_vaporisation(t: str) -> str:
    return f"({num(LV0)} + {num(CPV - CPL)} * ({t} - {num(T0)}))"


def latent_sublimation(t: str) -> str:
    return f"({num(LS0)} + {num(CPV - CPI)} * ({t} - {num(T0)}))"


def latent_mixed(t: str, omega: str) -> str:
    cpx = f"((1e0 - {omega}) * {num(CPL)} + {omega} * {num(CPI)})"
    return f"((1e0 - {omega}) * {num(LV0)} + {omega} * {num(LS0)} + ({num(CPV)} - {cpx}) * ({t} - {num(T0)}))"


def vapour_pressure(p: str, q: str) -> str:
    return f"({p} * {q} / ({num(EPS)} * (1e0 - {q}) + {q}))"


def _saturation(t: str, cpx: str, lx0: str) -> str:
    lx = f"({lx0} + ({num(CPV)} - {cpx}) * ({t} - {num(T0)}))"
    return f"({num(ES0)} * power({num(T0)} / {t}, ({cpx} - {num(CPV)}) / {num(RV)}) * exp({lx0} / {num(RV * T0)} - {lx} / ({num(RV)} * {t})))"


def saturation_pressure(t: str, phase: str = "liquid", omega: str = "0e0") -> str:
    """Saturation vapour pressure (Pa) over liquid, ice or a mixture with ice fraction omega."""
    if phase == "liquid":
        return _saturation(t, num(CPL), num(LV0))
    if phase == "ice":
        return _saturation(t, num(CPI), num(LS0))
    if phase == "mixed":
        return _saturation(t, f"((1e0 - {omega}) * {num(CPL)} + {omega} * {num(CPI)})", f"((1e0 - {omega}) * {num(LV0)} + {omega} * {num(LS0)})")
    raise ValueError("phase must be liquid, ice or mixed")


def saturation_humidity(p: str, t: str, phase: str = "liquid", omega: str = "0e0") -> str:
    es = saturation_pressure(t, phase, omega)
    return f"({num(EPS)} * {es} / ({p} - {num(1 - EPS)} * {es}))"


def relative_humidity(p: str, t: str, q: str, phase: str = "liquid", omega: str = "0e0") -> str:
    """As a fraction."""
    return f"({vapour_pressure(p, q)} / {saturation_pressure(t, phase, omega)})"


def ice_fraction(t: str) -> str:
    """Share of ice, a half cosine from all at 253.15 K to none at 273.15 K."""
    ramp = f"0.5e0 * (1e0 - cos(pi() * (({num(T_LIQUID)} - {t}) / {num(T_LIQUID - T_ICE)})))"
    return case((f"{t} <= {num(T_ICE)}", "1e0"), (f"{t} >= {num(T_LIQUID)}", "0e0"), other=ramp)


def ice_fraction_slope(t: str) -> str:
    """Its derivative by temperature (1/K)."""
    slope = f"-0.5e0 * (pi() / {num(T_LIQUID - T_ICE)}) * sin(pi() * (({num(T_LIQUID)} - {t}) / {num(T_LIQUID - T_ICE)}))"
    return case((f"{t} <= {num(T_ICE)} OR {t} >= {num(T_LIQUID)}", "0e0"), other=slope)


def humidity_from_rh(p: str, t: str, rh: str, phase: str = "liquid") -> str:
    """Specific humidity from relative humidity (%)."""
    e = f"({rh} / 100e0 * {saturation_pressure(t, phase, ice_fraction(t) if phase == 'mixed' else '0e0')})"
    return f"({num(EPS)} * {e} / ({p} - {num(1 - EPS)} * {e}))"


# Rational approximations of the lower branch of Lambert's W.
_W_NEAR = ([-7.874564067684664, -63.11879948166995, -168.6110850408981, -150.1089086912451], [15.97679839497612, 98.26612857148953, 293.9558944644677, 430.4471947824411, 247.8576700279611])
_W_MIDDLE = ([-1362.78381643109, -1386.04132570149, 11892.1649836015, 16904.0507511421], [251.440197724561, -1264.99554712435, -5687.63429510978, -2639.24130979048])
_W_FAR = ([1.01999365162218, -12.6917365519443, -45.1506015092455], [-22.9809693297808, -104.692066099727, -95.2085341727207])


def lambert_guess(x: str) -> str:
    """A first value of W-1(x) for x in [-1/e, 0), null elsewhere."""
    rational = lambda ab: f"({x} * {horner(x, ab[0])} / {horner(x, [1.0, *ab[1]])})"
    k1 = f"ln(-{x})"
    far = f"({rational(_W_FAR)} + {k1} - ln(-{k1}) + ln(-{k1}) / {k1})"
    return case(
        (f"{x} >= -0.3678794411714423e0 AND {x} < -0.34e0", f"({rational(_W_NEAR)} * ({x} + {num(np.exp(-1.0))}) - 1e0)"),
        (f"{x} >= -0.34e0 AND {x} < -0.1e0", rational(_W_MIDDLE)),
        (f"{x} >= -0.1e0 AND {x} < 0e0", far),
        other="CAST(NULL AS DOUBLE)",
    )


def lambert_refine(x: str, y: str) -> str:
    """One fourth-order correction of a value y of W-1(x)."""
    z = f"(ln({x} / {y}) - {y})"
    t = f"(2e0 * (1e0 + {y}) * (1e0 + {y} + {num(2 / 3)} * {z}))"
    return f"({y} * (1e0 + ({z} / (1e0 + {y})) * ({t} - {z}) / ({t} - 2e0 * {z})))"


def dewpoint_terms(t: str, rh: str, phase: str = "liquid") -> tuple[float, str]:
    """(alpha, x) with dew point = alpha / W-1(x), for a relative humidity as fraction."""
    cpx, lx0 = (CPL, LV0) if phase == "liquid" else (CPI, LS0)
    beta = (cpx - CPV) / RV
    alpha = -(1 / beta) * (lx0 + (cpx - CPV) * T0) / RV
    return alpha, f"(power({rh}, {num(1 / beta)}) * ({num(alpha)} / {t}) * exp({num(alpha)} / {t}))"


def wet_bulb_step(p: str, t: str, q: str, tw: str, qs: str, lv: str) -> str:
    """One Newton step for the isobaric wet-bulb temperature over liquid, given qs and lv at tw."""
    cpm = specific_heat(q)
    dq = f"({qs} * (1e0 - {qs} + {qs} / {num(EPS)}) * {lv} / ({num(RV)} * {tw} * {tw}))"
    f = f"({cpm} * ({t} - {tw}) * (1e0 - {qs}) - ({qs} - {q}) * {lv})"
    slope = f"(-({cpm} * ({t} - {tw}) + {lv}) * {dq} - {cpm} * (1e0 - {qs}) - ({qs} - {q}) * {num(CPV - CPL)})"
    return f"({tw} - {f} / {slope})"


def wet_bulb_columns(p: str, t: str, q: str, steps: int = 5) -> list[tuple[str, str]]:
    """Named expressions, each using the ones before: dew point td and wet bulb tw, both at most t.

    Newton's method gains digits quadratically; five steps leave far less than 0.001 K.
    """
    out = [("rh_", relative_humidity(p, t, q))]
    alpha, x = dewpoint_terms(t, "rh_")
    out += [("w_x", x), ("w_0", lambert_guess("w_x")), ("w_1", lambert_refine("w_x", "w_0")), ("td", f"least({num(alpha)} / w_1, {t})"), ("tw_0", f"({t} - {num(1 / 3)} * ({t} - {num(alpha)} / w_1))")]
    for k in range(steps):
        out += [(f"qs_{k}", saturation_humidity(p, f"tw_{k}")), (f"tw_{k + 1}", wet_bulb_step(p, t, q, f"tw_{k}", f"qs_{k}", latent_vaporisation(f"tw_{k}")))]
    return [*out, ("tw", f"least({t}, tw_{steps})")]


def wet_bulb_array(p, t, q, steps: int = 6) -> np.ndarray:
    """Wet-bulb temperature of arrays, by the same iteration started at the air temperature."""
    p, t, q = (np.asarray(x, np.float64) for x in (p, t, q))
    tw = t.copy()
    for _ in range(steps):
        lv = LV0 + (CPV - CPL) * (tw - T0)
        es = ES0 * (T0 / tw) ** ((CPL - CPV) / RV) * np.exp(LV0 / (RV * T0) - lv / (RV * tw))
        qs = EPS * es / (p - (1 - EPS) * es)
        cpm = (1 - q) * CPD + q * CPV
        dq = qs * (1 - qs + qs / EPS) * lv / (RV * tw * tw)
        f = cpm * (t - tw) * (1 - qs) - (qs - q) * lv
        tw = tw - f / (-(cpm * (t - tw) + lv) * dq - cpm * (1 - qs) - (qs - q) * (CPV - CPL))
    return np.minimum(t, tw)
