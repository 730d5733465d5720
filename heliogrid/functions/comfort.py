"""Thermal comfort indices: UTCI, globe temperature, WBGT."""

from __future__ import annotations

import numpy as np

from .expr import case, horner, num

# Coefficients of the published sixth-order UTCI approximation, of
# Ta^i va^j D^k Pa^l in the order of l, k, j, i, each from 0 with i + j + k + l <= 6.
UTCI_COEFFICIENTS = """
6.07562052E-01 -2.27712343E-02 8.06470249E-04 -1.54271372E-04 -3.24651735E-06 7.32602852E-08 1.35959073E-09
-2.25836520E+00 8.80326035E-02 2.16844454E-03 -1.53347087E-05 -5.72983704E-07 -2.55090145E-09 -7.51269505E-01
-4.08350271E-03 -5.21670675E-05 1.94544667E-06 1.14099531E-08 1.58137256E-01 -6.57263143E-05 2.22697524E-07
-4.16117031E-08 -1.27762753E-02 9.66891875E-06 2.52785852E-09 4.56306672E-04 -1.74202546E-07 -5.91491269E-06
3.98374029E-01 1.83945314E-04 -1.73754510E-04 -7.60781159E-07 3.77830287E-08 5.43079673E-10 -2.00518269E-02
8.92859837E-04 3.45433048E-06 -3.77925774E-07 -1.69699377E-09 1.69992415E-04 -4.99204314E-05 2.47417178E-07
1.07596466E-08 8.49242932E-05 1.35191328E-06 -6.21531254E-09 -4.99410301E-06 -1.89489258E-08 8.15300114E-08
7.55043090E-04 -5.65095215E-05 -4.52166564E-07 2.46688878E-08 2.42674348E-10 1.54547250E-04 5.24110970E-06
-8.75874982E-08 -1.50743064E-09 -1.56236307E-05 -1.33895614E-07 2.49709824E-09 6.51711721E-07 1.94960053E-09
-1.00361113E-08 -1.21206673E-05 -2.18203660E-07 7.51269482E-09 9.79063848E-11 1.25006734E-06 -1.81584736E-09
-3.52197671E-10 -3.36514630E-08 1.35908359E-10 4.17032620E-10 -1.30369025E-09 4.13908461E-10 9.22652254E-12
-5.08220384E-09 -2.24730961E-11 1.17139133E-10 6.62154879E-10 4.03863260E-13 1.95087203E-12 -4.73602469E-12
5.12733497E+00 -3.12788561E-01 -1.96701861E-02 9.99690870E-04 9.51738512E-06 -4.66426341E-07 5.48050612E-01
-3.30552823E-03 -1.64119440E-03 -5.16670694E-06 9.52692432E-07 -4.29223622E-02 5.00845667E-03 1.00601257E-06
-1.81748644E-06 -1.25813502E-03 -1.79330391E-04 2.34994441E-06 1.29735808E-04 1.29064870E-06 -2.28558686E-06
-3.69476348E-02 1.62325322E-03 -3.14279680E-05 2.59835559E-06 -4.77136523E-08 8.64203390E-03 -6.87405181E-04
-9.13863872E-06 5.15916806E-07 -3.59217476E-05 3.28696511E-05 -7.10542454E-07 -1.24382300E-05 -7.38584400E-09
2.20609296E-07 -7.32469180E-04 -1.87381964E-05 4.80925239E-06 -8.75492040E-08 2.77862930E-05 -5.06004592E-06
1.14325367E-07 2.53016723E-06 -1.72857035E-08 -3.95079398E-08 -3.59413173E-07 7.04388046E-07 -1.89309167E-08
-4.79768731E-07 7.96079978E-09 1.62897058E-09 3.94367674E-08 -1.18566247E-09 3.34678041E-10 -1.15606447E-10
-2.80626406E+00 5.48712484E-01 -3.99428410E-03 -9.54009191E-04 1.93090978E-05 -3.08806365E-01 1.16952364E-02
4.95271903E-04 -1.90710882E-05 2.10787756E-03 -6.98445738E-04 2.30109073E-05 4.17856590E-04 -1.27043871E-05
-3.04620472E-06 5.14507424E-02 -4.32510997E-03 8.99281156E-05 -7.14663943E-07 -2.66016305E-04 2.63789586E-04
-7.01199003E-06 -1.06823306E-04 3.61341136E-06 2.29748967E-07 3.04788893E-04 -6.42070836E-05 1.16257971E-06
7.68023384E-06 -5.47446896E-07 -3.59937910E-08 -4.36497725E-06 1.68737969E-07 2.67489271E-08 3.23926897E-09
-3.53874123E-02 -2.21201190E-01 1.55126038E-02 -2.63917279E-04 4.53433455E-02 -4.32943862E-03 1.45389826E-04
2.17508610E-04 -6.66724702E-05 3.33217140E-05 -2.26921615E-03 3.80261982E-04 -5.45314314E-09 -7.96355448E-04
2.53458034E-05 -6.31223658E-06 3.02122035E-04 -4.77403547E-06 1.73825715E-06 -4.09087898E-07 6.14155345E-01
-6.16755931E-02 1.33374846E-03 3.55375387E-03 -5.13027851E-04 1.02449757E-04 -1.48526421E-03 -4.11469183E-05
-6.80434415E-06 -9.77675906E-06 8.82773108E-02 -3.01859306E-03 1.04452989E-03 2.47090539E-04 1.48348065E-03
"""

# Saturation vapour pressure, exponents -2 to 4 of the temperature and its logarithm.
SATURATION = [-2.8365744e3, -6.028076559e3, 1.954263612e1, -2.737830188e-2, 1.6261698e-5, 7.0229056e-10, -1.8680009e-13]
SATURATION_LN = 2.7150305
SENTINEL = -999.0
SIGMA_GLOBE = 5.670374419e-8


def _nested(degree: int, values: list[float]):
    """Coefficients as nested lists by l, k, j, i."""
    it = iter(values)
    return [[[[next(it) for _ in range(degree + 1 - p - d - v)] for v in range(degree + 1 - p - d)] for d in range(degree + 1 - p)] for p in range(degree + 1)]


COEFFICIENTS = _nested(6, [float(x) for x in UTCI_COEFFICIENTS.split()])


def polynomial(ta: str, va: str, d: str, pa: str) -> str:
    """The polynomial's offset from air temperature, by Horner's rule in every variable."""
    return horner(pa, [horner(d, [horner(va, [horner(ta, i) for i in j]) for j in k]) for k in COEFFICIENTS])


def saturation_hpa(ta: str) -> str:
    """Saturation vapour pressure over water (hPa) at ta (deg C)."""
    tk = f"({ta} + 273.15e0)"
    terms = " + ".join(f"{num(g)} * power({tk}, {num(i - 2)})" for i, g in enumerate(SATURATION))
    return f"(exp({num(SATURATION_LN)} * ln({tk}) + {terms}) * 0.01e0)"


def vapour_kpa(ta: str, rh: str) -> str:
    return f"({saturation_hpa(ta)} * {rh} / 1000e0)"


def missing(*values: str) -> str:
    """Is any input the missing-value sentinel, or below it?"""
    return "(" + " OR ".join(f"{v} <= -999e0" for v in values) + ")"


def globe(hcg: str, tmrt: str, ta: str, emissivity: float = 0.95) -> str:
    """Black-globe temperature (deg C): the closed-form root of its heat balance."""
    a = f"({hcg} / {num(emissivity * SIGMA_GLOBE)})"
    b = f"(power({tmrt} + 273.15e0, 4e0) + {a} * ({ta} + 273.15e0))"
    e = f"power(9e0 * {a} * {a} + 1.73205e0 * sqrt(27e0 * power({a}, 4e0) + 256e0 * power({b}, 3e0)), {num(1 / 3)})"
    k = f"(0.381571e0 * {e} - 3.4943e0 * {b} / {e})"
    i = f"0.5e0 * sqrt(greatest(2e0 * {a} / sqrt(greatest({k}, 2.2250738585072014e-308)) - {k}, 0e0))"
    return f"({i} - 0.5e0 * sqrt(greatest({k}, 0e0)) - 273.15e0)"


def globe_coefficient(va: str) -> str:
    return f"({num(6.3 / 0.46821)} * power({va}, 0.6e0))"


def wbgt(tw: str, tg: str, ta: str, shadow: str) -> str:
    """Wet-bulb globe temperature; the sunlit weights hold where shadow < 0.1."""
    return case((f"{shadow} < 0.1e0", f"0.7e0 * {tw} + 0.3e0 * {tg}"), other=f"0.7e0 * {tw} + 0.2e0 * {tg} + 0.1e0 * {ta}")


# --- the same in NumPy, for tile kernels -------------------------------------------


def utci_array(ta, rh, tmrt, va) -> np.ndarray:
    """UTCI of arrays, -999 where an input is missing."""
    ta, rh, tmrt, va = np.broadcast_arrays(*(np.asarray(x, np.float64) for x in (ta, rh, tmrt, va)))
    bad = (ta <= -999) | (rh <= -999) | (tmrt <= -999) | (va <= -999)
    t = np.where(bad, 0.0, ta)
    tk = t + 273.15
    es = np.exp(SATURATION_LN * np.log(tk) + sum(g * tk ** (i - 2.0) for i, g in enumerate(SATURATION))) * 0.01
    pa, d, v = es * np.where(bad, 0, rh) / 1000, np.where(bad, 0, tmrt) - t, np.where(bad, 0, va)
    powers = np.stack([t**i for i in range(7)], -1)
    out = np.zeros_like(t)
    for k in reversed(COEFFICIENTS):
        by_d = np.zeros_like(t)
        for j in reversed(k):
            by_v = np.zeros_like(t)
            for i in reversed(j):
                by_v = by_v * v + powers[..., : len(i)] @ np.array(i)
            by_d = by_d * d + by_v
        out = out * pa + by_d
    return np.where(bad, SENTINEL, out + t)
