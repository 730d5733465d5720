"""Wind: components, direction bins, canopy coefficients, heat-island amplitude."""

from __future__ import annotations

import math

from .expr import case, clip, num, wrap


def speed(u: str, v: str) -> str:
    return f"sqrt({u} * {u} + {v} * {v})"


def direction(u: str, v: str) -> str:
    """Direction the wind blows from, degrees clockwise from north; 0 in calm air."""
    return case((f"{speed(u, v)} > 0.01e0", wrap(f"270e0 - degrees(atan2({v}, {u}))", 360)), other="0e0")


def to_earth(u: str, v: str, cosa: str, sina: str) -> tuple[str, str]:
    """Grid-relative components as earth-relative ones."""
    return f"({u} * {cosa} - {v} * {sina})", f"({v} * {cosa} + {u} * {sina})"


def direction_bin(wd: str) -> str:
    """The nearest multiple of 30 degrees, as integer in 0..330."""
    turned = wrap(wd, 360)
    return f"CAST({wrap(f'CAST(floor(({turned} + 15e0) / 30e0) AS DOUBLE) * 30e0', 360)} AS INTEGER)"


def effective(coefficient: str, u: str, least: float = 0.15) -> str:
    return f"greatest({coefficient} * {u}, {num(least)})"


def align_longitude(lon: str, grid_east: bool) -> str:
    """Longitude in the grid's convention: 0..360 if grid_east, else -180..180."""
    if grid_east:
        return case((f"{lon} < 0e0", f"{lon} + 360e0"), other=lon)
    return case((f"{lon} > 180e0", f"{lon} - 360e0"), other=lon)


def _reference_log(z: float, z0_ref: float) -> float:
    return math.log(max(z, 1.01 * z0_ref) / max(z0_ref, 1e-6)) or 1e-6


def tree_coefficient(h: str, share: str, z: float = 10.0, z0_ref: float = 0.7, lai: float = 4.0, a0: float = 0.5, a1: float = 0.2) -> str:
    """Wind at height z over or in a canopy of mean height h and plan share, relative to open land."""
    den = num(_reference_log(z, z0_ref))
    hh, z0 = f"greatest({h}, 1e-6)", f"greatest(0.1e0 * greatest({h}, 1e-6), 0.05e0)"
    alpha = clip(f"({num(a0)} + {num(a1)} * {num(lai)} * {clip(share, 0, 1)})", 0.6, 3.5)
    inside = f"exp(-{alpha} * greatest(0e0, 1e0 - {num(z)} / {hh})) * ln(greatest(0.3e0 * {hh} / {z0}, 1.01e0)) / {den}"
    over = f"(({num(z)} - 0.7e0 * {hh}) / {z0})"
    outside = f"ln({case((f'{over} <= 1e0', '1.01e0'), other=over)}) / {den}"
    return clip(case((f"{clip(share, 0, 1)} <= 0e0", "1e0"), (f"{h} > {num(z)}", inside), other=outside), 0.01, 1.5)


def building_coefficient(h: str, frontal: str, z: float = 10.0, z0_ref: float = 0.7) -> str:
    """The same among buildings of mean height h and frontal area index; no lower clamp."""
    den = num(_reference_log(z, z0_ref))
    hh, z0, d = f"greatest({h}, 1e-6)", f"greatest(0.1e0 * {h}, 0.01e0)", f"greatest(0.7e0 * {h}, 0e0)"
    share = clip(frontal, 0, 1)
    inside = f"exp(9.6e0 * {share} * ({num(z)} / {hh} - 1e0)) * ln(greatest(({hh} - {d}) / {z0}, 1.01e0)) / {den}"
    over = f"(({num(z)} - {d}) / {z0})"
    outside = f"ln({case((f'{over} <= 1e0', '1.01e0'), other=over)}) / {den}"
    return clip(case((f"{share} <= 0e0", "1e0"), (f"{h} > {num(z)}", inside), other=outside), None, 1.5)


def heat_island_amplitude(mean_sw: str, dtr: str, mean_wind: str, rho_cp: float = 1.225 * 1005.0) -> str:
    """Daily maximum heat-island intensity (K)."""
    top = f"greatest({mean_sw} / {num(rho_cp)} * power({dtr}, 3e0), 0e0)"
    return f"coalesce(power({top} / {case((f'{mean_wind} > 1e0', mean_wind), other='1e0')}, 0.25e0), 0e0)"
