"""Tile kernels on NumPy arrays: shadows, sky-view factors, ground view, walls, components.

A kernel sees one logical tile, because a ray at low sun crosses all of it.  Kernels run in
``applyInArrow`` groups keyed by tile, or by tile and a chunk of sky patches.
"""

from __future__ import annotations

import math

import numpy as np

from .rays import patch_weights, patches, ray_schedule, sky_azimuths

TRANSMISSIVITY = 0.03
#: What the discretisation leaves of a full hemisphere in the south and west quarters.
TAIL = 3.0459e-4


def shifted(a: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """a sampled at (row + dr, col + dc); 0 outside."""
    out = np.zeros_like(a)
    rows, cols = a.shape
    r0, r1, c0, c1 = max(0, -dr), min(rows, rows - dr), max(0, -dc), min(cols, cols - dc)
    if r0 < r1 and c0 < c1:
        out[r0:r1, c0:c1] = a[r0 + dr : r1 + dr, c0 + dc : c1 + dc]
    return out


def sky_shadow(dsm, canopy, trunk, bush, azimuth: float, altitude: float, amax: float, scale: float = 1.0):
    """Visibility of one sky direction past buildings, vegetation, and vegetation behind buildings.

    1 is visible; the third can be 2.  A bush does not hide the sky from its own pixel; a
    taller one on the ray does.
    """
    z = dsm
    bushy = bush > 1
    f, veg, behind = z.copy(), bushy.astype(float), np.zeros_like(z)
    tallest = np.zeros_like(z)
    for step, dr, dc, dz in ray_schedule(*z.shape, amax, azimuth, altitude, scale):
        low, top, bottom = shifted(z, dr, dc) - dz, shifted(canopy, dr, dc) - dz, shifted(trunk, dr, dc) - dz
        f = np.maximum(f, low)
        shade = f > z
        veg = np.maximum(veg, (top > z).astype(float) - (bottom > z))
        veg[(veg * shade) > 0] = 0
        behind = behind + veg
        if step == 1:
            gap = top - low
            gap[gap <= 0] = 1000
            veg[gap < dz] = 1
            veg = veg * (trunk > z)
            behind = np.zeros_like(z)
        if bushy.any() and ((top > z) & bushy).any():
            tallest = np.maximum(tallest, shifted(bush, dr, dc) - dz) * bushy
    shade = (f > z).astype(float)
    behind = (behind > 0) - veg
    if bushy.any():
        veg = np.maximum(veg - bushy + (tallest > bush), 0)
    return 1 - shade, 1 - (veg > 0), 1 - behind


def sky_view(dsm, canopy, trunk, bush, amax: float, option: int = 2, scale: float = 1.0, chosen=None, coded: bool = False) -> dict[str, np.ndarray]:
    """Sky-view factors and visibility cubes.  ``chosen`` limits the patches, for partial sums that add up.

    If coded, one cube holds all three visibilities, a byte a patch: first + 2 * second + 4 * third.
    """
    azimuths, weights = sky_azimuths(option), patch_weights(option)
    rows = patches(option)
    names = ("svf", "svfveg", "svfaveg")
    quarters = {"": None, "E": (0, 180), "S": (90, 270), "W": (180, 360), "N": (270, 90)}
    out = {n + q: np.zeros_like(dsm) for n in names for q in quarters}
    cubes = {n: [] for n in ("shmat", "vegshmat", "vbshvegshmat")}
    chosen = range(len(rows)) if chosen is None else chosen
    code = np.empty((*dsm.shape, len(chosen)), np.uint8) if coded else None
    for place, k in enumerate(chosen):
        azi = azimuths[k]
        visible = sky_shadow(dsm, canopy, trunk, bush, azi, rows[k][2], amax, scale)
        for name, v in zip(names, visible):
            for q, span in quarters.items():
                if span is None:
                    out[name] += weights[k][0] * v
                elif (span[0] <= azi < span[1]) if span[0] < span[1] else (azi >= span[0] or azi < span[1]):
                    out[name + q] += weights[k][1] * v
        if coded:
            code[..., place] = visible[0] + 2 * visible[1] + 4 * visible[2]
            continue
        for cube, v in zip(cubes.values(), visible):
            cube.append(v.astype(np.uint8))
    if coded:
        return out | {"code": code}
    return out | {n: np.stack(c, -1) if c else np.zeros((*dsm.shape, 0), np.uint8) for n, c in cubes.items()}


def finish_sky_view(fields: dict[str, np.ndarray], trunk: np.ndarray) -> dict[str, np.ndarray]:
    """Tail corrections, the clip at 1, and the total, once all patches are summed."""
    out = dict(fields)
    for q in "SW":
        out["svf" + q] = out["svf" + q] + TAIL
        for n in ("svfveg", "svfaveg"):
            out[n + q] = out[n + q] + np.where(trunk == 0, TAIL, 0)
    for n in list(out):
        if n.startswith("svf"):
            out[n] = np.minimum(out[n], 1)
    out["svftotal"] = out["svf"] - (1 - out["svfveg"]) * (1 - TRANSMISSIVITY)
    return out


def wall_shadow(dsm, walls, aspect, azimuth: float, altitude: float, scale: float = 1.0, canopy=None, trunk=None, bush=None, amax: float | None = None):
    """Ground shadow and heights of shaded and sunlit wall, with vegetation if given.

    ``aspect`` is in radians.  Returns shadow, veg, behind, wall_shade, wall_sun, wall_veg, face_shade, face_sun.
    """
    azi, alt = math.radians(azimuth), math.radians(altitude)
    z = dsm
    with_veg = canopy is not None
    f, veg = z.copy(), np.zeros_like(z)
    behind, height_veg = np.zeros_like(z), np.zeros_like(z)
    if with_veg:
        veg = (bush > 1).astype(float)
        height_veg = np.where(bush > 1, canopy, 0.0)
    top_z = amax if amax is not None else float(z.max())
    steps = ray_schedule(*z.shape, top_z, azimuth, altitude, scale)
    steps = [(0, 0, 0, 0.0), *steps] if with_veg else steps
    before = 0.0
    for _, dr, dc, dz in steps:
        f = np.maximum(f, shifted(z, dr, dc) - dz)
        if with_veg:
            c, t = shifted(canopy, dr, dc), shifted(trunk, dr, dc)
            flags = (c - dz > z).astype(int) + (t - dz > z) + (c - before > z) + (t - before > z)
            hit = ((flags > 0) & (flags < 4)).astype(float)
            veg = np.maximum(veg, hit)
            veg[(veg * (f > z)) > 0] = 0
            height_veg = np.maximum(height_veg, (c - dz) * (hit > 0))
            behind = behind + veg
            before = dz
    shade = (f > z).astype(float)
    # A wall faces the sun if its aspect is within 90 degrees of the sun's azimuth.
    lo, hi = azi - math.pi / 2, azi + math.pi / 2
    wall = walls > 0
    if lo < 0:
        away = wall & ~((aspect >= 0) & (aspect < hi) | (aspect >= lo + 2 * math.pi))
    elif hi > 2 * math.pi:
        away = wall & ~((aspect >= lo) | (aspect < hi - 2 * math.pi))
    else:
        away = wall & ~((aspect >= lo) & (aspect < hi))
    face_shade = away.astype(float)
    face_sun = (wall & ~away).astype(float)
    volume = f - z
    sun = np.clip(walls - volume, 0, None)
    sun[away] = 0
    wall_shade = walls - sun
    wall_veg = np.zeros_like(z)
    if with_veg:
        covered = np.clip(height_veg - z, 0, None)
        wall_veg = np.clip(np.minimum(covered, walls) - wall_shade, 0, None)
        wall_veg[wall_veg < 0] = 0
        sun = np.clip(sun - wall_veg, 0, None)
        wall_veg = np.minimum(wall_veg, walls)
        behind = (behind > 0) - veg
    return 1 - shade, 1 - (veg > 0), 1 - behind, wall_shade, sun, wall_veg, face_shade, face_sun


def ground_view_gather(buildings, shadow, albedo, emitted, sun_wall, azimuth: float, scale: float = 1.0, reach: int = 22, near: int = 1):
    """Sums along a ground ray until buildings block it: for the near and the whole reach.

    Returns, for each reach: samples seen, shadow, albedo * shadow, albedo, emission, and whether
    a sunlit wall was met.  Samples outside the tile keep the value met last.
    """
    azi = math.radians(azimuth)
    quarter = math.pi / 4
    by_row = quarter <= azi < 3 * quarter or 5 * quarter <= azi < 7 * quarter
    steps = int(reach * scale)
    rows, cols = buildings.shape
    f = buildings.copy()
    held = [buildings, shadow, albedo * shadow, albedo, emitted, sun_wall]
    last = [x.copy() for x in held]
    sums = [np.zeros_like(buildings, dtype=float) for _ in range(5)]
    wall = np.zeros_like(buildings, dtype=bool)
    snapshots = []
    for n in range(steps):
        if by_row:
            dc, dr = int(np.sign(math.sin(azi))) * n, -int(np.sign(math.cos(azi))) * abs(int(np.rint(n / math.tan(azi)))) if n else 0
        else:
            dc, dr = int(np.sign(math.sin(azi))) * abs(int(np.rint(n * math.tan(azi)))), -int(np.sign(math.cos(azi))) * n
        r0, r1, c0, c1 = max(0, -dr), min(rows, rows - dr), max(0, -dc), min(cols, cols - dc)
        if r0 < r1 and c0 < c1:
            for l, x in zip(last, held):
                l[r0:r1, c0:c1] = x[r0 + dr : r1 + dr, c0 + dc : c1 + dc]
        f = np.minimum(f, last[0])
        for s, x in zip(sums, (np.ones_like(f), *last[1:5])):
            s += f * x
        wall |= last[5] * f > 0
        if n + 1 == max(1, near):
            snapshots.append(([s.copy() for s in sums], wall.copy()))
    return snapshots[0], (sums, wall)


def goodwin_aspect(walls: np.ndarray, dsm: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Wall aspect (degrees) by line filters turned in steps of one degree; the first best angle wins.

    The sides' mean elevations say which of the two normals the wall faces.
    """
    half = max(1, int(math.floor((scale + 1e-10) * 9)) // 2)
    rows, cols = walls.shape
    mask = (walls > 0).astype(float)
    best, angle, side = np.zeros_like(mask), np.zeros_like(mask), np.zeros_like(mask)
    reach = range(-half, half + 1)
    for degrees in range(180):
        a = math.radians(degrees)
        line = [(int(np.rint(-k * math.cos(a))), int(np.rint(k * math.sin(a)))) for k in reach]
        score = sum(shifted(mask, r, c) for r, c in dict.fromkeys(line))
        normal = [(int(np.rint(k * math.sin(a))), int(np.rint(k * math.cos(a)))) for k in range(1, half + 1)]
        right = sum(shifted(dsm, r, c) for r, c in normal)
        left = sum(shifted(dsm, -r, -c) for r, c in normal)
        better = (mask > 0) & (score > best)
        best[better], angle[better] = score[better], degrees
        side[better] = (right > left)[better]
    out = np.where(side > 0, angle - 90, angle + 90)
    out = np.mod(np.where(mask > 0, out, 0), 360)
    edge = np.zeros_like(mask, bool)
    edge[half : rows - half - 1, half : cols - half - 1] = True
    gy, gx = np.gradient(dsm, 1 / scale)
    fallback = np.degrees(np.mod(-np.arctan2(gx, gy), 2 * np.pi))
    return np.where(mask > 0, np.where(edge, out, fallback), 0)


def label(mask: np.ndarray) -> np.ndarray:
    """4-connected components numbered from 1 in reading order; 0 is background."""
    rows, cols = mask.shape
    names = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    while True:
        new = names.copy()
        new[1:] = np.minimum(new[1:], names[:-1])
        new[:-1] = np.minimum(new[:-1], names[1:])
        new[:, 1:] = np.minimum(new[:, 1:], names[:, :-1])
        new[:, :-1] = np.minimum(new[:, :-1], names[:, 1:])
        new[~mask] = mask.size
        flat = np.append(new.ravel(), mask.size)
        new = flat[new]
        if (new == names).all():
            break
        names = new
    out = np.zeros(mask.shape, np.int64)
    out[mask] = np.searchsorted(np.unique(names[mask]), names[mask]) + 1
    return out


def rotate(a: np.ndarray, degrees: float, order: int = 1, fill: float = 0.0) -> np.ndarray:
    """Turn counter-clockwise to the full extent; quarter turns exactly, else nearest (0) or bilinear (1)."""
    turns = (degrees / 90) % 4
    if turns == int(turns):
        return np.rot90(a, int(turns)).copy()
    t = math.radians(degrees)
    rows, cols = a.shape
    h, w = int(round(abs(rows * math.cos(t)) + abs(cols * math.sin(t)))), int(round(abs(cols * math.cos(t)) + abs(rows * math.sin(t))))
    y, x = np.mgrid[0:h, 0:w].astype(float)
    y, x = y - (h - 1) / 2, x - (w - 1) / 2
    sy, sx = y * math.cos(t) + x * math.sin(t) + (rows - 1) / 2, -y * math.sin(t) + x * math.cos(t) + (cols - 1) / 2
    if order == 0:
        r, c = np.rint(sy).astype(int), np.rint(sx).astype(int)
        ok = (r >= 0) & (r < rows) & (c >= 0) & (c < cols)
        return np.where(ok, a[np.clip(r, 0, rows - 1), np.clip(c, 0, cols - 1)], fill)
    r, c = np.floor(sy).astype(int), np.floor(sx).astype(int)
    fy, fx = sy - r, sx - c
    ok = (sy >= 0) & (sy <= rows - 1) & (sx >= 0) & (sx <= cols - 1)
    g = lambda i, j: a[np.clip(i, 0, rows - 1), np.clip(j, 0, cols - 1)]
    mixed = g(r, c) * (1 - fy) * (1 - fx) + g(r + 1, c) * fy * (1 - fx) + g(r, c + 1) * (1 - fy) * fx + g(r + 1, c + 1) * fy * fx
    return np.where(ok, mixed, fill)


def center_fit(a: np.ndarray, shape: tuple[int, int], fill: float = 0.0) -> np.ndarray:
    """Cut or pad around the centre to a shape."""
    out = np.full(shape, fill, a.dtype)
    sr, sc = max(0, (a.shape[0] - shape[0]) // 2), max(0, (a.shape[1] - shape[1]) // 2)
    dr, dc = max(0, (shape[0] - a.shape[0]) // 2), max(0, (shape[1] - a.shape[1]) // 2)
    h, w = min(a.shape[0], shape[0]), min(a.shape[1], shape[1])
    out[dr : dr + h, dc : dc + w] = a[sr : sr + h, sc : sc + w]
    return out


def wake_lengths(height: float, width: float, depth: float) -> tuple[float, float]:
    """Lengths (m) of the wakes behind and in front of an obstacle."""
    ratio = depth / height
    back = 3.0 * 1.8 * width / (ratio**0.3 * (1 + 0.24 * ratio))
    return back, 1.5 * width / (1 + 0.8 * width / height)


def building_wake(heights: np.ndarray, direction: float, pixel: float = 1.0, base: np.ndarray | None = None) -> np.ndarray:
    """Wind coefficients behind and in front of obstacles for wind from ``direction`` (degrees).

    The scene is turned so that the wind blows down the columns.  In each column of a
    component the coefficient rises linearly from 0 over the wake behind every segment, up to
    the next segment, and by the power 1.5 over the wake in front of the first.  Where wakes
    meet, the least holds.  With ``base``, as for trees, wakes rise from the obstacle's own
    coefficient, which also holds on the obstacle.
    """
    turned = rotate(heights, direction, 1)
    mask = rotate((heights > 0).astype(float), direction, 0) > 0
    own = np.zeros_like(turned) if base is None else np.clip(rotate(base, direction, 1, fill=1.0), 0, 1)
    parts = label(mask)
    out = np.ones_like(turned)
    for k in range(1, parts.max() + 1):
        where = parts == k
        tall = turned[where & (turned > 0)]
        if not len(tall):
            continue
        cols, rows = np.flatnonzero(where.any(0)), np.flatnonzero(where.any(1))
        back, front = wake_lengths(float(tall.mean()), len(cols) * pixel, len(rows) * pixel)
        behind = np.clip(np.arange(math.ceil(back / pixel) + 1) * pixel / back, 0, 1)
        ahead = np.clip(np.arange(math.ceil(front / pixel) + 1) * pixel / front, 0, 1) ** 1.5
        for c in cols:
            on = np.flatnonzero(where[:, c])
            ends = on[np.append(np.diff(on) > 1, True)]
            nexts = np.append(on[1:][np.diff(on) > 1], out.shape[0])
            for end, stop in zip(ends, nexts):
                stop = min(end + 1 + len(behind), stop)
                rise = own[end, c] + (1 - own[end, c]) * behind[: max(0, stop - end - 1)]
                out[end + 1 : stop, c] = np.minimum(out[end + 1 : stop, c], rise)
            at = np.arange(on[0] - 1, max(-1, on[0] - 1 - len(ahead)), -1)
            out[at, c] = np.minimum(out[at, c], own[on[0], c] + (1 - own[on[0], c]) * ahead[: len(at)])
    if base is not None:
        out[mask] = own[mask]
    return np.clip(center_fit(rotate(out, -direction, 1, fill=1.0), heights.shape, 1.0), 0, 1)


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian mean over four sigma that repeats the border pixels beyond the border."""
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        padded = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        a = sum(x * padded.take(range(k, k + a.shape[axis]), axis) for k, x in enumerate(w))
    return a


def erode_disc(a: np.ndarray, radius: int) -> np.ndarray:
    """The least value in a disc; border pixels repeat beyond the border."""
    padded, out = np.pad(a, radius, mode="edge"), a.copy()
    for i in range(-radius, radius + 1):
        for j in range(-radius, radius + 1):
            if i * i + j * j <= radius * radius:
                np.minimum(out, padded[radius + i : radius + i + a.shape[0], radius + j : radius + j + a.shape[1]], out=out)
    return out


def tree_base(height: np.ndarray, z0_ref: float, least: float, most: float, z: float = 10.0) -> np.ndarray:
    """Coefficient at height z over or in the trees of each pixel (leaf area index 2, fully covered)."""
    den = math.log(max(z, 1.01 * z0_ref) / max(z0_ref, 1e-6)) or 1e-6
    h = np.maximum(height, 1e-6)
    z0, alpha = np.maximum(0.1 * h, 0.05), min(max(0.5 + 0.4 * 2.0, 0.2), 2.5)
    inside = np.exp(-alpha * np.maximum(0, 1 - z / h)) * np.log(np.maximum(0.3 * h / z0, 1.01)) / den
    ratio = (z - 0.7 * h) / z0
    over = np.log(np.where(ratio <= 1, 1.01, ratio)) / den
    return np.where(height > 0, np.clip(np.where(height > z, inside, over), least, most), 1.0)


def wind_coefficient(heights: np.ndarray, trees: np.ndarray, direction: float, pixel: float = 1.0, z0_ref: float = 0.03, least: float = 0.1, most: float = 1.0) -> np.ndarray:
    """Wakes of buildings and trees, smoothed over 6 m, then 40 m, between buildings; NaN on buildings."""
    floor, built, wooded = 0.01, heights > 0, trees > 0
    wakes = np.clip(building_wake(heights, direction, pixel), floor, most)
    if wooded.any():
        r = max(1, round(10 / pixel))
        base = np.clip(tree_base(trees, z0_ref, least, most), floor, most)
        base = np.where(wooded, erode_disc(base, r), base)
        behind = building_wake(trees, direction, pixel, base)
        behind = np.where(wooded, erode_disc(behind, r), behind)
        wakes = np.clip(wakes * np.clip(behind, floor, most), floor, most)
    out = np.where(built, np.nan, wakes)
    for window in (6.0, 40.0):
        sigma = max(window / (2 * pixel), 0.5)
        weight = gaussian((~built).astype(float), sigma)
        out = np.where(built | (weight <= 1e-6), np.nan, gaussian(np.where(np.isnan(out), 0.0, out), sigma) / np.maximum(weight, 1e-6))
    return np.clip(out, least, most)


def nearest_fill(a: np.ndarray) -> np.ndarray:
    """NaN cells take the value of the nearest valid cell (Euclidean; ties to the first in reading order)."""
    bad = np.isnan(a)
    if not bad.any() or bad.all():
        return a.copy()
    good = np.argwhere(~bad)
    values = a[~bad]
    out = a.copy()
    holes = np.argwhere(bad)
    for lo in range(0, len(holes), 256):
        part = holes[lo : lo + 256]
        d = ((part[:, None, :] - good[None, :, :]) ** 2).sum(-1)
        out[part[:, 0], part[:, 1]] = values[d.argmin(1)]
    return out
