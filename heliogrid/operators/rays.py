"""Sky patches, ray schedules and shadows.

Two forms.  The relational one joins pixels to a schedule of ray steps, a dimension of a few
hundred rows, shifts the key and aggregates; it shows the plan and serves small scenes.
For whole tiles, ``kernels`` runs the same recurrences on arrays, one tile (and a chunk of
sky patches) per task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Annuli, altitudes, first azimuths and patch counts of the sky divisions.
ANNULI = {1: [0, 12, 24, 36, 48, 60, 72, 84, 90], 4: [0, 4.5, 9, 15, 21, 27, 33, 39, 45, 51, 57, 63, 69, 75, 81, 90]}
ALTITUDES = {1: [6, 18, 30, 42, 54, 66, 78, 90], 4: [3, 9, 15, 21, 27, 33, 39, 45, 51, 57, 63, 69, 75, 81, 90]}
STARTS = {1: [0, 4, 2, 5, 8, 0, 10, 0], 4: [0, 0, 4, 4, 2, 2, 5, 5, 8, 8, 0, 0, 10, 10, 0]}
COUNTS = {
    1: [30, 30, 24, 24, 18, 12, 6, 1],
    2: [31, 30, 28, 24, 19, 13, 7, 1],
    3: [62, 60, 56, 48, 38, 26, 14, 1],
    4: [62, 62, 60, 60, 56, 56, 48, 48, 38, 38, 26, 26, 14, 14, 1],
}


def patches(option: int = 2) -> list[tuple[int, int, float, float]]:
    """(patch_id, band, altitude, azimuth) of a sky division, in its fixed order."""
    if option not in COUNTS:
        raise ValueError("sky divisions are 1 to 4")
    table = 4 if option == 4 else 1
    out = []
    for band, n in enumerate(COUNTS[option]):
        step = np.float32(1) / np.float32(n) * np.float32(360)
        for k in range(n):
            out.append((len(out), band, float(ALTITUDES[table][band]), float(np.float32(k) * step + np.float32(STARTS[table][band]))))
    return out


def sky_azimuths(option: int = 2) -> list[float]:
    """The azimuths that sky-view factors are traced at.

    Each band's share is filled while k * step < 360 - step, in steps of the annulus; later
    bands move up and the tail stays 0, which is part of the results to match.
    """
    out = []
    for n, start in zip(COUNTS[option], STARTS[1]):
        step = np.float32(1) / np.float32(n) * np.float32(360)
        out += [float(np.float32(k) * step + np.float32(start)) for k in range(int(np.float32(360) / step))]
    want = len(patches(option))
    return (out + [0.0] * want)[:want]


def patch_table(spark: SparkSession, option: int = 2) -> DataFrame:
    return spark.createDataFrame(patches(option), "patch_id int, band int, altitude double, azimuth double")


def steradians(option: int = 2) -> list[float]:
    """Solid angle of each patch: its band's ring, shared; the zenith is a cap above the band before."""
    rows = patches(option)
    counts = {}
    for _, _, alt, _ in rows:
        counts[alt] = counts.get(alt, 0) + 1
    half, before, out = math.radians(rows[0][2]), None, []
    for _, _, alt, _ in rows:
        a = math.radians(alt)
        if counts[alt] > 1:
            out.append(2 * math.pi / counts[alt] * (math.sin(a + half) - math.sin(a - half)))
        else:
            out.append(2 * math.pi / counts[alt] * (math.sin(a) - math.sin(math.radians(before) + half)))
        before = alt
    return out


def annulus_weight(annulus: int, n: int) -> float:
    """The view-factor weight of one degree annulus cut into n sectors."""
    return (2 * math.pi / n) / (2 * math.pi) * math.sin(math.pi / 180) * math.sin(math.pi * (2 * (91 - annulus) - 1) / 180)


def patch_weights(option: int = 2) -> list[tuple[float, float]]:
    """(isotropic, directional) weight of each patch: its annuli's weights summed."""
    ann = ANNULI[1]
    out = []
    for band, n in enumerate(COUNTS[option]):
        rings = range(ann[band] + 1, ann[band + 1] + 1)
        pair = (sum(annulus_weight(k, n) for k in rings), sum(annulus_weight(k, math.ceil(n / 2)) for k in rings))
        out += [pair] * n
    return out


def ray_schedule(rows: int, cols: int, amax: float, azimuth: float, altitude: float, scale: float = 1.0) -> list[tuple[int, int, int, float]]:
    """(step, drow, dcol, dz) of a ray towards a sky direction, while it is inside and below amax.

    The test uses the step before, so one step beyond the edge is included.
    """
    azi = math.radians(azimuth if azimuth else 1e-12)
    tan_alt = math.tan(math.radians(altitude)) / scale
    sin, cos, tan = math.sin(azi), math.cos(azi), math.tan(azi)
    quarter = math.pi / 4
    by_row = quarter <= azi < 3 * quarter or 5 * quarter <= azi < 7 * quarter
    ds = abs(1 / sin) if by_row else abs(1 / cos)
    out, dr, dc, dz, i = [], 0, 0, 0.0, 1
    while amax >= dz and abs(dr) < rows and abs(dc) < cols:
        if by_row:
            dc, dr = int(np.sign(sin)) * i, -int(np.sign(cos)) * abs(int(np.rint(i / tan)))
        else:
            dc, dr = int(np.sign(sin)) * abs(int(np.rint(i * tan))), -int(np.sign(cos)) * i
        dz = ds * i * tan_alt
        out.append((i, dr, dc, dz))
        i += 1
    return out


def schedule_table(spark: SparkSession, schedules: dict[int, list[tuple[int, int, int, float]]]) -> DataFrame:
    rows = [(ray, *step) for ray, steps in schedules.items() for step in steps]
    return spark.createDataFrame(rows, "ray int, step int, drow int, dcol int, dz double")


def building_shadow(scene: DataFrame, schedule: DataFrame, keys: list[str] = (), value: str = "dsm") -> DataFrame:
    """(keys, ray, row, col, sunlit): 0 where some step of the ray meets a higher surface.

    Every pixel sends its elevation along the reversed ray, and the greatest received is kept:
    the maximum is order-free, so partial aggregation applies before the shuffle.
    """
    sent = scene.select(*keys, F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(value).alias("sz")).join(F.broadcast(schedule), F.lit(True))
    got = sent.groupBy(*keys, "ray", (F.col("sr") - F.col("drow")).alias("row"), (F.col("sc") - F.col("dcol")).alias("col")).agg(F.max(F.col("sz") - F.col("dz")).alias("f"))
    rays = F.broadcast(schedule.select("ray").distinct())
    own = scene.select(*keys, "row", "col", F.col(value).alias("z")).join(rays, F.lit(True))
    # A step beyond the scene meets elevation 0.
    out = own.join(got, [*keys, "ray", "row", "col"], "left")
    return out.select(*keys, "ray", "row", "col", F.when(F.coalesce("f", F.col("z")) > F.col("z"), 0).otherwise(1).alias("sunlit"))


def visible_fraction(visible: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted patch sums per pixel, in all directions and in the four quarters.

    ``visible`` has keys, patch_id, visible; ``weights`` patch_id, azimuth, w, wd.
    """
    a = F.col("azimuth")
    v = F.col("visible")
    part = lambda cond: F.least(F.sum(F.when(cond, v * F.col("wd")).otherwise(0.0)), F.lit(1.0))
    return visible.join(F.broadcast(weights), "patch_id").groupBy(*keys).agg(
        F.least(F.sum(v * F.col("w")), F.lit(1.0)).alias("svf"),
        part((a >= 0) & (a < 180)).alias("svf_e"),
        part((a >= 90) & (a < 270)).alias("svf_s"),
        part((a >= 180) & (a < 360)).alias("svf_w"),
        part((a >= 270) | (a < 90)).alias("svf_n"),
    )
