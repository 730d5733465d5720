"""Result sinks for people: colour-ramped PNG overlays and JSON documents."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tiles import to_array

# Stops of the sequential and of the diverging colour ramp.
SEQUENTIAL = [(0.0, (49, 54, 149)), (0.25, (116, 173, 209)), (0.5, (255, 255, 191)), (0.75, (244, 109, 67)), (1.0, (165, 0, 38))]
DIVERGING = [(0.0, (33, 102, 172)), (0.5, (247, 247, 247)), (1.0, (178, 24, 43))]


def ramp(values: np.ndarray, lo: float, hi: float, stops=SEQUENTIAL, alpha: int = 200) -> np.ndarray:
    """RGBA by piecewise linear stops; NaN is transparent."""
    t = np.clip((values - lo) / (hi - lo if hi > lo else 1.0), 0, 1)
    at = [s for s, _ in stops]
    channels = [np.interp(np.nan_to_num(t), at, [c[k] for _, c in stops]) for k in range(3)]
    out = np.stack([*channels, np.where(np.isnan(values), 0, alpha)], -1)
    return np.rint(out).astype(np.uint8)


def png(rgba: np.ndarray) -> bytes:
    h, w = rgba.shape[:2]

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    lines = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(rgba))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def render(df: DataFrame, keys: list[str], value: str, lo: float, hi: float, difference: bool = False) -> DataFrame:
    """One PNG per key (say tile and step): keys and png."""

    def run(group: tuple, table: pa.Table) -> pa.Table:
        image = to_array(table.combine_chunks(), value, float("nan"))
        data = png(ramp(image, lo, hi, DIVERGING if difference else SEQUENTIAL))
        return pa.table({**{k: pa.array([g.as_py()], table.schema.field(k).type) for k, g in zip(keys, group)}, "png": pa.array([data], pa.binary())})

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", png binary"
    return df.select(*keys, "row", "col", value).groupBy(*keys).applyInArrow(run, schema)


def result_document(stats: DataFrame, hours: list[str]) -> DataFrame:
    """variable, json: the series of mean, min, max and changed pixels of each variable in step order."""
    rows = F.array_sort(F.collect_list(F.struct("step", "mean", "min", "max", "changed")))
    parts = stats.groupBy("variable").agg(rows.alias("r"))
    series = F.struct(*[F.transform("r", lambda x, n=n: x[n]).alias(n) for n in ("mean", "min", "max", "changed")])
    return parts.select("variable", F.to_json(F.struct(F.lit(json.dumps(hours)).alias("hours"), series.alias("stats"))).alias("json"))


def canonical_json(value) -> str:
    """JSON with sorted keys and no spaces; NaN, infinities and keys that are not strings are errors."""

    def check(x):
        if isinstance(x, dict):
            if any(not isinstance(k, str) for k in x):
                raise TypeError("keys must be strings")
            for v in x.values():
                check(v)
        elif isinstance(x, (list, tuple)):
            for v in x:
                check(v)

    check(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)
