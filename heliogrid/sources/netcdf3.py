"""NetCDF-3 (classic and 64-bit offset): a parser, a writer, and long tables of gridded forcing."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}

# Names under which gridded forcing has its axes and variables.
TIME_NAMES = ("valid_time", "time", "Times", "XTIME")
LAT_NAMES = ("latitude", "lat", "XLAT", "y")
LON_NAMES = ("longitude", "lon", "XLONG", "x")


class _Reader:
    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or data[3] not in (1, 2):
            raise ValueError("not a NetCDF-3 file")
        self.data, self.at, self.wide = data, 4, data[3] == 2

    def int(self) -> int:
        (x,) = struct.unpack_from(">i", self.data, self.at)
        self.at += 4
        return x

    def name(self) -> str:
        n = self.int()
        x = self.data[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return x

    def values(self):
        kind, n = self.int(), self.int()
        dtype = np.dtype(_TYPES[kind])
        raw = self.data[self.at : self.at + n * dtype.itemsize]
        self.at += -(-len(raw) // 4) * 4
        return raw.decode() if kind == 2 else np.frombuffer(raw, dtype).tolist()

    def items(self, one) -> list:
        self.int()
        return [one() for _ in range(self.int())]


def decode(data: bytes) -> dict[str, dict]:
    """Variables by name: dims, shape, attrs and data; attribute ``""`` holds the file's own."""
    r = _Reader(data)
    records = r.int()
    dims = r.items(lambda: (r.name(), r.int()))
    attrs = dict(r.items(lambda: (r.name(), r.values())))
    headers = []
    r.int()
    for _ in range(r.int()):
        name = r.name()
        ids = [r.int() for _ in range(r.int())]
        own = dict(r.items(lambda: (r.name(), r.values())))
        kind, size = r.int(), r.int()
        (begin,) = struct.unpack_from(">q" if r.wide else ">i", data, r.at)
        r.at += 8 if r.wide else 4
        headers.append((name, ids, own, kind, size, begin))
    is_record = lambda ids: bool(ids) and dims[ids[0]][1] == 0
    several = sum(is_record(h[1]) for h in headers) > 1
    stride = sum(h[4] for h in headers if is_record(h[1]))
    out = {"": {"attrs": attrs}}
    for name, ids, own, kind, size, begin in headers:
        dtype = np.dtype(_TYPES[kind])
        shape = [records if dims[i][1] == 0 else dims[i][1] for i in ids]
        if is_record(ids):
            each = int(np.prod(shape[1:], dtype=np.int64))
            step = stride if several else each * dtype.itemsize
            values = np.stack([np.frombuffer(data, dtype, each, begin + k * step) for k in range(records)]) if records else np.zeros((0, each), dtype)
        else:
            values = np.frombuffer(data, dtype, int(np.prod(shape, dtype=np.int64)), begin)
        values = values.reshape(shape)
        if kind not in (1, 2) and ("scale_factor" in own or "add_offset" in own):
            values = values * own.get("scale_factor", [1.0])[0] + own.get("add_offset", [0.0])[0]
        out[name] = {"dims": [dims[i][0] for i in ids], "attrs": own, "data": values}
    return out


def encode(variables: dict[str, tuple[list[str], np.ndarray, dict[str, str]]]) -> bytes:
    """A classic file of fixed-size variables: name -> (dims, array, text attributes)."""
    word = lambda x: struct.pack(">i", x)
    text = lambda s: word(len(s.encode())) + s.encode().ljust(-(-len(s.encode()) // 4) * 4, b"\0")
    dims: dict[str, int] = {}
    for names, array, _ in variables.values():
        dims |= dict(zip(names, array.shape))
    order = list(dims)
    head = b"CDF\x01" + word(0) + word(10) + word(len(dims)) + b"".join(text(d) + word(n) for d, n in dims.items()) + word(0) + word(0) + word(11) + word(len(variables))
    bodies, parts = [], []
    for name, (names, array, attrs) in variables.items():
        code = _CODES[array.dtype.str[1:]]
        own = word(12) + word(len(attrs)) + b"".join(text(k) + word(2) + text(v) for k, v in attrs.items()) if attrs else word(0) + word(0)
        body = array.astype(array.dtype.newbyteorder(">")).tobytes()
        body = body.ljust(-(-len(body) // 4) * 4, b"\0")
        parts.append(text(name) + word(len(names)) + b"".join(word(order.index(d)) for d in names) + own + word(code) + word(len(body)))
        bodies.append(body)
    begin = len(head) + sum(len(p) + 4 for p in parts)
    for part, body in zip(parts, bodies):
        head += part + word(begin)
        begin += len(body)
    return head + b"".join(bodies)


def axis(names: list[str], candidates: tuple[str, ...]) -> str:
    for c in candidates:
        if c in names:
            return c
    raise KeyError(f"none of {candidates} among {names}")


def read_grid(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """Gridded variables as a long table: file, t (as stored), units, iy, ix, lat, lon and the variables.

    A task reads a file, and yields one batch a time step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = decode(content.as_buffer().to_pybytes())
                names = list(found)
                t, la, lo = (found[axis(names, c)] for c in (TIME_NAMES, LAT_NAMES, LON_NAMES))
                lat, lon = np.asarray(la["data"], float), np.asarray(lo["data"], float)
                if lat.ndim == 1:
                    lat, lon = np.meshgrid(lat, lon, indexing="ij")
                lat, lon = lat.reshape(-1, *lat.shape[-2:])[0], lon.reshape(-1, *lon.shape[-2:])[0]
                iy, ix = (x.ravel() for x in np.indices(lat.shape))
                n = lat.size
                units = t["attrs"].get("units", "")
                for k, time in enumerate(np.atleast_1d(t["data"])):
                    planes = [np.asarray(found[v]["data"], float)[k].ravel() for v in variables]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.full(n, float(time))), pa.array([units] * n), pa.array(iy.astype(np.int32)), pa.array(ix.astype(np.int32)), pa.array(lat.ravel()), pa.array(lon.ravel()), *map(pa.array, planes)], names=["file", "t", "units", "iy", "ix", "lat", "lon", *variables])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, t double, units string, iy int, ix int, lat double, lon double, " + ", ".join(f"{v} double" for v in variables))


def with_time(df: DataFrame) -> DataFrame:
    """Adds time from stored numbers and their units (hours, minutes or seconds since an instant)."""
    unit = F.regexp_extract("units", r"^(\w+) since", 1)
    start = F.to_timestamp(F.regexp_replace(F.regexp_extract("units", r"since ([0-9T:\- ]+)", 1), "T", " "))
    seconds = F.when(unit == "hours", 3600.0).when(unit == "minutes", 60.0).when(unit == "days", 86400.0).otherwise(1.0)
    return df.withColumn("time", F.timestamp_micros(F.unix_micros(start) + F.round(F.col("t") * seconds * 1e6).cast("long")))


def wrf_name(path) -> tuple:
    """(domain, time) of a model output file name in any of its three spellings."""
    name = F.regexp_extract(path, r"wrfout_(d\d\d)_(\d{4}-\d\d-\d\d)_(\d\d)[_:]?(\d\d)[_:]?(\d\d)", 0)
    part = lambda k: F.regexp_extract(path, r"wrfout_(d\d\d)_(\d{4}-\d\d-\d\d)_(\d\d)[_:]?(\d\d)[_:]?(\d\d)", k)
    return F.nullif(part(1), F.lit("")), F.when(name != "", F.to_timestamp(F.concat_ws(" ", part(2), F.concat_ws(":", part(3), part(4), part(5)))))
