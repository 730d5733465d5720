"""GeoTIFF rasters as a Spark data source: ``spark.read.format("geotiff")`` and its writer.

Reads single- and multi-band strips or tiles, uncompressed or deflate, of float, integer and
byte samples; writes float32 strips, deflate or plain.  A partition is one file, and a row is
one block row of a band: file, band, time, row, cols, values array, with the geotransform.
``pixels`` explodes blocks to one row a pixel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, band int, time string, rows int, cols int, gt array<double>, row int, values array<float>"
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
_TEXT = 42112


@dataclass
class Raster:
    """Bands of equal size with their geotransform; times are the bands' labels."""

    bands: np.ndarray
    gt: list[float] = field(default_factory=lambda: [0.0, 1.0, 0.0, 0.0, 0.0, -1.0])
    times: list[str] = field(default_factory=list)


def _entries(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        code = _TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize(order + code) * count
        where = at + 2 + 12 * k + 8
        if size > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        tags[tag] = (data[where : where + count],) if code == "s" else struct.unpack_from(order + code * count, data, where)
    (after,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, after


def _plane(data: bytes, tags: dict, order: str) -> np.ndarray:
    cols, rows = tags[256][0], tags[257][0]
    bits, kind = tags.get(258, (8,))[0], tags.get(339, (1,))[0]
    dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}[kind] + str(bits // 8))
    samples, packed = tags.get(277, (1,))[0], tags.get(259, (1,))[0]
    if packed not in (1, 8, 32946):
        raise ValueError(f"TIFF compression {packed} is not read")
    predictor = tags.get(317, (1,))[0]

    def chunk(offset: int, size: int, h: int, w: int) -> np.ndarray:
        raw = data[offset : offset + size]
        raw = zlib.decompress(raw) if packed != 1 else raw
        a = np.frombuffer(raw, dtype, h * w * samples).reshape(h, w, samples)
        if predictor == 2:
            a = np.cumsum(a, axis=1, dtype=dtype)
        return a

    out = np.zeros((rows, cols, samples), dtype)
    if 322 in tags:
        tw, th = tags[322][0], tags[323][0]
        across = -(-cols // tw)
        for k, (o, n) in enumerate(zip(tags[324], tags[325])):
            r, c = k // across * th, k % across * tw
            out[r : r + th, c : c + tw] = chunk(o, n, th, tw)[: rows - r, : cols - c]
    else:
        step = tags.get(278, (rows,))[0]
        for k, (o, n) in enumerate(zip(tags[273], tags[279])):
            r = k * step
            h = min(step, rows - r)
            out[r : r + h] = chunk(o, n, h, cols)
    return np.moveaxis(out, -1, 0).astype(np.float32)


def decode(data: bytes, metadata_only: bool = False) -> Raster:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    bands, times, gt, shape = [], [], None, None
    while at:
        tags, at = _entries(data, order, at)
        shape = (tags[257][0], tags[256][0])
        if gt is None:
            if 33550 in tags and 33922 in tags:
                sx, sy = tags[33550][:2]
                i, j, _, x, y = tags[33922][:5]
                gt = [x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy]
            elif 34264 in tags:
                m = tags[34264]
                gt = [m[3], m[0], m[1], m[7], m[4], m[5]]
        planes = np.zeros((tags.get(277, (1,))[0], *shape), np.float32) if metadata_only else _plane(data, tags, order)
        label = tags[270][0].rstrip(b"\0").decode() if 270 in tags else ""
        bands.extend(planes)
        times.extend([label.removeprefix("Time=")] * len(planes))
    return Raster(np.stack(bands), gt or [0.0, 1.0, 0.0, 0.0, 0.0, 1.0], times)


def encode(raster: Raster, compress: bool = True) -> bytes:
    """A little-endian TIFF, a directory per band, float32; the band's time is its description."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    rows, cols = raster.bands.shape[1:]
    step = max(1, (1 << 16) // max(1, cols * 4))
    for k, band in enumerate(raster.bands):
        strips = []
        for r in range(0, rows, step):
            raw = np.ascontiguousarray(band[r : r + step], "<f4").tobytes()
            raw = zlib.compress(raw, 6) if compress else raw
            strips.append((len(out), len(raw)))
            out += raw
        label = ("Time=" + raster.times[k]).encode() + b"\0" if k < len(raster.times) and raster.times[k] else None
        gt = raster.gt
        fields = [(256, 4, [cols]), (257, 4, [rows]), (258, 3, [32]), (259, 3, [8 if compress else 1]), (262, 3, [1])]
        fields += [(270, 2, label)] if label else []
        fields += [(273, 4, [o for o, _ in strips]), (277, 3, [1]), (278, 4, [step]), (279, 4, [n for _, n in strips]), (339, 3, [3])]
        fields += [(33550, 12, [gt[1], -gt[5], 0.0]), (33922, 12, [0.0, 0.0, 0.0, gt[0], gt[3], 0.0])]
        entries = bytearray()
        for tag, kind, values in fields:
            body = values if kind == 2 else struct.pack("<" + _TYPES[kind] * len(values), *values)
            if len(body) <= 4:
                place = body.ljust(4, b"\0")
            else:
                out += b"\0" * (len(out) % 2)
                place = struct.pack("<I", len(out))
                out += body
            entries += struct.pack("<HHI", tag, kind, len(values)) + place
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.metadata_only = options.get("metadataonly", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = _system(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [_File(self.path)]
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        prefix = self.path[: len(self.path) - len(path)]
        return [_File(prefix + f.path) for f in sorted(found, key=lambda f: f.path) if f.path.lower().endswith((".tif", ".tiff"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, path = _system(partition.value)
        with system.open_input_file(path) as f:
            raster = decode(f.read(), self.metadata_only)
        _, rows, cols = raster.bands.shape
        for band, (plane, time) in enumerate(zip(raster.bands, raster.times), 1):
            if self.metadata_only:
                yield (partition.value, band, time, rows, cols, raster.gt, None, None)
                continue
            for row in range(rows):
                yield (partition.value, band, time, rows, cols, raster.gt, row, plane[row].tolist())


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class GeoTiffWriter(DataSourceWriter):
    """Writes rows of (file, band, time, row, values, gt) as one TIFF per file name; give each file one partition."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.compress = options.get("compression", "deflate").lower() != "none"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        files: dict[str, dict] = {}
        for r in rows:
            f = files.setdefault(r.file, {"gt": list(r.gt), "bands": {}})
            f["bands"].setdefault((r.band, r.time), {})[r.row] = r.values
        names = []
        for name, f in files.items():
            keys = sorted(f["bands"])
            bands = np.stack([np.array([f["bands"][k][i] for i in sorted(f["bands"][k])], np.float32) for k in keys])
            system, path = _system(self.path)
            system.create_dir(path, recursive=True)
            part = f"{path}/.{name}.part"
            with system.open_output_stream(part, compression=None) as out:
                out.write(encode(Raster(bands, f["gt"], [k[1] or "" for k in keys]), self.compress))
            system.move(part, f"{path}/{name}")
            names.append(name)
        return _Written(names)

    def commit(self, messages: list) -> None:
        """The names of all files, written last, tell a complete result from a partial one."""
        system, path = _system(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/_SUCCESS", compression=None) as out:
            out.write("\n".join(sorted(n for m in messages if m for n in m.files)).encode())

    def abort(self, messages: list) -> None:
        system, path = _system(self.path)
        for m in messages:
            for name in m.files if m else []:
                system.delete_file(f"{path}/{name}")


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GeoTiffReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return GeoTiffWriter(dict(self.options))


def pixels(blocks: DataFrame, value: str = "value") -> DataFrame:
    """One row a pixel: file, band, time, row, col, value."""
    return blocks.select("file", "band", "time", "row", F.posexplode("values").alias("col", value))


def blocks(pixels_: DataFrame, value: str, gt: list[float], keys: tuple[str, ...] = ("file", "band", "time")) -> DataFrame:
    """Pixel rows as block rows for the writer, one partition a file."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("col", F.col(value).cast("float").alias("v")))), lambda x: x["v"])
    out = pixels_.groupBy(*keys, "row").agg(line.alias("values")).withColumn("gt", F.array(*map(F.lit, gt)))
    return out.withColumns({"rows": F.lit(None).cast("int"), "cols": F.size("values")}).select("file", "band", "time", "rows", "cols", "gt", "row", "values").repartition("file")
