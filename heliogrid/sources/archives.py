"""Members of ZIP archives: rasters, and cubes of NumPy archives by rows.

An archive is read by one task, which opens its members one after another; a cube is given
out a row at a time, so that no more of it than that is held.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import geotiff


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, zipfile.ZipFile, str]]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                for name in sorted(archive.namelist()):
                    yield path.as_py(), archive, name


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """path, member, band, row and values of every raster (.tif) in archives; other members are no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, archive, name in _opened(batches):
            if name.lower().endswith((".tif", ".tiff")):
                for band, plane in enumerate(geotiff.decode(archive.read(name)).bands):
                    n = len(plane)
                    values = pa.array([r.astype(np.float64) for r in plane], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([name] * n), pa.array([band] * n, pa.int32()), pa.array(range(n), pa.int32()), values], names=["path", "member", "band", "row", "values"])

    return _archives(spark, path).mapInArrow(run, "path string, member string, band int, row int, values array<double>")


def read_cubes(spark: SparkSession, path: str) -> DataFrame:
    """path, member, row, shape and values (of all but the first axis, flat) of the arrays in NumPy archives.

    Arrays in column order are read whole.  An array without axes is one row.
    """

    def rows(stream) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        version = np.lib.format.read_magic(stream)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
        inner = int(np.prod(shape[1:], dtype=np.int64))
        if fortran:
            whole = np.frombuffer(stream.read(), kind).reshape(shape[::-1]).T
            yield from ((shape, r.ravel()) for r in whole)
            return
        for _ in range(shape[0] if shape else 1):
            yield shape, np.frombuffer(stream.read(inner * kind.itemsize), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, archive, name in _opened(batches):
            if name.endswith(".npy"):
                with archive.open(name) as stream:
                    for i, (shape, values) in enumerate(rows(stream)):
                        arrays = [pa.array([file]), pa.array([name.removesuffix(".npy")]), pa.array([i], pa.int32()), pa.array([list(shape)], pa.list_(pa.int32())), pa.array([values.astype(np.float64)], pa.list_(pa.float64()))]
                        yield pa.RecordBatch.from_arrays(arrays, names=["path", "member", "row", "shape", "values"])

    return _archives(spark, path).mapInArrow(run, "path string, member string, row int, shape array<int>, values array<double>")
