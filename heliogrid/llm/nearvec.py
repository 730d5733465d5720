"""Near-duplicate vectors by PCA-ordered tiled comparison.

Unit vectors are rotated onto the eigenvectors of their second moments, leading ones
first, which keeps all dot products.  Leading dimensions are accumulated first; the rest
of a product is at most the product of the two suffix norms, so a pair is given up as soon
as its partial product plus that bound cannot reach the threshold.

Vectors are sorted by the cells that their angles to the leading axes fall in and cut into
tiles of about TILE.  A tile keeps the range of its angles to AXES axes, its centre and its
radius.  Angles of similar vectors to anything differ by arccos(threshold) at most, so tiles
further apart by any of these hold no pair, which is exact.  Tiles meet in units of UNIT by
UNIT tiles, so a tile is shipped once a unit and not once a pair of tiles.  Inside a unit,
blocks of vectors accumulate a step of dimensions at a time by one matrix product, until
few enough pairs are alive to go on one by one.  A unit returns counts of links and a
spanning forest of them, at most two rows a vector and tile pair, however many pairs link.

Exact copies are one class with a multiplicity and are compared once.

Defined results.  Vectors that are null, empty, zero, or hold a null or a non-finite number
link with nothing.  Shorter vectors count as padded with zeros.  A row with a null id is
compared like any other; a component's id is its smallest non-null id.  Repeated rows are
vectors of their own that link with each other.  Ties at the threshold are decided by the
vectors as given, in double precision.  An empty table gives an empty result.  Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import written

TILE = 2048
#: Tiles on each side of a unit.
UNIT = 4
#: Vectors on each side of a matrix product.
BLOCK = 1024
#: Prefix lengths after which pairs are given up.
STEPS = (16, 32, 48)
#: Leading axes whose angles bound tiles, and those that order vectors.
AXES, CELLS = 8, 4
#: Share of a block's pairs alive up to which they are followed one by one.
_FEW = 0.02
_NEAR = 1e-9


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, padded with zeros; the column holds no nulls."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), dim))
    if len(flat):
        row = np.repeat(np.arange(len(column)), lengths)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[row, place] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    largest = np.abs(x).max(axis=1, keepdims=True)
    x = x / largest  # neither overflows nor vanishes when squared
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the second moments of all unit vectors, by falling eigenvalue."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            u = _unit(_matrix(batch.column(0), dim))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dim), dim)), pa.array(np.tile(np.arange(dim), dim)), pa.array(total.ravel())], names=["i", "j", "m"])

    rows = classes.select("v").mapInArrow(moments, "i long, j long, m double").groupBy("i", "j").agg(F.sum("m").alias("m")).toPandas()  # dim * dim rows
    m = np.zeros((dim, dim))
    m[rows["i"], rows["j"]] = rows["m"]
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()


@dataclass
class Tile:
    """Vectors as given, rotated unit vectors, these in single precision, and per step the norms of what follows."""

    h: np.ndarray
    n: np.ndarray
    raw: np.ndarray
    a: np.ndarray
    short: np.ndarray
    rest: dict[int, np.ndarray]


def prepare(raw: np.ndarray, axes: np.ndarray, h: np.ndarray, n: np.ndarray) -> Tile:
    a = _unit(raw) @ axes
    rest = {s: np.sqrt((a[:, s:] ** 2).sum(axis=1)) for s in STEPS if s < a.shape[1]}
    return Tile(h, n, raw, a, a.astype(np.float32), rest)


def _exact(one: Tile, two: Tile, p: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs p, q that link; a pair is given up as soon as the bound says so."""
    dim = one.a.shape[1]
    dots, lo = np.zeros(len(p)), 0
    for hi in [*one.rest, dim]:
        dots = dots + np.einsum("ij,ij->i", one.a[p, lo:hi], two.a[q, lo:hi])
        keep = dots + (one.rest[hi][p] * two.rest[hi][q] if hi < dim else 0) >= threshold - _NEAR
        p, q, dots, lo = p[keep], q[keep], dots[keep], hi
    return _decided(one, two, p, q, dots, threshold)


def _decided(one: Tile, two: Tile, p: np.ndarray, q: np.ndarray, dots: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    close = np.flatnonzero(np.abs(dots - threshold) < _NEAR)
    if len(close):  # decide by the vectors as given
        x, y = one.raw[p[close]], two.raw[q[close]]
        dots[close] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
    return p[dots >= threshold], q[dots >= threshold]


def _block_links(one: Tile, two: Tile, i: slice, j: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of two blocks of vectors."""
    dim = one.a.shape[1]
    low = np.float32(threshold - 1e-4)  # single precision is off by far less
    cuts = [*one.rest, dim]
    dots, lo = None, 0
    for hi in cuts:
        part = one.short[i, lo:hi] @ two.short[j, lo:hi].T
        dots = part if dots is None else np.add(dots, part, out=dots)
        if hi < dim:
            alive = dots >= low - np.outer(one.rest[hi][i].astype(np.float32), two.rest[hi][j].astype(np.float32))
        else:
            alive = dots >= low
        found = np.count_nonzero(alive)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if found <= _FEW * alive.size:
            p, q = np.divmod(np.flatnonzero(alive), alive.shape[1])
            return _exact(one, two, p + i.start, q + j.start, threshold)
        lo = hi
    full = one.a[i] @ two.a[j].T
    p, q = np.divmod(np.flatnonzero(full >= threshold - _NEAR), full.shape[1])
    return _decided(one, two, p + i.start, q + j.start, full[p, q], threshold)


def tile_links(one: Tile, two: Tile, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the linked pairs of two prepared tiles; if same, each pair once."""
    empty = np.zeros(0, np.int64)
    kept_i, kept_j = [empty], [empty]
    for a in range(0, len(one.a), BLOCK):
        for b in range(a if same else 0, len(two.a), BLOCK):
            p, q = _block_links(one, two, slice(a, a + BLOCK), slice(b, b + BLOCK), threshold)
            if same and a == b:
                p, q = p[p < q], q[p < q]
            kept_i.append(p)
            kept_j.append(q)
    return np.concatenate(kept_i), np.concatenate(kept_j)


def apart(lo: np.ndarray, hi: np.ndarray, centre: np.ndarray, radius: np.ndarray, k: int, reach: float) -> np.ndarray:
    """For each tile: do its bounds exclude a pair within ``reach`` of tile k's vectors?"""
    gap = np.maximum(lo - hi[k], lo[k] - hi).max(axis=1)
    between = np.arccos(np.clip(centre @ centre[k], -1, 1))
    return (gap > reach) | (between - radius - radius[k] > reach)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node each of n nodes reaches by the links i-j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """Links by cosine >= threshold: id_col, n_links, component_id, kept for every row.

    kept is true for the row whose id is its component's id.
    """
    spark = table.sparkSession
    v = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(id_col).alias("id"), F.when(good, v).alias("v"))
    rows = rows.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    classes = written(rows.filter("v IS NOT NULL").groupBy("h", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")), "vec-classes")
    first = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    total, dim = first["n"], first["dim"] or 0
    plain = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    if not total:
        return plain
    v_type = classes.schema["v"].dataType.simpleString()
    axes = _axes(classes, dim)
    n_tiles = -(-total // tile)
    kind = np.float32 if v_type == "array<float>" else np.float64

    reach = float(np.arccos(min(1.0, max(-1.0, threshold)))) + 1e-6
    width = max(reach, 0.05)
    cells = [f"c{k}" for k in range(min(CELLS, dim))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = np.arccos(np.clip(_unit(_matrix(batch.column(1), dim)) @ axes[:, : len(cells)], -1, 1))
            made = [pa.array((angle[:, k] // width).astype(np.int32)) for k in range(len(cells))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle[:, 0]), *made], names=["h", "v", "n", "angle", *cells])

    spread = written(classes.select("h", "v", "n").mapInArrow(place, f"h long, v {v_type}, n long, angle double, " + ", ".join(f"{c} int" for c in cells)), "vec-cells")
    parts = max(1, min(n_tiles, 10_000))
    ranged = spread.repartitionByRange(parts, *cells, "angle", "h").select("h", "v", "n", F.spark_partition_id().alias("part"))
    ranged = written(ranged, "vec-ranged")
    # Ranges are about even; one that is not is cut by hash, so that a tile holds about TILE vectors.
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # at most 10,000 rows
    tiled = ranged.join(F.broadcast(sizes), "part").withColumn("tile", F.col("part") * 1_000_000 + F.pmod(F.xxhash64("h"), F.ceil(F.col("rows") / (2 * tile))))
    tiled = tiled.select("tile", "h", "v", "n")
    n_axes = min(AXES, dim)

    def bundle(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("h").combine_chunks()
        x = _matrix(t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"], dim)
        u = _unit(x) @ axes
        angle = np.arccos(np.clip(u[:, :n_axes], -1, 1))
        centre = u.mean(axis=0)
        size = np.sqrt(centre @ centre)
        centre = centre / size if size > 1e-9 else np.eye(dim)[0]
        radius = float(np.arccos(np.clip(u @ centre, -1, 1)).max()) + 1e-6
        return pa.table({
            "tile": pa.array([key[0].as_py()], pa.int64()),
            "lo": [angle.min(axis=0).tobytes()], "hi": [angle.max(axis=0).tobytes()], "centre": [centre.tobytes()], "radius": [radius],
            "h": [t["h"].to_numpy().tobytes()], "n": [t["n"].to_numpy().tobytes()], "x": [x.astype(kind).tobytes()],
        })

    tiles = written(tiled.groupBy("tile").applyInArrow(bundle, "tile long, lo binary, hi binary, centre binary, radius double, h binary, n binary, x binary"), "vec-tiles")
    # Bounds of tiles, a row for every TILE vectors.
    bounds = tiles.select("tile", "lo", "hi", "centre", "radius").orderBy("tile").toArrow()
    stack = lambda name: np.stack([np.frombuffer(x.as_py(), np.float64) for x in bounds[name]])
    known = spark.sparkContext.broadcast((bounds["tile"].to_numpy(), stack("lo"), stack("hi"), stack("centre"), bounds["radius"].to_numpy()))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each tile, numbered, once for every unit (two groups of UNIT tiles) in which it has a partner."""
        number, lo, hi, centre, radius = known.value
        for batch in batches:
            for at, name in enumerate(batch.column(0).to_pylist()):
                k = int(np.searchsorted(number, name))
                mine = k // UNIT
                near = np.flatnonzero(~apart(lo, hi, centre, radius, k, reach))
                for group in np.unique(np.append(near // UNIT, mine)).tolist():
                    one = batch.slice(at, 1)
                    yield pa.RecordBatch.from_arrays([pa.array([min(mine, group)], pa.int64()), pa.array([max(mine, group)], pa.int64()), pa.array([k], pa.int64()), *one.columns[1:]], names=["g", "g2", "k", "h", "n", "x"])

    groups = -(-len(bounds) // UNIT)
    dealt = tiles.select("tile", "h", "n", "x").mapInArrow(units, "g long, g2 long, k long, h binary, n binary, x binary")
    dealt = dealt.repartition(max(1, min(2 * groups * (groups + 1), 20_000)), "g", "g2").sortWithinPartitions("g", "g2", "k")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, lo, hi, centre, radius = known.value
        unit, held = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if unit != (r["g"], r["g2"]):
                    unit, held = (r["g"], r["g2"]), {}
                k = r["k"]
                two = prepare(np.frombuffer(r["x"], kind).astype(np.float64).reshape(-1, dim), axes, np.frombuffer(r["h"], np.int64), np.frombuffer(r["n"], np.int64))
                if k // UNIT == unit[0]:  # the unit's first group comes first and stays
                    held[k] = two
                far = apart(lo, hi, centre, radius, k, reach)
                for k1, one in held.items():
                    if far[k1] or (k1 // UNIT == k // UNIT) != (unit[0] == unit[1]):
                        continue
                    same = k1 == k
                    i, j = tile_links(one, two, threshold, same)
                    if not len(i):
                        continue
                    nodes = one.h if same else np.concatenate([one.h, two.h])
                    jj = j if same else j + len(one.h)
                    links = np.bincount(i, two.n[j], len(nodes)) + np.bincount(jj, one.n[i], len(nodes))
                    root = nodes[_forest(i, jj, len(nodes))]
                    use = links > 0
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[use]), pa.array(root[use]), pa.array(links[use].astype(np.int64))], names=["a", "b", "links"])

    found = written(dealt.mapInArrow(compare, "a long, b long, links long"), "vec-links")
    counts = found.groupBy(F.col("a").alias("h")).agg(F.sum("links").alias("links"))
    labels = components(found.select("a", "b"))
    named = classes.select("h", "n", "low").join(counts, "h", "left").join(labels.withColumnRenamed("node", "h"), "h", "left")
    named = written(named.select("h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "low", F.coalesce("label", "h").alias("label")), "vec-named")
    lowest = named.groupBy("label").agg(F.min("low").alias("component"))
    by_class = written(named.join(lowest, "label").select("h", "links", "component"), "vec-by-class")
    out = written(rows.select("id", "h"), "vec-rows").join(by_class, "h", "left")
    component = F.coalesce("component", "id").cast("long")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
