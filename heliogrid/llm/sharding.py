"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents with equal texts form a group, and a group goes to one shard.  Groups with a
share above 1 / (shards * FINE) of any dimension are large: at most 3 * shards * FINE can
exist, whatever the input.  All other groups are bundled by hash into shards * BUNDLES
bundles.  Large groups and bundles, a number bounded by parameters alone, are placed on
the driver in the order of decreasing size, each into the shard where the dot product of
its vector with the residual capacity is highest among those that it fits.

A group larger than a whole shard cannot keep the law, so it is cut by document id into
pieces of at most half a shard, which are placed like groups.

Defined results.  A null text counts as empty, so it has size 1, and is equal to an empty
one.  Repeated rows are documents of their own with slots of their own.  A null id is an
ordinary value.  Empty input gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mixing import word_count
from .storage import written

FINE = 1024
BUNDLES = 512
#: Rows that one slot window holds, on average.
SLOT_ROWS = 20_000


def place(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each vector, by decreasing largest share.

    A vector fits where that much is left of all dimensions: bytes, tokens and rows.  Among
    those shards the one is taken whose residual capacity has the highest dot product with
    the vector, the first of equal ones.  Where it fits in none, the first dimension decides,
    as bytes are the law: among shards with so many bytes left, then the one with most left.
    """
    total = vectors.sum(axis=0)
    shares = vectors / np.where(total > 0, total, 1)
    left = np.full((n_shards, vectors.shape[1]), 1 / n_shards)
    out = np.zeros(len(vectors), np.int32)
    for i in np.argsort(-shares.max(axis=1), kind="stable"):
        enough = left >= shares[i] - 1e-12
        fits = enough.all(axis=1) if enough.all(axis=1).any() else enough[:, 0]
        score = np.where(fits, np.maximum(left, 0) @ shares[i], -np.inf) if fits.any() else left[:, 0]
        out[i] = int(np.argmax(score))
        left[out[i]] -= shares[i]
    return out


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", fine: int = FINE, bundles: int = BUNDLES, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Assign every document a shard and a slot in it.

    Returns per document: id_col, size (UTF-8 bytes + 1), text_crc32, tokens (words),
    unit (the group or bundle it was placed with), shard, slot (0, 1, ... in its shard).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    meta = written(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("h"), word_count(text).alias("tokens")), "shard-meta")
    total = meta.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).first()
    n, key, dims = total["n"], ["h", "crc", "size"], ["bytes", "words", "n"]
    whole = [float(total["size"] or 0), float(total["tokens"] or 0), float(n)]
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("words"), F.count(F.lit(1)).alias("n")]

    groups = written(meta.groupBy(*key).agg(*sums), "shard-groups")
    share = F.greatest(*[F.col(d) / max(w, 1.0) for d, w in zip(dims, whole)])
    of_bytes = F.col("bytes") / max(whole[0], 1.0)
    is_large = share > 1 / (n_shards * fine)
    large = groups.filter(is_large).withColumn("parts", F.when(of_bytes > 1 / n_shards, F.ceil(of_bytes * n_shards * 2)).otherwise(1).cast("int"))
    large = large.select(*key, "parts").orderBy(*key).toPandas()  # at most 3 * n_shards * fine rows
    large["g"] = np.arange(len(large), dtype=np.int32)
    schema = pa.schema([("h", pa.int64()), ("crc", pa.int64()), ("size", pa.int64()), ("parts", pa.int32()), ("g", pa.int32())])
    known = F.broadcast(spark.createDataFrame(pa.Table.from_pandas(large, schema, preserve_index=False)))
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts"))
    unit = F.when(F.col("g").isNull(), F.concat(F.lit("b"), F.pmod(F.col("h"), F.lit(n_shards * bundles)))).otherwise(F.concat_ws(".", F.lit("g"), "g", part))
    tagged = meta.join(known, key, "left").withColumn("unit", unit).drop("parts", "g")
    units = tagged.groupBy("unit").agg(*sums).orderBy("unit").toPandas()  # bounded: bundles, large groups, their parts
    units["shard"] = place(units[dims].to_numpy(np.float64).reshape(-1, 3), n_shards)
    where = F.broadcast(spark.createDataFrame(pa.Table.from_pandas(units[["unit", "shard"]], pa.schema([("unit", pa.string()), ("shard", pa.int32())]), preserve_index=False)))
    buckets = max(4, -(-n // (n_shards * slot_rows)))
    placed = tagged.join(where, "unit").withColumn("bucket", F.pmod(F.xxhash64("id", "h"), F.lit(buckets)))
    return _slots(placed).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "tokens", "unit", "shard", "slot")


def _slots(placed: DataFrame) -> DataFrame:
    """Gapless numbers in each shard: an offset per (shard, bucket) and a row number inside."""
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "h", "crc", "size")
    return placed.join(offsets, ["shard", "bucket"]).withColumn("slot", (F.col("offset") + F.row_number().over(inside) - 1).cast("long"))
