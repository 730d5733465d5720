"""Streams of weather and fluxes: windows, sessions, and the thermal delay as keyed state.

The reference processing is batch; these are its ordered folds over an unbounded input.
Checkpoints, replay and exactly-once batches are Spark's.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELAY, LIMIT = 33.27, 59 / 1440


def hourly(stream: DataFrame, ts: str, keys: list[str], value: str, late: str = "2 hours") -> DataFrame:
    """Tumbling hourly means; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), *keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("hour"), "mean", "n")


def stress_episodes(stream: DataFrame, ts: str, keys: list[str], value: str, above: float, gap: str = "90 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of values above a threshold: start, end, peak and rows."""
    hot = stream.withWatermark(ts, late).filter(F.col(value) > above)
    return hot.groupBy(F.session_window(ts, gap).alias("s"), *keys).agg(F.max(value).alias("peak"), F.count(F.lit(1)).alias("n")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "peak", "n")


def thermal_delay(stream: DataFrame, key: str, key_type: str = "string") -> DataFrame:
    """The thermal-wave delay of rows (key, step, t0, day, first, dt) as state per key.

    Steps must rise within a key across batches; a step at or before the last one is an error,
    and so is never folded twice.  Within a batch rows are sorted.
    """

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t1, clock, last = state.get if state.exists else (0.0, 0.0, -1)
        out = []
        for r in pd.concat(list(frames)).sort_values("step").itertuples():
            if r.step <= last:
                raise ValueError(f"step {r.step} of {k[0]} comes after {last}")
            last = r.step
            if not r.day:
                clock = 0.0
                out.append((k[0], r.step, None))
                continue
            t1 = r.t0 if r.first else t1
            long = clock >= LIMIT
            w = math.exp(-DELAY * (clock if long else clock + r.dt))
            value = r.t0 * (1 - w) + t1 * w
            if long:
                t1, clock = value, r.dt if r.dt > LIMIT else 0.0
            else:
                clock += r.dt
            out.append((k[0], r.step, value))
        state.update((t1, clock, int(last)))
        yield pd.DataFrame(out, columns=[key, "step", "delayed"])

    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {key_type}, step long, delayed double", "t1 double, clock double, last long", "append", GroupStateTimeout.NoTimeout)


def identity(config: dict) -> str:
    """Hash of a configuration; a checkpoint made under another one is refused."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def publish(stream: DataFrame, path: str, checkpoint: str, config: dict, keys: list[str]):
    """Write batches idempotently: a batch's folder is named by its id, and a manifest row closes it."""
    name = identity(config)
    spark = stream.sparkSession
    try:
        known = {r["identity"] for r in spark.read.json(f"{path}/manifest").select("identity").distinct().collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = set()
    if known - {name}:
        raise ValueError("the output was made under another configuration")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")
        n = batch.count()
        batch.sparkSession.createDataFrame([(batch_id, n, name)], "batch long, rows long, identity string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/batch={batch_id}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
