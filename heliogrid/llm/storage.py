"""Intermediate tables in the folder that the cluster shares.

``spark.checkpoint.dir`` of the session names that folder.  Only where it is unset and the
master is local, as in tests on one machine, a folder of the driver is used; on a cluster
that is an error.  Tables written here cut the
lineage: an executor lost later costs no recomputation of what was written before.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share on {master}")
        app = spark.sparkContext.applicationId
        named = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="heliogrid-"))
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/heliogrid/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, rounds: int = 5) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Spark does so when the driver collects its garbage, which may be long after a written
    table has replaced them.  Repeated, as references and files are dropped with a delay.
    """
    for _ in range(rounds):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.8)
