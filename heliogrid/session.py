"""Sessions and registration of data sources and SQL functions."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from .functions import comfort, humidity, radiation, solar, wind
from .sources.geotiff import GeoTiff

#: SQL functions over doubles: name -> (arguments, expression).
SQL_FUNCTIONS = {
    "utci_saturation_hpa": (["ta"], comfort.saturation_hpa("ta")),
    "vapour_kpa": (["ta", "rh"], comfort.vapour_kpa("ta", "rh")),
    "utci_offset": (["ta", "va", "d", "pa"], comfort.polynomial("ta", "va", "d", "pa")),
    "globe_temperature": (["hcg", "tmrt", "ta"], comfort.globe("hcg", "tmrt", "ta")),
    "wbgt": (["tw", "tg", "ta", "shadow"], comfort.wbgt("tw", "tg", "ta", "shadow")),
    "magnus_rh": (["t", "td"], humidity.magnus_rh("t", "td")),
    "mixing_ratio_rh": (["t2", "q2", "psfc"], humidity.mixing_ratio_rh("t2", "q2", "psfc")),
    "humidity_from_rh": (["p", "t", "rh"], humidity.humidity_from_rh("p", "t", "rh")),
    "ice_fraction": (["t"], humidity.ice_fraction("t")),
    "wind_speed": (["u", "v"], wind.speed("u", "v")),
    "wind_direction": (["u", "v"], wind.direction("u", "v")),
    "tree_wind_coefficient": (["h", "share"], wind.tree_coefficient("h", "share")),
    "building_wind_coefficient": (["h", "frontal"], wind.building_coefficient("h", "frontal")),
    "day_length": (["doy", "lat"], solar.day_length("doy", "lat")),
    "sun_distance": (["doy"], solar.sun_distance("doy")),
    "sky_emissivity": (["ta", "rh"], solar.sky_emissivity("ta", "rh")),
    "tmrt_of_absorbed": (["s"], radiation.tmrt("s")),
}


def register(spark: SparkSession) -> SparkSession:
    """Register the raster source and the scalar functions, which stay expressions of the JVM."""
    spark.dataSource.register(GeoTiff)
    for name, (arguments, text) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(a + ' DOUBLE' for a in arguments)}) RETURNS DOUBLE RETURN {text}")
    return spark


def session(app: str = "heliogrid", **config: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in config.items():
        builder = builder.config(key, value)
    return register(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, named by the session; one of the driver's own where it names none."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="heliogrid-"))
    return spark.sparkContext.getCheckpointDir()
