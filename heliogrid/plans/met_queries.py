"""Queries over weather tables: forcing, time, wind, heat islands, files and jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import humidity, solar, wind
from ..functions.expr import column
from ..operators import grid, timeline
from ..operators.columns import sql_columns, with_columns
from ..sources import metfile
from .fixtures import FACTS, HOURLY, facts, hourly, rounded, spread, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _keyed(spark, sf_dir, named):
    return with_columns(facts(spark, sf_dir), named)


_RH = [("td", "ta - (100e0 - rh) / 5e0"), ("r1", humidity.magnus_rh("ta", "td")), ("r2", humidity.magnus_rh_builder("ta", "td")), ("r3", humidity.mixing_ratio_rh("(ta + 273.15e0)", "(rh / 10000e0)", "press"))]


@query(f"SELECT {_KEY}, round(r1, 6) AS r1, round(r2, 6) AS r2, round(r3, 6) AS r3 FROM {sql_columns(FACTS, _RH)}")
def relative_humidity_formulas(spark, sf_dir):
    return rounded(_keyed(spark, sf_dir, _RH).select(*_KEY.split(", "), "r1", "r2", "r3"))


_UV = [("u", "ta / 3e0"), ("v", "(rh - 50e0) / 10e0"), ("speed", wind.speed("u", "v")), ("wd", wind.direction("u", "v")), ("ue", wind.to_earth("u", "v", "0.8e0", "0.6e0")[0]), ("ve", wind.to_earth("u", "v", "0.8e0", "0.6e0")[1])]


@query(f"SELECT {_KEY}, round(speed, 6) AS speed, round(wd, 6) AS wd, round(ue, 6) AS ue, round(ve, 6) AS ve FROM {sql_columns(FACTS, _UV)}")
def wind_uv_to_dir(spark, sf_dir):
    return rounded(_keyed(spark, sf_dir, _UV).select(*_KEY.split(", "), "speed", "wd", "ue", "ve"))


_BIN = [("wd", "ta * 13e0 - 100e0"), ("dir", wind.direction_bin("wd"))]


@query(f"""SELECT l.{_KEY.replace(', ', ', l.')}, dir, round(greatest(coalesce(c.coef, 1e0) * va, 0.15e0), 6) AS wind FROM {sql_columns(FACTS, _BIN)} l
 LEFT JOIN (SELECT CAST(n_nationkey * 30 AS INTEGER) AS dir, 0.1e0 + n_nationkey / 20e0 AS coef FROM nation WHERE n_nationkey < 11) c USING (dir)""")
def wind_bin_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    coef = n.filter("n_nationkey < 11").select((F.col("n_nationkey") * 30).cast("int").alias("dir"), (0.1 + F.col("n_nationkey") / 20.0).alias("coef"))
    out = _keyed(spark, sf_dir, _BIN).join(F.broadcast(coef), "dir", "left")  # twelve bins
    return rounded(out.select(*_KEY.split(", "), "dir", column(wind.effective("coalesce(coef, 1e0)", "va")).alias("wind")))


_COEF = [("h", "greatest(ta, 0e0)"), ("share", "rh / 100e0"), ("trees", wind.tree_coefficient("h", "share")), ("built", wind.building_coefficient("h", "share")), ("east", wind.align_longitude("ta * 10e0", False))]


@query(f"SELECT {_KEY}, round(trees, 6) AS trees, round(built, 6) AS built, east FROM {sql_columns(FACTS, _COEF)}")
def wind_coefficients(spark, sf_dir):
    return rounded(_keyed(spark, sf_dir, _COEF).select(*_KEY.split(", "), "trees", "built", "east"))


@query(f"""SELECT cell, day, round({wind.heat_island_amplitude('sw', 'dtr', 'u')}, 6) AS amplitude FROM
 (SELECT cell, date_trunc('day', hour) AS day, avg(vmax) AS sw, avg(n) AS u, max(v) - min(v) AS dtr FROM {HOURLY} GROUP BY cell, date_trunc('day', hour))""")
def uhi_daily_amplitude(spark, sf_dir):
    return rounded(timeline.heat_island_daily(hourly(spark, sf_dir), ["cell"], "hour", "v", "vmax", "n"))


_DAILY = f"(SELECT cell, date_trunc('day', hour) AS day, max(v) - min(v) AS amp FROM {HOURLY} GROUP BY cell, date_trunc('day', hour) HAVING max(v) - min(v) > 300)"


@query(f"""SELECT h.cell, h.hour, round(coalesce((SELECT max_by(amp, day) FROM {_DAILY} d WHERE d.cell = h.cell AND d.day <= h.hour), 0e0), 6) AS amp FROM {HOURLY} h""")
def daily_forward_fill(spark, sf_dir):
    h = hourly(spark, sf_dir)
    d = timeline.daily(h, ["cell"], "hour", "v").filter("dtr > 300").select("cell", "day", F.col("dtr").alias("amp"))
    return rounded(timeline.forward_fill(d, h, ["cell"], "hour", "day", "amp"))


@query(f"""WITH h AS (SELECT cell, hour, CASE WHEN extract(hour FROM hour) BETWEEN 7 AND 18 THEN v ELSE 0e0 END AS sw, v / 100e0 AS amp FROM {HOURLY}),
r AS (SELECT *, sum(CASE WHEN sw <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY cell ORDER BY hour ROWS UNBOUNDED PRECEDING) AS run, sw <= 5 AS night FROM h),
j AS (SELECT *, row_number() OVER (PARTITION BY cell, run, night ORDER BY hour) - 1 AS j, count(*) OVER (PARTITION BY cell, run, night) AS n, avg(amp) OVER (PARTITION BY cell, run, night) AS a FROM r)
SELECT cell, hour, round(CASE WHEN night AND n >= 2 AND a > 0 THEN a * greatest(sin(pi() * j / greatest(n - 1, 1)), 0e0) ELSE 0e0 END, 6) AS night FROM j""")
def uhi_night_islands(spark, sf_dir):
    h = hourly(spark, sf_dir).select("cell", "hour", F.when(F.hour("hour").between(7, 18), F.col("v")).otherwise(0.0).alias("sw"), (F.col("v") / 100).alias("amp"))
    return rounded(timeline.night_profile(h, ["cell"], "hour", "sw", "amp").select("cell", "hour", "night"))


@query(f"""SELECT CAST(floor(a.cell / 2e0) AS INTEGER) AS pair, a.hour, round(a.v, 6) AS instant, round(b.v / 3600e0, 8) AS accumulated
 FROM {HOURLY} a JOIN {HOURLY} b ON a.hour = b.hour AND a.cell % 2 = 0 AND b.cell = a.cell + 1""")
def stream_intersection_join(spark, sf_dir):
    """Two streams, of even and of odd cells, joined at equal hours within each pair of neighbours."""
    h = hourly(spark, sf_dir).withColumn("pair", F.floor(F.col("cell") / 2).cast("int"))
    instant = h.filter("cell % 2 = 0").select("pair", "hour", F.col("v").alias("instant"))
    summed = h.filter("cell % 2 = 1").select("pair", "hour", (F.col("v") / 3600).alias("accumulated"))
    return rounded(instant.join(summed, ["pair", "hour"]), accumulated=8)


@query(f"SELECT cell, hour, round(v, 6) AS v FROM {HOURLY} WHERE hour BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 23:00:00'")
def time_window_inclusive(spark, sf_dir):
    """A time window, which is the feature: both of its ends are in it."""
    return rounded(timeline.window(hourly(spark, sf_dir).select("cell", "hour", "v"), "hour", "2024-01-03 00:00:00", "2024-01-20 23:00:00"))


_CELLS = "(SELECT s_suppkey AS cell_id, (s_suppkey * 37 % 360) / 2e0 - 90e0 AS lon, (s_suppkey * 53 % 170) / 2e0 - 42e0 AS lat, CAST(s_suppkey AS DOUBLE) AS value FROM supplier)"


def _cells(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("cell_id"), ((k * 37 % 360) / 2.0 - 90).alias("lon"), ((k * 53 % 170) / 2.0 - 42).alias("lat"), k.cast("double").alias("value"))


@query(f"""SELECT c_custkey, min_by(cell_id, d2 * 1e6 + cell_id / 1e6) AS cell_id, round(min(d2), 6) AS d2 FROM (SELECT c_custkey, cell_id,
 power((c_custkey * 17 % 360) / 2e0 - 89.8e0 - lon, 2) + power((c_custkey * 31 % 170) / 2e0 - 41.9e0 - lat, 2) AS d2 FROM customer, {_CELLS}) GROUP BY c_custkey""")
def nearest_grid_cell(spark, sf_dir):
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k, ((k * 17 % 360) / 2.0 - 89.8).alias("lon"), ((k * 31 % 170) / 2.0 - 41.9).alias("lat"))
    return rounded(grid.nearest_cell(spread(points), _cells(spark, sf_dir), "c_custkey"))


_BOXES = "(SELECT n_nationkey AS box, n_nationkey * 7e0 - 88.3e0 AS min_lon, n_nationkey * 7e0 - 80.1e0 AS max_lon, n_nationkey * 3e0 - 41.2e0 AS min_lat, n_nationkey * 3e0 - 40.1e0 + n_nationkey % 3 * 4e0 AS max_lat FROM nation)"


@query(f"""WITH c AS {_CELLS}, b AS {_BOXES}, m AS (SELECT box, avg(value) AS v FROM b JOIN c ON lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat GROUP BY box),
n AS (SELECT box, min_by(value, (power((min_lon + max_lon) / 2 - lon, 2) + power((min_lat + max_lat) / 2 - lat, 2)) * 1e6 + cell_id / 1e6) AS v FROM b, c GROUP BY box)
SELECT box, round(coalesce(m.v, n.v), 6) AS value FROM n LEFT JOIN m USING (box)""")
def bbox_mean_with_fallback(spark, sf_dir):
    k = F.col("n_nationkey")
    boxes = table(spark, sf_dir, "nation").select(k.alias("box"), (k * 7 - F.lit(88.3)).alias("min_lon"), (k * 7 - F.lit(80.1)).alias("max_lon"), (k * 3 - F.lit(41.2)).alias("min_lat"), (k * 3 - F.lit(40.1) + k % 3 * 4).alias("max_lat"))
    return rounded(grid.box_mean(boxes, _cells(spark, sf_dir), "box", "value"))


@query(f"""WITH c AS {_CELLS}, d AS (SELECT a.cell_id, 2 * 6371000e0 * asin(sqrt(least(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2), 1e0))) AS m
 FROM c a JOIN c b ON a.cell_id <> b.cell_id) SELECT cell_id, round(min(m), 3) AS nearest_m, round(median(m), 3) AS median_m FROM d GROUP BY cell_id""")
def haversine_cell_size(spark, sf_dir):
    return rounded(grid.cell_spacing(_cells(spark, sf_dir)), 3)


@query(f"SELECT cell_id, CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS zone, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS epsg, round(lon, 6) AS lon, round(lat, 6) AS lat FROM {_CELLS}")
def utm_round_trip(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("zone", grid.utm_zone(F.col("lon"))).withColumn("epsg", grid.utm_epsg(F.col("lon"), F.col("lat")))
    east, north = grid.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    c = c.withColumns({"east": east, "north": north})
    flat = F.when(F.col("lat") < 0, F.col("north") - 1e7).otherwise(F.col("north"))
    lon, lat = grid.from_utm(F.col("east"), flat, F.col("zone"))
    return rounded(c.select("cell_id", "zone", "epsg", lon.alias("lon"), lat.alias("lat")))


_POS = solar.position_columns("days", "lat", "lon")
_SUN = "(SELECT DISTINCT hour, (epoch(hour) - 946728000) / 86400e0 AS days, 40e0 AS lat, -74e0 AS lon FROM {h})"


@query(f"SELECT hour, round(sun_zenith, 5) AS sun_zenith, round(sun_azimuth, 5) AS sun_azimuth FROM {sql_columns(_SUN.format(h=HOURLY), _POS)}")
def solar_position(spark, sf_dir):
    h = hourly(spark, sf_dir).select("hour").distinct().select("hour", ((F.unix_seconds("hour") - 946728000) / 86400.0).alias("days"), F.lit(40.0).alias("lat"), F.lit(-74.0).alias("lon"))
    return rounded(with_columns(h, _POS).select("hour", "sun_zenith", "sun_azimuth"), 5)


_DAYS = "(SELECT DISTINCT date_trunc('day', ts) AS day FROM events)"
_QUARTERS = f"(SELECT day, day + (k.range * INTERVAL 15 MINUTE) AS ts, (epoch(day) + k.range * 900 - 946728000) / 86400e0 AS days, 40e0 AS lat, 0e0 AS lon FROM {_DAYS}, range(0, 96) k)"


@query(f"""WITH a AS (SELECT day, ts, 90e0 - sun_zenith AS alt FROM {sql_columns(_QUARTERS, _POS)}),
n AS (SELECT *, lead(alt) OVER (PARTITION BY day ORDER BY ts) AS nxt FROM a WHERE ts >= day + INTERVAL 615 MINUTE)
SELECT day, round(min_by(alt, ts), 5) AS max_altitude FROM n WHERE nxt IS NULL OR nxt < alt GROUP BY day""")
def daily_max_altitude(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("day")).distinct()
    q = d.withColumn("ts", F.explode(F.sequence("day", F.col("day") + F.expr("INTERVAL '23:45' HOUR TO MINUTE"), F.expr("INTERVAL 15 MINUTES"))))
    q = q.select("day", "ts", ((F.unix_seconds("ts") - 946728000) / 86400.0).alias("days"), F.lit(40.0).alias("lat"), F.lit(0.0).alias("lon"))
    a = with_columns(q, _POS).withColumn("alt", 90 - F.col("sun_zenith"))
    return rounded(timeline.daily_maximum_altitude(a, "alt", ["day"], "ts"), 5)


@query("""SELECT DISTINCT CAST(year(ts) AS INTEGER) AS year, CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, (year(ts) % 4 = 0 AND year(ts) % 100 <> 0) OR year(ts) % 400 = 0 AS leap,
 round(dayofyear(ts) + hour(ts) / 24e0 + minute(ts) / 1440e0, 6) AS dectime, date_trunc('hour', ts) + INTERVAL 1 HOUR * 6 AS local FROM events""")
def time_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.year("ts").alias("year"), F.dayofyear("ts").alias("doy"))
    hour = timeline.from_hours(F.floor(timeline.hours_since_epoch(F.col("ts"))).cast("double"))
    out = e.select("year", "doy", timeline.date_of(F.col("year"), F.col("doy")).cast("string").alias("date"), timeline.is_leap(F.col("year")).alias("leap"), timeline.decimal_day(F.col("doy"), F.hour("ts"), F.minute("ts")).alias("dectime"), timeline.to_local(hour, "Etc/GMT-6").alias("local"))
    return rounded(out).distinct()


@query(f"""WITH RECURSIVE h AS (SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY hour) AS i, hour, v, extract(hour FROM hour) BETWEEN 6 AND 19 AS day, extract(hour FROM hour) = 6 AS first FROM {HOURLY} ),
f AS (SELECT cell, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS hour, 0e0::DOUBLE AS t1, 0e0::DOUBLE AS add, CAST(NULL AS DOUBLE) AS out FROM h GROUP BY cell
 UNION ALL SELECT h.cell, h.i, h.hour,
  CASE WHEN NOT h.day THEN f.t1 WHEN f.add >= 59e0 / 1440e0 THEN h.v * (1 - exp(-33.27e0 * f.add)) + (CASE WHEN h.first THEN h.v ELSE f.t1 END) * exp(-33.27e0 * f.add) ELSE CASE WHEN h.first THEN h.v ELSE f.t1 END END,
  CASE WHEN NOT h.day THEN 0e0 WHEN f.add >= 59e0 / 1440e0 THEN 1e0 / 24e0 ELSE f.add + 1e0 / 24e0 END,
  CASE WHEN h.day THEN h.v * (1 - exp(-33.27e0 * (CASE WHEN f.add >= 59e0 / 1440e0 THEN f.add ELSE f.add + 1e0 / 24e0 END))) + (CASE WHEN h.first THEN h.v ELSE f.t1 END) * exp(-33.27e0 * (CASE WHEN f.add >= 59e0 / 1440e0 THEN f.add ELSE f.add + 1e0 / 24e0 END)) END
  FROM f JOIN h ON h.cell = f.cell AND h.i = f.i + 1)
SELECT cell, hour, round(out, 6) AS delayed FROM f WHERE i > 0""")
def thermal_delay_fold(spark, sf_dir):
    h = hourly(spark, sf_dir).select("cell", "hour", "v", F.hour("hour").between(6, 19).alias("day"), (F.hour("hour") == 6).alias("first"), F.lit(1 / 24).alias("dt"))
    return rounded(timeline.thermal_delay(h, ["cell"], "hour", "v", "day", "first", "dt"))


@query("""SELECT event_id, CAST(year(ts) AS INTEGER) AS iy, CAST(dayofyear(ts) AS INTEGER) AS id, CAST(hour(ts) AS INTEGER) AS it, CAST(minute(ts) AS INTEGER) AS imin,
 round(value / 10, 5) AS wind, round(value % 100, 2) AS rh, 14 AS n_fields FROM events""")
def met_parse_text(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.format_string("%d %d %d %d %s -999 -999 -999 -999 %s %s 20.0 101.3 0", F.year("ts"), F.dayofyear("ts"), F.hour("ts"), F.minute("ts"), F.lit("-999"), F.round(F.col("value") / 10, 5).cast("string"), F.round(F.col("value") % 100, 2).cast("string"))
    parsed = metfile.parse(e.select("event_id", line.alias("value")), keep=["event_id"])
    return parsed.select("event_id", "iy", "id", "it", "imin", F.col("Wind").alias("wind"), F.col("RH").alias("rh"), "n_fields")


@query("""SELECT DISTINCT md5(text) AS h, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY md5(text)""")
def dedupe_by_content_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


@query("""SELECT page_id, regexp_extract(url, '_?([0-9]+)(\\.html)?', 1) AS number, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_replace(url, '[^A-Za-z0-9_]+', '_', 'g') AS name FROM pages""")
def filename_regex_parse(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"_?([0-9]+)(\.html)?", 1).alias("number"), F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_replace("url", r"\W+", "_").alias("name"))


@query("""SELECT o_orderkey, CAST(running AS BIGINT) AS running, running <= 5000000 AS admitted FROM
 (SELECT o_orderkey, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY CAST(floor(o_totalprice) AS BIGINT) DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM orders)""")
def admission_running_sum(spark, sf_dir):
    """Jobs of each client's queue in the order of size, up to a budget."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").alias("bytes"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("bytes"), "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return o.select("o_orderkey", F.sum("bytes").over(w).alias("running")).withColumn("admitted", F.col("running") <= 5000000)


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS INTEGER) AS rank FROM events) WHERE rank <= 5")
def keep_latest_k(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("rank")).filter("rank <= 5")


@query("SELECT event_type, hour, CAST(sum(n) AS BIGINT) AS n, round(sum(v), 4) AS v FROM (SELECT event_type, date_trunc('hour', ts) AS hour, 1 AS n, value AS v FROM events) GROUP BY event_type, hour")
def hourly_tumbling_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return rounded(out.select("event_type", F.col("w.start").alias("hour"), "n", "v"), 4)


@query(f"""WITH m AS (SELECT cell, hour, avg(v) OVER (PARTITION BY cell, date_trunc('day', hour)) AS mean, row_number() OVER (PARTITION BY cell ORDER BY hour) AS i FROM {HOURLY})
SELECT cell, hour, round(last_value(CASE WHEN i = 1 OR extract(hour FROM hour) = 0 THEN mean END IGNORE NULLS) OVER (PARTITION BY cell ORDER BY hour ROWS UNBOUNDED PRECEDING), 6) AS twater FROM m""")
def water_temperature_daily(spark, sf_dir):
    return rounded(timeline.water_temperature(hourly(spark, sf_dir).select("cell", "hour", "v"), ["cell"], "hour", "v").select("cell", "hour", "twater"))


@query("""SELECT tile, max(file) AS file, CAST(split_part(tile, '_', 1) AS BIGINT) AS ti, CAST(split_part(tile, '_', 2) AS BIGINT) AS tj FROM
 (SELECT user_id || '_' || event_id % 7 AS tile, 'DEM_' || user_id || '_' || event_id % 7 || '_v' || event_id % 11 || CASE event_id % 3 WHEN 0 THEN '.tif' WHEN 1 THEN '.TXT' ELSE '.png' END AS file FROM events)
 WHERE NOT file LIKE '%.png' GROUP BY tile""")
def tile_files_latest(spark, sf_dir):
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, ".tif").when(e % 3 == 1, ".TXT").otherwise(".png")
    name = F.concat(F.lit("DEM_"), F.col("user_id").cast("string"), F.lit("_"), (e % 7).cast("string"), F.lit("_v"), (e % 11).cast("string"), kind)
    return grid.tile_files(table(spark, sf_dir, "events").select(name.alias("file")))
