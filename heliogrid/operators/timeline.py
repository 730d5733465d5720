"""Ordered operators over time: as-of joins, daily aggregates, night runs, delays, time parsing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wind
from ..functions.expr import column

NIGHT_SW = 5.0
DELAY = 33.27
DELAY_STEP = 59 / 1440


def decimal_day(doy: Column, hour: Column, minute: Column) -> Column:
    return doy + hour / 24 + minute / 1440


def date_of(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy.cast("int") - 1)


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def hours_since_epoch(ts: Column) -> Column:
    return F.unix_micros(ts) / 3.6e9


def from_hours(hours: Column) -> Column:
    return F.timestamp_micros((hours * 3.6e9).cast("long"))


def to_local(ts: Column, zone: str) -> Column:
    """UTC to local clock time.  The zone is a parameter: no boundary polygons are looked up."""
    return F.from_utc_timestamp(ts, zone)


def to_utc(ts: Column, zone: str) -> Column:
    return F.to_utc_timestamp(ts, zone)


def valid_time(valid: Column, time: Column, step_hours: Column) -> Column:
    """A forecast's valid time: as given, else run time plus step."""
    return F.coalesce(valid, F.timestamp_micros(F.unix_micros(time) + (step_hours * 3.6e9).cast("long")))


def band_time(date: Column, hour: Column, minute: Column) -> Column:
    """A band's time stamp: the selected date with the row's clock; the date never advances."""
    return F.make_timestamp(F.year(date), F.month(date), F.dayofmonth(date), hour.cast("int"), minute.cast("int"), F.lit(0).cast("decimal(16,6)"))


def daily(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Mean, greatest, least and range per key and day."""
    out = df.groupBy(*keys, F.date_trunc("day", ts).alias("day")).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"))
    return out.withColumn("dtr", F.col("max") - F.col("min"))


def heat_island_daily(df: DataFrame, keys: list[str], ts: str, t2: str, sw: str, wind_speed: str) -> DataFrame:
    """The daily heat-island amplitude of each key: day, amplitude."""
    d = df.groupBy(*keys, F.date_trunc("day", ts).alias("day")).agg(F.avg(sw).alias("sw_"), F.avg(wind_speed).alias("u_"), (F.max(t2) - F.min(t2)).alias("dtr_"))
    return d.select(*keys, "day", column(wind.heat_island_amplitude("sw_", "dtr_", "u_")).alias("amplitude"))


def forward_fill(daily_rows: DataFrame, hourly_rows: DataFrame, keys: list[str], ts: str, day: str, value: str) -> DataFrame:
    """Hourly rows with the last daily value at or before them, 0 before the first.

    An as-of join as a union and one window: both sides are shuffled once by key.
    """
    a = daily_rows.select(*keys, F.col(day).alias(ts), F.col(value).alias("d_"), F.lit(0).alias("side_"))
    b = hourly_rows.select(*keys, ts, F.lit(None).cast("double").alias("d_"), F.lit(1).alias("side_"))
    w = Window.partitionBy(*keys).orderBy(ts, "side_").rowsBetween(Window.unboundedPreceding, 0)
    filled = a.unionByName(b).withColumn(value, F.coalesce(F.last("d_", ignorenulls=True).over(w), F.lit(0.0)))
    return filled.filter("side_ = 1").select(*keys, ts, value)


def night_profile(df: DataFrame, keys: list[str], ts: str, sw: str, amplitude: str) -> DataFrame:
    """Adds night: a half sine over each run of consecutive night rows, scaled by the run's mean amplitude.

    Night is sw <= 5.  Runs of one row, or of mean amplitude 0 or less, give 0.
    """
    order = Window.partitionBy(*keys).orderBy(ts)
    df = df.withColumn("is_", F.coalesce((F.col(sw) <= NIGHT_SW) & ~F.isnan(sw), F.lit(False)))
    df = df.withColumn("run_", F.sum(F.when(F.col("is_"), 0).otherwise(1)).over(order))
    run = Window.partitionBy(*keys, "run_", "is_")
    n, j = F.count(F.lit(1)).over(run), F.row_number().over(run.orderBy(ts)) - 1
    mean = F.avg(F.nanvl(amplitude, F.lit(None))).over(run)
    shape = F.greatest(F.sin(math.pi * j / F.greatest(n - 1, F.lit(1))), F.lit(0.0))
    night = F.when(F.col("is_") & (n >= 2) & (mean > 0), mean * shape).otherwise(0.0)
    return df.withColumn("night", night).drop("is_", "run_")


def window(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """The rows from start to end, both included; a null time is in no window."""
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def first_step_length(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds step: the second row's value less the first's, for every row of a key."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("step", F.nth_value(value, 2).over(w) - F.first(value).over(w))


def thermal_delay(df: DataFrame, keys: list[str], order: str, value: str, day: str, first: str, step: str) -> DataFrame:
    """The thermal-wave delay of a surface flux, folded over time within each key.

    ``day`` is false at night, when the clock resets and nothing is put out (null); ``first``
    marks a day's first step; ``step`` is the time step in days.  One row per input row.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("double").alias("t0"), F.col(day).alias("day"), F.col(first).alias("first"), F.col(step).cast("double").alias("dt"))))
    grouped = df.groupBy(*keys).agg(rows.alias("rows"))
    out_type = df.schema[order].dataType.simpleString()
    start = F.expr(f"named_struct('t1', 0D, 'add', 0D, 'out', CAST(array() AS array<struct<o:{out_type},v:double>>))")

    def step_(s, r):
        t1 = F.when(r["first"], r["t0"]).otherwise(s["t1"])
        long = s["add"] >= DELAY_STEP
        add = F.when(long, s["add"]).otherwise(s["add"] + r["dt"])
        k = F.exp(-DELAY * add)
        mixed = r["t0"] * (1 - k) + t1 * k
        after = F.when(long, F.when(r["dt"] > DELAY_STEP, r["dt"]).otherwise(0.0)).otherwise(add)
        row = F.struct(r[order].alias("o"), F.when(r["day"], mixed).alias("v"))
        return F.struct(
            F.when(~r["day"], s["t1"]).when(long, mixed).otherwise(t1).alias("t1"),
            F.when(~r["day"], F.lit(0.0)).otherwise(after).alias("add"),
            F.concat(s["out"], F.array(row)).alias("out"),
        )

    folded = grouped.select(*keys, F.explode(F.aggregate("rows", start, step_, lambda s: s["out"])).alias("r"))
    return folded.select(*keys, F.col("r.o").alias(order), F.col("r.v").alias("delayed"))


def daily_maximum_altitude(days: DataFrame, altitude: str, keys: list[str], ts: str) -> DataFrame:
    """From rows in 15-minute steps: per key, the altitude before the first fall at or after 10:15."""
    w = Window.partitionBy(*keys).orderBy(ts)
    rows = days.filter(F.date_format(ts, "HH:mm") >= "10:15").withColumn("next_", F.lead(altitude).over(w))
    return rows.filter(F.col("next_").isNull() | (F.col("next_") < F.col(altitude))).groupBy(*keys).agg(F.min_by(altitude, ts).alias("max_altitude"))


def water_temperature(df: DataFrame, keys: list[str], ts: str, ta: str) -> DataFrame:
    """twater: the mean of ``ta`` over the day, taken at the first row and at each midnight and kept until the next."""
    ordered = Window.partitionBy(*keys).orderBy(ts)
    mean = F.avg(ta).over(Window.partitionBy(*keys, F.to_date(ts)))
    taken = (F.row_number().over(ordered) == 1) | (F.date_trunc("day", ts) == F.col(ts))
    out = df.withColumns({"mean_": mean, "taken_": taken})
    kept = F.last(F.when(F.col("taken_"), F.col("mean_")), ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("twater", kept).drop("mean_", "taken_")
