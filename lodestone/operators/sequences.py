"""Order-dependent logic over rows: islands, carried values, clamped running depth, event windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], hit: Column, gap: int, least: int) -> DataFrame:
    """keys, first_pos, last_pos, size: runs of hits at most ``gap`` positions apart, of ``least`` or more."""
    w = Window.partitionBy(*keys).orderBy(*order)
    own = df.withColumn("pos", F.row_number().over(w).cast("long")).where(hit)
    w = Window.partitionBy(*keys).orderBy("pos")
    own = own.withColumn("island", F.sum(F.when(F.col("pos") - F.lag("pos").over(w) <= gap, 0).otherwise(1)).over(w))
    out = own.groupBy(*keys, "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("size"))
    return out.where(F.col("size") >= least).drop("island")


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the last value that isn't null up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def clamped_depth(df: DataFrame, keys: list[str], order: list[str], change: Column, name: str = "depth") -> DataFrame:
    """df with the running sum of changes that never goes below zero."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("__s", F.sum(change).over(w))
    return own.withColumn(name, (F.col("__s") - F.least(F.lit(0), F.min("__s").over(w))).cast("long")).drop("__s")


def tumbling(events: DataFrame, ts: str, size: str, *keys: str) -> DataFrame:
    return _windowed(events.groupBy(F.window(ts, size).alias("w"), *keys), keys)


def sliding(events: DataFrame, ts: str, size: str, step: str, *keys: str) -> DataFrame:
    return _windowed(events.groupBy(F.window(ts, size, step).alias("w"), *keys), keys)


def sessions(events: DataFrame, ts: str, gap: str, *keys: str) -> DataFrame:
    return _windowed(events.groupBy(F.session_window(ts, gap).alias("w"), *keys), keys)


def _windowed(grouped, keys) -> DataFrame:
    out = grouped.agg(F.count(F.lit(1)).alias("n_events"))
    return out.select(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(w.start AS TIMESTAMP_NTZ))").alias("start_us"), *keys, "n_events")
