"""The stateless operators on streams, and sums by window with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urban_spark.operators.risk import aqi, aqi_category


def with_aqi(readings: DataFrame, *, pm25: str = "pm2_5", pm10: str = "pm10") -> DataFrame:
    """Runs on a stream as on a table."""
    return readings.withColumn("aqi", aqi(F.col(pm25), F.col(pm10))).withColumn("category", aqi_category(F.col("aqi")))


def windowed_sums(events: DataFrame, value: str, *, time: str = "ts", key: str = "station", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sum and count by key and window; rows later than `late` behind the newest are left out and their state is dropped."""
    windows = events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return windows.select(key, F.col("window.start").alias("start"), "total", "n")
