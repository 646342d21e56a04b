"""Traces as streams of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.geo import haversine


def windowed_lengths(points: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Metres and points per trace and window of event time, from a stream of points
    (trace_id, ts, lon, lat).  Points of a window are put in order before they are measured;
    what comes later than the watermark is dropped by Spark."""
    one = points.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "trace_id").agg(F.array_sort(F.collect_list(F.struct("ts", "lon", "lat"))).alias("p"))
    n = F.size("p") - 1
    legs = F.zip_with(F.slice("p", F.lit(1), n), F.slice("p", F.lit(2), n), lambda a, b: haversine(a["lon"], a["lat"], b["lon"], b["lat"]))
    length = F.when(n > 0, F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)
    return one.select("trace_id", F.col("w.start").alias("from_ts"), F.size("p").alias("n_points"), length.alias("length_m"))
