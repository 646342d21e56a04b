"""Traces: ordered points (trace_id, pos, lon, lat, ele) as rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.geo import haversine
from cairn.operators.routes import grade_bin

SPACING_M, STEEP = 25.0, 0.20


def legs(points: DataFrame) -> DataFrame:
    """Each point with the one before it: lon0, lat0, ele0, the metres between and their
    running sum.  A trace's first point has none of these but a sum of 0."""
    w = Window.partitionBy("trace_id").orderBy("pos")
    rows = points.withColumns({f"{c}0": F.lag(c).over(w) for c in ("lon", "lat", "ele")})
    rows = rows.withColumn("m", haversine(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat")))
    return rows.withColumn("along_m", F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))


def lengths(points: DataFrame) -> DataFrame:
    return legs(points).groupBy("trace_id").agg(F.count("*").alias("n_points"), F.coalesce(F.sum("m"), F.lit(0.0)).alias("length_m"))


def profile(points: DataFrame, steep: float = STEEP) -> DataFrame:
    """Length, ascent, descent, metres by grade bin, steep metres, mean and greatest grade.
    Legs without both elevations have a length but no grade."""
    d = F.col("ele") - F.col("ele0")
    rows = legs(points).withColumn("grade", F.when(F.col("m") > 0, d / F.col("m"))).withColumn("gm", F.when(F.col("grade").isNotNull(), F.col("m")).otherwise(0.0))
    return rows.groupBy("trace_id").agg(
        F.coalesce(F.sum("m"), F.lit(0.0)).alias("length_m"),
        F.sum(F.when(d >= 0, d).otherwise(0.0)).alias("ascent_m"),
        F.sum(F.when(d < 0, -d).otherwise(0.0)).alias("descent_m"),
        *grade_bin(F.col("grade"), F.col("gm")),
        F.sum(F.when(F.abs("grade") >= steep, F.col("gm")).otherwise(0.0)).alias("sustained_steep_m"),
        (F.sum(F.coalesce(F.abs("grade"), F.lit(0.0)) * F.col("gm")) / F.greatest(F.sum("gm"), F.lit(1.0))).alias("mean_grade"),
        F.coalesce(F.max(F.abs("grade")), F.lit(0.0)).alias("max_grade"),
    )


def densified(points: DataFrame, spacing_m: float = SPACING_M) -> DataFrame:
    """(trace_id, pos, step, lon, lat): all points, and between two of them one every
    spacing_m metres, strictly before the second.  Row-wise once points have their
    predecessor."""
    rows = legs(points)
    inner = F.when(F.col("m") > spacing_m, F.sequence(F.lit(1), (F.ceil(F.col("m") / spacing_m) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    step = F.explode(F.concat(inner, F.array(F.lit(0)))).alias("step")
    t = F.when(F.col("step") == 0, 1.0).otherwise(F.col("step") * spacing_m / F.col("m"))
    at = lambda c: F.when(F.col("step") == 0, F.col(c)).otherwise(F.col(f"{c}0") + (F.col(c) - F.col(f"{c}0")) * t)
    return rows.select("*", step).select("trace_id", "pos", "step", at("lon").alias("lon"), at("lat").alias("lat"))


def located(points: DataFrame, asked: DataFrame) -> DataFrame:
    """(trace_id, along_m, lon, lat, ele) of places along traces; asked: (trace_id, at_m).

    An as-of join by window: places and points are sorted together, and a place takes the
    last point before it and the first at or after it.  Beyond an end it is that end."""
    p = legs(points).select("trace_id", F.col("along_m").alias("k"), F.struct("along_m", "lon", "lat", "ele").alias("p"), F.lit(0).alias("ask"), "pos")
    a = asked.select("trace_id", F.col("at_m").alias("k"), F.lit(None).cast(p.schema["p"].dataType).alias("p"), F.lit(1).alias("ask"), F.lit(0).cast(p.schema["pos"].dataType).alias("pos"))
    w = Window.partitionBy("trace_id").orderBy("k", "ask", "pos")
    both = p.union(a)
    both = both.withColumn("lo", F.last("p", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.first("p", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    rows = both.where("ask = 1").withColumn("lo", F.coalesce("lo", "hi")).withColumn("hi", F.coalesce("hi", "lo"))
    span = F.col("hi.along_m") - F.col("lo.along_m")
    t = F.when(span > 0, (F.col("k") - F.col("lo.along_m")) / span).otherwise(0.0)
    mid = lambda c: (F.col(f"lo.{c}") + (F.col(f"hi.{c}") - F.col(f"lo.{c}")) * t).alias(c)
    return rows.where("lo is not null").select("trace_id", F.col("k").alias("at_m"), mid("lon"), mid("lat"), mid("ele"))


def kept_points(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Positions that Douglas-Peucker keeps: a point goes unless it is farther than the
    tolerance from the chord (strictly)."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        n = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / n, 0, 1) if n else np.zeros(len(px))
        d = np.hypot(px - t * dx, py - t * dy)
        k = int(d.argmax())
        if d[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplified(points: DataFrame, tolerance_m: float = 50.0) -> DataFrame:
    """The points that Douglas-Peucker keeps, in a plane around each trace's first point."""
    rows = points.select("trace_id", "pos", "lon", "lat", "ele")

    def simplify(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        lon, lat = t.column("lon").to_numpy(), t.column("lat").to_numpy()
        keep = kept_points((lon - lon[0]) * 111_320 * np.cos(np.radians(lat[0])), (lat - lat[0]) * 110_540, tolerance_m)
        return t.filter(pa.array(keep))

    return rows.groupBy("trace_id").applyInArrow(simplify, rows.schema)


def islands(rows: DataFrame, by: list[str], order: str, same: list[Column]) -> DataFrame:
    """rows with `island`: a number that grows by one wherever `same` does not hold with the
    row before (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(order)
    joined = same[0]
    for s in same[1:]:
        joined = joined & s
    start = F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)
    return rows.withColumn("start_", start).withColumn("island", F.sum("start_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("start_")


def coalesced_gaps(gaps: DataFrame) -> DataFrame:
    """(trace_id, kind, first_segment, last_segment, nearest_m): runs of gaps of one kind that
    touch or overlap are one; nearest_m is the largest, null where any is unknown."""
    w = Window.partitionBy("trace_id").orderBy("first_segment", "last_segment", "kind")
    reach = F.max("last_segment").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = gaps.withColumn("joins_", (F.lag("kind").over(w) == F.col("kind")) & (F.col("first_segment") <= reach + 1))
    rows = rows.withColumn("island", F.sum(F.when(F.coalesce("joins_", F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    near = F.when(F.count("nearest_m") == F.count("*"), F.max("nearest_m"))
    return rows.groupBy("trace_id", "island", "kind").agg(F.min("first_segment").alias("first_segment"), F.max("last_segment").alias("last_segment"), near.alias("nearest_m")).drop("island")
