"""Overlays on edges: access, terrain, crossings.

Edges are (edge_id, line array of points, ...), overlays (pos, geometry array of points,
is_ring, tolerance_m, ...); pos is an overlay's place in the order of application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import calendar, geo
from cairn.operators.spatial import boxed_line, met


def touching(edges: DataFrame, overlays: DataFrame, size: float) -> DataFrame:
    """(edge_id, pos): overlays that an edge meets: a ring it enters or crosses, or a line
    within the overlay's tolerance.  Both sides meet through cells of their boxes."""
    lat = F.transform("geometry", lambda p: F.abs(p["lat"]))
    high = F.col("tolerance_m") / geo.LAT_M
    wide = high / F.greatest(F.abs(F.cos(F.radians(F.array_max(lat)))), F.lit(0.01))
    a = boxed_line(edges.select("edge_id", "line"), "a", "line", size)
    b = boxed_line(overlays.select("pos", "geometry", "is_ring", "tolerance_m"), "b", "geometry", size, wide, high)
    pairs = met(a, b, size)
    meets = F.when(F.col("is_ring"), geo.line_meets_ring(F.col("line"), F.col("geometry"))).otherwise(geo.line_distance(F.col("line"), F.col("geometry")) <= F.col("tolerance_m"))
    return pairs.where(meets).select("edge_id", "pos")


def with_access(edges: DataFrame, hits: DataFrame, overlays: DataFrame, date=None, time=None) -> DataFrame:
    """edges with access, travel, confidence and access_confidence after the overlays that
    are active: the last one's access and travel hold, confidence is the least of all,
    access_confidence the largest.  overlays carry a struct `window`."""
    live = overlays.where(calendar.active(F.lit(date).cast("date"), F.lit(time).cast("string"), F.col("window")))
    live = live.select("pos", F.col("access").alias("o_access"), F.col("travel").alias("o_travel"), F.col("confidence").alias("o_conf"))
    by = hits.join(live, "pos").groupBy("edge_id").agg(
        F.max_by("o_access", "pos").alias("o_access"), F.max_by("o_travel", F.when(F.col("o_travel").isNotNull(), F.col("pos"))).alias("o_travel"), F.min("o_conf").alias("low"), F.max("o_conf").alias("high"), F.count("*").alias("n_overlays")
    )
    return edges.join(by, "edge_id", "left").withColumns(
        {
            "access": F.coalesce("o_access", "access"),
            "travel": F.coalesce("o_travel", "travel"),
            "confidence": F.least("confidence", "low"),
            "access_confidence": F.greatest("access_confidence", "high"),
            "n_overlays": F.coalesce("n_overlays", F.lit(0)),
        }
    ).drop("o_access", "o_travel", "low", "high")


def with_terrain(edges: DataFrame, hits: DataFrame, overlays: DataFrame) -> DataFrame:
    """The same law for terrain; a surface holds if its overlay gives one."""
    rows = overlays.select("pos", F.col("terrain").alias("o_terrain"), F.col("surface").alias("o_surface"), F.col("confidence").alias("o_conf"))
    by = hits.join(rows, "pos").groupBy("edge_id").agg(F.max_by("o_terrain", "pos").alias("o_terrain"), F.max_by("o_surface", F.when(F.col("o_surface").isNotNull(), F.col("pos"))).alias("o_surface"), F.min("o_conf").alias("low"), F.max("o_conf").alias("high"))
    return edges.join(by, "edge_id", "left").withColumns(
        {"terrain": F.coalesce("o_terrain", "terrain"), "surface": F.coalesce("o_surface", "surface"), "confidence": F.least("confidence", "low"), "terrain_confidence": F.greatest("terrain_confidence", "high")}
    ).drop("o_terrain", "o_surface", "low", "high")


def with_crossings(edges: DataFrame, context: DataFrame, size: float) -> DataFrame:
    """edges with road_crossings, water_crossings, road_exposure and confidence from lines
    (kind, line, confidence, source_id) that cross them.  Of several lines of one kind and
    source the largest count stands; a line of the edge's own source doesn't count."""
    a = boxed_line(edges.select("edge_id", "line", F.col("source_id").alias("own")), "a", "line", size)
    b = boxed_line(context.select("kind", F.col("line").alias("other"), F.col("confidence").alias("o_conf"), "source_id"), "b", "other", size)
    hits = met(a, b, size).where("own is null or source_id is null or own != source_id")
    hits = hits.withColumn("n", geo.crossing_count(F.col("line"), F.col("other"))).where("n > 0")
    one = hits.groupBy("edge_id", "kind", "source_id").agg(F.max("n").alias("n"), F.min("o_conf").alias("o_conf"))
    exposure = F.least(F.max(F.when(F.col("kind") == "road", F.col("n"))) * 0.03, F.lit(0.20))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    by = one.groupBy("edge_id").agg(of("road").alias("road_crossings"), of("water").alias("water_crossings"), exposure.alias("exposed"), F.min("o_conf").alias("low"))
    out = edges.join(by, "edge_id", "left")
    return out.withColumns({"road_exposure": F.greatest("road_exposure", "exposed"), "confidence": F.least("confidence", "low"), "road_crossings": F.coalesce("road_crossings", F.lit(0)), "water_crossings": F.coalesce("water_crossings", F.lit(0))}).drop("exposed", "low")
