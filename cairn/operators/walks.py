"""Walks: edges in order from a start, checked against travel rules and turn bans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def walked(walks: DataFrame, edges: DataFrame, bans: DataFrame) -> DataFrame:
    """(walk_id, end_v, legs array<struct<edge_id, from_v, to_v>>) of those walks (walk_id,
    start_v, edges array) that are legal: each edge leaves where the last one ended, its
    travel rule lets it, and no turn onto it is banned.  Closed and private edges may be walked:
    access is a matter of constraints.  A walk without edges ends where it starts.  edges:
    (edge_id, a, b, travel); bans: (from_edge, via_v, to_edge)."""
    rows = walks.select("walk_id", "start_v", F.posexplode_outer("edges").alias("seq", "edge_id"))
    e = edges.select("edge_id", "a", "b", F.coalesce("travel", F.lit("both")).alias("travel"))
    step = F.struct("seq", "edge_id", "a", "b", "travel")
    steps = rows.join(e, "edge_id", "left").groupBy("walk_id", "start_v").agg(F.array_sort(F.collect_list(F.when(c("seq").isNotNull(), step))).alias("steps"))
    leg = "array<struct<edge_id:bigint,from_v:bigint,to_v:bigint>>"

    def go(state: Column, x: Column) -> Column:
        at = state["at"]
        to = F.when((x["a"] == at) & (x["travel"] != "backward"), x["b"]).when((x["b"] == at) & (x["travel"] != "forward"), x["a"])
        new = F.struct(x["edge_id"].cast("bigint").alias("edge_id"), at.alias("from_v"), to.alias("to_v"))
        return F.struct(to.alias("at"), F.concat(state["legs"], F.array(new)).alias("legs"))

    start = F.struct(c("start_v").cast("bigint").alias("at"), F.array().cast(leg).alias("legs"))
    done = steps.select("walk_id", F.aggregate("steps", start, go).alias("w")).where("w.at is not null").select("walk_id", c("w.at").alias("end_v"), "w.legs")
    turn = F.zip_with(F.slice("legs", 1, F.greatest(F.size("legs") - 1, F.lit(0))), F.slice("legs", 2, F.greatest(F.size("legs") - 1, F.lit(0))), lambda x, y: F.struct(x["edge_id"].alias("from_edge"), y["from_v"].alias("via_v"), y["edge_id"].alias("to_edge")))
    banned = done.select("walk_id", F.explode(turn).alias("t")).select("walk_id", "t.*").join(bans, ["from_edge", "via_v", "to_edge"], "left_semi").select("walk_id").distinct()
    return done.join(banned, "walk_id", "left_anti")


def line_starts(walks: DataFrame, edges: DataFrame, bans: DataFrame, vertices: DataFrame) -> DataFrame:
    """(walk_id, start_v): of the ends of a walk's first edge from which it is legal the one
    nearest (in degrees) to where its trace starts.  walks: (walk_id, edges array, lon, lat)."""
    ends = edges.select("edge_id", F.explode(F.array("a", "b")).alias("start_v"))
    both = walks.select("walk_id", "edges", "lon", "lat", F.get("edges", F.lit(0)).alias("edge_id")).join(ends, "edge_id")
    both = both.withColumn("try", F.struct("walk_id", "start_v"))
    legal = walked(both.select(c("try").alias("walk_id"), "start_v", "edges"), edges, bans).select(c("walk_id").alias("try"))
    at = vertices.select(c("v").alias("start_v"), c("lon").alias("x"), c("lat").alias("y"))
    near = both.join(legal, "try").join(at, "start_v")
    d2 = F.pow(c("x") - c("lon"), 2) + F.pow(c("y") - c("lat"), 2)
    return near.groupBy("walk_id").agg(F.min_by("start_v", F.struct(d2, "start_v")).alias("start_v"))


def snap_statistics(segments: DataFrame, max_snap_m: float, apart: DataFrame | None = None) -> DataFrame:
    """(trace_id, segment_count, snapped_segment_count, rejected_segment_count,
    disconnected_transition_count, max_snap_m, mean_snap_m) of a trace's segments with the
    distance_m of the edge nearest to each one's middle (null: no edge at all).  apart: a row
    (trace_id) per transition between edges that no way joins."""
    ok = F.coalesce(c("distance_m") <= max_snap_m, F.lit(False))
    count = lambda x: F.sum(x.cast("long"))
    rows = segments.groupBy("trace_id").agg(F.count("*").alias("segment_count"), count(ok).alias("snapped_segment_count"), count(~ok).alias("rejected_segment_count"), F.coalesce(F.max("distance_m"), F.lit(0.0)).alias("max_snap_m"), F.coalesce(F.avg("distance_m"), F.lit(0.0)).alias("mean_snap_m"))
    cut = apart.groupBy("trace_id").agg(F.count("*").alias("n_")) if apart is not None else rows.select("trace_id", F.lit(0).cast("long").alias("n_")).limit(0)
    rows = rows.join(cut, "trace_id", "left").withColumn("disconnected_transition_count", F.coalesce("n_", F.lit(0).cast("long")))
    return rows.select("trace_id", "segment_count", "snapped_segment_count", "rejected_segment_count", "disconnected_transition_count", "max_snap_m", "mean_snap_m")


def summary(m: dict[str, Column] | None = None) -> Column:
    """One line that tells a route's measures."""
    g = lambda k: (m or {}).get(k, c(k))
    text = "shape %s; distance %.2f km; ascent/descent %.0f/%.0f m; lower-limb load %.2f FGJW km; moving time %.2f h; road %.1f%%; low-confidence %.1f%%; restricted-access %.1f%%; repeated-edge %.1f%%"
    share = lambda k: F.coalesce(g(k), F.lit(0.0)) * 100.0
    return F.format_string(text, g("shape"), g("distance_m") / 1000.0, g("ascent_m"), g("descent_m"), g("load_km"), g("moving_time_s") / 3600.0, share("road_fraction"), share("low_confidence_fraction"), share("restricted_fraction"), share("repeated_fraction"))
