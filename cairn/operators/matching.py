"""Map matching: which edges a recorded trace walked, in order, and where it left the network.

Every segment of a trace goes to the edge nearest to its middle.  Changes of edge are the
trace's anchors; an anchor enters its edge at the end that the trace came from.  Anchors that
only flicker beside an edge which the whole span fits are dropped.  Anchors that don't touch
are connected by the shortest legal way within a budget; where there is none, the walk starts
anew behind the gap.

An anchor that can be entered leaves its edge at the other end, whatever came before it.  So
every connection depends on two anchors only, and all of all traces are searched at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geo
from cairn.operators import spatial, walks
from cairn.operators.graph import directed, steps
from cairn.state import dropped, stored

c = F.col

#: How a connector's budget in metres follows from its segment.
BUDGET_TIMES, SNAP_TIMES, BUDGET_OPEN_M, BUDGET_LEAST_M = 3.0, 2.0, 500.0, 50.0
#: Fixed value: metres along an edge that are none; of a segment square to its edge only
#: rounding would tell which end is farther along.
LEVEL_M = 1e-6
#: Of edges equally near, which one is taken.
ACCESS_RANK = {"open": 0, "unknown": 1, "restricted": 1, "closed": 2, "private": 2}
KIND_RANK = {"track": 1, "service-road": 2, "roadway": 3, "unknown": 3}


@dataclass
class Coverage:
    """legs (trace_id, seq, edge_id); gaps (trace_id, kind, first_segment, last_segment,
    nearest_edge, nearest_distance_m, before_edge, after_edge); stats, a row per trace."""

    legs: DataFrame
    gaps: DataFrame
    stats: DataFrame


def _ranked(value: Column, ranks: dict[str, int], default: int) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.coalesce(F.get(F.array(F.try_element_at(known, F.coalesce(value, F.lit("")))), F.lit(0)), F.lit(default))


def anchor_rank(edges: DataFrame) -> Column:
    """Open before unknown before closed, surveyed before proxies, paths before roads."""
    have = {f.lower() for f in edges.columns}
    access = _ranked(c("access"), ACCESS_RANK, 1) if "access" in have else F.lit(0)
    claim = F.when(c("claim") == "centerline-proxy", 1).otherwise(0) if "claim" in have else F.lit(0)
    kind = _ranked(c("kind"), KIND_RANK, 0) if "kind" in have else F.lit(0)
    return F.struct(access.alias("access"), claim.alias("claim"), kind.alias("kind"))


def trace_segments(points: DataFrame) -> DataFrame:
    """(trace_id, seg, lon1, lat1, lon2, lat2) of traces (trace_id, pos, lon, lat): seg from 0."""
    w = Window.partitionBy("trace_id").orderBy("pos")
    rows = points.select("trace_id", (F.row_number().over(w) - 1).alias("seg"), c("lon").alias("lon1"), c("lat").alias("lat1"), F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"))
    return rows.where("lon2 is not null")


def edge_segments(edges: DataFrame) -> DataFrame:
    """(edge_id, lon1, lat1, lon2, lat2, anchor), a row per segment of each edge's line."""
    rows = edges.select("edge_id", anchor_rank(edges).alias("anchor"), F.explode(geo.segments(c("line"))).alias("s"))
    return rows.select("edge_id", c("s.a.lon").alias("lon1"), c("s.a.lat").alias("lat1"), c("s.b.lon").alias("lon2"), c("s.b.lat").alias("lat2"), "anchor")


def middles(segments: DataFrame) -> DataFrame:
    half = lambda a, b: c(a) + (c(b) - c(a)) * 0.5
    return segments.select("trace_id", "seg", half("lon1", "lon2").alias("lon"), half("lat1", "lat2").alias("lat"))


def anchors(segments: DataFrame, near: DataFrame, edges: DataFrame, max_snap_m: float) -> DataFrame:
    """(trace_id, n, seg, edge_id, entry, exit, live, budget_m): a row where the edge of a
    trace's snapped segments changes, n from 1.  near: (trace_id, seg, edge_id, distance_m).
    live: the edge's travel rule lets a walk enter there.  A segment that goes neither way
    along its edge enters it at a."""
    w = Window.partitionBy("trace_id").orderBy("seg")
    rows = segments.join(near.where(c("distance_m") <= max_snap_m), ["trace_id", "seg"]).withColumn("was", F.lag("edge_id").over(w)).where("was is null or was != edge_id")
    rows = rows.join(edges.select("edge_id", "a", "b", F.coalesce("travel", F.lit("both")).alias("travel"), "line", geo.along(c("line")).alias("line_m")), "edge_id")
    progress = lambda k: geo.line_projection(F.struct(c(f"lon{k}").alias("lon"), c(f"lat{k}").alias("lat")), c("line"), c("line_m"))["progress_m"]
    allowance = BUDGET_OPEN_M if max_snap_m == float("inf") else max_snap_m * SNAP_TIMES
    budget = F.greatest(geo.haversine(c("lon1"), c("lat1"), c("lon2"), c("lat2")) * BUDGET_TIMES + allowance, F.lit(BUDGET_LEAST_M))
    rows = rows.select("*", (progress(2) - progress(1) >= -LEVEL_M).alias("ahead"), budget.alias("budget_m"))
    entry, out = F.when(c("ahead"), c("a")).otherwise(c("b")), F.when(c("ahead"), c("b")).otherwise(c("a"))
    live = F.when(c("ahead"), c("travel") != "backward").otherwise(c("travel") != "forward")
    return rows.select("trace_id", F.row_number().over(w).alias("n"), "seg", "edge_id", entry.alias("entry"), out.alias("exit"), live.alias("live"), "budget_m")


def _taken(intervals: DataFrame) -> DataFrame:
    """Of intervals (trace_id, n, far) those that a walk from the left takes: the first, then
    each time the first that starts behind the end of the last one taken.

    Jumps of 1, 2, 4, ... intervals are composed and then all followed from the first, so
    rounds grow with the logarithm of a trace's intervals."""
    marks = intervals.select("trace_id", c("n").alias("at"), c("n").alias("start"), F.lit(None).cast("int").alias("of")).unionByName(intervals.select("trace_id", c("far").alias("at"), F.lit(None).cast("int").alias("start"), c("n").alias("of")))
    w = Window.partitionBy("trace_id").orderBy("at", c("start").isNull()).rowsBetween(1, Window.unboundedFollowing)
    jump = stored(marks.select("trace_id", "of", F.first("start", ignorenulls=True).over(w).alias("to")).where("of is not null and to is not null"), "jumps")
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        on = jump.select("trace_id", c("of").alias("to"), c("to").alias("next"))
        jump = stored(jump.join(on, ["trace_id", "to"]).select("trace_id", "of", c("next").alias("to")), "jumps")
    dropped(jump)
    taken = intervals.groupBy("trace_id").agg(F.min("n").alias("n"))
    for j in reversed(jumps):
        taken = taken.union(taken.join(j, (taken["trace_id"] == j["trace_id"]) & (c("n") == c("of"))).select(taken["trace_id"], c("to").alias("n")))
    out = stored(intervals.join(taken.distinct(), ["trace_id", "n"]), "taken")
    dropped(*jumps)
    return out


def without_shadows(found: DataFrame, mids: DataFrame, parts: DataFrame, max_snap_m: float) -> DataFrame:
    """anchors() without those between two anchors of one edge and entry if the middles of all
    segments from the one to the other are within max_snap_m of that edge; of the two the
    first stays."""
    again = found.groupBy("trace_id", "edge_id", "entry").agg(F.count("*").alias("k")).where("k > 1").select("trace_id", "edge_id").distinct()
    again = stored(again, "again")
    if again.isEmpty():
        return found
    fits = spatial.edges_within(mids.join(again.select("trace_id").distinct(), "trace_id", "left_semi"), ["trace_id", "seg"], parts, max_snap_m).join(again, ["trace_id", "edge_id"], "left_semi")
    w = Window.partitionBy("trace_id", "edge_id").orderBy("seg")
    island = fits.select("trace_id", "edge_id", "seg", (c("seg") - F.row_number().over(w)).alias("island"))
    own = found.join(island, ["trace_id", "edge_id", "seg"])
    far = F.max("n").over(Window.partitionBy("trace_id", "edge_id", "entry", "island"))
    intervals = stored(own.select("trace_id", "n", far.alias("far")).where("far >= n + 2"), "intervals")
    if intervals.isEmpty():
        return found
    ends = _taken(intervals).select("trace_id", "n", "far")
    w = Window.partitionBy("trace_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    kept = found.join(ends, ["trace_id", "n"], "left").withColumn("until", F.max("far").over(w)).where("until is null or n > until")
    return kept.select(*found.columns)


QUERY = ["start_v", "after_edge", "target", "entry"]


def connectors(step: DataFrame, bans: DataFrame, asked: DataFrame) -> DataFrame:
    """(start_v, after_edge, target, entry, dist, edges) for those of the asked (the same four,
    most) that have a legal way of at most `most` metres: from start_v, where a walk arrived
    by after_edge, to `entry`, so that the turn onto `target` is legal, without target itself.

    All are searched at once, by frontier: a round writes the states that it improves.  step:
    graph.steps() over the same bans."""
    banned = bans.select(c("from_edge").alias("last"), c("via_v").alias("v"))
    one = asked.groupBy(*QUERY).agg(F.max("most").alias("most"))
    begin = one.join(banned.distinct(), (c("after_edge") == c("last")) & (c("start_v") == c("v")), "left").select(*QUERY, "most", c("start_v").alias("v"), "last")
    state = F.struct("dist", "hops", "edges")
    keys = [*QUERY, "v", "last"]
    front = stored(begin.select(*keys, "most", F.struct(F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.array().cast("array<bigint>").alias("edges")).alias("p")), "front")
    written = [front]
    while True:
        go = front.withColumnRenamed("last", "was").join(step, (c("v") == c("from_v")) & c("was").eqNullSafe(c("last_in")) & (c("edge_id") != c("target")))
        go = go.select(*QUERY, "most", c("to_v").alias("v"), "last", (c("p.dist") + c("cost")).alias("dist"), (c("p.hops") + 1).alias("hops"), F.concat("p.edges", F.array("edge_id")).alias("edges")).where("dist <= most")
        new = go.groupBy(*keys).agg(F.max("most").alias("most"), F.min(state).alias("p"))
        known = reduce(DataFrame.unionByName, written).groupBy(*keys).agg(F.min("p").alias("o"))
        same = reduce(lambda x, y: x & y, [new[k].eqNullSafe(known[k]) for k in keys])
        front = stored(new.join(known, same, "left").where("o is null or p < o").select(*[new[k] for k in keys], "most", "p"), "front")
        written.append(front)
        if front.isEmpty():
            break
    goal = reduce(DataFrame.unionByName, written).where("v = entry")
    no = bans.select(c("from_edge").alias("last"), c("via_v").alias("v"), c("to_edge").alias("target"))
    out = stored(goal.join(no, ["last", "v", "target"], "left_anti").groupBy(*QUERY).agg(F.min("p").alias("p")).select(*QUERY, "p.dist", "p.edges"), "connectors")
    dropped(*written)
    return out


def _ends(edges: DataFrame, side: str) -> DataFrame:
    """(edge_id, v): where a walk may leave each edge (side out) or enter it (in)."""
    ahead, back = (("b", "a") if side == "out" else ("a", "b"))
    travel = F.coalesce("travel", F.lit("both"))
    ways = F.array(F.when(travel != "backward", c(ahead)), F.when(travel != "forward", c(back)))
    return edges.select("edge_id", F.explode(ways).alias("v")).where("v is not null")


def _linked(pairs: DataFrame, edges: DataFrame, step: DataFrame, bans: DataFrame) -> DataFrame:
    """Of pairs (before, after, most) the distinct ones that any legal way of at most `most`
    metres joins, from either end of the one to either end of the other."""
    both = pairs.distinct().join(_ends(edges, "out").select(c("edge_id").alias("before"), c("v").alias("start_v")), "before").join(_ends(edges, "in").select(c("edge_id").alias("after"), c("v").alias("entry")), "after")
    no = bans.select(c("from_edge").alias("before"), c("via_v").alias("start_v"), c("to_edge").alias("after"))
    touch = both.where("start_v = entry").join(no, ["before", "start_v", "after"], "left_anti").select("before", "after", "most")
    ask = both.select("start_v", c("before").alias("after_edge"), c("after").alias("target"), "entry", "most")
    ways = ask.join(connectors(step, bans, ask), QUERY).where("dist <= most").select(c("after_edge").alias("before"), c("target").alias("after"), "most")
    return touch.union(ways).distinct()


def coverage(points: DataFrame, edges: DataFrame, bans: DataFrame, max_snap_m: float = float("inf")) -> Coverage:
    """The edges that traces (trace_id, pos, lon, lat) walked.

    edges: (edge_id, a, b, m, travel, line array<struct<lon, lat, ele>>), with access, claim and
    kind where they are known; bans: (from_edge, via_v, to_edge).  A segment whose middle is
    farther than max_snap_m from all edges is a gap `beyond-network`; two anchors that no legal
    way within their budgets joins are a gap `disconnected-network`, and the legs are those
    behind the last place where the walk had to start anew.  Traces of fewer than two points
    have no segments and no rows.  Null coordinates belong to no point."""
    seg = stored(trace_segments(points.where("trace_id is not null and lon is not null and lat is not null")), "segments")
    parts, mids = stored(edge_segments(edges), "edge_parts"), middles(seg)
    near = stored(spatial.nearest_edge_at_any_distance(mids, ["trace_id", "seg"], parts).select("trace_id", "seg", "edge_id", "distance_m"), "near")
    found = stored(anchors(seg, near, edges, max_snap_m), "anchors")
    if max_snap_m != float("inf"):
        found = without_shadows(found, mids, parts, max_snap_m)
    w = Window.partitionBy("trace_id").orderBy("n")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    walk = F.last(F.when(c("live"), F.struct(c("exit").alias("v"), c("edge_id").alias("edge"))), ignorenulls=True).over(before)
    lag = lambda k: F.lag(k).over(w).alias(f"was_{k}")
    rows = found.select("*", walk.alias("walk"), F.first("live").over(w).alias("starts"), (F.lag("n").over(w)).isNull().alias("is_first"), lag("edge_id"), lag("seg"), lag("budget_m"))
    no = bans.select(c("from_edge").alias("walk_edge"), c("via_v").alias("entry"), c("to_edge").alias("edge_id"), F.lit(True).alias("banned")).distinct()
    rows = rows.withColumn("walk_edge", c("walk.edge")).join(no, ["walk_edge", "entry", "edge_id"], "left")
    direct = F.coalesce(c("live") & (c("walk.v") == c("entry")) & c("banned").isNull(), F.lit(False))
    rows = stored(rows.withColumn("direct", direct), "walk")
    # access is a matter of constraints: matching asks for travel rules and bans only
    step = steps(directed(edges.withColumn("access", F.lit("open")).withColumn("road", F.lit(0.0))), bans)
    ask = rows.where("starts and not is_first and live and not direct").select("trace_id", "n", c("walk.v").alias("start_v"), c("walk_edge").alias("after_edge"), c("edge_id").alias("target"), "entry", c("budget_m").alias("most"))
    got = ask.join(connectors(step, bans, ask), QUERY).where("dist <= most").select("trace_id", "n", c("edges").alias("way"))
    rows = stored(rows.join(got, ["trace_id", "n"], "left").withColumn("restart", c("starts") & ~c("is_first") & c("live") & ~c("direct") & c("way").isNull()), "walk")

    apart = rows.where("starts and not is_first and not direct and way is null").select("trace_id", "was_seg", "seg", c("was_edge_id").alias("before"), c("edge_id").alias("after"), F.greatest("budget_m", "was_budget_m").alias("most"))
    apart = apart.join(_linked(apart.select("before", "after", "most"), edges, step, bans), ["before", "after", "most"], "left_anti").select("trace_id", F.least("was_seg", "seg").alias("first"), F.greatest("was_seg", "seg").alias("last"), "before", "after")
    never = rows.where("is_first and not live").select("trace_id", c("seg").alias("first"), c("seg").alias("last"), c("edge_id").alias("before"), c("edge_id").alias("after"))
    apart = stored(apart.unionByName(never), "apart")

    last = F.max(F.when(c("restart"), c("n"))).over(Window.partitionBy("trace_id"))
    on = rows.where("starts and live").withColumn("from_n", F.coalesce(last, F.lit(0))).where("n >= from_n")
    way = F.concat(F.when(c("n") > c("from_n"), F.coalesce("way", F.array().cast("array<bigint>"))).otherwise(F.array().cast("array<bigint>")), F.array(c("edge_id").cast("bigint")))
    legs = on.select("trace_id", "n", F.posexplode(way).alias("k", "edge_id")).select("trace_id", F.row_number().over(Window.partitionBy("trace_id").orderBy("n", "k")).alias("seq"), "edge_id")

    observed = seg.select("trace_id", "seg").join(near, ["trace_id", "seg"], "left")
    return Coverage(legs, gaps(observed, apart, max_snap_m), walks.snap_statistics(observed, max_snap_m, apart))


def gaps(observed: DataFrame, apart: DataFrame, max_snap_m: float) -> DataFrame:
    """Gaps of both kinds, those of one kind that touch or overlap made one: a beyond-network gap
    keeps its nearest edge if it is the same all along and the largest distance, a disconnected
    one its first and its last edge.  observed: (trace_id, seg, edge_id, distance_m)."""
    none = F.lit(None).cast("bigint")
    far = observed.where(F.coalesce(c("distance_m") > max_snap_m, F.lit(True)))
    far = far.select("trace_id", F.lit("beyond-network").alias("kind"), c("seg").alias("first"), c("seg").alias("last"), c("edge_id").cast("bigint").alias("near"), "distance_m", none.alias("before"), none.alias("after"))
    cut = apart.select("trace_id", F.lit("disconnected-network").alias("kind"), "first", "last", none.alias("near"), F.lit(None).cast("double").alias("distance_m"), c("before").cast("bigint").alias("before"), c("after").cast("bigint").alias("after"))
    w = Window.partitionBy("trace_id").orderBy("first", "last", "kind", "before", "after")
    rows = far.unionByName(cut).withColumn("run", F.sum(F.when(F.lag("kind").over(w) == c("kind"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("trace_id", "run").orderBy("first", "last", "before", "after")
    reach = F.max("last").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(c("first") <= reach + 1, 0).otherwise(1)).withColumn("part", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct("first", "last", "before", "after")
    whole = lambda k: F.when((F.count(k) == F.count("*")) & (F.min(k) == F.max(k)), F.min(k))
    merged = rows.groupBy("trace_id", "run", "part", "kind").agg(
        F.min("first").alias("first_segment"), F.max("last").alias("last_segment"), whole("near").alias("nearest_edge"), F.when(F.count("distance_m") == F.count("*"), F.max("distance_m")).alias("nearest_distance_m"), F.min_by("before", order).alias("before_edge"), F.max_by("after", order).alias("after_edge")
    )
    return merged.drop("run", "part")


def seeds(points: DataFrame, edges: DataFrame, bans: DataFrame, vertices: DataFrame, max_snap_m: float = float("inf")) -> tuple[DataFrame, Coverage]:
    """((trace_id, start_v, end_v, closed_loop, edges array, distance_m), coverage) of traces taken
    as routes: the matched edges, walked from the feasible end nearest to where the trace
    starts.  start_v and end_v are null where no end of the first edge lets all be walked."""
    found = coverage(points, edges, bans, max_snap_m)
    legs = stored(found.legs, "legs")
    found.legs = legs
    home = points.where("trace_id is not null and lon is not null and lat is not null").groupBy("trace_id").agg(F.min_by(F.struct("lon", "lat"), "pos").alias("p"))
    route = legs.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "edge_id"))), lambda x: x["edge_id"]).alias("edges"))
    route = stored(route.join(home, "trace_id").select(c("trace_id").alias("walk_id"), "edges", "p.lon", "p.lat"), "routes")
    starts = walks.line_starts(route, edges, bans, vertices)
    ends = walks.walked(route.join(starts, "walk_id").select("walk_id", "start_v", "edges"), edges, bans).select("walk_id", "end_v")
    length = legs.join(edges.select("edge_id", "m"), "edge_id").groupBy(c("trace_id").alias("walk_id")).agg(F.sum("m").alias("distance_m"))
    rows = route.join(starts, "walk_id", "left").join(ends, "walk_id", "left").join(length, "walk_id", "left")
    return rows.select(c("walk_id").alias("trace_id"), "start_v", "end_v", F.coalesce(c("start_v") == c("end_v"), F.lit(False)).alias("closed_loop"), "edges", "distance_m"), found
