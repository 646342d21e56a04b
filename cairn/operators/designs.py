"""Trail designs: support points that are bound to places inside edges, routed leg by leg over
parts of edges, and realized as walks.

A walk is a list of spans (edge_id, from_m, to_m), metres along the edge's line; a span that
goes down is walked backwards.  The legs of all designs are routed together: the first of
each, then the second, for a leg may depend on the edge by which the one before arrived.  In
each leg every way out of the place (to either end of its edge) and into the next is joined
by a search over whole edges, and the cheapest of all counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geo
from cairn.operators.graph import directed, steps
from cairn.operators.matching import edge_segments
from cairn.operators.returns import return_paths
from cairn.operators.spatial import nearest_edge_at_any_distance
from cairn.state import dropped, stored

c = F.col

#: A cut this near an edge's end is the end.
SLACK_M = 1e-6
#: Supports lie between these latitudes.
MOST_LAT = 85.0
SPAN = "struct<edge_id:bigint,from_m:double,to_m:double>"
SHAPES = ("open", "out-and-back", "loop")


def invalid_designs(designs: DataFrame) -> DataFrame:
    """(trail_id, rule): what is wrong with designs (trail_id, shape, slot, lon, lat): a shape
    that supports don't define, fewer than two of them, or one that is no place."""
    bad = c("lon").isNull() | c("lat").isNull() | F.isnan("lon") | F.isnan("lat") | ~c("lon").between(-180, 180) | ~c("lat").between(-MOST_LAT, MOST_LAT)
    rows = designs.groupBy("trail_id").agg(F.count("*").alias("n"), F.max(~F.coalesce(c("shape").isin(*SHAPES), F.lit(False))).alias("odd"), F.max(bad).alias("bad"))
    rule = lambda when, name: F.when(when, F.lit(name))
    found = F.array_compact(F.array(rule(c("odd"), "shape"), rule(c("n") < 2, "too few supports"), rule(c("bad"), "support")))
    return rows.select("trail_id", F.explode(found).alias("rule"))


def bound(designs: DataFrame, edges: DataFrame) -> DataFrame:
    """(trail_id, slot, shape, edge_id, distance_m, progress_m, length_m, a, b): the place on the
    nearest edge of each support.  edges: (edge_id, a, b, m, travel, line, ...)."""
    near = nearest_edge_at_any_distance(designs.select("trail_id", "slot", "lon", "lat"), ["trail_id", "slot"], edge_segments(edges)).select("trail_id", "slot", "edge_id")
    rows = designs.join(near, ["trail_id", "slot"]).join(edges.select("edge_id", "a", "b", "line", geo.length(c("line")).alias("length_m")), "edge_id")
    place = geo.line_projection(F.struct("lon", "lat"), c("line"))
    return rows.withColumn("place", place).select("trail_id", "slot", "shape", "edge_id", c("place.distance_m").alias("distance_m"), c("place.progress_m").alias("progress_m"), "length_m", "a", "b")


def _end(progress: Column, length: Column, a: Column, b: Column) -> Column:
    return F.when(progress <= SLACK_M, a).when(length - progress <= SLACK_M, b)


def _span(edge: Column, start: Column, end: Column) -> Column:
    return F.struct(edge.cast("bigint").alias("edge_id"), start.alias("from_m"), end.alias("to_m"))


def _ok(travel: Column, start: Column, end: Column) -> Column:
    return F.when(travel == "forward", end >= start).when(travel == "backward", end <= start).otherwise(True)


def _routed(legs: DataFrame, edges: DataFrame, step: DataFrame, bans: DataFrame) -> DataFrame:
    """(q, cost, spans): the cheapest way of each leg (q, place, goal, was, barred, banned) that has
    one.  place and goal are structs of bound()'s columns; edges: (edge_id, a, b, travel, cost,
    length_m); spans of barred edges are not taken."""
    info = edges.select("edge_id", "travel", "cost")
    rows = legs.join(info.select(c("edge_id").alias("e1"), c("travel").alias("t1"), c("cost").alias("c1")), c("place.edge_id") == c("e1"), "left").join(info.select(c("edge_id").alias("e2"), c("travel").alias("t2"), c("cost").alias("c2")), c("goal.edge_id") == c("e2"), "left")
    rows = stored(rows, "legs")
    part = lambda cost, x, y, n: cost * F.abs(y - x) / F.greatest(n, F.lit(2.220446049250313e-16))
    none = F.lit(None).cast("bigint")
    free = lambda e: ~F.array_contains("barred", e.cast("bigint"))
    at = _end(c("place.progress_m"), c("place.length_m"), c("place.a"), c("place.b"))

    # along one edge
    here = rows.where((c("e1") == c("e2")) & c("c1").isNotNull() & _ok(c("t1"), c("place.progress_m"), c("goal.progress_m")) & free(c("e1"))).withColumn("via_v", at)
    no = bans.select(c("from_edge").alias("was"), "via_v", c("to_edge").alias("e1"))
    here = here.join(no, ["was", "via_v", "e1"], "left_anti").select("q", part(c("c1"), c("place.progress_m"), c("goal.progress_m"), c("place.length_m")).alias("cost"), F.array(_span(c("e1"), c("place.progress_m"), c("goal.progress_m"))).alias("spans"))

    def exits(side: str, travel: str, cost: str, out: bool) -> Column:
        """The ways between a place and the ends of its edge: structs (v, cost, span)."""
        p, n = c(f"{side}.progress_m"), c(f"{side}.length_m")
        one = []
        for v, end in ((c(f"{side}.a"), F.lit(0.0)), (c(f"{side}.b"), n)):
            x, y = (p, end) if out else (end, p)
            one.append(F.when(_ok(c(travel), x, y) & free(c(f"{side}.edge_id")) & c(cost).isNotNull(), F.struct(v.cast("bigint").alias("v"), part(c(cost), x, y, n).alias("cost"), _span(c(f"{side}.edge_id"), x, y).alias("span"))))
        end = _end(p, n, c(f"{side}.a"), c(f"{side}.b"))
        alone = F.struct(end.cast("bigint").alias("v"), F.lit(0.0).alias("cost"), F.lit(None).cast(SPAN).alias("span"))
        return F.when(end.isNotNull(), F.array(alone)).otherwise(F.array_compact(F.array(*one)))

    both = rows.withColumn("d", F.explode(exits("place", "t1", "c1", True))).withColumn("r", F.explode(exits("goal", "t2", "c2", False)))
    both = stored(both.select("q", "d", "r", F.coalesce(c("d.span.edge_id"), c("was")).alias("was"), "barred", "banned"), "ways")
    pair = F.xxhash64("q", "d.v", "r.v", "was")
    ask = both.where("d.v != r.v").select(pair.alias("q"), c("d.v").alias("start_v"), "was", c("r.v").alias("target"), F.lit(1e12).alias("most_m"), "barred", "banned").dropDuplicates(["q"])
    ways = return_paths(step, bans, ask, 1, retrace=True).select(c("q").alias("pair"), c("cost").alias("way_cost"), "edges")
    joined = both.withColumn("pair", pair).join(ways, "pair", "left").where("d.v = r.v or edges is not null").withColumn("edges", F.coalesce("edges", F.array().cast("array<bigint>")))
    # the turn onto the goal's edge
    joined = joined.withColumn("by", F.when(F.size("edges") > 0, F.element_at("edges", -1)).otherwise(c("was"))).withColumn("onto", c("r.span.edge_id")).withColumn("via_v", c("r.v"))
    joined = joined.join(bans.select(c("from_edge").alias("by"), "via_v", c("to_edge").alias("onto")), ["by", "via_v", "onto"], "left_anti")
    # whole edges as spans: which way each was walked follows from the vertices
    walked = joined.select("q", "pair", c("d.v").alias("at"), F.posexplode("edges").alias("k", "edge_id")).distinct()
    walked = walked.join(edges.select("edge_id", "a", "b", "length_m"), "edge_id")
    w = F.array_sort(F.collect_list(F.struct("k", c("edge_id").cast("bigint").alias("edge_id"), c("a").cast("bigint").alias("a"), c("b").cast("bigint").alias("b"), "length_m")))
    walked = walked.groupBy("q", "pair", "at").agg(w.alias("w"))
    go = F.aggregate(
        "w",
        F.struct(c("at").alias("at"), F.array().cast(f"array<{SPAN}>").alias("s")),
        lambda x, e: F.struct(F.when(x["at"] == e["a"], e["b"]).otherwise(e["a"]).alias("at"), F.concat(x["s"], F.array(F.when(x["at"] == e["a"], _span(e["edge_id"], F.lit(0.0), e["length_m"])).otherwise(_span(e["edge_id"], e["length_m"], F.lit(0.0))))).alias("s")),
    )
    middle = walked.select(c("q").alias("q_"), c("pair").alias("pair_"), c("at").alias("at_"), go["s"].alias("middle"))
    joined = joined.join(middle, (c("q") == c("q_")) & (c("pair") == c("pair_")) & (c("d.v") == c("at_")), "left").select("q", "d", "r", "way_cost", "middle")
    spans = F.array_compact(F.concat(F.array(c("d.span")), F.coalesce("middle", F.array().cast(f"array<{SPAN}>")), F.array(c("r.span"))))
    found = joined.select("q", (c("d.cost") + c("r.cost") + F.coalesce("way_cost", F.lit(0.0))).alias("cost"), spans.alias("spans"))
    best = here.union(found).groupBy("q").agg(F.min(F.struct("cost", "spans")).alias("p"))
    out = stored(best.select("q", "p.cost", "p.spans"), "routed")
    dropped(rows, both, ways)
    return out


def routed(designs: DataFrame, edges: DataFrame, bans: DataFrame, max_snap_m: float, aversion: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(walks, bindings, failures) of designs (trail_id, shape, slot from 0, lon, lat).

    walks (trail_id, shape, spans, leg_ends): the spans of each design that can be realized and
    after how many of them each leg ends; bindings: bound(); failures (trail_id, rule, slot): an
    invalid design, a support farther than max_snap_m from the network, or the leg from a slot
    that no legal way joins.  A loop closes without the edges and vertices it has walked, or if
    it can't, by the cheapest way; an out-and-back returns as it came."""
    wrong = stored(invalid_designs(designs), "invalid")
    cost = F.when(~F.coalesce(c("access").isin("closed", "private"), F.lit(False)), c("m") * (1 + aversion * F.coalesce("road", F.lit(0.0))))
    info = stored(edges.select("edge_id", "a", "b", F.coalesce("travel", F.lit("both")).alias("travel"), cost.alias("cost"), geo.length(c("line")).alias("length_m")), "edges")
    step = steps(directed(edges, aversion), bans)
    places = stored(bound(designs.join(wrong, "trail_id", "left_anti"), edges), "bound")
    far = places.where(~(c("distance_m") <= max_snap_m))
    failed = [wrong.select("trail_id", "rule", F.lit(None).cast("int").alias("slot")), far.groupBy("trail_id").agg(F.lit("off the network").alias("rule"), F.min("slot").cast("int").alias("slot"))]
    place = F.struct("edge_id", "distance_m", "progress_m", "length_m", "a", "b")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("slot", place.alias("p")))), lambda x: x["p"])
    state = places.join(far.select("trail_id").distinct(), "trail_id", "left_anti").groupBy("trail_id", "shape").agg(lists.alias("places"))
    none, empty = F.lit(None).cast("bigint"), F.array().cast("array<bigint>")
    state = stored(state.withColumns({"spans": F.array().cast(f"array<{SPAN}>"), "leg_ends": F.array().cast("array<int>"), "was": none, "q": F.monotonically_increasing_id()}), "designs")
    longest = state.agg(F.coalesce(F.max(F.size("places")), F.lit(0))).first()[0]
    done = state.limit(0)

    def walked(rows: DataFrame, goal: Column, frm: int, barred: Column, banned: Column) -> tuple[DataFrame, DataFrame]:
        ask = rows.select("q", F.get("places", F.lit(frm)).alias("place") if frm >= 0 else F.element_at("places", -1).alias("place"), goal.alias("goal"), "was", barred.alias("barred"), banned.alias("banned"))
        got = _routed(ask, info, step, bans)
        on = rows.join(got.select("q", c("spans").alias("leg")), "q")
        return on, rows.join(got.select("q"), "q", "left_anti")

    def extended(rows: DataFrame) -> DataFrame:
        spans = F.concat("spans", "leg")
        return rows.withColumn("was", F.coalesce(F.try_element_at(F.transform("leg", lambda s: s["edge_id"]), F.lit(-1)), c("was"))).withColumn("spans", spans).withColumn("leg_ends", F.concat("leg_ends", F.array(F.size("spans")))).drop("leg")

    for k in range(longest - 1):
        now = state.where(F.size("places") > k + 1)
        ended = state.where(F.size("places") <= k + 1)
        on, lost = walked(now, F.get("places", F.lit(k + 1)), k, empty, empty)
        failed.append(lost.select("trail_id", F.lit("no way").alias("rule"), F.lit(k).alias("slot")))
        state = stored(extended(on).unionByName(ended), "designs")
    loops, rest = state.where("shape = 'loop'"), state.where("shape != 'loop'")
    if not loops.isEmpty():
        over = F.array_distinct(F.transform("spans", lambda s: s["edge_id"]))
        ends = loops.select("q", F.explode("spans").alias("s")).join(info.select(c("edge_id").alias("e"), "a", "b", "length_m"), c("s.edge_id") == c("e"))
        ends = ends.select("q", F.explode(F.array_compact(F.array(_end(c("s.from_m"), c("length_m"), c("a"), c("b")), _end(c("s.to_m"), c("length_m"), c("a"), c("b"))))).alias("v")).groupBy("q").agg(F.collect_set(c("v").cast("bigint")).alias("passed"))
        loops = stored(loops.join(ends, "q", "left").withColumn("passed", F.coalesce("passed", empty)), "loops")
        home = F.get("places", F.lit(0))
        simple, rough = walked(loops, home, -1, over, c("passed"))
        simple = stored(simple, "closed")
        again, lost = walked(rough, home, -1, empty, empty)
        failed.append(lost.select("trail_id", F.lit("no way").alias("rule"), (F.size("places") - 1).alias("slot")))
        # the closing leg has no support at its end
        closed = simple.unionByName(again).withColumn("spans", F.concat("spans", "leg")).drop("leg", "passed")
        rest = rest.unionByName(closed)
    back = F.transform(F.reverse("spans"), lambda s: _span(s["edge_id"], s["to_m"], s["from_m"]))
    done = rest.withColumn("spans", F.when(c("shape") == "out-and-back", F.concat("spans", back)).otherwise(c("spans")))
    walks = stored(done.select("trail_id", "shape", "spans", "leg_ends"), "walks")
    failures = failed[0]
    for f in failed[1:]:
        failures = failures.union(f)
    return walks, places, stored(failures, "failures")


def pieces(walks: DataFrame, bindings: DataFrame, edges: DataFrame) -> DataFrame:
    """(trail_id, seq, edge_id, low_m, high_m, ahead, from_v, to_v, m, line): the walks cut at all
    places that they bind or touch, in order.  A vertex is an edge's end (as text) or a place
    inside one (edge@metres).  m follows the line; line runs as it is walked."""
    lines = edges.select("edge_id", "a", "b", "line", geo.length(c("line")).alias("length_m"))
    spans = stored(walks.select("trail_id", F.posexplode("spans").alias("k", "s")).select("trail_id", "k", "s.*"), "spans")
    marks = spans.select("trail_id", "edge_id", F.explode(F.array("from_m", "to_m")).alias("m")).union(bindings.join(walks.select("trail_id"), "trail_id", "left_semi").select("trail_id", c("edge_id").cast("bigint"), "progress_m"))
    marks = marks.join(lines.select("edge_id", "length_m"), "edge_id")
    ends = marks.select("trail_id", "edge_id", F.explode(F.array(F.lit(0.0), c("length_m"))).alias("m"))
    every = F.array_sort(F.collect_set("m"))
    cuts = marks.select("trail_id", "edge_id", "m").union(ends).groupBy("trail_id", "edge_id").agg(every.alias("cuts"))
    # marks as near as the slack are one, the first of them
    one = F.aggregate("cuts", F.array().cast("array<double>"), lambda s, m: F.when((F.size(s) > 0) & (m - F.element_at(F.concat(F.array(F.lit(-1.0)), s), -1) <= SLACK_M), s).otherwise(F.concat(s, F.array(m))))
    cuts = cuts.withColumn("cuts", one)
    rows = spans.join(cuts, ["trail_id", "edge_id"]).join(lines, "edge_id")
    low, high = F.least("from_m", "to_m"), F.greatest("from_m", "to_m")
    inner = F.filter("cuts", lambda m: (m >= low - SLACK_M) & (m <= high + SLACK_M))
    parts = F.zip_with(F.slice(inner, F.lit(1), F.greatest(F.size(inner) - 1, F.lit(0))), F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 1, F.lit(0))), lambda x, y: F.struct(x.alias("low_m"), y.alias("high_m")))
    ahead = c("to_m") >= c("from_m")
    rows = rows.withColumn("ahead", ahead).select("trail_id", "k", "edge_id", "a", "b", "line", "length_m", "ahead", F.posexplode(F.when(ahead, parts).otherwise(F.reverse(parts))).alias("j", "p"))
    vertex = lambda m: F.coalesce(_end(m, c("length_m"), c("a"), c("b")).cast("string"), F.format_string("%d@%.6f", c("edge_id").cast("bigint"), m))
    lo, hi = vertex(c("p.low_m")), vertex(c("p.high_m"))
    cut = geo.line_slice(c("line"), c("p.low_m"), c("p.high_m"))
    seq = F.row_number().over(Window.partitionBy("trail_id").orderBy("k", "j"))
    return rows.select("trail_id", seq.alias("seq"), "edge_id", c("p.low_m").alias("low_m"), c("p.high_m").alias("high_m"), "ahead", F.when(c("ahead"), lo).otherwise(hi).alias("from_v"), F.when(c("ahead"), hi).otherwise(lo).alias("to_v"), (c("p.high_m") - c("p.low_m")).alias("m"), F.when(c("ahead"), cut).otherwise(F.reverse(cut)).alias("line"))


def realized(walked: DataFrame, walks: DataFrame) -> DataFrame:
    """(trail_id, shape, found, fulfilled, distance_m, n_pieces, start_v, end_v): what pieces() are as
    routes, and whether that is what was designed: a loop has to close, the others must have
    their shape."""
    piece = F.struct("edge_id", "low_m", "high_m")
    rows = walked.groupBy("trail_id").agg(F.sum("m").alias("distance_m"), F.count("*").alias("n_pieces"), F.countDistinct(piece).alias("different"), F.min_by("from_v", "seq").alias("start_v"), F.max_by("to_v", "seq").alias("end_v"))
    visits = walked.groupBy("trail_id", "to_v").count().groupBy("trail_id").agg((F.max("count") > 1).alias("again"))
    shape = F.when(c("start_v") != c("end_v"), "open").when(c("n_pieces") > c("different"), "out-and-back").when(c("again"), "figure-eight").otherwise("loop")
    rows = walks.select("trail_id", "shape").join(rows.join(visits, "trail_id").withColumn("found", shape), "trail_id")
    good = F.when(c("shape") == "loop", c("start_v") == c("end_v")).otherwise(c("found") == c("shape"))
    return rows.select("trail_id", "shape", "found", good.alias("fulfilled"), "distance_m", "n_pieces", "start_v", "end_v")


def insertion_slot(asked: DataFrame, walks: DataFrame, edges: DataFrame) -> DataFrame:
    """(trail_id, ask_id, slot, distance_m): between which supports of a realized design a new one
    (trail_id, ask_id, lon, lat) goes: behind those whose leg ends before the nearest span.  The
    way back of an out-and-back doesn't count."""
    out = F.when(c("shape") == "out-and-back", F.slice("spans", F.lit(1), (F.size("spans") / 2).cast("int"))).otherwise(c("spans"))
    rows = walks.select("trail_id", "leg_ends", F.posexplode(out).alias("k", "s")).join(edges.select("edge_id", "line"), c("s.edge_id") == c("edge_id"))
    part = geo.line_slice(c("line"), F.least("s.from_m", "s.to_m"), F.greatest("s.from_m", "s.to_m"))
    near = asked.join(rows.select("trail_id", "leg_ends", "k", part.alias("part")), "trail_id").withColumn("distance_m", geo.line_projection(F.struct("lon", "lat"), c("part"))["distance_m"])
    best = near.groupBy("trail_id", "ask_id").agg(F.min(F.struct("distance_m", "k", "leg_ends")).alias("p"))
    slot = F.size(F.filter("p.leg_ends", lambda e: e <= c("p.k"))) + 1
    return best.select("trail_id", "ask_id", slot.alias("slot"), c("p.distance_m").alias("distance_m"))


def inferred(legs: DataFrame, shapes: DataFrame, edges: DataFrame, bans: DataFrame, vertices: DataFrame, aversion: float = 0.0) -> DataFrame:
    """(route_id, shape, slot, lon, lat): supports that make routes (legs route_id, seq, edge_id,
    from_v, to_v, without gaps) again.  A stretch that is the cheapest way between its ends
    needs its start alone; else its halves are tried, all stretches of all routes at once, and
    a single edge that isn't the cheapest way gets a support in its middle.  shapes: (route_id,
    shape); out-and-backs that don't return as they came, and figure eights, are left out."""
    w = Window.partitionBy("route_id").orderBy("seq")
    rows = legs.select("route_id", (F.row_number().over(w) - 1).alias("i"), c("edge_id").cast("bigint").alias("edge_id"), "from_v", "to_v")
    lists = F.array_sort(F.collect_list(F.struct("i", "edge_id", "from_v", "to_v")))
    routes = stored(rows.groupBy("route_id").agg(lists.alias("l")).join(shapes, "route_id").where(c("shape").isin(*SHAPES)), "routes")
    n, half = F.size("l"), F.floor(F.size("l") / 2).cast("int")
    ids = F.transform("l", lambda x: x["edge_id"])
    mirrored = (n % 2 == 0) & (F.slice(ids, F.lit(1), half) == F.reverse(F.slice(ids, half + 1, half)))
    closed = F.get("l", F.lit(0))["from_v"] == F.element_at("l", -1)["to_v"]
    good = routes.where(((c("shape") == "out-and-back") & mirrored) | ((c("shape") == "loop") & closed & (n >= 2)) | ((c("shape") == "open") & (n >= 1)))
    first = F.when(c("shape") == "loop", F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), n.alias("hi")))).when(c("shape") == "open", F.array(F.struct(F.lit(0).alias("lo"), n.alias("hi")))).otherwise(F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi"))))
    arcs = stored(good.select("route_id", F.explode(first).alias("x")).select("route_id", "x.*"), "arcs")
    step = steps(directed(edges, aversion), bans)
    found = []
    while not arcs.isEmpty():
        full = arcs.join(routes, "route_id").select("route_id", "lo", "hi", F.transform(F.slice("l", c("lo") + 1, c("hi") - c("lo")), lambda x: x["edge_id"]).alias("own"), F.get("l", c("lo"))["from_v"].alias("start_v"), F.get("l", c("hi") - 1)["to_v"].alias("target"), F.get("l", c("lo") - 1)["edge_id"].alias("was"))
        full = stored(full.withColumn("q", F.xxhash64("route_id", "lo", "hi")), "arcs")
        empty = F.array().cast("array<bigint>")
        got = return_paths(step, bans, full.select("q", "start_v", "was", "target", F.lit(1e12).alias("most_m"), empty.alias("barred"), empty.alias("banned")), 1, retrace=True)
        rows = stored(full.join(got.select("q", "edges"), "q", "left").withColumn("same", F.coalesce((c("edges") == c("own")) & (c("start_v") != c("target")), F.lit(False))), "arcs")
        found.append(rows.where("same or hi - lo <= 1").select("route_id", "lo", "start_v", F.when(~c("same"), F.element_at("own", 1)).alias("edge_id")))
        mid = (c("lo") + F.floor((c("hi") - c("lo")) / 2)).cast("int")
        arcs = stored(rows.where("not same and hi - lo > 1").select("route_id", F.explode(F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), "hi"))).alias("x")).select("route_id", "x.*"), "arcs")
    if not found:
        return shapes.limit(0).select("route_id", "shape", F.lit(0).alias("slot"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    rows = found[0]
    for f in found[1:]:
        rows = rows.union(f)
    at = vertices.select("v", "lon", "lat")
    middle = edges.select("edge_id", geo.line_at(c("line"), geo.length(c("line")) * 0.5).alias("mid"))
    starts = rows.join(at, c("start_v") == c("v")).select("route_id", "lo", F.lit(0).alias("k"), "lon", "lat")
    inner = rows.where("edge_id is not null").join(middle, "edge_id").select("route_id", "lo", F.lit(1).alias("k"), c("mid.lon").alias("lon"), c("mid.lat").alias("lat"))
    last = good.where("shape != 'loop'").select("route_id", n.alias("lo"), F.lit(2).alias("k"), F.get("l", F.when(c("shape") == "open", n).otherwise(half) - 1)["to_v"].alias("v")).join(at, "v").select("route_id", "lo", "k", "lon", "lat")
    every = starts.union(inner).union(last)
    slot = F.row_number().over(Window.partitionBy("route_id").orderBy("lo", "k")) - 1
    return every.join(shapes, "route_id").select("route_id", "shape", slot.alias("slot"), "lon", "lat")
