"""Ways back: paths of least routing cost under a hard limit of metres, the k best of them, and
loops that are closed by them.

Two measures conflict here, cost (metres weighted by aversion to roads) and metres.  Each state
of each search keeps the labels of which no other is at least as good in both.  What is left to
the target, in cost and in metres, comes from searches on the reversed ways, done once for all
that share a target: it ends labels that cannot arrive.  All searches advance by one edge a
round, as joins; nothing is cut off by a count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geo
from cairn.functions.identity import splitmix64
from cairn.operators.graph import loops_once
from cairn.state import dropped, stored

c = F.col
#: Added to limits before they end a label, so that rounding doesn't: metres, and share of a cost.
SLACK = 1e-6


def _none() -> Column:
    return F.lit(None).cast("bigint")


def _empty() -> Column:
    return F.array().cast("array<bigint>")


def scoped(edges: DataFrame, allowed: DataFrame | None = None, forbidden: DataFrame | None = None) -> DataFrame:
    """The edges that a search may use: those in `allowed` (edge_id), if it is given, without
    those in `forbidden` (edge_id)."""
    out = edges if allowed is None else edges.join(allowed.select("edge_id"), "edge_id", "left_semi")
    return out if forbidden is None else out.join(forbidden.select("edge_id"), "edge_id", "left_anti")


def costs_to(step: DataFrame, targets: DataFrame, value: str = "cost") -> DataFrame:
    """(target, v, last, left): the least cost, or with value="m" the least metres, from each
    state of graph.steps() to each target (target), where there is a way.

    The search runs on the reversed ways from all states at the target."""
    ends = step.select(c("to_v").alias("v"), "last").union(step.select(c("from_v").alias("v"), c("last_in").alias("last"))).distinct()
    goals = targets.select("target").distinct()
    own = goals.select("target", c("target").alias("v"), _none().alias("last"))
    front = stored(goals.join(ends, c("target") == c("v")).select("target", "v", "last").union(own).distinct().withColumn("left", F.lit(0.0)), "reverse")
    written = [front]
    while True:
        go = front.join(step.withColumnRenamed("last", "arrived"), (c("v") == c("to_v")) & c("last").eqNullSafe(c("arrived")))
        new = go.select("target", c("from_v").alias("v"), c("last_in").alias("last"), (c("left") + c(value)).alias("left"))
        known = reduce(DataFrame.union, written)
        best = lambda k: F.min(F.when(c("new") == k, c("left")))
        both = new.withColumn("new", F.lit(True)).union(known.withColumn("new", F.lit(False))).groupBy("target", "v", "last").agg(best(True).alias("n"), best(False).alias("o"))
        front = stored(both.where("n is not null and (o is null or n < o)").select("target", "v", "last", c("n").alias("left")), "reverse")
        written.append(front)
        if front.isEmpty():
            break
    out = stored(reduce(DataFrame.union, written).groupBy("target", "v", "last").agg(F.min("left").alias("left")), "left")
    dropped(*written)
    return out


def return_paths(step: DataFrame, bans: DataFrame | None, asked: DataFrame, k: int = 1, retrace: bool = False) -> DataFrame:
    """(q, rank, cost, m, edges): for each search the k paths of least cost, ties by metres and
    edges, that use no edge twice and have at most most_m metres; k is the feature.

    asked: (q, start_v, was, target, most_m, barred array, banned array): a walk that arrived at
    start_v over the edge `was` (null: none) goes to the target, which it reaches once, at its
    end, without the barred edges and through none of the banned vertices.  With retrace (k = 1)
    it may use edges again, as a walk that turns round to get past a banned turn.  step: graph.steps(), with the same bans (from_edge,
    via_v, to_edge).

    With k = 1 the labels of a state that another is as good as in cost and metres end.  With
    more every label goes on that can still become one of the k best: the k-th best path found
    so far and what is left to the target decide, so all that are returned are exact."""
    begin = asked.select("q", "target", "most_m", F.coalesce("barred", _empty()).alias("barred"), F.coalesce("banned", _empty()).alias("banned"), c("start_v").alias("v"), "was")
    if bans is None:
        begin = begin.withColumn("last", _none())
    else:
        marks = bans.select(c("from_edge").alias("was"), c("via_v").alias("v"), c("from_edge").alias("last")).distinct()
        begin = begin.join(marks, ["was", "v"], "left")
    ends = stored(asked.select("target").distinct(), "targets")
    metres, costs = costs_to(step, ends, "m").withColumnRenamed("left", "left_m"), costs_to(step, ends, "cost").withColumnRenamed("left", "left_cost")
    to_go = stored(metres.join(costs, (metres["target"] == costs["target"]) & (metres["v"] == costs["v"]) & metres["last"].eqNullSafe(costs["last"])).select(metres["target"], metres["v"], metres["last"], "left_m", "left_cost"), "to_go")
    dropped(metres, costs)
    shape = ["q", "target", "most_m", "barred", "banned", "v", "last", "cost", "m", "edges"]
    front = stored(begin.select(*shape[:5], "v", "last", F.lit(0.0).alias("cost"), F.lit(0.0).alias("m"), (_empty() if retrace else F.when(c("was").isNotNull(), F.array("was")).otherwise(_empty())).alias("edges")), "labels")
    known, goals, written = [front.select("q", "v", "last", "cost", "m")], [], [front]
    while True:
        w = step.select("last_in", "from_v", "to_v", "edge_id", c("m").alias("way_m"), c("cost").alias("way_cost"), c("last").alias("next"))
        go = front.join(w, (c("v") == c("from_v")) & c("last").eqNullSafe(c("last_in")))
        # the edge of arrival stands first in edges, so that it is not walked back either
        go = go if retrace else go.where(~F.array_contains("edges", c("edge_id")))
        go = go.where(~F.array_contains("barred", c("edge_id")) & ((c("to_v") == c("target")) | ~F.array_contains("banned", c("to_v"))))
        go = go.select("q", "target", "most_m", "barred", "banned", c("to_v").alias("v"), c("next").alias("last"), (c("cost") + c("way_cost")).alias("cost"), (c("m") + c("way_m")).alias("m"), F.concat("edges", F.array("edge_id")).alias("edges"))
        left = to_go.select(c("target").alias("t_"), c("v").alias("v_"), c("last").alias("l_"), "left_m", "left_cost")
        go = go.join(left, (c("target") == c("t_")) & (c("v") == c("v_")) & c("last").eqNullSafe(c("l_"))).where(c("m") + c("left_m") <= c("most_m") + SLACK)
        if goals:
            best = reduce(DataFrame.union, goals)
            rank = F.row_number().over(Window.partitionBy("q").orderBy("cost"))
            bound = best.select("q", c("cost").alias("bound")).withColumnRenamed("q", "q_").withColumn("r_", F.row_number().over(Window.partitionBy("q_").orderBy("bound"))).where(c("r_") == k).select("q_", "bound")
            go = go.join(bound, c("q") == c("q_"), "left").where(c("bound").isNull() | (c("cost") + c("left_cost") <= c("bound") * (1 + SLACK)))
        go = stored(go.select(*shape), "labels")
        here = stored(go.where((c("v") == c("target")) & (c("m") <= c("most_m"))).select("q", "cost", "m", "edges"), "goals")
        goals.append(here)
        on = go.where(c("v") != c("target"))
        if k == 1:
            old = reduce(DataFrame.union, known).withColumn("edges", _empty()).withColumn("old", F.lit(True))
            order = Window.partitionBy("q", "v", "last").orderBy("cost", "m", c("old").isNull(), "edges").rowsBetween(Window.unboundedPreceding, -1)
            both = on.withColumn("old", F.lit(None).cast("boolean")).unionByName(old, allowMissingColumns=True).withColumn("least", F.min("m").over(order))
            on = both.where("old is null and (least is null or m < least)").select(*shape)
        front = stored(on, "labels")
        written += [go, front]
        if k == 1:
            known.append(front.select("q", "v", "last", "cost", "m"))
        if front.isEmpty():
            break
    came = asked.select("q", c("was").alias("was_"))
    rows = reduce(DataFrame.union, goals).join(came, "q")
    if not retrace:
        rows = rows.withColumn("edges", F.when(c("was_").isNotNull(), F.slice("edges", 2, F.size("edges"))).otherwise(c("edges")))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("cost", "m", "edges"))
    out = stored(rows.withColumn("rank", rank).where(c("rank") <= k).select("q", "rank", "cost", "m", "edges"), "paths")
    dropped(*written, *goals, to_go, ends)
    return out


def closed_loops(step: DataFrame, bans: DataFrame | None, starts: DataFrame, depth: int, k: int, least_m: float, most_m: float) -> DataFrame:
    """(start, edges, m): loops from each start (v): every way out of 1 to `depth` edges that
    uses no edge twice and can still return in time, closed by its k best ways back.  Each loop
    is listed once, whichever way round, with a length in bounds; the turn at the start is free.

    depth and k say how much is looked for: with a depth of a loop's edges less one every loop
    of that many edges is found."""
    back = stored(costs_to(step, starts.select(c("v").alias("target")), "m"), "home")
    w = step.select("last_in", "from_v", "to_v", "edge_id", c("m").alias("way_m"), c("last").alias("next"))
    path = starts.select(c("v").alias("start"), "v", _none().alias("last"), _empty().alias("edges"), F.lit(0.0).alias("m"))
    outs, loops = [], []
    for _ in range(depth):
        grown = path.join(w, (c("v") == c("from_v")) & c("last").eqNullSafe(c("last_in"))).where(~F.array_contains("edges", c("edge_id")))
        grown = grown.select("start", c("to_v").alias("v"), c("next").alias("last"), F.concat("edges", F.array("edge_id")).alias("edges"), (c("m") + c("way_m")).alias("m"))
        left = back.select(c("target").alias("start"), c("v").alias("v_"), c("last").alias("l_"), "left")
        grown = grown.join(left, "start").where((c("v") == c("v_")) & c("last").eqNullSafe(c("l_")) & (c("m") + c("left") <= most_m + SLACK)).select("start", "v", "last", "edges", "m")
        path = stored(grown, "out")
        outs.append(path)
        loops.append(path.where((c("v") == c("start")) & (F.size("edges") >= 2)).select("start", "edges", "m"))
        path = path.where(c("v") != c("start"))
    ways = stored(reduce(DataFrame.union, outs).where(c("v") != c("start")).select(F.xxhash64("start", "edges").alias("q"), "start", "v", "edges", "m"), "ways_out")
    ask = ways.select("q", c("v").alias("start_v"), F.element_at("edges", -1).alias("was"), c("start").alias("target"), (F.lit(float(most_m)) - c("m")).alias("most_m"), c("edges").alias("barred"), _empty().alias("banned"))
    got = return_paths(step, bans, ask, k).select("q", c("edges").alias("home"), c("m").alias("home_m"))
    loops.append(ways.join(got, "q").select("start", F.concat("edges", "home").alias("edges"), (c("m") + c("home_m")).alias("m")))
    out = stored(loops_once(reduce(DataFrame.union, loops).where(c("m").between(least_m, most_m)).groupBy("start", "edges").agg(F.min("m").alias("m"))), "loops")
    dropped(*outs, ways, back, got)
    return out


def support_designs(landmarks: DataFrame, known: DataFrame, vertices: DataFrame, least_m: float, keep: int, seed: int = 0) -> DataFrame:
    """(start, supports array, bound_m, pos): ordered supports to draw loops through: every
    landmark (source, v) alone, the 8 * keep pairs and the 16 * keep triples whose lower bound
    of metres (out, straight lines between, back) is nearest least_m; ties, to a micrometre, by
    a seeded hash.
    known: (source, v, dist).  Fewer pairs and triples are the feature: they are a portfolio."""
    at = landmarks.select("source", "v").distinct().join(known.select("source", "v", "dist"), ["source", "v"]).join(vertices.select("v", "lon", "lat"), "v")
    at = stored(at.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("v", "dist", "lon", "lat"))).alias("marks")), "marks")  # at most rings * sectors of them
    one = at.select("source", F.explode("marks").alias("x"))
    line = lambda x, y: geo.haversine(x["lon"], x["lat"], y["lon"], y["lat"])

    def ranked(rows: DataFrame, n: int, most: int | None = None) -> DataFrame:
        mixed = F.lit(seed).cast("bigint")
        for k in range(n):
            mixed = splitmix64(mixed.bitwiseXOR(F.get("supports", F.lit(k)).cast("bigint")))
        unsigned = F.struct((mixed < 0).alias("high"), mixed.alias("low"))  # the order of 64 bits without a sign
        rows = rows.select("source", "supports", "bound_m", F.struct(F.round(F.abs(c("bound_m") - least_m), 6).alias("off"), unsigned.alias("hash")).alias("order"))
        return rows if most is None else rows.withColumn("r_", F.row_number().over(Window.partitionBy("source").orderBy("order"))).where(c("r_") <= most).drop("r_")

    single = ranked(one.select("source", F.array("x.v").alias("supports"), (c("x.dist") * 2).alias("bound_m")), 1)
    two = one.join(at, "source").select("source", "x", F.explode("marks").alias("y")).where("x.v != y.v")
    pairs = ranked(two.select("source", F.array("x.v", "y.v").alias("supports"), (c("x.dist") + line(c("x"), c("y")) + c("y.dist")).alias("bound_m")), 2, 8 * keep)
    three = two.join(at, "source").select("source", "x", "y", F.explode("marks").alias("z")).where("z.v != x.v and z.v != y.v")
    triples = ranked(three.select("source", F.array("x.v", "y.v", "z.v").alias("supports"), (c("x.dist") + line(c("x"), c("y")) + line(c("y"), c("z")) + c("z.dist")).alias("bound_m")), 3, 16 * keep)
    rows = single.union(pairs).union(triples)
    return rows.select(c("source").alias("start"), "supports", "bound_m", F.row_number().over(Window.partitionBy("source").orderBy("order")).alias("pos"))


def loop_portfolio(step: DataFrame, bans: DataFrame | None, designs: DataFrame, least_m: float, most_m: float) -> DataFrame:
    """(start, pos, supports, edges, m): the loop through each design's supports, where there is
    one: leg by leg the least cost way that stays away from the vertices and edges of the
    legs before, within what is left of most_m.  All designs walk their legs together."""
    legs = F.concat("supports", F.array("start"))
    d = designs.select("start", "pos", "supports", legs.alias("stops"), c("start").alias("at"), _none().alias("was"), _empty().alias("edges"), F.array("start").alias("banned"), F.lit(0.0).alias("m"))
    state = stored(d, "designs")
    longest = state.agg(F.coalesce(F.max(F.size("stops")), F.lit(0))).first()[0]
    ends = stored(step.select("edge_id", "from_v", "to_v").distinct(), "ends")
    done = []
    for leg in range(1, longest + 1):
        state = stored(state.withColumn("q", F.xxhash64("at", "was", F.get("stops", F.lit(leg - 1)), "m", "edges", "banned")), "designs")
        ask = state.select("q", c("at").alias("start_v"), "was", F.get("stops", F.lit(leg - 1)).alias("target"), (F.lit(float(most_m)) - c("m")).alias("most_m"), c("edges").alias("barred"), "banned").dropDuplicates(["q"])
        got = return_paths(step, bans, ask, 1).select("q", c("edges").alias("leg"), c("m").alias("leg_m"))
        # the vertices inside each leg: the ends of all its edges but the last
        inner = got.join(ask.select("q", "start_v"), "q").select("q", "start_v", F.posexplode(F.slice("leg", 1, F.greatest(F.size("leg") - 1, F.lit(0)))).alias("k", "edge_id"))
        inner = inner.join(ends, "edge_id").groupBy("q").agg(F.collect_set("to_v").alias("xs"), F.collect_set("from_v").alias("ys"))
        target = F.get("stops", F.lit(leg - 1))
        rows = state.join(got, "q").join(inner, "q", "left")
        passed = F.array_except(F.array_union(F.array_union(F.coalesce("xs", _empty()), F.coalesce("ys", _empty())), F.array("at")), F.array(target))
        state = stored(
            rows.select("start", "pos", "supports", "stops", target.alias("at"), F.element_at("leg", -1).alias("was"), F.concat("edges", "leg").alias("edges"), F.array_union("banned", passed).alias("banned"), (c("m") + c("leg_m")).alias("m")),
            "designs",
        )
        done.append(state.where(F.size("stops") == leg))
        state = state.where(F.size("stops") > leg)
    rows = reduce(DataFrame.union, done)
    return rows.where(c("m").between(least_m, most_m)).select("start", "pos", "supports", "edges", "m")


def portfolio_routes(loops: DataFrame) -> DataFrame:
    """The distinct loops of loop_portfolio(): of those with the same edges the first design's."""
    key: Column = F.array_sort("edges")
    return loops.groupBy("start", key.alias("same")).agg(F.min_by(F.struct("pos", "supports", "edges", "m"), "pos").alias("p")).select("start", "p.*")
