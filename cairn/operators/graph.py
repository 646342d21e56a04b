"""The walkable graph: edges (edge_id, a, b, m, road, access, travel), vertices by id.

Searches are loops of joins.  Each round's state is written to the shared folder; a round
moves the frontier only, and a search ends when nothing improves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.geo import bearing_sector
from cairn.state import stored


def directed(edges: DataFrame, aversion: float = 0.0) -> DataFrame:
    """(edge_id, from_v, to_v, m, cost): both ways of each edge that its travel rule lets
    depart.  Closed and private edges have no way; cost is metres * (1 + aversion * road)."""
    legal = edges.where(~F.coalesce(F.col("access").isin("closed", "private"), F.lit(False)))
    cost = (F.col("m") * (1 + aversion * F.coalesce("road", F.lit(0.0)))).alias("cost")
    ways = F.explode(F.array(F.struct(F.col("a").alias("from_v"), F.col("b").alias("to_v"), F.lit("backward").alias("no")), F.struct(F.col("b").alias("from_v"), F.col("a").alias("to_v"), F.lit("forward").alias("no"))))
    return legal.select("edge_id", "m", cost, F.coalesce("travel", F.lit("both")).alias("travel"), ways.alias("w")).where(F.col("travel") != F.col("w.no")).select("edge_id", "w.from_v", "w.to_v", "m", "cost")


def turns(ways: DataFrame) -> DataFrame:
    """(from_edge, via_v, to_edge): pairs of different ways that can follow each other."""
    a = ways.select(F.col("edge_id").alias("from_edge"), F.col("to_v").alias("via_v"))
    b = ways.select(F.col("from_v").alias("via_v"), F.col("edge_id").alias("to_edge"))
    return a.join(b, "via_v").where("from_edge != to_edge").select("from_edge", "via_v", "to_edge")


def resolved_bans(restrictions: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(from_edge, via_v, to_edge): the turns that restrictions (rule, from_way, via_node, to_way)
    ban.  edges: (edge_id, way, a, b, travel), a way may have several; vertices: (v, node).

    Edges of the first way that arrive at the node may not go on: under `no` over the edges of
    the second way that depart from it, under `only` over all edges there but these."""
    c = F.col
    travel = F.coalesce("travel", F.lit("both"))
    ends = edges.select("edge_id", "way", F.explode(F.array(F.struct(c("a").alias("v"), (travel != "forward").alias("into"), (travel != "backward").alias("out")), F.struct(c("b").alias("v"), (travel != "backward").alias("into"), (travel != "forward").alias("out")))).alias("e")).select("edge_id", "way", "e.*")
    at = restrictions.join(vertices.select(c("node").alias("via_node"), c("v").alias("via_v")), "via_node").select("rule", "from_way", "via_v", "to_way").distinct()
    into = ends.where("into").select(c("edge_id").alias("from_edge"), c("way").alias("from_way"), c("v").alias("via_v"))
    out = ends.where("out").select(c("edge_id").alias("to_edge"), c("way").alias("to_way"), c("v").alias("via_v")).distinct()
    arrived = at.join(into, ["from_way", "via_v"])
    # a restriction counts only where both of its ways are in the graph
    arrived = arrived.join(edges.select(c("way").alias("to_way")).distinct(), "to_way", "left_semi")
    no = arrived.where("rule = 'no'").join(out, ["to_way", "via_v"]).select("from_edge", "via_v", "to_edge")
    every = ends.select(c("edge_id").alias("to_edge"), c("v").alias("via_v")).distinct()
    only = arrived.where("rule = 'only'").select("from_edge", "via_v", "to_way").join(every, "via_v").join(out, ["to_edge", "to_way", "via_v"], "left_anti").select("from_edge", "via_v", "to_edge")
    return no.union(only).distinct()


def legal_legs(legs: DataFrame, bans: DataFrame) -> DataFrame:
    """Legs (route_id, seq, edge_id, from_v) whose turn onto their edge is not banned."""
    w = Window.partitionBy("route_id").orderBy("seq")
    rows = legs.withColumn("from_edge", F.lag("edge_id").over(w))
    banned = bans.select("from_edge", F.col("via_v").alias("from_v"), F.col("to_edge").alias("edge_id"))
    return rows.join(banned, ["from_edge", "from_v", "edge_id"], "left_anti").drop("from_edge")


STATE = ["source", "v", "last"]


def steps(ways: DataFrame, bans: DataFrame | None = None) -> DataFrame:
    """(last_in, from_v, to_v, edge_id, m, cost, last): the ways that a search may take from
    a state, written once for all its rounds.

    A state is a vertex and, only where a ban (from_edge, via_v, to_edge) asks for it, the
    edge by which it was reached: all other arrivals at a vertex go on alike, so that bans
    add as many states as they name and no more.  Going back over an edge is a turn like
    any other."""
    w = ways.select("from_v", "to_v", F.col("edge_id").cast("bigint").alias("edge_id"), "m", "cost")
    none = F.lit(None).cast("bigint")
    if bans is None:
        return stored(w.select(none.alias("last_in"), "*", none.alias("last")), "steps")
    bans = bans.select(*[F.col(c).cast("bigint").alias(c) for c in ("from_edge", "via_v", "to_edge")]).distinct()
    marks = bans.select(F.col("from_edge").alias("edge_id"), F.col("via_v").alias("to_v"), F.col("from_edge").alias("last")).distinct()
    w = stored(w.join(marks, ["edge_id", "to_v"], "left").select("from_v", "to_v", "edge_id", "m", "cost", "last"), "ways")
    after = marks.select(F.col("last").alias("last_in"), F.col("to_v").alias("from_v")).join(w, "from_v")
    no = bans.select(F.col("from_edge").alias("last_in"), F.col("via_v").alias("from_v"), F.col("to_edge").alias("edge_id"))
    legal = after.join(no, ["last_in", "from_v", "edge_id"], "left_anti").select("last_in", *w.columns)
    return stored(w.select(none.alias("last_in"), "*").unionByName(legal), "steps")


def reached(step: DataFrame, sources: DataFrame, most: float | None = None) -> DataFrame:
    """(source, v, last, dist, hops, via, before): the least cost from each source (source, v)
    to each state, at most `most`; of equal costs the fewest hops, then the smallest edge.
    via is the last edge, before the `last` of the state that it leaves.

    Bellman-Ford by frontier: a round joins the states that improved with the ways that
    leave them, and writes only what is better than all that is known."""
    best = lambda new: F.min(F.when(F.col("new") == new, F.struct("dist", "hops", "via", "before")))
    none = F.lit(None).cast("bigint")
    front = stored(sources.select("source", "v", none.alias("last"), F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), none.alias("via"), none.alias("before")).distinct(), "front")
    written = [front]
    while True:
        go = front.withColumnRenamed("last", "was").join(step, (F.col("v") == F.col("from_v")) & F.col("was").eqNullSafe(F.col("last_in")))
        go = go.select("source", F.col("to_v").alias("v"), "last", (F.col("dist") + F.col("cost")).alias("dist"), (F.col("hops") + 1).alias("hops"), F.col("edge_id").alias("via"), F.col("was").alias("before"))
        go = go if most is None else go.where(F.col("dist") <= most)
        known = reduce(DataFrame.union, written)
        both = go.withColumn("new", F.lit(True)).union(known.withColumn("new", F.lit(False))).groupBy(*STATE).agg(best(True).alias("n"), best(False).alias("o"))
        better = both.where("n is not null and (o is null or n.dist < o.dist or (n.dist = o.dist and n.hops < o.hops))")
        front = stored(better.select(*STATE, "n.*"), "front")
        if front.isEmpty():
            break
        written.append(front)
        if len(written) > 16:
            written = [stored(_least(written), "known")]
    return stored(_least(written), "known")


def _least(tables: list[DataFrame]) -> DataFrame:
    every = reduce(DataFrame.union, tables)
    return every.groupBy(*STATE).agg(F.min(F.struct("dist", "hops", "via", "before")).alias("p")).select(*STATE, "p.*")


def distances(ways: DataFrame, sources: DataFrame, most: float | None = None, bans: DataFrame | None = None) -> DataFrame:
    """(source, v, dist, hops): of reached() the best of each vertex's states."""
    known = reached(steps(ways, bans), sources, most)
    return known.groupBy("source", "v").agg(F.min(F.struct("dist", "hops")).alias("p")).select("source", "v", "p.*")


def paths(known: DataFrame, step: DataFrame, ends: DataFrame) -> DataFrame:
    """(source, end, dist, edges array): the ways of reached() from each source to each end
    (source, end) that it reaches, walked back by all at once, an edge a round."""
    e = ends.select("source", F.col("end").alias("v")).distinct().join(known, ["source", "v"])
    first = e.groupBy("source", "v").agg(F.min(F.struct("dist", "hops", "via", "before", "last")).alias("p"))
    at = stored(first.select("source", F.col("v").alias("end"), "v", "p.last", "p.dist", F.array().cast("array<bigint>").alias("edges")), "walk")
    back = stored(step.select(F.col("edge_id").alias("via"), F.col("to_v").alias("v"), F.col("from_v").alias("prev")).distinct(), "back")
    out = None
    while True:
        here = at.withColumnRenamed("last", "now").join(known.select(F.col("source").alias("s"), F.col("v").alias("kv"), "last", "via", "before"), (F.col("source") == F.col("s")) & (F.col("v") == F.col("kv")) & F.col("now").eqNullSafe(F.col("last")))
        here = stored(here.select("source", "end", "v", "via", "before", "dist", "edges"), "walk")
        done = here.where("via is null").select("source", "end", "dist", "edges")
        out = done if out is None else out.union(done)
        left = here.where("via is not null")
        if left.isEmpty():
            return out
        at = left.join(back, ["via", "v"]).select("source", "end", F.col("prev").alias("v"), F.col("before").alias("last"), "dist", F.concat(F.array("via"), "edges").alias("edges"))


def out_and_back(known: DataFrame, least_m: float, most_m: float) -> DataFrame:
    """(source, v, there_and_back): turning points whose way there and back fits."""
    twice = (2 * F.col("dist")).alias("there_and_back")
    return known.where("hops > 0").select("source", "v", twice).where(F.col("there_and_back").between(least_m, most_m))


def loops(ways: DataFrame, starts: DataFrame, most_edges: int, least_m: float, most_m: float, bans: DataFrame | None = None) -> DataFrame:
    """(start, edges array, m): simple loops from each start v with 3 to most_edges edges and
    a length in bounds, each once: in the direction whose first edge is smaller than its
    last, or in the other one where only that is legal.  No loop takes a banned turn (from_edge, via_v, to_edge) on its way; the turn at the start
    is free.

    Breadth first: paths that are too long, or that meet themselves, end.  All are kept."""
    none = F.lit(None).cast("bigint")
    path = starts.select(F.col("v").alias("start"), F.col("v").alias("at"), none.alias("was"), F.array(F.col("v")).alias("seen"), F.array().cast("array<bigint>").alias("edges"), F.lit(0.0).alias("so_far"))
    w, out = steps(ways, bans), None
    for n in range(1, most_edges + 1):
        grown = path.join(w, (F.col("at") == F.col("from_v")) & F.col("was").eqNullSafe(F.col("last_in"))).withColumn("m", F.col("so_far") + F.col("m")).where(F.col("m") <= most_m)
        grown = grown.select("start", "to_v", "last", "seen", F.concat("edges", F.array("edge_id")).alias("edges"), "m")
        if n >= 3:
            closed = grown.where((F.col("to_v") == F.col("start")) & (F.col("m") >= least_m)).select("start", "edges", "m")
            out = closed if out is None else out.union(closed)
        if n < most_edges:
            on = grown.where(~F.array_contains("seen", F.col("to_v")))
            path = stored(on.select("start", F.col("to_v").alias("at"), F.col("last").alias("was"), F.concat("seen", F.array("to_v")).alias("seen"), "edges", F.col("m").alias("so_far")), "paths")
    return loops_once(out)


def loops_once(loops: DataFrame) -> DataFrame:
    """Loops (start, edges, m) listed once, whichever way round: in the direction whose first
    edge is smaller than its last, or in the other one where only that is there."""
    turn = F.struct((F.get("edges", F.lit(0)) > F.element_at("edges", -1)).alias("other"), "edges", "m")
    one = loops.groupBy("start", F.least(F.col("edges"), F.reverse("edges")).alias("both")).agg(F.min(turn).alias("p"))
    return one.select("start", "p.edges", "p.m")


def landmarks(known: DataFrame, vertices: DataFrame, most_m: float, rings: int = 12, sectors: int = 16) -> DataFrame:
    """(source, ring, sector, v): for each ring of distance and sector of bearing around a
    source the reached vertex whose distance is nearest the ring's, ties by v."""
    ceiling = most_m * 0.5
    floor = ceiling / 16.0
    at = vertices.select(F.col("v"), F.col("lon"), F.col("lat"))
    home = vertices.select(F.col("v").alias("source"), F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    rows = known.where("v != source").join(at, "v").join(home, "source").withColumn("sector", bearing_sector(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat"), sectors))
    rows = rows.withColumn("ring", F.explode(F.sequence(F.lit(0), F.lit(rings - 1))))
    target = floor + (ceiling - floor) * (F.col("ring") + 0.5) / rings
    return rows.groupBy("source", "ring", "sector").agg(F.min(F.struct(F.abs(F.col("dist") - target).alias("off"), F.col("v"))).alias("p")).select("source", "ring", "sector", "p.v")


def chains(edges: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(edge_id, chain): maximal runs of edges through vertices of degree two (those in
    `kept` (v) always end a run); chain is the run's smallest edge id.

    Edges that share such a vertex are linked; labels halve the way to the smallest each
    round (pointer jumping), so rounds grow with the logarithm of the longest run."""
    ends = edges.select("edge_id", F.explode(F.array("a", "b")).alias("v"))
    passing = ends.groupBy("v").agg(F.count("*").alias("n"), F.min("edge_id").alias("x"), F.max("edge_id").alias("y")).where("n = 2 and x != y")
    if kept is not None:
        passing = passing.join(kept, "v", "left_anti")
    links = stored(passing.select("x", "y").union(passing.select(F.col("y"), F.col("x"))), "links")
    label = stored(edges.select("edge_id", F.col("edge_id").alias("chain")), "labels")
    while True:
        near = links.join(label, F.col("y") == F.col("edge_id")).groupBy("x").agg(F.min("chain").alias("near"))
        low = label.join(near, F.col("edge_id") == F.col("x"), "left").select("edge_id", F.least("chain", F.coalesce("near", "chain")).alias("chain"), F.col("chain").alias("before"))
        jump = low.select(F.col("edge_id").alias("j"), F.col("chain").alias("far"))
        after = stored(low.join(jump, F.col("chain") == F.col("j"), "left").select("edge_id", F.least("chain", F.coalesce("far", "chain")).alias("chain"), "before"), "labels")
        label = after.select("edge_id", "chain")
        if after.where("chain != before").isEmpty():
            return label


def seed_popularity(uses: DataFrame) -> DataFrame:
    """(edge_id, n_sources, popularity): from (edge_id, source), distinct sources of an edge."""
    return uses.groupBy("edge_id").agg(F.countDistinct("source").alias("n_sources")).withColumn("popularity", F.log1p(F.col("n_sources").cast("double")))


def violations(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, id): what keeps tables from being a graph."""
    ids = vertices.select("v")
    rules = [
        vertices.where(~(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)) | F.col("lon").isNull() | F.col("lat").isNull()).select(F.lit("coordinate").alias("rule"), F.col("v").alias("id")),
        edges.where("a = b").select(F.lit("self-loop"), "edge_id"),
        edges.where("m is null or m <= 0").select(F.lit("length"), "edge_id"),
        edges.select("edge_id", F.explode(F.array("a", "b")).alias("v")).join(ids, "v", "left_anti").select(F.lit("missing vertex"), "edge_id"),
        edges.groupBy("edge_id").count().where("count > 1").select(F.lit("repeated edge"), "edge_id"),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.union(r)
    return out
