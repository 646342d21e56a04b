"""Spatial joins: points, lines and rings meet through the cells of a pyramid of grids.

Every row has a box and, by its box's size, a level: cells of level l are 2^l times the
smallest cell, so that a box of any size touches four cells of its level at most.  Two boxes
meet in a cell of the coarser one's level, and the pair is kept in the cell that holds the
lower left corner of what they share, so that none is listed twice.  The exact test follows.
Hot cells are split by Spark's skew join; the cell size is a parameter, never the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geo
from cairn.state import dropped, stored

#: Levels of the pyramid at most.
LEVELS = 32


def cell(lon: Column, lat: Column, size: Column | float) -> Column:
    """One long per cell of `size` degrees."""
    return F.floor(lon / size).cast("long") * 4_000_000_000 + F.floor(lat / size).cast("long")


def cells_of_box(west: Column, south: Column, east: Column, north: Column, size: Column | float) -> Column:
    """Array of all cells that a box touches."""
    xs = F.sequence(F.floor(west / size).cast("long"), F.floor(east / size).cast("long"))
    ys = lambda: F.sequence(F.floor(south / size).cast("long"), F.floor(north / size).cast("long"))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys(), lambda y: x * 4_000_000_000 + y)))


def boxed(df: DataFrame, side: str, west: Column, south: Column, east: Column, north: Column, size: float) -> DataFrame:
    """df with a box and its level, in columns that start with `side`; rows without one go."""
    df = df.withColumns({f"{side}_w": west, f"{side}_s": south, f"{side}_e": east, f"{side}_n": north})
    wide = F.greatest(F.col(f"{side}_e") - F.col(f"{side}_w"), F.col(f"{side}_n") - F.col(f"{side}_s"))
    level = F.when(wide > size, F.least(F.ceil(F.log(2.0, wide / size)), F.lit(LEVELS - 1))).otherwise(0).cast("int")
    return df.withColumn(f"{side}_l", level).where(" and ".join(f"{side}_{k} is not null" for k in "wsen"))


def boxed_points(df: DataFrame, side: str, size: float, dlon: Column | float = 0.0, dlat: Column | float = 0.0) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    return boxed(df, side, lon - dlon, lat - dlat, lon + dlon, lat + dlat, size)


def boxed_segments(df: DataFrame, side: str, size: float) -> DataFrame:
    return boxed(df, side, F.least("lon1", "lon2"), F.least("lat1", "lat2"), F.greatest("lon1", "lon2"), F.greatest("lat1", "lat2"), size)


def boxed_line(df: DataFrame, side: str, line: str, size: float, dlon: Column | float = 0.0, dlat: Column | float = 0.0) -> DataFrame:
    lon, lat = F.transform(line, lambda p: p["lon"]), F.transform(line, lambda p: p["lat"])
    return boxed(df, side, F.array_min(lon) - dlon, F.array_min(lat) - dlat, F.array_max(lon) + dlon, F.array_max(lat) + dlat, size)


def met(a: DataFrame, b: DataFrame, size: float, x: str = "a", y: str = "b") -> DataFrame:
    """All pairs of rows of a and b (as boxed() gives them, with sides x and y) whose boxes
    meet, once each, with both rows' columns but the boxes'.  The levels that either side has
    are a scalar of a few numbers; each row takes part at those that are the coarser one of
    its own and any of these."""

    def listed(df: DataFrame, side: str, other: DataFrame, o: str) -> DataFrame:
        levels = other.agg(F.collect_set(f"{o}_l")).scalar()
        own = F.col(f"{side}_l")
        rows = df.withColumn("v_", levels).withColumn("l_", F.explode(F.array_distinct(F.transform("v_", lambda n: F.greatest(n, own))))).drop("v_").withColumn("z_", size * F.pow(F.lit(2.0), "l_"))
        return rows.withColumn("c_", F.explode(cells_of_box(*[F.col(f"{side}_{k}") for k in "wsen"], F.col("z_"))))

    both = listed(a, x, b, y).join(listed(b, y, a, x).drop("z_"), ["l_", "c_"])
    c, sz = F.col, F.col("z_")
    meet = (c(f"{x}_w") <= c(f"{y}_e")) & (c(f"{y}_w") <= c(f"{x}_e")) & (c(f"{x}_s") <= c(f"{y}_n")) & (c(f"{y}_s") <= c(f"{x}_n"))
    here = (c("l_") == F.greatest(f"{x}_l", f"{y}_l")) & (c("c_") == cell(F.greatest(f"{x}_w", f"{y}_w"), F.greatest(f"{x}_s", f"{y}_s"), sz))
    return both.where(meet & here).drop("l_", "c_", "z_", *[f"{s}_{k}" for s in (x, y) for k in "wsenl"])


def in_window(points: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows whose point lies in a box, its sides included: a filter that reaches the scan."""
    return points.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def nearest_vertex(points: DataFrame, key: list[str], vertices: DataFrame, size: float) -> DataFrame:
    """points (identified by the columns `key`) with v and distance_m: the vertex nearest in
    degrees (ties: the smaller v), its distance on the sphere.

    Points look at the cells within reach; those that find none nearer than the reach try
    again with four times as much, until that spans the globe."""
    left, out, reach = points, None, size
    place = F.struct((F.pow(F.col("vlon") - F.col("lon"), 2) + F.pow(F.col("vlat") - F.col("lat"), 2)).alias("d2"), "v", "vlon", "vlat")
    v = vertices.select("v", F.col("lon").alias("vlon"), F.col("lat").alias("vlat"))
    while True:
        near = left.withColumn("cell", F.explode(cells_of_box(F.col("lon") - reach, F.col("lat") - reach, F.col("lon") + reach, F.col("lat") + reach, reach)))
        both = near.join(v.withColumn("cell", cell(F.col("vlon"), F.col("vlat"), reach)), "cell")
        best = stored(both.groupBy(*key).agg(F.min(place).alias("best_")).where(F.col("best_.d2") <= reach * reach), "nearest")
        found = left.join(best, key)
        out = found if out is None else out.unionByName(found)
        left = left.join(best, key, "left_anti")
        if reach > 512 or left.isEmpty():
            break
        reach *= 4
    return out.select(*points.columns, F.col("best_.v").alias("v"), geo.haversine(F.col("lon"), F.col("lat"), F.col("best_.vlon"), F.col("best_.vlat")).alias("distance_m"))


def _hits(points: DataFrame, key: list[str], edges: DataFrame, max_m: float, digits: int) -> DataFrame:
    """points' key and lon, lat with the segments of edges whose box meets that of max_m
    around the point, as d_ and share t_: those within max_m, and some beyond, which the
    callers drop behind their first aggregate.  The smallest cell is as large as a point's
    box, so that it touches four at most.

    What geo.projection() computes stands here in columns, step by step, the point's part in
    front of the join: as one expression, and repeated in a filter, it was a method too large
    for the JVM to compile."""
    c = F.col
    dlat = max_m / geo.LAT_SHORT_M
    dlon = max_m / (geo.LAT_M * F.greatest(F.abs(F.cos(F.radians("lat"))), F.lit(0.01)))
    size = min(2 * dlat, 360.0)
    a = boxed_points(points.select(*key, "lon", "lat"), "a", size, dlon, dlat).withColumn("sx_", geo.metres_east("lat"))
    rows = met(a, boxed_segments(edges, "b", size), size)
    for columns in geo.projection_steps("lon", "lat", "lon1", "lat1", "lon2", "lat2", "sx_"):
        rows = rows.withColumns(columns)
    return rows.withColumn("d_", F.round("d_", digits))


def edges_within(points: DataFrame, key: list[str], edges: DataFrame, max_m: float, digits: int = 6) -> DataFrame:
    """(key columns, edge_id, distance_m): all edges within max_m metres of each point."""
    return _hits(points, key, edges, max_m, digits).groupBy(*key, "edge_id").agg(F.min("d_").alias("distance_m")).where(F.col("distance_m") <= max_m)


def nearest_edges(points: DataFrame, key: list[str], edges: DataFrame, max_m: float, k: int, digits: int = 6) -> DataFrame:
    """(key columns, edge_id, distance_m, anchor, progress, rank): of edges within max_m metres
    of each point the k nearest; ties (to `digits` decimals of a metre, for edges that share
    an end differ by rounding there) by anchor, then edge id.  edges: (edge_id, lon1, lat1,
    lon2, lat2, anchor) segments, several per edge allowed; progress is the share along the
    nearest of them; k is the feature.

    Each edge's best segment and then the k best edges combine before the exchange by key;
    no window ranks all that is near."""
    c = F.col
    place = F.struct(c("d_").alias("distance_m"), "anchor", "edge_id", c("t_").alias("progress"))
    hits = _hits(points, key, edges, max_m, digits)
    if k == 1:
        best = hits.groupBy(*key).agg(F.min(place).alias("p")).where(c("p.distance_m") <= max_m)
        return best.select(*key, "p.edge_id", "p.distance_m", "p.anchor", "p.progress", F.lit(1).alias("rank"))
    one = hits.groupBy(*key, "edge_id").agg(F.min(place).alias("p")).where(c("p.distance_m") <= max_m)
    best = one.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list("p")), 1, k).alias("p"))
    return best.select(*key, F.posexplode("p").alias("i", "p")).select(*key, "p.edge_id", "p.distance_m", "p.anchor", "p.progress", (c("i") + 1).alias("rank"))


def nearest_edge_at_any_distance(points: DataFrame, key: list[str], edges: DataFrame, first_m: float = 32.0, rounds: int = 11, digits: int = 6) -> DataFrame:
    """(key columns, edge_id, distance_m, anchor, progress): the edge nearest to each point.
    Points look within first_m metres; those that find none look four times as far, until that
    spans the globe, so what a point meets is what is about as near as its nearest edge."""
    left, found = points, []
    for k in range(rounds):
        best = stored(nearest_edges(left, key, edges, first_m * 4**k, 1, digits).drop("rank"), "nearest")
        found.append(best)
        rest = stored(left.join(best, key, "left_anti"), "left")
        if k:
            dropped(left)
        left = rest
        if left.isEmpty():
            break
    dropped(left)
    return reduce(DataFrame.union, found)


def points_in_rings(points: DataFrame, rings: DataFrame, size: float) -> DataFrame:
    """(point columns, ring_id): the rings that hold each point.  rings: (ring_id, ring)."""
    both = met(boxed_points(points, "a", size), boxed_line(rings, "b", "ring", size), size)
    return both.where(geo.in_ring(F.col("lon"), F.col("lat"), F.col("ring"))).select(*points.columns, "ring_id")


ENDS = ("lon1", "lat1", "lon2", "lat2")


def crossings(segments: DataFrame, size: float) -> DataFrame:
    """(a, b, t, u): pairs of segments (seg_id, lon1, lat1, lon2, lat2) that intersect, a < b,
    and the shares along each."""
    c = F.col
    side = lambda s: boxed_segments(segments, s, size).select(c("seg_id").alias(s), *[c(k).alias(f"{s}_{k}") for k in ENDS], *[f"{s}_{k}" for k in "wsenl"])
    hit = geo.intersection((c("a_lon1"), c("a_lat1")), (c("a_lon2"), c("a_lat2")), (c("b_lon1"), c("b_lat1")), (c("b_lon2"), c("b_lat2")))
    both = met(side("a"), side("b"), size).where("a < b").withColumn("hit", hit).where("hit is not null")
    return both.select("a", "b", "hit.t", "hit.u")


PROTECTED = ["sidewalk", "crossing", "pedestrian-street", "roadway", "service-road", "cycleway", "bushwhack"]


def parallels(drafts: DataFrame, canonical: DataFrame, size: float, tolerance_m: float = 8.0, least_cosine: float = 0.94) -> DataFrame:
    """(seg_id, twin, separation_m): the nearest canonical segment that runs alongside a
    draft segment's midpoint and is the same kind of facility.  Both sides are segments
    (seg_id, lon1, lat1, lon2, lat2, kind, claim)."""
    c = F.col
    mid = drafts.withColumn("mx", (c("lon1") + c("lon2")) / 2).withColumn("my", (c("lat1") + c("lat2")) / 2)
    dlat = tolerance_m / geo.LAT_M
    dlon = dlat / F.greatest(F.abs(F.cos(F.radians("my"))), F.lit(0.05))
    a = boxed(mid, "a", c("mx") - dlon, c("my") - dlat, c("mx") + dlon, c("my") + dlat, size)
    b = boxed_segments(canonical, "b", size).select(c("seg_id").alias("twin"), *[c(k).alias(f"c_{k}") for k in (*ENDS, "kind", "claim")], *[f"b_{k}" for k in "wsenl"])
    sx, sy = geo.LAT_M * F.cos(F.radians("my")), F.lit(geo.LAT_M)
    vx, vy, wx, wy = (c("c_lon2") - c("c_lon1")) * sx, (c("c_lat2") - c("c_lat1")) * sy, (c("mx") - c("c_lon1")) * sx, (c("my") - c("c_lat1")) * sy
    span = vx * vx + vy * vy
    t = F.when(span <= 2.220446049250313e-16, 0.0).otherwise((vx * wx + vy * wy) / span)
    inside = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    far = F.hypot(wx - inside * vx, wy - inside * vy)
    cosine = geo.parallel_cosine((c("lon1"), c("lat1")), (c("lon2"), c("lat2")), (c("c_lon1"), c("c_lat1")), (c("c_lon2"), c("c_lat2")))
    same = (c("claim") == c("c_claim")) & ((c("kind") == c("c_kind")) | ~(c("kind").isin(PROTECTED) | c("c_kind").isin(PROTECTED)))
    hits = met(a, b, size).where(same).withColumn("separation_m", far).where((c("separation_m") <= tolerance_m) & t.between(0.0, 1.0) & (cosine >= least_cosine))
    best = hits.groupBy("seg_id").agg(F.min(F.struct("separation_m", "twin")).alias("b"))
    return best.select("seg_id", c("b.twin").alias("twin"), c("b.separation_m").alias("separation_m"))


def clipped(segments: DataFrame, rects: DataFrame, size: float = 0.01) -> DataFrame:
    """(seg_id, part, t0, t1): the parts of each segment inside a union of rectangles
    (west, south, east, north).  A segment is cut at the sides of each rectangle that its box
    meets; a piece stays if its midpoint is in any of them, and touching pieces are one."""
    c = F.col
    rows = rects.select("west", "south", "east", "north").distinct()
    near = met(boxed_segments(segments.select("seg_id", *ENDS), "a", size), boxed(rows, "b", c("west"), c("south"), c("east"), c("north"), size), size)
    rows = near.groupBy("seg_id", *ENDS).agg(F.collect_list(F.struct("west", "south", "east", "north")).alias("boxes"))
    dx, dy = F.nullif(c("lon2") - c("lon1"), F.lit(0.0)), F.nullif(c("lat2") - c("lat1"), F.lit(0.0))
    cuts = F.flatten(F.transform("boxes", lambda b: F.array((b["west"] - c("lon1")) / dx, (b["east"] - c("lon1")) / dx, (b["south"] - c("lat1")) / dy, (b["north"] - c("lat1")) / dy)))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(cuts, lambda t: t.isNotNull() & (t > 0) & (t < 1)))))
    rows = rows.withColumn("cuts", cuts).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("cuts") - 2)))
    rows = rows.withColumn("t0", F.get("cuts", c("i"))).withColumn("t1", F.get("cuts", c("i") + 1))
    m = (c("t0") + c("t1")) / 2
    x, y = c("lon1") + (c("lon2") - c("lon1")) * m, c("lat1") + (c("lat2") - c("lat1")) * m
    inside = rows.where(F.exists("boxes", lambda b: x.between(b["west"], b["east"]) & y.between(b["south"], b["north"])))
    w = Window.partitionBy("seg_id").orderBy("t0")
    runs = inside.withColumn("part", F.sum(F.when(F.lag("t1").over(w) == c("t0"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("seg_id", "part").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
