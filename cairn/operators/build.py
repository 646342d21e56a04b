"""From drafts of lines to a graph: splits at crossings, repairs of near misses, edges.

Drafts are (draft_id, line array of points, policy, key_a, key_b, kind, claim, confidence and
the attributes of ATTRIBUTES).  policy says where a draft may get junctions: `planar` at
crossings and near misses, `explicit-nodes` only at its own points, `explicit-endpoints` at
its ends (near misses are repaired), `grade-separated-endpoints` at its ends, unrepaired.
key_a and key_b name the ends where the source does; those that begin with `seam:` may be
joined like ends without a name.

A primitive (draft_id, seg) is a piece with two ends: the whole line for the two endpoint
policies, else one segment.  An end is (draft_id, seg, side), side 0 or 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geo
from cairn.operators import spatial
from cairn.state import stored

WHOLE = ("explicit-endpoints", "grade-separated-endpoints")
#: Confidence of a repaired edge at most, and shares that count as one place.
REPAIRED, SAME_T, END_T = 0.74, 1e-9, 1e-12
ATTRIBUTES = ("standing", "marking", "terrain", "access")
PRIM = ["draft_id", "seg"]
END = [*PRIM, "side"]
c = F.col


def primitives(drafts: DataFrame) -> DataFrame:
    """(draft_id, seg, policy, key_a, key_b, lon1, lat1, lon2, lat2): key_a and key_b only
    where the primitive's end is the draft's."""
    n = F.size("line")
    whole = c("policy").isin(*WHOLE)
    seg = F.explode(F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 2)))
    rows = drafts.where(n >= 2).withColumn("seg", seg)
    a, b = F.get("line", c("seg")), F.when(whole, F.element_at("line", -1)).otherwise(F.get("line", c("seg") + 1))
    ends = {"lon1": a["lon"], "lat1": a["lat"], "lon2": b["lon"], "lat2": b["lat"]}
    last = whole | (c("seg") == n - 2)
    keys = [F.when(c("seg") == 0, c("key_a")).alias("key_a"), F.when(last, c("key_b")).alias("key_b")]
    return rows.select(*PRIM, "policy", *keys, *[v.alias(k) for k, v in ends.items()])


def snap_primitives(drafts: DataFrame) -> DataFrame:
    """(draft_id, seg, t0, t1, lon1, lat1, lon2, lat2): the segments of primitives, and the
    shares of the primitive's length at which each begins and ends."""
    pieces = F.transform(geo.segments(c("line")), lambda s: geo.metres(s["a"], s["b"]))
    rows = drafts.where(F.size("line") >= 2).select("draft_id", "policy", "line", pieces.alias("m"))
    rows = rows.select("*", F.posexplode(geo.segments(c("line"))).alias("i", "s"))
    before = F.aggregate(F.slice("m", 1, c("i")), F.lit(0.0), lambda s, x: s + x)
    whole, total = c("policy").isin(*WHOLE), F.greatest(geo.total(c("m")), F.lit(2.220446049250313e-16))
    t0, t1 = F.when(whole, before / total).otherwise(0.0), F.when(whole, (before + F.get("m", c("i"))) / total).otherwise(1.0)
    return rows.select("draft_id", F.when(whole, 0).otherwise(c("i")).alias("seg"), t0.alias("t0"), t1.alias("t1"), c("s.a.lon").alias("lon1"), c("s.a.lat").alias("lat1"), c("s.b.lon").alias("lon2"), c("s.b.lat").alias("lat2"))


def ends_of(prims: DataFrame) -> DataFrame:
    """(draft_id, seg, side, lon, lat, open): open ends may be joined with near ones."""
    side = lambda k, x, y, key: F.struct(F.lit(k).alias("side"), c(x).alias("lon"), c(y).alias("lat"), (c("policy").isin("planar", "explicit-endpoints") & (c(key).isNull() | c(key).startswith("seam:"))).alias("open"))
    return prims.select(*PRIM, F.explode(F.array(side(0, "lon1", "lat1", "key_a"), side(1, "lon2", "lat2", "key_b"))).alias("e")).select(*PRIM, "e.*")


def near_misses(prims: DataFrame, snaps: DataFrame, tolerance_m: float, size: float) -> DataFrame:
    """(draft_id, seg, side, to_draft, to_seg, to_t, to_side, lon, lat, d2): open ends within
    tolerance of another draft's primitive; to_side where that is the other's end (each pair
    of ends once, from the smaller one), else null; lon and lat the place on the other."""
    e = ends_of(prims).where("open")
    dlat = tolerance_m / geo.LAT_SHORT_M
    dlon = tolerance_m / (geo.LAT_M * F.greatest(F.abs(F.cos(F.radians("lat"))), F.lit(0.05)))
    a = spatial.boxed_points(e, "a", size, dlon, dlat)
    target = snaps.join(prims.select(*PRIM, "policy", "key_a", "key_b"), PRIM).where(c("policy").isin("planar", "explicit-endpoints"))
    target = target.select(c("draft_id").alias("to_draft"), c("seg").alias("to_seg"), "t0", "t1", "key_a", "key_b", *spatial.ENDS)
    both = spatial.met(a, spatial.boxed_segments(target, "b", size), size).where("draft_id != to_draft")
    sx = geo.LAT_M * F.cos(F.radians("lat"))
    vx, vy = (c("lon2") - c("lon1")) * sx, (c("lat2") - c("lat1")) * geo.LAT_SHORT_M
    wx, wy = (c("lon") - c("lon1")) * sx, (c("lat") - c("lat1")) * geo.LAT_SHORT_M
    span = vx * vx + vy * vy
    t = F.least(F.greatest((wx * vx + wy * vy) / span, F.lit(0.0)), F.lit(1.0))
    both = both.where(span > 2.220446049250313e-16).withColumn("t", t)
    dx, dy = wx - c("t") * vx, wy - c("t") * vy
    both = both.withColumn("d2", dx * dx + dy * dy).where(c("d2") <= tolerance_m * tolerance_m).withColumn("to_t", c("t0") + (c("t1") - c("t0")) * c("t"))
    key = F.when(c("to_t") <= END_T, c("key_a")).when(c("to_t") >= 1 - END_T, c("key_b"))
    side = F.when(c("to_t") <= SAME_T, 0).when(c("to_t") >= 1 - SAME_T, 1)
    both = both.where(key.isNull() | key.startswith("seam:")).withColumn("to_side", side)
    both = both.where(c("to_side").isNull() | (F.struct(*END) < F.struct("to_draft", "to_seg", "to_side")))
    at = lambda k: F.when(c("t") == 0, c(f"{k}1")).when(c("t") == 1, c(f"{k}2")).otherwise(c(f"{k}1") + (c(f"{k}2") - c(f"{k}1")) * c("t"))
    return both.select(*END, "to_draft", "to_seg", "to_t", "to_side", at("lon").alias("x"), at("lat").alias("y"), "d2").withColumnsRenamed({"x": "lon", "y": "lat"})


def clustered(near: DataFrame, ends: DataFrame, tolerance_m: float) -> DataFrame:
    """(draft_id, seg, side, root, lon, lat): ends that are joined, with their cluster's
    smallest end and the place where they meet, that of the end with the least sum of
    distances to the others.

    Pairs merge in order of distance where no two ends of the merged cluster are farther
    apart than the tolerance.  A pair is decided as soon as it is the first one left of both
    its clusters, for nothing else can change these; so each round decides many at once, and
    the result is that of going through all pairs one by one.  Ends at one place are one
    from the start: no pair comes before theirs."""
    end = F.struct(*END)
    place = F.struct("lon", "lat")
    who = stored(ends.select(*END, "lon", "lat", F.min(end).over(Window.partitionBy("lon", "lat")).alias("spot")), "ends")
    pair = near.where("to_side is not null").select(end.alias("u"), F.struct(c("to_draft").alias("draft_id"), c("to_seg").alias("seg"), c("to_side").alias("side")).alias("v"), "d2")
    spots = who.select(end.alias("e"), "spot")
    left = pair.join(spots.withColumnsRenamed({"e": "u", "spot": "p"}), "u").join(spots.withColumnsRenamed({"e": "v", "spot": "q"}), "v").where("p != q")
    left = stored(left.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.min(F.struct("d2", "u", "v")).alias("o")), "pairs")
    touched = left.select(c("p").alias("spot")).union(left.select("q")).distinct()
    label = stored(who.select("spot", "lon", "lat").distinct().join(touched, "spot").withColumn("root", c("spot")), "clusters")
    while not left.isEmpty():
        root = label.select("spot", "root")
        now = left.join(root.withColumnsRenamed({"spot": "p", "root": "a"}), "p").join(root.withColumnsRenamed({"spot": "q", "root": "b"}), "q").where("a != b")
        now = stored(now, "pairs")
        first = now.select("o", F.explode(F.array("a", "b")).alias("r")).groupBy("r").agg(F.min("o").alias("o"))
        sure = now.join(first.withColumnsRenamed({"r": "a", "o": "oa"}), "a").join(first.withColumnsRenamed({"r": "b", "o": "ob"}), "b").where("o = oa and o = ob")
        sure = stored(sure.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "o"), "sure")
        x = label.select(c("root").alias("a"), c("lon").alias("x1"), c("lat").alias("y1"))
        y = label.select(c("root").alias("b"), c("lon").alias("x2"), c("lat").alias("y2"))
        far = sure.join(x, "a").join(y, "b").groupBy("a", "b").agg(F.max(geo.haversine(c("x1"), c("y1"), c("x2"), c("y2"))).alias("far")).where(c("far") <= tolerance_m)
        label = stored(label.join(far.select(c("b").alias("root"), c("a").alias("to")), "root", "left").select("spot", "lon", "lat", F.coalesce("to", "root").alias("root")), "clusters")
        left = stored(now.join(sure.select("o"), "o", "left_anti").select("p", "q", "o"), "pairs")
    full = who.join(label.select("spot", "root"), "spot", "left").withColumn("root", F.coalesce("root", "spot"))
    # What is joined are ends of different drafts.
    of = full.groupBy("root").agg(F.min("draft_id").alias("x"), F.max("draft_id").alias("y")).where("x != y").select("root")
    full = stored(full.join(of, "root"), "members")
    # The sum of distances by place, each as often as ends lie there.
    spot = full.groupBy("root", "spot", "lon", "lat").agg(F.count("*").alias("n"), F.min(end).alias("first"))
    other = spot.select("root", c("lon").alias("x2"), c("lat").alias("y2"), "n")
    score = spot.drop("n").join(other, "root").groupBy("root", "first", "lon", "lat").agg(F.sum(c("n") * geo.haversine(c("lon"), c("lat"), c("x2"), c("y2"))).alias("score"))
    best = score.groupBy("root").agg(F.min(F.struct("score", "first", place.alias("at"))).alias("b")).select("root", "b.at.lon", "b.at.lat")
    return full.select(*END, "root").join(best, "root").select(*END, "root", "lon", "lat")


def cuts(drafts: DataFrame, prims: DataFrame, tolerance_m: float, size: float) -> DataFrame:
    """(draft_id, seg, t, lon, lat, snapped): where each primitive is cut, its ends included.
    Cuts less than SAME_T apart are one, a repaired one before others."""
    plain = lambda df, t, x, y, order, snapped=False: df.select(*PRIM, t.alias("t"), x.alias("lon"), y.alias("lat"), F.lit(snapped).alias("snapped"), F.lit(order).alias("o"))
    zero, one = F.lit(0.0), F.lit(1.0)
    all_cuts = plain(prims, zero, c("lon1"), c("lat1"), 0).union(plain(prims, one, c("lon2"), c("lat2"), 0))
    flat = prims.where("policy = 'planar'").select(F.struct(*PRIM).alias("seg_id"), *spatial.ENDS)
    hit = spatial.crossings(flat, size).join(flat.withColumnRenamed("seg_id", "a"), "a")
    at = lambda k: F.when(c("t") == 0, c(f"{k}1")).when(c("t") == 1, c(f"{k}2")).otherwise(c(f"{k}1") + (c(f"{k}2") - c(f"{k}1")) * c("t"))
    hit = stored(hit.select("a", "b", "t", "u", at("lon").alias("x"), at("lat").alias("y")), "crossings")
    for side, t in (("a", "t"), ("b", "u")):
        all_cuts = all_cuts.union(hit.select(f"{side}.draft_id", f"{side}.seg", c(t).alias("t"), c("x").alias("lon"), c("y").alias("lat"), F.lit(False), F.lit(1)))
    near = stored(near_misses(prims, snap_primitives(drafts), tolerance_m, size), "near")
    joined = stored(clustered(near, ends_of(prims).where("open"), tolerance_m), "joined")
    all_cuts = all_cuts.union(joined.select(*PRIM, c("side").cast("double").alias("t"), "lon", "lat", F.lit(True), F.lit(2)))
    inner = near.where("to_side is null").join(joined.select(*END), END, "left_anti")
    best = inner.groupBy(*END).agg(F.min(F.struct("d2", "to_draft", "to_seg", "to_t", "lon", "lat")).alias("b"))
    all_cuts = all_cuts.union(best.select(*PRIM, c("side").cast("double"), "b.lon", "b.lat", F.lit(True), F.lit(3)))
    all_cuts = all_cuts.union(best.select("b.to_draft", "b.to_seg", "b.to_t", "b.lon", "b.lat", F.lit(True), F.lit(3)))
    w = Window.partitionBy(*PRIM).orderBy("t", "o", "lon", "lat")
    new = F.coalesce((c("t") - F.lag("t").over(w)) >= SAME_T, F.lit(True)).cast("int")
    rows = all_cuts.withColumn("new", new).withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = F.struct("t", "lon", "lat", "snapped")
    order = F.struct("t", "o", "lon", "lat")
    one_cut = rows.groupBy(*PRIM, "k").agg(F.coalesce(F.max_by(cut, F.when(c("snapped"), order)), F.min_by(cut, order)).alias("p"))
    return one_cut.select(*PRIM, "p.*")


def built(drafts: DataFrame, tolerance_m: float = 8.0, size: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(vertices (v, lon, lat, key), edges (edge_id, a, b, draft_id, seg, t0, t1, line, m,
    snapped, confidence, kind, claim, ATTRIBUTES, n_drafts)).

    A vertex is a named end or else a place; its id is the hash of that, so that nothing is
    numbered globally.  Edges with equal ends, shape, kind and claim are one: the first in
    order of draft stands, with the largest confidence and what others know of attributes
    that it doesn't (`unknown`).  Drafts with less than two points make nothing."""
    drafts = stored(drafts, "drafts")
    prims = stored(primitives(drafts), "primitives")
    w = Window.partitionBy(*PRIM).orderBy("t")
    rows = cuts(drafts, prims, tolerance_m, size).withColumns({f"{k}_": F.lead(k).over(w) for k in ("t", "lon", "lat", "snapped")})
    rows = rows.where("t_ is not null and pow(lon - lon_, 2) + pow(lat - lat_, 2) >= 1e-18").join(prims.select(*PRIM, "key_a", "key_b"), PRIM)
    named = lambda key: F.when(~c(key).startswith("seam:"), c(key))
    key = lambda t: F.when(c(t) <= END_T, named("key_a")).when(c(t) >= 1 - END_T, named("key_b"))
    where = lambda x, y: F.concat_ws(",", c(x).cast("string"), c(y).cast("string"))
    rows = rows.withColumns({"ka": key("t"), "kb": key("t_")})
    rows = rows.withColumns({"a": F.xxhash64(F.coalesce("ka", where("lon", "lat"))), "b": F.xxhash64(F.coalesce("kb", where("lon_", "lat_")))}).where("a != b")
    rows = stored(rows, "pieces")
    end = lambda v, x, y, k: F.struct(c(v).alias("v"), c(x).alias("lon"), c(y).alias("lat"), c(k).alias("key"))
    ends = rows.select(F.struct(*PRIM, "t").alias("o"), F.explode(F.array(end("a", "lon", "lat", "ka"), end("b", "lon_", "lat_", "kb"))).alias("e"))
    vertices = stored(ends.groupBy("e.v").agg(F.min_by("e", "o").alias("e")).select("e.*"), "vertices")
    spot = lambda v: vertices.select(c("v").alias(v), F.struct("lon", "lat").alias(f"p{v}"))
    rows = rows.join(spot("a"), "a").join(spot("b"), "b").join(drafts.drop("key_a", "key_b"), "draft_id")
    m = F.transform(geo.segments(c("line")), lambda s: geo.metres(s["a"], s["b"]))
    rows = rows.withColumn("along", F.transform(m, lambda x, i: F.aggregate(F.slice(m, F.lit(1), i + 1), F.lit(0.0), lambda s, y: s + y)))
    total = F.element_at("along", -1)
    inside = F.filter(F.zip_with("along", F.slice("line", F.lit(2), F.size("along")), lambda s, p: F.when((s > total * c("t") + 1e-7) & (s < total * c("t_") - 1e-7), F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))), lambda p: p.isNotNull())
    empty = F.array().cast("array<struct<lon:double,lat:double>>")
    line = F.concat(F.array("pa"), F.when(c("policy").isin(*WHOLE), inside).otherwise(empty), F.array("pb"))
    rows = rows.withColumn("shape", line).withColumn("snapped", c("snapped") | c("snapped_"))
    text = F.transform("shape", lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))
    there, back = F.struct(c("a").alias("a"), c("b").alias("b"), F.array_join(text, ",").alias("s")), F.struct(c("b").alias("a"), c("a").alias("b"), F.array_join(F.reverse(text), ",").alias("s"))
    rows = rows.withColumn("support", F.least(there, back)).withColumn("o", F.struct(*PRIM, "t"))
    sure = F.when(c("snapped"), F.least(c("confidence"), F.lit(REPAIRED))).otherwise(c("confidence"))
    known = [F.coalesce(F.min_by(k, F.when(c(k) != "unknown", c("o"))), F.lit("unknown")).alias(k) for k in ATTRIBUTES]
    body = F.min_by(F.struct("draft_id", "seg", c("t").alias("t0"), c("t_").alias("t1"), "a", "b", c("shape").alias("line"), "snapped"), "o").alias("e")
    one = rows.groupBy("support", "kind", "claim").agg(body, F.max(F.least(F.greatest(sure, F.lit(0.0)), F.lit(1.0))).alias("confidence"), *known, F.count("*").alias("n_drafts"))
    edges = one.select(F.xxhash64("support", "kind", "claim").alias("edge_id"), "e.*", "confidence", "kind", "claim", *ATTRIBUTES, "n_drafts")
    metres = geo.total(F.transform(geo.segments(c("line")), lambda s: geo.haversine(s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"])))
    return vertices, edges.withColumn("m", metres)


def fragment_key(key: Column, source_lon: Column, source_lat: Column, lon: Column, lat: Column, kind: str, key_a: Column, key_b: Column) -> Column:
    """The name of a fragment's end: the source's where the place is the same, else one of its
    own, from the fragment's kind (`clip` or `seam`), the source's ends and the place."""
    own = F.concat(F.lit(f"{kind}:"), key_a, F.lit("→"), key_b, F.lit(":"), lon.cast("string"), F.lit(":"), lat.cast("string"))
    return F.when((source_lon == lon) & (source_lat == lat), key).otherwise(own)
