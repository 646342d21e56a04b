"""The library's queries over the bridge, each with the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn import sinks
from cairn.functions import calendar, crs, geo, identity, physics, vocab
from cairn.operators import build, designs, enrich, gazetteer, graph, library, matching, network, overlays, returns, routes, spatial, traces, walks
from cairn.plans import bridge
from cairn.plans.bridge import table
from cairn.plans.registry import query
from cairn.sources.networks import classified
from cairn.state import stored

BOUNDS = routes.Bounds()
r = F.round


def view(body: str, more: str = "") -> str:
    return f"WITH {bridge.SQL}{', ' + more if more else ''} {body}"


def num(x: float) -> str:
    """A DOUBLE literal."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def _joint(g: str) -> str:
    out = f"CASE WHEN {g} <= {num(physics.DESCENT[0][0])} THEN {num(physics.DESCENT[1][0])} WHEN {g} >= {num(physics.ASCENT[0][2])} THEN {num(physics.ASCENT[1][2])}"
    for x0, w, y0, y1, m0, m1 in physics.PIECES:
        t = f"(({g} - {num(x0)}) / {num(w)})"
        out += f" WHEN {g} < {num(x0 + w)} THEN (2e0*{t}*{t}*{t} - 3e0*{t}*{t} + 1e0) * {num(y0)} + ({t}*{t}*{t} - 2e0*{t}*{t} + {t}) * {num(w * m0)} + (3e0*{t}*{t} - 2e0*{t}*{t}*{t}) * {num(y1)} + ({t}*{t}*{t} - {t}*{t}) * {num(w * m1)}"
    return out + " END"


def _speed(g: str, c: float, d: float) -> str:
    s = f"degrees(atan({g}))"
    k = f"greatest(least({s}, 40e0), -40e0)"
    return f"greatest(exp(1.58e0 - 0.00389e0 * least(abs({s}), 40e0) + {num(c)} * {k} + {num(d)} * {k} * {k}), 0.2e0)"


# ------------------------------------------------------------------------------- routes
METRICS = f"""m AS (SELECT route_id, min(start_v) AS start_v, count(*) AS n_legs, sum(m) AS distance_m, sum(CASE WHEN e2 >= e1 THEN e2 - e1 ELSE 0e0 END) AS ascent_m, sum(CASE WHEN e2 < e1 THEN e1 - e2 ELSE 0e0 END) AS descent_m,
 sum(m / 1000e0 * ({_joint("grade")}) * CASE WHEN terrain = 'pavement' THEN 1e0 ELSE 1.28e0 END) AS load_km,
 sum(3.6e0 * m / CASE WHEN terrain = 'pavement' THEN {_speed("grade", -0.00726, -0.00218)} ELSE {_speed("grade", -0.00965, -0.00248)} END) AS moving_time_s,
 100e0 * sum(m * (1e0 - greatest(0e0, least(1e0, 0.7e0 * greatest(0e0, least(1e0, road)) + 0.25e0 * (1e0 - greatest(0e0, least(1e0, conf))) + 0.5e0 * CASE access WHEN 'restricted' THEN 0.25e0 ELSE 0e0 END)))) / sum(m) AS quality,
 sum(m * greatest(0e0, least(1e0, road))) / sum(m) AS road_fraction, sum(CASE WHEN conf < 0.6e0 THEN m ELSE 0e0 END) / sum(m) AS low_confidence_fraction,
 sum(CASE WHEN access = 'restricted' THEN m ELSE 0e0 END) / sum(m) AS restricted_fraction, sum(CASE WHEN rep > 1 THEN m ELSE 0e0 END) / sum(m) AS repeated_fraction
 FROM (SELECT b_leg.*, row_number() OVER (PARTITION BY route_id, edge_id ORDER BY seq) AS rep FROM b_leg) q GROUP BY route_id)"""
SHAPES = """s AS (SELECT f.route_id, CASE WHEN start_v <> end_v THEN 'open' WHEN legs > edges THEN 'out-and-back' WHEN again THEN 'figure-eight' ELSE 'loop' END AS shape
 FROM (SELECT route_id, min(start_v) AS start_v, arg_max(to_v, seq) AS end_v, count(*) AS legs, count(DISTINCT edge_id) AS edges FROM b_leg GROUP BY route_id) f
 JOIN (SELECT route_id, max(n) > 1 AS again FROM (SELECT route_id, to_v, count(*) AS n FROM b_leg GROUP BY ALL) GROUP BY route_id) v USING (route_id))"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics with shape and start of every route."""
    return routes.measured(bridge.legs(spark, sf_dir))


@query(view("SELECT route_id, n_legs, round(distance_m, 3) AS distance_m, round(ascent_m, 3) AS ascent_m, round(descent_m, 3) AS descent_m, round(load_km, 5) AS load_km, round(moving_time_s, 3) AS moving_time_s, round(quality, 5) AS quality, round(road_fraction, 6) AS road_fraction, round(low_confidence_fraction, 6) AS low_confidence_fraction, round(restricted_fraction, 6) AS restricted_fraction, round(repeated_fraction, 6) AS repeated_fraction FROM m", METRICS))
def route_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = routes.metrics(bridge.legs(spark, sf_dir))
    places = {"distance_m": 3, "ascent_m": 3, "descent_m": 3, "load_km": 5, "moving_time_s": 3, "quality": 5}
    return m.select("route_id", "n_legs", *[r(c, places.get(c, 6)).alias(c) for c in m.columns[2:]])


@query(view("SELECT route_id, shape FROM s", SHAPES))
def route_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.shapes(bridge.legs(spark, sf_dir))


def _mix(key: str) -> str:
    return view(f"SELECT route_id, {key}, round(metres, 3) AS metres, round(metres / greatest(sum(metres) OVER (PARTITION BY route_id), 1e0), 6) AS fraction FROM (SELECT route_id, {key}, sum(m) AS metres FROM b_leg GROUP BY ALL)")


@query(_mix("terrain"))
def terrain_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.keyed_metres(bridge.legs(spark, sf_dir), "terrain").select("route_id", "terrain", r("metres", 3).alias("metres"), r("fraction", 6).alias("fraction"))


@query(_mix("access"))
def access_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.keyed_metres(bridge.legs(spark, sf_dir), "access").select("route_id", "access", r("metres", 3).alias("metres"), r("fraction", 6).alias("fraction"))


@query(view("SELECT route_id, " + ", ".join(f"round(sum(CASE WHEN abs(grade) >= {num(lo)} AND abs(grade) < {num(min(hi, 1e300))} THEN m ELSE 0e0 END), 3) AS {n}" for n, lo, hi in routes.BINS) + ", round(max(abs(grade)), 6) AS max_grade FROM b_leg GROUP BY route_id"))
def grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = routes.grades(bridge.legs(spark, sf_dir))
    return g.select("route_id", *[r(n, 3).alias(n) for n, _, _ in routes.BINS], r("max_grade", 6).alias("max_grade"))


def _checks() -> list[tuple[int, str, str, str, str, float, float]]:
    """(pos, name, kind, value in SQL, breach in SQL, bound, floor) of each bound."""
    out = []
    for pos, (name, kind, column, unit, bound, floor) in enumerate(BOUNDS.checks()):
        value = f"{column} * 100e0" if unit == 0.01 else f"{column} / {num(unit)}"
        over = f"{num(bound)} - {value}" if kind == "min" else f"{value} - {num(bound)}"
        out.append((pos, name, kind, value, f"greatest(({over}) / {num(max(bound, floor))}, 0e0)", bound, floor))
    return out


def _held(kind: str, value: str, bound: float) -> str:
    return f"{value} {'>=' if kind == 'min' else '<='} {num(bound)}"


_ODD = "shape NOT IN (" + ", ".join(f"'{s}'" for s in BOUNDS.shapes) + ")"
JUDGED = (
    f"j AS (SELECT *, penalty + 0.1e0 * (100e0 - quality) AS score, n_violations = 0 AS satisfied FROM (SELECT m.*, shape, "
    + " + ".join([*[f"CASE WHEN {_held(k, v, b)} THEN 0 ELSE 1 END" for _, _, k, v, _, b, _ in _checks()], f"CASE WHEN {_ODD} THEN 1 ELSE 0 END"])
    + " AS n_violations, 100e0 * ("
    + " + ".join([*[b for *_, b, _, _ in _checks()], f"CASE WHEN {_ODD} THEN 4e0 ELSE 0e0 END"])
    + ") AS penalty FROM m JOIN s USING (route_id)))"
)


@query(view(" UNION ALL ".join(f"SELECT route_id, {p} AS pos, '{n}' AS metric, '{k}' AS kind, round({v}, 4) AS measured, {_held(k, v, b)} AS satisfied FROM m" for p, n, k, v, _, b, _ in _checks()), METRICS))
def constraint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.audit(routes.metrics(bridge.legs(spark, sf_dir)), BOUNDS).select("route_id", "pos", "metric", "kind", r("measured", 4).alias("measured"), "satisfied")


@query(view("SELECT route_id, n_violations, satisfied, round(penalty, 6) AS penalty, round(score, 6) AS score FROM j", ", ".join([METRICS, SHAPES, JUDGED])))
def constraint_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.judged(_measured(spark, sf_dir), BOUNDS).select("route_id", "n_violations", "satisfied", r("penalty", 6).alias("penalty"), r("score", 6).alias("score"))


def _rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged routes whose objectives are rounded, so that ties are ties in any engine."""
    j = routes.judged(_measured(spark, sf_dir), BOUNDS)
    return j.select("route_id", "start_v", "satisfied", *[r(c, 6).alias(c) for c in routes.RANKED])


def _deviation(c: str, low: float, high: float) -> str:
    return f"CASE WHEN {c} < {num(low)} THEN {num(low)} - {c} WHEN {c} > {num(high)} THEN {c} - {num(high)} ELSE 0e0 END"


_OBJECTIVES = ["penalty", _deviation("distance_m", *BOUNDS.distance_m), _deviation("ascent_m", *BOUNDS.ascent_m), _deviation("descent_m", *BOUNDS.descent_m), _deviation("load_km", *BOUNDS.load_km), _deviation("moving_time_s", *BOUNDS.moving_time_s), "100e0 - quality", "restricted_fraction", "repeated_fraction"]
_ROUNDED = "k AS (SELECT route_id, start_v, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("penalty", "distance_m", "ascent_m", "descent_m", "load_km", "moving_time_s", "quality", "restricted_fraction", "repeated_fraction")) + " FROM j)"
_POINTS = "o AS (SELECT route_id, start_v, " + ", ".join(f"{x} AS o{i}" for i, x in enumerate(_OBJECTIVES)) + " FROM k)"


@query(
    view(
        "SELECT route_id, start_v FROM o x WHERE NOT EXISTS (SELECT 1 FROM o y WHERE y.start_v = x.start_v AND " + " AND ".join(f"y.o{i} <= x.o{i}" for i in range(9)) + " AND (" + " OR ".join(f"y.o{i} < x.o{i}" for i in range(9)) + "))",
        ", ".join([METRICS, SHAPES, JUDGED, _ROUNDED, _POINTS]),
    )
)
def pareto_first_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.first_front(_rounded(spark, sf_dir), BOUNDS, "start_v").select("route_id", "start_v")


@query()
def pareto_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.pareto_ranks(_rounded(spark, sf_dir), BOUNDS, "start_v").select("route_id", "start_v", "satisfied", "pareto_rank", "score")


@query()
def portfolio_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.diverse(_rounded(spark, sf_dir), lambda ids: bridge.legs(spark, sf_dir, ids), BOUNDS, "start_v")


@query(view("SELECT min(route_id) AS route_id, shape, count(*) AS n_routes FROM (SELECT route_id, shape, string_agg(edge_id || 'x' || n, ',' ORDER BY edge_id) AS sig FROM (SELECT route_id, edge_id, count(*) AS n FROM b_leg GROUP BY ALL) JOIN s USING (route_id) GROUP BY ALL) GROUP BY shape, sig", SHAPES))
def route_signature_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = bridge.legs(spark, sf_dir)
    return routes.first_of_signature(routes.signatures(legs, routes.shapes(legs)))


@query(
    view(
        "SELECT p.l AS left_id, p.l + 1 AS right_id, round(1e0 - coalesce((SELECT sum(x.m * least(x.n, y.n)) FROM e x JOIN e y ON x.edge_id = y.edge_id AND y.route_id = p.l + 1 WHERE x.route_id = p.l), 0e0) / greatest(least(da, db), 1e0), 6) AS distance FROM p",
        "e AS (SELECT route_id, edge_id, count(*) AS n, min(m) AS m FROM b_leg GROUP BY ALL), d AS (SELECT route_id, sum(m) AS d FROM b_leg GROUP BY ALL), p AS (SELECT a.route_id AS l, a.d AS da, b.d AS db FROM d a JOIN d b ON b.route_id = a.route_id + 1)",
    )
)
def route_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = bridge.legs(spark, sf_dir)
    ids = legs.select("route_id").distinct()
    pairs = ids.select(F.col("route_id").alias("left_id"), (F.col("route_id") + 1).alias("right_id")).join(ids.withColumnRenamed("route_id", "right_id"), "right_id").select("left_id", "right_id")
    return routes.overlaps(legs, pairs).select("left_id", "right_id", r("distance", 6).alias("distance"))


@query(view("SELECT route_id, round(moving_time_s * exp(1.58e0) / 4e0, 3) AS own_time_s, round(moving_time_s, 3) AS moving_time_s FROM m", METRICS))
def base_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = routes.metrics(bridge.legs(spark, sf_dir))
    return m.select("route_id", r(physics.pace_scaled(F.col("moving_time_s"), 4.0), 3).alias("own_time_s"), r("moving_time_s", 3).alias("moving_time_s"))


# ------------------------------------------------------------------------------- traces
@query(view("SELECT trace_id, count(*) AS n_points, round(coalesce(sum(tm), 0e0), 3) AS length_m FROM b_tm GROUP BY trace_id"))
def trace_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.lengths(bridge.points(spark, sf_dir)).select("trace_id", "n_points", r("length_m", 3).alias("length_m"))


@query(
    view(
        "SELECT trace_id, round(coalesce(sum(tm), 0e0), 3) AS length_m, round(sum(CASE WHEN d >= 0 THEN d ELSE 0e0 END), 3) AS ascent_m, round(sum(CASE WHEN d < 0 THEN -d ELSE 0e0 END), 3) AS descent_m, "
        + ", ".join(f"round(sum(CASE WHEN g >= {num(lo)} AND g < {num(min(hi, 1e300))} THEN tm ELSE 0e0 END), 3) AS {n}" for n, lo, hi in routes.BINS)
        + ", round(sum(CASE WHEN g >= 0.2e0 THEN tm ELSE 0e0 END), 3) AS sustained_steep_m, round(sum(coalesce(g, 0e0) * CASE WHEN g IS NULL THEN 0e0 ELSE tm END) / greatest(sum(CASE WHEN g IS NULL THEN 0e0 ELSE tm END), 1e0), 6) AS mean_grade, round(coalesce(max(g), 0e0), 6) AS max_grade FROM g GROUP BY trace_id",
        "g AS (SELECT *, ele - ele0 AS d, CASE WHEN tm > 0 THEN abs((ele - ele0) / tm) END AS g FROM b_tm)",
    )
)
def trace_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = traces.profile(bridge.points(spark, sf_dir))
    return p.select("trace_id", *[r(c, 6 if "grade" in c else 3).alias(c) for c in p.columns[1:]])


@query(
    view(
        "SELECT trace_id, pos, step, round(CASE WHEN step = 0 THEN lon ELSE lon0 + (lon - lon0) * (step * 500e0 / tm) END, 9) AS lon, round(CASE WHEN step = 0 THEN lat ELSE lat0 + (lat - lat0) * (step * 500e0 / tm) END, 9) AS lat FROM (SELECT *, unnest(range(0, CASE WHEN tm > 500e0 THEN CAST(ceil(tm / 500e0) AS BIGINT) ELSE 1 END))::INT AS step FROM b_tm)"
    )
)
def trace_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.densified(bridge.points(spark, sf_dir), 500.0).select("trace_id", "pos", "step", r("lon", 9).alias("lon"), r("lat", 9).alias("lat"))


@query()
def trace_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.simplified(bridge.points(spark, sf_dir), 500.0)


@query(
    view(
        """SELECT q.trace_id, q.n_quarter, round(lo.lon + (hi.lon - lo.lon) * t, 8) AS lon, round(lo.lat + (hi.lat - lo.lat) * t, 8) AS lat FROM
 (SELECT w.*, CASE WHEN hi.along_m > lo.along_m THEN (k - lo.along_m) / (hi.along_m - lo.along_m) ELSE 0e0 END AS t FROM w) q""",
        """a AS (SELECT trace_id, n::INT AS n_quarter, max(along_m) * n / 4e0 AS k FROM b_along, (VALUES (1), (2), (3)) x(n) GROUP BY trace_id, n),
 w AS (SELECT a.*, (SELECT arg_max(struct_pack(along_m := b.along_m, lon := b.lon, lat := b.lat), b.pos) FROM b_along b WHERE b.trace_id = a.trace_id AND b.along_m <= a.k) AS lo,
 (SELECT arg_min(struct_pack(along_m := b.along_m, lon := b.lon, lat := b.lat), b.pos) FROM b_along b WHERE b.trace_id = a.trace_id AND b.along_m >= a.k) AS hi FROM a)""",
    )
)
def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = bridge.points(spark, sf_dir)
    whole = traces.lengths(points).select("trace_id", F.col("length_m"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("n_quarter"))
    asked = whole.select("trace_id", "n_quarter", (F.col("length_m") * F.col("n_quarter") / 4.0).alias("at_m"))
    found = traces.located(points, asked.select("trace_id", "at_m"))
    return asked.join(found, ["trace_id", "at_m"]).select("trace_id", "n_quarter", r("lon", 8).alias("lon"), r("lat", 8).alias("lat"))


@query(
    view(
        "SELECT trace_id, kind, min(pos) AS first_segment, max(pos) AS last_segment, round(CASE WHEN count(ele) = count(*) THEN max(ele) END, 6) AS nearest_m FROM (SELECT *, sum(CASE WHEN kind = k0 AND pos <= p0 + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY trace_id ORDER BY pos) AS island FROM (SELECT *, lag(kind) OVER w AS k0, lag(pos) OVER w AS p0 FROM g WINDOW w AS (PARTITION BY trace_id ORDER BY pos))) GROUP BY trace_id, kind, island",
        "g AS (SELECT trace_id, pos, ele, CASE WHEN ele IS NULL THEN 'unmatched' ELSE 'disconnected' END AS kind FROM b_trace WHERE ele IS NULL OR ele < 1604e0)",
    )
)
def gap_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps: points without an elevation, and those on low ground."""
    p = bridge.points(spark, sf_dir).where("ele is null or ele < 1604")
    gaps = p.select("trace_id", F.when(F.col("ele").isNull(), "unmatched").otherwise("disconnected").alias("kind"), F.col("pos").alias("first_segment"), F.col("pos").alias("last_segment"), F.col("ele").alias("nearest_m"))
    return traces.coalesced_gaps(gaps).withColumn("nearest_m", r("nearest_m", 6))


# ------------------------------------------------------------------------------ spatial
@query(
    view(
        "SELECT trace_id, pos, p.v, round(2e0 * 6371008.8e0 * asin(sqrt(power(sin(radians(p.lat - t.lat) / 2e0), 2e0) + cos(radians(t.lat)) * cos(radians(p.lat)) * power(sin(radians(p.lon - t.lon) / 2e0), 2e0))), 3) AS distance_m FROM (SELECT t.*, (SELECT arg_min(struct_pack(v := v.v, lon := v.lon, lat := v.lat), struct_pack(d := power(v.lon - t.lon, 2e0) + power(v.lat - t.lat, 2e0), v := v.v)) FROM b_vertex v) AS p FROM b_trace t) t"
    )
)
def nearest_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_vertex(bridge.points(spark, sf_dir), ["trace_id", "pos"], bridge.vertices(spark, sf_dir), 0.01).select("trace_id", "pos", "v", r("distance_m", 3).alias("distance_m"))


_NEAR = """h AS (SELECT trace_id, pos, edge_id, round(hypot2, 4) AS distance_m FROM (SELECT trace_id, pos, edge_id, sqrt(power(hx + dx * t, 2e0) + power(hy + dy * t, 2e0)) AS hypot2 FROM (SELECT *, greatest(0e0, least(1e0, -(hx * dx + hy * dy) / (dx * dx + dy * dy))) AS t FROM (
 SELECT trace_id, pos, edge_id, (lon1 - p.lon) * 111320e0 * cos(radians(p.lat)) AS hx, (lat1 - p.lat) * 110540e0 AS hy, (lon2 - lon1) * 111320e0 * cos(radians(p.lat)) AS dx, (lat2 - lat1) * 110540e0 AS dy FROM b_trace p, b_edge))) WHERE hypot2 <= 900e0)"""


def _near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    segs = stored(bridge.edges(spark, sf_dir).select("edge_id", "lon1", "lat1", "lon2", "lat2", F.lit(0).alias("anchor")), "segments")
    return spatial.nearest_edges(bridge.points(spark, sf_dir), ["trace_id", "pos"], segs, 900.0, k, digits=4)


@query(view("SELECT trace_id, pos, arg_min(edge_id, struct_pack(d := distance_m, e := edge_id)) AS edge_id, round(min(distance_m), 4) AS distance_m FROM h GROUP BY ALL", _NEAR))
def nearest_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 1).select("trace_id", "pos", "edge_id", r("distance_m", 4).alias("distance_m"))


@query(view("SELECT trace_id, pos, rank::INT AS rank, edge_id, round(distance_m, 4) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, pos ORDER BY distance_m, edge_id) AS rank FROM h) WHERE rank <= 3", _NEAR))
def k_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 3).select("trace_id", "pos", "rank", "edge_id", r("distance_m", 4).alias("distance_m"))


RING = [(-104.995, 40.003), (-104.965, 40.008), (-104.958, 40.031), (-104.981, 40.022), (-104.992, 40.035)]


def _ring_sql() -> str:
    """1 where a point is inside: crossings of the ring's edges, counted."""
    out = []
    for (px, py), (qx, qy) in zip(RING, [RING[-1], *RING]):
        out.append(f"CASE WHEN (({num(py)} > lat) <> ({num(qy)} > lat)) AND lon < {num(px)} + ({num(qx)} - {num(px)}) * ((lat - {num(py)}) / ({num(qy)} - {num(py)})) THEN 1 ELSE 0 END")
    return "(" + " + ".join(out) + ") % 2 = 1"


def _ring(spark: SparkSession) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in RING])
    return spark.range(1).select(F.lit(1).alias("ring_id"), ring.alias("ring"))


@query(view(f"SELECT trace_id, pos, 1 AS ring_id FROM b_trace WHERE {_ring_sql()}"))
def point_in_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.points_in_rings(bridge.points(spark, sf_dir).select("trace_id", "pos", "lon", "lat"), _ring(spark), 0.01).select("trace_id", "pos", "ring_id")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.edges(spark, sf_dir).select(F.col("edge_id").alias("seg_id"), "lon1", "lat1", "lon2", "lat2")


@query(
    view(
        "SELECT a, b, round(greatest(0e0, least(1e0, t)), 6) AS t, round(greatest(0e0, least(1e0, u)), 6) AS u FROM (SELECT *, (qx * sy - qy * sx) / det AS t, (qx * ry - qy * rx) / det AS u FROM (SELECT *, rx * sy - ry * sx AS det FROM x) WHERE abs(det) >= 1e-14) WHERE t BETWEEN -1e-9 AND 1.000000001e0 AND u BETWEEN -1e-9 AND 1.000000001e0",
        "x AS (SELECT a.edge_id AS a, b.edge_id AS b, a.lon2 - a.lon1 AS rx, a.lat2 - a.lat1 AS ry, b.lon2 - b.lon1 AS sx, b.lat2 - b.lat1 AS sy, b.lon1 - a.lon1 AS qx, b.lat1 - a.lat1 AS qy FROM b_edge a JOIN b_edge b ON a.edge_id < b.edge_id)",
    )
)
def segment_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.crossings(_segments(spark, sf_dir), 0.01).select("a", "b", r("t", 6).alias("t"), r("u", 6).alias("u"))


_CROSSED = """x AS (SELECT a.edge_id AS a, b.edge_id AS b, a.lon2 - a.lon1 AS rx, a.lat2 - a.lat1 AS ry, b.lon2 - b.lon1 AS sx, b.lat2 - b.lat1 AS sy, b.lon1 - a.lon1 AS qx, b.lat1 - a.lat1 AS qy FROM b_edge a JOIN b_edge b ON a.edge_id < b.edge_id),
y AS (SELECT a, b, (qx * sy - qy * sx) / det AS t, (qx * ry - qy * rx) / det AS u FROM (SELECT *, rx * sy - ry * sx AS det FROM x) WHERE abs(det) >= 1e-14),
z AS (SELECT a AS draft_id, t FROM y WHERE u BETWEEN -1e-9 AND 1.000000001e0 UNION ALL SELECT b, u FROM y WHERE t BETWEEN -1e-9 AND 1.000000001e0)"""


@query(view("SELECT e.edge_id AS draft_id, 1 + count(DISTINCT round(z.t, 7)) AS n_edges, round(min(e.m), 2) AS m FROM b_edge e LEFT JOIN z ON z.draft_id = e.edge_id AND z.t > 1e-8 AND z.t < 0.99999999e0 GROUP BY e.edge_id", _CROSSED))
def graph_split_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network's edges as planar drafts: how many edges each becomes, and their metres."""
    e = bridge.edges(spark, sf_dir)
    point = lambda k: F.struct(F.col(f"lon{k}").alias("lon"), F.col(f"lat{k}").alias("lat"), F.lit(None).cast("double").alias("ele"))
    text = {k: F.lit(v) for k, v in {"policy": "planar", "kind": "path", "claim": "surveyed", "standing": "unknown", "marking": "unknown", "terrain": "trail", "access": "open"}.items()}
    none = F.lit(None).cast("string")
    drafts = e.select(F.col("edge_id").alias("draft_id"), F.array(point(1), point(2)).alias("line"), none.alias("key_a"), none.alias("key_b"), F.lit(0.9).alias("confidence"), *[v.alias(k) for k, v in text.items()])
    made = build.built(drafts)[1]
    return made.groupBy("draft_id").agg(F.count("*").alias("n_edges"), r(F.sum("m"), 2).alias("m"))


RECTS = [(-104.996, 40.004, -104.970, 40.030), (-104.975, 40.020, -104.950, 40.046)]


@query()
def clip_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = spark.createDataFrame(RECTS, "west double, south double, east double, north double")
    return spatial.clipped(_segments(spark, sf_dir), rects).select("seg_id", "part", r("t0", 9).alias("t0"), r("t1", 9).alias("t1"))


SHIFT = 0.00005
def _shifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The network's segments as the canonical ones, and the same a few metres away."""
    same = _segments(spark, sf_dir).withColumns({"kind": F.lit("path"), "claim": F.lit("surveyed")})
    moved = same.withColumns({"seg_id": F.col("seg_id") + 100_000, "lat1": F.col("lat1") + SHIFT, "lat2": F.col("lat2") + SHIFT})
    return moved, same


_PAIRS = f"""pr AS (SELECT d.edge_id + 100000 AS seg_id, c.edge_id AS twin, (c.lon2 - c.lon1) * 111320e0 * cos(radians((d.lat1 + d.lat2) / 2e0 + {num(SHIFT)})) AS vx, (c.lat2 - c.lat1) * 111320e0 AS vy,
 ((d.lon1 + d.lon2) / 2e0 - c.lon1) * 111320e0 * cos(radians((d.lat1 + d.lat2) / 2e0 + {num(SHIFT)})) AS wx, ((d.lat1 + d.lat2) / 2e0 + {num(SHIFT)} - c.lat1) * 111320e0 AS wy,
 cos(radians((d.lat1 + d.lat2 + c.lat1 + c.lat2 + {num(2 * SHIFT)}) * 0.25e0)) AS k, d.lon2 - d.lon1 AS ax, d.lat2 - d.lat1 AS ay, c.lon2 - c.lon1 AS bx, c.lat2 - c.lat1 AS bt FROM b_edge d, b_edge c),
pt AS (SELECT *, (vx * wx + vy * wy) / (vx * vx + vy * vy) AS t FROM pr),
pf AS (SELECT seg_id, twin, sqrt(power(wx - t * vx, 2e0) + power(wy - t * vy, 2e0)) AS far FROM pt WHERE t BETWEEN 0e0 AND 1e0 AND abs(ax * k * bx * k + ay * bt) / (sqrt(power(ax * k, 2e0) + ay * ay) * sqrt(power(bx * k, 2e0) + bt * bt)) >= 0.94e0),
tw AS (SELECT seg_id, arg_min(twin, struct_pack(far := round(far, 6), twin := twin)) AS twin, min(far) AS far FROM pf WHERE far <= 8e0 GROUP BY seg_id)"""


@query(view("SELECT seg_id, twin, round(far, 4) AS separation_m FROM tw", _PAIRS))
def parallel_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved, same = _shifted(spark, sf_dir)
    return spatial.parallels(moved, same, 0.01).select("seg_id", "twin", r("separation_m", 4).alias("separation_m"))


@query(view("SELECT edge_id AS seg_id, 0 AS precedence FROM b_edge UNION ALL SELECT edge_id + 100000, 10 FROM b_edge WHERE edge_id + 100000 NOT IN (SELECT seg_id FROM tw)", _PAIRS))
def conflate_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved, same = _shifted(spark, sf_dir)
    both = same.withColumn("precedence", F.lit(0)).unionByName(moved.withColumn("precedence", F.lit(10)))
    return network.conflated(both, 0.01)[0].select("seg_id", "precedence")


# -------------------------------------------------------------------------------- graph
AVERSION = 2.0


def _known_sql(cost: str = "m", rounds: int = 12) -> str:
    """dist (source, v, d, edges): least costs between all vertices, by rounds."""
    out = [f"c_way AS (SELECT edge_id, a AS from_v, b AS to_v, {cost} AS c FROM b_edge UNION ALL SELECT edge_id, b, a, {cost} FROM b_edge)", "d0 AS (SELECT v AS source, v, 0e0 AS d, [] AS edges FROM b_vertex)"]
    for i in range(rounds):
        out.append(f"d{i + 1} AS (SELECT source, v, min(d) AS d, arg_min(edges, d) AS edges FROM (SELECT * FROM d{i} UNION ALL SELECT source, to_v, d + c, list_append(edges, edge_id) FROM d{i} JOIN c_way ON from_v = v) GROUP BY ALL)")
    return ", ".join([*out, f"dist AS (SELECT * FROM d{rounds})"])


def _known(spark: SparkSession, sf_dir: str, most: float | None = None) -> DataFrame:
    sources = bridge.vertices(spark, sf_dir).select(F.col("v").alias("source"), "v")
    return graph.distances(graph.directed(bridge.edges(spark, sf_dir)), sources, most)


@query(view("SELECT source, v AS \"end\", round(d, 3) AS dist, array_to_string(edges, '-') AS edges FROM dist", _known_sql(f"m * (1e0 + {num(AVERSION)} * road)")))
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-cost paths with their edges between all pairs of vertices, averse to roads."""
    step = graph.steps(graph.directed(bridge.edges(spark, sf_dir), AVERSION))
    v = bridge.vertices(spark, sf_dir).select("v")
    known = graph.reached(step, v.select(F.col("v").alias("source"), "v"))
    found = graph.paths(known, step, known.select("source", F.col("v").alias("end")))
    return found.select("source", "end", r("dist", 3).alias("dist"), F.array_join(F.col("edges").cast("array<string>"), "-").alias("edges"))


@query()
def shortest_path_with_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where turns between two edges whose ids sum to a multiple of five are banned."""
    ways = graph.directed(bridge.edges(spark, sf_dir), AVERSION)
    step = graph.steps(ways, graph.turns(ways).where("(from_edge + to_edge) % 5 = 0"))
    v = bridge.vertices(spark, sf_dir).select("v")
    known = graph.reached(step, v.select(F.col("v").alias("source"), "v"))
    found = graph.paths(known, step, known.select("source", F.col("v").alias("end")))
    return found.select("source", "end", r("dist", 3).alias("dist"), F.array_join(F.col("edges").cast("array<string>"), "-").alias("edges"))


@query(view("SELECT source, v, round(d, 3) AS dist FROM dist WHERE d <= 3000e0", _known_sql()))
def radial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir, 3000.0).select("source", "v", r("dist", 3).alias("dist"))


@query(view("SELECT source, v, round(2e0 * d, 3) AS there_and_back FROM dist WHERE v <> source AND 2e0 * d BETWEEN 5000e0 AND 8000e0", _known_sql()))
def out_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.out_and_back(_known(spark, sf_dir), 5000.0, 8000.0).select("source", "v", r("there_and_back", 3).alias("there_and_back"))


@query(
    view(
        "SELECT source, ring::INT AS ring, sector, arg_min(v, struct_pack(o := round(abs(d - (750e0 / 2e0 + (6000e0 - 750e0 / 2e0) * (ring + 0.5e0) / 12e0)), 6), v := v)) AS v FROM (SELECT x.source, x.v, d, least(CAST(floor((atan2(p.lat - h.lat, (p.lon - h.lon) * cos(radians(h.lat))) + pi()) / (2e0 * pi()) * 16e0) AS INT), 15) AS sector FROM dist x JOIN b_vertex p ON p.v = x.v JOIN b_vertex h ON h.v = x.source WHERE x.v <> x.source) z, range(0, 12) t(ring) GROUP BY ALL",
        _known_sql(),
    )
)
def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _known(spark, sf_dir).withColumn("dist", r("dist", 6))
    return graph.landmarks(known, bridge.vertices(spark, sf_dir), 12_000.0)


_LOOP3 = "SELECT a.from_v AS start, [a.edge_id, b.edge_id, c.edge_id]::BIGINT[] AS edges, a.m + b.m + c.m AS m FROM b_way a JOIN b_way b ON b.from_v = a.to_v JOIN b_way c ON c.from_v = b.to_v WHERE c.to_v = a.from_v AND b.to_v <> a.from_v AND a.edge_id < c.edge_id"
_LOOP4 = "SELECT a.from_v, [a.edge_id, b.edge_id, c.edge_id, e.edge_id]::BIGINT[], a.m + b.m + c.m + e.m FROM b_way a JOIN b_way b ON b.from_v = a.to_v JOIN b_way c ON c.from_v = b.to_v JOIN b_way e ON e.from_v = c.to_v WHERE e.to_v = a.from_v AND b.to_v <> a.from_v AND c.to_v NOT IN (a.from_v, a.to_v) AND a.edge_id < e.edge_id"


@query(view(f"SELECT start, array_to_string(edges, '-') AS edges, round(m, 3) AS m FROM ({_LOOP3} UNION ALL {_LOOP4}) WHERE m BETWEEN 3000e0 AND 6000e0"))
def exact_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = bridge.vertices(spark, sf_dir).select("v")
    found = graph.loops(graph.directed(bridge.edges(spark, sf_dir)), starts, 4, 3000.0, 6000.0)
    return found.select("start", F.array_join(F.col("edges").cast("array<string>"), "-").alias("edges"), r("m", 3).alias("m"))


@query(
    view(
        "SELECT route_id, seq, edge_id FROM (SELECT *, lag(edge_id) OVER (PARTITION BY route_id ORDER BY seq) AS prev FROM b_leg) WHERE prev IS NULL OR (prev + edge_id) % 7 <> 0 OR prev = edge_id",
    )
)
def turn_legal_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = bridge.legs(spark, sf_dir)
    # Banned: turns between two edges whose ids sum to a multiple of seven.  The turns of 25
    # vertices are few at any scale and go to every task, so that routes stay where they are.
    bans = graph.turns(legs.select("edge_id", "from_v", "to_v").distinct()).where("(from_edge + to_edge) % 7 = 0")
    return graph.legal_legs(legs, F.broadcast(bans.distinct())).select("route_id", "seq", "edge_id")


@query(view("SELECT edge_id, count(DISTINCT route_id) AS n_sources, round(ln(1e0 + count(DISTINCT route_id)), 6) AS popularity FROM b_leg GROUP BY edge_id"))
def seed_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = bridge.legs(spark, sf_dir).select("edge_id", F.col("route_id").alias("source"))
    return graph.seed_popularity(uses).withColumn("popularity", r("popularity", 6))


# ------------------------------------------------------------------- overlays, calendar
@query("SELECT o_orderkey, o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND (month(o_orderdate) * 100 + day(o_orderdate) >= 1101 OR month(o_orderdate) * 100 + day(o_orderdate) <= 315) AND isodow(o_orderdate) >= 6 AND ((o_orderkey % 24) * 60 >= 1320 OR (o_orderkey % 24) * 60 <= 360) AS active FROM orders")
def access_window_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    window = F.struct(F.lit("1995-01-01").cast("date").alias("from"), F.lit("1996-12-31").cast("date").alias("to"), F.lit(1101).alias("season_from"), F.lit(315).alias("season_to"), F.lit(96).alias("weekdays"), F.lit("22:00").alias("time_from"), F.lit("06:00").alias("time_to"))
    time = F.format_string("%02d:00", (F.col("o_orderkey") % 24).cast("int"))
    return o.select("o_orderkey", calendar.active(F.col("o_orderdate").cast("date"), time, window).alias("active"))


@query("SELECT o_orderkey, (month(o_orderdate) * 100 + day(o_orderdate) >= 1215 OR month(o_orderdate) * 100 + day(o_orderdate) <= 401) AS winter, month(o_orderdate) * 100 + day(o_orderdate) BETWEEN 301 AND 630 AS spring FROM orders")
def seasonal_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", calendar.in_season(d, F.lit(1215), F.lit(401)).alias("winter"), calendar.in_season(d, F.lit(301), F.lit(630)).alias("spring"))


# Sets of weekdays as text, and their bits from Monday on.
WEEKDAY_TEXTS = [("daily", 127), ("Mon-Fri", 31), ("weekends", 96), ("fri-mon", 113), ("Tuesday; thu", 10), ("sat,sun,wed", 100), ("none", 0)]


@query("SELECT c_custkey, CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN {bits}" for i, (_, bits) in enumerate(WEEKDAY_TEXTS)) + " END AS bits FROM customer")
def weekday_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*[F.lit(t) for t, _ in WEEKDAY_TEXTS]), (F.col("c_custkey") % 7).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", calendar.weekday_bits(text).alias("bits"))


def _cross_sql(ax: str, ay: str, bx: str, by: str, cx: str, cy: str, dx: str, dy: str) -> str:
    o = lambda px, py, qx, qy, sx, sy: f"(({qx} - {px}) * ({sy} - {py}) - ({qy} - {py}) * ({sx} - {px}))"
    return f"((({o(ax, ay, bx, by, cx, cy)} > 0) <> ({o(ax, ay, bx, by, dx, dy)} > 0)) AND (({o(cx, cy, dx, dy, ax, ay)} > 0) <> ({o(cx, cy, dx, dy, bx, by)} > 0)))"


_MEETS = " OR ".join([f"({_ring_sql().replace('lon', 'lon1').replace('lat', 'lat1')})", f"({_ring_sql().replace('lon', 'lon2').replace('lat', 'lat2')})", *[_cross_sql("lon1", "lat1", "lon2", "lat2", num(p[0]), num(p[1]), num(q[0]), num(q[1])) for p, q in zip(RING, [RING[-1], *RING])]])


@query(view(f"SELECT edge_id, CASE WHEN {_MEETS} THEN 'closed' ELSE 'open' END AS access, CASE WHEN {_MEETS} THEN 2 ELSE 0 END AS n_overlays FROM b_edge"))
def access_overlay_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlays over one ring: restricted, then closed."""
    e = bridge.edges(spark, sf_dir)
    line = F.array(F.struct(F.col("lon1").alias("lon"), F.col("lat1").alias("lat")), F.struct(F.col("lon2").alias("lon"), F.col("lat2").alias("lat")))
    e = e.select("edge_id", "access", "travel", F.lit(0.75).alias("confidence"), F.lit(0.5).alias("access_confidence"), line.alias("line"))
    window = F.expr("named_struct('from', cast(null as date), 'to', cast(null as date), 'season_from', cast(null as int), 'season_to', cast(null as int), 'weekdays', 0, 'time_from', cast(null as string), 'time_to', cast(null as string))")
    two = spark.createDataFrame([(1, "restricted"), (2, "closed")], "pos int, access string")
    over = two.crossJoin(_ring(spark)).select("pos", "access", F.lit(None).cast("string").alias("travel"), F.lit(0.9).alias("confidence"), F.col("ring").alias("geometry"), F.lit(True).alias("is_ring"), F.lit(20.0).alias("tolerance_m"), window.alias("window"))
    return overlays.with_access(e, overlays.touching(e, over, 0.01), over).select("edge_id", "access", F.col("n_overlays").cast("int").alias("n_overlays"))


# ------------------------------------------------------------------------- CRS and tiles
@query(view("SELECT v, round(6378137e0 * radians(lon), 3) AS x, round(6378137e0 * ln(tan(pi() / 4e0 + radians(lat) / 2e0)), 3) AS y, round(lon, 9) AS lon, round(lat, 9) AS lat FROM b_vertex"))
def mercator_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = crs.to_mercator(F.col("lon"), F.col("lat"))
    lon, lat = crs.from_mercator(F.col("x"), F.col("y"))
    v = bridge.vertices(spark, sf_dir).select("v", x.alias("x"), y.alias("y"))
    return v.select("v", r("x", 3).alias("x"), r("y", 3).alias("y"), r(lon, 9).alias("lon"), r(lat, 9).alias("lat"))


def _utm_sql() -> str:
    a, e2, ep2 = crs._constants("wgs84")
    m = f"{num(a)} * ({num(1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)} * phi - {num(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024)} * sin(2e0 * phi) + {num(15 * e2**2 / 256 + 45 * e2**3 / 1024)} * sin(4e0 * phi) - {num(35 * e2**3 / 3072)} * sin(6e0 * phi))"
    return view(
        f"""SELECT trace_id, pos, round(500000e0 + 0.9996e0 * n * (x + (1e0 - t + c) * power(x, 3e0) / 6e0 + (5e0 - 18e0 * t + t * t + 72e0 * c - 58e0 * {num(ep2)}) * power(x, 5e0) / 120e0), 3) AS easting,
 round(0.9996e0 * ({m} + n * tan(phi) * (x * x / 2e0 + (5e0 - t + 9e0 * c + 4e0 * c * c) * power(x, 4e0) / 24e0 + (61e0 - 58e0 * t + t * t + 600e0 * c - 330e0 * {num(ep2)}) * power(x, 6e0) / 720e0)), 3) AS northing
 FROM (SELECT *, {num(a)} / sqrt(1e0 - {num(e2)} * power(sin(phi), 2e0)) AS n, power(tan(phi), 2e0) AS t, {num(ep2)} * power(cos(phi), 2e0) AS c, cos(phi) * (radians(lon) - radians(-105e0)) AS x FROM (SELECT trace_id, pos, lon, radians(lat) AS phi FROM b_trace))"""
    )


@query(_utm_sql())
def utm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north = crs.to_utm(F.col("lon"), F.col("lat"), 13)
    return bridge.points(spark, sf_dir).select("trace_id", "pos", r(east, 3).alias("easting"), r(north, 3).alias("northing"))


@query(view("SELECT CAST(floor((lon + 180e0) / 360e0 * 16384e0) AS INT) AS x, CAST(floor((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * 16384e0) AS INT) AS y, count(*) AS n_points FROM b_trace GROUP BY ALL"))
def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = crs.tile(F.col("lon"), F.col("lat"), F.lit(14))
    return bridge.points(spark, sf_dir).groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n_points"))


# ---------------------------------------------------------------------------- elevation
GRID = dict(west=-105.006, south=39.994, size=0.012, ncols=5, nrows=5)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = bridge.vertices(spark, sf_dir)
    return v.select((4 - F.floor(F.col("v") / 5)).cast("int").alias("row"), (F.col("v") % 5).cast("int").alias("col"), F.col("ele").alias("z"))


@query(
    view(
        "SELECT trace_id, pos, round(a.ele * (1e0 - tx) * (1e0 - ty) + b.ele * tx * (1e0 - ty) + c.ele * (1e0 - tx) * ty + d.ele * tx * ty, 4) AS ele FROM q JOIN b_vertex a ON a.v = (4 - floor(y)) * 5 + floor(x) JOIN b_vertex b ON b.v = (4 - floor(y)) * 5 + ceil(x) JOIN b_vertex c ON c.v = (4 - ceil(y)) * 5 + floor(x) JOIN b_vertex d ON d.v = (4 - ceil(y)) * 5 + ceil(x)",
        "g AS (SELECT trace_id, pos, least(greatest((lon + 105.006e0) / 0.012e0 - 0.5e0, 0e0), 4e0) AS x, least(greatest((39.994e0 + 5e0 * 0.012e0 - lat) / 0.012e0 - 0.5e0, 0e0), 4e0) AS y FROM b_trace WHERE lon BETWEEN -105.006e0 AND -104.946e0 AND lat BETWEEN 39.994e0 AND 40.054e0), q AS (SELECT *, x - floor(x) AS tx, y - floor(y) AS ty FROM g)",
    )
)
def dem_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bridge.points(spark, sf_dir).select("trace_id", "pos", "lon", "lat")
    return enrich.sampled(p, ["trace_id", "pos"], _cells(spark, sf_dir), **GRID).where("ele is not null").select("trace_id", "pos", r("ele", 4).alias("ele"))


@query()
def contour_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.contours(_cells(spark, sf_dir), 100.0)


@query(view("SELECT edge_id, seq, route_id, CASE WHEN road >= 0.75e0 THEN 'road' WHEN abs(grade) >= 0.32e0 THEN 'scramble' WHEN abs(grade) >= 0.22e0 THEN 'talus' ELSE 'trail' END AS terrain FROM b_leg"))
def terrain_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = enrich.inferred_terrain(F.lit("unknown"), F.lit(0.0), F.col("road"), F.abs("grade"), F.lit("path"))
    return bridge.legs(spark, sf_dir).select("edge_id", "seq", "route_id", t["terrain"].alias("terrain"))


# ------------------------------------------------------------- tags, sources, merges
# Raw tags as sources spell them.
TAGS = [" Path ", "SERVICE", "footway", "living_street", "Cross-Country", "asphalt", "Scree", "woods", "permit", "YES", "private", "-1", "zebra", "official", "42", "Open Water", "river", "proxy", ""]


def _case(vocabulary: tuple[str | None, dict[str, list[str]]]) -> str:
    default, terms = vocabulary
    whens = " ".join(f"WHEN lower(trim(tag)) IN ({', '.join(repr(k) for k in keys)}) THEN '{term}'" for term, keys in terms.items())
    return f"CASE {whens} ELSE {'NULL' if default is None else repr(default)} END"


VOCABULARIES = {"way_kind": vocab.WAY_KIND, "terrain": vocab.TERRAIN, "access": vocab.ACCESS, "travel": vocab.TRAVEL, "crossing": vocab.CROSSING_CONTROL, "standing": vocab.TRAIL_STANDING, "marking": vocab.TRAIL_MARKING, "realm": vocab.WAY_REALM, "claim": vocab.GEOMETRY_CLAIM, "crossing_kind": vocab.CROSSING_KIND}


@query(f"SELECT p_partkey, {', '.join(f'{_case(v)} AS {n}' for n, v in VOCABULARIES.items())} FROM (SELECT p_partkey, [{', '.join(repr(t) for t in TAGS)}][p_partkey % {len(TAGS)} + 1] AS tag FROM part)")
def tag_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.get(F.array(*[F.lit(t) for t in TAGS]), (F.col("p_partkey") % len(TAGS)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", *[vocab.from_tag(tag, v).alias(n) for n, v in VOCABULARIES.items()])


@query("SELECT type, id, version, body FROM (SELECT l_returnflag AS type, l_orderkey AS id, l_linenumber AS version, l_partkey::VARCHAR AS body, row_number() OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY l_linenumber DESC, l_partkey::VARCHAR DESC) AS k FROM lineitem) WHERE k = 1")
def shard_merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("version"), F.col("l_partkey").cast("string").alias("body"))
    return network.newest(rows)


@query("SELECT c_mktsegment AS provider, c_custkey AS region FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey AND s_nationkey % 3 = c_nationkey % 3)")
def receipt_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1).alias("schema")
    wanted = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("provider"), F.col("c_custkey").alias("region"), one, (F.col("c_nationkey") % 3).alias("revision"), F.lit("all").alias("request"))
    got = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("region"), one, (F.col("s_nationkey") % 3).alias("revision"), F.lit("all").alias("request"), F.sha2("s_name", 256).alias("content_sha256"))
    receipts = wanted.select("provider", "region").join(got, "region")
    return network.missing_receipts(wanted, receipts)


PATHS = ["seed/route-1.gpx", "a/track.json", "x/closure.geojson", "x/roads.geojson", "x/net.geojson", "x/streams.osm", "x/region.osm.pbf", "dem/a.asc", "dem/b.tif", "s/ownership.shp", "s/landcover.shp", "notes.txt"]
# What these paths are.
ADAPTERS = ["gpx-route", "json-route", "geojson-closure-overlay", "geojson-road-context", "geojson-network", "osm-hydrology-context", "osm-pbf-network", "arc-ascii-elevation", "geotiff-elevation", "shapefile-access-overlay", "shapefile-terrain-overlay", None]


@query(f"SELECT p_partkey, CASE p_partkey % {len(PATHS)} " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ADAPTERS) if a) + " END AS adapter FROM part")
def file_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.get(F.array(*[F.lit(p) for p in PATHS]), (F.col("p_partkey") % len(PATHS)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", classified(path)["adapter"].alias("adapter"))


@query(view("SELECT route_id, 'shape ' || shape || '; distance ' || printf('%.2f', distance_m / 1000e0) || ' km; legs ' || n_legs AS summary, n_legs > 0 AS walked FROM m JOIN s USING (route_id)", ", ".join([METRICS, SHAPES])))
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginning of each route's one-line account, and whether it has legs."""
    m = _measured(spark, sf_dir)
    text = F.substring_index(walks.summary(), "; ascent", 1)
    return m.select("route_id", F.concat(text, F.lit("; legs "), F.col("n_legs").cast("string")).alias("summary"), (F.col("n_legs") > 0).alias("walked"))


@query(view("SELECT route_id, arg_max(to_v, seq) AS end_v, count(*) AS n_legs FROM b_leg GROUP BY route_id HAVING NOT bool_or(edge_id % 11 = 0 AND from_v > to_v)"))
def walk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes as walks over their edges, of which some may only be walked to the larger end."""
    legs = bridge.legs(spark, sf_dir)
    one_way = F.when(F.col("edge_id") % 11 == 0, "forward").otherwise("both").alias("travel")
    edges = legs.select("edge_id", F.least("from_v", "to_v").alias("a"), F.greatest("from_v", "to_v").alias("b"), one_way, F.lit("open").alias("access")).distinct()
    steps = F.transform(F.array_sort(F.collect_list(F.struct("seq", "edge_id"))), lambda x: x["edge_id"])
    routes_ = legs.groupBy(F.col("route_id").alias("walk_id")).agg(F.min("start_v").alias("start_v"), steps.alias("edges"))
    bans = edges.limit(0).select(F.col("edge_id").alias("from_edge"), F.col("a").alias("via_v"), F.col("edge_id").alias("to_edge"))
    # The edges of 25 vertices are few at any scale and go to every task.
    return walks.walked(routes_, F.broadcast(edges), bans).select(F.col("walk_id").alias("route_id"), "end_v", F.size("legs").cast("long").alias("n_legs"))


@query(view("SELECT kind, value, count(*) AS n FROM (SELECT 'terrain' AS kind, terrain AS value FROM b_leg UNION ALL SELECT 'access', access FROM b_leg) GROUP BY ALL"))
def leg_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.inventory(bridge.legs(spark, sf_dir), "terrain", "access")


@query(view("SELECT DISTINCT edge_id, substr(sha256(printf('trail-region-v1:%.8f:%.8f:%.8f:%.8f', least(lon1, lon2), least(lat1, lat2), greatest(lon1, lon2), greatest(lat1, lat2))), 1, 24) AS region, lon1 <> lon2 AND lat1 <> lat2 AS valid FROM b_edge"))
def region_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge's box as a region: its key, and whether it is one of some area."""
    e = bridge.edges(spark, sf_dir)
    box = [F.least("lon1", "lon2"), F.least("lat1", "lat2"), F.greatest("lon1", "lon2"), F.greatest("lat1", "lat2")]
    return e.select("edge_id", identity.region_key(*box).alias("region"), identity.region_valid(*box, 1.0).alias("valid"))


# -------------------------------------------------------------------------------- sinks
@query()
def gpx_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.gpx(bridge.points(spark, sf_dir), "trace_id")


@query(view("SELECT v, 'POINT Z (' || lon::VARCHAR || ' ' || lat::VARCHAR || ' ' || ele::VARCHAR || ')' AS wkt FROM b_vertex"))
def wkt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.vertices(spark, sf_dir).select("v", sinks.wkt_point(F.col("lon"), F.col("lat"), F.col("ele")).alias("wkt"))


# ------------------------------------------------------------------------------- map matching
SNAP_M = 150.0


def _oneway_sql() -> str:
    return "e AS (SELECT *, CASE edge_id % 5 WHEN 0 THEN 'forward' WHEN 1 THEN 'backward' ELSE 'both' END AS travel FROM b_edge), w AS (SELECT edge_id, a AS f, b AS t, m FROM e WHERE travel <> 'backward' UNION ALL SELECT edge_id, b, a, m FROM e WHERE travel <> 'forward')"


def _oneway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridge's edges as lines, some of them one-way."""
    point = lambda k: F.struct(F.col(f"lon{k}").alias("lon"), F.col(f"lat{k}").alias("lat"), F.lit(None).cast("double").alias("ele"))
    rule = F.when(F.col("edge_id") % 5 == 0, "forward").when(F.col("edge_id") % 5 == 1, "backward").otherwise("both")
    return bridge.edges(spark, sf_dir).select("edge_id", "a", "b", "m", rule.alias("travel"), F.array(point(1), point(2)).alias("line"))


def _projection_sql(name: str, source: str, x: str, y: str, keep: str) -> str:
    """name (keep, edge_id, d, t): each point of source on each edge."""
    inner = f"SELECT {keep}, edge_id, (lon1 - {x}) * 111320e0 * cos(radians({y})) AS hx, (lat1 - {y}) * 110540e0 AS hy, (lon2 - lon1) * 111320e0 * cos(radians({y})) AS dx, (lat2 - lat1) * 110540e0 AS dy FROM {source}"
    return f"{name} AS (SELECT {keep}, edge_id, round(sqrt(power(hx + dx * t, 2e0) + power(hy + dy * t, 2e0)), 6) AS d, t FROM (SELECT *, greatest(0e0, least(1e0, -(hx * dx + hy * dy) / (dx * dx + dy * dy))) AS t FROM ({inner})))"


def _ways_sql(name: str, asked: str, rounds: int = 14) -> str:
    """name (start_v, target, entry, d, edges): least ways of asked (start_v, target, entry, most)."""
    out = [f"{name}0 AS (SELECT start_v, target, entry, max(most) AS most, start_v AS v, 0e0 AS d, []::BIGINT[] AS edges FROM {asked} GROUP BY ALL)"]
    for i in range(rounds):
        out.append(f"{name}{i + 1} AS (SELECT start_v, target, entry, any_value(most) AS most, v, min(d) AS d, arg_min(edges, struct_pack(d := d, n := len(edges), e := edges)) AS edges FROM (SELECT * FROM {name}{i} UNION ALL SELECT start_v, target, entry, most, t, d + m, list_append(edges, edge_id) FROM {name}{i} JOIN w ON f = v AND edge_id <> target WHERE d + m <= most) GROUP BY start_v, target, entry, v)")
    return ", ".join([*out, f"{name} AS (SELECT start_v, target, entry, d, edges FROM {name}{rounds} WHERE v = entry)"])


_HAV = "2e0 * 6371008.8e0 * asin(sqrt(power(sin(radians(y2 - y1) / 2e0), 2e0) + cos(radians(y1)) * cos(radians(y2)) * power(sin(radians(x2 - x1) / 2e0), 2e0)))"
_ANCHORS = ", ".join(
    [
        _oneway_sql(),
        "sg AS (SELECT * FROM (SELECT trace_id, pos - 1 AS seg, lon AS x1, lat AS y1, lead(lon) OVER (PARTITION BY trace_id ORDER BY pos) AS x2, lead(lat) OVER (PARTITION BY trace_id ORDER BY pos) AS y2 FROM b_trace) WHERE x2 IS NOT NULL)",
        _projection_sql("pd", "(SELECT trace_id, seg, x1 + (x2 - x1) * 0.5e0 AS mx, y1 + (y2 - y1) * 0.5e0 AS my FROM sg), e", "mx", "my", "trace_id, seg"),
        "nr AS (SELECT trace_id, seg, arg_min(edge_id, struct_pack(d := d, e := edge_id)) AS edge_id, min(d) AS d FROM pd GROUP BY ALL)",
        f"ch AS (SELECT * FROM (SELECT nr.*, lag(edge_id) OVER (PARTITION BY trace_id ORDER BY seg) AS was FROM nr WHERE d <= {num(SNAP_M)}) WHERE was IS NULL OR was <> edge_id)",
        _projection_sql("p1", "ch JOIN sg USING (trace_id, seg) JOIN e USING (edge_id)", "x1", "y1", "trace_id, seg"),
        _projection_sql("p2", "ch JOIN sg USING (trace_id, seg) JOIN e USING (edge_id)", "x2", "y2", "trace_id, seg"),
        f"a0 AS (SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY seg) AS n, seg, edge_id, CASE WHEN (p2.t - p1.t) * e.m >= {num(-matching.LEVEL_M)} THEN a ELSE b END AS entry, CASE WHEN (p2.t - p1.t) * e.m >= {num(-matching.LEVEL_M)} THEN b ELSE a END AS leave, travel <> CASE WHEN (p2.t - p1.t) * e.m >= {num(-matching.LEVEL_M)} THEN 'backward' ELSE 'forward' END AS live, greatest(3e0 * {_HAV} + {num(2 * SNAP_M)}, 50e0) AS budget FROM ch JOIN sg USING (trace_id, seg) JOIN p1 USING (trace_id, seg, edge_id) JOIN p2 USING (trace_id, seg, edge_id) JOIN e USING (edge_id))",
    ]
)
_MATCHED = ", ".join(
    [
        _ANCHORS,
        f"sh AS (SELECT x.trace_id, x.n, max(z.n) AS far FROM a0 x JOIN a0 z ON z.trace_id = x.trace_id AND z.edge_id = x.edge_id AND z.entry = x.entry AND z.n >= x.n + 2 WHERE NOT EXISTS (SELECT 1 FROM pd WHERE pd.trace_id = x.trace_id AND pd.edge_id = x.edge_id AND pd.seg BETWEEN x.seg AND z.seg AND pd.d > {num(SNAP_M)}) GROUP BY ALL)",
        "gr AS (SELECT trace_id, 1::BIGINT AS n FROM (SELECT DISTINCT trace_id FROM a0) UNION ALL SELECT gr.trace_id, coalesce(sh.far, gr.n) + 1 FROM gr LEFT JOIN sh ON sh.trace_id = gr.trace_id AND sh.n = gr.n WHERE EXISTS (SELECT 1 FROM a0 WHERE a0.trace_id = gr.trace_id AND a0.n = coalesce(sh.far, gr.n) + 1))",
        "a1 AS (SELECT a0.* FROM a0 JOIN gr USING (trace_id, n))",
        "a2 AS (SELECT *, last_value(CASE WHEN live THEN leave END IGNORE NULLS) OVER p AS here_v, first_value(live) OVER q AS starts, lag(n) OVER q IS NULL AS is_first, lag(edge_id) OVER q AS was_edge, lag(seg) OVER q AS was_seg, lag(budget) OVER q AS was_budget FROM a1 WINDOW p AS (PARTITION BY trace_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY trace_id ORDER BY n))",
        "aq AS (SELECT here_v AS start_v, edge_id AS target, entry, budget AS most FROM a2 WHERE starts AND NOT is_first AND live AND here_v <> entry)",
        _ways_sql("k", "aq"),
        "a3 AS (SELECT a2.*, coalesce(live AND here_v = a2.entry, false) AS direct, k.edges AS way FROM a2 LEFT JOIN k ON k.start_v = here_v AND k.target = edge_id AND k.entry = a2.entry AND k.d <= budget AND starts AND NOT is_first AND live AND here_v <> a2.entry)",
    ]
)
_APART = ", ".join(
    [
        "f0 AS (SELECT trace_id, was_seg, seg, was_edge AS before, edge_id AS after, greatest(budget, was_budget) AS most FROM a3 WHERE starts AND NOT is_first AND NOT direct AND way IS NULL)",
        "f1 AS (SELECT DISTINCT before, after, f0.most, o.t AS start_v, i.f AS entry FROM f0 JOIN w o ON o.edge_id = before JOIN w i ON i.edge_id = after)",
        "fq AS (SELECT start_v, after AS target, entry, most FROM f1)",
        _ways_sql("l", "fq"),
        "f2 AS (SELECT DISTINCT before, after, most FROM f1 LEFT JOIN l ON l.start_v = f1.start_v AND l.target = after AND l.entry = f1.entry WHERE f1.start_v = f1.entry OR l.d <= most)",
        "ap AS (SELECT trace_id, least(was_seg, seg) AS first, greatest(was_seg, seg) AS last, before, after FROM f0 ANTI JOIN f2 USING (before, after, most) UNION ALL SELECT trace_id, seg, seg, edge_id, edge_id FROM a3 WHERE is_first AND NOT live)",
    ]
)


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(view("SELECT trace_id, n::INT AS n, seg::INT AS seg, edge_id, entry, live, round(budget, 3) AS budget_m FROM a0", _ANCHORS))
def map_match_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the nearest edge of each trace's segments changes, and the end that it is entered by."""
    edges = stored(_oneway(spark, sf_dir), "edges")
    seg = stored(matching.trace_segments(bridge.points(spark, sf_dir)), "segments")
    near = spatial.nearest_edge_at_any_distance(matching.middles(seg), ["trace_id", "seg"], matching.edge_segments(edges))
    return matching.anchors(seg, near, edges, SNAP_M).select("trace_id", "n", "seg", "edge_id", "entry", "live", r("budget_m", 3).alias("budget_m"))


def _covered(spark: SparkSession, sf_dir: str) -> matching.Coverage:
    none = spark.createDataFrame([], "from_edge bigint, via_v bigint, to_edge bigint")
    return matching.coverage(stored(bridge.points(spark, sf_dir), "points"), stored(_oneway(spark, sf_dir), "edges"), none, SNAP_M)


@query(
    _recursive(
        view(
            "SELECT trace_id, count(*) AS n_legs, string_agg(edge_id::VARCHAR, '-' ORDER BY n, k) AS edges FROM (SELECT trace_id, n, unnest(range(1, len(s) + 1)) AS k, unnest(s) AS edge_id FROM (SELECT trace_id, n, list_append(CASE WHEN n > z THEN coalesce(way, []::BIGINT[]) ELSE []::BIGINT[] END, edge_id) AS s FROM (SELECT *, coalesce(max(CASE WHEN starts AND NOT is_first AND live AND NOT direct AND way IS NULL THEN n END) OVER (PARTITION BY trace_id), 0) AS z FROM a3) WHERE starts AND live AND n >= z)) GROUP BY trace_id",
            _MATCHED,
        )
    )
)
def map_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that each trace walked, connected by shortest legal ways."""
    legs = _covered(spark, sf_dir).legs.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("seq", "edge_id"))).alias("l"))
    return legs.select("trace_id", F.size("l").cast("bigint").alias("n_legs"), F.concat_ws("-", F.transform("l", lambda x: x["edge_id"].cast("string"))).alias("edges"))


@query(
    _recursive(
        view(
            "SELECT trace_id, kind, min(first)::INT AS first_segment, max(last)::INT AS last_segment, CASE WHEN count(near) = count(*) AND min(near) = max(near) THEN min(near)::VARCHAR END AS nearest_edge, CASE WHEN count(d) = count(*) THEN max(d) END AS nearest_distance_m, arg_min(before, struct_pack(f := first, l := last, b := before, a := after))::VARCHAR AS before_edge, arg_max(after, struct_pack(f := first, l := last, b := before, a := after))::VARCHAR AS after_edge FROM (SELECT *, sum(CASE WHEN first <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY trace_id, run ORDER BY first, last, before, after ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, max(last) OVER (PARTITION BY trace_id, run ORDER BY first, last, before, after ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT *, sum(CASE WHEN kind = was THEN 0 ELSE 1 END) OVER (PARTITION BY trace_id ORDER BY first, last, kind, before, after ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY trace_id ORDER BY first, last, kind, before, after) AS was FROM (SELECT trace_id, 'beyond-network' AS kind, seg AS first, seg AS last, edge_id AS near, d, NULL::BIGINT AS before, NULL::BIGINT AS after FROM nr WHERE d > "
            + num(SNAP_M)
            + " UNION ALL SELECT trace_id, 'disconnected-network', first, last, NULL, NULL, before, after FROM ap))))) GROUP BY trace_id, run, part, kind",
            f"{_MATCHED}, {_APART}",
        )
    )
)
def map_match_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where traces are off the network, and where the network doesn't join what they walked."""
    ids = {k: F.col(k).cast("string") for k in ("nearest_edge", "before_edge", "after_edge")}
    return _covered(spark, sf_dir).gaps.withColumns(ids)


@query(
    _recursive(
        view(
            f"SELECT trace_id, count(*) AS segment_count, sum((d <= {num(SNAP_M)})::BIGINT)::BIGINT AS snapped_segment_count, sum((d > {num(SNAP_M)})::BIGINT)::BIGINT AS rejected_segment_count, coalesce(any_value(c), 0)::BIGINT AS disconnected_transition_count, max(d) AS max_snap_m, round(avg(d), 4) AS mean_snap_m FROM nr LEFT JOIN (SELECT trace_id, count(*) AS c FROM ap GROUP BY ALL) USING (trace_id) GROUP BY trace_id",
            f"{_MATCHED}, {_APART}",
        )
    )
)
def map_match_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir).stats.withColumn("mean_snap_m", r("mean_snap_m", 4))


@query()
def seed_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces as routes: start, end and whether they close."""
    none = spark.createDataFrame([], "from_edge bigint, via_v bigint, to_edge bigint")
    found, _ = matching.seeds(stored(bridge.points(spark, sf_dir), "points"), stored(_oneway(spark, sf_dir), "edges"), none, bridge.vertices(spark, sf_dir), SNAP_M)
    return found.select("trace_id", "start_v", "end_v", "closed_loop", F.size("edges").alias("n_edges"), r("distance_m", 3).alias("distance_m"))


# ------------------------------------------------------------------------------- ways back
RETURN_M, RETURN_AVERSION = 5000.0, 2.0
#: The bridge's edges with lengths of their own, so that no two ways are equally long.
_OWN = "o AS (SELECT edge_id, a AS f, b AS t, m + (edge_id * edge_id % 9973) * 0.001e0 AS m FROM b_edge UNION ALL SELECT edge_id, b, a, m + (edge_id * edge_id % 9973) * 0.001e0 FROM b_edge), ow AS (SELECT o.*, o.m * (1e0 + 2e0 * road) AS c FROM o JOIN b_edge USING (edge_id))"
_JOINED = "array_to_string(edges, '-')"


def _paths_sql(asked: str, most: float, hops: int = 5) -> str:
    """all_paths (q, cost, m, edges): every edge-simple path of asked (q, start_v, was, target)."""
    out = [f"g0 AS (SELECT q, target, start_v AS v, was, 0e0 AS cost, 0e0 AS m, []::BIGINT[] AS edges FROM ({asked}))"]
    for i in range(hops):
        go = "" if i == 0 else "WHERE v <> target"
        out.append(f"g{i + 1} AS (SELECT q, target, t AS v, was, cost + c AS cost, g.m + ow.m AS m, list_append(edges, edge_id) AS edges FROM (SELECT * FROM g{i} {go}) g JOIN ow ON f = v WHERE g.m + ow.m <= {num(most)} AND NOT list_contains(edges, edge_id) AND edge_id IS DISTINCT FROM was)")
    union = " UNION ALL ".join(f"SELECT q, cost, m, edges FROM g{i + 1} WHERE v = target" for i in range(hops))
    return ", ".join([*out, f"all_paths AS ({union})"])


def _own_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = bridge.edges(spark, sf_dir).withColumn("m", F.col("m") + (F.col("edge_id") * F.col("edge_id") % 9973) * 0.001)
    return graph.steps(graph.directed(own, RETURN_AVERSION))


def _asked(rows: DataFrame, most: float) -> DataFrame:
    empty = F.array().cast("array<bigint>")
    return rows.select("q", "start_v", "was", "target", F.lit(most).alias("most_m"), empty.alias("barred"), empty.alias("banned"))


@query(view(f"SELECT q // 100 AS source, q % 100 AS target, round(cost, 3) AS cost, round(m, 3) AS m, {_JOINED} AS edges FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cost, m) AS r FROM all_paths) WHERE r = 1", f"{_OWN}, {_paths_sql('SELECT x.v * 100 + z.v AS q, x.v AS start_v, NULL::BIGINT AS was, z.v AS target FROM b_vertex x, b_vertex z WHERE x.v <> z.v', RETURN_M)}"))
def constrained_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between all pairs of vertices the way of least cost, averse to roads, of at most 5 km."""
    v = bridge.vertices(spark, sf_dir).select("v")
    pairs = v.select(F.col("v").alias("start_v")).join(v.select(F.col("v").alias("target")), F.col("start_v") != F.col("target"))  # 25 vertices at any scale
    asked = _asked(pairs.select((F.col("start_v") * 100 + F.col("target")).alias("q"), "start_v", F.lit(None).cast("bigint").alias("was"), "target"), RETURN_M)
    found = returns.return_paths(_own_steps(spark, sf_dir), None, asked)
    return found.select(F.floor(F.col("q") / 100).cast("bigint").alias("source"), (F.col("q") % 100).alias("target"), r("cost", 3).alias("cost"), r("m", 3).alias("m"), F.array_join(F.col("edges").cast("array<string>"), "-").alias("edges"))


@query(view(f"SELECT q // 100 AS edge_id, q % 100 AS arrived_v, r::INT AS rank, round(cost, 3) AS cost, round(m, 3) AS m, {_JOINED} AS edges FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cost, m) AS r FROM all_paths) WHERE r <= 3", f"{_OWN}, {_paths_sql('SELECT edge_id * 100 + t AS q, t AS start_v, edge_id AS was, f AS target FROM ow', RETURN_M)}"))
def return_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best ways back from the end of each edge to where it was entered, without it."""
    step = _own_steps(spark, sf_dir)
    rows = step.select((F.col("edge_id") * 100 + F.col("to_v")).alias("q"), F.col("to_v").alias("start_v"), F.col("edge_id").alias("was"), F.col("from_v").alias("target"))
    found = returns.return_paths(step, None, _asked(rows, RETURN_M), 3)
    return found.select(F.floor(F.col("q") / 100).cast("bigint").alias("edge_id"), (F.col("q") % 100).alias("arrived_v"), "rank", r("cost", 3).alias("cost"), r("m", 3).alias("m"), F.array_join(F.col("edges").cast("array<string>"), "-").alias("edges"))


@query(view("SELECT v AS target, source AS v, round(d, 3) AS cost FROM dist", _known_sql("m * (1e0 + 2e0 * road)")))
def reverse_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cost from every vertex to every vertex, searched from the ends."""
    step = graph.steps(graph.directed(bridge.edges(spark, sf_dir), RETURN_AVERSION))
    return returns.costs_to(step, bridge.vertices(spark, sf_dir).select(F.col("v").alias("target"))).select("target", "v", r("left", 3).alias("cost"))


def _loops_sql(most: float, hops: int) -> str:
    asked = "SELECT v AS q, v AS start_v, NULL::BIGINT AS was, v AS target FROM b_vertex WHERE v % 6 = 0"
    return f"{_OWN}, {_paths_sql(asked, most, hops)}"


@query(view(f"SELECT start, {_JOINED} AS edges, round(m, 3) AS m FROM (SELECT q AS start, CASE WHEN edges[1] < edges[-1] THEN edges ELSE list_reverse(edges) END AS edges, min(m) AS m FROM all_paths WHERE m >= 4000e0 GROUP BY ALL)", _loops_sql(5500.0, 5)))
def hunted_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops of 4 to 5.5 km from the vertices on the diagonal: ways out of up to four edges, each
    closed by its best ways back."""
    starts = bridge.vertices(spark, sf_dir).select("v").where("v % 6 = 0")
    found = returns.closed_loops(_own_steps(spark, sf_dir), None, starts, 4, 1, 4000.0, 5500.0)
    return found.select("start", F.array_join(F.col("edges").cast("array<string>"), "-").alias("edges"), r("m", 3).alias("m"))


@query()
def support_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops of 4 to 9 km through ordered landmarks around the vertices on the diagonal."""
    v = bridge.vertices(spark, sf_dir)
    home = v.where("v % 6 = 0")
    known = graph.distances(graph.directed(bridge.edges(spark, sf_dir)), home.select(F.col("v").alias("source"), "v"), 9000.0 * 0.55)
    known = stored(known, "known")
    designs = returns.support_designs(graph.landmarks(known, v, 9000.0), known, v, 4000.0, 2)
    found = returns.portfolio_routes(returns.loop_portfolio(_own_steps(spark, sf_dir), None, stored(designs, "designs"), 4000.0, 9000.0))
    return found.select("start", "pos", F.array_join(F.col("supports").cast("array<string>"), "-").alias("supports"), F.array_join(F.col("edges").cast("array<string>"), "-").alias("edges"), r("m", 3).alias("m"))


# ------------------------------------------------------------------------------- contours
_D = lambda i, j: f"sqrt(power(x{i} - x{j}, 2e0) + power(y{i} - y{j}, 2e0))"
_PAIRS = " + ".join(f"coalesce({_D(i, j)}, 0e0)" for i in range(4) for j in range(i + 1, 4))
_CONTOURS = f"""ce AS (SELECT (4 - v // 5) AS r, v % 5 AS c, ele AS z FROM b_vertex),
 sq AS (SELECT a.z AS z0, b.z AS z1, c.z AS z2, d.z AS z3 FROM ce a JOIN ce b ON b.r = a.r AND b.c = a.c + 1 JOIN ce c ON c.r = a.r + 1 AND c.c = a.c + 1 JOIN ce d ON d.r = a.r + 1 AND d.c = a.c),
 lv AS (SELECT *, unnest(range(CAST(floor(least(z0, z1, z2, z3) / 25e0) AS BIGINT) + 1, CAST(floor(greatest(z0, z1, z2, z3) / 25e0) AS BIGINT) + 1)) * 25e0 AS v FROM sq),
 pt AS (SELECT *, CASE WHEN (z0 >= v) <> (z1 >= v) THEN (v - z0) / (z1 - z0) END AS x0, 0e0 AS y0, CASE WHEN (z1 >= v) <> (z2 >= v) THEN 1e0 END AS x1, (v - z1) / nullif(z2 - z1, 0e0) AS y1,
  CASE WHEN (z2 >= v) <> (z3 >= v) THEN 1e0 - (v - z2) / (z3 - z2) END AS x2, 1e0 AS y2, CASE WHEN (z3 >= v) <> (z0 >= v) THEN 0e0 END AS x3, 1e0 - (v - z3) / nullif(z0 - z3, 0e0) AS y3 FROM lv)"""
_LENGTH = f"CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL THEN CASE WHEN ((z0 + z1 + z2 + z3) / 4e0 >= v) = (z0 >= v) THEN {_D(0, 1)} + {_D(2, 3)} ELSE {_D(3, 0)} + {_D(1, 2)} END ELSE {_PAIRS} END"


@query(view(f"SELECT v AS level, round(sum({_LENGTH}), 5) AS length FROM pt GROUP BY v HAVING sum({_LENGTH}) > 1e-6", _CONTOURS))
def contour_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length, in cells, of the chained contours of each level."""
    lines = enrich.contour_lines(enrich.contours(_cells(spark, sf_dir), 25.0))
    w = Window.partitionBy("line").orderBy("pos")
    part = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return lines.withColumn("part", part).groupBy("level").agg(r(F.sum("part"), 5).alias("length"))


@query()
def contour_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = enrich.smoothed(enrich.contour_lines(enrich.contours(_cells(spark, sf_dir), 25.0)))
    return lines.select("level", "line", "pos", r("x", 6).alias("x"), r("y", 6).alias("y"), "closed")


@query()
def inferred_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supports that make the walkable routes of the bridge again, averse to roads."""
    edges = stored(_oneway(spark, sf_dir).withColumns({"travel": F.lit("both"), "road": F.lit(0.0), "access": F.lit("open")}), "edges")
    legs = bridge.legs(spark, sf_dir).select("route_id", "seq", "edge_id", "from_v", "to_v")
    # routes whose legs are all edges of the network
    gone = legs.join(edges.select("edge_id"), "edge_id", "left_anti").select("route_id").distinct()
    legs = stored(legs.join(gone, "route_id", "left_anti"), "legs")
    shapes = stored(routes.shapes(bridge.legs(spark, sf_dir)).join(legs.select("route_id").distinct(), "route_id", "left_semi"), "shapes")
    none = spark.createDataFrame([], "from_edge bigint, via_v bigint, to_edge bigint")
    found = designs.inferred(legs, shapes, edges, none, bridge.vertices(spark, sf_dir))
    return found.select("route_id", "shape", "slot", r("lon", 6).alias("lon"), r("lat", 6).alias("lat"))


# ------------------------------------------------------------------------------- places
_PLAIN = lambda t: f"trim(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_PLACES = f"""pl AS (SELECT s_suppkey AS entry_id, s_name AS name, n_name AS jurisdiction, r_name AS kind, v.lon, v.lat, {_PLAIN("s_name")} AS plain, {_PLAIN("s_name || ' ' || n_name || ' ' || r_name")} AS hay FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN b_vertex v ON v.v = n_nationkey),
 qs AS (SELECT n_nationkey AS query_id, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN substr(n_name, 2, 4) WHEN 2 THEN 'supp ' || substr(n_name, 1, 3) ELSE 'Supplier#0000000' || CAST(n_nationkey AS VARCHAR) END AS text, v.lon, v.lat FROM nation JOIN b_vertex v ON v.v = n_nationkey),
 qp AS (SELECT query_id, lon, lat, {_PLAIN("text")} AS asked FROM qs),
 hit AS (SELECT query_id, entry_id, name, jurisdiction, kind, CASE WHEN plain = asked THEN 0 WHEN starts_with(plain, asked) THEN 1 WHEN len(list_filter(string_split(asked, ' '), lambda w: len(list_filter(string_split(hay, ' '), lambda t: starts_with(t, w))) = 0)) = 0 THEN 2 WHEN contains(hay, asked) THEN 3 END AS rank,
  round(2e0 * 6371008.8e0 * asin(sqrt(power(sin(radians(qp.lat - pl.lat) / 2e0), 2e0) + cos(radians(pl.lat)) * cos(radians(qp.lat)) * power(sin(radians(qp.lon - pl.lon) / 2e0), 2e0))), 3) AS d FROM qp, pl)"""


@query(view("SELECT query_id::BIGINT AS query_id, position::INT AS position, entry_id::BIGINT AS entry_id, rank::INT AS rank, d AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, d, name, jurisdiction, kind, entry_id) AS position FROM hit WHERE rank IS NOT NULL) WHERE position <= 8", _PLACES))
def gazetteer_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best of all suppliers, as places, for names and parts of names of nations."""
    c, v = F.col, bridge.vertices(spark, sf_dir).select(F.col("v").alias("n"), "lon", "lat")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = table(spark, sf_dir, "supplier").join(nation, c("s_nationkey") == c("n_nationkey")).join(region, c("n_regionkey") == c("r_regionkey")).join(v, c("n") == c("n_nationkey"))
    places = places.select(c("s_suppkey").cast("bigint").alias("entry_id"), c("s_name").alias("name"), c("n_name").alias("jurisdiction"), c("r_name").alias("kind"), "lon", "lat")
    k = c("n_nationkey")
    text = F.when(k % 4 == 0, c("n_name")).when(k % 4 == 1, F.substring("n_name", 2, 4)).when(k % 4 == 2, F.concat(F.lit("supp "), F.substring("n_name", 1, 3))).otherwise(F.concat(F.lit("Supplier#0000000"), k.cast("string")))
    asked = nation.join(v, c("n") == k).select(k.cast("bigint").alias("query_id"), text.alias("text"), "lon", "lat")
    return gazetteer.search(asked, places, 8).withColumn("distance_m", r("distance_m", 3))
