"""Geometry on columns: coordinates are doubles in degrees, a point a struct (lon, lat, ele),
a line an array of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the sphere, and metres of a degree as each operator takes them.
EARTH_M = 6_371_008.8
LAT_M, LAT_SHORT_M = 111_320.0, 110_540.0


def once(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    s, t = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.pow(s, 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(t, 2)))


def metres(a: Column, b: Column) -> Column:
    return haversine(a["lon"], a["lat"], b["lon"], b["lat"])


def lerp(a: Column, b: Column, t: Column) -> Column:
    """The point at t from a to b; exactly a and b at 0 and 1; no ele if either has none."""
    mid = F.struct(*[(a[k] + (b[k] - a[k]) * t).alias(k) for k in ("lon", "lat", "ele")])
    return F.when(t == 0, a).when(t == 1, b).otherwise(mid)


def planar2(a: Column, b: Column) -> Column:
    return F.pow(b["lon"] - a["lon"], 2) + F.pow(b["lat"] - a["lat"], 2)


def segments(line: Column) -> Column:
    """The line's segments as structs (a, b)."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def length(line: Column) -> Column:
    return total(F.transform(segments(line), lambda s: metres(s["a"], s["b"])))


def climb(line: Column, sign: int) -> Column:
    """Metres of ascent (sign 1) or descent (-1) where both ends of a segment have an ele."""
    return total(F.transform(segments(line), lambda s: F.greatest(F.coalesce((s["b"]["ele"] - s["a"]["ele"]) * sign, F.lit(0.0)), F.lit(0.0))))


def midpoint(line: Column) -> Column:
    """The middle vertex, or halfway between the middle two."""
    mid = F.floor(F.size(line) / 2).cast("int")
    return F.when(F.size(line) % 2 == 0, lerp(F.get(line, mid - 1), F.get(line, mid), F.lit(0.5))).otherwise(F.get(line, mid))


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def projection(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """(distance, share along) of a point to a segment in local metres around the point."""
    sx = LAT_M * F.cos(F.radians(py))
    hx, hy, tx, ty = (ax - px) * sx, (ay - py) * LAT_SHORT_M, (bx - px) * sx, (by - py) * LAT_SHORT_M
    dx, dy = tx - hx, ty - hy
    span = dx * dx + dy * dy
    t = F.when(span <= 2.220446049250313e-16, 0.0).otherwise(_clamp(-(hx * dx + hy * dy) / span, 0.0, 1.0))
    return F.hypot(hx + dx * t, hy + dy * t), t


def metres_east(lat: str) -> Column:
    """Metres of a degree of longitude, as projection() takes them."""
    return LAT_M * F.cos(F.radians(F.col(lat)))


def projection_steps(px: str, py: str, ax: str, ay: str, bx: str, by: str, sx: str) -> list[dict[str, Column]]:
    """projection() of columns by name as columns to be added one dict after the other, bit for
    bit the same: distance d_ and share t_.  sx: the column of metres_east(py)."""
    c, dx, dy, t = F.col, F.col("dx_"), F.col("dy_"), F.col("t_")
    ends = {"hx_": (c(ax) - c(px)) * c(sx), "hy_": (c(ay) - c(py)) * LAT_SHORT_M, "tx_": (c(bx) - c(px)) * c(sx), "ty_": (c(by) - c(py)) * LAT_SHORT_M}
    way = {"dx_": c("tx_") - c("hx_"), "dy_": c("ty_") - c("hy_")}
    share = F.when(c("span_") <= 2.220446049250313e-16, 0.0).otherwise(_clamp(-(c("hx_") * dx + c("hy_") * dy) / c("span_"), 0.0, 1.0))
    return [ends, way, {"span_": dx * dx + dy * dy}, {"t_": share}, {"d_": F.hypot(c("hx_") + dx * t, c("hy_") + dy * t)}]


def overlay_distance(p: Column, a: Column, b: Column) -> Column:
    """Metres from a point to a segment, both axes scaled alike."""
    sx = LAT_M * F.greatest(F.abs(F.cos(F.radians(p["lat"]))), F.lit(0.01))
    px, py, ax, ay = p["lon"] * sx, p["lat"] * LAT_M, a["lon"] * sx, a["lat"] * LAT_M
    dx, dy = (b["lon"] - a["lon"]) * sx, (b["lat"] - a["lat"]) * LAT_M
    span = dx * dx + dy * dy
    t = F.when(span <= 2.220446049250313e-16, 0.0).otherwise(_clamp(((px - ax) * dx + (py - ay) * dy) / span, 0.0, 1.0))
    return F.hypot(px - ax - dx * t, py - ay - dy * t)


def orient(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def crosses(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Whether segments ab and cd cross or touch; points are pairs of columns."""
    eps = 1e-12
    d1, d2, d3, d4 = orient(*a, *b, *c), orient(*a, *b, *d), orient(*c, *d, *a), orient(*c, *d, *b)

    def on(p: tuple, q: tuple, x: tuple) -> Column:
        inside = [(v >= F.least(s, t) - eps) & (v <= F.greatest(s, t) + eps) for s, t, v in zip(p, q, x)]
        return inside[0] & inside[1]

    touch = ((F.abs(d1) <= eps) & on(a, b, c)) | ((F.abs(d2) <= eps) & on(a, b, d)) | ((F.abs(d3) <= eps) & on(c, d, a)) | ((F.abs(d4) <= eps) & on(c, d, b))
    return touch | (((d1 > 0) != (d2 > 0)) & ((d3 > 0) != (d4 > 0)))


def intersection(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """struct (t, u) where segments ab and cd meet, else null."""
    rx, ry, sx, sy, qx, qy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1], c[0] - a[0], c[1] - a[1]
    det = rx * sy - ry * sx
    t, u = (qx * sy - qy * sx) / F.nullif(det, F.lit(0.0)), (qx * ry - qy * rx) / F.nullif(det, F.lit(0.0))
    ok = (F.abs(det) >= 1e-14) & t.between(-1e-9, 1 + 1e-9) & u.between(-1e-9, 1 + 1e-9)
    return F.when(ok, F.struct(_clamp(t, 0.0, 1.0).alias("t"), _clamp(u, 0.0, 1.0).alias("u")))


def parallel_cosine(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Absolute cosine between the directions of ab and cd, in the local plane."""
    k = F.cos(F.radians((a[1] + b[1] + c[1] + d[1]) * 0.25))
    px, py, qx, qy = (b[0] - a[0]) * k, b[1] - a[1], (d[0] - c[0]) * k, d[1] - c[1]
    norm = F.hypot(px, py) * F.hypot(qx, qy)
    return F.when(norm <= 2.220446049250313e-16, 0.0).otherwise(F.abs(px * qx + py * qy) / norm)


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting; a ring's edges are half open in latitude.  ring: array of points."""
    n = F.size(ring)
    previous = F.concat(F.slice(ring, n, F.lit(1)), F.slice(ring, F.lit(1), n - 1))

    def hit(p: Column, q: Column) -> Column:
        at = p["lon"] + (q["lon"] - p["lon"]) * ((lat - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)))
        return F.when(((p["lat"] > lat) != (q["lat"] > lat)) & (lon < at), 1).otherwise(0)

    hits = F.aggregate(F.zip_with(ring, previous, hit), F.lit(0), lambda s, x: s + x)
    return F.when(n < 3, False).otherwise(hits % 2 == 1)


def line_meets_ring(line: Column, ring: Column) -> Column:
    """Whether a vertex lies inside, or a segment crosses the boundary."""
    pair = lambda p: (p["lon"], p["lat"])
    closed = F.concat(segments(ring), F.array(F.struct(F.element_at(ring, -1).alias("a"), F.element_at(ring, 1).alias("b"))))
    inside = F.exists(line, lambda p: in_ring(p["lon"], p["lat"], ring))
    cut = F.exists(segments(line), lambda s: F.exists(closed, lambda r: crosses(pair(s["a"]), pair(s["b"]), pair(r["a"]), pair(r["b"]))))
    return inside | cut


def line_distance(a: Column, b: Column) -> Column:
    """0 where lines cross, else the least distance of an end to a segment."""
    pair = lambda p: (p["lon"], p["lat"])

    def gap(s: Column, r: Column) -> Column:
        ends = F.least(overlay_distance(s["a"], r["a"], r["b"]), overlay_distance(s["b"], r["a"], r["b"]), overlay_distance(r["a"], s["a"], s["b"]), overlay_distance(r["b"], s["a"], s["b"]))
        return F.when(crosses(pair(s["a"]), pair(s["b"]), pair(r["a"]), pair(r["b"])), 0.0).otherwise(ends)

    return F.array_min(F.transform(segments(a), lambda s: F.array_min(F.transform(segments(b), lambda r: gap(s, r)))))


def crossing_count(a: Column, b: Column) -> Column:
    pair = lambda p: (p["lon"], p["lat"])
    one = lambda s: F.size(F.filter(segments(b), lambda r: crosses(pair(s["a"]), pair(s["b"]), pair(r["a"]), pair(r["b"]))))
    return F.aggregate(F.transform(segments(a), one), F.lit(0), lambda n, x: n + x)


def bearing_sector(lon0: Column, lat0: Column, lon: Column, lat: Column, sectors: int = 16) -> Column:
    turn = (F.atan2(lat - lat0, (lon - lon0) * F.cos(F.radians(lat0))) + F.pi()) / (2 * F.pi())
    return F.least(F.floor(turn * sectors), F.lit(sectors - 1)).cast("int")


def ring_area2(ring: Column) -> Column:
    """Twice the signed area in square degrees (shoelace)."""
    closed = F.concat(segments(ring), F.array(F.struct(F.element_at(ring, -1).alias("a"), F.element_at(ring, 1).alias("b"))))
    return total(F.transform(closed, lambda s: s["a"]["lon"] * s["b"]["lat"] - s["b"]["lon"] * s["a"]["lat"]))


def along(line: Column) -> Column:
    """Metres from the line's start to each of its points."""
    steps = F.transform(segments(line), lambda s: metres(s["a"], s["b"]))
    return once(steps, lambda m: F.concat(F.array(F.lit(0.0)), F.transform(m, lambda x, i: F.aggregate(F.slice(m, F.lit(1), i + 1), F.lit(0.0), lambda a, y: a + y))))


def line_at(line: Column, at_m: Column) -> Column:
    """The point at_m metres along a line; its ends beyond them."""

    def place(m: Column) -> Column:
        k = F.least(F.greatest(F.size(F.filter(m, lambda x: x <= at_m)), F.lit(1)), F.size(m) - 1)
        a, b = F.get(m, k - 1), F.get(m, k)
        t = F.when(b > a, _clamp((at_m - a) / (b - a), 0.0, 1.0)).otherwise(0.0)
        return lerp(F.get(line, k - 1), F.get(line, k), t)

    return once(along(line), place)


def line_slice(line: Column, start_m: Column, end_m: Column) -> Column:
    """The part of a line between two distances along it, of two points at least."""

    def part(m: Column) -> Column:
        inner = F.filter(F.zip_with(line, m, lambda p, x: F.when((x > start_m) & (x < end_m), p)), lambda p: p.isNotNull())
        return once(F.concat(F.array(line_at(line, start_m)), inner, F.array(line_at(line, end_m))), lambda q: F.when((F.size(q) > 2) & (F.element_at(q, -1) == F.element_at(q, -2)), F.slice(q, F.lit(1), F.size(q) - 1)).otherwise(q))

    return once(along(line), part)


def line_projection(p: Column, line: Column, metres: Column | None = None) -> Column:
    """struct (distance_m, segment, progress_m): the place of a line nearest to a point; of
    equal ones the first.  metres: along(line), where it is known."""

    def place(m: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            d, t = projection(p["lon"], p["lat"], s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"])
            return F.struct(d.alias("distance_m"), i.alias("segment"), (F.get(m, i) + (F.get(m, i + 1) - F.get(m, i)) * t).alias("progress_m"))

        return F.array_min(F.transform(segments(line), one))

    return once(along(line), place) if metres is None else place(metres)


def on_line(p: Column, line: Column, most2: float = 1e-18) -> Column:
    """Whether a point lies on a line, to a squared distance in degrees."""

    def near(s: Column) -> Column:
        dx, dy = s["b"]["lon"] - s["a"]["lon"], s["b"]["lat"] - s["a"]["lat"]
        span = dx * dx + dy * dy
        t = F.when(span <= 2.220446049250313e-16, 0.0).otherwise(_clamp(((p["lon"] - s["a"]["lon"]) * dx + (p["lat"] - s["a"]["lat"]) * dy) / span, 0.0, 1.0))
        return F.pow(p["lon"] - s["a"]["lon"] - dx * t, 2) + F.pow(p["lat"] - s["a"]["lat"] - dy * t, 2) <= most2

    return F.exists(segments(line), near)


def same_path(a: Column, b: Column) -> Column:
    """Whether two lines run over the same ground: equal ends, and each other's points."""
    ends = (planar2(F.element_at(a, 1), F.element_at(b, 1)) <= 1e-18) & (planar2(F.element_at(a, -1), F.element_at(b, -1)) <= 1e-18)
    return ends & F.forall(a, lambda p: on_line(p, b)) & F.forall(b, lambda p: on_line(p, a))


def ring_holds(p: Column, ring: Column) -> Column:
    """Whether a point lies in a ring or on its boundary."""
    closed = F.concat(ring, F.slice(ring, F.lit(1), F.lit(1)))
    return on_line(p, closed) | in_ring(p["lon"], p["lat"], ring)
