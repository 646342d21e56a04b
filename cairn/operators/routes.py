"""Routes: metrics, shape, constraints, ranking and choice.

Legs are rows (route_id, seq, start_v, from_v, to_v, edge_id, m, e1, e2, grade, road, conf,
access, terrain); a route is its legs in order of seq."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import physics
from cairn.functions.vocab import is_restricted
from cairn.state import dropped, stored

#: Weights of quality, confidence that counts as low, bounds of grade bins.
ROAD_WEIGHT, DOUBT_WEIGHT, ACCESS_WEIGHT = 0.70, 0.25, 0.50
LOW_CONFIDENCE = 0.6
BINS = [("flat_m", 0.0, 0.05), ("rolling_m", 0.05, 0.15), ("steep_m", 0.15, 0.30), ("savage_m", 0.30, float("inf"))]
#: What ranks and portfolios take of a route beside its id, verdict and group.
RANKED = ("penalty", "score", "distance_m", "ascent_m", "descent_m", "load_km", "moving_time_s", "quality", "restricted_fraction", "repeated_fraction")
SHAPES = ["open", "out-and-back", "figure-eight", "loop"]


def road_exposure(road: Column, terrain: Column) -> Column:
    return F.when(terrain == "road", 1.0).otherwise(F.least(F.greatest(road, F.lit(0.0)), F.lit(1.0)))


def edge_quality(road: Column, conf: Column, access: Column, terrain: Column) -> Column:
    barred = F.when(access.isin("closed", "private"), 1.0).when(access == "restricted", 0.25).otherwise(0.0)
    doubt = 1 - F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0))
    loss = ROAD_WEIGHT * road_exposure(road, terrain) + DOUBT_WEIGHT * doubt + ACCESS_WEIGHT * barred
    return 1 - F.least(F.greatest(loss, F.lit(0.0)), F.lit(1.0))


def grade_bin(grade: Column, m: Column) -> list[Column]:
    """Metres by bin of absolute grade."""
    g = F.abs(grade)
    return [F.sum(F.when((g >= lo) & (g < hi), m).otherwise(0.0)).alias(name) for name, lo, hi in BINS]


def measured(legs: DataFrame) -> DataFrame:
    """One row per route: route_id, start_v, shape and the measures.

    An edge repeats from its second traversal on.  Shape is open, out-and-back if an edge
    repeats, figure-eight if a vertex is visited once more than its due (the start may be
    visited twice), else loop.  Fractions of a route without length are null.  Everything
    is one pass over legs that lie together by route: repeats show as equal neighbours in
    the orders of edges and of vertices, so that no second exchange is needed."""
    c, of = F.col, Window.partitionBy("route_id")
    again = lambda k: F.coalesce(F.lag(k).over(of.orderBy(k, "seq")) == c(k), F.lit(False))
    rows = legs.withColumn("rep_", again("edge_id")).withColumn("seen_", again("to_v"))
    length = F.nullif(F.sum("m"), F.lit(0.0))
    share = lambda test: F.sum(F.when(test, c("m")).otherwise(0.0)) / length
    road = road_exposure(c("road"), c("terrain"))
    shape = F.when(F.min("start_v") != F.max_by("to_v", "seq"), "open").when(F.max("rep_"), "out-and-back").when(F.max("seen_"), "figure-eight").otherwise("loop")
    return rows.groupBy("route_id").agg(
        F.count("*").alias("n_legs"),
        F.sum("m").alias("distance_m"),
        F.sum(F.when(c("e2") >= c("e1"), c("e2") - c("e1")).otherwise(0.0)).alias("ascent_m"),
        F.sum(F.when(c("e2") < c("e1"), c("e1") - c("e2")).otherwise(0.0)).alias("descent_m"),
        F.sum(c("m") / 1000.0 * physics.joint_work(c("grade")) * physics.roughness(c("terrain"))).alias("load_km"),
        F.sum(3.6 * c("m") / physics.speed_kmh(c("grade"), c("terrain"))).alias("moving_time_s"),
        (100.0 * F.sum(c("m") * edge_quality(c("road"), c("conf"), c("access"), c("terrain"))) / length).alias("quality"),
        (F.sum(c("m") * road) / length).alias("road_fraction"),
        share(c("conf") < LOW_CONFIDENCE).alias("low_confidence_fraction"),
        share(is_restricted(c("access"))).alias("restricted_fraction"),
        share(c("rep_")).alias("repeated_fraction"),
        shape.alias("shape"),
        F.min("start_v").alias("start_v"),
    )


def metrics(legs: DataFrame) -> DataFrame:
    """The measures of measured(), without shape and start."""
    return measured(legs).drop("shape", "start_v")


def keyed_metres(legs: DataFrame, key: str) -> DataFrame:
    """(route_id, key, metres, fraction) for terrain or access."""
    by = legs.groupBy("route_id", key).agg(F.sum("m").alias("metres"))
    whole = F.sum("metres").over(Window.partitionBy("route_id"))
    return by.withColumn("fraction", F.col("metres") / F.greatest(whole, F.lit(1.0)))


def grades(legs: DataFrame) -> DataFrame:
    return legs.groupBy("route_id").agg(*grade_bin(F.col("grade"), F.col("m")), F.max(F.abs("grade")).alias("max_grade"))


def shapes(legs: DataFrame) -> DataFrame:
    """(route_id, shape) of measured()."""
    return measured(legs).select("route_id", "shape")


@dataclass(frozen=True)
class Bounds:
    """What a search asks of a route; metres, seconds, FGJW kilometres and fractions."""

    distance_m: tuple[float, float] = (5_000.0, 12_000.0)
    load_km: tuple[float, float] = (0.0, 1.7976931348623157e308)
    moving_time_s: tuple[float, float] = (0.0, 1.7976931348623157e308)
    ascent_m: tuple[float, float] = (0.0, 3_000.0)
    descent_m: tuple[float, float] = (0.0, 3_000.0)
    road_fraction: float = 1.0
    low_confidence_fraction: float = 0.20
    restricted_fraction: float = 0.0
    repeated_fraction: float = 0.0
    target_load_km: float | None = None
    shapes: tuple[str, ...] = ("loop", "figure-eight")
    forbidden_terrain: tuple[str, ...] = ()
    least_terrain: dict[str, float] = field(default_factory=dict)
    most_terrain: dict[str, float] = field(default_factory=dict)

    def checks(self) -> list[tuple[str, str, str, float, float, float]]:
        """(name, kind, column, unit's size, bound in that unit, least scale)."""
        rows = []
        for name, column, unit, floor in (("distance", "distance_m", 1000.0, 0.001), ("lower-limb load", "load_km", 1.0, 0.001), ("moving time", "moving_time_s", 3600.0, 0.001), ("ascent", "ascent_m", 1.0, 1.0), ("descent", "descent_m", 1.0, 1.0)):
            low, high = getattr(self, column)
            rows += [(name, "min", column, unit, low / unit, floor), (name, "max", column, unit, high / unit, floor)]
        for name, column in (("road exposure", "road_fraction"), ("low-confidence exposure", "low_confidence_fraction"), ("restricted-access exposure", "restricted_fraction"), ("repeated-edge exposure", "repeated_fraction")):
            rows.append((name, "max", column, 0.01, getattr(self, column) * 100.0, 1.0))
        return rows


def _value(column: str, unit: float) -> Column:
    """A fraction times 100, or a measure in its unit."""
    return F.coalesce(F.col(column), F.lit(0.0)) * 100.0 if unit == 0.01 else F.col(column) / unit


def _held(kind: str, value: Column, bound: float) -> Column:
    return value >= bound if kind == "min" else value <= bound


def audit(routes: DataFrame, bounds: Bounds) -> DataFrame:
    """(route_id, pos, metric, kind, measured, bound, margin, satisfied), a row per check."""
    rows = []
    for pos, (name, kind, column, unit, bound, _) in enumerate(bounds.checks()):
        v = _value(column, unit)
        margin = v - bound if kind == "min" else F.lit(bound) - v
        rows.append(F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("metric"), F.lit(kind).alias("kind"), v.alias("measured"), F.lit(float(bound)).alias("bound"), margin.alias("margin"), _held(kind, v, bound).alias("satisfied")))
    return routes.select("route_id", F.explode(F.array(*rows)).alias("r")).select("route_id", "r.*")


def judged(routes: DataFrame, bounds: Bounds, terrain: DataFrame | None = None) -> DataFrame:
    """routes (metrics with shape) with satisfied, n_violations, penalty and score.

    terrain: (route_id, terrain, fraction), needed if bounds ask for terrain."""
    breaches, broken = [], []
    for _, kind, column, unit, bound, floor in bounds.checks():
        v = _value(column, unit)
        over = F.lit(bound) - v if kind == "min" else v - bound
        breaches.append(F.greatest(over / max(bound, floor), F.lit(0.0)))
        broken.append(~_held(kind, v, bound))
    odd = ~F.col("shape").isin(list(bounds.shapes))
    breaches.append(F.when(odd, 4.0).otherwise(0.0))
    broken.append(odd)
    if bounds.forbidden_terrain or bounds.least_terrain or bounds.most_terrain:
        routes = routes.join(terrain.groupBy("route_id").agg(F.map_from_entries(F.collect_list(F.struct("terrain", "fraction"))).alias("mix_")), "route_id", "left")
        part = lambda t: F.coalesce(F.col("mix_")[t], F.lit(0.0))
        for t in bounds.forbidden_terrain:
            breaches.append(part(t) * 4.0)
            broken.append(part(t) > 0)
        for t, low in bounds.least_terrain.items():
            breaches.append(F.greatest((low - part(t)) / max(low, 0.01), F.lit(0.0)))
            broken.append(part(t) < low)
        for t, high in bounds.most_terrain.items():
            breaches.append(F.greatest((part(t) - high) / max(high, 0.01), F.lit(0.0)))
            broken.append(part(t) > high)
    n = sum((b.cast("int") for b in broken[1:]), broken[0].cast("int"))
    out = routes.withColumn("n_violations", n).withColumn("satisfied", F.col("n_violations") == 0)
    out = out.withColumn("penalty", 100.0 * sum(breaches[1:], breaches[0]))
    return out.withColumn("score", F.col("penalty") + 0.1 * (100.0 - F.col("quality"))).drop("mix_")


def deviation(value: Column, low: float, high: float) -> Column:
    return F.when(value < low, low - value).when(value > high, value - high).otherwise(0.0)


def objectives(bounds: Bounds) -> list[Column]:
    """The nine objectives, each the smaller the better."""
    load = F.abs(F.col("load_km") - bounds.target_load_km) if bounds.target_load_km is not None else deviation(F.col("load_km"), *bounds.load_km)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return [F.col("penalty"), deviation(F.col("distance_m"), *bounds.distance_m), deviation(F.col("ascent_m"), *bounds.ascent_m), deviation(F.col("descent_m"), *bounds.descent_m), load, deviation(F.col("moving_time_s"), *bounds.moving_time_s), 100.0 - zero("quality"), zero("restricted_fraction"), zero("repeated_fraction")]


def undominated(x: np.ndarray) -> np.ndarray:
    """Which rows no other row is at least as good as in all columns and better in one.

    Rows are visited by their sum: what dominates a row has a smaller sum, so only the
    front so far need be looked at."""
    order, keep = np.lexsort((*x.T[::-1], x.sum(1))), np.zeros(len(x), bool)
    front, n = np.empty_like(x), 0
    for i in order:
        if n and ((front[:n] <= x[i]).all(1) & (front[:n] < x[i]).any(1)).any():
            continue
        keep[i] = True
        front[n] = x[i]
        n += 1
    return keep


def _running_fronts(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.RecordBatch]:
    """Of all rows of a task the front of each group.  Dominated rows go whenever as many new
    ones have come as were held, so that no more than twice the fronts and a batch is held."""
    held, new, come = None, [], 0

    def fronts() -> pa.Table:
        rows = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches(new)]).combine_chunks()
        at: dict = {}
        for i, g in enumerate(rows.column(group).to_pylist()):
            at.setdefault(g, []).append(i)
        x, keep = _columns(rows.column("o_")), np.zeros(len(rows), bool)
        for rows_of in at.values():
            keep[rows_of] = undominated(x[rows_of])
        return rows.filter(pa.array(keep))

    for batch in batches:
        if batch.num_rows:
            new.append(batch)
            come += batch.num_rows
        if new and come >= (len(held) if held is not None else 0):
            held, new, come = fronts(), [], 0
    if new:
        held = fronts()
    if held is not None:
        yield from held.to_batches()


def first_front(routes: DataFrame, bounds: Bounds, group: str, salts: int = 64) -> DataFrame:
    """Routes of each group that no other of the group dominates.

    Each task first keeps the fronts of its own rows, so that what is exchanged doesn't grow
    with the rows.  Then two steps, for a group may be hot: the front of each of `salts` random
    parts, then the front of what these leave (a route outside its part's front is outside the
    whole's)."""
    cols = routes.columns
    rows = routes.withColumn("o_", F.array(*objectives(bounds)))

    def front(pdf: pa.Table) -> pa.Table:
        x = np.array(pdf.column("o_").to_pylist(), float)
        return pdf.filter(pa.array(undominated(x)))

    salt = F.pmod(F.xxhash64("route_id"), F.lit(salts)).cast("int")
    part = rows.mapInArrow(lambda batches: _running_fronts(batches, group), rows.schema).withColumn("salt_", salt)
    part = part.groupBy(group, "salt_").applyInArrow(front, part.schema).drop("salt_")
    return part.groupBy(group).applyInArrow(front, part.schema).select(*cols)


def _columns(points: pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of equally long lists of doubles as rows of a matrix."""
    flat = pa.concat_arrays([x.flatten() for x in points.chunks]) if points.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(points), -1)


#: Points that are ranked together, and comparisons of these with fronts that are made at once.
BLOCK, COMPARED = 512, 1 << 20
#: Points for which a task of its own is worth its start.
TASK_POINTS = 4096


class Fronts:
    """Points by rank; the ranks of many new ones are found by one bisection.

    What dominates a point of front f has one of front f - 1 that dominates it, so above
    `floor`, the largest rank known from elsewhere, the fronts that hold a dominating point
    are the lowest ones.  A front stands in one piece of a pool, with room to grow; x has a
    row for each objective that is compared."""

    def __init__(self, width: int) -> None:
        self.x, self.used, self.top = np.empty((width, 1024)), 0, 0
        self.start, self.size, self.room = (np.zeros(64, np.int64) for _ in range(3))

    def add(self, x: np.ndarray, rank: np.ndarray) -> None:
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        of, first, n = np.unique(rank[order], return_index=True, return_counts=True)
        self.top = max(self.top, int(of[-1]))
        if self.top >= len(self.size):
            self.start, self.size, self.room = (np.concatenate([z, np.zeros(self.top, np.int64)]) for z in (self.start, self.size, self.room))
        more = of[self.size[of] + n > self.room[of]]
        if len(more):
            need = self.size[of] + n
            room = np.where(self.size[of] > 0, 2 * need, need)[self.size[of] + n > self.room[of]]
            at = self.used + np.cumsum(room) - room
            self.used += int(room.sum())
            if self.used > self.x.shape[1]:
                self.x = np.concatenate([self.x, np.empty((len(self.x), self.used))], axis=1)
            old = self.size[more]
            self.x[:, _places(at, old)] = self.x[:, _places(self.start[more], old)]
            self.start[more], self.room[more] = at, room
        self.x[:, _places(self.start[of] + self.size[of], n)] = x[:, order]
        self.size[of] += n

    def _hit(self, x: np.ndarray, front: np.ndarray) -> np.ndarray:
        """Whether a point of its front dominates each point (none equals it)."""
        n, out = self.size[front], np.zeros(len(front), bool)
        for i in np.flatnonzero(n > COMPARED // BLOCK).tolist():
            a, left = int(self.start[front[i]]), None
            for row, value in zip(self.x, x[:, i].tolist()):
                left = np.flatnonzero(row[a : a + n[i]] <= value) + a if left is None else left[row[left] <= value]
            out[i] = left is None or len(left) > 0
        few = np.flatnonzero((n > 0) & (n <= COMPARED // BLOCK))
        of, at = np.repeat(few, n[few]), _places(self.start[front[few]], n[few])
        for row, values in zip(self.x, x):
            ok = row[at] <= values[of]
            of, at = of[ok], at[ok]
        out[of] = True
        return out

    def above(self, x: np.ndarray, floor: np.ndarray, ends: bool = False) -> np.ndarray:
        """The largest rank of a point that dominates each of these.  ends: most are dominated
        by none of these fronts or by the last, so the first and the last are looked at first."""
        out = np.empty(len(floor), np.int64)
        for a in range(0, len(floor), BLOCK):
            now = x[:, a : a + BLOCK]
            low = floor[a : a + BLOCK].astype(np.int64)
            high = np.maximum(low, self.top)
            step = 0
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_] + 1) // 2
                if ends and step < 2:
                    mid = low[open_] + 1 if step == 0 else high[open_]
                hit = self._hit(now[:, open_], mid)
                low[open_[hit]], high[open_[~hit]] = mid[hit], mid[~hit] - 1
                step += 1
            out[a : a + BLOCK] = low
        return out


def _places(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of stretches of n from each start on, one after another."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def _compared(x: np.ndarray) -> list[int]:
    """The columns of points in lexicographic order to compare with what comes before them:
    those that vary, but for the first, by which they are sorted; those first that refute most."""
    cols = np.flatnonzero((x != x[:1]).any(0)) if len(x) else np.arange(x.shape[1])
    cols = [int(k) for k in cols if k or np.isnan(x[:, 0]).any()]
    pairs = np.sort(np.random.default_rng(0).integers(0, max(len(x), 1), (2, 2048)), axis=0)
    return sorted(cols, key=lambda k: (x[pairs[0], k] <= x[pairs[1], k]).mean() if len(x) else 0.0)


def _ranked_slice(pdf: pa.Table) -> pa.Table:
    """Ranks of a slice's points; base_ is the largest rank of an earlier slice that dominates.

    A block of points in lexicographic order is first held against the fronts of those
    before it, then its own points against each other."""
    x, base = _columns(pdf.column("o_")), pdf.column("base_").to_numpy()
    order, rank = np.lexsort(x.T[::-1]), np.zeros(len(x), np.int32)
    cols = _compared(x[order])
    sorted_, fronts = np.ascontiguousarray(x[order][:, cols].T), Fronts(len(cols))
    for a in range(0, len(x), BLOCK):
        now = sorted_[:, a : a + BLOCK]
        below = np.tri(now.shape[1], k=-1, dtype=bool)
        for row in now:
            below &= row[None, :] <= row[:, None]
        got = fronts.above(now, base[order[a : a + BLOCK]]) + 1
        for i in np.flatnonzero(below.any(1)).tolist():
            got[i] = max(got[i], got[:i][below[i, :i]].max() + 1)
        fronts.add(now, got)
        rank[order[a : a + BLOCK]] = got
    return pdf.select(["set_", "o_"]).append_column("rank_", pa.array(rank))


def _dominating(asked: pa.Table, known: pa.Table) -> pa.Table:
    """For asked points the largest rank of a known one that dominates; known holds whole
    fronts of points that come before all asked ones."""
    x, y, ranks = _columns(asked.column("o_")), _columns(known.column("known_")), known.column("rank_").to_numpy().astype(np.int64)
    low = int(ranks.min()) - 1 if len(ranks) else 0
    cols = _compared(np.concatenate([y, x]))
    fronts = Fronts(len(cols))
    fronts.add(np.ascontiguousarray(y[:, cols].T), ranks)
    best = fronts.above(np.ascontiguousarray(x[:, cols].T), np.full(len(x), low), ends=True)
    return asked.select(["set_", "o_"]).append_column("base_", pa.array(np.where(best == low, 0, best).astype(np.int32)))


def _rank_slices(points: DataFrame, slice_rows: int) -> DataFrame:
    """(set_, o_, rank_) of distinct points (set_, o_): 1 more than the largest rank of a point
    of the set that dominates.

    Points are cut by range into slices, so that only what stands in earlier slices or in the
    same one dominates.  A round ranks the next slice of every set: first against the earlier
    ones, in chunks of whole fronts, then within itself.  No task holds more than a slice and
    a chunk; a set of less than slice_rows points is one slice or two."""
    c = F.col
    points = stored(points, "points")
    parts = max(1, -(-points.count() // slice_rows))
    cut = stored(points.repartitionByRange(parts, "set_", "o_").withColumn("p_", F.spark_partition_id()), "cut")
    dropped(points)
    nth = cut.select("set_", "p_").distinct().withColumn("slice_", F.row_number().over(Window.partitionBy("set_").orderBy("p_")))
    cut_rows = stored(cut.join(nth, ["set_", "p_"]).drop("p_"), "slices")
    dropped(cut)
    form = points.schema.simpleString()[len("struct<") : -1]
    written: list[DataFrame] = []
    # As many tasks as follow the sets and the rows: adaptive execution, which goes by bytes,
    # would put many sets into one.
    sizes = cut_rows.groupBy("slice_", "set_").count().groupBy("slice_").agg(F.count("*").alias("sets"), F.sum("count").alias("rows")).collect()
    tasks = {x["slice_"]: max(1, min(2 * x["sets"], x["rows"] // TASK_POINTS)) for x in sizes}
    for k in range(1, max(tasks, default=1) + 1):
        now = cut_rows.where(c("slice_") == k).drop("slice_")
        many = tasks.get(k, 1)
        if written:
            done = reduce(DataFrame.unionByName, written).join(now.select("set_").distinct(), "set_", "left_semi")
            before = F.sum("count").over(Window.partitionBy("set_").orderBy("rank_").rowsBetween(Window.unboundedPreceding, -1))
            chunks = done.groupBy("set_", "rank_").count().select("set_", "rank_", F.floor(F.coalesce(before, F.lit(0)) / slice_rows).alias("chunk_"))
            chunks = stored(chunks, "chunks")
            asked = now.join(chunks.select("set_", c("chunk_").alias("of_")).distinct(), "set_")
            known = done.join(chunks, ["set_", "rank_"]).select(c("set_").alias("known_set_"), c("chunk_").alias("known_of_"), c("o_").alias("known_"), "rank_")
            asked, known = asked.repartition(many * (k - 1), "set_", "of_"), known.repartition(many * (k - 1), "known_set_", "known_of_")
            base = asked.groupBy("set_", "of_").cogroup(known.groupBy("known_set_", "known_of_")).applyInArrow(_dominating, f"{form}, base_ int")
            now = base.groupBy("set_", "o_").agg(F.max("base_").alias("base_"))
        else:
            now = now.withColumn("base_", F.lit(0))
        written.append(stored(now.repartition(many, "set_").groupBy("set_").applyInArrow(_ranked_slice, f"{form}, rank_ int"), "ranks"))
        if k > 1:
            dropped(chunks)
    dropped(cut_rows)
    return reduce(DataFrame.unionByName, written)


def pareto_ranks(routes: DataFrame, bounds: Bounds, group: str, slice_rows: int = 1 << 18) -> DataFrame:
    """routes with pareto_rank: fronts are peeled off the satisfied ones first, and ranks
    go on through the others.  Routes of equal objectives are ranked once."""
    c = F.col
    cols = [x for x in routes.columns if x != "pareto_rank"]
    good = F.coalesce("satisfied", F.lit(False))
    rows = stored(routes.withColumn("o_", F.array(*objectives(bounds))).withColumn("set_", F.struct(F.struct(group).alias("group"), good.alias("good"))), "routes")
    ranks = _rank_slices(rows.select("set_", "o_").distinct(), slice_rows)
    # A hash goes first, by which rows sort faster than by lists.
    rows, ranks = (x.withColumn("h_", F.xxhash64("set_", "o_")) for x in (rows, ranks))
    tops = ranks.where("set_.good").groupBy(c("set_.group").alias("group_")).agg(F.max("rank_").alias("top_"))
    both = rows.join(ranks, ["h_", "set_", "o_"]).withColumn("group_", c("set_.group")).join(tops, "group_", "left")
    return both.select(*cols, (c("rank_") + F.when(c("set_.good"), 0).otherwise(F.coalesce("top_", F.lit(0)))).alias("pareto_rank"))


def final_order(ranked: DataFrame) -> DataFrame:
    return ranked.orderBy(F.desc("satisfied"), "pareto_rank", "score", "route_id")


def signatures(legs: DataFrame, shaped: DataFrame) -> DataFrame:
    """(route_id, shape, signature): the shape and the multiset of edges, as text."""
    counts = legs.groupBy("route_id", "edge_id").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "n"))), lambda s: F.concat_ws("x", s["edge_id"].cast("string"), s["n"].cast("string"))), ",")
    return counts.groupBy("route_id").agg(text.alias("signature")).join(shaped, "route_id").select("route_id", "shape", "signature")


def first_of_signature(signed: DataFrame) -> DataFrame:
    """The route with the smallest id of each signature, and how many share it."""
    return signed.groupBy("shape", "signature").agg(F.min("route_id").alias("route_id"), F.count("*").alias("n_routes")).select("route_id", "shape", "n_routes")


def overlaps(legs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, distance): 1 less the shared metres (each edge as often as both
    have it) over the shorter route's metres.  pairs: (left_id, right_id).

    A route's edges go with it as one row, so that the joins are by route alone and keep the
    tasks that the legs are dealt over."""
    c = F.col
    edges = legs.groupBy("route_id", "edge_id").agg(F.count("*").alias("n"), F.min("m").alias("m"), F.sum("m").alias("d"))
    entry = F.when(c("edge_id").isNotNull(), F.struct("edge_id", "n", "m"))
    one = edges.groupBy("route_id").agg(F.array_sort(F.collect_list(entry)).alias("edges"), F.sum("d").alias("d"))
    counts = F.map_from_entries(F.transform("edges", lambda e: F.struct(e["edge_id"], e["n"])))
    a = one.select(c("route_id").alias("left_id"), c("edges").alias("ea"), c("d").alias("da"))
    b = one.select(c("route_id").alias("right_id"), counts.alias("nb"), c("d").alias("db"))
    both = pairs.join(a, "left_id").join(b, "right_id")
    times = lambda e: F.least(e["n"], F.coalesce(F.try_element_at(c("nb"), e["edge_id"]), F.lit(0)))
    shared = F.aggregate("ea", F.lit(0.0), lambda s, e: s + F.coalesce((e["m"] * times(e)).cast("double"), F.lit(0.0)))
    return both.select("left_id", "right_id", (1 - shared / F.greatest(F.least("da", "db"), F.lit(1.0))).alias("distance"))


def portfolio(ranked: DataFrame, legs: DataFrame, group: str, limit: int = 12, radii: tuple[float, ...] = (0.35, 0.20, 0.08, 0.0), batch: int = 256) -> DataFrame:
    """At most `limit` routes of each group, (group, route_id, pick): greedily in final
    order, tier by tier, those at least a radius away from all picked ones, for ever
    smaller radii.  limit is the feature: a portfolio is what one search keeps.

    A round takes of each group the first `batch` routes that are far enough from all picked
    so far, and picks among these.  What it passes over is too near to a pick, so the next
    round need not know where this one ended; rounds go on until no group has more."""
    c = F.col
    items = stored(_with_edges(ranked.select(group, "route_id", "satisfied", "pareto_rank", "score", "distance_m"), legs, group), "items")
    few = stored(items.groupBy("set_").count().withColumn("few_", c("count") <= limit).drop("count"), "groups")
    small = items.join(few.where("few_"), "set_")
    return _greedy(small, few.where("not few_").select("set_"), lambda tier, going: items.where(c("satisfied") == tier), group, limit, radii, batch)


def diverse(routes: DataFrame, legs_of: Callable[[DataFrame], DataFrame], bounds: Bounds, group: str, limit: int = 12, radii: tuple[float, ...] = (0.35, 0.20, 0.08, 0.0), batch: int = 256) -> DataFrame:
    """portfolio() of pareto_ranks() of routes that all have legs; legs_of gives the legs of a
    table of route_ids.

    Satisfied routes come first in rank and order, and the others' ranks among themselves
    don't depend on them.  So these are ranked, and their edges read, in those groups only
    that the satisfied ones leave open."""
    c = F.col
    measures = [x for x in routes.columns if x in RANKED]
    rows = stored(routes.select("route_id", "satisfied", *measures, group).withColumn("set_", F.struct(group)), "routes")
    few = stored(rows.groupBy("set_").count().withColumn("few_", c("count") <= limit).drop("count"), "groups")

    def ranked(some: DataFrame) -> DataFrame:
        return pareto_ranks(some.drop("set_"), bounds, group).select(group, "route_id", "satisfied", "pareto_rank", "score", "distance_m")

    def of_tier(tier: bool, going: DataFrame) -> DataFrame:
        good = c("satisfied") if tier else ~F.coalesce("satisfied", F.lit(False))
        order = stored(ranked(rows.where(good).join(going, "set_", "left_semi")).where(c("satisfied") == tier), "ranked")
        return stored(_with_edges(order, legs_of(order.select("route_id")), group), "items")

    small = ranked(rows.join(few.where("few_").select("set_"), "set_", "left_semi")).withColumn("set_", F.struct(group))
    return _greedy(small, few.where("not few_").select("set_"), of_tier, group, limit, radii, batch)


def _with_edges(routes: DataFrame, legs: DataFrame, group: str) -> DataFrame:
    """routes that have legs, with the list of their edges and set_, their group."""
    counts = legs.groupBy("route_id", "edge_id").agg(F.count("*").alias("n"), F.min("m").alias("m"))
    edges = counts.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("edge_id", "n", "m"))).alias("edges"))
    return routes.join(edges, "route_id").withColumn("set_", F.struct(group))


def _greedy(small: DataFrame, large: DataFrame, of_tier: Callable[[bool, DataFrame], DataFrame], group: str, limit: int, radii: tuple[float, ...], batch: int) -> DataFrame:
    """What portfolio() gives: small are the routes of groups of `limit` at most, large the other
    groups (set_), of_tier gives a tier's routes with edges, of these groups at least."""
    c = F.col
    final = [F.coalesce("satisfied", F.lit(False)).desc(), "pareto_rank", "score", "route_id"]
    small = small.select("set_", "route_id", (F.row_number().over(Window.partitionBy("set_").orderBy(*final)) - 1).alias("pick"))
    fields = ["set_", "route_id", "distance_m", "edges"]

    def choose(radius: float):
        def away(a: dict, b: dict) -> float:
            shared = 0.0  # summed as the column expression below does it
            for e, (n, m) in a["counts"].items():
                shared += m * min(n, b["counts"][e][0]) if e in b["counts"] else 0.0
            return 1 - shared / max(1.0, min(a["distance_m"], b["distance_m"]))

        def of(near: pa.Table, picked: pa.Table) -> pa.Table:
            rows, chosen, new = near.to_pylist(), picked.to_pylist(), []
            for r in [*rows, *chosen]:
                r["counts"] = {e["edge_id"]: (e["n"], e["m"]) for e in r["edges"]}
            for r in sorted(rows, key=lambda r: r["nth_"]):
                if len(chosen) < limit and all(away(r, x) >= radius for x in chosen):
                    new.append(r | {"pick": len(chosen)})
                    chosen.append(r)
            return pa.Table.from_pylist([{k: r[k] for k in [*fields, "pick"]} for r in new], schema=pa.schema([*[near.schema.field(k) for k in fields], ("pick", pa.int32())]))

        return of

    picks: list[DataFrame] = []
    left = stored(large, "open")
    shared = lambda e, x: e["m"] * F.least(e["n"], F.coalesce(F.try_element_at(x["counts"], e["edge_id"]), F.lit(0)))
    for tier in (True, False):
        if left.isEmpty():
            break
        items = of_tier(tier, left)
        if not picks:
            form = items.select(*fields).schema.simpleString()[len("struct<") : -1]
            picks.append(stored(items.select(*fields, F.lit(0).alias("pick")).where("false"), "picks"))
        for radius in radii:
            going = left
            while not going.isEmpty():
                picked = reduce(DataFrame.unionByName, picks)
                counted = F.map_from_entries(F.transform("edges", lambda e: F.struct(e["edge_id"], e["n"])))
                by = picked.groupBy("set_").agg(F.collect_list(F.struct("route_id", "distance_m", counted.alias("counts"))).alias("picked_"))
                pool = items.join(going, "set_", "left_semi").join(by, "set_", "left")
                apart = lambda x: (x["route_id"] != c("route_id")) & (1 - F.aggregate("edges", F.lit(0.0), lambda s, e: s + shared(e, x)) / F.greatest(F.lit(1.0), F.least("distance_m", x["distance_m"])) >= radius)
                pool = pool.where(F.coalesce(F.forall("picked_", apart), F.lit(True))).drop("picked_")
                near = stored(pool.withColumn("nth_", F.row_number().over(Window.partitionBy("set_").orderBy("pareto_rank", "score", "route_id"))).where(c("nth_") <= batch), "near")
                got = near.groupBy("set_").cogroup(picked.groupBy("set_")).applyInArrow(choose(radius), f"{form}, pick int")
                picks.append(stored(got, "picks"))
                full = reduce(DataFrame.unionByName, picks).groupBy("set_").count().where(c("count") >= limit)
                left = stored(left.join(full, "set_", "left_anti"), "open")
                going = stored(near.groupBy("set_").count().where(c("count") == batch).select("set_").join(left, "set_", "left_semi"), "going")
                dropped(near)
    whole = reduce(DataFrame.unionByName, [small, *(x.select("set_", "route_id", "pick") for x in picks)])
    return whole.select(c("set_")[group].alias(group), "route_id", "pick")


def carried_ids(previous: DataFrame, now: DataFrame) -> DataFrame:
    """(key, identity): a route seen before keeps its identity; new ones are numbered after
    the largest, in order of key.  Both tables have key, previous has identity."""
    both = now.select("key").distinct().join(previous.select("key", "identity"), "key", "left")
    new = both.where("identity is null").select("key")
    # New keys are counted by range, so that no task numbers them all.
    parts = stored(new.repartitionByRange("key").withColumn("p_", F.spark_partition_id()), "ranges")
    parts = parts.withColumn("r_", F.row_number().over(Window.partitionBy("p_").orderBy("key")))
    before = parts.groupBy("p_").count().withColumn("b_", F.sum("count").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)))
    top = previous.agg(F.coalesce(F.max("identity"), F.lit(0)).alias("top_"))
    numbered = parts.join(F.broadcast(before.select("p_", "b_")), "p_").crossJoin(F.broadcast(top))
    ids = numbered.select("key", (F.col("top_") + F.coalesce("b_", F.lit(0)) + F.col("r_")).cast("long").alias("identity"))
    return both.where("identity is not null").select("key", F.col("identity").cast("long")).union(ids)
