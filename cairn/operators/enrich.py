"""Elevation and terrain: grids of heights, samples, inference, contours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.crs import from_lonlat
from cairn.functions.vocab import pathless
from cairn.state import dropped, stored


def sampled(points: DataFrame, key: list[str], cells: DataFrame, west: float, south: float, size: float, ncols: int, nrows: int) -> DataFrame:
    """points (identified by the columns `key`) with ele: bilinear between the four cell
    centres around each point; beyond the outer centres the edge's value; null outside the
    grid or where a cell has no value.  cells: (row, col, z), row 0 the northernmost.

    An equi-join by cell; the grid may be as large as any table."""
    c = F.col
    inside = c("lon").between(west, west + ncols * size) & c("lat").between(south, south + nrows * size)
    x = F.least(F.greatest((c("lon") - west) / size - 0.5, F.lit(0.0)), F.lit(ncols - 1.0))
    y = F.least(F.greatest((south + nrows * size - c("lat")) / size - 0.5, F.lit(0.0)), F.lit(nrows - 1.0))
    p = points.withColumn("x_", x).withColumn("y_", y)
    corner = lambda col, row, w: F.struct(col.cast("int").alias("col"), row.cast("int").alias("row"), w.alias("w"))
    tx, ty = c("x_") - F.floor("x_"), c("y_") - F.floor("y_")
    four = F.array(corner(F.floor("x_"), F.floor("y_"), (1 - tx) * (1 - ty)), corner(F.ceil("x_"), F.floor("y_"), tx * (1 - ty)), corner(F.floor("x_"), F.ceil("y_"), (1 - tx) * ty), corner(F.ceil("x_"), F.ceil("y_"), tx * ty))
    asked = p.where(inside).select(*key, F.explode(four).alias("c")).select(*key, "c.*")
    got = asked.join(cells, ["row", "col"], "left").groupBy(*key).agg(F.when(F.count("z") == F.count("*"), F.sum(c("w") * c("z"))).alias("ele_"))
    return points.join(got, key, "left").select(*[k for k in points.columns if k != "ele"], c("ele_").alias("ele"))


def sampled_raster(points: DataFrame, key: list[str], cells: DataFrame, width: int, height: int, crs: tuple, transform: tuple[float, ...]) -> DataFrame:
    """sampled() on a grid in any supported system, turned or not: transform is
    (x0, dx_col, dx_row, y0, dy_col, dy_row), crs what crs_of_text() gives."""
    x0, dx_col, dx_row, y0, dy_col, dy_row = transform
    det = dx_col * dy_row - dx_row * dy_col
    x, y = from_lonlat(F.col("lon"), F.col("lat"), crs)
    x, y = x - x0, y - y0
    # Grid coordinates: columns to the east and rows to the north of the lower left corner.
    flat = points.select(*key, ((x * dy_row - y * dx_row) / det).alias("lon"), (F.lit(float(height)) - (y * dx_col - x * dy_col) / det).alias("lat"))
    got = sampled(flat, key, cells, 0.0, 0.0, 1.0, width, height).select(*key, F.col("ele").alias("ele_"))
    return points.join(got, key, "left").select(*[k for k in points.columns if k != "ele"], F.col("ele_").alias("ele"))


def mosaic(*samples: Column) -> Column:
    """The first source that has a value."""
    return F.coalesce(*samples)


def inferred_terrain(terrain: Column, confidence: Column, road: Column, max_grade: Column, kind: Column) -> Column:
    """struct (terrain, confidence): an explicit terrain of 0.85 or more stays; else what
    road exposure and grade say, unless that is less sure than what there is."""
    guess = lambda t, c: F.struct(F.lit(t).alias("terrain"), F.lit(c).alias("confidence"))
    new = F.when(road >= 0.75, guess("road", 0.70)).when(max_grade >= 0.32, guess("scramble", 0.52)).when(max_grade >= 0.22, guess("talus", 0.45)).when(pathless(kind), guess("unknown", 0.0)).otherwise(guess("trail", 0.35))
    old = F.struct(terrain.alias("terrain"), confidence.alias("confidence"))
    keep = ((terrain != "unknown") & (confidence >= 0.85)) | (new["confidence"] < confidence)
    return F.when(keep, old).otherwise(new)


def merged_evidence(evidence: DataFrame) -> DataFrame:
    """(edge_id, terrain, rationale, provenance, confidence): one row of each, the surest."""
    return evidence.groupBy("edge_id", "terrain", "rationale", "provenance").agg(F.max("confidence").alias("confidence"))


def terrarium(red: Column, green: Column, blue: Column) -> Column:
    """Metres of a height tile's pixel; null where implausible."""
    z = red * 256 + green + blue / 256.0 - 32768
    return F.when(z.between(-150, 9000), z)


def contours(cells: DataFrame, interval: float) -> DataFrame:
    """(row, col, level, x1, y1, x2, y2): marching squares over (row, col, z); x and y in cell
    units from the square's top left centre.  A square whose four sides are all crossed is
    parted by the mean of its corners.

    Each cell gives its value to the four squares that it is a corner of: one exchange."""
    c = F.col
    corners = F.explode(F.array(*[F.struct((c("row") - dr).alias("row"), (c("col") - dc).alias("col"), F.lit(k).alias("k")) for k, (dr, dc) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))]))
    rows = cells.where("z is not null").select("z", corners.alias("s")).select("s.*", "z")
    sq = rows.groupBy("row", "col").agg(*[F.max(F.when(c("k") == k, c("z"))).alias(f"z{k}") for k in range(4)]).where(" and ".join(f"z{k} is not null" for k in range(4)))
    low, high = F.least(*[f"z{k}" for k in range(4)]), F.greatest(*[f"z{k}" for k in range(4)])
    first, last = F.floor(low / interval) + 1, F.floor(high / interval)
    sq = sq.where(first <= last).withColumn("k", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("level", c("k") * F.lit(float(interval)))
    at = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))

    def side(k: int) -> Column:
        a, b, v = c(f"z{k}"), c(f"z{(k + 1) % 4}"), c("level")
        t = (v - a) / F.nullif(b - a, F.lit(0.0))
        (x0, y0), (x1, y1) = at[k], at[(k + 1) % 4]
        return F.when((a >= v) != (b >= v), F.struct((x0 + (x1 - x0) * t).alias("x"), (y0 + (y1 - y0) * t).alias("y")))

    sq = sq.withColumns({f"s{k}": side(k) for k in range(4)})
    pair = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    sides = [c(f"s{k}") for k in range(4)]
    all_cut = sides[0].isNotNull() & sides[1].isNotNull() & sides[2].isNotNull() & sides[3].isNotNull()
    mean_in = (c("z0") + c("z1") + c("z2") + c("z3")) / 4 >= c("level")
    apart = F.when(mean_in == (c("z0") >= c("level")), F.array(pair(sides[0], sides[1]), pair(sides[2], sides[3]))).otherwise(F.array(pair(sides[3], sides[0]), pair(sides[1], sides[2])))
    some = F.filter(F.array(*sides), lambda s: s.isNotNull())
    lines = F.when(all_cut, apart).otherwise(F.array(pair(F.get(some, F.lit(0)), F.get(some, F.lit(1)))))
    return sq.withColumn("l", F.explode(lines)).select("row", "col", "level", c("l.p.x").alias("x1"), c("l.p.y").alias("y1"), c("l.q.x").alias("x2"), c("l.q.y").alias("y2"))


#: Places of a contour that are as near as this share of a cell are one.
KNOTS_PER_CELL = 1_000_000
#: What smoothing takes of a point and of each neighbour.
OWN, NEIGHBOUR = 0.64, 0.18


def _ranked(links: DataFrame) -> DataFrame:
    """(d, tail, dist, least): of directed parts (d, next) the last one of their list, the steps to
    it and the smallest d from each on; parts of a ring have no tail and their ring's smallest.

    Pointer jumping: a round doubles how far each part looks, so rounds grow with the logarithm
    of the longest list."""
    c = F.col
    at = stored(links.select("d", "next", c("d").alias("tail"), F.lit(0).cast("bigint").alias("dist"), c("d").alias("least")), "links")
    while True:
        far = at.select(c("d").alias("f"), c("next").alias("f_next"), c("tail").alias("f_tail"), c("dist").alias("f_dist"), c("least").alias("f_least"))
        rows = at.join(far, c("next") == c("f"), "left")
        go = c("f").isNotNull()
        after = stored(rows.select("d", F.when(go, c("f_next")).alias("next"), F.when(go, c("f_tail")).otherwise(c("tail")).alias("tail"), F.when(go, c("dist") + c("f_dist") + 1).otherwise(c("dist")).alias("dist"), F.least("least", F.coalesce("f_least", "least")).alias("least"), (go & (c("f_next").isNull() | (c("f_least") < c("least")))).alias("moved")), "links")
        dropped(at)
        at = after.drop("moved")
        if after.where("moved").isEmpty():
            return at.select("d", F.when(c("next").isNull(), c("tail")).alias("tail"), "dist", "least")


def contour_lines(segments: DataFrame) -> DataFrame:
    """(level, line, pos, x, y, closed): contours() chained to lines, in cells of the whole grid; a
    ring's first point is also its last.  A place where more than two parts meet ends lines.

    Every part is there in both directions; of a line's two orders the one whose first part is
    the smaller is kept."""
    c = F.col
    knot = lambda v: F.round(v * KNOTS_PER_CELL).cast("bigint")
    key = F.struct("level", "row", "col", "x1", "y1", "x2", "y2")
    rows = segments.withColumns({"ax": c("col") + c("x1"), "ay": c("row") + c("y1"), "bx": c("col") + c("x2"), "by": c("row") + c("y2")})
    rows = rows.withColumn("id", F.shiftright(F.xxhash64(key), 2)).where((knot(c("ax")) != knot(c("bx"))) | (knot(c("ay")) != knot(c("by"))))
    ways = F.array(F.struct((c("id") * 2).alias("d"), c("ax").alias("x"), c("ay").alias("y"), c("bx").alias("tx"), c("by").alias("ty")), F.struct((c("id") * 2 + 1).alias("d"), c("bx").alias("x"), c("by").alias("y"), c("ax").alias("tx"), c("ay").alias("ty")))
    parts = stored(rows.select("level", F.explode(ways).alias("w")).select("level", "w.*").withColumns({"u": F.struct("level", knot(c("x")).alias("x"), knot(c("y")).alias("y")), "v": F.struct("level", knot(c("tx")).alias("x"), knot(c("ty")).alias("y"))}), "parts")
    two = parts.groupBy("u").agg(F.count("*").alias("n"), F.min("d").alias("p"), F.max("d").alias("q")).where("n = 2")
    other = F.when(F.shiftright("p", 1) == F.shiftright("d", 1), c("q")).otherwise(c("p"))
    links = stored(parts.select("d", "v").join(two.withColumnRenamed("u", "v"), "v", "left").select("d", F.when(c("n") == 2, other).alias("next")), "links")
    first = stored(_ranked(links), "ranks")
    # rings are cut before their smallest part
    heads = first.where("tail is null and d = least").select(c("d").alias("next"), F.lit(True).alias("cut"))
    ranks = _ranked(links.join(heads, "next", "left").select("d", F.when(c("cut").isNull(), c("next")).alias("next")))
    ranks = stored(ranks.join(first.select("d", c("tail").isNull().alias("closed"), c("least").alias("ring")), "d"), "ranks")
    lists = ranks.groupBy("tail").agg(F.max_by("d", "dist").alias("head"), F.max("dist").alias("most"), F.max("closed").alias("closed"))
    back = ranks.select((c("d").bitwiseXOR(F.lit(1))).alias("head"), c("ring").alias("turned"))
    # an open line's other order starts with its tail turned round; a ring's with that ring's smallest
    kept = lists.join(back, "head").where(F.when(c("closed"), c("head") < c("turned")).otherwise(c("head") <= c("tail").bitwiseXOR(F.lit(1))))
    rows = ranks.select("d", "tail", "dist").join(kept.select("tail", "head", "most", "closed"), "tail").join(parts, "d")
    pos = (c("most") - c("dist")).cast("int")
    start = rows.select("level", c("head").alias("line"), pos.alias("pos"), "x", "y", "closed")
    end = rows.where("dist = 0").select("level", c("head").alias("line"), (pos + 1).alias("pos"), c("tx").alias("x"), c("ty").alias("y"), "closed")
    return start.union(end)


def smoothed(lines: DataFrame) -> DataFrame:
    """contour_lines() with each point drawn towards its neighbours; open lines keep their ends,
    and lines of fewer than three different points stay as they are."""
    c = F.col
    w = Window.partitionBy("line").orderBy("pos")
    whole = Window.partitionBy("line")
    rows = lines.withColumns({"n": F.count("*").over(whole)})
    for k in ("x", "y"):
        # the ring's neighbour across its seam: the last point but one, and the second
        rows = rows.withColumns({f"a{k}": F.coalesce(F.lag(k).over(w), F.when(c("closed"), F.max(F.when(c("pos") == c("n") - 2, c(k))).over(whole))), f"b{k}": F.coalesce(F.lead(k).over(w), F.when(c("closed"), F.max(F.when(c("pos") == 1, c(k))).over(whole)))})
    few = F.when(c("closed"), c("n") - 1).otherwise(c("n")) < 3
    new = lambda k: F.when(few | c(f"a{k}").isNull() | c(f"b{k}").isNull(), c(k)).otherwise((c(f"a{k}") + c(f"b{k}")) * NEIGHBOUR + c(k) * OWN).alias(k)
    return rows.select("level", "line", "pos", new("x"), new("y"), "closed")
