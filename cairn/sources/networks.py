"""Networks and overlays: GeoJSON features, OSM XML, height grids, and what a file is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import crs, vocab
from cairn.sources import binary

PARTS = "array<array<array<double>>>"
#: Properties of shapefiles that may be numbers.
MEASURES = ["confidence", "terrain_confidence", "road_exposure", "road", "tolerance_m", "landcover", "land_cover", "landcover_class", "land_cover_class", "nlcd", "nlcd_code", "gridcode", "class", "class_name", "cover", "cover_type"]


def features(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, p map<string,string>, kind, coordinates): features of FeatureCollections,
    in the file's order.  Values of p that are no strings are their JSON text."""
    schema = "type string, features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("j"))
    rows = files.select("path", F.posexplode("j.features").alias("pos", "f"))
    return rows.select("path", "pos", F.col("f.id").alias("id"), F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("p"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def _said(*keys: str) -> Column:
    """The first of these properties that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.col("p")[k]), F.lit("")) for k in keys])


def truth(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "yes", "y", "1", "t"), True).when(t.isin("false", "no", "n", "0", "f"), False)


def _unit(text: Column) -> Column:
    x = text.try_cast("double")
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def _lines() -> Column:
    """array of lines (arrays of [lon, lat, ele]); other geometries are an error."""
    one = F.array(F.from_json("coordinates", "array<array<double>>"))
    many = F.from_json("coordinates", PARTS)
    return F.when(F.col("kind") == "LineString", one).when(F.col("kind") == "MultiLineString", many).otherwise(F.raise_error(F.concat(F.lit("not a line: "), F.coalesce("kind", F.lit("no geometry")))))


def _points(parts: Column) -> Column:
    return F.transform(parts, lambda c: F.struct(F.get(c, F.lit(0)).alias("lon"), F.get(c, F.lit(1)).alias("lat"), F.get(c, F.lit(2)).alias("ele")))


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """One draft per line or part of a line, with normalised attributes and the defaults of
    a network: access unknown, confidence 0.75."""
    return _network(features(spark, path).withColumn("lines", F.transform(_lines(), _points)), 0.75)


def read_shapefile_network(spark: SparkSession, path: str) -> DataFrame:
    """The same of shapefiles, projected from what their .prj says; confidence 0.78.  Properties
    are texts, or for measures numbers; shapes that are no lines are an error."""
    rows = _shapes(spark, path)
    bad = F.raise_error(F.concat(F.lit("not a line: "), F.coalesce("kind", F.lit("no geometry"))))
    return _network(rows.withColumn("lines", F.when(F.col("kind") == "line", F.col("lines")).otherwise(bad)), 0.78)


def _shapes(spark: SparkSession, path: str) -> DataFrame:
    """binary.shape_rows() as features(): points in degrees under `lines`, numbers as texts
    under the names that have measures."""
    rows, out = binary.shape_rows(spark, path), None
    systems: dict[tuple, list[str]] = {}
    for file, text in binary.prj_text(path).items():
        systems.setdefault(crs.crs_of_text(text), []).append(file)
    for system, files in systems.items():
        part = rows.where(F.col("path").isin(files)).withColumn("lines", F.transform("parts", _placed(system)))
        out = part if out is None else out.unionByName(part)
    numbers = F.transform_values(F.map_filter("n", lambda k, v: k.isin(MEASURES)), lambda k, v: F.when(k == "road", F.when(v == 1, "true").otherwise("false")).when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string")))
    p = F.map_concat(F.map_filter("p", lambda k, v: ~F.map_contains_key(numbers, k)), numbers)
    return out.select("path", "pos", F.lit(None).cast("string").alias("id"), p.alias("p"), "n", "kind", "lines")


def _placed(system: tuple) -> Callable[[Column], Column]:
    """A part's points (x, y, z) as points in degrees."""

    def place(p: Column) -> Column:
        lon, lat = crs.to_lonlat(p["x"], p["y"], system)
        return F.struct(lon.alias("lon"), lat.alias("lat"), p["z"].alias("ele"))

    return lambda part: F.transform(part, place)


def _network(features: DataFrame, confidence: float) -> DataFrame:
    """Drafts of rows (path, pos, id, p, lines)."""
    terrain_tag, surface = _said("terrain"), _said("surface")
    terrain = F.when(terrain_tag.isNotNull(), vocab.from_tag(terrain_tag, vocab.TERRAIN)).when(surface.isNotNull(), vocab.from_tag(surface, vocab.TERRAIN)).otherwise("unknown")
    sure = F.when(terrain == "unknown", 0.0).when(terrain_tag.isNotNull(), 0.90).when(surface.isNotNull(), 0.82).otherwise(0.45)
    rows = features.select(
        "path", "pos",
        F.coalesce("id", _said("id"), _said("name"), F.concat(F.lit("feature-"), F.col("pos"))).alias("id"),
        _said("source").alias("source"),
        vocab.from_tag(_said("way_kind", "highway"), vocab.WAY_KIND).alias("way_kind"),
        vocab.from_tag(_said("realm"), vocab.WAY_REALM).alias("realm"),
        vocab.from_tag(_said("trail_standing", "standing"), vocab.TRAIL_STANDING).alias("standing"),
        vocab.from_tag(_said("trail_marking", "marking", "trailblazed", "asset"), vocab.TRAIL_MARKING).alias("marking"),
        terrain.alias("terrain"), surface.alias("surface"),
        F.coalesce(_unit(_said("terrain_confidence")), sure).alias("terrain_confidence"),
        F.coalesce(vocab.from_tag(_said("access"), vocab.ACCESS), F.lit("unknown")).alias("access"),
        vocab.from_tag(_said("travel", "travel_direction", "direction", "oneway", "one_way"), vocab.TRAVEL).alias("travel"),
        F.coalesce(_unit(_said("confidence")), F.lit(confidence)).alias("confidence"),
        F.coalesce(_unit(_said("road_exposure")), truth(_said("road")).cast("double"), (terrain == "road").cast("double")).alias("road_exposure"),
        F.posexplode("lines").alias("part", "line"),
    )
    return rows


def _rings() -> Column:
    """Outer rings, or lines, of an overlay's geometry."""
    k = F.col("kind")
    deep = F.transform(F.from_json("coordinates", f"array<{PARTS}>"), lambda p: F.get(p, F.lit(0)))
    flat = F.from_json("coordinates", PARTS)
    return F.when(k == "Polygon", F.slice(flat, 1, 1)).when(k == "MultiPolygon", deep).when(k == "MultiLineString", flat).when(k == "LineString", F.array(F.from_json("coordinates", "array<array<double>>"))).otherwise(F.raise_error(F.concat(F.lit("no overlay geometry: "), F.coalesce("kind", F.lit("none")))))


def _shaped(spark: SparkSession, path: str, form: str) -> DataFrame:
    """(path, pos, id, p, is_ring, lines): features of GeoJSON files or rows of shapefiles."""
    if form == "shapefile":
        bad = F.raise_error(F.concat(F.lit("no overlay geometry: "), F.coalesce("kind", F.lit("none"))))
        return _shapes(spark, path).select("path", "pos", "id", "p", (F.col("kind") == "polygon").alias("is_ring"), F.when(F.col("kind").isin("polygon", "line"), F.col("lines")).otherwise(bad).alias("lines"))
    return features(spark, path).select("path", "pos", "id", "p", F.col("kind").isin("Polygon", "MultiPolygon").alias("is_ring"), F.transform(_rings(), _points).alias("lines"))


def _overlay(rows: DataFrame, *columns: Column) -> DataFrame:
    tolerance = F.coalesce(_said("tolerance_m").try_cast("double"), F.lit(20.0)).alias("tolerance_m")
    return rows.select("path", "pos", *columns, tolerance, "is_ring", "lines").select("*", F.posexplode("lines").alias("part", "geometry")).drop("lines")


# Properties that tell whether a permit is needed.
PERMIT_KEYS = ["permit_required", "requires_permit", "permit", "permits", "reservation_required", "requires_reservation", "reservation", "reservations", "timed_entry_required", "timed_entry", "quota_required"]
LANDCOVER_KEYS = ["landcover", "land_cover", "landcover_class", "land_cover_class", "nlcd", "nlcd_code", "gridcode", "class", "class_name", "cover", "cover_type"]


def read_access_overlays(spark: SparkSession, path: str, form: str = "geojson") -> DataFrame:
    """Access overlays; without access, status or a permit property they are closed."""
    said = _said("access", "status")
    permit = F.coalesce(*[truth(F.col("p")[k]) for k in PERMIT_KEYS])
    access = F.when(said.isNotNull(), vocab.from_tag(said, vocab.ACCESS)).when(permit, "restricted").when(~permit, "open").otherwise("closed")
    from cairn.functions.calendar import minute, weekday_bits

    def read(value, *keys: str):
        """What is said, or an error where it can't be read."""
        said = _said(*keys)
        wrong = F.raise_error(F.concat(F.lit(f"feature cannot be read: {keys[0]} = "), said))
        return F.when(said.isNull(), F.lit(None)).otherwise(F.coalesce(value(said), wrong))

    def both(kind: str, value):
        """The two ends of a window, of which none may be missing alone."""
        first, last = _said(f"{kind}_from"), _said(f"{kind}_to")
        half = F.when(first.isNull() != last.isNull(), F.raise_error(F.lit(f"feature has half a window: {kind}")))
        return [F.coalesce(half, read(value, f"{kind}_{end}")).alias(f"{kind}_{end}") for end in ("from", "to")]

    part = lambda x, i: F.split_part(x, F.lit("-"), F.lit(i)).try_cast("int")
    month_day = lambda x: F.when(part(x, 1).between(1, 12) & part(x, 2).between(1, 31), part(x, 1) * 100 + part(x, 2))
    date, time = lambda x: x.try_cast("date"), lambda x: F.when(minute(x).isNotNull(), x)
    window = F.struct(
        read(date, "active_from", "from").alias("from"), read(date, "active_to", "to").alias("to"), *both("season", month_day),
        read(weekday_bits, "weekdays", "days").alias("weekdays"), *both("time", time),
    )
    travel = _said("travel", "travel_direction", "direction", "oneway", "one_way")
    return _overlay(_shaped(spark, path, form), F.coalesce(_said("name"), _said("id")).alias("name"), access.alias("access"), F.when(travel.isNotNull(), vocab.from_tag(travel, vocab.TRAVEL)).alias("travel"), F.coalesce(_unit(_said("confidence")), F.lit(0.9)).alias("confidence"), window.alias("window"))


def read_terrain_overlays(spark: SparkSession, path: str, form: str = "geojson") -> DataFrame:
    """Terrain overlays: terrain or surface, else land cover; an unknown terrain is an error."""
    direct = F.coalesce(*[F.nullif(vocab.from_tag(_said(k), vocab.TERRAIN), F.lit("unknown")) for k in ("terrain", "surface")])
    cover = F.coalesce(*[F.nullif(vocab.terrain_from_landcover(F.col("p")[k]), F.lit("unknown")) for k in LANDCOVER_KEYS])
    terrain = F.coalesce(direct, cover, F.raise_error(F.concat(F.lit("unknown terrain at feature "), F.col("pos").cast("string"))))
    return _overlay(_shaped(spark, path, form), terrain.alias("terrain"), _said("surface").alias("surface"), F.coalesce(_unit(_said("confidence")), F.lit(0.75)).alias("confidence"))


def read_context_overlays(spark: SparkSession, path: str, form: str = "geojson") -> DataFrame:
    """Road and water lines; features that are neither are dropped.  Shapefiles that don't say
    so in a row are of the kind that their path names."""
    kind = vocab.from_tag(_said("kind", "context", "type"), vocab.CROSSING_KIND)
    if form == "shapefile":
        named = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.lower("path").contains(w))
        kind = F.coalesce(kind, F.when(named(["road", "street"]), "road").when(named([*WATER, "creek", "river"]), "water"))
        rows = _shapes(spark, path).where("kind = 'line'").withColumnRenamed("kind", "shape")
    else:
        rows = features(spark, path).withColumn("lines", F.transform(_lines(), _points)).drop("kind")
    rows = rows.withColumn("kind", kind).where("kind is not null")
    return rows.select("path", "pos", "kind", F.coalesce(_said("id"), F.col("id")).alias("source_id"), F.coalesce(_unit(_said("confidence")), F.lit(0.78)).alias("confidence"), F.posexplode("lines").alias("part", "line"))


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations) of OSM XML: (id, lon, lat, tags), (id, refs, tags), (id, members,
    tags).  Spark's XML scan splits large files at the elements."""

    def scan(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    t = "tag array<struct<_k:string,_v:string>>"
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda x: F.struct(x["_k"], x["_v"]))).alias("tags")
    nodes = scan("node", f"_id bigint, _lon double, _lat double, {t}").select(F.col("_id").alias("id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), tags)
    ways = scan("way", f"_id bigint, nd array<struct<_ref:bigint>>, {t}").select(F.col("_id").alias("id"), F.col("nd._ref").alias("refs"), tags)
    relations = scan("relation", f"_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, {t}").select(F.col("_id").alias("id"), F.col("member").alias("members"), tags)
    return nodes, ways, relations


def osm_drafts(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """(way_id, pos, node, lon, lat, w struct): the points of walkable ways, for
    operators.network.contracted().  A way that names a missing node is an error."""
    route = relations.where((F.col("tags")["type"] == "route") & F.col("tags")["route"].isin("hiking", "foot", "walking"))
    members = route.select(F.explode("members").alias("m")).where("m._type = 'way'").select(F.col("m._ref").alias("id")).distinct().withColumn("hiking", F.lit(True))
    walk = ways.join(members, "id", "left").withColumn("w", vocab.walkway(F.col("tags"), F.coalesce("hiking", F.lit(False)))).where("w is not null and size(refs) > 1")
    refs = walk.select(F.col("id").alias("way_id"), "w", F.posexplode("refs").alias("pos", "node"))
    both = refs.join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node", "left")
    lon = F.when(F.col("lon").isNull(), F.raise_error(F.concat(F.lit("missing node "), F.col("node").cast("string")))).otherwise(F.col("lon"))
    return both.select("way_id", "pos", "node", lon.alias("lon"), "lat", "w")


def osm_restrictions(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(relation_id, rule, from_way, via_node, to_way): turn restrictions for walkers.  rule is
    only or no; of members with one role the last counts, and a restriction whose node is not
    there, or that has no way from or to, tells nothing."""
    t = F.col("tags")
    rows = relations.where((t["type"] == "restriction") & (t["restriction:foot"] != ""))
    last = lambda kind, role: F.element_at(F.concat(F.array(F.lit(None).cast("bigint")), F.transform(F.filter("members", lambda m: (m["_type"] == kind) & (m["_role"] == role)), lambda m: m["_ref"])), -1)
    # of nodes the last that is there
    via = rows.select("id", F.posexplode(F.filter("members", lambda m: (m["_type"] == "node") & (m["_role"] == "via"))).alias("k", "m")).select("id", "k", F.col("m._ref").alias("node"))
    via = via.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").groupBy("id").agg(F.max_by("node", "k").alias("via_node"))
    rule = F.when(t["restriction:foot"].startswith("only_"), "only").otherwise("no")
    rows = rows.select("id", rule.alias("rule"), last("way", "from").alias("from_way"), last("way", "to").alias("to_way")).where("from_way is not null and to_way is not null")
    return rows.join(via, "id").select(F.col("id").alias("relation_id"), "rule", "from_way", "via_node", "to_way")


# Ways that are context of a network.
OSM_WATER = ["stream", "river", "canal", "drain", "ditch", "brook"]
OSM_ROADS = ["motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service", "track", "road"]


def osm_context(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(way_id, name, kind, confidence, line): water and roads among OSM ways, of two points at
    least.  A way that names a missing node is an error."""
    t = F.col("tags")
    kind = F.when(t["waterway"].isin(OSM_WATER), "water").when(t["highway"].isin(OSM_ROADS), "road")
    name = F.coalesce(t["name"], t["ref"], F.concat(F.lit("osm-way-"), F.col("id").cast("string")))
    rows = ways.select(F.col("id").alias("way_id"), name.alias("name"), kind.alias("kind"), "refs").where("kind is not null and size(refs) > 1")
    both = rows.select("way_id", "name", "kind", F.posexplode("refs").alias("pos", "node")).join(nodes.select(F.col("id").alias("node"), "lon", "lat", _height().alias("ele")), "node", "left")
    lon = F.when(F.col("lon").isNull(), F.raise_error(F.concat(F.lit("missing node "), F.col("node").cast("string")))).otherwise(F.col("lon"))
    points = F.array_sort(F.collect_list(F.struct("pos", lon.alias("lon"), "lat", "ele")))
    line = F.transform(points, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), p["ele"].alias("ele")))
    return both.groupBy("way_id", "name", "kind").agg(line.alias("line")).select("way_id", "name", "kind", F.lit(0.78).alias("confidence"), "line")


def _height() -> Column:
    """A node's height, where its tags say a finite one."""
    ele = F.col("tags")["ele"].try_cast("double")
    return F.when(~F.isnan(ele) & (F.abs(ele) < float("inf")), ele)


def read_grid(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    """(cells (row, col, z), header) of an Arc/Info ASCII grid; z is null where there is no
    data.  Rows count from the north.  Values may be broken over lines anyhow; another number
    of them than the header says is an error.

    The file is read in blocks: how many values each has comes to the driver, with the header,
    and tells where each line's values belong."""
    c = F.col
    lines = spark.read.text(path).select(F.trim("value").alias("v"), c("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).where("v != ''")
    head = {r["k"]: float(r["x"]) for r in lines.where(c("v").rlike("^[A-Za-z]")).select(F.lower(F.element_at(F.split("v", r"\s+"), 1)).alias("k"), F.element_at(F.split("v", r"\s+"), -1).alias("x")).collect()}
    head.setdefault("nodata_value", -9999.0)
    body = lines.where(~c("v").rlike("^[A-Za-z]")).select("b", "i", F.split("v", r"\s+").alias("t"))
    blocks, before = {}, 0
    for r in body.groupBy("b").agg(F.sum(F.size("t")).alias("n")).orderBy("b").collect():  # a row a block
        blocks[r["b"]], before = before, before + r["n"]
    ncols, nrows = int(head["ncols"]), int(head["nrows"])
    if before != ncols * nrows:
        raise ValueError(f"a grid of {ncols} by {nrows} has {before} values")
    start = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])[c("b")] if blocks else F.lit(0)
    w = Window.partitionBy("b").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = body.select("t", (start + F.coalesce(F.sum(F.size("t")).over(w), F.lit(0))).alias("first"))
    cells = rows.select("first", F.posexplode("t").alias("k", "t")).select((c("first") + c("k")).alias("n"), c("t").cast("double").alias("z"))
    cells = cells.select(F.floor(c("n") / ncols).cast("int").alias("row"), (c("n") % ncols).cast("int").alias("col"), "z")
    return cells.withColumn("z", F.when(c("z") != head["nodata_value"], c("z"))), head


# What a file is, by extension and words in its path; the first row that fits.
GEO, OSM, SHP = ["geojson", "json"], ["osm", "osm.pbf"], ["shp"]
COVER = ["terrain", "surface", "landcover", "land-cover", "land_cover"]
WATER = ["hydrology", "water", "stream"]
FILES = [
    (["gpx"], None, "seed-route", "gpx-route"), (["csv"], None, "seed-route", "csv-route"), (["kml", "kmz"], None, "seed-route", "kml-route"),
    (["json"], ["route", "track", "seed", "activity"], "seed-route", "json-route"),
    (GEO, ["closure"], "closure", "geojson-closure-overlay"), (GEO, ["access"], "access", "geojson-access-overlay"), (GEO, COVER, "terrain", "geojson-terrain-overlay"),
    (GEO, ["road"], "road", "geojson-road-context"), (GEO, WATER, "hydrology", "geojson-hydrology-context"), (GEO, None, "trail-network", "geojson-network"),
    (OSM, ["road", "street", "highway"], "road", "osm-road-context"), (OSM, [*WATER, "river", "creek"], "hydrology", "osm-hydrology-context"),
    (["osm"], None, "trail-network", "osm-xml-network"), (["osm.pbf"], None, "trail-network", "osm-pbf-network"),
    (["asc"], None, "elevation", "arc-ascii-elevation"), (["tif", "tiff"], None, "elevation", "geotiff-elevation"), (["vrt"], None, "elevation", "vrt-elevation"),
    (SHP, ["closure"], "closure", "shapefile-closure-layer"), (SHP, ["access", "ownership"], "access", "shapefile-access-overlay"), (SHP, COVER, "terrain", "shapefile-terrain-overlay"),
    (SHP, ["road", "street"], "road", "shapefile-road-context"), (SHP, WATER, "hydrology", "shapefile-hydrology-context"), (SHP, None, "trail-network", "shapefile-network"),
]


def classified(path: Column) -> Column:
    """struct (kind, adapter) of a path, null for a file of no known kind."""
    p = F.lower(path)
    ext = F.when(p.endswith(".osm.pbf"), "osm.pbf").otherwise(F.regexp_extract(p, r"\.([^./]+)$", 1))
    out = None
    for exts, words, kind, adapter in FILES:
        test = ext.isin(exts)
        if words:
            test = test & F.exists(F.array(*[F.lit(w) for w in words]), lambda w: p.contains(w))
        out = (F if out is None else out).when(test, F.struct(F.lit(kind).alias("kind"), F.lit(adapter).alias("adapter")))
    return out
