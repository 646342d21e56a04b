"""Route files as points (path, pos, lon, lat, ele) with their metadata.

Each reader takes a folder or files; a file is one row of the scan, so files are read in
parallel, and a malformed one fails the job with its path."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of columns and keys as files spell them.
LON, LAT, ELE = ["lon", "lng", "long", "longitude"], ["lat", "latitude"], ["ele", "elevation", "elevation_m", "alt"]
#: Bytes of the KML in an archive at most.
KML_BYTES = 32 << 20
CONTAINERS = ["points", "coordinates", "track", "route", "segments", "trackpoints", "waypoints", "geometry", "path", "data"]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _points(df: DataFrame, *keep: str) -> DataFrame:
    """From (path, points array<struct<lon,lat,ele>>): one row per point, checked."""
    bad = F.exists("points", lambda p: p["lon"].isNull() | p["lat"].isNull() | ~p["lon"].between(-180, 180) | ~p["lat"].between(-90, 90))
    ok = F.when((F.size("points") < 2) | bad, F.raise_error(F.concat(F.lit("not a route of two points or more: "), F.col("path")))).otherwise(F.col("points"))
    return df.select("path", *keep, F.posexplode(ok).alias("pos", "p")).select("path", *keep, "pos", "p.lon", "p.lat", "p.ele")


def _point(lon: Column, lat: Column, ele: Column) -> Column:
    return F.struct(lon.try_cast("double").alias("lon"), lat.try_cast("double").alias("lat"), ele.try_cast("double").alias("ele"))


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """The one track segment or route of each file; another number of them is an error."""
    pt = "array<struct<_lon:double,_lat:double,ele:double>>"
    seg = f"array<struct<trkpt:{pt}>>"
    schema = f"metadata struct<name:string,desc:string>, trk array<struct<name:string,desc:string,trkseg:{seg}>>, rte array<struct<name:string,desc:string,rtept:{pt}>>"
    x = _files(spark, path).withColumn("x", F.from_xml("value", schema))
    segs = F.flatten(F.transform(F.coalesce("x.trk", F.array().cast(f"array<struct<name:string,desc:string,trkseg:{seg}>>")), lambda t: F.transform(t["trkseg"], lambda s: s["trkpt"])))
    routes = F.transform(F.coalesce("x.rte", F.array().cast(f"array<struct<name:string,desc:string,rtept:{pt}>>")), lambda r: r["rtept"])
    x = x.withColumn("all", F.concat(F.coalesce(segs, F.array().cast(f"array<{pt}>")), routes))
    one = F.when(F.size("all") != 1, F.raise_error(F.concat(F.lit("not one track segment or route: "), F.col("path")))).otherwise(F.element_at("all", 1))
    title = F.coalesce("x.metadata.name", F.get("x.trk", F.lit(0))["name"], F.get("x.rte", F.lit(0))["name"])
    return _points(x.select("path", title.alias("title"), F.transform(one, lambda p: _point(p["_lon"], p["_lat"], p["ele"])).alias("points")), "title")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows split at comma, semicolon or tab; with a header that names a longitude and a
    latitude, else lon, lat[, ele].  Lines that start with # are comments."""
    lines = F.filter(F.transform(F.split("value", "\r?\n"), F.trim), lambda s: (s != "") & ~s.startswith("#"))
    x = _files(spark, path).select("path", lines.alias("lines")).withColumn("head", F.transform(F.split(F.lower(F.element_at("lines", 1)), "[,;\t]"), F.trim))
    at = lambda names: F.array_position(F.transform("head", lambda h: h.isin(names)), True)
    x = x.withColumns({"i": at(LON).cast("int"), "j": at(LAT).cast("int"), "k": at(ELE).cast("int")}).withColumn("named", (F.col("i") > 0) & (F.col("j") > 0))
    rows = F.when(F.col("named"), F.slice("lines", F.lit(2), F.size("lines"))).otherwise(F.col("lines"))
    x = x.withColumns({"i": F.when(F.col("named"), F.col("i")).otherwise(1), "j": F.when(F.col("named"), F.col("j")).otherwise(2), "k": F.when(F.col("named"), F.col("k")).otherwise(3)})

    def parse(line: Column) -> Column:
        f = F.split(line, "[,;\t]")
        part = lambda i: F.trim(F.get(f, i - 1))
        return _point(part(F.col("i")), part(F.col("j")), F.when(F.col("k") > 0, part(F.col("k"))))

    return _points(x.select("path", F.transform(rows, parse).alias("points")))


def read_kmz(spark: SparkSession, path: str) -> DataFrame:
    """The same of the first .kml member of each archive, of 32 MB at most."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    @F.udf("string")  # one call a file
    def text(content: bytes, name: str) -> str:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            member = next((m for m in z.infolist() if m.filename.lower().endswith(".kml")), None)
            if member is None:
                raise ValueError(f"no KML in {name}")
            with z.open(member) as f:
                raw = f.read(KML_BYTES + 1)
        if len(raw) > KML_BYTES:
            raise ValueError(f"more than {KML_BYTES} bytes of KML in {name}")
        return raw.decode()

    return _kml(files.select("path", text("content", "path").alias("value")))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """The first <coordinates> of each file."""
    return _kml(_files(spark, path))


def _kml(files: DataFrame) -> DataFrame:
    found = F.regexp_extract("value", r"(?s)<coordinates[^>]*>(.*?)</coordinates>", 1)
    tuples = F.filter(F.split(F.trim(F.regexp_replace(found, r"\s+", " ")), " "), lambda t: t != "")
    title = F.nullif(F.trim(F.regexp_extract("value", r"(?s)<name>(.*?)</name>", 1)), F.lit(""))

    def parse(t: Column) -> Column:
        f = F.split(t, ",")
        return _point(F.get(f, F.lit(0)), F.get(f, F.lit(1)), F.get(f, F.lit(2)))

    return _points(files.select("path", title.alias("title"), F.transform(tuples, parse).alias("points")), "title")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Points as arrays [lon, lat, ele] or objects with the usual names, at the top or under
    the first of the usual container keys.  Numbers may be strings."""
    v = F.try_parse_json("value")
    spots = ["$"] + [f"$.{k}" for k in CONTAINERS] + [f"$.{a}.{b}" for a in CONTAINERS for b in ("points", "coordinates")]
    raw = F.coalesce(*[F.try_variant_get("v", s, "array<variant>") for s in spots])

    def parse(p: Column) -> Column:
        pick = lambda names, i: F.coalesce(F.try_variant_get(p, f"$[{i}]", "double"), *[F.try_variant_get(p, f"$.{n}", "double") for n in names])
        return _point(pick(LON, 0), pick(LAT, 1), pick(ELE, 2))

    return _points(_files(spark, path).select("path", v.alias("v")).select("path", F.transform(raw, parse).alias("points")))
