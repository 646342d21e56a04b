"""Writers: rows to GPX, GeoJSON and WKT text, and graphs as Parquet."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, xml in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(plain), F.lit(xml))
    return out


def gpx(points: DataFrame, key: str, title: Column | None = None) -> DataFrame:
    """(key, gpx): one document with one track segment per key, points in order of pos;
    coordinates have 8 decimals, elevations 2."""
    pt = F.struct("pos", F.concat(F.format_string('<trkpt lat="%.8f" lon="%.8f">', "lat", "lon"), F.coalesce(F.format_string("<ele>%.2f</ele>", "ele"), F.lit("")), F.lit("</trkpt>")).alias("x"))
    pt = F.when(F.col("ele").isNull(), F.struct("pos", F.format_string('<trkpt lat="%.8f" lon="%.8f"></trkpt>', "lat", "lon").alias("x"))).otherwise(pt)
    name = title if title is not None else F.col(key).cast("string")
    body = points.withColumn("name_", name).groupBy(key).agg(F.first("name_").alias("name_"), F.array_join(F.transform(F.array_sort(F.collect_list(pt)), lambda s: s["x"]), "").alias("body"))
    head = '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="cairn" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'
    return body.select(key, F.concat(F.lit(head), escaped(F.col("name_")), F.lit("</name><trkseg>"), "body", F.lit("</trkseg></trk></gpx>")).alias("gpx"))


def wkt_point(lon: Column, lat: Column, ele: Column) -> Column:
    return F.concat(F.lit("POINT Z ("), F.concat_ws(" ", lon.cast("string"), lat.cast("string"), F.coalesce(ele, F.lit(0.0)).cast("string")), F.lit(")"))


def wkt_line(line: Column) -> Column:
    text = F.transform(line, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"), F.coalesce(p["ele"], F.lit(0.0)).cast("string")))
    return F.concat(F.lit("LINESTRING Z ("), F.array_join(text, ", "), F.lit(")"))


def geojson(edges: DataFrame, line: str = "line") -> DataFrame:
    """(feature): a GeoJSON feature per row; all columns but the line are properties."""
    props = [c for c in edges.columns if c != line]
    xy = F.transform(line, lambda p: F.array(p["lon"], p["lat"]))
    return edges.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), F.struct(F.lit("LineString").alias("type"), xy.alias("coordinates")).alias("geometry"))).alias("feature"))


def csv_field(text: Column) -> Column:
    """A field as comma-separated files quote it."""
    t = text.cast("string")
    return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(t, F.lit("")))


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables in a new folder below path, and then a line in path/commits that names it:
    a reader sees either this state or the one before, never half of one."""
    folder = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    vertices.write.parquet(f"{path}/{folder}/vertices")
    edges.write.parquet(f"{path}/{folder}/edges")
    vertices.sparkSession.createDataFrame([(folder,)], "value string").coalesce(1).write.mode("append").text(f"{path}/commits")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The (vertices, edges) that were committed last."""
    folder = spark.read.text(f"{path}/commits").agg(F.max("value")).first()[0]
    return spark.read.parquet(f"{path}/{folder}/vertices"), spark.read.parquet(f"{path}/{folder}/edges")
