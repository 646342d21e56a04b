"""From drafts of lines to a network: contraction, conflation, vertices and edges, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.spatial import parallels
from cairn.state import stored


def newest(elements: DataFrame) -> DataFrame:
    """Of shards' elements (type, id, version, body) the highest version of each, of equal
    versions the larger body: the extract's merge.  Combines before its exchange."""
    best = F.max(F.struct("version", "body")).alias("b")
    return elements.groupBy("type", "id").agg(best).select("type", "id", "b.version", "b.body")


def contracted(points: DataFrame) -> DataFrame:
    """Ways cut at shared nodes: (way_id, part, pos, node, lon, lat) from (way_id, pos, node,
    lon, lat).  A node used more than once ends one part and starts the next."""
    c = F.col
    uses = points.groupBy("node").agg(F.count("*").alias("uses"))
    w = Window.partitionBy("way_id").orderBy("pos")
    rows = points.join(uses, "node").withColumn("last", F.lead("pos").over(w).isNull()).withColumn("first", F.lag("pos").over(w).isNull())
    cut = (c("uses") > 1) & ~c("first") & ~c("last")
    rows = rows.withColumn("part", F.coalesce(F.sum(cut.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("cut", cut)
    # A cut node stands in both parts that it joins.
    parts = F.when(c("cut"), F.array(c("part"), c("part") + 1)).otherwise(F.array("part"))
    return rows.select("way_id", F.explode(parts).alias("part"), "pos", "node", "lon", "lat").withColumn("part", F.col("part").cast("int"))


def conflated(segments: DataFrame, size: float, tolerance_m: float = 8.0, least_cosine: float = 0.94) -> tuple[DataFrame, DataFrame]:
    """(kept segments, decisions (seg_id, twin, separation_m)): strata merge in order of
    precedence; a segment that runs alongside one of a stratum before it goes, and its
    twin is corroborated.  Within a stratum nothing is compared.

    A loop over precedences, of which sources have a handful; each step is a cell join."""
    order = [r["precedence"] for r in segments.select("precedence").distinct().orderBy("precedence").collect()]
    kept, found = None, []
    for p in order:
        layer = segments.where(F.col("precedence") == p)
        if kept is None:
            kept = stored(layer, "kept")
            continue
        twins = stored(parallels(layer, kept, size, tolerance_m, least_cosine), "twins")
        found.append(twins)
        kept = stored(kept.unionByName(layer.join(twins.select("seg_id"), "seg_id", "left_anti")), "kept")
    none = kept.limit(0).select("seg_id", F.col("seg_id").alias("twin"), F.lit(0.0).alias("separation_m"))
    return kept, reduce(DataFrame.union, found, none)


def corroborated(first: Column, other: Column, unknown: str = "unknown") -> Column:
    """What is known of an attribute: the preferred source's value, else the other's."""
    return F.coalesce(F.nullif(first, F.lit(unknown)), other, F.lit(unknown))


def assembled(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of drafts (draft_id, pos, lon, lat), one line each.

    Ends at the same coordinates, or with the same `key` where a draft gives one, are one
    vertex; its id is the hash of that, so that no global numbering is needed.  Of drafts
    with the same ends and points (either way round) the smallest id is the edge; n_drafts
    counts them."""
    p = F.struct("pos", "lon", "lat")
    lines = drafts.groupBy("draft_id").agg(F.array_sort(F.collect_list(p)).alias("pts"), F.first("key_a").alias("key_a"), F.first("key_b").alias("key_b"))
    end = lambda i, key: F.xxhash64(F.coalesce(F.col(key), F.concat_ws(",", F.element_at("pts", i)["lon"].cast("string"), F.element_at("pts", i)["lat"].cast("string"))))
    lines = lines.withColumn("a", end(1, "key_a")).withColumn("b", end(-1, "key_b"))
    text = F.transform("pts", lambda q: F.concat_ws(" ", q["lon"].cast("string"), q["lat"].cast("string")))
    there, back = F.array_join(text, ","), F.array_join(F.reverse(text), ",")
    lines = lines.withColumn("support", F.least(there, back))
    edges = lines.groupBy("support").agg(F.min(F.struct("draft_id", "a", "b", "pts")).alias("e"), F.count("*").alias("n_drafts")).select(F.col("e.draft_id").alias("edge_id"), "e.a", "e.b", "n_drafts", F.col("e.pts").alias("pts"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.element_at("pts", 1).alias("p")), F.struct(F.col("b").alias("v"), F.element_at("pts", -1).alias("p")))).alias("x"))
    vertices = ends.groupBy("x.v").agg(F.min(F.struct("x.p.lon", "x.p.lat")).alias("p")).select("v", "p.lon", "p.lat")
    return vertices, edges


def missing_receipts(wanted: DataFrame, receipts: DataFrame) -> DataFrame:
    """(provider, region) pairs whose receipt is absent or differs in schema, revision,
    request or content: what has to be fetched again."""
    keys = ["provider", "region", "schema", "revision", "request"]
    return wanted.join(receipts.where("content_sha256 is not null"), keys, "left_anti").select("provider", "region")
