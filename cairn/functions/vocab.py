"""Closed vocabularies of tags, as column expressions.

A tag is trimmed and lower-cased, then looked up; what is not listed gets the vocabulary's
default, and so does null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# For each vocabulary the default and the tags of each term.
WAY_KIND = ("unknown", {
    "path": ["path", "trail", "singletrack"],
    "footway": ["footway"],
    "sidewalk": ["sidewalk"],
    "crossing": ["crossing"],
    "track": ["track"],
    "service-road": ["service", "service-road"],
    "pedestrian-street": ["pedestrian", "pedestrian-way"],
    "steps": ["steps", "stairs"],
    "bridleway": ["bridleway"],
    "bushwhack": ["bushwhack", "bushwhacking", "off-trail", "offtrail", "cross-country"],
    "roadway": ["road", "living_street", "residential", "unclassified", "tertiary", "secondary", "primary"],
    "cycleway": ["cycleway", "cycle-way"],
})
WAY_REALM = ("recreational", {"connector": ["connector", "recreational-connector"], "urban": ["urban", "pedestrian", "circulation"]})
GEOMETRY_CLAIM = ("surveyed", {"centerline-proxy": ["centerline-proxy", "road-centerline-proxy", "proxy"]})
CROSSING_CONTROL = ("none", {
    "uncontrolled": ["uncontrolled", "unmarked", "no"],
    "marked": ["marked", "zebra", "uncontrolled-marked"],
    "signals": ["signals", "signal", "traffic-signals"],
    "grade-separated": ["grade-separated", "bridge", "tunnel"],
})
TRAIL_STANDING = ("unknown", {
    "established": ["established", "maintained", "official", "current"],
    "unmaintained": ["unmaintained", "disused", "overgrown"],
    "informal": ["informal", "social", "social-trail", "desire-path"],
    "historical": ["historical", "abandoned", "removed"],
})
TRAIL_MARKING = ("unknown", {
    "marked": ["marked", "marked trail", "blazed", "yes", "symbols", "poles", "cairns"],
    "unmarked": ["unmarked", "unmarked trail", "unblazed", "no", "none"],
})
TERRAIN = ("unknown", {
    "trail": ["trail", "path", "singletrack"],
    "forest": ["forest", "woods"],
    "alpine": ["alpine", "tundra"],
    "talus": ["talus", "scree", "boulder"],
    "scramble": ["scramble", "technical"],
    "pavement": ["pavement", "paved", "asphalt"],
    "road": ["road", "service-road", "gravel-road"],
    "water": ["water", "ford"],
})
ACCESS = ("unknown", {"open": ["open", "yes", "permissive"], "restricted": ["restricted", "permit"], "closed": ["closed", "no"], "private": ["private"]})
TRAVEL = ("both", {"forward": ["forward", "with", "yes", "true", "1"], "backward": ["backward", "reverse", "against", "-1"]})
CROSSING_KIND = (None, {"road": ["road", "roads", "pavement", "highway", "street"], "water": ["water", "hydrology", "stream", "creek", "river", "ford"]})
# Land-cover names without punctuation, and codes of the national land cover.
LANDCOVER = (None, {
    "water": ["openwater", "emergentherbaceouswetlands", "wetlands"],
    "alpine": ["perennialicesnow", "shrubscrub", "grasslandherbaceous", "sedgeherbaceous", "lichens", "moss", "pasturehay", "cultivatedcrops"],
    "pavement": ["developedopenspace", "developedlowintensity", "developedmediumintensity", "developedhighintensity", "developed", "urban"],
    "talus": ["barrenland", "rocksandclay", "barren", "bedrock", "rock"],
    "forest": ["deciduousforest", "evergreenforest", "mixedforest", "forestland", "woodywetlands"],
})
NLCD = {"water": [11, 95], "alpine": [12, 52, 71, 72, 73, 74, 81, 82], "pavement": [21, 22, 23, 24], "talus": [31], "forest": [41, 42, 43, 90]}


def plain(tag: Column) -> Column:
    """Trimmed and, of A to Z, lower-cased."""
    return F.translate(F.trim(tag), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def canonical(tag: Column) -> Column:
    """The ASCII letters and digits alone, lower-cased."""
    return F.lower(F.regexp_replace(tag, "[^0-9A-Za-z]", ""))


def lookup(key: Column, vocabulary: tuple[str | None, dict[str, list]]) -> Column:
    default, terms = vocabulary
    out = None
    for term, keys in terms.items():
        out = (F if out is None else out).when(key.isin(keys), F.lit(term))
    return out.otherwise(F.lit(default))


def from_tag(tag: Column, vocabulary: tuple[str | None, dict[str, list[str]]]) -> Column:
    return lookup(plain(tag), vocabulary)


def terrain_from_landcover(tag: Column) -> Column:
    """A terrain tag, else a land-cover code, else a land-cover name, else unknown."""
    direct = from_tag(tag, TERRAIN)
    code = F.when(F.trim(tag).rlike(r"^\+?[0-9]+$"), F.trim(tag).try_cast("int"))
    named = F.coalesce(lookup(canonical(tag), LANDCOVER), F.lit("unknown"))
    by_code = F.coalesce(lookup(code, (None, NLCD)), F.lit("unknown"))
    return F.when(direct != "unknown", direct).when(code.isNotNull(), by_code).otherwise(named)


def road_like(kind: Column) -> Column:
    return kind.isin("track", "service-road", "roadway")


def pathless(kind: Column) -> Column:
    return kind == "bushwhack"


def admitted_by_finder(realm: Column) -> Column:
    return realm.isin("recreational", "connector")


def is_restricted(access: Column) -> Column:
    return access.isin("restricted", "closed", "private")


# ----------------------------------------------------------- tags of walkable ways
SIDEWALK_KEYS = ("sidewalk", "sidewalk:left", "sidewalk:right", "sidewalk:both")


def asserts_sidewalk(tags: Column) -> Column:
    return F.exists(F.array(*[tags[k] for k in SIDEWALK_KEYS]), lambda v: v.isNotNull() & v.isin("yes", "both", "left", "right"))


def asserts_separate_sidepath(tags: Column) -> Column:
    parts = F.exists(F.array(*[tags[k] for k in SIDEWALK_KEYS]), lambda v: v.isNotNull() & (v == "separate"))
    return F.coalesce(tags["foot"] == "use_sidepath", F.lit(False)) | parts


def junction_policy(tags: Column) -> Column:
    """Bridges, tunnels and other layers meet others at their ends only."""
    raised = F.exists(F.array(tags["bridge"], tags["tunnel"]), lambda v: v.isNotNull() & ~v.isin("no", "false", "0"))
    layer = F.coalesce(tags["layer"].try_cast("smallint"), F.lit(0))
    return F.when(raised | (layer != 0), "grade-separated-endpoints").otherwise("explicit-nodes")


def walkway(tags: Column, relation: Column) -> Column:
    """A struct of what a way's tags (map<string,string>) say, or null for a way that is not
    walkable.  relation: whether a hiking relation holds the way."""
    no = F.lit(False)
    is_ = lambda c, *v: F.coalesce(c.isin(*v), no)
    highway = F.coalesce(tags["abandoned:highway"], tags["disused:highway"], tags["highway"])
    standing = (
        F.when(tags["abandoned:highway"].isNotNull(), "historical")
        .when(tags["disused:highway"].isNotNull(), "unmaintained")
        .when(is_(tags["informal"], "yes"), "informal")
        .when(is_(tags["trail_visibility"], "bad", "horrible", "no") | is_(tags["maintenance"], "no", "none"), "unmaintained")
        .when(tags["highway"].isNotNull(), "established")
        .otherwise("unknown")
    )
    hiking = F.coalesce(relation, no) | is_(tags["route"], "hiking", "foot", "walking")
    known = F.when(highway.isNotNull(), F.nullif(from_tag(highway, WAY_KIND), F.lit("unknown")))
    kind = F.coalesce(known, F.lit("path"))
    kind = F.when((kind == "footway") & is_(tags["footway"], "sidewalk"), "sidewalk").when((kind == "footway") & is_(tags["footway"], "crossing", "traffic_island"), "crossing").otherwise(kind)
    proxy = kind.isin("service-road", "roadway") & asserts_sidewalk(tags) & ~asserts_separate_sidepath(tags)
    kind = F.when(proxy, "sidewalk").otherwise(kind)
    road = kind.isin("roadway", "service-road")
    barred = road & (is_(tags["foot"], "use_sidepath") | (is_(highway, "motorway", "trunk") & ~is_(tags["foot"], "yes", "designated", "permissive")))
    surface = from_tag(tags["surface"], TERRAIN)
    alpine, scramble = F.coalesce(tags["sac_scale"].contains("alpine_hiking"), no), F.coalesce(tags["sac_scale"].contains("demanding_mountain_hiking"), no)
    paved = kind.isin("sidewalk", "crossing", "pedestrian-street", "cycleway")
    terrain = F.when(surface != "unknown", surface).when(alpine, "alpine").when(scramble, "scramble").when(paved, "pavement").when(road_like(kind), "road").otherwise("trail")
    sure = F.when(surface != "unknown", 0.86).when(alpine | scramble, 0.80).when(paved, 0.76).when(road_like(kind), 0.62).when(tags["surface"].isNotNull(), 0.68).otherwise(0.50)
    right = F.coalesce(tags["foot"], tags["access"])
    access = F.when(right.isNull() | right.isin("yes", "designated", "permissive", "official"), "open").otherwise(from_tag(right, ACCESS))
    blazed = F.coalesce(tags["trailblazed"], tags["marked"])
    marking = F.when(blazed.isNotNull(), from_tag(blazed, TRAIL_MARKING)).when(F.coalesce(relation, no) | is_(tags["route"], "hiking", "foot", "walking") | tags["trailblazed:visibility"].isNotNull(), "marked").otherwise("unknown")
    realm = (
        F.when(kind.isin("path", "track", "bridleway", "bushwhack"), "recreational")
        .when(hiking & kind.isin("footway", "steps", "cycleway"), "recreational")
        .when(hiking & kind.isin("sidewalk", "crossing", "pedestrian-street", "service-road", "roadway"), "connector")
        .otherwise("urban")
    )
    exposure = F.when(road_like(kind), 1.0).when(kind == "crossing", 0.65).when(proxy, 0.25).otherwise(0.0)
    out = F.struct(
        kind.alias("kind"), realm.alias("realm"), F.when(proxy, "centerline-proxy").otherwise("surveyed").alias("geometry_claim"), standing.alias("standing"), marking.alias("marking"),
        terrain.alias("terrain"), sure.alias("terrain_confidence"), access.alias("access"), from_tag(tags["oneway:foot"], TRAVEL).alias("travel"), exposure.alias("road_exposure"),
        F.when(F.coalesce(relation, no), 0.82).otherwise(0.74).alias("confidence"), junction_policy(tags).alias("junctions"), tags["surface"].alias("surface"),
    )
    return F.when((known.isNotNull() | hiking) & ~barred, out)
