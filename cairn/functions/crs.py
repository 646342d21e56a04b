"""Coordinate reference systems: web Mercator, UTM on two ellipsoids, names and tiles."""

from __future__ import annotations

import re
from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere of web Mercator, its northern limit, ellipsoids (a, 1/f), scale.
MERCATOR_M, MERCATOR_LAT = 6_378_137.0, 85.051_128_78
ELLIPSOIDS = {"wgs84": (6_378_137.0, 298.257223563), "nad83": (6_378_137.0, 298.257222101)}
K0, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500_000.0, 10_000_000.0


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    phi = F.radians(F.least(F.greatest(lat, F.lit(-MERCATOR_LAT)), F.lit(MERCATOR_LAT)))
    return MERCATOR_M * F.radians(lon), MERCATOR_M * F.log(F.tan(pi / 4 + phi / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_M), F.degrees(2 * F.atan(F.exp(y / MERCATOR_M)) - pi / 2)


def _constants(datum: str) -> tuple[float, float, float]:
    a, inverse = ELLIPSOIDS[datum]
    f = 1 / inverse
    e2 = f * (2 - f)
    return a, e2, e2 / (1 - e2)


def to_utm(lon: Column, lat: Column, zone: Column | int, north: Column | bool = True, datum: str = "wgs84") -> tuple[Column, Column]:
    """(easting, northing) by the usual series; null where a coordinate is not finite."""
    a, e2, ep2 = _constants(datum)
    zone, north = (x if isinstance(x, Column) else F.lit(x) for x in (zone, north))
    phi, tan = F.radians(lat), F.tan(F.radians(lat))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c = tan * tan, ep2 * F.pow(F.cos(phi), 2)
    x = F.cos(phi) * (F.radians(lon) - F.radians(zone * 6 - 183))
    # Meridian arc: coefficients of phi and of the sines of its multiples.
    arc = [(0, 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256), (2, -(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024)), (4, 15 * e2**2 / 256 + 45 * e2**3 / 1024), (6, -35 * e2**3 / 3072)]
    m = a * sum((k * (F.sin(i * phi) if i else phi) for i, k in arc[1:]), arc[0][1] * phi)
    east = FALSE_EASTING + K0 * n * (x + (1 - t + c) * F.pow(x, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(x, 5) / 120)
    up = F.pow(x, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(x, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(x, 6) / 720
    return east, K0 * (m + n * tan * up) + F.when(north, 0.0).otherwise(FALSE_NORTHING)


def from_utm(east: Column, northing: Column, zone: Column | int, north: Column | bool = True, datum: str = "wgs84") -> tuple[Column, Column]:
    a, e2, ep2 = _constants(datum)
    zone, north = (x if isinstance(x, Column) else F.lit(x) for x in (zone, north))
    e1 = (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2))
    mu = (northing - F.when(north, 0.0).otherwise(FALSE_NORTHING)) / (K0 * a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = [(2, 3 * e1 / 2 - 27 * e1**3 / 32), (4, 21 * e1**2 / 16 - 55 * e1**4 / 32), (6, 151 * e1**3 / 96), (8, 1097 * e1**4 / 512)]
    phi = sum((k * F.sin(i * mu) for i, k in foot), mu)
    tan, w = F.tan(phi), 1 - e2 * F.pow(F.sin(phi), 2)
    n, r = a / F.sqrt(w), a * (1 - e2) / F.pow(w, 1.5)
    t, c = tan * tan, ep2 * F.pow(F.cos(phi), 2)
    d = (east - FALSE_EASTING) / (n * K0)
    up = F.pow(d, 2) / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6) / 720
    side = d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120
    return F.degrees(F.radians(zone * 6 - 183) + side / F.cos(phi)), F.degrees(phi - n * tan / r * up)


def named_crs(name: Column) -> Column:
    """struct (kind, datum, zone, north) of a CRS name or EPSG code; null where unknown."""
    key = F.upper(F.regexp_replace(name, "[^0-9A-Za-z]", ""))
    code = F.regexp_extract(key, "EPSG[0-9]*?([0-9]{4,6})$", 1)
    code = F.when(code == "", F.regexp_extract(key, "^([0-9]{4,6})$", 1)).otherwise(code).try_cast("int")
    out = lambda kind, datum, zone, north: F.struct(F.lit(kind).alias("kind"), F.lit(datum).alias("datum"), zone.cast("int").alias("zone"), north.cast("boolean").alias("north"))
    none = F.lit(None)
    return (
        F.when(code.between(32601, 32660), out("utm", "wgs84", code - 32600, F.lit(True)))
        .when(code.between(32701, 32760), out("utm", "wgs84", code - 32700, F.lit(False)))
        .when(code.between(26901, 26923), out("utm", "nad83", code - 26900, F.lit(True)))
        .when(code.isin(3857, 900913) | key.contains("PSEUDOMERCATOR") | key.contains("WEBMERCATOR"), out("mercator", "wgs84", none, none))
        .when(code.isin(4326, 4269, 4979) | key.contains("CRS84") | key.isin("WGS84", "NAD83"), out("geographic", "wgs84", none, none))
    )


def tile(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """(x, y) of the tile that holds a point; longitudes and latitudes at the edge count in."""
    side = F.pow(F.lit(2.0), zoom)
    phi = F.radians(F.least(F.greatest(lat, F.lit(-MERCATOR_LAT)), F.lit(MERCATOR_LAT)))
    x = (lon + 180) / 360 * side
    y = (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / pi) / 2 * side
    inside = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), (side - 1).cast("long")).cast("int")
    return inside(x), inside(y)


def crs_of_text(text: str | None) -> tuple[str, str, int | None, bool | None]:
    """(kind, datum, zone, north) of a declared system: an EPSG code or the WKT of a .prj.  None
    counts as geographic; what is not supported is an error."""
    if text is None:
        return "geographic", "wgs84", None, None
    key = re.sub("[^0-9A-Z]", "", text.upper())
    if code := re.search(r"^(?:EPSG)?([0-9]{4,6})$", key) or (None if "PROJCS" in key or "GEOGC" in key else re.search(r"EPSG[0-9]*?([0-9]{4,6})$", key)):
        n = int(code[1])
        for low, high, datum, north in ((32601, 32660, "wgs84", True), (32701, 32760, "wgs84", False), (26901, 26923, "nad83", True)):
            if low <= n <= high:
                return "utm", datum, n - low + 1, north
        if n in (3857, 900913):
            return "mercator", "wgs84", None, None
        if n in (4326, 4269, 4979):
            return "geographic", "wgs84", None, None
    elif "WEBMERCATOR" in key or "PSEUDOMERCATOR" in key or "MERCATORAUXILIARYSPHERE" in key:
        return "mercator", "wgs84", None, None
    elif zone := re.search(r"UTMZONE([0-9]{1,2})([NS])", key):
        if 1 <= int(zone[1]) <= 60 and re.search("WGS(?:19)?84|NAD(?:19)?83|NORTHAMERICAN(?:19)?83", key):
            return "utm", "wgs84" if re.search("WGS(?:19)?84", key) else "nad83", int(zone[1]), zone[2] == "N"
    elif "PROJC" not in key and re.search("CRS84|WGS(?:19)?84|NAD(?:19)?83|NORTHAMERICAN(?:DATUM)?(?:19)?83", key):
        return "geographic", "wgs84", None, None
    raise ValueError(f"this coordinate system is not supported: {text[:120]}")


def to_lonlat(x: Column, y: Column, crs: tuple[str, str, int | None, bool | None]) -> tuple[Column, Column]:
    """(lon, lat) of coordinates in a system of crs_of_text()."""
    kind, datum, zone, north = crs
    return from_mercator(x, y) if kind == "mercator" else from_utm(x, y, zone, north, datum) if kind == "utm" else (x, y)


def from_lonlat(lon: Column, lat: Column, crs: tuple[str, str, int | None, bool | None]) -> tuple[Column, Column]:
    """(x, y) of longitudes and latitudes in a system of crs_of_text()."""
    kind, datum, zone, north = crs
    return to_mercator(lon, lat) if kind == "mercator" else to_utm(lon, lat, zone, north, datum) if kind == "utm" else (lon, lat)
