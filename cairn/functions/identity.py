"""Names, keys and seeded numbers."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Multipliers of the mixing function and of the byte hash, and the prefix of
#: what a region's key is made from.
MIX_ADD, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
BYTES_START, BYTES_STEP = 0xCBF29CE484222325, 0x100000001B3
REGION = "trail-region-v1:%.8f:%.8f:%.8f:%.8f"
#: Fixed value: characters of a slug's stem at most.
STEM = 64


def splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(MIX_ADD)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
        return x ^ (x >> np.uint64(31))


@F.pandas_udf(T.LongType())
def splitmix64(x: pd.Series) -> pd.Series:
    """The mixing function on the 64 bits of a long (overflow is meant, so it is no SQL)."""
    return pd.Series(splitmix(x.to_numpy().astype(np.int64).view(np.uint64)).view(np.int64))


@F.pandas_udf(T.DoubleType())
def seeded_unit(seed: pd.Series, depth: pd.Series, at: pd.Series, edge: pd.Series) -> pd.Series:
    """A number from 0 to 1 that follows from a seed, a depth, a vertex and an edge."""
    u = lambda s: s.to_numpy().astype(np.int64).view(np.uint64)
    h = splitmix(u(seed) ^ (u(depth) << np.uint64(48)) ^ (u(at) << np.uint64(24)) ^ u(edge))
    return pd.Series((h >> np.uint64(32)).astype(np.float64) / (2**32 - 1))


def slug(raw: str) -> str:
    stem = re.sub(r"[^A-Za-z0-9]+", "-", raw).lower().lstrip("-")[:STEM].rstrip("-") or "route"
    h = BYTES_START
    for b in raw.encode():
        h = (h ^ b) * BYTES_STEP & (2**64 - 1)
    return f"{stem}-{h:016x}"


@F.pandas_udf(T.StringType())
def artifact_slug(raw: pd.Series) -> pd.Series:
    """A file's stem from a title: letters, digits and single dashes, and a hash of the whole."""
    return raw.map(lambda x: None if x is None else slug(x))


def region_key(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.substring(F.sha2(F.format_string(REGION, west, south, east, north), 256), 1, 24)


def region_valid(west: Column, south: Column, east: Column, north: Column, most_deg2: float) -> Column:
    """Whether bounds lie on the globe, in order, and span most_deg2 square degrees at most."""
    inside = west.between(-180, 180) & east.between(-180, 180) & south.between(-90, 90) & north.between(-90, 90)
    return F.coalesce(inside & (west < east) & (south < north) & ((east - west) * (north - south) <= most_deg2), F.lit(False))


def hours_minutes(seconds: Column) -> Column:
    """h:mm of a time, to the nearest minute."""
    minutes = F.floor(F.greatest(seconds, F.lit(0.0)) / 60 + 0.5)
    return F.format_string("%d:%02d", F.floor(minutes / 60).cast("long"), (minutes % 60).cast("long"))
