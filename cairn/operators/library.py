"""Keyed tables of saved things: changes give a new table, keys stay unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with these rows, which replace those of the same key."""
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def removed(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti").select(*table.columns)


def renamed(table: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """table with the names of (key, name) where there is one that is not blank."""
    new = names.select(F.col(key), F.nullif(F.trim(F.col(name)), F.lit("")).alias("name_"))
    return table.join(new, key, "left").withColumn(name, F.coalesce("name_", name)).select(*table.columns)


def inventory(table: DataFrame, *kinds: str) -> DataFrame:
    """(kind, value, n): how many rows have each value of each of these columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds]))
    return table.select(pairs.alias("p")).groupBy("p.kind", "p.value").agg(F.count("*").alias("n"))


def union_bounds(regions: DataFrame) -> DataFrame:
    """(west, south, east, north) that hold all regions; nulls where there is none."""
    return regions.agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def union_provenance(first: Column, other: Column) -> Column:
    """The first list and what only the other has, in order."""
    return F.concat(F.coalesce(first, F.array()), F.array_except(F.coalesce(other, F.array()), F.coalesce(first, F.array())))
