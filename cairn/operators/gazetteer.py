"""Search for places by name: exact names first, then beginnings, then words that begin, then
any part; of equal ones the nearest first.

An index of n-grams brings queries and entries together.  Every way to match implies grams
that the entry must have; each query takes the rarest of them, so that a common beginning
doesn't list every place that has it if the rest of the query is less common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geo

c = F.col

#: Letters of a gram.
GRAM = 3


def normalized(text: Column) -> Column:
    """Lower case, with one space for what is neither letter nor digit; none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _of_length(text: Column, n: int) -> Column:
    """The stretches of n letters of a text; none of a shorter one."""
    last = F.length(text) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def _grams(text: Column) -> Column:
    """All grams of a text, of one letter to GRAM."""
    return F.array_distinct(F.concat(*[_of_length(text, n) for n in range(1, GRAM + 1)]))


def entries_of(places: DataFrame) -> DataFrame:
    """places (entry_id, name, jurisdiction, kind, lon, lat) with what is searched in them."""
    return places.withColumns({"plain": normalized(c("name")), "haystack": normalized(F.concat_ws(" ", "name", "jurisdiction", "kind"))})


def search(queries: DataFrame, places: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, position, entry_id, rank, distance_m): the `most` best places of each query
    (query_id, text, lon, lat); the number is the feature.  rank: 0 the name itself, 1 its
    beginning, 2 every word begins a word of name, jurisdiction or kind, 3 a part of these.
    Distances count to a millimetre.  A query without letters and digits finds nothing."""
    q = queries.select("query_id", normalized(c("text")).alias("asked"), c("lon").alias("qlon"), c("lat").alias("qlat")).where("asked != ''")
    e = entries_of(places)
    index = e.select("entry_id", F.explode(_grams(F.concat(F.lit(" "), c("haystack")))).alias("gram"))
    # beginnings: a word's first letters behind a space; parts: the query's own grams
    words = F.split("asked", " ")
    begin = F.transform(words, lambda w: F.substring(F.concat(F.lit(" "), w), 1, GRAM))
    size = F.least(F.length("asked"), F.lit(GRAM))
    part = F.filter(_grams(c("asked")), lambda g: F.length(g) == size)
    wanted = q.select("query_id", F.explode(F.array(F.struct(F.lit("begin").alias("way"), begin.alias("grams")), F.struct(F.lit("part").alias("way"), part.alias("grams")))).alias("w")).select("query_id", "w.way", F.explode("w.grams").alias("gram"))
    used = index.join(wanted.select("gram").distinct(), "gram", "left_semi")
    counts = used.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("query_id", "way").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).select("query_id", c("g.gram").alias("gram"))
    pairs = used.join(rarest, "gram").select("query_id", "entry_id").distinct()
    rows = pairs.join(q, "query_id").join(e, "entry_id")
    begins = F.forall(F.split("asked", " "), lambda w: F.exists(F.split("haystack", " "), lambda t: t.startswith(w)))
    rank = F.when(c("plain") == c("asked"), 0).when(c("plain").startswith(c("asked")), 1).when(begins, 2).when(c("haystack").contains(c("asked")), 3)
    rows = rows.withColumn("rank", rank).where("rank is not null").withColumn("distance_m", geo.haversine(c("lon"), c("lat"), c("qlon"), c("qlat")))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", F.round("distance_m", 3), "name", "jurisdiction", "kind", "entry_id"))
    return rows.withColumn("position", order).where(c("position") <= most).select("query_id", "position", "entry_id", "rank", "distance_m")
