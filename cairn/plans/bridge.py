"""A trail network read out of the driver's tables.

Vertices are nations on a grid, a route is an order, its legs run from the customer's
nation over the nations of the line items' suppliers, a trace is a user's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.geo import haversine


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("bigint")
    return table(spark, sf_dir, "nation").select(n.alias("v"), (-105.0 + (n % 5) * 0.012).alias("lon"), (40.0 + F.floor(n / 5.0) * 0.012).alias("lat"), (1600 + 37 * ((n * 7) % 25)).cast("double").alias("ele"))


#: Line items in a task at most, about: what follows sorts them by route several times.
TASK_ROWS = 250_000


def hops(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """One row per line item, of all routes or of those whose route_id `only` has.  Where a task to each core would hold more than TASK_ROWS, routes
    are dealt over as many tasks as hold that, in the one exchange by route that the joins and
    windows need, so that a task's memory doesn't grow with the tables.  The session's shuffle
    partitions don't bound it: adaptive execution makes one of several up to a size in bytes.
    So are orders and customers, which are too many to go to every task."""
    t = lambda n: table(spark, sf_dir, n)
    c = F.col
    placed, homes = t("orders").select("o_orderkey", "o_custkey"), t("customer").select("c_custkey", "c_nationkey")
    bought = t("lineitem")
    if only is not None:
        placed = placed.join(only.select(c("route_id").alias("o_orderkey")), "o_orderkey", "left_semi")
        bought = bought.join(only.select(c("route_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    lines = bought.join(t("supplier").select("s_suppkey", "s_nationkey"), c("l_suppkey") == c("s_suppkey"))
    tasks = -(-t("lineitem").count() // TASK_ROWS)
    if tasks > min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism):
        placed, homes = placed.repartition(tasks, "o_custkey"), homes.repartition(tasks, "c_custkey")
        starts = placed.join(homes, c("o_custkey") == c("c_custkey")).repartition(tasks, "o_orderkey")
        lines = lines.repartition(tasks, "l_orderkey")
    else:
        starts = placed.join(homes, c("o_custkey") == c("c_custkey"))
    rows = lines.join(starts, c("l_orderkey") == c("o_orderkey"))
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")).cast("bigint")
    access = F.when(c("l_returnflag") == "A", "restricted").when(c("l_returnflag") == "N", "open").otherwise("unknown")
    terrain = F.get(F.array(*[F.lit(x) for x in ("trail", "forest", "talus", "pavement", "alpine")]), c("l_linenumber") % 5)
    return rows.select(
        c("l_orderkey").alias("route_id"), c("c_nationkey").cast("bigint").alias("start_v"), c("s_nationkey").cast("bigint").alias("to_v"), seq.alias("seq"), F.least(c("l_discount") * 10.0, F.lit(1.0)).alias("road"), (1.0 - c("l_tax") * 6.0).alias("conf"), access.alias("access"), terrain.alias("terrain")
    )


def legs(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Legs as operators.routes takes them, of all routes or of those of `only`; hops that stay in place are none.  The vertices
    are a nation each, 25 at any scale, and go to every task."""
    h = hops(spark, sf_dir, only)
    before = F.coalesce(F.lag("to_v").over(Window.partitionBy("route_id").orderBy("seq")), F.col("start_v"))
    v = vertices(spark, sf_dir)
    end = lambda k, at: F.broadcast(v.select(F.col("v").alias(at), F.col("lon").alias(f"lon{k}"), F.col("lat").alias(f"lat{k}"), F.col("ele").alias(f"e{k}")))
    rows = h.withColumn("from_v", before).where("from_v <> to_v").join(end(1, "from_v"), "from_v").join(end(2, "to_v"), "to_v")
    m = haversine(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    edge = F.least("from_v", "to_v") * 100 + F.greatest("from_v", "to_v")
    rows = rows.withColumn("m", m).withColumn("grade", (F.col("e2") - F.col("e1")) / F.col("m"))
    return rows.select("route_id", "seq", "start_v", "from_v", "to_v", edge.alias("edge_id"), "road", "conf", "access", "terrain", "e1", "e2", "m", "grade")


def edges(spark: SparkSession, sf_dir: str, most_m: float = 2000.0) -> DataFrame:
    """The short edges that legs use: (edge_id, a, b, m, road, access, travel, lon1 ... lat2)."""
    one = legs(spark, sf_dir).where(F.col("m") < most_m).groupBy("edge_id").agg(F.min(F.least("from_v", "to_v")).alias("a"), F.min(F.greatest("from_v", "to_v")).alias("b"), F.min("m").alias("m"), F.min("road").alias("road"))
    v = vertices(spark, sf_dir)
    end = lambda k, at: F.broadcast(v.select(F.col("v").alias(at), F.col("lon").alias(f"lon{k}"), F.col("lat").alias(f"lat{k}")))
    return one.join(end(1, "a"), "a").join(end(2, "b"), "b").select("edge_id", "a", "b", "m", "road", F.lit("open").alias("access"), F.lit("both").alias("travel"), "lon1", "lat1", "lon2", "lat2")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces (trace_id, pos, lon, lat, ele)."""
    e = table(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    ele = F.when(F.col("event_type") == "error", F.lit(None).cast("double")).otherwise(1600.0 + F.col("value") * 0.1)
    return e.select(F.col("user_id").alias("trace_id"), pos.alias("pos"), (-105.0 + (F.col("event_id") % 997) * 0.00005).alias("lon"), (40.0 + (F.col("event_id") % 89) * 0.0005).alias("lat"), ele.alias("ele"))


#: The same views in SQL, in front of every oracle.
SQL = """
b_vertex AS (SELECT CAST(n_nationkey AS BIGINT) AS v, -105e0 + CAST(n_nationkey % 5 AS DOUBLE) * 0.012e0 AS lon,
  40e0 + floor(CAST(n_nationkey AS DOUBLE) / 5e0) * 0.012e0 AS lat, CAST(1600 + 37 * ((n_nationkey * 7) % 25) AS DOUBLE) AS ele FROM nation),
b_hop AS (SELECT l_orderkey AS route_id, CAST(c_nationkey AS BIGINT) AS start_v, CAST(s_nationkey AS BIGINT) AS to_v,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seq,
  least(l_discount * 10e0, 1e0) AS road, 1e0 - l_tax * 6e0 AS conf,
  CASE l_returnflag WHEN 'A' THEN 'restricted' WHEN 'N' THEN 'open' ELSE 'unknown' END AS access,
  CASE l_linenumber % 5 WHEN 0 THEN 'trail' WHEN 1 THEN 'forest' WHEN 2 THEN 'talus' WHEN 3 THEN 'pavement' ELSE 'alpine' END AS terrain
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
b_step AS (SELECT b_hop.*, coalesce(lag(to_v) OVER (PARTITION BY route_id ORDER BY seq), start_v) AS from_v FROM b_hop),
b_leg AS (SELECT z.*, (e2 - e1) / m AS grade FROM (SELECT s.*, least(from_v, to_v) * 100 + greatest(from_v, to_v) AS edge_id, a.ele AS e1, b.ele AS e2,
  2e0 * 6371008.8e0 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2e0), 2e0) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2e0), 2e0))) AS m
  FROM b_step s JOIN b_vertex a ON a.v = s.from_v JOIN b_vertex b ON b.v = s.to_v WHERE s.from_v <> s.to_v) z),
b_edge AS (SELECT e.*, x.lon AS lon1, x.lat AS lat1, y.lon AS lon2, y.lat AS lat2 FROM (SELECT edge_id, min(least(from_v, to_v)) AS a, min(greatest(from_v, to_v)) AS b, min(m) AS m, min(road) AS road
  FROM b_leg WHERE m < 2000e0 GROUP BY edge_id) e JOIN b_vertex x ON x.v = e.a JOIN b_vertex y ON y.v = e.b),
b_way AS (SELECT edge_id, a AS from_v, b AS to_v, m FROM b_edge UNION ALL SELECT edge_id, b, a, m FROM b_edge),
b_trace AS (SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, -105e0 + CAST(event_id % 997 AS DOUBLE) * 0.00005e0 AS lon,
  40e0 + CAST(event_id % 89 AS DOUBLE) * 0.0005e0 AS lat, CASE WHEN event_type = 'error' THEN NULL ELSE 1600e0 + value * 0.1e0 END AS ele FROM events),
b_tleg AS (SELECT t.*, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lag(ele) OVER w AS ele0 FROM b_trace t WINDOW w AS (PARTITION BY trace_id ORDER BY pos)),
b_tm AS (SELECT t.*, 2e0 * 6371008.8e0 * asin(sqrt(power(sin(radians(lat - lat0) / 2e0), 2e0) + cos(radians(lat0)) * cos(radians(lat)) * power(sin(radians(lon - lon0) / 2e0), 2e0))) AS tm FROM b_tleg t),
b_along AS (SELECT t.*, coalesce(sum(tm) OVER (PARTITION BY trace_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0e0) AS along_m FROM b_tm t)
"""
