"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The space and the control characters that part words.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened where df has a column of that name (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in spark.checkpoint.dir.  Only where that is unset, as in
    tests on one machine, is a folder below the warehouse used and set.
    """
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        name = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", name)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(name)
    return name.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage
    and survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Between large steps: Spark removes the exchange files of queries that are over once
    the driver has collected what refers to them, which else may take until its heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(df: DataFrame) -> None:
    """Remove what stored() wrote; for tables that no later job reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files of a stored() table."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        total += path.getFileSystem(conf).getContentSummary(path).getLength()
    return total


def small(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """A stored() table, marked for broadcast if its files have at most most_bytes; else as
    it is, so that the join exchanges both sides.  The bound is one of bytes, and does not
    grow with the data."""
    return F.broadcast(df) if stored_bytes(df) <= most_bytes else df
