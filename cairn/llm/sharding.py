"""Operator 4: uniform shuffle into shards of exact size.

Law `rows`: the shards' row counts differ by at most one, and every assignment of rows
to slots is equally likely (over seeds).  Four steps:

1. count the rows of every input partition;
2. draw how many rows each partition sends to each cell (a shard is a run of equally
   large cells, each small enough for one task) from the multivariate hypergeometric
   law, so that rows and columns of this communication matrix sum exactly.  The matrix
   is never built: a task draws its own row by walking down a seeded binary tree over
   the partitions, splitting the cells' capacities between the halves at each node;
3. permute locally: a seeded permutation of the partition's labels deals its rows out;
4. exchange by cell, and permute again within the cell.  A cell's first slot is the sum
   of the capacities before it, so slots are gapless without any global sort.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import unused

#: numpy draws hypergeometric numbers from populations below this.
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good ones; any population size."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n)) if good + bad else 0
    low, high = max(0, n - bad), min(n, good)
    share = good / (good + bad)
    sd = math.sqrt(n * share * (1 - share) * (good + bad - n) / (good + bad - 1))
    mean = n * share
    k = np.arange(max(low, int(mean - 12 * sd) - 2), min(high, int(mean + 12 * sd) + 2) + 1, dtype=np.float64)
    steps = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[1:]) - np.log(bad - n + k[1:])
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(mass, rng.random() * mass[-1])])


def split(rng: np.random.Generator, colors: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric: n of the rows that `colors` counts, by color."""
    rest, out = int(colors.sum()), np.zeros(len(colors), np.int64)
    if rest < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(colors, n, method="marginals")
    for i, c in enumerate(colors.tolist()):
        out[i] = hypergeometric(rng, c, rest - c, n) if n else 0
        rest, n = rest - c, n - int(out[i])
    return out


def matrix_row(counts: np.ndarray, capacities: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the communication matrix of these partition counts and cell capacities."""
    before = np.concatenate([[0], np.cumsum(counts)])
    low, high, have = 0, len(counts), capacities
    while high - low > 1:
        mid = (low + high) // 2
        left = split(np.random.default_rng([seed, low, high]), have, int(before[mid] - before[low]))
        low, high, have = (low, mid, left) if p < mid else (mid, high, have - left)
    return have


def even(total: int, parts: int) -> np.ndarray:
    """`total` in `parts` whole numbers that differ by at most one, the larger first."""
    return np.array([total // parts + (i < total % parts) for i in range(parts)], np.int64)


def uniform_shards(docs: DataFrame, n_shards: int, cells_per_shard: int | None = None, seed: int = 17) -> DataFrame:
    """All rows and columns of docs, with shard int and slot long.

    docs must be a table as read from storage, whose partitions hold the same rows in
    the same order each time they are read; a task that meets another number of rows
    than was counted fails rather than lose one.  Columns of docs that are named shard
    or slot are replaced.  Nulls, empty and long texts and repeated rows are rows like
    any other: each gets a slot of its own.  With fewer rows than shards the first
    shards get one row each; an empty table gives an empty result.

    One exchange, by cell, of every row; cells are as many as shuffle partitions at
    least, and equally large whatever the data's keys are, so no key can be hot.
    """
    spark = docs.sparkSession
    docs = docs.select([c for c in docs.columns if c.lower() not in ("shard", "slot")])
    cell, order_, first_ = unused(docs, "cell_", "order_", "first_")
    # The number of input partitions bounds what the driver gets: one count for each.
    got = docs.groupBy(F.spark_partition_id().alias("p")).count().collect()
    counts = np.zeros(max([r["p"] for r in got], default=-1) + 1, np.int64)
    for r in got:
        counts[r["p"]] = r["count"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    k = cells_per_shard or max(1, -(-tasks // n_shards))
    sizes = even(int(counts.sum()), n_shards)
    capacities = np.concatenate([even(int(s), k) for s in sizes])
    first = np.concatenate([np.concatenate([[0], np.cumsum(part)[:-1]]) for part in capacities.reshape(n_shards, k)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at = TaskContext.get().partitionId(), 0
        mine = int(counts[p]) if p < len(counts) else 0
        labels = np.repeat(np.arange(len(capacities), dtype=np.int32), matrix_row(counts, capacities, p, seed)) if mine else np.empty(0, np.int32)
        rng = np.random.default_rng([seed, p, 1])
        rng.shuffle(labels)
        order = rng.integers(0, 1 << 62, mine)
        for b in batches:
            if at + b.num_rows > mine:
                raise RuntimeError("the table's partitions changed since they were counted")
            part = slice(at, at + b.num_rows)
            added = [pa.array(labels[part]), pa.array(order[part]), pa.array(first[labels[part]])]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, cell, order_, first_])
            at += b.num_rows
        if at != mine:
            raise RuntimeError("the table's partitions changed since they were counted")

    kept = T.StructType(list(docs.schema)).add(cell, T.IntegerType()).add(order_, T.LongType()).add(first_, T.LongType())
    dealt = docs.mapInArrow(deal, kept).repartitionById(len(capacities), F.col(cell))
    rank = F.row_number().over(Window.partitionBy(cell).orderBy(order_))
    slot = (F.col(first_) + rank - 1).cast("long")
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns], F.floor(F.col(cell) / k).cast("int").alias("shard"), slot.alias("slot"))
