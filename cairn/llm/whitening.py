"""Operator 12: whitening of embeddings by a covariance that is computed in tiles.

Dimensions are cut into tiles and rows into blocks.  The column blocks (block of rows,
tile) meet by their block of rows; for each pair of tiles their product is a part of the
covariance, and the parts of a pair are summed over all blocks.  What reaches the driver is
the covariance alone, whose size is that of the dimensions squared, and its eigenvectors go
back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import dropped, stored, unused

#: Dimensions of a tile and rows of a block: a column block has at most 2 MB.
TILE, BLOCK_ROWS = 64, 4096
#: Dimensions at most: the covariance has their square in doubles, here 512 MB.
MOST_DIMENSIONS = 8192
#: An eigenvalue below this share of the largest counts as zero.
ZERO = 1e-12


def usable(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose vector is there and has finite entries only, if any."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return rows.where(F.col(column).isNotNull() & ~F.coalesce(F.exists(column, bad), F.lit(True)))


def levels(column: str, scale: int):
    """floor(scale * entry) of each entry as double, as long."""
    return F.transform(column, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


def matrix(column: pa.Array, d: int, kind=np.float64) -> np.ndarray:
    """A list column as rows of d entries; shorter rows end in zeros."""
    n, counts = len(column), np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (counts == d).all():
        return flat.reshape(n, d).astype(kind)
    out = np.zeros((n, d), kind)
    row = np.repeat(np.arange(n), counts)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out


@dataclass
class Moments:
    """Of a list of vectors: how many, the exact sum of each dimension, the covariance with
    divisor n, and its eigenvalues (falling) with unit eigenvectors as columns."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def rank(self) -> int:
        """How many eigenvalues are not zero."""
        return int((self.values > max(self.values[0] * ZERO, 0)).sum()) if len(self.values) else 0


def tiled_covariance(vectors: DataFrame, n: int, sums: list[int], tile: int = TILE, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """The covariance of a stored table with one column of vectors of longs, each centred by
    sums / n before it is multiplied.

    Blocks of rows never leave their size, however many rows there are: a task of the join by
    blocks holds two column blocks at a time, and sums of tile pairs are made within tasks
    and then by (tile, tile, place), so no pair of tiles is one task's alone."""
    d = len(sums)
    tiles = range(0, d, tile)
    mean = np.array([s / n for s in sums])

    def column_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, block_rows):
                x = matrix(whole.slice(at, block_rows).column(0), d) - mean
                for t, first in enumerate(tiles):
                    block = np.ascontiguousarray(x[:, first : first + tile])
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([k], pa.int64()), pa.array([t], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["part", "k", "tile", "block"])
                k += 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (a, b), p in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([p.ravel().tolist()], pa.list_(pa.float64()))], ["a", "b", "product"])

        for batch in batches:
            for a, b, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(left).reshape(-1, min(tile, d - a * tile))
                y = np.frombuffer(right).reshape(-1, min(tile, d - b * tile))
                held[a, b] = held.get((a, b), 0.0) + x.T @ y
            if len(held) * tile * tile > 1 << 22:  # 32 MB
                yield from out()
                held = {}
        yield from out()

    blocks = stored(vectors.mapInArrow(column_blocks, "part long, k long, tile int, block binary"), "column_blocks")
    left, right = (blocks.select("part", "k", F.col("tile").alias(t), F.col("block").alias(f"block_{t}")) for t in "ab")
    pairs = left.join(right.hint("shuffle_hash"), ["part", "k"]).where("a <= b").select("a", "b", "block_a", "block_b")
    parts = pairs.mapInArrow(products, "a int, b int, product array<double>").select("a", "b", F.posexplode("product").alias("place", "value"))
    summed = parts.groupBy("a", "b", "place").agg(F.sum("value").alias("value"))
    got = summed.toPandas()  # the dimensions squared, not the rows
    dropped(blocks)
    out = np.zeros((d, d))
    width = np.minimum(tile, d - got["b"].to_numpy() * tile)
    i = got["a"].to_numpy() * tile + got["place"].to_numpy() // width
    j = got["b"].to_numpy() * tile + got["place"].to_numpy() % width
    out[i, j] = out[j, i] = got["value"].to_numpy() / n
    return out


def moments(vectors: DataFrame, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> Moments:
    """Moments of a stored table with one column `x` of vectors of longs; shorter vectors
    count as ending in zeros."""
    n, d = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; the covariance is assembled for at most {MOST_DIMENSIONS}")
    sums = [0] * d
    exact = vectors.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"))
    for r in exact.collect():  # one row a dimension
        sums[r["i"]] = int(r["s"])
    covariance = tiled_covariance(vectors, n, sums, tile, block_rows) if d else np.zeros((0, 0))
    values, vecs = np.linalg.eigh(covariance)
    return Moments(n, sums, covariance, values[::-1], vecs[:, ::-1])


def projected(x: np.ndarray, m: Moments, components: int) -> np.ndarray:
    """Centred rows on the first components, each over the root of its eigenvalue; not a
    number where the eigenvalue is zero."""
    k = min(components, len(m.sums))
    scale = np.where(np.arange(k) < m.rank, np.sqrt(np.maximum(m.values[:k], 1e-300)), np.nan)
    return (x - np.array(m.sums, float) / max(m.n, 1)) @ m.vectors[:, :k] / scale


def identity_error(vectors: DataFrame, m: Moments, components: int) -> float | None:
    """The largest entry, without its sign, of the covariance of the whitened table less the
    identity, over the components whose eigenvalue isn't zero; None if there is none."""
    k, d = min(components, m.rank), len(m.sums)
    if not k:
        return None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = projected(matrix(batch.column(0), d), m, k)
            total, square = total + w.sum(0), square + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([[*total, *square.ravel()]], pa.list_(pa.float64()))], ["sums"])

    got = vectors.mapInArrow(sums, "sums array<double>").select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"))
    flat = np.zeros(k + k * k)
    for r in got.collect():  # k and its square, not the rows
        flat[r["i"]] = r["s"]
    mean = flat[:k] / m.n
    return float(np.abs(flat[k:].reshape(k, k) / m.n - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, m: Moments) -> list[int | None]:
    """The exact sum over dimensions of (n * x - S)^2; None where 64 bits don't hold it."""
    top = max(int(x.max(initial=0)) * m.n, -int(x.min(initial=0)) * m.n, max(map(abs, m.sums), default=0))
    if 4 * top * top * max(len(m.sums), 1) < 1 << 63:
        d = x * m.n - np.array(m.sums, np.int64)
        return (d * d).sum(1).tolist()
    out = [sum((int(c) * m.n - s) ** 2 for c, s in zip(row, m.sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def whitened(rows: DataFrame, column: str = "embedding", components: int = 4, scale: int = 256, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The usable rows, each `components` times, with the columns component, n, deviation,
    whitened, explained and identity_error.

    Rows whose vector is null or has null or non-finite entries go.  Entries c become
    x = floor(scale * c).  The moments are those of the distinct x vectors: n of them, their
    sums S and covariance V with divisor n.  component counts V's unit eigenvectors from 1 by
    falling eigenvalue e; whitened is x - S/n on the component over sqrt(e), explained is
    e / trace(V), deviation the exact sum of (n*x - S)^2 (null beyond 64 bits).  Vectors
    that are shorter than the longest count as ending in zeros; with fewer dimensions than
    components each dimension has its component.  Where e is zero (few or equal vectors)
    whitened is null, and explained is null where V is; identity_error is null where all
    are.  An empty table gives an empty result.  Repeated rows and ids are kept.  Other
    columns are carried; a new one whose name is taken is lengthened by underscores.
    """
    names = unused(rows, "component", "n", "deviation", "whitened", "explained", "identity_error")
    kept = usable(rows, column)
    fit = stored(kept.select(levels(column, scale).alias("x")).distinct(), "fit_list")
    m = moments(fit, tile, block_rows)
    d, k = len(m.sums), min(components, len(m.sums))
    error, trace = identity_error(fit, m, components), float(np.trace(m.covariance))
    dropped(fit)
    explained = [float(max(v, 0.0) / trace) if trace > 0 else None for v in m.values[:k]]
    (x_name,) = unused(rows, "levels_")

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(batch.num_columns - 1), d, np.int64)
            w = projected(x.astype(float), m, components)
            rows_ = np.repeat(np.arange(batch.num_rows), k)
            columns = [c.take(pa.array(rows_)) for c in batch.columns[:-1]]
            again = lambda v: pa.array(list(v) * batch.num_rows)
            columns += [again(range(1, k + 1)).cast(pa.int32()), pa.array(np.full(len(rows_), m.n, np.int64)), pa.array(deviations(x, m), pa.int64()).take(pa.array(rows_))]
            columns += [pa.array(w.ravel(), mask=np.isnan(w.ravel())), again(explained).cast(pa.float64()), pa.array([error] * len(rows_), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *names])

    types = ("int", "long", "long", "double", "double", "double")
    schema = kept.limit(0).select("*", *(F.lit(None).cast(t).alias(n) for n, t in zip(names, types))).schema
    return kept.withColumn(x_name, levels(column, scale)).mapInArrow(out, schema)
