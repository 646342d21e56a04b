"""Operator 6: token ids packed into rows of fixed length by best-fit decreasing.

Every text becomes ids of a public byte-level vocabulary.  A text longer than a row is
split into pieces of a full row and a rest; nothing is lost.  Tasks pack the pieces of a
bounded block at a time: longest first, each into the open row with the least room that
is enough, found by a segment tree over capacities.  Each packed row is one row of an id
matrix, with cumulative segment lengths and the places where position ids start again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of a block that is packed at once: bounds a task's memory.
BLOCK_IDS = 1 << 22
PACK = "pack_id bigint, ids binary, cu_seqlens array<int>, position_resets array<int>, segments array<struct<doc_id:{kind},piece:int,n_pieces:int>>"


class Capacities:
    """Counts of open rows by room left, 0 to `most`, in a segment tree."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def least(self, need: int) -> int:
        """The least room >= need that an open row has, or -1."""
        tree, i = self.tree, need + self.size
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Rows as lists of indices; each row's lengths sum to `length` at most.  Of equal
    lengths the earlier goes first, of equal rooms the row that got it last.  A length of 0
    goes to a row with room, so that its place lies inside the row."""
    rooms, by_room, rows = Capacities(length), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        room = rooms.least(max(need, 1))
        if room < 0:
            room, row = length, len(rows)
            rows.append([])
        else:
            row = by_room[room].pop()
            rooms.add(room, -1)
        rows[row].append(i)
        by_room.setdefault(room - need, []).append(row)
        rooms.add(room - need, 1)
    return rows


_ENCODINGS: dict = {}


def encoding(ranks_file: str, pattern: str):
    """One tokenizer per worker and file."""
    if ranks_file not in _ENCODINGS:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
        _ENCODINGS[ranks_file] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[ranks_file]


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def packed(docs: DataFrame, ranks_file: str, pattern: str, length: int = 2048, pad: int = 50_256, vocabulary: int = 50_257, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of PACK: `length` little-endian ids each (16 or 32 bits, as the vocabulary asks
    for), padded with `pad`; cu_seqlens from 0 to the ids in use; position_resets, the
    places where a segment starts; and the document and piece of each segment.

    A null or empty text is one segment of length 0, so that every row of docs, also one
    with a null or repeated id, has its segments.  Blocks are runs of the input's rows, so
    no row is exchanged; an empty table gives no rows.  One very long text is the largest
    thing held.  ranks_file must exist on every executor.  pack_id is the input partition
    and a counter: the same input split the same way gives the same packs.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    dtype = id_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = encoding(ranks_file, pattern), TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        segments: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal at
            rows = best_fit_decreasing([len(x) for x in ids], length)
            for lo in range(0, len(rows), 512):
                part = rows[lo : lo + 512]
                matrix = np.full((len(part), length), pad, dtype)
                ends = []
                for k, row in enumerate(part):
                    whole = np.concatenate([ids[i] for i in row])
                    matrix[k, : len(whole)] = whole
                    ends.append([0, *np.cumsum([len(ids[i]) for i in row]).tolist()])
                seg = pa.array([[segments[i] for i in row] for row in part], pa.list_(pa.struct([("doc_id", doc_type), ("piece", pa.int32()), ("n_pieces", pa.int32())])))
                cols = [pa.array(range(at, at + len(part)), pa.int64()), pa.array([x.tobytes() for x in matrix], pa.binary()), pa.array(ends, pa.list_(pa.int32())), pa.array([e[:-1] for e in ends], pa.list_(pa.int32())), seg]
                yield pa.RecordBatch.from_arrays(cols, names=["pack_id", "ids", "cu_seqlens", "position_resets", "segments"])
                at += len(part)
            ids.clear()
            segments.clear()

        held, doc_type = 0, None
        for whole in batches:
            doc_type = whole.column(0).type
            for start in range(0, whole.num_rows, 64):
                b = whole.slice(start, 64)
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    got = np.array(enc.encode_ordinary(text or ""), dtype)
                    n = max(1, -(-len(got) // length))
                    for piece in range(n):
                        ids.append(got[piece * length : (piece + 1) * length])
                        segments.append({"doc_id": doc, "piece": piece, "n_pieces": n})
                    held += len(got)
                    if held >= BLOCK_IDS:
                        yield from flush()
                        held = 0
        if segments:
            yield from flush()

    both = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return both.mapInArrow(run, PACK.format(kind=kind))


def write_packed(packs: DataFrame, path: str) -> None:
    packs.write.option("compression", "zstd").parquet(path)


def unpacked(packs: DataFrame, vocabulary: int = 50_257) -> DataFrame:
    """(doc_id, piece, n_pieces, pack_id, first, n_tokens, ids binary): the segments of
    packed rows; first is the segment's place in its row."""
    width = 2 if id_type(vocabulary) == "<u2" else 4
    rows = packs.select("pack_id", "ids", "cu_seqlens", F.posexplode("segments").alias("k", "s"))
    first, end = F.get("cu_seqlens", F.col("k")), F.get("cu_seqlens", F.col("k") + 1)
    rows = rows.select(F.col("s.doc_id").alias("doc_id"), F.col("s.piece").alias("piece"), F.col("s.n_pieces").alias("n_pieces"), "pack_id", first.alias("first"), (end - first).alias("n_tokens"), "ids")
    return rows.withColumn("ids", F.substring("ids", F.col("first") * width + 1, F.col("n_tokens") * width))


def position_ids(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Position ids of a packed row: each segment counts from 0, and so does the padding."""
    ends = np.array([*cu_seqlens, length])
    n = np.diff(ends)
    return np.arange(length) - np.repeat(ends[:-1], n)
