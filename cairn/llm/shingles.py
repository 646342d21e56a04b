"""Word shingles in tasks: numpy over the bytes of Arrow string batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes that part words.
BLANK_BYTES = [0x20, *range(0x09, 0x0E)]
#: Bytes of text that are hashed at a time; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixing function (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[BLANK_BYTES] = True
_EXACT = mixed(np.arange(256, dtype=np.uint64), 31)
_LOWER = _EXACT.copy()
_LOWER[ord("A") : ord("Z") + 1] = _EXACT[ord("a") : ord("z") + 1]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2^64, n of them at least."""
    size = max(SLICE_BYTES, 1 << int(n).bit_length())
    if size not in _powers:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if size > SLICE_BYTES:
            return made[0], made[1]  # of a very long text; not kept
        _powers[size] = (made[0], made[1])
    return _powers[size]


def hash_words(data: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of UTF-8 texts, offsets of each text's words).

    data holds the bytes of all texts, ends where each ends.  A word's hash is the
    polynomial of its bytes' random values, from running sums over all of them, mixed."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(ends) + 1, np.int64)
    power, inverse = powers(n)
    blank = _BLANK[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    before[starts[starts < n]] = True
    after[starts[(starts > 0) & (starts <= n)] - 1] = True
    first, last = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((_LOWER if lower else _EXACT)[data] * power[:n], out=sums[1:])
        h = (sums[last] - sums[first]) * inverse[first]
    return mixed(h ^ mixed((last - first).astype(np.uint64), 5), 6), np.searchsorted(first, np.concatenate([starts, [n]]), "left")


def word_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES, lower: bool = True) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, offsets from 0, word hashes) of a string column, a bounded number of bytes at a
    time.  A null text has no words.  lower: words are compared after lower-casing A-Z."""
    text = batch.column(column)
    if text.null_count:
        text = pc.fill_null(text, "")
    _, places, data = text.buffers()
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    ends = np.frombuffer(places, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < batch.num_rows:
        end = min(batch.num_rows, max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1))
        hashes, offsets = hash_words(flat[ends[at] : ends[end]], ends[at + 1 : end + 1] - ends[at], lower)
        yield batch.slice(at, end - at), offsets, hashes
        at = end


def windows_of(flat: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all windows of `width` words, offsets of each row's windows).  A row with
    fewer words, but at least one, has its whole sequence as its one window."""
    n = np.diff(offsets)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        whole = np.zeros(max(len(flat) - width + 1, 0), np.uint64)
        for k in range(width):
            whole = whole * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + len(whole)]
        got = np.empty(int(out[-1]), np.uint64)
        long = n >= width
        starts = np.repeat(offsets[:-1][long] - out[:-1][long], counts[long])
        at = np.flatnonzero(np.repeat(long, counts))
        got[at] = whole[at + starts]
        for i in np.flatnonzero(~long & (n > 0)):
            h = int(n[i])
            for w in flat[offsets[i] : offsets[i + 1]].tolist():
                h = (h * 0xD6E8FEB86659FD93 + w) & (2**64 - 1)
            got[out[i]] = np.uint64(h)
    return mixed(got, width), out


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted, without repeats, and their offsets."""
    values = values.copy()
    bounds = offsets.tolist()
    for a, b in zip(bounds, bounds[1:]):
        values[a:b].sort()
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    first[starts] = True
    return values[first], np.concatenate([[0], np.cumsum(first)])[offsets]
