"""Operator 11: runs, the maximal periodic stretches of words of a text.

A text's words become numbers.  Under an order of these and under its reverse, a stack
that is scanned right to left holds the starts of the Lyndon factors, so that the top
left by a position's comparisons is its next smaller suffix, and the words between are
the longest Lyndon word that starts there.  Every run begins such a word within its
first period under one of the two orders and repeats it, so extending the pairs of
equal first words to both sides gives every run, with its smallest period.

Suffixes are compared by their longest common extension: a few words directly, then by
a binary search over rolling hashes, whose answer is checked on the words themselves.
A stretch that repeats at a distance is measured once: later comparisons at this
distance within it read its end, so a text of one repeated word takes linear time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairn.llm.common import unused

#: A run has at least this many words.
LEAST = 12
#: Words that are compared one by one before hashes are.
NEAR = 12
#: Modulus and base of the rolling hash.
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E689 % ((1 << 61) - 1)
#: Powers of the base that a worker keeps between texts.
KEPT = 1 << 20
#: Bytes of text whose results are held at a time.
SLICE_BYTES = 4 << 20

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_powers = [1]


def _power(n: int) -> list[int]:
    """The first powers of the base, n + 1 of them at least."""
    global _powers
    out = _powers
    if len(out) <= n:
        out = out + list(accumulate(range(n + 1 - len(out)), lambda x, _: x * BASE % PRIME, initial=out[-1] * BASE % PRIME))
        _powers = out if len(out) <= KEPT else _powers
    return out


class Extensions:
    """Longest common extensions of two places of a sequence of numbers."""

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)
        self.sums: list[int] = []
        self.packed = b""
        #: distance -> (first word, end) of the last stretch that repeats at this distance
        self.known: dict[int, tuple[int, int]] = {}

    def _equal(self, i: int, j: int, n: int) -> bool:
        """Whether n words from i and from j on have equal hashes."""
        s, p = self.sums, self.power[n]
        return (s[i + n] - s[i] * p - s[j + n] + s[j] * p) % PRIME == 0

    def _same(self, i: int, j: int, n: int) -> bool:
        return self.packed[4 * i : 4 * (i + n)] == self.packed[4 * j : 4 * (j + n)]

    def _prepare(self) -> None:
        self.sums = list(accumulate(self.ids, lambda s, x: (s * BASE + x + 1) % PRIME, initial=0))
        self.power = _power(self.n)
        self.packed = b"".join(x.to_bytes(4, "little") for x in self.ids)

    def _ahead(self, i: int, j: int, n: int) -> int:
        """Common words from i and j > i on, of which n are known."""
        most, step = self.n - j, 2 * NEAR
        while n < most and self._equal(i + n, j + n, part := min(step, most - n)):
            n, step = n + part, 2 * step
        low, high = n, min(most, n + step)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self._equal(i + n, j + n, mid - n) else (low, mid - 1)
        if self._same(i, j, low):
            return low
        return next((k for k in range(low) if self.ids[i + k] != self.ids[j + k]), low)

    def _behind(self, i: int, j: int) -> int:
        """Common words before i and before j > i."""
        n, step = 0, NEAR
        while n < i and self._equal(i - n - (part := min(step, i - n)), j - n - part, part):
            n, step = n + part, 2 * step
        low, high = n, min(i, n + step)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self._equal(i - mid, j - mid, mid - n) else (low, mid - 1)
        if self._same(i - low, j - low, low):
            return low
        return next((k for k in range(low) if self.ids[i - 1 - k] != self.ids[j - 1 - k]), low)

    def ahead(self, i: int, j: int) -> int:
        """Common words from i and j > i on, where the first are equal."""
        first, end = self.known.get(j - i, (0, 0))
        if first <= i and j < end:
            return end - j
        ids, n, most = self.ids, 1, min(NEAR, self.n - j)
        while n < most and ids[i + n] == ids[j + n]:
            n += 1
        if n < NEAR:
            return n
        if not self.sums:
            self._prepare()
        n = self._ahead(i, j, n)
        self.known[j - i] = (i - self._behind(i, j), j + n)
        return n

    def start(self, i: int, j: int) -> int:
        """The first word of the stretch that repeats at distance j - i and holds i."""
        first, end = self.known.get(j - i, (0, 0))
        if first <= i and j < end:
            return first
        ids, n, most = self.ids, 0, min(NEAR, i)
        while n < most and ids[i - 1 - n] == ids[j - 1 - n]:
            n += 1
        if n < NEAR:
            return i - n
        if not self.sums:
            self._prepare()
        return i - self._behind(i, j)


def runs(ids: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `least` numbers, by start and period."""
    n, found = len(ids), set()
    if n < max(least, 2):
        return []
    extensions = Extensions(ids)
    ahead, start = extensions.ahead, extensions.start
    for order in (ids, [-x for x in ids]):
        values = [*order, -n - 1]  # the end is smaller than all words under both orders
        stack = [n]
        for i in range(n - 1, -1, -1):
            x = values[i]
            while (y := values[top := stack[-1]]) >= x:
                if y == x:
                    same = ahead(i, top)
                    if values[top + same] < values[i + same]:
                        period, end = top - i, top + same
                        if end - (first := start(i, top)) >= 2 * period:
                            found.add((first, end - first, period))
                        break
                stack.pop()
            stack.append(i)
    return sorted(r for r in found if r[1] >= least)


def numbered(words: list[bytes]) -> list[int]:
    """Words as numbers: equal words, and no others, have equal numbers."""
    seen: dict[bytes, int] = {}
    return [seen.setdefault(w, len(seen)) for w in words]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    kept, at = [], 0
    for low, high in sorted((s + q, s + n) for s, n, q in found):
        if high > at:
            kept += words[at : max(low, at)]
            at = high
    return b" ".join(kept + words[at:])


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with three more columns: n_words long, runs array<struct<start, length, period>>
    by start and period, collapsed string.

    Words are stretches of `[^\\x20\\x09-\\x0D]`.  A run has at least max(least, 2 * period)
    words, its period is its smallest, and no neighbouring word keeps it.  `collapsed` has the
    words that no run holds after its first period, joined by one space.  A null or empty
    text has no words, no runs and an empty collapsed text.  Every row is judged by itself,
    so repeated rows and ids give repeated results.  Where docs has a column of one of the
    new names, the new one is lengthened by underscores.  Texts have at most 2^31 words.
    """
    names = unused(docs, "n_words", "runs", "collapsed")
    kinds = [T.LongType(), RUNS, T.StringType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k, False) for n, k in zip(names, kinds))])
    column = docs.columns.index(text)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).cast(pa.large_binary())
            n, r, c, rows, size = [], [], [], 0, 0
            for k in range(batch.num_rows):
                words = (texts[k].as_py() or b"").split()  # bytes are split at the same six characters
                here = runs(numbered(words), least)
                n.append(len(words))
                r.append([{"start": s, "length": m, "period": q} for s, m, q in here])
                c.append(collapsed(words, here))
                size += len(c[-1])
                if size >= SLICE_BYTES or k + 1 == batch.num_rows:
                    more = [pa.array(n, pa.int64()), pa.array(r, _ARROW_RUNS), pa.array(c, pa.binary()).view(pa.string())]
                    yield pa.RecordBatch.from_arrays([*batch.slice(rows, k + 1 - rows).columns, *more], [*batch.schema.names, *names])
                    n, r, c, rows, size = [], [], [], k + 1, 0

    return docs.mapInArrow(found, schema)
