"""Operator 13: words of documents that stand inside a phrase of a benchmark.

Each task reads its documents as training shards of a bounded number of words and builds
an FM-index over each: the words become numbers of the phrases' vocabulary, suffixes are
sorted, and the wavelet tree over the words before them answers ranks.  All phrases are
searched backward at once, their occurrences are located by sampled suffix positions, and
the spans of these are merged to what is to be removed.

A word that no phrase has ends every occurrence.  The index therefore holds the stretches
between such words, and of these the ones that are at least as long as the shortest phrase;
where all words belong to the vocabulary it holds the whole shard.

Documents are not shuffled.  Phrases go to the tasks in blocks of bounded bytes; where one
block doesn't hold them, the documents pass through one search after another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import dropped, stored, unused
from cairn.llm.fmindex import FMIndex
from cairn.llm.shingles import mixed, powers

#: Words of a window.
WIDTH = 10
#: What items and documents are made of, in bytes of UTF-8 after lower-casing A-Z.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_BYTES = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
#: Words of a training shard: one index is held at a time.  A longer text is a shard of its own.
SHARD_WORDS = 1 << 20
#: Bytes of phrases that go to a task at once, and pairs of a phrase and an item.
BLOCK_BYTES, BLOCK_PAIRS = 32 << 20, 1 << 18

SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("word", "words", "byte", "bytes")]), False)
_ARROW_SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in ("word", "words", "byte", "bytes")]))

_WORD = np.zeros(256, bool)
_WORD[WORD_BYTES] = True
_WORD[ord("A") : ord("Z") + 1] = True
_VALUE = mixed(np.arange(256, dtype=np.uint64), 47)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]


def item_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes, first bytes, ends) of the words of UTF-8 texts that begin at starts in data."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    power, inverse = powers(n)
    word = _WORD[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = starts[starts < n]
    before[starts] = False
    after[starts[starts > 0] - 1] = False
    first, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUE[data] * power[:n], out=sums[1:])
        h = (sums[end] - sums[first]) * inverse[first]
    return mixed(h ^ mixed((end - first).astype(np.uint64), 7), 8), first, end


def phrases(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(words array<string>, item string), a row per distinct window and item that has it."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(ITEM_WORD), F.lit(0))
    # the words are bound to a name, else the pattern would be matched again for each window
    windows = F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))), lambda i: F.slice(w, i, width)))[0]
    rows = items.where(F.col(text_col).isNotNull()).select(F.explode(windows).alias("words"), F.col(id_col).cast("string").alias("item"))
    return rows.where(F.size("words") > 0).distinct()


class Phrases:
    """A block of distinct windows, of the lengths that there are, and the items of each."""

    def __init__(self, rows: list[tuple[list[str], str | None]]):
        numbers: dict[str, int] = {}
        at: dict[tuple[int, ...], int] = {}
        self.items: list[list[str]] = []
        for words, item in rows:
            p = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words)
            if (k := at.setdefault(p, len(self.items))) == len(self.items):
                self.items.append([])
            if item is not None:
                self.items[k].append(item)
        text = [w.encode() for w in numbers]
        ends = np.cumsum([len(w) for w in text])
        hashes, _, _ = item_words(np.frombuffer(b"".join(text), np.uint8), np.concatenate([[0], ends[:-1]]))
        order = np.argsort(hashes)
        self.hashes, self.numbers, self.n_symbols = hashes[order], order + 1, len(text)
        #: 1 where a hash of the vocabulary has these 20 bits: most other words end here.
        self.seen = np.zeros(1 << 20, bool)
        self.seen[hashes >> np.uint64(44)] = True
        by: dict[int, list[int]] = {}
        for p, k in at.items():
            by.setdefault(len(p), []).append(k)
        every = list(at)
        self.by_length = {m: (np.array([every[k] for k in ks]), np.array(ks)) for m, ks in by.items()}
        self.shortest = min(by)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary, or 0."""
        out = np.zeros(len(hashes), np.int32)
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), self.n_symbols - 1)
        same = self.hashes[at] == hashes[maybe]
        out[maybe[same]] = self.numbers[at[same]]
        return out

    def stretches(self, symbols: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers with a 0 behind each stretch, their word or -1) of the stretches of words
        of the vocabulary that may hold a phrase.  firsts: where documents begin."""
        known = symbols > 0
        new = known.copy()
        new[1:] &= ~known[:-1]
        new[firsts[firsts < len(symbols)]] = known[firsts[firsts < len(symbols)]]
        begins = np.flatnonzero(new)
        number = np.cumsum(new) - 1  # of the stretch
        lengths = np.bincount(number[known], minlength=len(begins)) if len(begins) else np.empty(0, np.int64)
        long = lengths >= self.shortest
        keep = np.flatnonzero(known & long[number]) if len(begins) else np.empty(0, np.int64)
        if not len(keep):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        behind = np.cumsum(lengths[long])
        s, place = np.insert(symbols[keep].astype(np.int64), behind, 0), np.insert(keep, behind, -1)
        return s, place

    def occurrences(self, symbols: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first words, windows) of all occurrences in a shard, by the windows' length."""
        s, place = self.stretches(symbols, firsts)
        if not len(s):
            return
        index = FMIndex(s, self.n_symbols)
        for m, (windows, ks) in self.by_length.items():
            low, high = index.search(windows)
            n = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            yield m, place[index.locate(rows)], np.repeat(ks, n)


def _merged(old: list | None, hit: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[dict]:
    """The stretches of hit words of one document, with those that an earlier block found."""
    if old:
        hit = hit.copy()
        for s in old:
            hit[s["word"] : s["word"] + s["words"]] = True
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    return [{"word": a, "words": b - a, "byte": int(first[a]), "bytes": int(end[b - 1] - first[a])} for a, b in zip(begins.tolist(), ends.tolist())]


def searched(docs: DataFrame, text_col: str, block: Phrases, names: list[str], again: bool) -> DataFrame:
    """docs with n_words, spans and items of one block of phrases, under these names; again:
    docs has them already, of earlier blocks, and they are united."""
    kinds = [T.LongType(), SPANS, T.ArrayType(T.StringType(), False)]
    own = docs.columns[: len(docs.columns) - (3 if again else 0)]
    schema = T.StructType([*(docs.schema[c] for c in own), *(T.StructField(n, k, False) for n, k in zip(names, kinds))])
    column, sent = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(block)

    def of_shard(batch: pa.RecordBatch, text: pa.Array) -> pa.RecordBatch:
        phrases_, rows = sent.value, batch.num_rows
        _, places, data = text.buffers()
        ends = np.frombuffer(places, np.int64)[text.offset : text.offset + rows + 1]
        flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
        starts = ends - ends[0]
        hashes, first, end = item_words(flat, starts[:-1])
        firsts = np.searchsorted(first, starts)  # of words
        n = len(hashes)
        edges = np.zeros(n + 1, np.int32)
        pairs = []
        for m, at, windows in phrases_.occurrences(phrases_.symbols(hashes), firsts[:-1]):
            np.add.at(edges, at, 1)
            np.add.at(edges, at + m, -1)
            pairs.append(np.unique((np.searchsorted(firsts, at, "right") - 1) * len(phrases_.items) + windows))
        hit = np.cumsum(edges[:-1]) > 0
        items: dict[int, set[str]] = {}
        for p in pairs:
            for d, k in zip((p // len(phrases_.items)).tolist(), (p % len(phrases_.items)).tolist()):
                items.setdefault(d, set()).update(phrases_.items[k])
        old = [batch.column(len(own) + 1 + k).to_pylist() for k in (0, 1)] if again else None
        spans, named = [], []
        any_hit = np.add.reduceat(np.append(hit, False), firsts[:-1]) > 0 if rows else np.empty(0, bool)
        any_hit &= np.diff(firsts) > 0
        for d in range(rows):
            a, b = int(firsts[d]), int(firsts[d + 1])
            before = old[0][d] if old else None
            spans.append(_merged(before, hit[a:b], first[a:b] - starts[d], end[a:b] - starts[d]) if any_hit[d] or before else [])
            named.append(sorted(items.get(d, set()) | set(old[1][d] if old else ())))
        more = [pa.array(np.diff(firsts), pa.int64()), pa.array(spans, _ARROW_SPANS), pa.array(named, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *more], [*own, *names])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, most = 0, SHARD_WORDS * 6  # bytes; a word has about six with its blank

        def shard() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return of_shard(whole, pc.fill_null(whole.column(column).cast(pa.large_string()), ""))

        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(sizes, done + most - size, "right")))
                held.append(batch.slice(at, stop - at))
                size += int(sizes[stop - 1]) - done
                at = stop
                if size >= most:
                    yield shard()
                    held, size = [], 0
        if held:
            yield shard()

    return docs.mapInArrow(found, schema)


def blocks(rows: DataFrame, most_bytes: int = BLOCK_BYTES, most_pairs: int = BLOCK_PAIRS) -> Iterator[Phrases]:
    """The rows of phrases(), dealt by hash to blocks of about most_bytes and most_pairs."""
    size = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w)) + F.coalesce(F.octet_length("item"), F.lit(0))
    total, pairs = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    n = max(1, math.ceil(total / most_bytes), math.ceil(pairs / most_pairs))
    dealt = F.pmod(F.xxhash64("words", "item"), F.lit(n))
    for k in range(n):
        if got := [(r["words"], r["item"]) for r in rows.where(dealt == k).collect()]:
            yield Phrases(got)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, most_bytes: int = BLOCK_BYTES, most_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """docs with three more columns: n_words long; spans array<struct<word, words, byte, bytes>>,
    the merged stretches of words that lie inside an occurrence of a window, by word number
    (from 0) and by bytes of the text's UTF-8; items array<string>, the sorted ids, as
    strings, of the items that have an occurring window.

    Words are stretches of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z.  A
    window is `width` consecutive words of an item; an item of fewer words, but not none, is
    one window.  Null and empty texts have no words, spans or items; items without words have
    no windows; the windows of an item whose id is null are searched, but it isn't listed, and
    an id that stands twice is listed once.  Every row of docs is judged by itself, so repeated
    rows and ids give repeated results.  Where docs has a column of one of the new names, the
    new one is lengthened by underscores.
    """
    names = unused(docs, "n_words", "spans", "items")
    rows = stored(phrases(benchmark, item_id, item_text, width), "phrases")
    out, again = docs, False
    for block in blocks(rows, most_bytes, most_pairs):
        out, again = searched(out, text, block, names, again), True
    dropped(rows)  # all blocks are on their way
    if again:
        return out
    lower = F.coalesce(F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    plain = {names[0]: F.regexp_count(lower, F.lit(ITEM_WORD)).cast("long"), names[1]: F.array().cast(SPANS), names[2]: F.array().cast("array<string>")}
    return docs.select("*", *(c.alias(n) for n, c in plain.items()))


def without_spans(found: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """The rows of contaminated_spans() with each span cut out of the text."""
    raw = F.col(text).cast("binary")
    joined = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").cast("binary").alias("kept")),
        lambda x, s: F.struct((s["byte"] + s["bytes"]).alias("at"), F.concat(x["kept"], F.substring(raw, (x["at"] + 1).cast("int"), (s["byte"] - x["at"]).cast("int"))).alias("kept")),
        lambda x: F.concat(x["kept"], F.substring(raw, (x["at"] + 1).cast("int"), F.octet_length(raw))),
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, joined.cast("string")).otherwise(F.col(text)))
