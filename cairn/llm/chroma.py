"""Operator 5: chroma fingerprints of recordings, and their alignment.

A recording (16-bit mono PCM) becomes frames of twelve pitch-class energies.  An integral
image over frames and classes gives the sum of any rectangle in four reads; sixteen
filters compare rectangles, each answer is quantised to two bits (a Gray code), and the
32 bits of a frame's window are one packed integer.  Recordings with equal fingerprints
are one class.  A query's integers, from four starts within a hop and with up to two of the
six least certain bits changed, are joined with those of all classes; the histogram of
their offsets says where two recordings would align, and the share of differing bits
over the whole overlap decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import stored

RATE, FRAME, HOP = 4000, 1024, 256
#: Frames of a filter's window, and the log ratio beyond which an answer is strong.
SPAN, STRONG = 16, 0.25
#: Starts within a hop at which a query is fingerprinted.
PHASES = 4
#: Notes of a rendered recording last so many samples; semitones from 220 Hz up.
NOTE, LOWEST, NOTES = 400, 220.0, 24


def filters() -> list[list[tuple[int, int, int, int, int]]]:
    """Sixteen filters as rectangles (sign, frames from, to, classes from, to): halves of
    time, halves of pitch, a checker and centre against sides, over four bands each."""
    out = []
    for low in (0, 3, 6, 8):
        high, half, mid = low + 4, SPAN // 2, low + 2
        out.append([(1, 0, half, low, high), (-1, half, SPAN, low, high)])
        out.append([(1, 0, SPAN, low, mid), (-1, 0, SPAN, mid, high)])
        out.append([(1, 0, half, low, mid), (1, half, SPAN, mid, high), (-1, half, SPAN, low, mid), (-1, 0, half, mid, high)])
        out.append([(1, SPAN // 4, 3 * SPAN // 4, low, high), (-1, 0, SPAN // 4, low, high), (-1, 3 * SPAN // 4, SPAN, low, high)])
    return out


def chroma_matrix() -> np.ndarray:
    """Frequency bins by pitch class: each bin goes to its nearest semitone's class."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(f), 12), np.float32)
    heard = np.flatnonzero((f > 100) & (f < 1800))
    out[heard, np.rint(12 * np.log2(f[heard] / LOWEST)).astype(int) % 12] = 1
    return out


_FILTERS, _CHROMA, _WINDOW = filters(), chroma_matrix(), np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by pitch classes, each frame of unit length (zero where it is silent)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = []
    for at in range(0, len(frames), 1024):
        power = np.abs(np.fft.rfft(frames[at : at + 1024] * _WINDOW, axis=1)) ** 2
        out.append(power.astype(np.float32) @ _CHROMA)
    c = np.concatenate(out)
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(norm > 1e-3, c / np.maximum(norm, 1e-3), 0)


def answers(c: np.ndarray) -> np.ndarray:
    """Windows of SPAN frames by filters: each filter's log ratio of two sums."""
    n = len(c) - SPAN + 1
    if n < 1:
        return np.empty((0, len(_FILTERS)))
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)
    out, at = np.empty((n, len(_FILTERS))), np.arange(n)
    for k, rects in enumerate(_FILTERS):
        total = {1: np.zeros(n), -1: np.zeros(n)}
        for sign, t0, t1, p0, p1 in rects:
            total[sign] += image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]
        out[:, k] = np.log1p(total[1]) - np.log1p(total[-1])
    return out


def packed_integers(a: np.ndarray) -> np.ndarray:
    """One uint32 per window from its filters' answers."""
    level = (a > -STRONG).astype(np.uint32) + (a > 0) + (a > STRONG)
    gray = level ^ level >> np.uint32(1)
    out = np.zeros(len(a), np.uint32)
    for k in range(a.shape[1]):
        out = out << np.uint32(2) | gray[:, k].astype(np.uint32)
    return out


def probes(a: np.ndarray, bits: int = 6, flips: int = 2) -> np.ndarray:
    """Probes by windows: the packed integer, and it with up to `flips` of the `bits` bits
    changed whose answers lie nearest to where they change."""
    margin = np.empty((len(a), 2 * a.shape[1]))
    margin[:, 0::2] = np.abs(a)
    margin[:, 1::2] = np.minimum(np.abs(a + STRONG), np.abs(a - STRONG))
    bit = np.uint32(1) << (margin.shape[1] - 1 - np.argsort(margin, 1, kind="stable")[:, :bits]).astype(np.uint32)
    out = [packed_integers(a)]
    for n in range(1, flips + 1):
        out += [np.bitwise_xor.reduce(bit[:, list(some)], axis=1) ^ out[0] for some in combinations(range(bits), n)]
    return np.array(out)


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, audio binary): a recording of each vector, a note per number.  The tables
    hold no media; this gives the operator a column of sound.  A null vector has none.

    Columns `late` (samples of silence in front), `noise` (its amplitude, from the id) and
    `kept` (share of the notes), where there are any, make it a worse copy of the tune."""
    kind = vectors.schema[id_col].dataType.simpleString()
    extra = [F.col(c).cast("double").alias(c) if c in vectors.columns else F.lit(v).alias(c) for c, v in (("late", 0.0), ("noise", 0.0), ("kept", 1.0))]
    t = np.arange(NOTE)
    table = np.stack([np.sin(2 * np.pi * LOWEST * 2 ** (k / 12) / RATE * t) for k in range(NOTES)])
    table = (table * np.hanning(NOTE) * 20_000).astype("<i2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                audio = []
                for i, v, late, noise, kept in zip(*[c.to_pylist() for c in b.columns]):
                    if v is None:
                        audio.append(None)
                        continue
                    x = np.nan_to_num(np.array([0.0 if e is None else e for e in v]))
                    x = x[: int(np.ceil(len(x) * kept))]
                    sound = table[np.clip(np.floor(x * 48 + NOTES / 2), 0, NOTES - 1).astype(int)].ravel()
                    if late or noise:
                        sound = np.concatenate([np.zeros(int(late)), sound.astype(float)])
                        sound = np.clip(sound + np.random.default_rng(abs(i or 0)).normal(0, noise, len(sound)), -32767, 32767).astype("<i2")
                    audio.append(sound.tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(audio, pa.binary())], names=[id_col, "audio"])

    return vectors.select(F.col(id_col), F.col(vector_col).cast("array<double>"), *extra).mapInArrow(run, f"`{id_col}` {kind}, audio binary")


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    flat = np.concatenate(values) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)), pa.array(flat, kind))


def _samples(x: bytes | None) -> np.ndarray:
    return np.frombuffer(x[: len(x) // 2 * 2] if x else b"", "<i2").astype(np.float32) / 32768


def fingerprints(recordings: DataFrame, id_col: str, audio_col: str = "audio") -> DataFrame:
    """(id_col, fingerprint array<int>): packed integers by window, as signed ints."""
    kind = recordings.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                out = [packed_integers(answers(chroma(_samples(x)))).view(np.int32) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(out, pa.int32())], names=[id_col, "fingerprint"])

    return recordings.select(F.col(id_col), F.col(audio_col)).mapInArrow(run, f"`{id_col}` {kind}, fingerprint array<int>")


def query_prints(recordings: DataFrame) -> DataFrame:
    """(q, phase, fingerprint, codes array<int>, ats array<int>) from (q, audio), a row for each
    of PHASES starts within a hop: the fingerprint, and the probes of the windows where it
    changes with their places."""
    kind = recordings.schema["q"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 16):
                b = whole.slice(at, 16)
                of, phases, prints, codes, ats = [], [], [], [], []
                for i, audio in enumerate(b.column(1).to_pylist()):
                    samples = _samples(audio)
                    for phase in range(PHASES):
                        a = answers(chroma(samples[phase * HOP // PHASES :]))
                        p = packed_integers(a)
                        new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.empty(0, np.int64)
                        code = probes(a[new]) if len(new) else np.empty((0, 0), np.uint32)
                        of.append(i)
                        phases.append(phase)
                        prints.append(p.view(np.int32))
                        codes.append(code.ravel().view(np.int32))
                        ats.append(np.tile(new, len(code)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(phases, pa.int32()), *[_lists(x, pa.int32()) for x in (prints, codes, ats)]], names=["q", "phase", "fingerprint", "codes", "ats"])

    return recordings.select("q", "audio").mapInArrow(run, f"q {kind}, phase int, fingerprint array<int>, codes array<int>, ats array<int>")


def aligned_recordings(recordings: DataFrame, id_col: str, audio_col: str = "audio", every: int = 50, least_hits: int = 2, least_overlap: int = 16, most_errors: float = 0.2) -> DataFrame:
    """(id_col, class_id, n_windows, matches array<struct<class_id, offset, phase, overlap,
    error_rate>>), a row per row.

    class_id is the smallest id with the same fingerprint.  Queries are the rows whose id
    is divisible by `every`, searched for in all rows.  matches stands at the row that is
    its class's smallest id, where the class holds a query, and is null elsewhere: the
    other classes that the class aligns with, in order of class_id.  offset is the
    match's window less the query's, and phase the quarter of a hop by which the query
    starts later, for two recordings may lie between each other's frames.  Of several
    alignments that match, the one with the least error, of equal ones the offset nearest 0
    (then the smaller), then the smaller phase.  A match has at that offset at least
    least_hits integers that equal one of the query's probes, least_overlap windows of
    overlap, and a share of differing bits of at most most_errors.

    Null or too short recordings have no windows and a null class; null ids have no class
    and are no queries.  Repeated rows are one class, and each carries its matches.  Other
    columns are not looked at.  An empty table gives an empty result.
    """
    sound = recordings.select(F.col(id_col).alias("id"), F.col(audio_col).alias("audio"))
    prints = fingerprints(sound, "id")
    prints = stored(prints.withColumn("key", F.md5(F.array_join(F.col("fingerprint").cast("array<string>"), ","))), "prints")
    live = prints.where("id is not null and size(fingerprint) > 0")
    # Windows of one class are equal, so any of its rows gives them.
    classes = stored(live.groupBy("key").agg(F.min("id").alias("class_id"), F.max((F.col("id") % every == 0).cast("int")).alias("query")), "classes")
    reps = stored(live.join(classes, "key").where("id = class_id").select("class_id", "query", "fingerprint").dropDuplicates(["class_id"]), "representatives")
    asked = sound.join(reps.where("query = 1").select(F.col("class_id").alias("q")), F.col("id") == F.col("q")).dropDuplicates(["q"])
    asked = stored(query_prints(asked.select("q", "audio")), "queries")
    # Of equal integers in a row (a held note, silence) the first stands for the run.
    starts = F.filter(F.transform("fingerprint", lambda x, i: F.struct(i.alias("at"), x.alias("code"), ((i == 0) | (F.get("fingerprint", F.greatest(i - 1, F.lit(0))) != x)).alias("new"))), lambda s: s["new"])
    items = reps.select("class_id", F.explode(starts).alias("s")).select("class_id", "s.at", "s.code")
    b = items.groupBy("class_id", "code").agg(F.collect_list("at").alias("ma")).select(F.col("class_id").alias("m"), "code", "ma")
    a = asked.select("q", "phase", F.explode(F.arrays_zip("codes", "ats")).alias("z")).select("q", "phase", F.col("z.codes").alias("code"), F.col("z.ats").alias("at"))
    a = a.groupBy("q", "phase", "code").agg(F.collect_set("at").alias("qa"))
    both = a.join(b, "code").where("q != m")
    offsets = F.flatten(F.transform("ma", lambda y: F.transform("qa", lambda x: y - x)))
    hits = both.select("q", "phase", "m", F.explode(offsets).alias("offset")).groupBy("q", "phase", "m", "offset").count().where(F.col("count") >= least_hits)
    x = asked.select("q", "phase", F.col("fingerprint").alias("fq"))
    y = reps.select(F.col("class_id").alias("m"), F.col("fingerprint").alias("fm"))
    pairs = hits.join(x, ["q", "phase"]).join(y, "m")
    start, shift = F.greatest(F.lit(0), -F.col("offset")), F.greatest(F.lit(0), F.col("offset"))
    overlap = F.least(F.size("fq") - start, F.size("fm") - shift)
    pairs = pairs.withColumn("overlap", overlap).where(F.col("overlap") >= least_overlap)
    bits = F.zip_with(F.slice("fq", start + 1, F.col("overlap")), F.slice("fm", shift + 1, F.col("overlap")), lambda p, r: F.bit_count(p.bitwiseXOR(r)))
    # bit_count() of a negative int counts its 64-bit sign extension: 32 bits too many.
    wrong = F.aggregate(F.transform(bits, lambda n: F.when(n > 32, n - 32).otherwise(n)), F.lit(0), lambda s, n: s + n)
    pairs = pairs.withColumn("error_rate", wrong / (F.col("overlap") * 32.0)).where(F.col("error_rate") <= most_errors)
    # The best of the alignments that pass.
    order = F.struct(F.col("error_rate").alias("e"), F.abs("offset").alias("d"), "offset", "phase", "overlap")
    pairs = pairs.groupBy("q", "m").agg(F.min(order).alias("b")).select("q", "m", "b.offset", "b.phase", "b.overlap", F.col("b.e").alias("error_rate"))
    found = pairs.groupBy("q").agg(F.array_sort(F.collect_list(F.struct(F.col("m").alias("class_id"), "offset", "phase", "overlap", "error_rate"))).alias("matches"))
    rows = prints.join(classes, "key", "left").withColumn("class_id", F.when(F.col("id").isNotNull() & (F.size("fingerprint") > 0), F.col("class_id")))
    owner = F.when((F.col("id") == F.col("class_id")) & (F.col("query") == 1), F.col("id"))
    rows = rows.withColumn("q", owner).join(found, "q", "left")
    matches = F.when(F.col("q").isNotNull(), F.coalesce("matches", F.array().cast(found.schema["matches"].dataType)))
    return rows.select(F.col("id").alias(id_col), "class_id", F.size("fingerprint").alias("n_windows"), matches.alias("matches"))
