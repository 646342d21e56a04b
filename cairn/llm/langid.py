"""Operator 2: language of a text by a string kernel.

Blended-spectrum presence kernel: of two texts, the number of distinct (hashed) character
n-grams, n from 1 to 4, that both hold, over the geometric mean of their own numbers.
Nyström: the kernel against `landmarks` labelled texts, whitened by their own kernel
matrix, stands for the full kernel.  One kernel ridge regression per language, one
against the rest, is solved in that space.  A batch of texts is scored by two matrix
products: presence by landmarks, kernel by languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3, 4)
BITS = 15
#: Texts of a matrix product.
BATCH = 64


class Model(NamedTuple):
    languages: list[str]
    landmarks: np.ndarray  # presence of each bucket in each landmark over the root of the landmark's size
    weights: np.ndarray  # landmarks by languages


def presence(texts: list[str]) -> np.ndarray:
    """Texts by buckets: whether the text holds an n-gram of the bucket."""
    out = np.zeros((len(texts), 1 << BITS), bool)
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(c) for c in codes])
    flat = np.concatenate(codes).astype(np.uint64) if codes else np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
    h = np.zeros(len(flat), np.uint64)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(flat) < n:
                break
            h = h[: len(flat) - n + 1] * np.uint64(0x100000001B3) + flat[n - 1 :] + np.uint64(1)
            bucket = ((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)
            ok = left[: len(h)] >= n
            out[row[: len(h)][ok], bucket[ok]] = True
    return out


def kernel(seen: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    seen = seen.astype(np.float32)
    return (seen @ landmarks) / np.sqrt(np.maximum(seen.sum(1, keepdims=True), 1))


def letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(ids: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(rows: DataFrame, per_language: int) -> list:
    """About per_language rows (id, text, lang) of each language, those of smallest hash.

    Two scans: one counts the rows of each language, the other takes those whose hash is
    below the share that the counts call for.  What reaches the driver is bounded by
    1.5 * per_language rows a language, in expectation, whatever the table's size."""
    counts = rows.groupBy("lang").count()
    share = counts.select(F.col("lang").alias("lang_"), F.least(F.lit(1.0), F.lit(1.5 * per_language) / F.col("count")).alias("share_"))
    unit = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    got = rows.join(F.broadcast(share), F.col("lang") == F.col("lang_")).where(unit < F.col("share_")).where(letters(F.col("text")))
    return sorted(got.select("lang", unit.alias("u"), "id", "text").collect(), key=lambda r: (r["lang"], r["u"], r["id"]))


def fit(rows: list, per_language: int, landmarks: int, ridge: float = 1e-2) -> Model | None:
    """The model of labelled rows (lang, text), in the order in which they are to be taken."""
    taken: dict[str, list[str]] = {}
    for r in rows:
        own = taken.setdefault(r["lang"], [])
        if len(own) < per_language and r["text"] not in own[-3:]:
            own.append(r["text"])
    if not taken:
        return None
    names = sorted(taken)
    marks = [t for k in names for t in taken[k][: max(1, landmarks // len(names))]]
    seen = presence(marks).astype(np.float32)
    table = np.ascontiguousarray((seen / np.sqrt(np.maximum(seen.sum(1, keepdims=True), 1))).T)
    own = kernel(seen, table).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    good = value > 1e-6 * value.max()
    white = vector[:, good] / np.sqrt(value[good])
    gram, right, n = np.zeros((good.sum() + 1, good.sum() + 1)), np.zeros((good.sum() + 1, len(names))), 0
    for k, name in enumerate(names):
        for at in range(0, len(taken[name]), BATCH):
            part = kernel(presence(taken[name][at : at + BATCH]), table) @ white
            part = np.hstack([part, np.ones((len(part), 1))]) / np.sqrt(len(taken[name]))  # languages weigh alike
            gram += part.T @ part
            right[:, k] += part.sum(0) / np.sqrt(len(taken[name]))
    beta = np.linalg.solve(gram + ridge * np.eye(len(gram)), right)
    return Model(names, table, np.vstack([white @ beta[:-1], beta[-1:]]).astype(np.float32))


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    k = kernel(presence(texts), model.landmarks)
    out = k @ model.weights[:-1] + model.weights[-1]
    return [model.languages[i] for i in out.argmax(1)], np.clip(out.max(1), 0, 1).astype(np.float64)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, landmarks: int = 96) -> DataFrame:
    """(id_col, held_out, lang_pred, score), a row per row of docs.

    Fitted on at most per_language texts of each language among the rows that are not held
    out and have a language; predicted for every whole text from the text alone.  `und`
    with score 0 for a null text, one without a letter, and everywhere if no row can be
    learned from.  Rows with a null id are not learned from, and not held out.  Ties go
    to the language that sorts first.  Repeated rows are rows of their own.  Other columns
    are not looked at.  An empty table gives an empty result.

    The model that tasks get is 2^15 by `landmarks` floats, whatever the corpus.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    learn = rows.where(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("lang").isNotNull())
    model = fit(sampled(learn, per_language), per_language, landmarks)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                texts, known = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                names, score = ["und"] * len(texts), np.zeros(len(texts))
                which = [i for i, k in enumerate(known) if k and model]
                if which:
                    got, s = predict(model, [texts[i] for i in which])
                    score[which] = s
                    for i, name in zip(which, got):
                        names[i] = name
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)], names=[id_col, "held_out", "lang_pred", "score"])

    both = rows.select("id", held_out(F.col("id")).alias("h"), "text", letters(F.col("text")).alias("known"))
    return both.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
