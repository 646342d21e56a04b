"""Operator 1: mixing a corpus to target weights by soft membership.

1. Domains come from the labelled table: `toxic`, else `good` or `low` by quality.  A
   classifier gives every document posteriors over them: smoothed log ratios of hashed
   words (present or not) between each domain and the rest, and a softmax regression over
   two sums of these per domain.
2. Every document d gets a rate w_d >= 0 so that the expected tokens of each domain,
   sum of w_d n_d p_dk, match the targets in the least-squares sense.  Projected gradient
   from w = 1: each step is one aggregation over the corpus, to K sums, and a row-wise
   update.  The norm is that of the K x K matrix sum n_d p_d p_d', in which a step of 1
   is safe and few are needed.  Targets out of reach take accelerated steps, until a bound
   by the dual proves the loss to be least.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import stored
from cairn.llm.shingles import distinct, word_slices

DOMAINS = ("good", "low", "toxic")
BITS = 16
#: Log ratio above which a word counts as telling.
TELLING = 2.5
#: Steps between two written states of the rates.
STRIDE = 8


class Model(NamedTuple):
    ratios: np.ndarray  # buckets by domains
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # features and bias by domains


def labelled(labels: DataFrame, most: int) -> DataFrame:
    """(label_id, domain, half): at most `most` labelled ids, those of smallest hash.  A row
    without quality and toxic tells nothing; of contradicting rows the worst counts."""
    rows = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    one = rows.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    domain = F.when(F.col("t") == 1, 2).when(F.col("q") == 0, 1).otherwise(0)
    h = F.xxhash64("doc_id")
    return one.select(F.col("doc_id").alias("label_id"), domain.alias("domain"), F.pmod(F.shiftright(h, 40), F.lit(2)).alias("half"), h.alias("h")).orderBy("h", "label_id").limit(most).drop("h")


def _buckets(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each row's words, and their offsets."""
    return distinct(flat & np.uint64((1 << BITS) - 1), offsets)


def _listed(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _counted(rows: DataFrame) -> DataFrame:
    """(other columns, b array<int>): the distinct buckets of the last column's words."""
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, offsets, flat in word_slices(whole, len(names)):
                b, at = _buckets(flat, offsets)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _listed(b.astype(np.int32), at)], names=[*names, "b"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, b array<int>")


def _scored(text: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(id, n_tokens, x array<float>) from (id, text)."""
    kind = text.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, offsets, flat in word_slices(whole, 1):
                x = features(*_buckets(flat, offsets), ratios)
                lists = _listed(x.astype(np.float32).ravel(), np.arange(len(x) + 1) * x.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), lists], names=["id", "n_tokens", "x"])

    return text.mapInArrow(run, f"id {kind}, n_tokens bigint, x array<float>")


def features(bucket: np.ndarray, at: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Rows by 2K: the mean log ratio of the distinct words, and the log of what the telling
    ones exceed TELLING by."""
    n, k = len(at) - 1, ratios.shape[1]
    out = np.zeros((n, 2 * k))
    size = np.diff(at)
    some = size > 0
    if some.any():
        r = ratios[bucket.astype(np.int64)]
        starts = at[:-1][some]
        out[some, :k] = np.add.reduceat(r, starts, axis=0) / size[some, None]
        out[some, k:] = np.log1p(np.add.reduceat(np.maximum(r - TELLING, 0), starts, axis=0))
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def regression(x: np.ndarray, y: np.ndarray, k: int, steps: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, v = np.zeros((z.shape[1], k)), np.zeros((z.shape[1], k))
    hot = np.eye(k)[y]
    for _ in range(steps):
        v = 0.9 * v - 0.5 * (z.T @ (softmax(z @ w) - hot) / len(z) + ridge * w)
        w = w + v
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, most: int) -> Model | None:
    """One half of the labelled sample counts words, the other fits the regression."""
    k = len(DOMAINS)
    rows = docs.join(F.broadcast(labelled(labels, most)), F.col("id") == F.col("label_id"))
    rows = stored(_counted(rows.select("id", "domain", "half", F.col("text").cast("string"))), "labelled")
    size = np.zeros((2, k))
    for r in rows.groupBy("half", "domain").count().collect():
        size[r["half"], r["domain"]] = r["count"]
    if not size[0].sum() or not size[1].sum():
        return None
    counts = np.zeros((1 << BITS, k))
    seen = rows.where("half = 0").select("domain", F.explode("b").alias("b")).groupBy("b").agg(*[F.sum((F.col("domain") == i).cast("long")).alias(f"n{i}") for i in range(k)])
    for r in seen.collect():  # at most 2^BITS rows
        counts[r["b"]] = [r[f"n{i}"] for i in range(k)]
    total, all_ = size[0].sum(), counts.sum(1)
    ratios = np.zeros((1 << BITS, k))
    for i in range(k):
        own = size[0, i]
        share = own / total
        if 0 < own < total:
            ratios[:, i] = np.log((counts[:, i] + 4 * share) / (own + 8 * share)) - np.log((all_ - counts[:, i] + 4 * (1 - share)) / (total - own + 8 * (1 - share)))
    table = ratios

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = part.column(1)
            x = features(lists.values.to_numpy().astype(np.uint64), lists.offsets.to_numpy().astype(np.int64), table)
            yield pa.RecordBatch.from_arrays([part.column(0), _listed(x.ravel(), np.arange(len(x) + 1) * x.shape[1])], names=["domain", "x"])

    got = rows.where("half = 1").select("domain", "b").mapInArrow(measure, "domain int, x array<double>").collect()  # at most `most` rows of 2K numbers
    x, y = np.array([r["x"] for r in got], float), np.array([r["domain"] for r in got])
    order = np.lexsort((*x.T, y))  # sums do not depend on the order in which rows arrive
    return Model(ratios, *regression(x[order], y[order], k))


def posteriors(docs: DataFrame, labels: DataFrame, most: int = 40_000) -> DataFrame:
    """(id, n_tokens, p array<double>) over DOMAINS from docs (id, text); uniform where
    there is nothing to learn from."""
    model = fit(docs, labels, most)
    text, k = docs.select("id", F.col("text").cast("string")), len(DOMAINS)
    if model is None:
        return _scored(text, np.zeros((1 << BITS, k))).select("id", "n_tokens", F.array(*[F.lit(1.0 / k)] * k).alias("p"))
    x = _scored(text, model.ratios)
    logits = []
    for i in range(k):
        parts = [(F.get("x", j).cast("double") - float(model.mean[j])) * float(model.weights[j, i] / model.scale[j]) for j in range(2 * k)]
        logits.append(sum(parts, F.lit(float(model.weights[-1, i]))))
    rows = x.select("id", "n_tokens", *[z.alias(f"z{i}") for i, z in enumerate(logits)])
    top = F.greatest(*[f"z{i}" for i in range(k)])
    rows = rows.select("id", "n_tokens", F.array(*[F.exp(F.col(f"z{i}") - top) for i in range(k)]).alias("e"))
    norm = sum((F.get("e", i) for i in range(1, k)), F.get("e", 0))
    return rows.select("id", "n_tokens", F.array(*[F.get("e", i) / norm for i in range(k)]).alias("p"))


def _moved(w: Column, steps: list[np.ndarray]) -> Column:
    """The rate after these steps: each adds p . step and projects on w >= 0."""
    for s in steps:
        w = F.greatest(F.lit(0.0), w + sum((F.get("p", i) * float(c) for i, c in enumerate(s[1:], 1)), F.get("p", 0) * float(s[0])))
    return w


def _glided(steps: list[tuple[float, np.ndarray]]) -> Column:
    """struct (w, v), the rate and the one before, after these steps (momentum, step)."""
    if not steps:
        return F.struct("w", "v")
    table = F.array(*[F.struct(F.lit(float(b)).alias("b"), F.array(*[F.lit(float(c)) for c in s]).alias("s")) for b, s in steps])
    dot = lambda s: sum((F.get("p", i) * F.get(s, i) for i in range(1, len(DOMAINS))), F.get("p", 0) * F.get(s, 0))
    return F.aggregate(table, F.struct("w", "v"), lambda x, y: F.struct(F.greatest(F.lit(0.0), x["w"] + y["b"] * (x["w"] - x["v"]) + dot(y["s"])).alias("w"), x["w"].alias("v")))


def _approached(now: DataFrame, want: np.ndarray, inverse: np.ndarray, tolerance: float, gap: float) -> DataFrame:
    """now (with rates w) after accelerated projected gradient steps, for targets out of reach.

    In the norm of `inverse` a step of 1 is safe.  The steps end when the loss is proven to be
    within the share `gap` of the least: no row's rate can lower it by more than `least` a
    token, and what the rates weigh together is bounded by what they are.  Momentum is
    dropped where the loss grows."""
    k, n = len(DOMAINS), F.col("n_tokens")
    now, steps, t, before, loss, dual = now.withColumn("v", F.col("w")), [], 1.0, None, None, np.zeros(k)
    while True:
        state = now.select("n_tokens", "p", _glided(steps).alias("x"))
        sums = [F.sum(n).alias("n"), *[F.sum(F.col("x.w") * n * F.get("p", i)).alias(f"s{i}") for i in range(k)]]
        rise = sum((F.get("p", i) * float(c) for i, c in enumerate(dual[1:], 1)), F.get("p", 0) * float(dual[0]))
        got = state.agg(*sums, F.max(F.when(n > 0, rise)).alias("rise")).first()
        z = np.array([got[f"s{i}"] for i in range(k)]) / got["n"]
        if np.abs(want - z).sum() < tolerance:
            return now.withColumn("w", _glided(steps)["w"]).drop("v")
        if loss is not None and max(-(dual @ before), 0.0) + max(got["rise"], 0.0) * before.sum() <= gap * loss:
            return now.withColumn("w", _glided(steps[:-1])["w"]).drop("v")
        after = (want - z) @ inverse @ (want - z) / 2
        t, last = (1.0 if loss is not None and after > loss else t), t
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, t = (t - 1) / ahead, ahead
        y = z if before is None else z + momentum * (z - before)
        loss, dual, before = after, inverse @ (want - z), z
        steps.append((momentum, inverse @ (want - y)))
        if len(steps) > 4 * STRIDE:
            # the last step stays out: the one before may be what is returned
            x = _glided(steps[:-1])
            now, steps = stored(now.withColumn("x_", x).drop("w", "v").select("*", "x_.w", "x_.v").drop("x_"), "rates"), steps[-1:]


def fitted_rates(rows: DataFrame, targets: dict[str, float], growth: float = 1.0, newton_steps: int = 64, tolerance: float = 1e-4, gap: float = 5e-4) -> DataFrame:
    """(id, n_tokens, p, rate) from (id, n_tokens, p): rates whose expected domain tokens
    match growth * (all tokens) * targets / sum(targets), to `tolerance` of all tokens, or
    where no rates >= 0 do so, whose loss is within the share `gap` of the least.

    A step is scaled by the matrix of the rows with a rate above 0, for the others do not
    move; one that makes the residual larger is taken back for the safe one, which is
    scaled by the matrix of all rows.  Where newton_steps of these have not met the targets,
    or the residual stands still, accelerated steps go on until the loss is proven least."""
    k = len(DOMAINS)
    now, steps, trial, before = stored(rows.withColumn("w", F.lit(1.0)), "rates"), [], None, None
    want = np.array([targets[d] for d in DOMAINS], float)
    want, every, safe, met, slow = growth * want / want.sum(), None, True, False, 0
    for _ in range(newton_steps):
        w = _moved(F.col("w"), [*steps, trial] if trial is not None else steps)
        n = F.col("n_tokens")
        sums = [F.sum(n).alias("n"), *[F.sum(F.col("w") * n * F.get("p", i)).alias(f"s{i}") for i in range(k)]]
        sums += [F.sum(F.when(F.col("w") > 0, n * F.get("p", i) * F.get("p", j)).otherwise(0.0)).alias(f"h{i}{j}") for i in range(k) for j in range(i, k)]
        got = now.select("n_tokens", "p", w.alias("w")).agg(*sums).first()
        if not got["n"]:
            met = True
            break
        residual = want - np.array([got[f"s{i}"] for i in range(k)]) / got["n"]
        scale = np.array([[got[f"h{min(i, j)}{max(i, j)}"] for j in range(k)] for i in range(k)]) / got["n"]
        every = scale if every is None else every
        inverse = np.linalg.pinv(every, rcond=1e-9)
        if trial is not None and not safe and residual @ inverse @ residual > before @ inverse @ before:
            trial, safe = inverse @ before, True
            continue
        slow = slow + 1 if before is not None and residual @ inverse @ residual > 0.8 * (before @ inverse @ before) else 0
        steps, before = [*steps, trial] if trial is not None else steps, residual
        if len(steps) == STRIDE:
            now, steps = stored(now.withColumn("w", _moved(F.col("w"), steps)), "rates"), []
        trial = None
        if np.abs(residual).sum() < tolerance:
            met = True
            break
        if slow == 4:
            break
        trial, safe = np.linalg.pinv(scale, rcond=1e-9) @ residual, False
    now = now.withColumn("w", _moved(F.col("w"), steps))
    if not met:
        now = _approached(stored(now, "rates"), want, inverse, tolerance, gap)
    return now.select("id", "n_tokens", "p", F.col("w").alias("rate"))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], growth: float = 1.0, id_col: str = "doc_id", text_col: str = "text", most: int = 40_000) -> DataFrame:
    """(id_col, n_tokens, p_good, p_low, p_toxic, rate), a row per row of docs.

    n_tokens counts words.  targets are weights of DOMAINS, and growth scales the whole.
    The classifier is fitted on at most `most` labelled documents; everything else reads
    all rows.  A null or blank text has no tokens and the posteriors that the regression
    gives no evidence; its rate follows from these like any other.  Null and repeated ids
    keep their rows; equal texts get equal rates.  Other columns are not looked at.
    An empty table gives an empty result; without usable labels posteriors are uniform.
    Targets that no rates >= 0 reach are approached in the norm of the module's text, to a
    loss that is proven to be at most 1.0005 times the least.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rates = fitted_rates(posteriors(rows, labels, most), targets, growth)
    return rates.select(F.col("id").alias(id_col), "n_tokens", *[F.get("p", i).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate")


def copies(rate: Column, id_: Column, seed: int = 5) -> Column:
    """How often a document is drawn: its rate, rounded up or down by a hash of its id."""
    unit = F.pmod(F.xxhash64(id_, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + unit).cast("int")
