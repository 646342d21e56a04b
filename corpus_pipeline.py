"""The corpus pipeline: quality rules, near-duplicate documents, repeated passages, mixing
to target weights, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result
as Parquet into the folder that the cluster shares and gives it to the next.  All stages
but the last return the columns of documents.  Stages work on every row they are given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import dropped, small, stored, table, unused
from cairn.llm.jaccard import jaccard_components
from cairn.llm.mixing import DOMAINS, copies, fitted_rates, posteriors
from cairn.llm.quality import quality_verdicts
from cairn.llm.queries import ARROW_BYTES, ARROW_ROWS, MIX
from cairn.llm.sentencepieces import digests, encode_decode
from cairn.llm.substrings import repeated_passages, without_passages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less the rows with these ids (doc_id); rows with a null id stay."""
    return docs.join(small(stored(ids.distinct(), "dropped")), "doc_id", "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.  Of rows that repeat an id, all go if one is rejected; a row
    with a null id stays.  The verdicts are written first: a filter on them that Spark may
    move into their plan would hash a text's words again for each of its n-grams."""
    verdicts = stored(quality_verdicts(docs, table(spark, sf_dir, "labels")).select("doc_id", "kept"), "verdicts")
    return _without(docs, verdicts.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the smallest id stays; of rows that
    repeat this id, that with the smallest text (then the smallest of all columns as JSON).
    Rows with a null id stay."""
    found = jaccard_components(docs)
    kept = _without(docs, found.where("component_id != doc_id").select("doc_id"))
    again = small(stored(kept.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated"))
    once = kept.join(again, "doc_id", "left_anti").select(*docs.columns)
    row = F.struct(*[kept[c] for c in docs.columns])
    first = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row"))
    return once.union(first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds too are cut out; documents of which
    no word stays go.  n_chars counts the new text."""
    cut = without_passages(docs, stored(repeated_passages(docs), "passages"))
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing_targets(shares: dict[str, float]) -> dict[str, float]:
    """Tokens of each domain to aim at, from those of the input, both per token of the input:
    all of good, and of the others as MIX has them beside good, but no more than there are."""
    return {d: n if d == "good" else min(n, shares["good"] * MIX[d] / MIX["good"]) for d, n in shares.items()}


def document_rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, p, rate): rates for mixing_targets.  Domains that are aimed at as
    they are count as good in p, for a rare one's few documents would otherwise make up for
    what goes with others.  Clean documents, labelled so or more good than anything else,
    have a rate of 1 at least."""
    rows = stored(posteriors(docs.select(F.col("doc_id").alias("id"), "text"), labels), "posteriors")
    got = rows.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * F.get("p", i)).alias(d) for i, d in enumerate(DOMAINS)]).first()
    shares = {d: got[d] / got["n"] if got["n"] else 1 / len(DOMAINS) for d in DOMAINS}
    targets = mixing_targets(shares)
    less = [d for d in DOMAINS if targets[d] < shares[d]]
    good = sum((F.get("p", i) for i, d in enumerate(DOMAINS) if d not in less), F.lit(0.0))
    p = F.array(*[good if d == "good" else F.get("p", i) if d in less else F.lit(0.0) for i, d in enumerate(DOMAINS)])
    targets = {d: sum(shares[e] for e in DOMAINS if e not in less) if d == "good" else targets[d] if d in less else 0.0 for d in DOMAINS}
    rates = fitted_rates(rows.withColumn("p", p), targets, sum(targets.values()))
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("label_id"))
    clean = known.agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("coalesce(q, 1) != 0 and coalesce(t, 0) != 1").select("label_id")
    most = F.get("p", DOMAINS.index("good")) >= F.array_max("p")
    both = rates.join(clean, F.col("id") == F.col("label_id"), "left")
    held = F.when(most | F.col("label_id").isNotNull(), F.greatest(F.lit(1.0), "rate")).otherwise(F.col("rate"))
    return both.select(F.col("id").alias("doc_id"), "n_tokens", "p", held.alias("rate"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands in the result as often as its rate says, rounded by a hash;
    clean ones once at least."""
    rates = document_rates(docs, table(spark, sf_dir, "labels"))
    id_, times, copy = unused(docs, "drawn_id_", "copies_", "copy_")
    drawn = rates.where("doc_id is not null").groupBy(F.col("doc_id").alias(id_)).agg(F.max(copies(F.col("rate"), F.col("doc_id"))).alias(times)).where(F.col(times) != 1)
    both = docs.join(small(stored(drawn, "drawn")), docs["doc_id"] == F.col(id_), "left")
    often = F.explode(F.array_repeat(F.lit(1), F.coalesce(times, F.lit(1))))
    return both.select(*[docs[c] for c in docs.columns], often.alias(copy)).drop(copy)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and digest of what they decode to."""
    from public_tokenizers import path

    return digests(encode_decode(docs, path("piece_bpe_32k.model")))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("repeated_passages", passages),
    ("mixing", mixing),
    ("sentencepiece", token_ids),
]

#: Hashes, learned weights and min-hash windows have no SQL; tests/llm holds the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return docs
