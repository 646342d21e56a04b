"""Operator 8: quality rules, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated word windows of every whole
text.  The learned rule is a log-likelihood ratio: hashed word n-grams (one and two
words) under a multinomial of trusted documents against one of the whole raw corpus,
divided by the number of n-grams.  A document is kept if it passes the base rules and its
mean ratio is at least a fixed threshold; every document gets the verdict that its own
text and the two multinomials determine, with no sampling.

Plan: one scan counts the n-grams (the counts combine before the exchange, which then
moves at most `buckets` rows a task); the weights are one array of `buckets` doubles, a
scalar subquery; the second scan scores each row by itself.  Neither exchanges texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import BLANKS

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, as a lambda's argument: an expression that
    stands inside another lambda would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words, in order."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeat_words(hashes: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text.

    Equal hashes stand for equal windows (64 bits, within one text).  Windows are sorted
    by hash, so the work is n log n even if a whole long text repeats."""
    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    def covered(w: Column) -> Column:
        keyed = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
            pairs = F.transform(s, lambda x, k: F.when(((k > 0) & same(k, F.greatest(k - 1, F.lit(0)))) | ((k + 1 < F.size(s)) & same(k, k + 1)), x["i"]))
            return F.sort_array(F.filter(pairs, lambda x: x.isNotNull()))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return bound(bound(keyed, starts), total)

    some = bound(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))
    return F.when(F.size(hashes) < WINDOW + 1, F.lit(0).cast("long")).otherwise(some)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    hashes_): the counts of each text; hashes_ are its words' hashes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("text_"), word_hashes(text).alias("hashes_"))
    rows = rows.select(
        F.col(id_col),
        F.size("hashes_").cast("long").alias("n_words"),
        F.char_length(F.translate("text_", BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("text_") - F.char_length(F.translate("text_", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines(F.col("text_")).alias("n_dup_lines"),
        repeat_words(F.col("hashes_")).alias("n_repeat_words"),
        "hashes_",
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select("*", failed.alias("base_failed"))


def gram_buckets(hashes: Column, buckets: int) -> Column:
    """Buckets (from 1) of the one- and two-word n-grams."""
    n = F.size(hashes)
    ones = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int") + 1)
    pairs = F.zip_with(F.slice(hashes, 1, F.greatest(n - 1, F.lit(0))), F.slice(hashes, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int") + 1)
    return F.concat(ones, pairs)


def trusted_ids(labels: DataFrame, max_trusted: int) -> DataFrame:
    """At most max_trusted ids of rows with quality 1 and not toxic, those of smallest hash."""
    good = labels.where((F.col("quality") == 1) & F.coalesce(F.col("toxic") == 0, F.lit(True)) & F.col("doc_id").isNotNull())
    return good.select(F.col("doc_id").alias("trusted_")).distinct().orderBy(F.xxhash64("trusted_"), "trusted_").limit(max_trusted)


def weights(docs: DataFrame, labels: DataFrame, buckets: int, max_trusted: int, prior: float) -> DataFrame:
    """One row with the array of log ratios by bucket.

    Counts cover every n-gram of every document.  The trusted multinomial is smoothed
    towards the raw one with `prior` n-grams for each bucket, so that rare n-grams weigh
    little."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id_"), word_hashes(text).alias("hashes_"))
    rows = rows.join(F.broadcast(trusted_ids(labels, max_trusted)), F.col("id_") == F.col("trusted_"), "left")
    grams = rows.select(F.col("trusted_").isNotNull().cast("long").alias("t_"), F.explode(gram_buckets(F.col("hashes_"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t_").alias("trusted"))
    every = docs.sparkSession.range(1, buckets + 1).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    # One row of `buckets` entries, whatever the corpus.
    table = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "trusted"))).alias("c"), F.sum("raw").alias("r"), F.sum("trusted").alias("t"))
    mass = F.lit(float(prior * buckets))

    def ratio(x: Column) -> Column:
        share = x["raw"] / F.col("r")
        return F.when(x["raw"] > 0, F.log((x["trusted"] + mass * share) / (F.col("t") + mass) / share)).otherwise(0.0)

    return table.select(F.transform("c", ratio).alias("weights"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 14, max_trusted: int = 20_000, prior: float = 10.0, threshold: float = -0.06) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score, kept), a row per row of docs.

    docs needs doc_id and text, labels doc_id, quality and toxic; other columns are not
    looked at.  A null text counts as empty.  Texts without words have a score of 0 and
    fail the base rules.  A null or repeated doc_id keeps its rows.  Where no labelled
    row is trusted every ratio is 0, so that the base rules alone decide.

    Parameters: `buckets` hashed n-grams (bounds the weights' size), `max_trusted`
    labelled rows at most that the target is fitted on, `prior` as in weights(), and
    `threshold`, the least mean ratio that is kept.
    """
    w = weights(docs, labels, buckets, max_trusted, prior).scalar()
    rows = base_counts(docs).withColumn("weights_", w)
    grams = gram_buckets(F.col("hashes_"), buckets)
    total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.element_at("weights_", b))
    score = F.when(F.size("hashes_") > 0, total / F.greatest(2 * F.size("hashes_") - 1, F.lit(1))).otherwise(0.0)
    rows = rows.select("*", score.alias("score")).drop("hashes_", "weights_")
    return rows.select("*", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))
