"""The subpackage's queries and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import WORD, scratch, table

#: Target weights of the labelled domains, and expected tokens per token of the input.
MIX, GROWTH = {"good": 0.80, "low": 0.14, "toxic": 0.06}, 1.05
#: Rows and bytes of an Arrow batch: texts may be long.
ARROW_ROWS, ARROW_BYTES = "2000", str(32 << 20)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


@query
def op4_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.sharding import uniform_shards

    out = uniform_shards(table(spark, sf_dir, "documents"), 16)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.quality import quality_verdicts

    out = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query
def op10_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from cairn.llm.sentencepieces import digests, encode_decode

    return digests(encode_decode(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model")))


@query
def op1_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.mixing import mixing_rates

    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX, GROWTH)


@query
def op2_string_kernel_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.langid import languages

    return languages(table(spark, sf_dir, "documents"))


@query
def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.warc import read_warc, write_warc

    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("bigint")
    return read_warc(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLES["op3_warc_round_trip"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, unhex(sha1(html))::BIT::VARCHAR AS bits, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    list_sum(list_transform(range(0, 5), lambda j: substr(bits, i * 5 + j + 1, 1)::INT * (16 >> j::INT)))::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id != first THEN first END AS refers_to
FROM d
"""


@query
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.substrings import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


ORACLES["op9_jaccard_join"] = r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r(id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, l.v FROM r JOIN l ON l.u = r.reached)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.reached) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY d.doc_id
"""


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op5_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth recording but the queries' is a copy of the tune of the query before it:
    late, noisy or cut, as its id says."""
    from cairn.llm.chroma import aligned_recordings, rendered

    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    of = F.when((F.col("vec_id") % 9 == 4) & (F.col("vec_id") % 50 != 0), F.col("vec_id") - F.col("vec_id") % 50)
    tunes = v.where("vec_id % 50 = 0").groupBy(F.col("vec_id").alias("of")).agg(F.first("embedding").alias("tune"))
    rows = v.withColumn("of", of).join(tunes, "of", "left")
    copy = lambda value, plain: F.when(F.col("tune").isNotNull(), value).otherwise(plain)
    rows = rows.select("vec_id", F.coalesce("tune", "embedding").alias("embedding"), copy((F.col("vec_id") * 37) % 700, 0).alias("late"), copy(F.col("vec_id") % 4 * 1500, 0).alias("noise"), copy(1 - F.col("vec_id") % 3 * 0.2, 1.0).alias("kept"))
    return aligned_recordings(rendered(rows), "vec_id")


@query
def op6_packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN, path

    from cairn.llm.packing import packed, unpacked, write_packed

    place = scratch(spark, "packs")
    write_packed(packed(table(spark, sf_dir, "documents"), path("byte_bpe_50k.tiktoken"), PATTERN), place)
    rows = unpacked(spark.read.parquet(place))
    return rows.select("doc_id", "piece", "n_pieces", "pack_id", "first", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose hash ends in 0 repeat their words from one of them on, as the contract
    of this query asks."""
    from cairn.llm.periodic import periodic_runs

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.when(n > 0, g % n).otherwise(0)
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        times = (F.floor((n - a) / p) + 1).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), times)), F.lit(1), (n - a).cast("int"))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")

    # the words are bound to a name, else the pattern would be matched for each use
    text = F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), repeated)[0]
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))
    out = periodic_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    length, start, period = best["length"], -best["col2"], -best["col3"]
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")


@query
def op13_contaminated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.decontamination import contaminated_spans

    out = contaminated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLES["op13_contaminated_documents"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM t),
x AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m)),
o AS (SELECT DISTINCT x.doc_id, x.i, x.m, t.item_id FROM x JOIN t ON x.m = t.m AND x.g = t.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM o) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items, sha256(coalesce(n.items, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
