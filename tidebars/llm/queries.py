"""The operators of this subpackage as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidebars.llm import arc, classifier, decontaminate, divergence, hard_negatives, html_text, line_dedup, pieces, quality_rules, simhash, substrings, token_files, toxicity
from tidebars.llm.labelled import held_out
from tidebars.llm.staging import shuffles_freed, staged
from tidebars.series import new_path

#: A public SentencePiece model; a parameter of the operator.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: A public byte-level BPE tokenizer; a parameter of the operator.
TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[make.__name__] = make
    return make


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op4_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op9_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = substrings.repeats(table(spark, sf, "documents"))
    return substrings.without_repeats(found).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf, "documents"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select(*base, F.col("quality").alias("posterior"))


@query
def op8_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    found = classifier.score(docs, classifier.fit(docs, labels, "quality"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    found = toxicity.scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    found = html_text.extract(table(spark, sf, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query
def op7_legacy_archives(spark: SparkSession, sf: str) -> DataFrame:
    arcs, warcs = new_path(spark, "arc"), new_path(spark, "warc")
    with shuffles_freed(spark):
        arc.write_arc(table(spark, sf, "pages"), arcs)
        records = arc.convert(spark, arcs, warcs)
    found = staged(arc.index(records), "records")
    named = (F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"))
    # Only revisits refer to anything: responses are no rows of the join.
    again = found.where("type = 'revisit'").select("refers_to", *named)
    first = staged(again.select(F.col("refers_to").alias("record_id")).distinct().join(found.select("record_id", "key"), "record_id"), "first-records")
    referring = again.join(first.select(F.col("record_id").alias("refers_to"), "key"), "refers_to").select(*again.columns[1:], F.col("key").alias("refers_to"))
    return referring.union(found.where("type <> 'revisit'").select(*named, F.lit(None).cast("bigint")))


SQL["op7_legacy_archives"] = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS latest FROM p
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> latest THEN latest END AS refers_to
FROM g
"""


@query
def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf, "documents"), parts_of=line_dedup.chunkings_of)
    return found.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


@query
def op3_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    found = pieces.round_trip(table(spark, sf, "documents"), pieces.read_model(MODEL_PATH))
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", F.col("exact").alias("round_trip"))


@query
def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf, "embeddings").withColumn("label", shifted), F.col("vec_id") % 50 == 0)


SQL["op11_hard_negatives"] = """
WITH r AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, o.vec_id, o.r, o.label = a.label AS same,
        list_sum(list_transform(list_zip(a.v, o.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM r a JOIN r o ON o.r <> a.r WHERE a.vec_id % 50 = 0 AND len(a.v) = len(o.v)
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s
    WHERE same AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query
def op12_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "tokens")
    with shuffles_freed(spark):
        token_files.write_tokens(table(spark, sf, "documents"), path, TOKENIZER_PATH)
    ids = F.col("ids")
    return token_files.read_tokens(spark, path).select(
        F.col("key").alias("doc_id"), "start", (F.length(ids) / 4).cast("bigint").alias("n_tokens"), token_files.checksum(ids).alias("ids_crc32")
    )


@query
def op13_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"))


SQL["op13_source_divergence"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
    SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
    SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3
), c AS (
    SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL
), l AS (
    SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang
), g AS (
    SELECT o.lang, o.source, coalesce(any_value(v), 0) AS v, coalesce(any_value(lang_n), 0) AS lang_n, coalesce(sum(c.n), 0) AS n
    FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN l ON l.lang = o.lang LEFT JOIN c ON c.lang = o.lang AND c.source = o.source GROUP BY ALL
), p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (k.total + 1)) // (g.lang_n + g.v)::HUGEINT AS q
    FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows
QUALIFY part = 'pair' OR rank <= 200
"""


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
