"""Registered queries of this folder, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellmatch.llm import backoff_lm, bpe_replay, embedding_descent, language_ppm, latent_decontam, license_scan, minhash_forest, suffix_dedup, token_coder, treap_search, turn_repair, url_filter, warc_derive
from dwellmatch.session import read_table

Run = Callable[[SparkSession, str], DataFrame]

RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]


#: The pages carry no time of capture; their response records get this one.
CAPTURED = "2024-01-01T00:00:00Z"


def op1_warc_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derive.derivatives(warc_derive.responses(read_table(spark, sf_dir, "pages"), CAPTURED))


def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(read_table(spark, sf_dir, "documents"), words=4)


def op3_latent_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op5_token_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_coder.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe_replay.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = language_ppm.held_out(F.col("doc_id"))
    found = language_ppm.identify(docs, language_ppm.fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op9_embedding_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_descent.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, beside the rules, pages whose canonical url was fetched more than once."""
    pages = read_table(spark, sf_dir, "pages")
    key = url_filter.canonical(F.col("url"))
    listed = pages.select(key.alias("key")).where("key is not null").groupBy("key").count().where("count > 1").select("key")
    return url_filter.filter_urls(pages, listed, RULES)


def op11_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff_lm.score_texts(read_table(spark, sf_dir, "documents"), ~backoff_lm.held_out(F.col("doc_id")))
    return found.withColumn("held_out", ~F.col("learned")).drop("learned")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return turn_repair.repair_report(conversations, turn_repair.damage(conversations))


def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap_search.ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, instr(url, '://') > 0 AS ok FROM pages
), b AS (
  SELECT page_id, ok, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid)(=|$)'))) AS kept
  FROM a
), c AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    CASE WHEN ok THEN regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '^www[.]', '')
      || regexp_replace(path, '([.]html?|/+)$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS key
  FROM b
), listed AS (SELECT key FROM c WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1),
d AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM c
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM d
"""


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), points AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM points GROUP BY ALL),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM points, corpus WHERE term IN (SELECT term FROM wanted) GROUP BY term, docs
), scores AS (
  SELECT item_id, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN points p USING (term) JOIN lengths USING (doc_id), corpus GROUP BY item_id, p.doc_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def queries() -> dict[str, Run]:
    return {run.__name__: run for run in (op1_warc_derive, op2_minhash_forest, op3_latent_decontam, op4_suffix_dedup, op5_token_coder, op6_bpe_replay, op7_language_ppm, op8_license_scan, op9_embedding_descent, op10_url_filter, op11_backoff_lm, op12_turn_repair, op13_treap_search)}


def oracle_sql() -> dict[str, str]:
    return {"op10_url_filter": OP10_SQL, "op13_treap_search": OP13_SQL}
