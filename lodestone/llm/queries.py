"""The training-data operators as registered queries, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, langid, line_dedup, lm_scoring, ngram_join, order_minhash, packing, pii, url_filters, warc
from lodestone.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def url_list(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of pages and their parents by rule: four entries each, by digests."""
    hosts = pages.select(F.explode(url_filters.levels(url_filters.host_of(F.col("url")))).alias("host")).distinct()
    rows = hosts.select("host", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    number = F.conv(F.substring(F.md5(F.concat("host", F.col("k").cast("string"))), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("x", number)
    action = F.element_at(F.array(*map(F.lit, ("block", "allow", "remove", "block"))), (F.col("x") % 4 + 1).cast("int"))
    name = F.concat(F.lit("list"), (F.floor(F.col("x") / 4) % 3).cast("string"))
    since = F.date_add(F.lit("2020-01-01").cast("date"), (F.floor(F.col("x") / 16) % 1461).cast("int"))
    return rows.select(name.alias("list_name"), "host", action.alias("action"), since.alias("since"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("page_id", F.lit(1461)).cast("int"))
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", day.alias("fetched"))
    return url_filters.judge(captures, url_list(pages))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = F.aggregate("removed", F.lit(0), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", F.size("removed").alias("n_removed"), cut.alias("chars_removed"), F.char_length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict_languages(docs, langid.fit(docs, ~langid.held_out()))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


URL_SQL = r"""
WITH c AS (
  SELECT page_id AS capture_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host,
    DATE '2020-01-01' + (page_id % 1461)::INT AS fetched FROM pages),
l AS (
  SELECT host, k - least(2, len(p)) AS level, array_to_string(p[len(p) - k + 1:len(p)], '.') AS rule_host
  FROM (SELECT host, p, unnest(generate_series(least(2, len(p)), len(p))) AS k
    FROM (SELECT DISTINCT host, string_split(host, '.') AS p FROM c WHERE host IS NOT NULL))),
e AS (
  SELECT 'list' || ((x // 4) % 3) AS list_name, host, ['block', 'allow', 'remove', 'block'][x % 4 + 1] AS action, DATE '2020-01-01' + ((x // 16) % 1461)::INT AS since
  FROM (SELECT host, ('0x' || substr(md5(host || k), 1, 8))::BIGINT AS x FROM (SELECT DISTINCT rule_host AS host FROM l), generate_series(0, 3) g(k))),
i AS (
  SELECT list_name, host, action, since, lead(since) OVER (PARTITION BY list_name, host ORDER BY since) AS until
  FROM (SELECT list_name, host, since, max(action) AS action FROM e GROUP BY ALL)),
h AS (
  SELECT c.capture_id, i.action, i.host AS rule_host, i.list_name,
    row_number() OVER (PARTITION BY c.capture_id ORDER BY l.level DESC, i.action = 'block' DESC, i.list_name) AS n
  FROM c JOIN l ON l.host = c.host JOIN i ON i.host = l.rule_host AND i.action <> 'remove' AND c.fetched >= i.since AND (i.until IS NULL OR c.fetched < i.until))
SELECT c.capture_id, c.host, coalesce(h.action, 'none') AS verdict, h.rule_host, h.list_name FROM c LEFT JOIN h ON h.capture_id = c.capture_id AND h.n = 1
"""

WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to FROM o
"""

NGRAM_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\t-\r ]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.a, x.b FROM (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS c FROM s JOIN s t ON s.g = t.g AND s.doc_id <> t.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE x.c >= 0.8 * (na.n + nb.n - x.c) - 1e-9),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id)
SELECT r.doc_id, min(r.c) AS class_id, (SELECT count(*) FROM p WHERE p.a = r.doc_id) AS n_links FROM r GROUP BY r.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_url_filters": op3_url_filters,
        "op4_warc": op4_warc,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_line_dedup": op6_line_dedup,
        "op7_language_id": op7_language_id,
        "op8_pii": op8_pii,
        "op9_packing": op9_packing,
        "op10_order_minhash": op10_order_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": NGRAM_SQL, "op3_url_filters": URL_SQL, "op4_warc": WARC_SQL}
