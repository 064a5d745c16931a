"""Queries opN_<name> over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import circulant, code_sql, decontaminate, fingerprint, html_text, line_dedup, lm_score, mixing, ngram_join, quality, token_count, url_filter, vector_codes, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), folds=5, held_out=0)
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id",
        (quality.fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "n_lines",
        "n_good_lines",
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), "doc_id", "text", width=5, percent=80)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: Shares of the mixture by domain of ``labels``.
MIX_WEIGHTS = {"clean": 0.97, "low": 0.03, "toxic": 0.0}


def domains_of(labels: DataFrame) -> DataFrame:
    """Domain of each labelled document: toxic, else low or clean by quality."""
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", name.alias("domain"))


def op4_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), domains_of(_table(spark, sf_dir, "labels")), "domain", MIX_WEIGHTS)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    remainder = quality.fold(F.col("doc_id"), 7)
    scored = lm_score.score_texts(docs, remainder != 2)
    return scored.select("doc_id", (remainder == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: Vocabulary file of a public tokenizer, on the driver.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op6_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits in every document: 16 code points at a third give way to its first 24; its last 8 go in at two thirds."""
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    edit = lambda at, deleted, inserted: F.struct(at.cast("long").alias("at"), F.lit(deleted).cast("long").alias("deleted"), inserted.alias("inserted"))
    edits = F.array(edit(F.floor(n / 3), 16, F.substring(text, 1, 24)), edit(F.floor(2 * n / 3), 0, F.right(text, F.lit(8))))
    return token_count.count_tokens(_table(spark, sf_dir, "documents").withColumn("edits", edits), edits_col="edits", vocabulary=VOCABULARY)


#: (action, host, path)
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules)


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_sensitivity(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), rate=0.2)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op12_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = circulant.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text", width=2, percent=80)
    return groups.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` as a long, null where it does not fit."""
    white = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=16, scale=64, offset=1_000_000, weight="one")
    return white.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_mix_to_targets": op4_mix_to_targets,
    "op5_lm_score": op5_lm_score,
    "op6_edit_token_counts": op6_edit_token_counts,
    "op7_url_filter": op7_url_filter,
    "op8_order_minhash": op8_order_minhash,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_html_extraction": op10_html_extraction,
    "op11_vector_codes": op11_vector_codes,
    "op12_circulant_minhash": op12_circulant_minhash,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES: dict[str, str] = {
    "op7_url_filter": r"""
        WITH RECURSIVE rules(action, rule_host, rule_path) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                   ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
        ), tags AS (
            SELECT url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b[^>]*>')) AS tag, 'href' AS name
            FROM (SELECT url, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html FROM pages) WHERE contains(url, '://')
            UNION ALL
            SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')), 'url'
            FROM (SELECT url, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html FROM pages) WHERE contains(url, '://')
        ), links AS (
            SELECT url, replace(CASE name WHEN 'href' THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
                                ELSE regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) END, '&amp;', '&') AS link
            FROM tags
        ), targets AS (
            SELECT url, CASE
                WHEN link = '' THEN NULL
                WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
                WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                WHEN starts_with(link, '//') THEN 'http:' || link
                WHEN starts_with(link, '#') THEN url
                WHEN starts_with(link, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || link
                WHEN starts_with(link, '?') THEN regexp_extract(url, '^(.*?://[^?#]*)', 1, 's') || link
                ELSE regexp_extract(regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || '/' || regexp_extract(url, '^.*?://[^/?#]*/?([^?#]*)', 1, 's'), '^(.*/)', 1, 's') || link
            END AS target
            FROM links
        ), urls AS (
            SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT target FROM targets WHERE target IS NOT NULL
        ), parts AS (
            SELECT url, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
                   regexp_extract(url, '^.*?://[^?#]*(\?[^#]*)', 1, 's') AS query
            FROM urls
        ), named AS (
            SELECT *, CASE WHEN host <> '' THEN host || CASE path WHEN '' THEN '/' ELSE path END || query END AS node FROM parts
        ), best AS (
            SELECT url, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                   arg_max(action, length(rule_host || rule_path)) AS action
            FROM named JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY url
        ), edges AS (
            SELECT a.node AS a, b.node AS b FROM targets t JOIN named a ON a.url = t.url JOIN named b ON b.url = t.target
            WHERE a.node IS NOT NULL AND b.node IS NOT NULL AND a.node <> b.node
        ), both_ways AS (
            SELECT a, b FROM edges UNION SELECT b, a FROM edges
        ), reach(n, m) AS (
            SELECT a, a FROM both_ways UNION SELECT r.n, e.b FROM reach r JOIN both_ways e ON r.m = e.a
        ), spread AS (
            SELECT n, count(DISTINCT m) AS aliases, bool_or(action = 'allow') AS allows, bool_or(action = 'block') AS blocks
            FROM reach LEFT JOIN named ON named.node = m LEFT JOIN best USING (url) GROUP BY n
        )
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
               coalesce(action, CASE WHEN allows THEN 'allow' WHEN blocks THEN 'block' ELSE 'allow' END) AS verdict,
               coalesce(aliases, 1)::BIGINT AS aliases
        FROM pages LEFT JOIN named USING (url) LEFT JOIN best USING (url) LEFT JOIN spread ON node = n
    """,
    "op10_html_extraction": r"""
        WITH body AS (
            SELECT page_id, url,
                   regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS a
            FROM pages
        ), blocks AS (
            SELECT page_id, unnest(regexp_split_to_array(a, '</?(?:p|h[1-6]|div|ul|ol|li|blockquote|table|tr|td)(?: [^>]*)?>')) AS b,
                   generate_subscripts(regexp_split_to_array(a, '</?(?:p|h[1-6]|div|ul|ol|li|blockquote|table|tr|td)(?: [^>]*)?>'), 1) AS pos
            FROM body
        ), clean AS (
            SELECT page_id, pos, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(
                     b, '<br ?/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"', 'g'), '&lt;', '<'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t
            FROM blocks
        ), joined AS (
            SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY pos) AS text FROM clean WHERE t <> '' GROUP BY page_id
        )
        SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars
        FROM body LEFT JOIN joined USING (page_id)
    """,
    "op3_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), keyed AS (
            SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines
        ), hot AS (
            SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*)::BIGINT AS n_lines,
               count(*) FILTER (WHERE hot.k IS NOT NULL)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN hot USING (k) GROUP BY doc_id
    """,
    "op11_vector_codes": code_sql.text(),
}
