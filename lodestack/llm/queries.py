"""The registered queries of the training-text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestack.llm.common import table
from lodestack.llm.decontaminate import find_leaks
from lodestack.llm.exact_dedup import exact_duplicates
from lodestack.llm.jaccard_join import jaccard_components
from lodestack.llm.line_dedup import drop_boilerplate
from lodestack.llm.packing import pack_documents
from lodestack.llm.quality import judge_quality
from lodestack.llm.ranked_search import rank_documents
from lodestack.llm.secret_scan import scan_secrets
from lodestack.llm.sharding import assign_shards
from lodestack.llm.token_count import count_tokens
from lodestack.llm.toxicity import score_toxicity
from lodestack.llm.url_reputation import SUFFIXES, filter_urls
from lodestack.llm.whitening import whiten


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_total", "lines_dropped")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 40)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_line_dedup, op3_jaccard_join, op4_token_counts, op5_packing, op6_secret_scan, op7_sharding, op8_decontamination, op9_quality_rules, op10_toxicity, op11_ranked_search, op12_exact_dedup, op13_whitening)}

SQL: dict[str, str] = {}

SQL["op1_url_filter"] = r"""
WITH known AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 0 IS NULL OR toxic = 1 IS NULL THEN NULL ELSE 0 END) AS is_bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule, rule_host, rule_path, rule_verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
    ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), sites AS (
  SELECT site, count(is_bad) AS n, coalesce(sum(is_bad), 0)::DOUBLE AS k FROM (SELECT page_id, regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '\.+$', '') AS site FROM parts) LEFT JOIN known USING (page_id) GROUP BY 1
), labelled AS (
  SELECT site, n, k, string_split(site, '.') AS parts, array_to_string(list_slice(string_split(site, '.'), -2, -1), '.') IN (_SUFFIXES) AS long, regexp_matches(site, '^(\[.*\]|[0-9]+(\.[0-9]+){3})$') AS address FROM sites
), hosts AS (
  SELECT site, n, k, CASE WHEN address THEN site ELSE array_to_string(list_slice(parts, CASE WHEN long THEN -3 ELSE -2 END, -1), '.') END AS domain,
    CASE WHEN address THEN 'address' ELSE array_to_string(list_slice(parts, CASE WHEN long THEN -2 ELSE -1 END, -1), '.') END AS suffix FROM labelled
), domains AS (SELECT suffix, domain, sum(n) AS nd, sum(k) AS kd FROM hosts GROUP BY ALL
), suffixes AS (SELECT suffix, sum(nd) AS ns, sum(kd) AS ks FROM domains GROUP BY ALL
), total AS (SELECT coalesce(sum(ns), 0) AS n, coalesce(sum(ks), 0) AS k FROM suffixes
), s1 AS (SELECT suffix, ns, ks, (k - ks + 0.5::DOUBLE) / (n - ns + 1) AS m FROM suffixes, total
), s2 AS (SELECT sum(pow(ks - ns * m, 2)) - sum(ns * m * (1 - m)) AS excess, sum(ns * (ns - 1) * m * (1 - m)) AS scale FROM s1
), s3 AS (SELECT CASE WHEN NOT coalesce(scale > 0, false) THEN 1 WHEN excess > 0 THEN least(greatest(scale / excess - 1, 1), 1000) ELSE 1000 END AS w FROM s2
), d1 AS (SELECT domain, suffix, nd, kd, (ks - kd + w * m) / (ns - nd + w) AS m FROM domains JOIN s1 USING (suffix), s3
), d2 AS (SELECT sum(pow(kd - nd * m, 2)) - sum(nd * m * (1 - m)) AS excess, sum(nd * (nd - 1) * m * (1 - m)) AS scale FROM d1
), d3 AS (SELECT CASE WHEN NOT coalesce(scale > 0, false) THEN 1 WHEN excess > 0 THEN least(greatest(scale / excess - 1, 1), 1000) ELSE 1000 END AS w FROM d2
), h1 AS (SELECT site, n, k, (kd - k + w * m) / (nd - n + w) AS m FROM hosts JOIN d1 USING (domain, suffix), d3
), h2 AS (SELECT sum(pow(k - n * m, 2)) - sum(n * m * (1 - m)) AS excess, sum(n * (n - 1) * m * (1 - m)) AS scale FROM h1
), h3 AS (SELECT CASE WHEN NOT coalesce(scale > 0, false) THEN 1 WHEN excess > 0 THEN least(greatest(scale / excess - 1, 1), 1000) ELSE 1000 END AS w FROM h2
), h4 AS (SELECT site, (k + w * m) / (n + w) AS rate, k + w * m AS a, n - k + w * (1 - m) AS b FROM h1, h3
), h5 AS (SELECT site, rate, a, b, 1 / (2 * a - 1) AS x, 1 / (2 * b - 1) AS y, 2 / (1 / (2 * a - 1) + 1 / (2 * b - 1)) AS h, (1.96::DOUBLE * 1.96 - 3) / 6 AS l FROM h4
), h6 AS (SELECT site, rate, CASE WHEN b <= 1 THEN pow(0.024997895148220428::DOUBLE, 1 / a) WHEN a <= 0.5 THEN 0 ELSE a / (a + b * exp(2 * (1.96::DOUBLE * sqrt(h + l) / h - (y - x) * (l + 5::DOUBLE / 6 - 2 / (3 * h))))) END AS bound FROM h5
), fits AS (
  SELECT p.host, p.path, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
  GROUP BY ALL
)
SELECT page_id, parts.host, parts.path, rule, coalesce(rule_verdict, CASE WHEN bound > 0.25 THEN 'block' ELSE 'allow' END) AS verdict,
  round(rate, 6) AS bad_rate, round(bound, 6) AS bad_bound
FROM parts LEFT JOIN h6 ON regexp_replace(regexp_replace(parts.host, '^.*@|:[0-9]*$', '', 'g'), '\.+$', '') = h6.site LEFT JOIN fits ON parts.host = fits.host AND parts.path = fits.path
"""

SQL["op1_url_filter"] = SQL["op1_url_filter"].replace("_SUFFIXES", ", ".join(f"'{x}'" for x in SUFFIXES))

SQL["op2_line_dedup"] = r"""
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL
), totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source
), lines AS (SELECT source, text, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))))) AS line FROM pages
), bad AS (
  SELECT l.source, line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE line <> '' GROUP BY l.source, line, pages HAVING count(*) >= 3 AND count(*) > 0.05 * pages
), sites AS (SELECT source, list(line) AS bad FROM bad GROUP BY source
), cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS own, coalesce(bad, []) AS bad FROM documents d LEFT JOIN sites s ON d.source IS NOT DISTINCT FROM s.source
), kept AS (
  SELECT doc_id, text, own, list_filter(own, lambda x: NOT list_contains(bad, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS stay FROM cut
)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(stay, chr(10)), '') END AS text,
  CASE WHEN text IS NULL THEN 0 ELSE len(own) END AS lines_total, CASE WHEN text IS NULL THEN 0 ELSE len(own) - len(stay) END AS lines_dropped
FROM kept
"""

SQL["op11_ranked_search"] = r"""
WITH words AS (
  SELECT doc_id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)
), counts AS (SELECT doc_id, row, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (SELECT row, count(*) AS n FROM words GROUP BY row
), total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), weights AS (SELECT term, floor(1000 * ln((2 * max(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, total GROUP BY term
), items AS (
  SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS item FROM (SELECT DISTINCT item_id, text FROM benchmark))
), asked AS (SELECT item, item_id, term, count(*) AS times FROM items GROUP BY ALL
), scored AS (
  SELECT item, item_id, doc_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (row), total GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

SQL["op12_exact_dedup"] = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS content FROM documents
), firsts AS (
  SELECT *, first_value(doc_id) OVER own AS keep_id, first_value(chars) OVER own AS keep_chars, count(*) OVER (PARTITION BY content) AS group_size
  FROM bare WINDOW own AS (PARTITION BY content ORDER BY chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND chars = keep_chars AS kept, sha256(content) AS text_sha256 FROM firsts
"""
