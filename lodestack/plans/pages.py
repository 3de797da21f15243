"""Queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import urls as u
from lodestack.operators import aggregates as agg
from lodestack.operators import extract as ex
from lodestack.operators import filters as fl
from lodestack.operators import joins as jo
from lodestack.operators import tags as tg
from lodestack.operators.windows import cap_per_group
from lodestack.plans.base import Query, register, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Parts of a URL in SQL, for urls of the form scheme://host/path?query#fragment.
_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_SCHEME = "lower(regexp_extract(url, '^([A-Za-z]+):', 1))"
_ROUTE = f"""{_SCHEME} || '://' || {_HOST} || regexp_replace(CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END, '/+', '/', 'g') ||
 coalesce('?' || nullif(array_to_string(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(from|ref|source|fbclid|gclid|utm_[^=]*)(=|$)')), '&'), ''), '')"""
_CACHE = f"""{_SCHEME} || '://' || {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END ||
 coalesce('?' || nullif(array_to_string(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(v|ver|version|cb|cache|cachebust|cache_bust|cachebuster|t|ts|timestamp|_|dpl)(=|$)')), '&'), ''), '')"""
_CANON = f"""{_SCHEME} || '://' || {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END"""
_LINKS = f"""SELECT page_id, {_HOST} AS host, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS raw FROM pages"""
_GOOD = "raw <> '' AND NOT regexp_matches(raw, '(?i)^(#|javascript:|mailto:|tel:|data:)')"
_DUP = f"""SELECT page_id, url, html FROM pages UNION ALL SELECT page_id + 1000000000, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=dup', html FROM pages"""


def _q(sql: str | None = None):
    return register(QUERIES, SQL, sql)


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages``, and each again under a URL that only tracks."""
    p = table(spark, sf_dir, "pages")
    bare = F.regexp_replace("url", "#.*$", "")
    again = F.concat(bare, F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_source=dup"))
    return p.unionByName(p.select((F.col("page_id") + 1_000_000_000).alias("page_id"), again.alias("url"), "html"))


@_q(f"""WITH l AS ({_LINKS}) SELECT host, raw AS target, count(*) AS n, count(DISTINCT page_id) AS pages FROM l WHERE {_GOOD} GROUP BY ALL""")
def most_linked_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = ex.extract_links(table(spark, sf_dir, "pages"))
    return links.groupBy(u.hostname("page_url").alias("host"), F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("target")).agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@_q(f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY ALL")
def pages_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.filter_http(table(spark, sf_dir, "pages"), "url").groupBy(u.hostname("url").alias("host")).agg(F.count("*").alias("n"))


@_q(f"WITH d AS ({_DUP}) SELECT {_ROUTE} AS route, min(page_id) AS page_id, count(*) AS n FROM d GROUP BY 1")
def dedup_pages_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubled(spark, sf_dir).groupBy(u.route_url("url").alias("route")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@_q(f"WITH d AS ({_DUP}) SELECT {_CANON} AS canonical, count(*) AS n, min(page_id) AS page_id FROM d GROUP BY 1")
def canonical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubled(spark, sf_dir).groupBy(u.canonical_url("url").alias("canonical")).agg(F.count("*").alias("n"), F.min("page_id").alias("page_id"))


@_q(f"WITH d AS ({_DUP}) SELECT {_CACHE} AS identity, count(DISTINCT url) AS n, arg_min(url, page_id) AS representative FROM d GROUP BY 1")
def cache_identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.group_aliases(_doubled(spark, sf_dir).select("url", F.col("page_id").alias("ord")))


@_q(f"""SELECT {_SCHEME} || '://' || {_HOST} || CASE WHEN {_PATH} LIKE '%/' THEN {_PATH} WHEN {_PATH} = '' THEN '/'
  WHEN regexp_matches(lower({_PATH}), '[^/.]\\.(html|htm|php|asp|aspx|jsp)$') THEN regexp_replace({_PATH}, '[^/]*$', '') ELSE {_PATH} || '/' END AS base, count(*) AS n FROM pages GROUP BY 1""")
def directory_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(u.directory_base("url").alias("base")).agg(F.count("*").alias("n"))


@_q(f"""SELECT {_SCHEME} || '://' || regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) || CASE WHEN {_PATH} = '' THEN '/' ELSE regexp_replace({_PATH}, '[^/]*$', '') END || regexp_extract(url, '(#.*)$', 1) AS base, count(*) AS n FROM pages GROUP BY 1""")
def stripped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(u.strip_document("url").alias("base")).agg(F.count("*").alias("n"))


@_q(f"""SELECT {_SCHEME} AS scheme, {_HOST} AS host, CASE {_SCHEME} WHEN 'http' THEN 80 WHEN 'https' THEN 443 END AS port, count(*) AS n, min(page_id) AS first FROM pages GROUP BY ALL""")
def pages_per_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(u.scheme("url").alias("scheme"), u.hostname("url").alias("host"), u.port("url").alias("port")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@_q(f"""WITH s AS (SELECT CASE WHEN len(string_split({_HOST}, '.')) >= 3 THEN string_split({_HOST}, '.')[1] ELSE '' END AS subdomain, regexp_extract({_PATH}, '^/*([^/]*)', 1) AS folder FROM pages) SELECT subdomain, folder, count(*) AS n FROM s GROUP BY ALL""")
def subdomains_and_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(u.first_subdomain("url").alias("subdomain"), u.first_folder("url").alias("folder")).agg(F.count("*").alias("n"))


@_q(f"""WITH p AS (SELECT page_id, list_filter(string_split({_PATH}, '/'), lambda x: x <> '')[1:3] AS parts FROM pages) SELECT array_to_string(parts, '_') AS name, count(*) AS n, min(page_id) AS first FROM p GROUP BY 1""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(u.output_name("url").alias("name")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@_q(f"""WITH s AS (SELECT page_id, url, {_HOST} || {_PATH} || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END AS shown FROM pages)
SELECT CASE WHEN length(url) <= 30 THEN url WHEN length(shown) <= 30 THEN shown ELSE left(shown, 18) || '…' || right(shown, 11) END AS display, count(*) AS n FROM s GROUP BY 1""")
def display_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(u.display_url("url", 30).alias("display")).agg(F.count("*").alias("n"))


@_q(f"""WITH l AS ({_LINKS}), r AS (SELECT DISTINCT host, raw FROM l WHERE {_GOOD}) SELECT host, count(*) AS n, min(raw) AS first FROM r GROUP BY 1""")
def distinct_links_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = ex.extract_links(table(spark, sf_dir, "pages")).select(u.hostname("page_url").alias("host"), "raw").distinct()
    return links.groupBy("host").agg(F.count("*").alias("n"), F.min("raw").alias("first"))


@_q(f"""WITH l AS ({_LINKS}), t AS (SELECT host, raw, min(page_id) AS first FROM l WHERE {_GOOD} GROUP BY ALL), k AS (SELECT host, raw FROM t WHERE first % 3 = 0)
SELECT host, raw AS target, first FROM t WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.host = t.host AND k.raw = t.raw)""")
def new_routes_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = ex.extract_links(table(spark, sf_dir, "pages"))
    found = links.groupBy(u.hostname("page_url").alias("host"), F.col("raw").alias("target")).agg(F.min("page_id").alias("first")).withColumn("url", F.concat_ws(" ", "host", "target"))
    known = found.where(F.col("first") % 3 == 0).select("url")
    return jo.pending(found, known).select("host", "target", "first")


@_q(f"""WITH p AS (SELECT page_id, url, {_SCHEME} || '://' || {_HOST} AS origin, {_PATH} AS path FROM pages), s AS (SELECT DISTINCT origin, regexp_extract(path, '^(/[^/]+/)', 1) AS scope FROM p WHERE page_id % 2 = 0 AND regexp_matches(path, '^/[^/]+/'))
SELECT s.origin || s.scope AS seed, page_id FROM p JOIN s ON p.origin = s.origin AND starts_with(p.path, s.scope)""")
def scope_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    seed = F.concat(u.scheme("url"), F.lit("://"), F.lower(u.netloc("url")), F.regexp_extract(u.path("url"), "^(/[^/]+/)", 1))
    seeds = p.where((F.col("page_id") % 2 == 0) & F.rlike(u.path("url"), F.lit("^/[^/]+/"))).select(seed.alias("seed_id")).distinct().withColumn("scope_url", F.col("seed_id"))
    return jo.scope_pages(p, seeds).select(F.col("seed_id").alias("seed"), "page_id")


@_q(f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT CASE WHEN host = 'therin.example.net' THEN 'exact' WHEN host LIKE 'm.%' AND FALSE THEN '' WHEN host LIKE '%.example.org' OR host = 'example.org' THEN 'org' WHEN host LIKE '%.net' THEN 'net' ELSE 'default' END AS headers, count(*) AS n, min(page_id) AS first FROM h GROUP BY 1""")
def host_header_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = spark.createDataFrame([("therin.example.net", "exact")], "host string, headers string")
    suffixes = spark.createDataFrame([(0, "example.org", "org"), (1, "net", "net")], "rank int, suffix string, headers string")
    return jo.attach_headers(table(spark, sf_dir, "pages").select("page_id", "url"), exact, suffixes).groupBy("headers").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@_q(f"""WITH l AS ({_LINKS}), e AS (SELECT DISTINCT raw AS url, page_id AS owner FROM l WHERE {_GOOD}) SELECT url, owner, count(*) OVER (PARTITION BY url) AS n FROM e""")
def reference_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.ref_sources(ex.extract_links(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("owner"), F.col("raw").alias("url")))


@_q(f"""WITH d AS ({_DUP}), e AS (SELECT {_CACHE} AS identity, url, min(page_id) AS ord FROM d GROUP BY 1, 2)
SELECT identity, url, first_value(url) OVER (PARTITION BY identity ORDER BY ord, url) AS representative, count(*) OVER (PARTITION BY identity) AS n FROM e""")
def alias_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.alias_members(_doubled(spark, sf_dir).select("url", F.col("page_id").alias("ord")))


@_q(r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1)) AS body FROM pages) SELECT length(body) AS size, count(*) AS n, count(DISTINCT page_id) AS pages FROM s GROUP BY 1""")
def inline_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tg.extract_scripts(table(spark, sf_dir, "pages")).where("kind = 'inline'")
    return s.groupBy(F.length("body").alias("size")).agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@_q(f"""WITH l AS ({_LINKS}), o AS (SELECT DISTINCT page_id, raw FROM l WHERE {_GOOD}), n AS (SELECT page_id, raw, row_number() OVER (PARTITION BY page_id ORDER BY raw) AS n, count(*) OVER (PARTITION BY page_id) AS c FROM o) SELECT page_id, raw, n, greatest(c - 3, 0) AS more FROM n WHERE n <= 3""")
def first_links_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = ex.extract_links(table(spark, sf_dir, "pages")).select("page_id", "raw").distinct()
    return cap_per_group(links, "page_id", ["raw"], 3)
