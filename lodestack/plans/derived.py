"""Queries over references, answers, records and projects that Spark derives from ``pages``, ``documents``, ``orders`` and ``events``, so that every branch of an operator is met."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import fixed, scalars as sc
from lodestack.functions import urls as u
from lodestack.operators import aggregates as agg
from lodestack.operators import extract as ex
from lodestack.operators import filters as fl
from lodestack.operators import iterate as it
from lodestack.operators import joins as jo
from lodestack.operators import tags as tg
from lodestack.plans.base import Query, register, table
from lodestack.sources import readers as rd
from lodestack.streaming import telemetry as st

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _q(sql: str | None = None):
    return register(QUERIES, SQL, sql)


def _pick(values: tuple[str | None, ...], key: str) -> tuple[Callable[[], Column], str]:
    """The value at ``key`` modulo their number, as a Column (when asked for) and in SQL."""
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return lambda: F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int")), f"[{', '.join(map(text, values))}][{key} % {len(values)} + 1]"


def _list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_HOST = "regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
_BARE = f"('http://' || {_HOST} || rtrim({_PATH}, '/'))"


def _bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, bare (the URL without query, fragment and final slashes, under http), html."""
    p = table(spark, sf_dir, "pages")
    bare = F.concat(F.lit("http://"), F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1), F.regexp_replace(F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", ""))
    return p.select("page_id", "url", bare.alias("bare"), "html")


@_q("SELECT page_id, url, length(html) AS size FROM pages")
def page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.read_pages(spark, f"{sf_dir}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("size"))


_ENDS = (".css", ".mjs", ".woff2", ".webp", ".flac", ".txt", ".zip", ".html", ".bin", "", "/project.json", ".MP4", ".ico")
_MIMES = ("", "image/png", "text/css; charset=utf-8", "application/json", None, "application/problem+json", "text/javascript", "audio/ogg", "application/font-woff", "text/html")
_END, _END_SQL = _pick(_ENDS, "page_id")
_MIME, _MIME_SQL = _pick(_MIMES, "page_id")
_EXT = "lower(regexp_extract(url, '[^/](\\.[A-Za-z0-9]+)$', 1))"
_dots = lambda *names: _list(tuple(f".{n}" for own in names for n in own))
_DATA = f"(regexp_matches(lower(url), 'project\\.(json|txt|zip)$') OR ext IN {_dots(fixed.DATA_EXTENSIONS)})"


@_q(f"""WITH a AS (SELECT page_id, {_BARE} || {_END_SQL} AS url, coalesce(lower({_MIME_SQL}), '') AS m FROM pages), b AS (SELECT *, {_EXT} AS ext FROM a)
SELECT CASE WHEN contains(m, 'text/css') OR ext = '.css' THEN 'css' WHEN contains(m, 'javascript') OR ext IN ('.js', '.mjs') THEN 'js' WHEN contains(m, 'font') OR ext IN {_dots(fixed.FONT_EXTENSIONS)} THEN 'fonts'
  WHEN starts_with(m, 'image/') OR ext IN {_dots(fixed.IMAGE_EXTENSIONS)} THEN 'images' WHEN starts_with(m, 'audio/') OR starts_with(m, 'video/') OR ext IN {_dots(fixed.MEDIA_EXTENSIONS)} THEN 'media'
  WHEN m = 'application/json' OR {_DATA} THEN 'json' WHEN contains(m, 'text/html') OR ext IN ('.html', '.htm') THEN 'html' ELSE 'assets' END AS kind,
  CASE WHEN {_DATA} THEN 'json' WHEN ext IN {_dots(fixed.FONT_EXTENSIONS)} THEN 'fonts' WHEN ext IN {_dots(fixed.IMAGE_EXTENSIONS)} THEN 'images' WHEN ext IN {_dots(fixed.MEDIA_EXTENSIONS)} THEN 'media' WHEN ext = '.css' THEN 'css' WHEN ext IN ('.js', '.mjs') THEN 'js' ELSE 'assets' END AS path_kind,
  count(*) AS n, min(page_id) AS first FROM b GROUP BY 1, 2""")
def response_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bare(spark, sf_dir).select("page_id", F.concat("bare", _END()).alias("url"), _MIME().alias("mime"))
    return rows.groupBy(fl.classify_kind("url", F.col("mime")).alias("kind"), fl.classify_path("url").alias("path_kind")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@_q(f"""WITH a AS (SELECT page_id, {_BARE} || {_END_SQL} AS url, trim(split_part(coalesce(lower({_MIME_SQL}), ''), ';', 1)) AS m FROM pages)
SELECT page_id FROM a WHERE regexp_matches(m, '^(image|audio|video|font)/') OR m IN {_list(fixed.RUNTIME_TYPES)} OR {_EXT} IN {_dots(fixed.RUNTIME_EXTENSIONS)}""")
def runtime_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bare(spark, sf_dir).select("page_id", F.concat("bare", _END()).alias("url"), _MIME().alias("mime"))
    return fl.filter_runtime_assets(rows).select("page_id")


@_q(f"""WITH a AS (SELECT page_id, {_BARE} || {_END_SQL} AS url FROM pages), b AS (SELECT page_id, url, {_EXT} AS ext FROM a)
SELECT page_id FROM b WHERE (ext IN {_dots(fixed.ASSET_EXTENSIONS)} OR regexp_matches(lower(url), 'project\\.(json|txt|zip)$')) AND NOT contains(url, 'w3.org/')""")
def asset_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.filter_assets(_bare(spark, sf_dir).select("page_id", F.concat("bare", _END()).alias("url")), "url").select("page_id")


_RAWS = ("a.png", "data:image/png;base64,AA", " javascript:void(0)", "MAILTO:x@y", "#top", "", "ftp://h/x", "https://h/x", "tel:123", "C:/x.png", "none", "a\tb", "blob:x", "n/a", "//h/x")
_RAW, _RAW_SQL = _pick(_RAWS, "page_id")


@_q(f"""WITH r AS (SELECT page_id, trim({_RAW_SQL}, ' ') AS c FROM pages), g AS (SELECT page_id, c FROM r WHERE c <> '' AND NOT regexp_matches(lower(c), '^(data:|javascript:|mailto:|file:|ftp:|blob:|chrome:|about:|#)') AND (NOT regexp_matches(c, '^[A-Za-z][A-Za-z0-9+.-]*:') OR regexp_matches(lower(c), '^https?:')))
SELECT page_id, length(c) <= 600 AND NOT contains(c, chr(9)) AND upper(c) NOT IN ('NONE', 'NULL', 'N/A', '[]') AS strict FROM g""")
def clean_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", _RAW().alias("raw"))
    strict = fl.filter_refs(rows, "raw", strict=True).select("page_id", F.lit(True).alias("strict"))
    return fl.filter_refs(rows, "raw").select("page_id").join(strict, "page_id", "left").select("page_id", F.coalesce("strict", F.lit(False)).alias("strict"))


_SITES = ("https://www.google-analytics.com/collect", "https://o1.ingest.sentry.io/1", "https://eu.posthog.com/e", "https://sentry.io/x", "https://clarity.ms/t", "https://notclarity.ms/t")
_SITE, _SITE_SQL = _pick(_SITES, "page_id")


@_q(f"""WITH a AS (SELECT page_id, {_SITE_SQL} AS url FROM pages UNION ALL SELECT page_id + 1000000000, url FROM pages), h AS (SELECT page_id, lower({_HOST}) AS host FROM a)
SELECT page_id FROM h WHERE host NOT IN {_list(fixed.TELEMETRY_HOSTS)} AND NOT ends_with(host, '.sentry.io') AND NOT ends_with(host, '.posthog.com')""")
def without_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    rows = p.select("page_id", _SITE().alias("url")).unionByName(p.select((F.col("page_id") + 1_000_000_000).alias("page_id"), "url"))
    return fl.drop_telemetry_hosts(rows, "url").select("page_id")


_LEADS = ("https://www.github.com/a/b", "https://x.com/someone", "http://127.0.0.1:8000/a", "http://[::1]/a", "http://10.2.3.4/x", "https://h.example.org/pic.WEBP", "https://h.example.org/a/docs/b", "https://h.example.org/a/doc/b", "https://h.example.org/?utm_source=a", "ftp://h.example.org/", "https://netflix.com/", "http://printer.local/", "https://h.example.org/user/x", "/relative")
_LEAD, _LEAD_SQL = _pick(_LEADS, "page_id")


@_q(f"""WITH a AS (SELECT page_id, {_LEAD_SQL} AS url FROM pages UNION ALL SELECT page_id + 1000000000, url FROM pages), h AS (SELECT page_id, url, regexp_replace(lower({_HOST}), ':[0-9]+$', '') AS host, {_EXT} AS ext FROM a)
SELECT CASE WHEN NOT regexp_matches(lower(url), '^https?://[^/]') THEN 'not an HTTP(S) URL' WHEN ext IN {_dots(fixed.IMAGE_EXTENSIONS, fixed.MEDIA_EXTENSIONS, fixed.FONT_EXTENSIONS)} THEN 'direct media/font asset'
  WHEN host IN ('127.0.0.1', '[::1]', '10.2.3.4', 'printer.local') THEN 'internal address' WHEN host IN {_list(fixed.SOCIAL_HOSTS)} OR {' OR '.join(f"ends_with(host, '.{h}')" for h in fixed.SOCIAL_HOSTS)} THEN 'repository/social/analytics host'
  WHEN contains(lower(url), '/profile/') OR contains(lower(url), '/docs/') OR contains(lower(url), '/documentation/') OR contains(lower(url), 'utm_') THEN 'profile/documentation/tracking URL' ELSE 'allowed' END AS verdict, count(*) AS n, min(page_id) AS first FROM h GROUP BY 1""")
def screened_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    rows = p.select("page_id", _LEAD().alias("url")).unionByName(p.select((F.col("page_id") + 1_000_000_000).alias("page_id"), "url"))
    return fl.screen_candidates(rows).groupBy(F.coalesce("reason", F.lit("allowed")).alias("verdict")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


_HEADS = ("", "<p>Checking your browser</p>", "<p>checking your browser</p>", '<input name="jschl_vc">', "just a moment", '<div class="cf-turnstile">')
_TAILS = ("", "<div ID='CYOA-container'><script>const GAME_DATA = 1</script>", '<audio id="bg-music"><i class="point-bar">', '<audio id="bg-music">', "game_data")
_HEAD, _HEAD_SQL = _pick(_HEADS, "page_id")
_TAIL, _TAIL_SQL = _pick(_TAILS, "page_id")
_SERVER, _SERVER_SQL = _pick(("Cloudflare", "nginx", None, "CLOUDFLARE-nginx"), "page_id")
_RAY, _RAY_SQL = _pick((None, "", "8a1"), "page_id")


@_q(f"""WITH a AS (SELECT {_HEAD_SQL} || html || {_TAIL_SQL} AS html, {_SERVER_SQL} AS server, {_RAY_SQL} AS ray, {_MIME_SQL} AS mime FROM pages)
SELECT (contains(lower(html), 'id="cyoa-container"') OR contains(lower(html), 'id=''cyoa-container''')) AND contains(lower(html), 'game_data') OR (contains(lower(html), 'id="bg-music"') OR contains(lower(html), 'id=''bg-music''')) AND contains(lower(html), 'point-bar') AS custom_viewer,
  (contains(coalesce(mime, ''), 'text/html') OR contains(coalesce(mime, ''), 'application/json')) AND (coalesce(ray, '') <> '' OR contains(lower(coalesce(server, '')), 'cloudflare')) AND ({' OR '.join(f"contains(left(html, 2000), '{m}')" for m in fixed.CHALLENGE_MARKERS)}) AS challenge, count(*) AS n FROM a GROUP BY 1, 2""")
def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.concat(_HEAD(), "html", _TAIL()).alias("html"), _SERVER().alias("server"), _RAY().alias("ray"), _MIME().alias("mime"))
    return fl.flag_challenges(fl.flag_custom_viewers(p)).groupBy("custom_viewer", "challenge").agg(F.count("*").alias("n"))


_LABELS = ("Load more", "Next", "Upload next", "Register and continue", "Reveal", "open  section", "Details", "Muat lagi", "Continue", "Delete", "Expand", "Share")
_LABEL, _LABEL_SQL = _pick(_LABELS, "page_id")
_TYPE, _TYPE_SQL = _pick(("button", "submit", None, "image", "button"), "page_id")
_OPEN, _OPEN_SQL = _pick((None, "false", "true"), "page_id")


@_q(f"""WITH a AS (SELECT page_id, {_LABEL_SQL} AS label, {_TYPE_SQL} AS type, page_id % 7 = 0 AS in_form, {_OPEN_SQL} AS expanded FROM pages)
SELECT page_id, label FROM a WHERE NOT in_form AND coalesce(type, '') NOT IN ('submit', 'image', 'reset') AND label NOT IN ('Upload next', 'Register and continue', 'Delete', 'Share') AND (label IN ('Load more', 'Next', 'Reveal', 'open  section', 'Muat lagi', 'Continue', 'Expand') OR coalesce(expanded, '') = 'false')""")
def safe_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", _LABEL().alias("label"), _TYPE().alias("type"), (F.col("page_id") % 7 == 0).alias("in_form"), _OPEN().alias("expanded"))
    return fl.filter_safe_labels(rows).select("page_id", "label")


_MODES = ("website", "ICC-Folder", "icc", "pure website", "cyoap-vue-zip", "zip", "BOTH", "bogus", "", None, "website_folder", "cyoap_vue_folder", "embed", "pure_website_folder")
_MODE, _MODE_SQL = _pick(_MODES, "o_orderkey")
_MODE_NAME = f"translate(lower(trim(coalesce({_MODE_SQL}, ''))), '- ', '__')"


@_q(f"""WITH a AS (SELECT {_MODE_NAME} AS m FROM orders), b AS (SELECT CASE WHEN m IN ('icc', 'icc_zip') THEN 'website_zip' WHEN m = 'icc_folder' THEN 'website_folder' WHEN m IN {_list(fixed.MODES)} THEN m ELSE '' END AS mode FROM a)
SELECT mode, mode = 'zip' AS zip, mode = 'both' AS both, starts_with(mode, 'pure_') AS pure, starts_with(mode, 'website') OR starts_with(mode, 'pure_') OR starts_with(mode, 'cyoap_vue') AS website, NOT ends_with(mode, '_folder') AS website_zip, CASE WHEN starts_with(mode, 'cyoap_vue') THEN 'cyoap_vue' ELSE 'standard' END AS engine, count(*) AS n FROM b GROUP BY ALL""")
def queue_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fl.normalize_modes(table(spark, sf_dir, "orders").select(_MODE().alias("mode")))
    return rows.groupBy("mode", "zip", "both", "pure", "website", "website_zip", "engine").agg(F.count("*").alias("n"))


_LINES = (
    "Resolving project source for x", "Fetching page HTML", "Deep scan round 1", "Found 12 asset references", "Re-analysed: 3", "Integrity check passed", "ZIP created: x.zip", "Retry: attempt 2", "Asset: a b.png",
    "[3/10] ✓ pic.png", "[4 / 10] FAILED other.png", "[5/10] ✗ third.png", "nothing to see", "found the asset", "Localizing refs", "retry later",
)
_LINE, _LINE_SQL = _pick(_LINES, "event_id")


@_q(f"""WITH a AS (SELECT event_id, event_id % {len(_LINES)} AS k, {_LINE_SQL} AS line FROM events), s(k, type, state, name, done, total, error) AS (VALUES
  (0, 'stage_changed', 'RESOLVING', NULL, NULL, NULL, NULL), (1, 'stage_changed', 'FETCHING_ENTRY', NULL, NULL, NULL, NULL), (2, 'stage_changed', 'DISCOVERING_ASSETS', NULL, NULL, NULL, NULL), (3, 'stage_changed', 'DISCOVERING_ASSETS', NULL, NULL, NULL, NULL),
  (4, 'stage_changed', 'REWRITING', NULL, NULL, NULL, NULL), (5, 'stage_changed', 'VERIFYING', NULL, NULL, NULL, NULL), (6, 'stage_changed', 'PACKAGING', NULL, NULL, NULL, NULL), (7, 'file_retry', NULL, NULL, NULL, NULL, NULL), (8, 'file_completed', NULL, 'a b.png', NULL, NULL, NULL),
  (9, 'asset_discovered', NULL, NULL, NULL, 10, NULL), (9, 'file_completed', NULL, 'pic.png', 3, NULL, ''), (10, 'asset_discovered', NULL, NULL, NULL, 10, NULL), (10, 'file_failed', NULL, 'other.png', 4, NULL, '[4 / 10] FAILED other.png'),
  (11, 'asset_discovered', NULL, NULL, NULL, 10, NULL), (11, 'file_failed', NULL, 'third.png', 5, NULL, ''), (13, 'stage_changed', 'DISCOVERING_ASSETS', NULL, NULL, NULL, NULL), (14, 'stage_changed', 'REWRITING', NULL, NULL, NULL, NULL))
SELECT event_id, type, state, name, done, total, error FROM a JOIN s USING (k)""")
def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.parse_log_events(table(spark, sf_dir, "events").select("event_id", _LINE().alias("line"))).select("event_id", "type", "state", "name", "done", "total", "error")


_TAGS = '<script type="module" src="/_next/app.js"></script><link rel="stylesheet" href="/s.css"><link rel="icon" href="/i.ico"><img src="/a.png" srcset="/b.png 1x, /c.png 2x"><video poster="/p.jpg" src="/v.mp4"></video><p style="background:url(/bg.png)"></p><style>@font-face{src:url(/f.woff2)}</style>'


@_q("""WITH t(tag, attr, raw, kind) AS (VALUES ('script', 'src', '/_next/app.js', 'js'), ('link', 'href', '/s.css', 'css'), ('link', 'href', '/i.ico', 'images'), ('img', 'src', '/a.png', 'images'), ('img', 'srcset', '/b.png', 'images'), ('img', 'srcset', '/c.png', 'images'),
  ('video', 'poster', '/p.jpg', 'images'), ('video', 'src', '/v.mp4', 'media'), ('', 'style', '/bg.png', 'images'), ('style', '', '/f.woff2', 'fonts')) SELECT tag, attr, raw, kind, count(*) AS n FROM pages, t WHERE page_id % 3 = 0 GROUP BY ALL""")
def tag_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.when(F.col("page_id") % 3 == 0, _TAGS).otherwise("")).alias("html"))
    return tg.extract_tag_assets(p).groupBy("tag", "attr", "raw", "kind").agg(F.count("*").alias("n"))


_CSS = "'<style>@import \"base' || page_id % 5 || '.css\"; p{background:url(''bg/' || page_id % 7 || '.png'')} i{src:url(data:x)}</style>'"


@_q("""SELECT 'base' || page_id % 5 || '.css' AS raw, 'import' AS via, count(*) AS n FROM pages GROUP BY 1 UNION ALL SELECT 'bg/' || page_id % 7 || '.png', 'url', count(*) FROM pages GROUP BY 1""")
def css_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda n: (F.col("page_id") % n).cast("string")
    css = F.concat(F.lit('<style>@import "base'), k(5), F.lit(".css\"; p{background:url('bg/"), k(7), F.lit(".png')} i{src:url(data:x)}</style>"))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("html", css).alias("html"))
    return ex.extract_css_refs(p, "html", keep=("page_id",)).groupBy("raw", "via").agg(F.count("*").alias("n"))


_STORY = ('<a href="/sign-in/x">', '<a href="/CHECKOUT">', '<a href="/payments/x">', '<a href="/story/payment">', '<a href="https://elsewhere.example.org/x">', '<a href="/admin">')
_ANCHOR, _ANCHOR_SQL = _pick(_STORY, "page_id")


@_q(f"""WITH p AS (SELECT page_id, html || {_ANCHOR_SQL} AS html FROM pages), l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS raw FROM p)
SELECT page_id, min(raw) AS first_raw, count(*) AS n FROM l WHERE raw <> '' AND NOT regexp_matches(raw, '(?i)^(#|javascript:|mailto:|tel:|data:|https:)') AND NOT regexp_matches(raw, '(?i)/(?:api|auth|login|logout|sign-in|signin|signup|register|account|admin|checkout|payment)(?:/|$)') GROUP BY 1""")
def links_in_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", _ANCHOR()).alias("html"))
    links = ex.extract_links(p).withColumn("seed", F.concat(u.scheme("page_url"), F.lit("://"), u.netloc("page_url"), F.lit("/")))
    return fl.filter_scope(links).groupBy("page_id").agg(F.min("raw").alias("first_raw"), F.count("*").alias("n"))


def _more(key: str) -> tuple[Callable[[], Column], str]:
    parts = [(2, '<a href="next?x=1">n</a><a href="next?x=2">n</a><a href="next?x=1">again</a>'), (3, '<script type="module" src="/_next/app.js"></script>'), (5, '<div id="root"></div><canvas>'), (7, '<script>fetch("/x"); new Image(); new IntersectionObserver(f)</script>')]
    return lambda: F.concat(*[F.when(F.col(key) % n == 0, text).otherwise("") for n, text in parts]), " || ".join(f"CASE WHEN {key} % {n} = 0 THEN '{text}' ELSE '' END" for n, text in parts)


_MORE, _MORE_SQL = _more("page_id")


@_q(f"""WITH p AS (SELECT page_id, html || {_MORE_SQL} AS html FROM pages),
s AS (SELECT page_id, len(regexp_extract_all(html, '(?i)<script\\b[^>]*\\bsrc\\s*=')) AS scripts, len(regexp_extract_all(html, '(?i)<script\\b[^>]*\\btype\\s*=\\s*["'']module["'']')) AS modules, regexp_matches(html, '(?i)\\bid\\s*=\\s*["''](app|root|__next)["'']') AS framework, contains(lower(html), '/_next/') AS next, len(regexp_extract_all(html, '(?i)<canvas\\b')) AS canvas,
  array_to_string(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), ' ') AS js, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END AS routes FROM p),
t AS (SELECT page_id, routes, 2 * next::INT + (framework AND scripts > 0)::INT + (modules > 0)::INT + (canvas > 0)::INT + regexp_matches(js, '\\bfetch\\s*\\(')::INT + contains(js, 'IntersectionObserver')::INT + regexp_matches(js, '\\bnew\\s+Image\\s*\\(')::INT AS score FROM s)
SELECT page_id, routes, score, CASE WHEN score >= 2 THEN 'browser' WHEN routes > 0 THEN 'smart' ELSE 'classic' END AS strategy FROM t""")
def site_profile_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _bare(spark, sf_dir).select("page_id", F.concat("bare", F.lit("/")).alias("url"), F.concat("html", _MORE()).alias("html"))
    scripts = tg.extract_scripts(p).where("kind = 'inline'").select("page_id", F.concat("ord", F.lit(".js")).alias("path"), F.col("body").alias("text"))
    signals = agg.profile_signals(p, ex.extract_links(p), scripts)
    return agg.plan_archive(signals).join(signals.select("page_id", "routes", "score"), "page_id").select("page_id", F.col("routes").cast("int").alias("routes"), F.col("score").cast("int").alias("score"), "strategy")


_names = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_in = lambda folders, names: _names(tuple(f + n for f in folders for n in names))
_each = lambda bases, names: f"flatten([[b || n for n in {names}] for b in {bases}])"


@_q(f"""WITH p AS (SELECT DISTINCT url, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || {_HOST} AS origin, {_PATH} AS path, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS ps FROM pages WHERE url IS NOT NULL),
q AS (SELECT url, origin, origin || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END AS own, CASE WHEN len(ps) > 0 AND contains(ps[-1], '.') AND NOT starts_with(ps[-1], '.') THEN ps[1:len(ps) - 1] ELSE ps END AS ps FROM p),
r AS (SELECT url, own, list_transform(range(len(ps), 0, -1), lambda n: origin || '/' || array_to_string(ps[1:n], '/') || '/') || [origin || '/'] AS up FROM q),
c AS (SELECT url, {_each('[own]', _names(fixed.DATA_NAMES))} || {_each('up', _names(fixed.DATA_NAMES))} || {_each('[own]', _in(fixed.DATA_FOLDERS, fixed.DATA_NAMES))} || {_each('up[1:3]', _in(fixed.DATA_FOLDERS, fixed.DATA_NAMES))} || {_each('[own]', _names(fixed.OTHER_DATA_NAMES))} ||
  {_each('up[1:1]', _names(fixed.OTHER_DATA_NAMES))} || {_each('[own]', _in(fixed.OTHER_DATA_FOLDERS, fixed.DATA_NAMES))} || {_each('[own]', _in(('', *fixed.DATA_FOLDERS), fixed.OTHER_DATA_NAMES))} || {_each('([own] || up[1:2])', "['Project.json', 'PROJECT.JSON']")} AS places FROM r),
u AS (SELECT url, unnest(places) AS candidate, generate_subscripts(places, 1) AS k FROM c), f AS (SELECT url, candidate, min(k) AS k FROM u GROUP BY 1, 2), n AS (SELECT candidate, row_number() OVER (PARTITION BY url ORDER BY k) - 1 AS rank FROM f)
SELECT candidate, count(*) AS n, min(rank) AS best FROM n GROUP BY 1""")
def default_candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.default_candidates(table(spark, sf_dir, "pages")).groupBy("candidate").agg(F.count("*").alias("n"), F.min("rank").alias("best"))


#: Texts of projects: each shape is what follows a document's id.
_SHAPES = (
    '"title":"t","rows":[{"title":"r","objects":[{"image":"images/@.png","text":"<img src=\'art/@.webp\'> and more"},{"bgmId":"abcdefghij@","useAudioURL":false}]}],"backpack":[]}',
    '"cards":[],"sections":[],"scenes":[],"tabs":[],"choices":[]}',
    '"app":{"rows":[],"groups":[{"sfx":"snd/@.mp3","bgmId":"music/@.ogg","useAudioURL":true}],"bgmList":["https://youtu.be/abcdefghij@","x@.flac",7]}}',
    '"styling":1,"cssStyles":2,"name":"n"}',
    '"image":"https:/cdn.example.org/@.gif","name":"label","note":"see https://cdn.example.org/n@.jpg."}',
)


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, text of JSON made from each document's id; every eleventh is broken, every thirteenth stands in a script."""
    digit = (F.col("doc_id") % 10).cast("string")
    shape = F.get(F.array(*map(F.lit, _SHAPES)), (F.col("doc_id") % len(_SHAPES)).cast("int"))
    text = F.concat(F.lit('{"k":'), F.col("doc_id"), F.lit(","), F.replace(shape, F.lit("@"), digit))
    text = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("{"), text)).when(F.col("doc_id") % 13 == 0, F.concat(F.lit("var x = "), text, F.lit(";"))).otherwise(text)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("project_id"), text.alias("text"))


@_q("""SELECT doc_id AS project_id, [8, 5, 6, 1, 4][doc_id % 5 + 1] AS score FROM documents WHERE doc_id % 11 <> 0 AND [8, 5, 6, 1, 4][doc_id % 5 + 1] >= 4""")
def project_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rd.read_projects(_projects(spark, sf_dir))
    return found.select("project_id", sc.project_score(F.col("payload")).cast("int").alias("score"))


@_q("""WITH d AS (SELECT doc_id, (doc_id % 10)::VARCHAR AS g FROM documents WHERE doc_id % 11 <> 0), r AS (
  SELECT doc_id, unnest([{'class': 'image', 'raw': 'images/' || g || '.png'}, {'class': 'image', 'raw': 'art/' || g || '.webp'}, {'class': 'video', 'raw': 'https://www.youtube.com/watch?v=abcdefghij' || g}]) AS x FROM d WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, unnest([{'class': 'audio', 'raw': 'snd/' || g || '.mp3'}, {'class': 'audio', 'raw': 'music/' || g || '.ogg'}, {'class': 'video', 'raw': 'https://youtu.be/abcdefghij' || g}, {'class': 'audio', 'raw': 'x' || g || '.flac'}]) FROM d WHERE doc_id % 5 = 2
  UNION ALL SELECT doc_id, unnest([{'class': 'image', 'raw': 'https://cdn.example.org/' || g || '.gif'}, {'class': 'image', 'raw': 'https://cdn.example.org/n' || g || '.jpg'}]) FROM d WHERE doc_id % 5 = 4)
SELECT doc_id AS project_id, x.class AS class, x.raw AS raw FROM r""")
def project_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.walk_projects(rd.read_projects(_projects(spark, sf_dir))).select("project_id", "class", "raw")


@_q("""WITH d AS (SELECT doc_id, (doc_id % 10)::VARCHAR AS g FROM documents WHERE doc_id % 11 <> 0) SELECT doc_id AS project_id, 'abcdefghij' || g AS old, 'audio/' || g || '.mp3' AS new, true AS use_audio_url FROM d WHERE doc_id % 5 = 0 AND (doc_id % 10) < 5""")
def media_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = spark.createDataFrame([(f"https://youtu.be/abcdefghij{k}", f"audio/{k}.mp3") for k in range(5)], "url string, path string")
    walk = it.walk_strings(rd.read_projects(_projects(spark, sf_dir))).withColumnRenamed("key_name", "key")
    return jo.patch_media(walk, local).where("field = 'bgmId'").select("project_id", "old", "new", "use_audio_url")


@_q("""SELECT doc_id AS path, doc_id % 2 AS n FROM documents WHERE CASE WHEN doc_id % 11 = 0 THEN doc_id % 5 IN (0, 2) ELSE doc_id % 5 <> 3 END""")
def embedded_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of broken texts the project's own braces are found by the names in it, where it has such."""
    p = _projects(spark, sf_dir).where("project_id % 13 <> 0")
    script = F.when(F.col("project_id") % 2 == 0, F.concat(F.lit("f({a:'}'});window.__APP__="), "text", F.lit(";g()"))).otherwise(F.concat(F.lit("const q={};var z={z:1};const app=i("), "text", F.lit(");")))
    also = _projects(spark, sf_dir).where("project_id % 13 = 0").select("project_id", F.concat(F.lit("return "), F.regexp_replace("text", "^var x = ", "")).alias("text"))
    files = p.select(F.col("project_id").cast("string").alias("path"), script.alias("text")).unionByName(also.select(F.col("project_id").cast("string").alias("path"), "text"))
    return ex.extract_embedded(files).select(F.col("path").cast("long").alias("path")).withColumn("n", F.col("path") % 2)


_FONT_TEXT = """'{"googleFonts":["Open Sans",{"family":"Lora"}],"customFonts":[{"url":"fonts/c.css"}],"deep":[{"customCSS":"@font-face{src:url(f' || doc_id % 3 || '.woff2)}"}],"direct":"https:\\/\\/cdn.example.org\\/d' || doc_id % 2 || '.ttf?x"}'"""


@_q("""WITH f AS (SELECT doc_id, 'https://cdn.example.org/d' || doc_id % 2 || '.ttf?x' AS url, 'project, link' AS description FROM documents UNION ALL SELECT doc_id, 'https://site.example.org/v/f' || doc_id % 3 || '.woff2', 'project, style text' FROM documents
  UNION ALL SELECT doc_id, 'https://site.example.org/v/fonts/x.otf', 'project, style text' FROM documents UNION ALL SELECT doc_id, 'https://fonts.example.org/lora.woff2', 'font service (https://fonts.googleapis.com/css2?family=Lora:wght@400;600;700&display=swap)' FROM documents)
SELECT description, count(*) AS n, min(url) AS first FROM f GROUP BY 1""")
def font_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda n: (F.col("doc_id") % n).cast("string")
    text = F.concat(F.lit('{"googleFonts":["Open Sans",{"family":"Lora"}],"customFonts":[{"url":"fonts/c.css"}],"deep":[{"customCSS":"@font-face{src:url(f'), k(3), F.lit('.woff2)}"}],"direct":"https:\\/\\/cdn.example.org\\/d'), k(2), F.lit('.ttf?x"}'))
    projects = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("owner"), F.lit("https://site.example.org/v/").alias("base_url"), text.alias("text"))
    styles = spark.createDataFrame([("https://site.example.org/v/fonts/c.css", "@font-face{src:url(x.otf)}"), ("https://fonts.googleapis.com/css2?family=Lora:wght@400;600;700&display=swap", "src:url('https://fonts.example.org/lora.woff2')")], "url string, text string")
    return agg.summarise_fonts(ex.extract_fonts(projects, styles=styles))


@_q("""WITH d AS (SELECT doc_id FROM documents) SELECT doc_id AS record_id, 'https://a.example.org/' || doc_id AS raw FROM d UNION ALL SELECT doc_id, 'https://b.example.org/' || doc_id FROM d WHERE doc_id % 2 = 0""")
def record_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    inner = F.when(F.col("doc_id") % 2 == 0, "https").otherwise("ftp")
    text = F.concat(F.lit('{"title":"https://no.example.org/","iframe_url":"https://a.example.org/'), k, F.lit('","data":[{"deep":{"game_url":"'), inner, F.lit("://b.example.org/"), k, F.lit('"}}],"url":5}'))
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.try_parse_json(text).alias("payload"))
    return it.extract_record_urls(records).select("record_id", "raw")


@_q("""WITH v AS (SELECT doc_id, unnest(['abcdefghij' || doc_id % 10, 'ABCDEFGHIJ' || doc_id % 10]) AS id FROM documents WHERE doc_id % 2 = 0) SELECT 'https://www.youtube.com/watch?v=' || id AS url, count(*) AS n FROM v GROUP BY 1""")
def media_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("doc_id") % 10).cast("string")
    text = F.concat(F.lit("onclick=playVideo('abcdefghij"), k, F.lit("') https://youtu.be/ABCDEFGHIJ"), k, F.lit("?t=1 https://www.youtube.com/watch?x=1&v=abcdefghij"), k)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, text).otherwise("nothing").alias("text"))
    return ex.extract_media_ids(rows, "text", keep=("doc_id",)).groupBy("url").agg(F.count("*").alias("n"))


@_q("""WITH r AS (SELECT 'http://h.example.org/' || doc_id AS route FROM documents WHERE doc_id % 3 = 0) SELECT 'http://h.example.org/' || doc_id AS url, 'p/' || doc_id || '.html' AS local FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0""")
def mapped_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("http://h.example.org/"), "doc_id").alias("url"))
    have = d.where("doc_id % 3 = 0").select(F.col("url").alias("route"), F.concat(F.lit("p/"), "doc_id", F.lit(".html")).alias("local"))
    return jo.map_routes(d.where("doc_id % 2 = 0").select("url"), have)


@_q("""WITH s AS (SELECT doc_id % 50 AS b, min(doc_id) AS ord FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) SELECT 'http://o.example.org/x/' || doc_id % 80 || '.png' AS url, coalesce('f/' || s.ord, 'http://o.example.org/x/' || doc_id % 80 || '.png') AS local, count(*) AS n FROM documents LEFT JOIN s ON s.b = doc_id % 80 GROUP BY 1, 2""")
def basename_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lost = d.select(F.concat(F.lit("http://o.example.org/x/"), F.col("doc_id") % 80, F.lit(".png")).alias("url"))
    saved = d.where("doc_id % 3 = 0").select(F.concat(F.lit("http://h.example.org/"), F.col("doc_id") % 50, F.lit(".PNG")).alias("url"), F.concat(F.lit("f/"), "doc_id").alias("local"), F.col("doc_id").alias("ord"))
    return jo.fallback_basename(lost, saved).groupBy("url", "local").agg(F.count("*").alias("n"))


@_q("""WITH a AS (SELECT doc_id, doc_id % 20 AS g FROM documents) SELECT g AS identity, doc_id AS url, 'f' || g AS local FROM a WHERE g % 2 = 0""")
def fanned_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    aliases = d.select((F.col("doc_id") % 20).alias("identity"), F.col("doc_id").alias("url"))
    results = aliases.select("identity").distinct().where("identity % 2 = 0").withColumn("local", F.concat(F.lit("f"), "identity"))
    return jo.fan_out(results, aliases).select("identity", "url", "local")


@_q("""SELECT o_orderkey AS url, CASE WHEN o_orderkey % 4 <> 0 THEN 'zip' WHEN o_orderkey % 3 = 0 THEN 'website_folder' WHEN o_orderkey % 5 = 0 THEN 'embed' WHEN o_orderkey % 7 = 0 THEN 'website_folder' WHEN o_orderkey % 11 = 0 THEN 'cyoap_vue_folder' ELSE 'website_folder' END AS mode FROM orders""")
def auto_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    q = table(spark, sf_dir, "orders").select(k.alias("url"), F.when(k % 4 == 0, "auto").otherwise("zip").alias("mode"))
    probes = table(spark, sf_dir, "orders").where(k % 3 != 0).select(k.alias("url"), (k % 7 == 0).alias("static"), (k % 11 == 0).alias("structure_ok"), (k % 5 == 0).alias("failed"))
    return jo.resolve_auto_modes(q, probes)


@_q("""SELECT o_orderkey AS url, o_custkey AS rank FROM orders WHERE o_orderkey % 3 < 2""")
def answered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_custkey").alias("rank"))
    status = F.get(F.array(F.lit(200), F.lit(206), F.lit(404)), (F.col("url") % 3).cast("int"))
    return jo.live_candidates(o, o.select("url", status.alias("status"))).select("url", "rank")


@_q("""SELECT source AS file, count(*) AS n FROM documents, (VALUES (1), (2)) t(k) WHERE k = 1 OR doc_id % 2 = 0 GROUP BY 1""")
def failure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lines = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("u\te"), F.lit("  "), F.lit("v"))).otherwise(F.array(F.lit("w"), F.lit("")))
    return agg.count_failure_lines(d.select(F.col("source").alias("file"), F.explode(lines).alias("value")))


@_q("""SELECT source AS package, doc_id % 40 AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2""")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("package"), (F.col("doc_id") % 40).alias("key"))
    return ex.keep_first(d, ["package", "key"], ["doc_id"])


@_q("""SELECT DISTINCT source AS owner, lang AS raw FROM documents UNION SELECT source, (doc_id % 9)::VARCHAR FROM documents""")
def united_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return ex.union_refs(d.select(F.col("source").alias("owner"), F.col("lang").alias("raw")), d.select(F.col("source").alias("owner"), (F.col("doc_id") % 9).cast("string").alias("raw")))


@_q("""SELECT event_id, CASE WHEN event_id % 5 >= 3 AND value > 0 AND event_id / value <= 365 * 86400 THEN round(event_id / value, 4) END AS eta FROM events""")
def time_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(sc.eta(F.col("event_id").cast("double"), F.col("value"), F.col("event_id") % 5), 4).alias("eta"))


@_q("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_custkey::VARCHAR WHEN o_orderkey % 3 = 1 THEN o_orderkey::VARCHAR END AS length, count(*) AS n FROM orders GROUP BY 1""")
def identity_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ranged = F.when(k % 3 == 0, F.concat(F.lit("bytes 0-9/"), "o_custkey")).when(k % 3 == 1, "bytes 0-9/*")
    length = F.when(k % 3 < 2, k.cast("string"))
    return table(spark, sf_dir, "orders").groupBy(sc.identity_length(ranged, length).alias("length")).agg(F.count("*").alias("n"))


@_q("""SELECT user_id % 10 AS queue, count(*) FILTER (event_type IN ('purchase', 'error')) AS done, count(*) FILTER (event_type = 'signup') AS total, round(count(*) FILTER (event_type IN ('purchase', 'error')) / greatest(count(*) FILTER (event_type = 'signup'), 1), 6) AS ratio FROM events GROUP BY 1""")
def queue_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "job_completed").when(F.col("event_type") == "error", "job_failed").when(F.col("event_type") == "signup", "job_queued").otherwise("other")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("queue"), kind.alias("type"))
    return st.queue_progress(e).withColumn("ratio", F.round("ratio", 6))


@_q("""SELECT o_orderkey AS id, o_orderpriority AS name FROM orders WHERE o_orderkey % 3 <> 0""")
def library_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.get(F.array(F.lit("  "), F.lit("https://h/"), F.lit("x")), (F.col("o_orderkey") % 3).cast("int"))
    return rd.read_library(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), source.alias("source_url"))).select("id", "name")


@_q("""SELECT CASE WHEN doc_id % 2 = 0 THEN 'https://c.example.org/api/files/col/r' || doc_id || '/a%20b' || doc_id % 3 || '.png' END AS url, count(*) AS n FROM documents GROUP BY 1""")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.concat(F.when(F.col("doc_id") % 2 == 0, "r").otherwise("bad/"), "doc_id")
    url = u.record_file_url(F.lit("https://c.example.org/"), F.lit("col"), record, F.concat(F.lit("a b"), F.col("doc_id") % 3, F.lit(".png")))
    return table(spark, sf_dir, "documents").groupBy(url.alias("url")).agg(F.count("*").alias("n"))


_REFS = ("app/js/a.js?v=3", "app/img/b", "css/c.css?theme=2&t=9", "d%20e.png", "project.json", "x/", "")
_REF, _REF_SQL = _pick(_REFS, "doc_id")


@_q(f"""WITH r AS (SELECT doc_id, doc_id % 2 = 0 AS here, doc_id % {len(_REFS)} AS k FROM documents), p(k, kind, here, other) AS (VALUES
  (0, 'js', 'js/a.js', 'js/a.js'), (1, 'images', 'img/b.png', 'images/b.png'), (2, 'css', 'css/c_' || left(sha1('theme=2'), 10) || '.css', 'css/c_' || left(sha1('theme=2'), 10) || '.css'), (3, 'images', 'd e.png', 'images/d e.png'), (4, 'json', 'project.json', 'project.json'), (5, 'assets', 'x', 'assets/asset.bin'), (6, 'assets', 'assets/asset.bin', 'assets/asset.bin'))
SELECT kind, CASE WHEN r.here THEN p.here ELSE other END AS path, count(*) AS n FROM r JOIN p USING (k) GROUP BY 1, 2""")
def local_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.when(F.col("doc_id") % 2 == 0, "https://site.example.org/").otherwise("https://cdn.example.org/")
    refs = table(spark, sf_dir, "documents").select(F.concat(host, _REF()).alias("url"), F.when(F.col("doc_id") % len(_REFS) == 1, "image/png").alias("mime"))
    return u.plan_local_paths(refs, "https://site.example.org/app/").groupBy("kind", "path").agg(F.count("*").alias("n"))


@_q("""SELECT doc_id AS url FROM documents WHERE doc_id % 4 <> 0""")
def still_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("https://h.example.org/"), "doc_id", F.lit(".png")).alias("url"))
    have = d.where("doc_id % 4 = 0").select(F.concat("url", F.lit("?v=7")).alias("url"))
    return jo.remove_localised(d, have).select(F.col("doc_id").alias("url"))


@_q("""SELECT doc_id AS path FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0""")
def reachable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("doc_id", F.when(F.col("doc_id") % 3 == 0, ".css").otherwise(".js")).alias("path"))
    return jo.restrict_to_reachable(d, d.where("doc_id % 2 = 0").select("path")).select(F.col("doc_id").alias("path"))
