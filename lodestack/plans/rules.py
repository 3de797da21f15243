"""Queries that hold classifications and scans to what is known of single cases: each page, document or event of the tables brings one of them, or its site's address."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import urls as u
from lodestack.operators import aggregates as agg
from lodestack.operators import extract as ex
from lodestack.operators import filters as fl
from lodestack.operators import joins as jo
from lodestack.operators import tags as tg
from lodestack.operators import textscan as ts
from lodestack.operators.windows import rank_scripts
from lodestack.plans.base import Query, register, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_SITE = "'http://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"


def _q(sql: str | None = None):
    return register(QUERIES, SQL, sql)


def _values(rows: Sequence[tuple], names: str) -> str:
    """Rows as a table of SQL."""
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") t({names})"


def _nth(values: Sequence, key: Column) -> Column:
    """The value at ``key`` modulo their number."""
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def _numbered(rows: Sequence[tuple]) -> list[tuple]:
    return [(k, *r) for k, r in enumerate(rows)]


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.concat(F.lit("http://"), F.lower(u.netloc("url"))).alias("site"), "html")


_ERRORS = (
    ("SSLError: certificate verify failed", "tls"), ("('Connection aborted.', 'Connection reset by peer')", "reset"), ("ECONNRESET while reading", "reset"), ("[Errno -2] Name or service not known", "dns"),
    ("nodename nor servname provided", "dns"), ("HTTP Error 403: Forbidden", "bot check"), ("HTTP Error 404: Not Found", "http 404"), ("got status 503", "http 503"), ("Could not copy Chrome cookie database", "cookie lock"),
    ("cannot read cookie database:  Permission denied", "cookie lock"), ("database is locked", "other"), ("No supported JavaScript runtime could be found", "runtime missing"), ("denoise failed", "other"), ("Signature solving failed", "signature"),
    ("n challenge solving failed", "signature"), ("The provided YouTube account cookies are no longer valid", "cookies expired"), ("Sign in to confirm your age", "bot check"), ("Video unavailable", "bot check"), ("strange", "other"), (None, "other"),
)


@_q(f"SELECT cause, count(*) AS n FROM events JOIN {_values(_numbered(_ERRORS), 'k, error, cause')} ON event_id % {len(_ERRORS)} = k GROUP BY 1")
def failure_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.classify_failures(table(spark, sf_dir, "events").select(_nth([e for e, _ in _ERRORS], F.col("event_id")).alias("error")))


_CANDIDATES = (("/a/data.json", 1), ("/b/project", 2), ("/c/list.zip", 3), ("/d", 4))


@_q(f"SELECT {_SITE} || x AS found, k AS rank, count(DISTINCT page_id) AS n FROM pages, {_values(_CANDIDATES, 'x, k')} GROUP BY 1, 2")
def data_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """x="a/data.json"; y='\\/b\\/project'; fetch("/api/me"); z = ["project", "data:x.json", "Load/Save Project", "http://127.0.0.1/x.json"]; load("c/list.zip"); r.open("GET", "/d"); fetch("a/data.json")"""
    p = _sites(spark, sf_dir).select("page_id", F.concat("site", F.lit("/")).alias("url"))
    found = ex.extract_candidates(p.select("url").distinct().withColumn("text", F.lit(text)))
    return p.join(found, "url").groupBy("found", "rank").agg(F.count_distinct("page_id").alias("n"))


_HINTS = (("meta", "p.json"), ("data", "q.JSON"), ("data", "dir/u.txt"), ("link", "r.json"), ("script", "data/s.json"), ("script", "t.zip"))


@_q(f"SELECT hint, raw, {_SITE} || '/' || raw AS url, count(*) AS n FROM pages, {_values(_HINTS, 'hint, raw')} WHERE page_id % 2 = 0 GROUP BY 1, 2, 3")
def data_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = (
        """<meta content="p.json" name="my-Project"><div title="a > b" data-project='q.JSON' data-src="pic.jpg"></div><p data-file=dir/u.txt><link as=fetch href="r.json"><link href=x.css>"""
        """<!-- <link href="no.json"> --><script>window.__CONFIG__ = "no.json"; window.__DATA__ = "data\\/s.json"; fetch("t.zip"); fetch("/api")</script><script src="y.js"></script>"""
    )
    p = _sites(spark, sf_dir).select("page_id", F.concat("site", F.lit("/")).alias("url"), F.concat("html", F.when(F.col("page_id") % 2 == 0, more).otherwise("")).alias("html"))
    return tg.extract_hints(p).groupBy("hint", "raw", "url").agg(F.count("*").alias("n"))


_FOLDERS = (
    ("images", 0, "a b~.png"), ("images", 1, "a%20b~.png"), ("images", 2, "dist/images/a b~.png"), ("images", 3, "dist/images/a%20b~.png"), ("media", 0, "a b~.png"), ("media", 1, "a%20b~.png"), ("media", 2, "dist/audio/a b~.png"),
    ("media", 3, "dist/audio/a%20b~.png"), ("media", 4, "dist/media/a b~.png"), ("media", 5, "dist/media/a%20b~.png"), ("media", 6, "dist/images/a b~.png"), ("media", 7, "dist/images/a%20b~.png"), ("media", 8, "audio/a b~.png"),
    ("media", 9, "audio/a%20b~.png"), ("media", 10, "media/a b~.png"), ("media", 11, "media/a%20b~.png"),
)


@_q(f"SELECT kind, rank, {_SITE} || '/v/' || x AS candidate, count(*) AS n FROM pages, {_values(_FOLDERS, 'kind, rank, x')} WHERE kind = CASE WHEN page_id % 2 = 0 THEN 'images' ELSE 'media' END GROUP BY 1, 2, 3")
def folder_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sites(spark, sf_dir).select(F.lit("/a b~.png").alias("raw"), F.when(F.col("page_id") % 2 == 0, "images").otherwise("media").alias("kind"), F.concat("site", F.lit("/v/")).alias("base_url"))
    return ex.asset_folder_candidates(rows).groupBy("kind", "rank", "candidate").agg(F.count("*").alias("n"))


_VIEWERS = (("iframe", None, "/v/"), ("json", "https://g.example.org", "/1"), ("script field game_url", "https://g.example.org", "/1"), ("script field project_url", "https://p.example.org", "/a"), ("og", None, "/o"), ("canonical", None, "/c"))


@_q(f"SELECT method, coalesce(whole, {_SITE}) || x AS url, count(*) AS n FROM pages, {_values(_VIEWERS, 'method, whole, x')} GROUP BY 1, 2")
def embedded_viewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = (
        """<iframe width=1 src=/v/></iframe><script type="application/json">{"deep":[{"game_url":"https://g.example.org/1"}],"url":"relative"}</script><!-- <iframe src="/no"> -->"""
        """<script>x = {"project_url": "https://p.example.org/a", "viewer_url": "https://no.example.org/", "link": "/no"}</script><link href="/c" rel="canonical"><meta content="/o" property="og:url">"""
    )
    p = _sites(spark, sf_dir).select("page_id", F.concat("site", F.lit("/")).alias("url"), F.concat("html", F.lit(more)).alias("html"))
    return tg.viewer_candidates(p).groupBy("method", "url").agg(F.count("*").alias("n"))


@_q("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE 2 END::BIGINT AS refs, (CASE WHEN doc_id % 3 = 2 THEN 0 ELSE 1 END + len(regexp_extract_all(coalesce(text, ''), 'data:image/')))::BIGINT AS inlined,
(CASE WHEN doc_id % 3 = 2 THEN 0 ELSE 1 END - len(regexp_extract_all(coalesce(text, ''), 'data:image/')))::BIGINT AS remaining, doc_id % 3 = 0 AS ok FROM documents""")
def output_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects that hold a document's text and two pictures; some are cut short, and some are the text alone."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = F.concat(F.lit('{"rows": [{"image": "data:image/png;base64,AA"}, {"image":"a.png"}], "link": "https://o.test/b.png", "more": '), F.to_json(F.struct("text")), F.lit("}"))
    broken = F.when(F.col("doc_id") % 2 == 0, F.concat(whole, F.lit("}"))).otherwise(F.substring(whole, F.lit(1), F.length(whole) - 1))
    text = F.when(F.col("doc_id") % 3 == 0, whole).when(F.col("doc_id") % 3 == 1, broken).otherwise(F.col("text"))
    return agg.validate_outputs(d.select(F.col("doc_id").alias("path"), text.alias("text"))).select(F.col("path").alias("doc_id"), F.col("refs").cast("long").alias("refs"), F.col("inlined").cast("long").alias("inlined"), F.col("remaining").cast("long").alias("remaining"), "ok")


_SCRIPTS = (("/js/App.12ab.js", 0), ("whatsapp-share.js", 1), ("main.js", 0), ("/runtime.js", 0), ("webpack.js", 2), ("chunk-vendors.1.js", 2), ("jquery.js", 1), ("vendor.app.js", 0), ("polyfills.js", 2), ("/index.js", 0), ("inline_script_3", 1))


@_q(f"SELECT p_partkey, lower(p_name || x) AS low, rank FROM part JOIN {_values(_numbered(_SCRIPTS), 'k, x, rank')} ON p_partkey % {len(_SCRIPTS)} = k")
def script_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", _nth([x for x, _ in _SCRIPTS], F.col("p_partkey"))).alias("label"))
    return rank_scripts(names, "label").select("p_partkey", "low", "rank")


_REGISTERED = [{"id": "a", "type": "icc_plus", "name": "Mine"}, {"id": "b", "type": "custom", "name": "LocalViewer"}, {"id": "c", "type": "om1cr0n", "name": "x"}]
_MARKS = {"icc_plus": ("<NAV>", "track("), "custom": ("<article>", "<TABLE"), "om1cr0n": ('class="ad"', "<b>", "<br>", "<p>")}


@_q("""WITH h AS (SELECT page_id, lower(html) AS h, page_id % 3 AS k FROM pages), s AS (SELECT page_id, contains(h, '<nav>')::INT + contains(h, 'track(')::INT + CASE WHEN k = 1 THEN 10 ELSE 0 END AS a,
contains(h, '<article>')::INT + contains(h, '<table')::INT + CASE WHEN k = 2 THEN 10 ELSE 0 END AS b, contains(h, 'class="ad"')::INT + contains(h, '<b>')::INT + contains(h, '<br>')::INT + contains(h, '<p>')::INT AS c FROM h),
t AS (SELECT page_id, a, CASE WHEN b > 0 THEN b + 5 ELSE 0 END AS b, c FROM s) SELECT page_id, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS viewer, greatest(a, b, c) AS score FROM t WHERE greatest(a, b, c) > 0""")
def viewer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("mode", _nth(("auto", "website_zip", "pure_website_folder"), F.col("page_id")))
    return jo.match_viewer(pages, _REGISTERED, F.col("mode"), _MARKS)


#: url, content (hexadecimal), content type; what it is by name first, and by content first.
_FILES = (
    ("/a.woff2", "474946383961", "", "woff2", "gif"), ("/a.css", "FFD8FFE0", "", "css", "jpg"), ("/a.jpeg", "00", "", "jpeg", "jpeg"), ("/a.jpeg", "00", "image/jpeg", "jpeg", "jpg"), ("/a", "FFF344C4", "", None, None), ("/a", "FFFB90", "", "mp3", "mp3"),
    ("/a", "203C3F786D6C20", "", "svg", "svg"), ("/a", "3C737667", "text/plain", "svg", "svg"), ("/a?x=1&Format=WEBP", "89504E470D0A1A0A", "", "webp", "png"), ("/a?type=image/png", "00", "", None, None), ("/a?ext=b.ogg", "00", "", "ogg", "ogg"),
    ("/a?fm=.png", "424D", "", "png", "bmp"), ("/a.bin/", "00000000667479706176696600", "image/png; q=1", "avif", "avif"), ("/a.bin", "00", "image/webp; q=1", None, "webp"), ("/a.ico", "52494646000000005745425000", "", "ico", "webp"),
)


@_q(f"SELECT page_id, named, sniffed FROM pages JOIN {_values(_numbered(_FILES), 'k, x, content, mime, named, sniffed')} ON page_id % {len(_FILES)} = k")
def sniffed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: _nth([f[k] for f in _FILES], F.col("page_id"))
    rows = _sites(spark, sf_dir).select("page_id", F.concat("site", part(0)).alias("url"), F.unhex(part(1)).alias("content"), part(2).alias("mime"))
    return rows.select("page_id", fl.sniff(F.col("content"), F.col("url")).alias("named"), fl.sniff(F.col("content"), F.col("url"), True, F.col("mime")).alias("sniffed"))


_CODE = (
    ("js/app.js", "", "bundle"), ("main.js", "", "bundle"), ("core.js", "", "bundle"), ("js/core.js", "basePath = new URL('../', currentScript.src)", "loader"), ("a/chunk-vendors.1a2b3c-legacy.js", "", "bundle"), ("x.js", "p = __webpack_public_path__ + n", "loader"),
    ("x.js", "__webpack_require__(1)", "plain"), ("x.mjs", "import(name)", "plain"), ("application.js", "", "plain"), ("index.12.js", "", "plain"), ("app.js", None, "bundle"),
)


@_q(f"SELECT class, count(*) AS n FROM documents JOIN {_values(_numbered(_CODE), 'k, path, code, class')} ON doc_id % {len(_CODE)} = k GROUP BY 1")
def script_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts that hold a document's text as a comment."""
    part = lambda k: _nth([c[k] for c in _CODE], F.col("doc_id"))
    code = F.concat(F.lit("/* "), F.coalesce("text", F.lit("")), F.lit(" */ "), part(1))
    return fl.classify_scripts(table(spark, sf_dir, "documents").select(part(0).alias("path"), code.alias("text"))).groupBy("class").agg(F.count("*").alias("n"))


_GALLERY = (("/view/1", True, True), ("/a/status/2", True, True), ("/posts/3", True, True), ("/set/4", False, True), ("/album/5", False, True), ("/gallery/a.png", False, True), ("/artworks", False, True))


@_q(f"""SELECT page_id, CASE WHEN {_SITE} IN ('http://therin.example.net', 'http://thther.example.org') AND x NOT LIKE '%.png' THEN 'known' WHEN smart THEN substr({_SITE}, 8) END AS smart, CASE WHEN {_SITE} IN ('http://therin.example.net', 'http://thther.example.org') THEN 'known' ELSE substr({_SITE}, 8) END AS forced
FROM pages JOIN {_values(_numbered(_GALLERY), 'k, x, smart, forced')} ON page_id % {len(_GALLERY)} = k""")
def gallery_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sites(spark, sf_dir).select("page_id", F.concat("site", _nth([g[0] for g in _GALLERY], F.col("page_id"))).alias("url"))
    known = {"therin.example.net": "known", "thther.example.org": "known"}
    smart = fl.route_gallery(rows, known).withColumnRenamed("extractor", "smart")
    return fl.route_gallery(smart, known, mode="force").select("page_id", "smart", F.col("extractor").alias("forced"))


_PROJECT = '{"rows": [], "title": "t", "choices": [], "backpack": [], "points": [], "theme": {}, "pointTypes": []}'
#: path, status, content type, body; the reason against it.
_ANSWERS = (
    ("/a", 200, "text/html", "<title>Interactive CYOA Creator</title>", None), ("/b", 200, "text/html", "<script>window.app = 1</script>", None), ("/c", 200, "text/html", "<script type=module></script> shop", "no valid project/viewer signature"),
    ("/d", 404, "text/html", "", "HTTP 404"), ("/e", None, None, None, "request failed"), ("/f", 200, "text/html", "<title>[CYOA] x</title><main><input><label>", None), ("/g/project.json", 200, "application/json", _PROJECT, None),
    ("/g", 200, "text/html", "prose", None), ("/h", 200, "text/html", "prose", None), ("/h/dist/platform.json", 200, "application/json", "{}", None), ("/h/dist/nodes/list.json", 200, "application/json", "[1]", None),
    ("/i", 200, "text/html", "prose", "no valid project/viewer signature"), ("/i/dist/platform.json", 200, "application/json", "[]", "not a viewer's list"), ("/i/dist/nodes/list.json", 200, "application/json", "[]", None), ("/i/dist/nodes/list.json#x", 200, "application/json", "[]", "already visited"),
    ("/j/game/1", 200, "text/html", "<div id='app'>", "metadata page, not viewer"), ("/j/game/2", 200, "text/html", "<div id='app'><iframe>", None), ("/k", 200, "application/json", "{}", "no valid project/viewer signature"),
)


@_q(f"SELECT {_SITE} || '/' || page_id || x AS url, reason IS NULL AS ok, reason FROM pages, {_values([(a[0], a[4]) for a in _ANSWERS], 'x, reason')} WHERE NOT starts_with(x, '/j') OR {_SITE} = 'http://therin.example.net'")
def viewer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers below each page's address; the catalogue is one of the sites."""
    each = F.explode(F.array(*[F.struct(F.lit(a[0]).alias("x"), F.lit(a[1]).cast("int").alias("status"), F.lit(a[2]).alias("mime"), F.lit(a[3]).alias("body"), F.lit(k).alias("ord")) for k, a in enumerate(_ANSWERS)]))
    rows = _sites(spark, sf_dir).select("page_id", "site", each.alias("a")).select(F.concat("site", F.lit("/"), "page_id", "a.x").alias("url"), "a.*")
    rows = rows.where(~F.startswith("x", F.lit("/j")) | (u.hostname("url") == "therin.example.net")).drop("x")
    return fl.validate_viewers(rows, catalogue="therin.example.net")


#: A file's path, its text, and what it names, from the site's address on.
_TEXTS = (
    ("/v/js/core.js", """basePath = new URL('../', document.currentScript.src).pathname; add({href: basePath + 'css/dark.css'}); fetch(basePath + 'project.json')""", ("/v/css/dark.css", "/v/project.json")),
    ("/v/js/a.js", """w = new URL('./w/', import.meta.url); a = "./w/z.png"; b = "k.png"; c = new URL(`h.webp`, import.meta.url)""", ("/v/js/w/z.png", "/v/k.png", "/v/js/h.webp")),
    ("/v/js/b.js", """i = "img\\/esc.webp"; j = "my pic.png"; t = {"../../x/alias.webp": hashed}; m = "application/json,.json"; u = "data:image/gif;a.png"; n = "f(x).png" """, ("/v/img/esc.webp", "/v/my pic.png")),
    ("/v/js/c.js", """const imageSrc = 'image/'; let imagesToLoad = ['card/x.webp', "/abs/y.png"]; const other = ['card/z.png']""", ("/v/js/image/card/x.webp", "/abs/y.png", "/v/card/z.png")),
    ("/v/assets/d.js", """__vite__mapDeps=1;d=(m.f||(m.f=["foo-1.js","./bar-2.js","x/no.js"])); import("./lazy-3.js"); import{a}from"./st-4.mjs"; import "./assets/own-5.js" """, ("/assets/foo-1.js", "/v/assets/bar-2.js", "/v/assets/lazy-3.js", "/v/assets/st-4.mjs", "/v/assets/own-5.js")),
    ("/v/sw.js", """self.__precacheManifest = [{"url": "p/q", "revision": "1"}, {"url": "/r/s.js"}]""", ("/v/p/q", "/r/s.js")),
    ("/v/e.css", """a{b:url( 'img/f.png?x=1#y' )} c{d:image-set("g.avif" 1x, 'h.avif' 2x)} .x{background:url(data:image/png;base64,a.png)}""", ("/v/img/f.png?x=1", "/v/g.avif", "/v/h.avif")),
    ("/v/p.json", """{"a": {"img/key.png": "deep/l.png"}, "text": "<b>x</b><img src=\\"in/m.png\\">", "label": "Luna https:/cdn.example.org/n.gif", "list": ["o.js", "no", ".json"], "u": "https:\\/\\/cdn.example.org\\/q.jpg"}""", ("/v/deep/l.png", "/v/in/m.png", "https://cdn.example.org/n.gif", "/v/o.js", "/v/.json", "https://cdn.example.org/q.jpg", "/v/img/key.png")),
    ("/v/i.html", """<img data-src="lazy/r.png" srcset="s.png 1x, t.png 2x"><source src='u.bin'><link rel="preload" href="v.bin"><svg><image xlink:href="w.bin"/></svg>""", ("/v/lazy/r.png", "/v/s.png", "/v/t.png", "/v/u.bin", "/v/v.bin", "/v/w.bin")),
)
_NAMED = [(k, x if x.startswith("http") else None, x) for k, (_, _, names) in enumerate(_TEXTS) for x in names]


@_q(f"SELECT page_id, coalesce(whole, {_SITE} || x) AS url FROM pages JOIN {_values(_NAMED, 'k, whole, x')} ON page_id % {len(_TEXTS)} = k")
def text_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: _nth([t[k] for t in _TEXTS], F.col("page_id"))
    files = _sites(spark, sf_dir).select(F.concat("page_id", part(0)).alias("path"), F.concat("site", part(0)).alias("url"), F.concat("site", F.lit("/v/")).alias("base_url"), part(1).alias("text"))
    return ts.scan_text_assets(files).select(F.regexp_extract("owner", "^(\\d+)", 1).cast("long").alias("page_id"), "url").distinct()


#: A file's text, the rule, and the names that it makes.
_MADE = (
    ("const cardImages = ['a.png', 'x/b.webp', './c.png', 'pics/d.png', 'plain']; var imgDir = 'pics/'; undeclaredImages = ['e.png']; let words = ['f.png']", "list", ("pics/a.png", "pics/x/b.webp")),
    ("""n = Math.floor(Math.random()*3)+2; s = "t/"+n+".png?x=1"; big = Math.floor(Math.random()*5000); z = "u/"+big+".gif" """, "number", ("t/2.png?x=1", "t/3.png?x=1", "t/4.png?x=1")),
    ("""x = [{Code:'elf'},{"code":'orc'},{code:'data:no'},{code:'elf'}]; y = <img src=f/${p.code}_s.svg>""", "property", ("f/elf_s.svg", "f/orc_s.svg")),
)


@_q(f"SELECT page_id, rule, raw, {_SITE} || '/v/' || raw AS url FROM pages JOIN {_values([(k, r, x) for k, (_, r, names) in enumerate(_MADE) for x in names], 'k, rule, raw')} ON page_id % {len(_MADE)} = k")
def made_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _sites(spark, sf_dir).select(F.col("page_id").alias("path"), F.concat("site", F.lit("/v/x.js")).alias("url"), _nth([m[0] for m in _MADE], F.col("page_id")).alias("text"))
    made = lambda df, rule: df.select("path", F.lit(rule).alias("rule"), "raw")
    every = made(ts.infer_prefixed_assets(files), "list").unionByName(made(ts.expand_numeric(files), "number")).unionByName(made(ts.expand_properties(files), "property"))
    return every.join(files.select("path", "url"), "path").select(F.col("path").alias("page_id"), "rule", "raw", u.resolve(F.col("url"), F.col("raw")).alias("url"))


#: A page, what failed, its kind, as it was written; the places to try.
_LOST = (
    ("/v", "/v/css/img/a.png", "css", "img/a.png", ((0, "/v/a.png"),)), ("/v/", "/v/a.png", "css", "a.png", ((0, "/v/a.png"),)), ("/v/", "/v/js/b.png", "js", "b.png", ((0, "/v/b.png"),)), ("/v/", "/assets/c.js", "js", "/assets/c.js", ((1, "/v/assets/c.js"),)),
    ("/", "/d.mjs", "js", "/d.mjs", ((2, "/assets/d.mjs"),)), ("/v", "/v/assets/e.js", "js", "/v/assets/e.js", ()),
)


@_q(f"SELECT page_id, rank, {_SITE} || x AS candidate FROM pages JOIN {_values([(k, r, x) for k, c in enumerate(_LOST) for r, x in c[4] if x != c[1]], 'k, rank, x')} ON page_id % {len(_LOST)} = k")
def fallback_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: _nth([c[k] for c in _LOST], F.col("page_id"))
    rows = _sites(spark, sf_dir).select("page_id", F.concat("site", part(0)).alias("page_url"), F.concat("site", part(1)).alias("url"), part(2).alias("kind"), part(3).alias("raw"))
    found = ex.fallback_candidates(rows.drop("page_id").distinct())
    return rows.join(found, ["page_url", "url"]).select("page_id", "rank", "candidate")
