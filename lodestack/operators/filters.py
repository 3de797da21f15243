"""Predicates and classifications, each as a job over a table."""

from __future__ import annotations

import mimetypes
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import fixed
from lodestack.functions.scalars import is_project_text, redact, redaction_hits
from lodestack.functions.urls import canonical_url, extension, hostname, let, netloc, path, same_origin, scheme
from lodestack.operators.scan import with_totals
from lodestack.shared import written


def filter_http(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.rlike(F.trim(column), F.lit("(?i)^https?://")))


def filter_refs(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """References that could be fetched; ``strict`` also drops very long ones, control characters, drive letters and words for nothing."""
    c = F.trim(column)
    ok = (c != "") & ~F.rlike(c, F.lit(fixed.NO_REFERENCE)) & (~F.rlike(c, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")) | F.rlike(c, F.lit("(?i)^https?:")))
    if strict:
        ok &= (F.length(c) <= 600) & ~F.rlike(c, F.lit(r"[\x00-\x1f]|^[A-Za-z]:[\\/]")) & ~F.upper(c).isin("NONE", "NULL", "N/A", "[]")
    return df.where(ok)


def filter_assets(df: DataFrame, column: str) -> DataFrame:
    """URLs whose path has an asset's extension or ends in a project file; name-space links are none."""
    ext = F.substring(extension(column), 2, 20)
    return df.where((ext.isin(*fixed.ASSET_EXTENSIONS) | F.rlike(path(column), F.lit(r"(?i)project\.(json|txt|zip)$"))) & ~F.contains(column, F.lit("w3.org/")))


def drop_telemetry_hosts(df: DataFrame, column: str, hosts: Sequence[str] = fixed.TELEMETRY_HOSTS, suffixes: Sequence[str] = fixed.TELEMETRY_SUFFIXES) -> DataFrame:
    host = hostname(column)
    bad = host.isin(*hosts)
    for s in suffixes:
        bad |= F.endswith(host, F.lit(s))
    return df.where(~bad)


def is_internal_host(host: Column) -> Column:
    """localhost, local names, and literal addresses that no public server has; an empty host is one too.

    Of IPv6 those are: unspecified, loopback, IPv4 in it (judged as such), unique local (fc, fd), link local (fe8 to feb), multicast (ff), documentation
    (2001:db8), discard only (100::) and what is reserved outside of 2000::/3.
    """
    o = F.transform(F.split(F.regexp_extract(host, r"((?:\d{1,3}\.){3}\d{1,3})$", 1), r"\."), lambda x: x.try_cast("int"))
    a, b = F.get(o, F.lit(0)), F.get(o, F.lit(1))
    v4 = F.rlike(host, F.lit(r"^(::ffff:|::)?\d{1,3}(\.\d{1,3}){3}$"))
    private = v4 & (a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | (a >= 224) | ((a == 100) & b.between(64, 127)))
    v6 = F.contains(host, F.lit(":")) & ~v4 & (F.rlike(host, F.lit(r"^(0*:)*:?0*1?$|^f[cdef]|^0*(1[0-9a-f]{0,2}|[1-9a-f][0-9a-f]{0,2}|[0189a-e][0-9a-f]{3})?:|^2001:0?db8:")) & ~F.rlike(host, F.lit("^[23][0-9a-f]{3}:(?!0?db8:)")))
    named = (host == "") | (host == "localhost") | F.rlike(host, F.lit(r"\.(localhost|local)$"))
    return F.coalesce(named | private | v6, F.lit(False))


def is_blocked(url: Column, base: Column) -> Column:
    """Whether ``url`` is on an internal host that isn't ``base``'s own; an empty host isn't."""
    return let(lambda url, base: let(lambda host: (host != "") & is_internal_host(host), hostname(url)) & ~same_origin(url, base), url, base)


def screen_internal(df: DataFrame, url: str, base: str, allow: bool = False) -> DataFrame:
    """``df`` with ``blocked``: an internal host that isn't the base's own; an empty host passes."""
    return df.withColumn("blocked", F.lit(False) if allow else is_blocked(F.col(url), F.col(base)))


def filter_scope(links: DataFrame, seed_url: str = "seed", column: str = "url") -> DataFrame:
    """Links in the story of their seed: same scheme and host, no account pages, at or below the seed's folder."""
    start = F.regexp_replace(path(seed_url), "/+$", "")
    leaf = F.regexp_extract(path(seed_url), "([^/]*)$", 1)
    scope = F.when(F.contains(leaf, F.lit(".")), F.regexp_replace(path(seed_url), "[^/]*$", "")).otherwise(F.concat(start, F.lit("/")))
    own = F.when(path(column) == "", "/").otherwise(path(column))
    same = (scheme(seed_url) == scheme(column)) & (F.lower(netloc(seed_url)) == F.lower(netloc(column)))
    return links.where(same & ~F.rlike(own, F.lit(fixed.SKIPPED_PATHS)) & ((F.regexp_replace(own, "/+$", "") == start) | F.startswith(own, scope)))


def drop_error_documents(df: DataFrame, body: str = "content", mime: str = "mime", binary: str | None = None) -> DataFrame:
    """Responses that aren't an error page in place of a file; where the column ``binary`` says that a binary file was asked for, JSON is one too."""
    head = F.lower(F.ltrim(F.substring(F.col(body).cast("string"), 1, 512)))
    m = F.coalesce(F.lower(mime), F.lit(""))
    bad = F.rlike(m, F.lit(r"text/html|application/xhtml\+xml")) | F.rlike(head, F.lit(r'^(<!doctype html|<html|<head|<body|\{"error)'))
    if binary:
        bad |= F.coalesce(F.col(binary), F.lit(False)) & F.contains(m, F.lit("application/json"))
    return df.where(~bad)


def _is_data_path(p: Column) -> Column:
    return F.rlike(p, F.lit(r"(?i)project\.(json|txt|zip)$"))


def classify_kind(url: Column | str, mime: Column | None = None) -> Column:
    """css, js, fonts, images, media, json, html or assets: the first kind whose content type or extension it has."""
    ext = F.substring(extension(url), 2, 20)
    m = F.lower(F.coalesce(mime, F.lit(""))) if mime is not None else F.lit("")
    has = lambda text: F.contains(m, F.lit(text))
    begins = lambda text: F.startswith(m, F.lit(text))
    return (
        F.when(has("text/css") | ext.isin(*fixed.STYLE_EXTENSIONS), "css").when(has("javascript") | ext.isin(*fixed.SCRIPT_EXTENSIONS), "js")
        .when(has("font") | ext.isin(*fixed.FONT_EXTENSIONS), "fonts").when(begins("image/") | ext.isin(*fixed.IMAGE_EXTENSIONS), "images")
        .when(begins("audio/") | begins("video/") | ext.isin(*fixed.MEDIA_EXTENSIONS), "media")
        .when((m == "application/json") | _is_data_path(path(url)) | ext.isin(*fixed.DATA_EXTENSIONS), "json").when(has("text/html") | ext.isin("html", "htm"), "html")
        .otherwise("assets")
    )


def classify_path(url: Column | str) -> Column:
    """The kind of a reference of which only the path is known; data files come first, and pages count as assets."""
    ext = F.substring(extension(url), 2, 20)
    return (
        F.when(_is_data_path(path(url)) | ext.isin(*fixed.DATA_EXTENSIONS), "json").when(ext.isin(*fixed.FONT_EXTENSIONS), "fonts").when(ext.isin(*fixed.IMAGE_EXTENSIONS), "images")
        .when(ext.isin(*fixed.MEDIA_EXTENSIONS), "media").when(ext.isin(*fixed.STYLE_EXTENSIONS), "css").when(ext.isin(*fixed.SCRIPT_EXTENSIONS), "js").otherwise("assets")
    )


def filter_runtime_assets(df: DataFrame, url: str = "url", mime: str = "mime") -> DataFrame:
    """Responses that a running page loads as an asset: by content type, else by extension."""
    m = F.trim(F.lower(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    return df.where(F.rlike(m, F.lit("^(image|audio|video|font)/")) | m.isin(*fixed.RUNTIME_TYPES) | F.coalesce(F.substring(extension(url), 2, 20).isin(*fixed.RUNTIME_EXTENSIONS), F.lit(False)))


def sniff(content: Column, url: Column | None = None, media: bool = False, mime: Column | None = None) -> Column:
    """What a file is, else null: by its URL's extension, then by a hint in the query (``format``, ``fm``, ``ext``, ``type``), then by its first bytes;
    ``media``: by the bytes, then the content type, then the URL."""
    hexed = F.hex(F.substring(content, 1, 16))
    begins = lambda *x: F.rlike(hexed, F.lit("^(?:" + "|".join(x) + ")"))
    text = F.ltrim(F.regexp_replace(F.substring(content, 1, 256).cast("string"), r"^\s+", ""))
    magic = (
        F.when(begins("89504E470D0A1A0A"), "png").when(begins("FFD8FF"), "jpg").when(begins("474946383761", "474946383961"), "gif").when(begins("52494646.{8}57454250"), "webp")
        .when(begins(".{8}6674797061766966", ".{8}6674797061766973"), "avif").when(begins("424D"), "bmp").when(begins("494433", "FFFB"), "mp3").when(F.rlike(text, F.lit(r"^<(?:svg|\?xml)")), "svg")
    )
    if url is None:
        return magic
    bare = F.substring(extension(F.regexp_replace(path(url), "/+$", "")), 2, 20)
    hints = F.transform(F.regexp_extract_all(url, F.lit(r"(?i)(?<=[?&])(?:format|fm|ext|type)=([^&#]*)"), F.lit(1)), lambda v: F.lower(v))
    value = lambda v: F.coalesce(F.when(F.rlike(v, F.lit(r"\.[^./]+$")) & ~F.startswith(v, F.lit(".")), F.regexp_extract(v, r"\.([^./]+)$", 1)), F.regexp_replace(v, r"^\.+", ""))
    hint = F.get(F.filter(F.transform(hints, value), lambda v: v.isin(*fixed.SNIFFED_PICTURES, *fixed.SNIFFED_SOUNDS)), F.lit(0))
    by_name = F.coalesce(F.when(bare.isin(*fixed.SNIFFED_PICTURES, *fixed.SNIFFED_SOUNDS, *fixed.FONT_EXTENSIONS, *fixed.SNIFFED_TEXTS), bare), hint)
    if not media:
        return F.coalesce(by_name, magic)
    named = F.lit(None).cast("string") if mime is None else F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME_EXTENSIONS.items() for x in kv]), F.lower(F.trim(F.substring_index(mime, ";", 1))))
    return F.coalesce(magic, named, by_name)


#: The extension that a content type is known for, by the standard library's own table.
MIME_EXTENSIONS = {kind: ("jpg" if end in (".jpe", ".jpeg") else end[1:]) for kind in sorted(set(mimetypes.MimeTypes().types_map[True].values())) if (end := mimetypes.MimeTypes().guess_extension(kind))}


def sniff_audit(files: DataFrame) -> DataFrame:
    """declared, sniffed, n: how often a path's extension and its content disagree or agree."""
    declared = F.when(extension("path") == ".jpeg", "jpg").otherwise(F.substring(extension("path"), 2, 10))
    return files.select(declared.alias("declared"), sniff(F.col("content")).alias("sniffed")).groupBy("declared", "sniffed").agg(F.count("*").alias("n"))


def normal_mode(c: Column) -> Column:
    """A queue row's mode in its one spelling, "" if unknown."""
    own = _mode_name(c)
    for spelling, mode in fixed.MODE_SPELLINGS.items():
        own = F.when(own == spelling, mode).otherwise(own)
    return F.when(own.isin(*fixed.MODES), own).otherwise("")


def _mode_name(c: Column) -> Column:
    return F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "- ", "__")


def normalize_modes(queue: DataFrame) -> DataFrame:
    """The queue with its modes in one spelling and what they ask for: zip, both, pure, website, website_zip, engine."""
    m = F.col("mode")
    vue, pure = m.isin(*fixed.VUE_MODES), m.isin(*fixed.PURE_MODES)
    flags = {"zip": m == "zip", "both": m == "both", "pure": pure, "website": m.isin(*fixed.WEBSITE_MODES) | vue | pure, "website_zip": ~m.isin(*fixed.FOLDER_MODES), "engine": F.when(vue, "cyoap_vue").otherwise("standard")}
    return queue.withColumn("mode", normal_mode(m)).withColumns(flags)


def classify_records(df: DataFrame) -> DataFrame:
    """``class`` of a catalogue record: static_pages if it has page files, linked_viewer if one of its link fields is http(s), else unknown."""
    pages = F.coalesce(F.exists("pages", lambda x: F.trim(x) != ""), F.lit(False))
    linked = F.lit(False)
    for field in fixed.RECORD_FIELDS:
        if field in df.columns:
            linked |= F.coalesce(F.rlike(F.trim(field), F.lit("(?i)^https?://")), F.lit(False))
    return df.withColumn("class", F.when(pages, "static_pages").when(linked, "linked_viewer").otherwise("unknown"))


def screen_candidates(df: DataFrame, column: str = "url") -> DataFrame:
    """``df`` with ``reason`` (null if allowed) and ``allowed`` of candidate links."""
    host = hostname(column)
    social = host.isin(*fixed.SOCIAL_HOSTS)
    for s in fixed.SOCIAL_HOSTS:
        social |= F.endswith(host, F.lit(f".{s}"))
    aside = F.exists(F.array(*map(F.lit, fixed.ASIDE_TOKENS)), lambda t: F.contains(F.lower(column), t))
    ext = F.substring(extension(column), 2, 20)
    reason = (
        F.when(~F.coalesce(scheme(column).isin("http", "https") & (netloc(column) != ""), F.lit(False)), "not an HTTP(S) URL")
        .when(ext.isin(*fixed.IMAGE_EXTENSIONS, *fixed.MEDIA_EXTENSIONS, *fixed.FONT_EXTENSIONS), "direct media/font asset").when(is_internal_host(host), "internal address")
        .when(social, "repository/social/analytics host").when(aside, "profile/documentation/tracking URL")
    )
    return df.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def flag_challenges(df: DataFrame, body: str = "html", mime: str = "mime", server: str = "server", ray: str = "ray") -> DataFrame:
    """``challenge``: an HTML or JSON answer of the guarding edge (by its Server or ray header) with a marker in its first 2,000 characters."""
    typed = F.rlike(F.coalesce(mime, F.lit("")), F.lit("text/html|application/json"))
    edge = (F.coalesce(ray, F.lit("")) != "") | F.contains(F.lower(F.coalesce(server, F.lit(""))), F.lit("cloudflare"))
    marked = F.exists(F.array(*map(F.lit, fixed.CHALLENGE_MARKERS)), lambda m: F.contains(F.substring(body, 1, 2000), m))
    return df.withColumn("challenge", F.coalesce(typed & edge & marked, F.lit(False)))


def flag_custom_viewers(pages: DataFrame, body: str = "html", pairs: Sequence[tuple[str, str]] = fixed.VIEWER_MARKERS) -> DataFrame:
    """Pages in which both marks of a pair are, in any case of letters."""
    low, hit = F.lower(body), F.lit(False)
    for a, b in pairs:
        hit |= F.contains(low, F.lit(a)) & F.contains(low, F.lit(b))
    return pages.withColumn("custom_viewer", F.coalesce(hit, F.lit(False)))


def failure_cause(error: Column) -> Column:
    """Why a download failed, by the first 500 characters of its message: causes of media tools first, then of connections, then an HTTP status."""
    e = F.lower(F.substring(F.trim(F.regexp_replace(error, r"\s+", " ")), 1, 500))
    said = lambda *x: reduce(lambda a, b: a | b, [F.contains(e, F.lit(t)) for t in x])
    status = F.regexp_extract(e, r"\b(?:http|status)(?: error)?[ :]*([1-5]\d\d)\b", 1)
    return (
        F.when(said("cookie database") & said(*fixed.COOKIE_LOCKS), "cookie lock").when(said("no supported javascript runtime"), "runtime missing")
        .when(said("signature solving failed", "challenge solving failed"), "signature").when(said("provided youtube account cookies are no longer valid"), "cookies expired")
        .when(said("certificate verification failed", "certificate verify failed", "sslerror"), "tls").when(said("connection reset", "econnreset"), "reset")
        .when(said("name or service not known", "nodename"), "dns").when(said(*fixed.BOT_CHECKS), "bot check").when(status != "", F.concat(F.lit("http "), status)).otherwise("other")
    )


def classify_failures(log: DataFrame, column: str = "error") -> DataFrame:
    return log.groupBy(failure_cause(F.col(column)).alias("cause")).agg(F.count("*").alias("n"))


def redacted(df: DataFrame, column: str) -> DataFrame:
    """``df`` with secrets in ``column`` withheld, and ``hits``, their number."""
    return df.withColumn("hits", redaction_hits(F.col(column))).withColumn(column, redact(F.col(column)))


#: Bounds of a site's policy: column, default, least, most.
POLICY_BOUNDS = (("max_pages", 300, 1, 5000), ("max_depth", 30, 0, 100), ("max_seconds", 1800, 0, 1800), ("scroll_steps", 12, 0, 1000), ("interactions", 12, 0, 1000), ("rounds", 1, 1, 100))


def normalize_policies(df: DataFrame) -> DataFrame:
    """A table of per-site policies (strings) with every number in its bounds: what isn't a finite number becomes the default."""
    strategy = F.lower(F.trim("strategy"))
    out = df.withColumn("strategy", F.when(strategy.isin("classic", "smart", "browser"), strategy).otherwise("classic"))
    for name, default, least, most in POLICY_BOUNDS:
        x = F.col(name).try_cast("double")
        good = F.when(~F.isnan(x) & (F.abs(x) < 1e15), x).cast("long")
        out = out.withColumn(name, F.least(F.greatest(F.coalesce(good, F.lit(default)), F.lit(least)), F.lit(most)).cast("int"))
    return out


def filter_safe_labels(df: DataFrame) -> DataFrame:
    """UI controls that may be pressed: ``df`` is (label, type, in_form, expanded). None in a form, none that sends or buys; else those that show more."""
    label = F.trim(F.regexp_replace(F.coalesce("label", F.lit("")), r"\s+", " "))
    sends = F.coalesce(F.col("in_form"), F.lit(False)) | F.coalesce(F.lower("type").isin("submit", "reset", "image"), F.lit(False))
    shows = F.rlike(label, F.lit(fixed.SAFE_LABELS)) | F.coalesce(F.lower("expanded") == "false", F.lit(False))
    return df.where(~sends & ~F.rlike(label, F.lit(fixed.UNSAFE_LABELS)) & shows)


def classify_scripts(files: DataFrame) -> DataFrame:
    """path, class of scripts: loader by content, else bundle by name, else plain; only plain ones may be rewritten."""
    loads = F.rlike("text", F.lit(fixed.LOADER_BASE)) | F.rlike("text", F.lit(fixed.LOADER_PATHS))
    own = F.when(F.coalesce(loads, F.lit(False)), "loader").when(F.rlike(path("path"), F.lit(fixed.BUNDLE_NAME)), "bundle").otherwise("plain")
    return files.where(F.rlike("path", F.lit(r"(?i)\.m?js$"))).select("path", own.alias("class"))


_ENDPOINT = r"(?i)(?:project\.(?:json|txt)|dist/platform\.json|dist/nodes/list\.json)$"


def validate_viewers(responses: DataFrame, catalogue: str = fixed.CATALOGUE_HOST) -> DataFrame:
    """url, ok, reason: whether a response (url, status, mime, body; ``ord``, if there is an order) is a viewer page.

    A page is one if it is a project itself, has a viewer's mark (the catalogue's own pages need a strong one), is a plain form under the catalogue's title, or if
    the responses have a project or both of a platform's two lists below it. Of a page in several spellings the first counts, the others were visited.
    """
    order = "ord" if "ord" in responses.columns else "url"
    rows = responses.withColumn("__own", F.coalesce(canonical_url("url"), F.col("url")))
    first = written(with_totals(rows, ["__own"], __first=F.min(F.struct(order, "url"))))
    body, kind = F.coalesce("body", F.lit("")), F.lower(F.coalesce("mime", F.lit("")))
    low, own = F.lower(body), F.lower(path("__own"))
    json = F.schema_of_variant(F.try_parse_json("body"))
    good = F.coalesce("status", F.lit(0)) < 400
    listed = F.when(F.endswith(own, F.lit("dist/nodes/list.json")), F.coalesce(F.startswith(json, F.lit("ARRAY")), F.lit(False))).when(F.endswith(own, F.lit("dist/platform.json")), F.coalesce(F.startswith(json, F.lit("OBJECT")), F.lit(False)))
    project = is_project_text(F.col("body"))
    found = first.withColumns({"__listed": listed, "__project": project})

    ends = found.where(good & F.rlike(own, F.lit(_ENDPOINT))).select(F.regexp_replace("__own", r"/*" + _ENDPOINT, "").alias("__base"), own.alias("__end"), F.coalesce("__listed", "__project").alias("__good"))
    has = lambda end: F.bool_or(F.endswith("__end", F.lit(end)) & F.col("__good"))
    pairs = ends.groupBy("__base").agg((F.bool_or(F.rlike("__end", F.lit(r"project\.(json|txt)$")) & F.col("__good")) | (has("dist/platform.json") & has("dist/nodes/list.json"))).alias("__served"))
    found = found.withColumn("__base", F.regexp_replace("__own", "/+$", "")).join(pairs, "__base", "left")

    said = lambda *x: reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in x])
    custom = reduce(lambda a, b: a | b, [F.contains(low, F.lit(a)) & F.contains(low, F.lit(b)) for a, b in fixed.VIEWER_MARKERS])
    shell = (F.lower(netloc("__own")) == catalogue) & F.contains(own, F.lit("/game/")) & ~said(*fixed.STRONG_MARKS) & ~custom
    form = (F.contains(kind, F.lit("text/html")) | F.rlike(low, F.lit("^(?:<!doctype html|<html)"))) & said("<title>[cyoa]") & said("<main") & said("<input") & said("<label")
    data = F.contains(kind, F.lit("json")) | F.rlike(own, F.lit(r"\.(?:json|txt)$"))
    marked = said(*fixed.VIEWER_MARKS) | custom
    reason = (
        F.when(F.struct(order, "url") > F.col("__first"), "already visited").when(F.col("status").isNull() & F.col("body").isNull(), "request failed").when(~good, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(data & F.col("__listed").isNotNull(), F.when(~F.col("__listed"), "not a viewer's list")).when(data & F.col("__project"), None).when(marked & shell, "metadata page, not viewer").when(marked | form, None)
        .when(F.coalesce("__served", F.lit(False)), None).otherwise("no valid project/viewer signature")
    )
    return found.select("url", reason.isNull().alias("ok"), reason.alias("reason"))


def route_gallery(df: DataFrame, known: dict[str, str], column: str = "url", mode: str = "smart", raw_hosts: Sequence[str] = fixed.RAW_PICTURE_HOSTS) -> DataFrame:
    """``df`` with ``extractor`` of gallery links, null for others: a known host's key; else the host of pages whose path has a gallery's part. In mode ``smart``
    pictures, and what hosts of raw files hold, have none; in mode ``force`` every http(s) link has one; in mode ``off`` none."""
    if mode == "off":
        return df.withColumn("extractor", F.lit(None).cast("string"))
    host = hostname(column)
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.lit(None).cast("map<string,string>")
    own = F.coalesce(F.try_element_at(table, host), F.when(F.lit(mode == "force") & scheme(column).isin("http", "https"), F.when(host == "", "custom").otherwise(host)))
    page = reduce(lambda a, b: a | b, [F.contains(F.lower(path(column)), F.lit(t)) for t in fixed.GALLERY_PARTS])
    own = F.coalesce(own, F.when(page, F.when(host == "", "page").otherwise(host)))
    raw = host.isin(*raw_hosts) | F.substring(extension(column), 2, 20).isin(*fixed.IMAGE_EXTENSIONS)
    return df.withColumn("extractor", F.when(~raw, own) if mode == "smart" else own)
