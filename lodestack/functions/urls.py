"""URL and path identities as Column expressions. Nothing here is a UDF, so filters and projections on them stay in the scan's stage."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query keys that only track, besides all that begin with "utm_".
TRACKING_KEYS = ("from", "ref", "source", "fbclid", "gclid")

#: Query keys that only defeat caches.
CACHE_BUSTERS = ("v", "ver", "version", "cb", "cache", "cachebust", "cache_bust", "cachebuster", "t", "ts", "timestamp", "_", "dpl")

#: Suffixes of a path's last segment that make it a document rather than a directory.
DOCUMENT_SUFFIXES = (".html", ".htm", ".php", ".asp", ".aspx", ".jsp")

#: Path parts that are no name of a project on their own.
GENERIC_NAMES = tuple("cyoa assets asset images files pages index www web site game viewer view public static v1 v2 v3 v4 v5 beta test demo page cyoas".split())

#: Device names that some file systems reserve.
RESERVED_NAMES = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _part(pattern: str, group: int = 1):
    return lambda c: F.regexp_extract(_col(c), pattern, group)


scheme = lambda c: F.lower(_part(r"^([A-Za-z][A-Za-z0-9+.\-]*):")(c))
netloc = _part(r"^(?:[^:/?#]+:)?//([^/?#]*)")
raw_path = _part(r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)")
query = _part(r"^[^?#]*\?([^#]*)")
fragment = _part(r"^[^#]*#(.*)$")


def let(f: Callable[..., Column], *values: Column) -> Column:
    """``f`` of values that are computed once, however often its expression names them; plans would else repeat them each time."""
    bound = F.array(F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)]))
    return F.get(F.transform(bound, lambda s: f(*[s[f"v{k}"] for k in range(len(values))])), F.lit(0))


def path(c: Column | str) -> Column:
    """The path without parameters (what follows ``;`` in the last segment)."""
    return F.regexp_replace(raw_path(c), r";[^/]*$", "")


def hostname(c: Column | str) -> Column:
    """Lower-cased, without user, port and brackets."""
    own = F.regexp_replace(netloc(c), r"^.*@", "")
    return F.lower(F.when(own.startswith("["), F.regexp_extract(own, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(own, r"^([^:]*)", 1)))


def port(c: Column | str) -> Column:
    """The port as written, else the scheme's own, else null."""
    own = F.regexp_extract(netloc(c), r":(\d+)$", 1)
    return F.coalesce(F.when(own != "", own.try_cast("int")), F.when(scheme(c) == "http", 80), F.when(scheme(c) == "https", 443))


def without_dot_segments(p: Column) -> Column:
    """``.``, ``..`` and empty segments resolved; exactly two leading slashes stay, a trailing slash is lost."""
    parts = F.filter(F.split(p, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
    return F.concat(F.when(F.rlike(p, F.lit("^//(?!/)")), "//").otherwise("/"), F.array_join(kept, "/"))


def canonical_url(c: Column | str) -> Column:
    """The identity that keeps queries: lower-cased scheme and host, no default port, no dot segments, no parameters or fragment; null unless http(s) with a host."""
    c = F.trim(_col(c))
    host = F.rtrim(F.regexp_replace(hostname(c), r"\.+$", ""))
    shown = F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    default = F.when(scheme(c) == "http", 80).otherwise(443)
    place = F.concat(shown, F.when(port(c) != default, F.concat(F.lit(":"), port(c).cast("string"))).otherwise(""))
    own = F.when(path(c) == "", "/").otherwise(path(c))
    clean = without_dot_segments(own)
    clean = F.when(F.endswith(own, F.lit("/")) & (clean != "/"), F.concat(clean, F.lit("/"))).otherwise(clean)
    ask = F.when(query(c) != "", F.concat(F.lit("?"), query(c))).otherwise("")
    return F.when(scheme(c).isin("http", "https") & (host != ""), F.concat(scheme(c), F.lit("://"), place, clean, ask))


def _encoded(c: Column) -> Column:
    """Form encoding of a decoded value: spaces as +, the unreserved -._~ as they are."""
    plain = F.coalesce(F.try_url_decode(c), c)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def filtered_query(q: Column, dropped: Iterable[str], prefix: str | None = None) -> Column:
    """The query without the keys ``dropped`` (and those that begin with ``prefix``), encoded anew; blank values stay."""
    pairs = F.filter(F.split(q, "&"), lambda p: p != "")
    key = lambda p: F.lower(F.coalesce(F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)), p))
    gone = lambda p: key(p).isin(*dropped) | (F.startswith(key(p), F.lit(prefix)) if prefix else F.lit(False))
    one = lambda p: F.concat(_encoded(F.regexp_extract(p, "^([^=]*)", 1)), F.lit("="), _encoded(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)))
    return F.array_join(F.transform(F.filter(pairs, lambda p: ~gone(p)), one), "&")


def _joined(c: Column | str, own_path: Column, ask: Column) -> Column:
    return F.concat(scheme(c), F.lit("://"), F.lower(netloc(c)), own_path, F.when(ask != "", F.concat(F.lit("?"), ask)).otherwise(""))


def route_url(c: Column | str) -> Column:
    """The identity of a page in a crawl: slashes collapsed, tracking keys dropped, the query encoded anew, no fragment; an explicit port stays."""
    own = F.regexp_replace(F.when(path(c) == "", "/").otherwise(path(c)), "/+", "/")
    return _joined(c, own, filtered_query(query(c), TRACKING_KEYS, "utm_"))


def cache_identity(c: Column | str, default_slash: bool = True) -> Column:
    """The identity of a cached file: only cache-defeating keys dropped. ``default_slash``: an empty path is "/"."""
    own = F.when(path(c) == "", "/").otherwise(path(c)) if default_slash else path(c)
    return _joined(c, own, filtered_query(query(c), CACHE_BUSTERS))


def directory_base(c: Column | str) -> Column:
    """The directory a page stands for: a document's folder, else the path itself with a slash; no query."""
    own = canonical_url(c)
    where = path(own)
    last = F.regexp_extract(where, r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(last, r"[^.](\.[^.]+)$", 1))
    folder = F.when(F.endswith(where, F.lit("/")), where).when(suffix.isin(*DOCUMENT_SUFFIXES), F.regexp_replace(where, "[^/]*$", "")).otherwise(F.concat(where, F.lit("/")))
    return F.concat(scheme(own), F.lit("://"), netloc(own), folder)


def strip_document(c: Column | str) -> Column:
    """Cut after the path's last slash; the query goes."""
    own = F.regexp_replace(raw_path(c), "[^/]*$", "")
    return F.concat(scheme(c), F.lit("://"), netloc(c), F.when(own == "", "/").otherwise(own), F.when(fragment(c) != "", F.concat(F.lit("#"), fragment(c))).otherwise(""))


def same_origin(a: Column | str, b: Column | str) -> Column:
    """Equal scheme, host and effective port."""
    return F.struct(scheme(a), hostname(a), port(a)).eqNullSafe(F.struct(scheme(b), hostname(b), port(b)))


def unwrap_proxy(c: Column | str) -> Column:
    """The picture behind an image proxy's ``/_next/image?url=``, if that is http(s)."""
    inner = F.try_url_decode(F.regexp_extract(query(c), r"(?:^|&)url=([^&]*)", 1))
    return F.when(F.endswith(path(c), F.lit("/_next/image")) & F.rlike(inner, F.lit("(?i)^https?://")), inner)


def safe_component(c: Column) -> Column:
    """A path part that any file system takes: decoded, odd characters as _, reserved names with a leading _, long ones cut with a digest."""
    plain = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c), r"[<>:\"|?*\\/\x00-\x1f]", "_")
    plain = F.regexp_replace(plain, r"[. ]+$", "")
    safe = F.when(F.rlike(F.regexp_extract(plain, r"^([^.]*)", 1), F.lit(RESERVED_NAMES)), F.concat(F.lit("_"), plain)).otherwise(plain)
    return F.when(F.octet_length(safe) > 140, F.concat(F.substring(safe, 1, 100), F.lit("_"), F.substring(F.sha1(safe), 1, 10))).otherwise(safe)


def safe_path(c: Column | str) -> Column:
    """A relative path of safe components; ``.`` and ``..`` go, backslashes count as slashes."""
    parts = F.filter(F.split(F.replace(_col(c), F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", ".", ".."))
    return F.array_join(F.transform(parts, safe_component), "/")


def is_safe_member(c: Column | str) -> Column:
    """False for absolute paths, drive letters, parent steps and empty names."""
    own = F.replace(_col(c), F.lit("\\"), F.lit("/"))
    return ~(F.startswith(own, F.lit("/")) | F.rlike(own, F.lit(r"^[A-Za-z]:")) | F.rlike(own, F.lit(r"(^|/)\.\.(/|$)")) | (F.trim(own) == ""))


def first_subdomain(c: Column | str) -> Column:
    """The first label of a host of three or more, else ""."""
    labels = F.split(hostname(c), r"\.")
    return F.when(F.size(labels) >= 3, labels[0]).otherwise("")


def first_folder(c: Column | str) -> Column:
    """The path's first part, else ""."""
    return F.regexp_extract(path(c), "^/*([^/]*)", 1)


def output_name(c: Column | str) -> Column:
    """A name for what is mirrored from a URL: up to three path parts, unless they say nothing, with or else the subdomain, else the domain."""
    parts = F.slice(F.filter(F.split(path(c), "/"), lambda p: p != ""), 1, 3)
    full = F.array_join(F.transform(parts, safe_component), "_")
    generic = F.lower(F.regexp_replace(full, "^_+|_+$", "")).isin(*GENERIC_NAMES) | (F.length(full) <= 1)
    sub = first_subdomain(c)
    own_sub = (sub != "") & ~F.lower(sub).isin("www", "neocities")
    domain = F.regexp_extract(hostname(c), r"^([^.]*)", 1)
    return F.when((F.size(parts) > 0) & ~generic, full).when((F.size(parts) > 0) & own_sub, F.concat_ws("_", safe_component(sub), full)).when(own_sub, safe_component(sub)).when(domain != "", safe_component(domain)).otherwise("downloaded_cyoa")


def display_url(c: Column | str, n: int = 72) -> Column:
    """At most ``n`` characters of host, path and query: 62 % from the left, an ellipsis, the rest from the right."""
    own = _col(c)
    shown = F.when(netloc(own) != "", F.concat(netloc(own), path(own), F.when(query(own) != "", F.concat(F.lit("?"), query(own))).otherwise(""))).otherwise(own)
    left = max(6, int(n * 0.62))
    right = max(4, n - left - 1)
    if n < 12:
        return own
    return F.when(F.length(own) <= n, own).when(F.length(shown) <= n, shown).otherwise(F.concat(F.substring(shown, 1, left), F.lit("…"), F.right(shown, F.lit(right))))


def sheet_export(c: Column | str) -> Column:
    """A spreadsheet link as its CSV export; other links as they are."""
    own = _col(c)
    sheet = F.regexp_extract(own, r"docs\.google\.com/spreadsheets/d/([^/?#]+)", 1)
    gid = F.regexp_extract(own, r"[?&#]gid=(\d+)", 1)
    link = F.concat(F.lit("https://docs.google.com/spreadsheets/d/"), sheet, F.lit("/export?format=csv"), F.when(gid != "", F.concat(F.lit("&gid="), gid)).otherwise(""))
    return F.when(sheet != "", link).otherwise(own)


def archive_name_url(c: Column | str) -> Column:
    """The URL in an archive's file name, where ``~~~`` stands for ``://`` and ``~`` for ``/``; else null."""
    found = F.regexp_extract(_col(c), r"(?i)(https?~~~.+?)\.zip$", 1)
    url = F.replace(F.replace(found, F.lit("~~~"), F.lit("://")), F.lit("~"), F.lit("/"))
    return F.when(found != "", F.when(F.endswith(url, F.lit("/")), url).otherwise(F.concat(url, F.lit("/"))))


def resolve(base: Column, ref: Column) -> Column:
    """``ref`` as an absolute URL against ``base`` (RFC 3986), after repairs of escaped and half-written prefixes."""
    r = F.replace(F.trim(ref), F.lit("\\/"), F.lit("/"))
    r = F.regexp_replace(r, r"^(?i)(https?):/(?!/)", "$1://")
    origin = F.concat(scheme(base), F.lit("://"), netloc(base))
    tail = F.regexp_extract(r, r"([?#].*)$", 1)
    bare = F.regexp_extract(r, r"^([^?#]*)", 1)
    folder = F.regexp_replace(F.when(raw_path(base) == "", "/").otherwise(raw_path(base)), "[^/]*$", "")
    full = F.concat(folder, bare)
    normal = without_dot_segments(full)
    normal = F.when((F.endswith(bare, F.lit("/")) | F.rlike(bare, F.lit(r"(^|/)\.\.?$"))) & (normal != "/"), F.concat(normal, F.lit("/"))).otherwise(normal)
    dotted = F.rlike(full, F.lit(r"(^|/)\.\.?(/|$)"))
    rooted = F.when(F.rlike(bare, F.lit(r"(^|/)\.\.?(/|$)")), F.concat(without_dot_segments(bare), F.when(F.endswith(bare, F.lit("/")), "/").otherwise(""))).otherwise(bare)
    return (
        F.when(F.rlike(r, F.lit("^[A-Za-z][A-Za-z0-9+.\\-]*:")), r)
        .when(F.startswith(r, F.lit("//")), F.concat(scheme(base), F.lit(":"), r))
        .when(F.startswith(r, F.lit("/")), F.concat(origin, rooted, tail))
        .when(r == "", F.regexp_replace(base, "#.*$", ""))
        .when(F.startswith(r, F.lit("?")), F.concat(origin, raw_path(base), r))
        .when(F.startswith(r, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), r))
        .otherwise(F.concat(origin, F.when(dotted, normal).otherwise(full), tail))
    )


def repaired_assets(url: Column) -> Column:
    """Doubled folders of a reference collapsed: ``/assets/assets/`` and any ``/x/x/`` right after the host."""
    return F.regexp_replace(F.replace(url, F.lit("/assets/assets/"), F.lit("/assets/")), r"^([a-z]+://[^/]+)/([^/]+)/\2/", "$1/$2/")


def extension(c: Column | str) -> Column:
    """The last path segment's extension with its dot, lower-cased, else ""."""
    return F.lower(F.regexp_extract(path(c), r"[^/](\.[A-Za-z0-9]+)$", 1))


def record_file_url(base: Column, collection: Column, record: Column, name: Column) -> Column:
    """The link of a record's file, each part percent-encoded; null if the ids aren't 1 to 80 letters, digits, _ or -, or the name is empty."""
    part = lambda x: F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    collection, record, name = F.trim(collection), F.trim(record), F.trim(name)
    valid = lambda x: F.rlike(x, F.lit(r"^[A-Za-z0-9_-]{1,80}$"))
    return F.when(valid(collection) & valid(record) & (name != ""), F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/api/files/"), part(collection), F.lit("/"), part(record), F.lit("/"), part(name)))


def plan_local_paths(refs: DataFrame, start: str) -> DataFrame:
    """``refs`` (url, mime or null) with ``kind`` and ``path``: where a file of the site that starts at ``start`` is kept, before collisions are resolved.

    A file of the same host keeps its path below the start's folder, else from the root; others go to a folder of their kind under a safe name. A missing extension comes
    from the kind, and a query that means something adds a digest. The page itself is index.html, its data file project.json.
    """
    from lodestack.operators.filters import classify_kind

    kind = classify_kind("url", F.col("mime"))
    decoded = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    own, folder = decoded(path("url")), decoded(F.concat(F.regexp_replace(path(F.lit(start)), "/+$", ""), F.lit("/")))
    below = F.when(F.startswith(own, folder), F.expr("substr(own, length(folder) + 1)")).otherwise(F.regexp_replace("own", "^/+", ""))
    rows = refs.withColumns({"kind": kind, "own": own, "folder": folder}).withColumn("rel", F.regexp_replace(below, r"\\\\", "/"))
    mime = F.lower(F.coalesce("mime", F.lit("")))
    guess = lambda images, media: F.when(F.col("kind") == "images", images).when(F.col("kind") == "css", ".css").when(F.col("kind") == "js", ".js").when(F.col("kind") == "fonts", ".woff2").when(F.col("kind") == "json", ".json").when(F.col("kind") == "media", media).otherwise("")
    ext_of = lambda c: F.regexp_extract(c, r"^(?:.*/)?\.*[^/.][^/]*?(\.[^./]*)$", 1)
    ask = query(cache_identity("url"))
    digest = F.when(ask != "", F.concat(F.lit("_"), F.substring(F.sha1(ask), 1, 10))).otherwise("")

    def named(c: Column, ext: Column) -> Column:
        stem = F.regexp_replace(c, r"(?<=[^/.])\.[^./]*$", "")
        return F.concat(F.when(ext_of(c) == "", c).otherwise(stem), digest, F.when(ext_of(c) == "", ext).otherwise(ext_of(c)))

    same = named(F.col("rel"), guess(F.when(F.contains(mime, F.lit("jpeg")), ".jpg").otherwise(".png"), ""))
    base = safe_component(F.regexp_extract(path("url"), "([^/]*)$", 1))
    fallback = F.when(F.endswith("kind", F.lit("s")), F.expr("substr(kind, 1, length(kind) - 1)")).otherwise(F.col("kind"))
    base = F.when(base == "", fallback).otherwise(base)
    hint = guess(F.lit(".png"), ".bin")
    ext = F.when(ext_of(base) != "", ext_of(base)).when(hint != "", hint).otherwise(".bin")
    stem = F.when(ext_of(base) == "", base).otherwise(F.regexp_replace(base, r"(?<=[^/.])\.[^./]*$", ""))
    most = F.lit(140) - F.length(ext)
    short = F.when(F.length(stem) > most, F.concat(F.substr(stem, F.lit(1), F.greatest(most - 11, F.lit(1))), F.lit("_"), F.substring(F.sha1(base), 1, 10))).otherwise(stem)
    other = F.concat(F.when(F.col("kind").isin("html", "json"), "assets").otherwise(F.col("kind")), F.lit("/"), short, digest, ext)
    local = (
        F.when(F.col("kind") == "html", "index.html").when((F.col("kind") == "json") & F.rlike(path("url"), F.lit(r"(?i)project\.json$")), "project.json")
        .when((netloc("url") == netloc(F.lit(start))) & (F.col("rel") != ""), F.array_join(F.filter(F.split(same, "/"), lambda p: ~p.isin("", ".", "..")), "/")).otherwise(other)
    )
    return rows.withColumn("path", local).select(*refs.columns, "kind", "path")
