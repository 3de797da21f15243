"""HTML as a table of tags, read in one pass, and what pages say through them: assets, scripts, hints, viewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import fixed
from lodestack.functions.urls import canonical_url, directory_base, extension, let, resolve
from lodestack.operators.extract import css_urls, srcset_parts
from lodestack.operators.filters import is_blocked
from lodestack.operators.iterate import extract_record_urls

#: What stands between a tag's name and its end; quotes may hold ">", and one that is never closed is a letter. Possessive, so nothing is tried twice.
_INSIDE = r"""((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)"""

#: Comments; scripts and styles with their text; other tags.
_TAG = rf"""(?is)<!--.*?-->|<(script|style)\b{_INSIDE}>.*?</\1\s*>|<[a-z][a-z0-9:-]*+{_INSIDE}>"""
_ATTRIBUTE = r"""[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?"""


def _unescaped(c: Column) -> Column:
    """Text without the entities that attributes need."""
    for entity, letter in (("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(letter))
    return c


def tag_table(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep..., pos, name, attributes (array of name, value), body of a page's opening tags in order; ``body`` is a script's or style's text.

    Attributes may come in any order, in either quotes or none; names are in lower case, entities in values are resolved; what comments hold is no tag.
    """
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(html, F.lit(_TAG), F.lit(0))).alias("pos", "tag")).where(~F.startswith("tag", F.lit("<!--")))
    name = F.lower(F.regexp_extract("tag", "^<([A-Za-z][A-Za-z0-9:-]*)", 1))
    inside = F.regexp_extract("tag", rf"(?is)^<[a-z][a-z0-9:-]*+{_INSIDE}>", 1)

    def attribute(m: Column) -> Column:
        value = F.regexp_replace(F.regexp_extract(m, r"(?s)^[^=]*=\s*(.*)$", 1), r"""(?s)^(["'])(.*)\1$""", "$2")
        return F.struct(F.lower(F.regexp_extract(m, "^([^=]*?)\\s*(?:=|$)", 1)).alias("name"), _unescaped(value).alias("value"))

    body = F.when(name.isin("script", "style"), F.regexp_extract("tag", rf"(?is)^<[a-z]+{_INSIDE}>(.*)</[a-z]+\s*>$", 2))
    return rows.select(*keep, "pos", name.alias("name"), F.transform(F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), F.lit(0)), attribute).alias("attributes"), body.alias("body"))


def attr(name: str) -> Column:
    """An attribute's value, the first of several; null without it."""
    return F.get(F.filter("attributes", lambda a: a["name"] == name), F.lit(0))["value"]


def extract_tag_assets(pages: DataFrame) -> DataFrame:
    """page_id, tag, attr, raw, kind of what tags load: scripts, styles, pictures (also of srcsets and inline styles), sounds, icons, posters."""
    tags = tag_table(pages)
    name = F.col("name")
    ref = lambda tag, own, raw, kind: F.struct(F.lit(tag).alias("tag"), F.lit(own).alias("attr"), raw.alias("raw"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))
    one = lambda where, *x: F.when(where, F.array(ref(*x)))
    many = lambda where, raws, tag, own, kind: F.when(where, F.transform(raws, lambda r: ref(tag, own, r, kind(r) if callable(kind) else kind)))
    rel, use = F.coalesce(attr("rel"), F.lit("")), F.coalesce(attr("as"), F.lit(""))
    link = (
        F.when(F.rlike(rel, F.lit("(?i)stylesheet")) | (use == "style"), "css").when(F.rlike(rel, F.lit("(?i)icon")) | (use == "image"), "images").when(use == "font", "fonts")
        .when(F.rlike(rel, F.lit("(?i)modulepreload")) | (use == "script"), "js").otherwise("assets")
    )
    in_style = lambda r: F.when(F.substring(extension(r), 2, 20).isin(*fixed.FONT_EXTENSIONS), "fonts").otherwise("images")
    lists = (
        one(name == "script", "script", "src", attr("src"), "js"), one(name == "img", "img", "src", attr("src"), "images"), one(name == "source", "source", "src", attr("src"), "media"),
        one(name == "audio", "audio", "src", attr("src"), "media"), one(name == "video", "video", "src", attr("src"), "media"), one(name == "video", "video", "poster", attr("poster"), "images"),
        one(name == "link", "link", "href", attr("href"), link), many(name.isin("img", "source"), srcset_parts(attr("srcset")), "img", "srcset", "images"),
        many(name == "link", srcset_parts(attr("imagesrcset")), "link", "imagesrcset", "images"), many(name == "style", css_urls(F.col("body")), "style", "", in_style),
        many(attr("style").isNotNull(), css_urls(attr("style")), "", "style", in_style),
    )
    empty = F.array().cast("array<struct<tag:string,attr:string,raw:string,kind:string>>")
    found = tags.select("page_id", F.explode(F.concat(*[F.coalesce(x, empty) for x in lists])).alias("r")).select("page_id", "r.*")
    return found.where(F.col("raw").isNotNull() & (F.col("raw") != "")).distinct()


def extract_scripts(pages: DataFrame) -> DataFrame:
    """page_id, ord, kind, body of a page's scripts and frames: ``inline`` text, ``src`` values, sources of frames (``iframe``), and the application's
    script that an inline one loads by creating an element (``bootstrap``). ``ord`` is the tag's place in the page."""
    tags = tag_table(pages)
    script, src = F.col("name") == "script", attr("src")
    bootstrap = F.replace(F.regexp_extract("body", fixed.BOOTSTRAP_SCRIPT, 0), F.lit("\\/"), F.lit("/"))
    of = lambda where, kind, body: F.when(where, F.struct(F.lit(kind).alias("kind"), body.alias("body")))
    kinds = F.array_compact(F.array(
        of(script & src.isNull(), "inline", F.col("body")), of(script & F.coalesce(src != "", F.lit(False)), "src", F.replace(src, F.lit("\\/"), F.lit("/"))),
        of(script & F.contains("body", F.lit("document.createElement")) & (bootstrap != ""), "bootstrap", bootstrap), of((F.col("name") == "iframe") & (src != ""), "iframe", src),
    ))
    return tags.select("page_id", F.col("pos").alias("ord"), F.explode(kinds).alias("k")).select("page_id", "ord", "k.kind", "k.body")


def _first_places(found: DataFrame, *key: str) -> DataFrame:
    """Of the rows of a key the first by rank and ord."""
    rest = [c for c in found.columns if c not in key]
    return found.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("rank", "ord")).alias("r")).select(*key, "r.*")


def extract_hints(pages: DataFrame) -> DataFrame:
    """page_id, rank, ord, hint, raw, url of where a page (page_id, url, html) says that its data is, each place once, the first to try first: ``meta`` tags
    of a project, ``data`` attributes and ``link`` tags with a data file, and in inline scripts globals and calls (``script``).

    References are resolved against the page's folder; those on internal hosts other than the page's own go.
    """
    tags = tag_table(pages, keep=("page_id", "url"))
    ends = lambda c: F.rlike(c, F.lit(r"(?i)\.(?:json|txt|zip)$"))
    hint = lambda rank, name, raw: F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("hint"), raw.alias("raw"))
    data = [F.when(ends(attr(a)), hint(1, "data", attr(a))) for a in ("data-project", "data-src", "data-url", "data-file")]
    single = F.array_compact(F.array(
        F.when((F.col("name") == "meta") & F.rlike(attr("name"), F.lit("(?i)project|cyoa")), hint(0, "meta", attr("content"))), *data,
        F.when((F.col("name") == "link") & ends(attr("href")), hint(2, "link", attr("href"))),
    ))
    calls = F.when((F.col("name") == "script") & attr("src").isNull(), F.regexp_extract_all("body", F.lit(fixed.SCRIPT_HINT), F.lit(0)))
    raw = lambda m: F.regexp_extract(m, r"""["']([^"']+)["']$""", 1)
    in_script = F.coalesce(F.transform(calls, lambda m: hint(3, "script", raw(m))), F.array().cast("array<struct<rank:int,hint:string,raw:string>>"))
    rows = tags.select("page_id", "url", "pos", F.posexplode(F.concat(single, in_script)).alias("k", "h")).select("page_id", F.col("url").alias("page_url"), "h.rank", F.struct("pos", "k").alias("ord"), "h.hint", "h.raw")
    rows = rows.withColumn("raw", F.regexp_replace(F.replace("raw", F.lit("\\/"), F.lit("/")), r"""^[\s"']+|[\s"']+$""", "")).where((F.col("raw") != "") & ~F.rlike("raw", F.lit("^(data:|javascript:|#)")))
    found = F.array(let(resolve, let(directory_base, F.col("page_url")), F.col("raw")))
    rows = rows.select("page_id", "rank", "ord", "hint", "raw", F.explode(F.filter(found, lambda url: ~is_blocked(url, F.col("page_url")))).alias("url"))
    return _first_places(rows, "page_id", "url").select("page_id", "rank", "ord", "hint", "raw", "url")


def viewer_candidates(pages: DataFrame) -> DataFrame:
    """page_id, method, rank, ord, url of what a catalogue page (page_id, url, html) embeds: frames, links in embedded JSON at any depth, link fields in
    scripts, og:url, canonical link."""
    tags = tag_table(pages, keep=("page_id", "url")).withColumnRenamed("url", "page_url")
    item = lambda rank, method, raw: F.struct(F.lit(rank).alias("rank"), F.lit(method).alias("method"), raw.alias("raw"))
    script = F.col("name") == "script"
    named = lambda f: F.regexp_extract_all("body", F.lit(rf"""(?i)["']{f}["']\s*:\s*["'](https?://[^"']+)["']"""), F.lit(1))
    labelled = lambda f: lambda r: item(2, f"script field {f}", r)
    fields = [F.transform(F.when(script, named(f)), labelled(f)) for f in fixed.RECORD_FIELDS]
    single = F.array_compact(F.array(
        F.when(F.col("name") == "iframe", item(0, "iframe", F.trim(attr("src")))), F.when((F.col("name") == "meta") & (attr("property") == "og:url"), item(3, "og", F.trim(attr("content")))),
        F.when((F.col("name") == "link") & F.contains(attr("rel"), F.lit("canonical")), item(4, "canonical", F.trim(attr("href")))),
    ))
    empty = F.array().cast("array<struct<rank:int,method:string,raw:string>>")
    found = tags.select("page_id", "page_url", "pos", F.posexplode(F.concat(single, *[F.coalesce(x, empty) for x in fields])).alias("k", "c")).select("page_id", "page_url", F.struct("pos", "k").alias("ord"), "c.*")
    data = script & (F.lower(F.coalesce(attr("type"), F.lit(""))).isin("application/json", "application/ld+json") | attr("id").isin("__NEXT_DATA__", "__NUXT__"))
    records = tags.where(data).select(F.struct("page_id", "page_url", "pos").alias("record_id"), F.try_parse_json("body").alias("payload"))
    inner = extract_record_urls(records).select("record_id.page_id", "record_id.page_url", F.struct("record_id.pos", F.lit(0).alias("k")).alias("ord"), F.lit(1).alias("rank"), F.lit("json").alias("method"), "raw")
    every = found.unionByName(inner).where(F.col("raw") != "").withColumn("raw", F.replace("raw", F.lit("\\/"), F.lit("/")))
    url = let(lambda base, raw: let(canonical_url, resolve(base, raw)), F.col("page_url"), F.col("raw"))
    return every.select("page_id", "method", "rank", "ord", F.explode(F.array_compact(F.array(url))).alias("url"))
