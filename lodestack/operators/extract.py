"""Generators: one page or file in, many references out. Each rule is one regular expression over the text, exploded; rules are put together by a union."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import fixed
from lodestack.functions.scalars import is_project_text
from lodestack.functions.urls import extension, hostname, let, netloc, path, resolve, route_url, scheme
from lodestack.operators.filters import is_blocked

#: References that lead nowhere.
NO_LINK = r"(?i)^(#|javascript:|mailto:|tel:|data:)"

_IMG = "|".join(fixed.IMAGE_EXTENSIONS)


def matches(df: DataFrame, text: str, pattern: str, group: int = 1, *, keep: tuple[str, ...] = (), as_: str = "raw") -> DataFrame:
    """A row (keep..., ord, raw) per match of ``pattern`` in the column ``text``, in the order of the text."""
    return df.select(*keep, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), group)).alias("ord", as_))


def union_refs(*tables: DataFrame) -> DataFrame:
    """All rows of the extractors, each once."""
    return reduce(DataFrame.unionByName, tables).distinct()


def keep_first(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """Of the rows of a key the first in ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def extract_links(pages: DataFrame) -> DataFrame:
    """page_id, page_url, ord, raw, url of every ``<a href>`` that leads to a page; ``url`` is the route identity, malformed ones go."""
    raw = matches(pages, "html", r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']""", keep=("page_id", "url")).withColumnRenamed("url", "page_url")
    raw = raw.withColumn("raw", F.trim("raw")).where((F.col("raw") != "") & ~F.rlike("raw", F.lit(NO_LINK)))
    found = raw.withColumn("url", route_url(resolve(F.col("page_url"), F.col("raw"))))
    return found.where(F.rlike("url", F.lit(r"^https?://[^\[\]/]+(/|$)")))


def srcset_parts(c: Column) -> Column:
    """The candidates of a srcset; commas in ``data:`` URIs don't separate, and those URIs are left out."""
    parts = F.regexp_extract_all(c, F.lit(r"(?:^|,)\s*((?:data:\S+|[^\s,]+))(?:\s+[^,]*)?"), F.lit(1))
    return F.filter(parts, lambda x: ~F.startswith(x, F.lit("data:")))


def css_urls(c: Column) -> Column:
    """The references of ``url()`` in style text."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"""(?i)url\(\s*["']?([^"')]+?)["']?\s*\)"""), F.lit(1)), lambda x: ~F.rlike(x, F.lit("(?i)^(data:|#)")))


def split_srcset(df: DataFrame, column: str = "srcset") -> DataFrame:
    """``df`` with a row (ord, raw) per candidate of a srcset."""
    return df.select("*", F.posexplode(srcset_parts(F.col(column))).alias("ord", "raw"))


def extract_css_refs(files: DataFrame, text: str = "text", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """keep..., raw, via of ``url(...)`` and ``@import`` in style text."""
    urls = matches(files, text, r"""(?i)url\(\s*["']?([^"')]+?)["']?\s*\)""", keep=keep).withColumn("via", F.lit("url"))
    imports = matches(files, text, r"""(?i)@import\s+(?:url\(\s*)?["']([^"']+)["']""", keep=keep).withColumn("via", F.lit("import"))
    return union_refs(urls.drop("ord"), imports.drop("ord")).where(~F.rlike("raw", F.lit("(?i)^(data:|#)")))


def _image_like(c: Column) -> Column:
    return F.substring(extension(c), 2, 20).isin(*fixed.IMAGE_EXTENSIONS)


def _repaired_link(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"[.,;:)\]}]+$", ""), r"(?i)^(https?):/(?!/)", "$1://")


def image_refs_of(text: Column, bare: Column | bool = False) -> Column:
    """The pictures that a rich-text value names, each once: the value itself, if it is one link; else those in picture tags, style backgrounds, and links in
    the prose with a picture's extension; else, where ``bare`` allows it, the value as a path with such an extension."""
    t = F.trim(F.coalesce(text, F.lit("")))
    bare = F.lit(bare) if isinstance(bare, bool) else bare
    tag = r"""(?is)<(?:img|source)[^>]+(?:src|srcset)\s*=\s*["']([^"']+)["']"""
    style = r"""(?is)(?:background(?:-image)?|src)\s*:\s*url\(\s*["']?([^"')\s]+)"""
    named = F.concat(F.regexp_extract_all(t, F.lit(tag), 1), F.regexp_extract_all(t, F.lit(style), 1))
    named = F.transform(named, lambda r: F.when(F.contains(r, F.lit(",")) & F.contains(r, F.lit(" ")), F.regexp_extract(r, r"^\s*([^\s,]+)", 1)).otherwise(r))
    named = F.transform(named, lambda r: _repaired_link(F.when(F.startswith(r, F.lit("//")), F.concat(F.lit("https:"), r)).otherwise(r)))
    prose = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"""(?i)(?<![A-Za-z0-9])(https?:/{1,2}[^\s"'<>]+)"""), 1), _repaired_link), _image_like)
    good = F.filter(F.concat(named, prose), lambda r: (r != "") & ~F.rlike(r, F.lit("^(data:|javascript:|#)")))
    alone = F.when(bare & ~F.rlike(t, F.lit("[<>]")) & F.coalesce(_image_like(_repaired_link(t)), F.lit(False)), F.array(t)).otherwise(F.array().cast("array<string>"))
    return (
        F.when((t == "") | F.startswith(t, F.lit("data:")), F.array().cast("array<string>"))
        .when(F.rlike(t, F.lit(r"""(?i)^https?:/{1,2}[^\s"'<>]+$""")), F.array(_repaired_link(t)))
        .when(F.rlike(t, F.lit(r"""^//[^\s"'<>]+$""")), F.array(_repaired_link(F.concat(F.lit("https:"), t))))
        .when(F.size(good) > 0, F.array_distinct(good)).otherwise(alone)
    )


def markdown_images(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?i)!\[[^\]]*\]\(([^)]+\.(?:png|jpg|jpeg|webp|gif|svg|avif))\)"), 1)


def extract_image_refs(df: DataFrame, column: str, keep: tuple[str, ...] = (), bare: bool = False) -> DataFrame:
    """keep..., raw of pictures named in rich text (``image_refs_of``) and in Markdown, each once a row of ``df``."""
    refs = F.array_distinct(F.concat(image_refs_of(F.col(column), bare), markdown_images(F.col(column))))
    return df.select(*keep, F.explode(refs).alias("raw"))


def extract_media_ids(df: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep..., url (a watch link) of 11-character video ids in calls and links."""
    rules = (r"""playVideo\(\s*["']([\w-]{11})["']""", r"(?i)(?:youtube(?:-nocookie)?\.com/(?:watch\?(?:[^\s\"']*&)?v=|embed/|shorts/)|youtu\.be/)([\w-]{11})(?![\w-])")
    ids = union_refs(*[matches(df, column, p, keep=keep).drop("ord") for p in rules])
    return ids.select(*keep, F.concat(F.lit("https://www.youtube.com/watch?v="), "raw").alias("url"))


def extract_candidates(df: DataFrame, most: int = 80) -> DataFrame:
    """url, rank, raw, found of data files named in scripts: ``df`` is (url, text). The first ``most`` different ones of a text, in the order of rules and text.

    Quoted names that end in .json, .txt or .zip, or in ``project`` below a folder; what is opened by GET; calls that load such a file. Slashes may be
    escaped. Files on internal hosts other than the text's own go.
    """
    quoted = F.regexp_extract_all("text", F.lit(r"""(["'])([^"']+)\1"""), F.lit(2))
    own = lambda c: F.lower(path(c))
    data = lambda c: F.rlike(own(c), F.lit(r"[^/]\.(?:json|txt|zip)$")) | F.rlike(own(c), F.lit(r"/project(?:\.[a-z0-9]+)?$"))
    rules = [F.filter(quoted, data), *[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in fixed.OPENED_FILES]]
    found = df.select("url", F.posexplode(F.concat(*rules)).alias("ord", "raw"))
    found = found.withColumn("raw", F.regexp_replace(F.replace("raw", F.lit("\\/"), F.lit("/")), r"""^[\s"']+|[\s"']+$""", "")).where((F.col("raw") != "") & ~F.rlike("raw", F.lit("^(data:|javascript:|#)")))
    places = F.array(F.when(F.rlike("raw", F.lit("^https?://")), F.col("raw")).otherwise(let(resolve, F.col("url"), F.col("raw"))))
    found = found.select("url", "ord", "raw", F.explode(F.filter(places, lambda x: ~is_blocked(x, F.col("url")))).alias("found"))
    first = found.groupBy("url", "found").agg(F.min(F.struct("ord", "raw")).alias("f")).select("url", "found", "f.*")
    rank = F.row_number().over(Window.partitionBy("url").orderBy("ord"))
    return first.select("url", rank.alias("rank"), "raw", "found").where(F.col("rank") <= most)


def default_candidates(urls: DataFrame, column: str = "url") -> DataFrame:
    """url, rank (from 0), candidate: where a page's data may lie, the likeliest first, each place once.

    In order: the usual names in the page's folder and in those above it; in the usual folders there; less usual names; less usual folders; what
    known hosts do; capital spellings. Everything is an expression over the URL, so no rule table is joined, however many pages there are.
    """
    base = urls.select(F.col(column).alias("url")).where("url is not null").distinct()
    parts = F.filter(F.split(path(F.col("url")), "/"), lambda p: p != "")
    last = F.coalesce(F.try_element_at("all_parts", F.lit(-1)), F.lit(""))
    a_file = (F.size("all_parts") > 0) & F.contains(last, F.lit(".")) & ~F.startswith(last, F.lit("."))
    origin = F.concat(scheme("url"), F.lit("://"), netloc("url"))
    folder = F.regexp_replace(F.when(path(F.col("url")) == "", "/").otherwise(path(F.col("url"))), "[^/]*$", "")
    rows = base.withColumns({"all_parts": parts, "origin": origin, "host": hostname("url"), "own": F.concat(origin, folder)})
    rows = rows.withColumn("parts", F.when(a_file, F.slice("all_parts", F.lit(1), F.size("all_parts") - 1)).otherwise(F.col("all_parts")))
    up_to = lambda n: F.concat("origin", F.lit("/"), F.array_join(F.slice("parts", F.lit(1), n), "/"), F.lit("/"))
    above = F.when(F.size("parts") > 0, F.transform(F.sequence(F.size("parts"), F.lit(1), F.lit(-1)), up_to)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("above", F.concat(above, F.array(F.concat("origin", F.lit("/")))))
    one, table = F.array("own"), lambda names: F.array(*map(F.lit, names))

    def each(bases: Column, names: tuple[str, ...]) -> Column:
        return F.flatten(F.transform(bases, lambda b: F.transform(table(names), lambda n: F.concat(b, n))))

    inside = lambda folders, names: tuple(f + n for f in folders for n in names)
    site, first = F.array(F.concat(F.lit("https://"), "host", F.lit("/"))), F.concat(F.lit("https://"), "host", F.lit("/"), F.get("parts", F.lit(0)), F.lit("/"))
    none = F.array().cast("array<string>")
    its_first = F.when(F.size("parts") > 0, each(F.array(first), fixed.DATA_NAMES)).otherwise(none)
    by_name = lambda *places: tuple(p + n for n in fixed.DATA_NAMES for p in places)
    github = F.flatten(F.transform(table(fixed.DATA_NAMES), lambda n: F.array(F.concat("own", F.lit("docs/"), n), F.concat("own", F.lit("gh-pages/"), n), F.concat(site[0], n))))
    cafe = F.flatten(F.transform(table(fixed.DATA_NAMES), lambda n: F.when(F.size("parts") > 0, F.array(F.concat("own", n), F.concat(first, n))).otherwise(F.array(F.concat("own", n)))))
    is_host = lambda h: (F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))
    hosted = (
        F.when(is_host("neocities.org"), each(site, by_name("", "cyoa/", "game/"))).when(F.endswith("host", F.lit(".github.io")), F.concat(github, its_first))
        .when(F.contains("host", F.lit("itch.io")), each(one, by_name("game/", "public/"))).when(is_host("cyoa.cafe"), cafe).otherwise(none)
    )
    places = F.concat(
        each(one, fixed.DATA_NAMES), each(F.col("above"), fixed.DATA_NAMES), each(one, inside(fixed.DATA_FOLDERS, fixed.DATA_NAMES)), each(F.slice("above", F.lit(1), F.lit(3)), inside(fixed.DATA_FOLDERS, fixed.DATA_NAMES)),
        each(one, fixed.OTHER_DATA_NAMES), each(F.slice("above", F.lit(1), F.lit(1)), fixed.OTHER_DATA_NAMES), each(one, inside(fixed.OTHER_DATA_FOLDERS, fixed.DATA_NAMES)),
        each(one, inside(("", *fixed.DATA_FOLDERS), fixed.OTHER_DATA_NAMES)), hosted, each(F.concat(one, F.slice("above", F.lit(1), F.lit(2))), ("Project.json", "PROJECT.JSON")),
    )
    return rows.select("url", F.posexplode(F.array_distinct(places)).alias("rank", "candidate"))


def asset_folder_candidates(df: DataFrame) -> DataFrame:
    """``df`` (raw, kind) with a row (rank, candidate) per place to try: a link as it is; else the name, and below the folders of its kind, each also
    percent-encoded and once. With ``base_url`` candidates are resolved against it. Empty and inlined values have none."""
    raw = F.trim(F.coalesce("raw", F.lit("")))
    name = F.regexp_replace(raw, "^/+", "")
    encoded = F.url_encode(name)
    for code, letter in (("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(letter))
    below = F.when(F.startswith(name, F.lit("dist/")), F.array().cast("array<string>")).when(F.col("kind") == "images", F.array(*map(F.lit, fixed.PICTURE_FOLDERS))).otherwise(F.array(*map(F.lit, fixed.SOUND_FOLDERS)))
    places = F.flatten(F.transform(F.concat(F.array(F.lit("")), below), lambda f: F.array(F.concat(f, name), F.concat(f, encoded))))
    places = F.transform(places, lambda p: resolve(F.col("base_url"), p)) if "base_url" in df.columns else places
    none = (raw == "") | F.startswith(raw, F.lit("data:"))
    found = F.when(none, F.array().cast("array<string>")).when(F.rlike(raw, F.lit("(?i)^https?://")), F.array(raw)).otherwise(F.array_distinct(places))
    return df.select("*", F.posexplode(found).alias("rank", "candidate"))


def fallback_candidates(failed: DataFrame) -> DataFrame:
    """page_url, url, rank, candidate of other places for a reference that failed: ``failed`` is (page_url, url, kind), ``kind`` css where a style names it; ``raw``,
    the reference as it is written, if known. Same origin only.

    In order: of a style below the page its file name right below the page, of others a relative reference from the page's root; the page's own path before
    ``/assets/``; ``/assets/`` before a script at the root.
    """
    origin = F.concat(scheme("url"), F.lit("://"), netloc("url"))
    start = F.regexp_replace(path("page_url"), "/+$", "")
    own = path("url")
    below = (start != "") & F.startswith(own, F.concat(start, F.lit("/")))
    deeper = below & F.contains(F.substring(own, F.length(start) + 2, F.length(own)), F.lit("/"))
    name = F.regexp_extract(own, "([^/]+)$", 1)
    relative = F.when(~F.rlike("raw", F.lit("^(?:http|//|data:|#)")), resolve(F.col("page_url"), F.col("raw"))) if "raw" in failed.columns else F.lit(None).cast("string")
    rules = F.array(
        F.struct(F.lit(0).alias("rank"), F.when((F.col("kind") == "css") & deeper & (name != ""), F.concat(origin, start, F.lit("/"), name)).otherwise(relative).alias("candidate")),
        F.struct(F.lit(1).alias("rank"), F.when(F.startswith(own, F.lit("/assets/")) & (start != "") & ~below, F.concat(origin, start, own)).alias("candidate")),
        F.struct(F.lit(2).alias("rank"), F.when(F.rlike(own, F.lit(r"(?i)^/[^/]*\.m?js$")), F.concat(origin, F.lit("/assets"), own)).alias("candidate")),
    )
    found = failed.where((F.lower(netloc("page_url")) == F.lower(netloc("url"))) & (scheme("page_url") == scheme("url"))).select("page_url", "url", F.explode(rules).alias("r")).select("page_url", "url", "r.rank", "r.candidate")
    return found.where(F.col("candidate").isNotNull() & (F.col("candidate") != F.col("url")))


def explode_record_files(df: DataFrame) -> DataFrame:
    """record, kind, name, local of a catalogue record's picture files (pages, preview, cover): by name once, numbered in order."""
    kinds = (("page", "pages"), ("preview", "previews"), ("cover", "covers"))
    tables = [df.select("record", F.lit(k).alias("kind"), F.lit(r).alias("rank"), F.posexplode(c).alias("ord", "name")) for r, (k, c) in enumerate(kinds)]
    rows = reduce(DataFrame.unionByName, tables).where(F.rlike("name", F.lit(rf"(?i)\.(?:{_IMG})$")))
    rows = keep_first(rows, ["record", "name"], ["rank", "ord"])
    n = F.row_number().over(Window.partitionBy("record").orderBy("rank", "ord"))
    return rows.select("record", "kind", "name", F.concat(F.format_string("%04d_", n), "name").alias("local"))


def extract_fonts(projects: DataFrame, pages: DataFrame | None = None, styles: DataFrame | None = None) -> DataFrame:
    """owner, url, description of the fonts that projects (owner, base_url, text), their pages (owner, base_url, html) and styles need; of a font its first description.

    ``styles`` (url, text) are style files at hand: those that a project or page links and those of the font service (by the link that a family's name stands
    for) are searched for fonts. In order: links in the project, style text in it, its own styles, style functions in it, the page's links, its inline styles, font services.
    """
    ends = rf"(?i)\.(?:{'|'.join(fixed.FONT_EXTENSIONS)})$"
    service = r"""https://fonts\.googleapis\.com/css[^\s"'<>]*"""
    urls_in = r"""url\(["']?([^"')\s]+)["']?\)"""
    rows = projects.select("owner", "base_url", F.replace("text", F.lit("\\/"), F.lit("/")).alias("text"))
    folder = F.concat(F.regexp_replace("base_url", "/+$", ""), F.lit("/"))
    keep = ("owner", "base_url")
    found: list[DataFrame] = []

    def add(df: DataFrame, description: Column | str) -> None:
        shown = F.lit(description) if isinstance(description, str) else description
        found.append(df.select("owner", F.trim("found").alias("url"), shown.alias("description"), F.lit(len(found)).alias("rank"), "ord"))

    def fonts_in(df: DataFrame, text: str, base: Column, whole: bool = False) -> DataFrame:
        own = matches(df, text, urls_in, keep=keep if "source" not in df.columns else (*keep, "source"))
        bare = F.col("raw") if whole else F.regexp_replace("raw", r"\?.*$", "")
        own = own.where(F.rlike(bare, F.lit(ends)) & ~F.startswith("raw", F.lit("data:")))
        return own.withColumn("found", F.when(F.rlike("raw", F.lit("^https?://")), F.col("raw")).otherwise(resolve(base, F.col("raw"))))

    add(matches(rows, "text", rf"""(?i)https?://[^\s"'<>]+\.(?:woff2?|ttf|otf|eot)[^\s"'<>]*""", 0, keep=keep).withColumn("found", F.col("raw")), "project, link")
    services = matches(rows, "text", service, 0, keep=keep).select(*keep, F.col("raw").alias("url"))
    config = rows.select(*keep, F.try_parse_json("text").alias("v")).where("v is not null")
    fields = font_fields(config)
    families = fields.where("field = 'googlefonts'")
    named = F.concat(F.lit("https://fonts.googleapis.com/css2?family="), F.replace(F.replace(F.url_encode(F.replace("value", F.lit("+"), F.lit(" "))), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), F.lit(":wght@400;600;700&display=swap"))
    is_link = F.rlike("value", F.lit("^https?://"))
    at_service = F.contains("value", F.lit("fonts.googleapis.com"))
    services = services.unionByName(families.where(~is_link).select(*keep, named.alias("url"))).unionByName(families.where(is_link & at_service).select(*keep, F.col("value").alias("url")))
    linked = families.where(is_link & ~at_service).select(*keep, F.col("value").alias("url")).unionByName(fields.where("field = 'customfonts'").select(*keep, F.when(is_link, F.col("value")).otherwise(resolve(folder, F.col("value"))).alias("url")))
    css = fields.where("field = 'customcss'").select(*keep, F.col("value").alias("css"))
    add(fonts_in(css, "css", F.col("base_url")), "project, style text")
    if styles is not None:
        own = linked.distinct().join(styles.select("url", F.col("text").alias("css")), "url").withColumnRenamed("url", "source")
        add(fonts_in(own, "css", F.col("source")), "project, style text")
        services = services.unionByName(matches(own, "css", service, 0, keep=keep).select(*keep, F.col("raw").alias("url")))
    add(fonts_in(rows, "text", folder, True), "project, style function")
    if pages is not None:
        tags = matches(pages, "html", r"(?is)(<link\s[^>]*>)", keep=keep, as_="tag").where(F.rlike("tag", F.lit(r"""(?is)\brel\s*=\s*["'][^"']*stylesheet""")))
        tags = tags.withColumn("raw", F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1))
        add(tags.where(F.rlike("raw", F.lit(ends)) & ~F.contains("raw", F.lit("fonts.googleapis.com"))).withColumn("found", F.when(F.startswith("raw", F.lit("http")), F.col("raw")).otherwise(resolve(F.col("base_url"), F.col("raw")))), "page, link")
        services = services.unionByName(tags.where(F.contains("raw", F.lit("fonts.googleapis.com"))).select(*keep, F.col("raw").alias("url")))
        blocks = matches(pages, "html", r"(?is)<style[^>]*>(.*?)</style>", keep=keep, as_="css").drop("ord")
        add(fonts_in(blocks, "css", F.col("base_url"), True), "page, inline style")
    if styles is not None:
        own = services.distinct().join(styles.select("url", F.col("text").alias("css")), "url").withColumnRenamed("url", "source")
        own = matches(own, "css", r"url\(([^)]+)\)", keep=("owner", "source")).withColumn("found", F.regexp_replace("raw", "^[\"']+|[\"']+$", ""))
        add(own.where(F.rlike("found", F.lit(ends))), F.concat(F.lit("font service ("), "source", F.lit(")")))
    every = reduce(DataFrame.unionByName, found).where("url <> ''")
    return keep_first(every, ["owner", "url"], ["rank", "description", "ord"]).select("owner", "url", "description")


def font_fields(config: DataFrame) -> DataFrame:
    """owner, base_url, field (googlefonts, customfonts, customcss), value of font settings at any depth of project JSON (owner, base_url, v)."""
    from lodestack.operators.iterate import nested_levels

    out: list[DataFrame] = []
    for level in nested_levels(config, ("owner", "base_url"), "v"):
        entry = F.explode(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))).alias("e")
        own = level.select("owner", "base_url", entry).select("owner", "base_url", F.lower("e.key").alias("field"), F.col("e.value").alias("value")).where(F.col("field").isin("googlefonts", "customfonts", "customcss"))
        listed = F.coalesce(F.try_variant_get("value", "$", "array<variant>"), F.array("value"))
        items = own.select("owner", "base_url", "field", F.explode(listed).alias("x"))
        first = lambda *names: F.coalesce(*[F.when(c != "", c) for c in (F.try_variant_get("x", f"$.{n}", "string") for n in names)])
        text = F.when(F.schema_of_variant("x") == "STRING", F.try_variant_get("x", "$", "string"))
        named = F.when(F.col("field") == "googlefonts", first("family", "name", "fontFamily")).when(F.col("field") == "customfonts", first("url", "href", "src", "css"))
        out.append(items.select("owner", "base_url", "field", F.trim(F.coalesce(text, named)).alias("value")).where("value is not null and value <> ''"))
    return reduce(DataFrame.unionByName, out) if out else config.select("owner", "base_url", F.lit("").alias("field"), F.lit("").alias("value")).limit(0)


#: How far before a project's name its braces may lie, and the least length of a block around one.
NEAR, LEAST_BLOCK = 250_000, 100

#: Bytes of blocks that are handed on at once.
BLOCK_BYTES = 4 << 20

_TOKEN = re.compile(r"""\\.|["'{}]""", re.S)


class Braces:
    """The pairs of braces outside of quotes in a text, by where they open: ``start``, ``end`` (after the closing one; -1 for none), ``parent`` (the pair
    around it; -1 for none). One pass, in which each of the ascending ``places`` also learns the last pair that is open there (``around``)."""

    def __init__(self, text: str, places: list[int]) -> None:
        self.start, self.end, self.parent, self.around = [], [], [], []
        stack, quote, asked = [], "", 0
        for m in _TOKEN.finditer(text):
            c = m.group()
            while asked < len(places) and places[asked] <= m.start():
                self.around.append(stack[-1] if stack else -1)
                asked += 1
            if c[0] == "\\":
                continue
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == "{":
                self.start.append(m.start())
                self.end.append(-1)
                self.parent.append(stack[-1] if stack else -1)
                stack.append(len(self.start) - 1)
            elif stack:
                self.end[stack.pop()] = m.end()
        self.around += [stack[-1] if stack else -1] * (len(places) - asked)


def project_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the balanced braces that a marker or a project's name points at, in the order to try them, each once, in time linear in the text: braces
    after a marker, then those around a name, the innermost first."""
    names = sorted((m.start(), k) for k, pattern in enumerate(fixed.EMBEDDED_NAMES) for m in re.finditer(pattern, text))
    braces = Braces(text, [at for at, _ in names])
    number = {at: k for k, at in enumerate(braces.start)}
    found: dict[int, None] = {}
    for pattern, inside in [(re.escape(m), m.endswith("{")) for m in fixed.EMBEDDED_MARKERS] + [(p, True) for p in fixed.EMBEDDED_PATTERNS]:
        for m in re.finditer(pattern, text):
            k = number.get(m.end() - 1 if inside else text.find("{", m.start()), -1)
            if k >= 0 and braces.end[k] > 0:
                found.setdefault(k)
    reached: dict[int, int] = {}  # by pair the least place from which the pairs around it were walked
    for (at, _), k in sorted(zip(names, braces.around), key=lambda x: (x[0][1], x[0][0])):
        while k >= 0 and braces.start[k] >= at - NEAR and reached.get(k, at + 1) > at:
            reached[k] = at
            if braces.end[k] - braces.start[k] > LEAST_BLOCK:
                found.setdefault(k)
            k = braces.parent[k]
    return [(braces.start[k], braces.end[k]) for k in found]


def embedded_blocks(files: DataFrame) -> DataFrame:
    """path, rank, block: texts in balanced braces in scripts (path, text) that a marker or a project's name points at, in the order to try them; each block once."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, size = [], 0
            for path_, text in zip(pdf["path"], pdf["text"]):
                for rank, (start, end) in enumerate(project_blocks(text) if text and "{" in text else ()):
                    out.append((path_, rank, text[start:end]))
                    size += end - start
                    if size > BLOCK_BYTES:
                        yield pd.DataFrame(out, columns=["path", "rank", "block"])
                        out, size = [], 0
            yield pd.DataFrame(out, columns=["path", "rank", "block"])

    return files.select("path", "text").mapInPandas(cut, "path string, rank int, block string")


def extract_embedded(files: DataFrame) -> DataFrame:
    """path, payload of the project that a script (path, text) holds: the first of ``embedded_blocks`` that looks like one."""
    good = embedded_blocks(files).where(is_project_text(F.col("block")))
    return good.groupBy("path").agg(F.min_by("block", "rank").alias("payload"))
