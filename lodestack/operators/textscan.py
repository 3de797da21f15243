"""Assets named in the text of scripts, styles, JSON and HTML: one extractor a spelling, put together by a union; what a file defines is joined with its uses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import fixed
from lodestack.functions.urls import let, netloc, path, repaired_assets, resolve, scheme
from lodestack.operators.extract import image_refs_of, matches

_ASK = r"""(?:\?[^\s"'`<>]*+)?"""
_ASSET = rf"\.(?:{'|'.join(fixed.TEXT_ASSET_EXTENSIONS)}){_ASK}"
_CHUNK = rf"\.m?js{_ASK}"
_MANIFEST = rf"(?i)\.(?:{'|'.join((*fixed.TEXT_ASSET_EXTENSIONS, 'js', 'mjs'))})$"
_NAME = r"[A-Za-z_$][\w$]*"
_IMPORT_META = r"\s*,\s*import\.meta\.url\b"
_MIME_LIST = r"(?i)^(?:application|text|image|audio|video|font)/.*,"


def _is(kind: str) -> Column:
    return F.rlike("path", F.lit({"js": r"(?i)\.[mc]?js$", "json": r"(?i)\.json$", "html": r"(?i)\.html?$", "markup": r"(?i)\.(?:html?|svg)$"}[kind]))


def _pairs(df: DataFrame, text: str, pattern: str, *names: str, keep: tuple[str, ...]) -> DataFrame:
    """keep..., ord and a column for each group of each match."""
    groups = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k + 1)).alias(n) for k, n in enumerate(names)])
    return df.select(*keep, F.posexplode(groups).alias("ord", "m")).select(*keep, "ord", *[f"m.{n}" for n in names])


def _by_file(url: Column, base: Column, raw: Column, js: Column) -> Column:
    """A reference as the file itself means it: against the file's folder, or the site's root; a doubled folder of the page's path counts once."""
    seg = F.regexp_replace(path(base), "^/+|/+$", "")
    twice = F.concat(F.lit("/"), seg, F.lit("/"), seg, F.lit("/"))
    once = lambda near, twice, seg: repaired_assets(F.when((seg != "") & F.contains(path(near), twice), F.replace(near, twice, F.concat(F.lit("/"), seg, F.lit("/")))).otherwise(near))
    good = (raw != "") & (F.length(raw) <= 400) & ~F.rlike(raw, F.lit(r"^(?:data:|#|javascript:|mailto:|http://www\.w3\.org|blob:)")) & ~F.rlike(raw, F.lit(_MIME_LIST))
    code = js & (F.contains(raw, F.lit("`")) | F.contains(raw, F.lit("import.meta")) | F.rlike(raw, F.lit(rf"{_NAME}\s*\(")))
    root = F.concat(scheme(base), F.lit("://"), netloc(base), raw)
    own = F.when(F.rlike(raw, F.lit("^https?://")), raw).when(F.startswith(raw, F.lit("//")), F.concat(F.lit("https:"), raw)).when(F.startswith(raw, F.lit("/")), root)
    own = own.when(F.rlike(raw, F.lit(r"^\.\.?/")), let(once, resolve(url, raw), twice, seg)).otherwise(resolve(url, raw))
    return F.when(good & ~code, own)


def _found(how: Column, url: Column, base: Column, raw: Column, js: Column) -> Column:
    """A reference (trimmed) as its rule reads it: ``file``; ``page``, as the page that runs a script means it; ``written``: what doesn't say in a script where
    it is relative to is the page's, else the file's; ``chunk``: one of a preload list, in the site's assets; ``beside``: against the page's own address."""
    of_page = (how == "page") | ((how == "written") & js & ~F.rlike(raw, F.lit(r"^(?:\.\.?/|/|https?://)")))
    chunk = (how == "chunk") & ~F.startswith(raw, F.lit("./"))
    return (
        F.when(of_page, resolve(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/")), raw)).when(chunk, F.concat(scheme(base), F.lit("://"), netloc(base), F.lit("/assets/"), raw))
        .when(how == "beside", resolve(base, raw)).otherwise(_by_file(url, base, raw, js))
    )


def script_bases(files: DataFrame) -> DataFrame:
    """path, name, base of variables that a script derives from its own place: ``v = new URL('../', currentScript.src)``; of several the last counts."""
    pattern = rf"""(?i)\b({_NAME})\s*=\s*new\s+URL\(\s*["']([^"']+)["']\s*,\s*(?:document\.)?currentScript\.src\s*\)"""
    found = _pairs(files.where(_is("js")), "text", pattern, "name", "at", keep=("path", "url"))
    return found.groupBy("path", "name").agg(F.max_by(resolve(F.col("url"), F.col("at")), "ord").alias("base"))


def infer_prefixed_assets(files: DataFrame) -> DataFrame:
    """path, item, raw of pictures in a declared list that the file joins to a declared folder: ``const imageSrc='image/'`` and ``imagesToLoad=[...]``, both
    names with img, image or asset in them."""
    named = F.rlike("name", F.lit("(?i)img|image|asset"))
    prefix = _pairs(files, "text", rf"""(?i)(?:const|let|var)\s+({_NAME})\s*=\s*["']([^"']+/)["']""", "name", "prefix", keep=("path",)).where(named).withColumn("prefix", F.trim("prefix"))
    prefix = prefix.where(~F.rlike("prefix", F.lit("^(?:https?://|//|data:)"))).select("path", "prefix").distinct()
    lists = _pairs(files, "text", rf"(?is)(?:const|let|var)\s+({_NAME})\s*=\s*\[(.*?)\]", "name", "list", keep=("path",)).where(named)
    picture = rf"""(?i)["']([^"'\n\r<>{{}}()|\\]{{1,300}}\.(?:{'|'.join(fixed.LISTED_PICTURES)})(?:\?[^"']*)?)["']"""
    items = matches(lists, "list", picture, keep=("path",), as_="item").select("path", F.trim("item").alias("item")).distinct()
    both = prefix.join(items.where(~F.rlike("item", F.lit(r"^(?:\.?\.?/|https?://|data:)"))), "path").where(~F.startswith("item", F.col("prefix")))
    return both.select("path", "item", F.concat(F.regexp_replace("prefix", "/+$", ""), F.lit("/"), F.regexp_replace("item", "^/+", "")).alias("raw")).distinct()


def _resolved(found: DataFrame, files: DataFrame) -> DataFrame:
    """``found`` with ``url``, if the files have one to resolve against."""
    return found.join(files.select("path", F.col("url").alias("__at")), "path").withColumn("url", resolve(F.col("__at"), F.col("raw"))).drop("__at") if "url" in files.columns else found


def expand_numeric(files: DataFrame, most: int = 1000) -> DataFrame:
    """path, raw (, url) of numbered names: ``n = Math.floor(Math.random()*N)+s`` with ``"p/"+n+".png"``. Of ranges of one name the last counts."""
    spans = _pairs(files, "text", rf"(?i)\b({_NAME})\s*=\s*Math\.floor\s*\(\s*Math\.random\s*\(\s*\)\s*\*\s*(\d+)\s*\)\s*(?:\+\s*(\d+))?", "var", "count", "start", keep=("path",))
    spans = spans.select("path", "ord", "var", F.col("count").try_cast("int").alias("count"), F.coalesce(F.col("start").try_cast("int"), F.lit(0)).alias("start")).where(F.col("count").between(1, most))
    spans = spans.groupBy("path", "var").agg(F.max_by(F.struct("count", "start"), "ord").alias("s"))
    use = rf"""(?i)(["'])([A-Za-z0-9_./-]{{0,160}})\1\s*\+\s*({_NAME})\s*\+\s*(["'])([A-Za-z0-9_./?=&%:+-]{{0,160}}\.[A-Za-z0-9]{{1,8}}(?:\?[^'"\s<>]*)?)\4"""
    uses = _pairs(files, "text", use, "q1", "left", "var", "q2", "right", keep=("path",)).select("path", "left", "var", "right").distinct()
    numbered = uses.join(spans, ["path", "var"]).withColumn("n", F.explode(F.sequence("s.start", F.col("s.start") + F.col("s.count") - 1)))
    return _resolved(numbered.select("path", F.concat("left", "n", "right").alias("raw")).distinct(), files)


def expand_properties(files: DataFrame, most: int = 200, longest: int = 200) -> DataFrame:
    """path, ord, raw (, url) of ``${obj.prop}.ext``, wherever it stands, with each value of that property in the file, in order: at most ``most`` different
    ones of up to ``longest`` letters, none of them inlined data, script or a template itself."""
    template = rf"([A-Za-z0-9_./-]{{0,160}})\$\{{\s*{_NAME}\s*\.\s*({_NAME})\s*\}}([A-Za-z0-9_./?=&%:+-]{{0,160}}\.[A-Za-z0-9]{{1,8}}(?:\?[^'\"`\s<>]*)?)"
    uses = _pairs(files, "text", template, "left", "prop", "right", keep=("path",)).select("path", "left", F.lower("prop").alias("prop"), "right").distinct()
    values = _pairs(files, "text", rf"""(?:\b({_NAME})\b|['"]({_NAME})['"])\s*:\s*['"]([^'"\r\n]+)['"]""", "bare", "quoted", "value", keep=("path",))
    values = values.select("path", "ord", F.lower(F.concat("bare", "quoted")).alias("prop"), F.trim("value").alias("value"))
    values = values.where((F.col("value") != "") & (F.length("value") <= longest) & ~F.rlike("value", F.lit("^(?:data:|javascript:)")) & ~F.contains("value", F.lit("${")))
    values = values.join(uses.select("path", "prop").distinct(), ["path", "prop"], "left_semi").groupBy("path", "prop", "value").agg(F.min("ord").alias("ord"))
    values = values.withColumn("n", F.row_number().over(Window.partitionBy("path", "prop").orderBy("ord"))).where(F.col("n") <= most)
    return _resolved(uses.join(values, ["path", "prop"]).select("path", F.col("n").alias("ord"), F.concat("left", "value", "right").alias("raw")), files)


def _json_strings(df: DataFrame) -> DataFrame:
    """The string values of JSON objects at any depth: a string token that no colon follows is one."""
    tokens = matches(df, "text", r'(?s)("(?:[^"\\]++|\\.)*+"(?:\s*:)?)', keep=("path", "url", "base_url")).where(~F.endswith("raw", F.lit(":")))
    return tokens.withColumn("raw", F.trim(F.get(F.from_json(F.concat(F.lit("["), "raw", F.lit("]")), "array<string>"), F.lit(0))))


def scan_text_assets(files: DataFrame) -> DataFrame:
    """owner, rule, raw, url of assets named in scripts, styles, JSON and HTML: ``files`` is (path, url, base_url, text), the path unique.

    Slashes may be escaped. Quoted names with an asset's extension: a name in a script means the page's folder, ``./`` and ``../`` and names in other files
    the file's, ``new URL(name, import.meta.url)`` always the file's; object keys, lists of MIME types, code and tokens of over 400 letters are none, and of
    a label with a link the link counts. Further ``url()``, ``image-set()``, srcset, static and dynamic imports, chunks of preload lists, lazy attributes,
    sources, preload links and pictures of HTML and SVG, strings of JSON objects at any depth (with the references in their markup), precache lists. A
    variable that a script derives from its own place, and a declared folder with a declared list, are joined with their uses; their literals count
    there only. Fragments are dropped; only http(s) with a host stays.
    """
    keep = ("path", "url", "base_url")
    own = files.select(*keep, F.replace("text", F.lit("\\/"), F.lit("/")).alias("text"))
    js, json, markup = own.where(_is("js")), own.where(_is("json")), own.where(_is("markup"))
    rule = lambda df, name, how="file", base=None: df.select("path", "url", (F.col("base_url") if base is None else base).alias("base_url"), F.lit(name).alias("rule"), F.trim("raw").alias("raw"), (F.lit(how) if isinstance(how, str) else how).alias("how"))

    bases = script_bases(own)
    uses = _pairs(js, "text", rf"""(?i)\b({_NAME})\s*\+\s*["']([^"']+{_ASSET})["']""", "name", "raw", keep=keep).join(bases, ["path", "name"])
    prefixed = infer_prefixed_assets(own)
    inferred = prefixed.join(own.select(*keep), "path")
    elsewhere = uses.select("path", "raw").union(prefixed.select("path", "item")).distinct()

    quoted = _pairs(own, "text", rf"""(?i)(new(?:\s+{_NAME}\.)?\s*URL\s*\(\s*)?["'`]([^"'`\n\r<>{{}}()|\\]{{1,300}}{_ASSET})["'`](\s*:|{_IMPORT_META})?""", "before", "raw", "after", keep=keep)
    quoted = quoted.where(~(_is("js") & F.rlike("after", F.lit(r"^\s*:$"))) & ~F.trim("raw").isin(".json", ".mp3", ".webp", ".png", ".js", ".css"))
    links = quoted.withColumn("link", F.explode_outer(image_refs_of(F.col("raw"))))
    in_label = links.where("link is not null").withColumn("raw", F.col("link"))
    plain = links.where("link is null").where(~F.rlike("raw", F.lit(_MIME_LIST))).join(elsewhere, ["path", "raw"], "left_anti")
    module = (F.col("before") != "") & F.rlike("after", F.lit("import"))
    bare = _pairs(own.where(~_is("js")), "text", rf"""(?i)["`]([A-Za-z0-9][^"`/\n\r<>{{}}()|\\]{{0,200}}{_ASSET})["`]""", "raw", keep=keep).where(~F.contains("raw", F.lit("/")) & ~F.rlike("raw", F.lit(_MIME_LIST)))

    css = matches(own, "text", rf"""(?i)(?<!new\s{{0,9}})(?<!new\s{{1,9}}[\w$]{{1,40}}\.\s{{0,9}})url\(\s*["']?([^"')\s]+?{_ASSET}[^"')\s]*)["']?\s*\)""", keep=keep)
    sets = matches(matches(own, "text", r"(?is)\bimage-set\(((?:[^()]++|\([^()]*+\))*+)\)", keep=keep, as_="set"), "set", rf"""(?i)["'`]([^"'`]+{_ASSET})["'`]""", keep=keep)
    srcset = matches(own, "text", r"""(?i)srcset\s*=\s*["']([^"']+)["']""", keep=keep, as_="set")
    srcset = srcset.select(*keep, F.explode(F.split("set", ",")).alias("raw")).withColumn("raw", F.regexp_extract("raw", r"^\s*(\S+)", 1))
    imports = [matches(own, "text", p, keep=keep) for p in (
        rf"""(?i)(?:from|import)\s*["'](\.[^"']+{_CHUNK})["']""", rf"""(?i)import\s*\(\s*["'](\.[^"']+{_CHUNK})["']""", rf"""(?i)(?:import|require)\s*\(\s*["']([^"']+{_ASSET})["']""",
    )]
    preload = own.select(*keep, F.regexp_extract("text", r"(?s)__vite__mapDeps.*?d=\(m\.f\|\|\(m\.f=(\[.*?\])\)\)", 1).alias("list"))
    preload = matches(preload, "list", rf"""["']((?:\./)?[A-Za-z0-9][^"']+{_CHUNK})["']""", keep=keep).where(F.startswith("raw", F.lit("./")) | ~F.contains("raw", F.lit("/")))
    lazy = [matches(markup, "text", p, keep=keep) for p in (
        rf"""(?i)(?:data-src|data-lazy|data-background|data-poster|poster|data-original|data-bg)\s*=\s*["']([^"']+{_ASSET})["']""", r"""(?i)<source[^>]+src\s*=\s*["']([^"']+)["']""",
        r"""(?i)<link[^>]+rel\s*=\s*["']preload["'][^>]+href\s*=\s*["']([^"']+)["']""", r"""(?i)<image[^>]+(?:href|xlink:href)\s*=\s*["']([^"']+)["']""",
    )]
    precache = matches(js, "text", r"(?s)__precacheManifest\s*=\s*(\[.*?\])", keep=keep, as_="list").select(*keep, F.explode(F.from_json("list", "array<struct<url:string>>")).alias("e")).select(*keep, F.col("e.url").alias("raw"))

    strings = _json_strings(json.where(F.startswith(F.schema_of_variant(F.try_parse_json("text")), F.lit("OBJECT"))))
    refs = strings.withColumn("refs", image_refs_of(F.col("raw")))
    text = F.rlike("raw", F.lit("[<>]"))
    in_markup = refs.where((F.size("refs") == 0) & text).withColumn("own", F.concat(F.regexp_extract_all("raw", F.lit(r"""(?i)(?:src|href)\s*=\s*["']([^"']+)["']"""), F.lit(1)), F.regexp_extract_all("raw", F.lit(r"""(?i)url\(\s*["']?([^"')\s]+)["']?\s*\)"""), F.lit(1))))
    paths = refs.where((F.size("refs") == 0) & ~text).select(*keep, "raw").unionByName(in_markup.select(*keep, F.explode("own").alias("raw")).where(~F.rlike("raw", F.lit("[<>]"))))
    manifest = paths.where(F.rlike(path("raw"), F.lit(_MANIFEST))).unionByName(refs.select(*keep, F.explode("refs").alias("raw")))

    tables = [
        rule(uses, "script base", "beside", F.col("base")), rule(inferred, "list"), rule(css, "css"), rule(sets, "image-set"), rule(in_label, "label", "beside"),
        rule(plain, "quoted", F.when(module, "file").otherwise("written")), rule(bare.join(elsewhere, ["path", "raw"], "left_anti"), "bare", "page"), *[rule(i, "import") for i in imports],
        rule(preload, "preload", "chunk"), rule(srcset, "srcset"), *[rule(t, "tag") for t in lazy], rule(manifest, "manifest"), rule(precache, "precache"),
    ]
    every = reduce(DataFrame.unionByName, tables).distinct()
    found = F.regexp_replace(let(_found, *[F.col(c) for c in ("how", "url", "base_url", "raw")], _is("js")), "#.*$", "")
    good = F.filter(F.array(found), lambda x: F.coalesce(F.rlike(x, F.lit("(?i)^https?://[^/?]")), F.lit(False)))
    return every.select(F.col("path").alias("owner"), "rule", "raw", F.explode(good).alias("url")).distinct()
