"""Aggregations and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import fixed
from lodestack.functions.scalars import project_score
from lodestack.functions.urls import cache_identity, is_safe_member, netloc, path, query, resolve
from lodestack.operators.scan import with_totals
from lodestack.operators.windows import cap_scan


def summarise_by_kind(log: DataFrame, kind: str = "kind", local: str = "local") -> DataFrame:
    return log.groupBy(kind).agg(F.count_distinct(local).alias("n"), F.min(local).alias("first"), F.max(local).alias("last"))


def files_by_kind(log: DataFrame, kind: str = "kind", local: str = "local") -> DataFrame:
    """kind, local, n: the different files of each kind, and how many it has. One row a file."""
    return with_totals(log.select(kind, local).distinct(), [kind], n=F.count("*"))


def dedup_log(log: DataFrame) -> DataFrame:
    return log.select("url", "local", "kind", "error").dropDuplicates()


def summarise_results(df: DataFrame, by: str | None = None) -> DataFrame:
    """total, ok, others, succeeded (OK and SKIP) by status."""
    rows = df.groupBy(by) if by else df.groupBy()
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(F.col("status") != "OK").alias("others"), F.count_if(F.col("status").isin("OK", "SKIP")).alias("succeeded"))


def verify_packages(files: DataFrame, diff: DataFrame, missing: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """package, issues, notes, ok of packages' files (package, path, size; text, if projects are to be read).

    Issues: empty files (not reports), a project.json at the root that isn't a JSON object, corrupted and missing files (``diff``), missing references, and of
    ``packages`` (package) those without files. Notes: extra files, no project.json, or one without a project's fields.
    """
    row = lambda df, text, blocking=True: df.select("package", F.lit(text).alias("issue"), (F.lit(blocking) if isinstance(blocking, bool) else blocking).alias("blocking"))
    tables = [row(files.where((F.col("size") == 0) & ~F.regexp_extract("path", "([^/]+)$", 1).isin(*fixed.REPORT_NAMES)), "zero-byte asset"), row(missing, "missing reference")]
    tables.append(diff.where("status <> 'intact'").select("package", F.col("status").alias("issue"), (F.col("status") != "extra").alias("blocking")))
    every = files.select("package").distinct()
    roots = files.where(F.col("path") == "project.json")
    tables.append(row(every.join(roots.select("package").distinct(), "package", "left_anti"), "no project.json at root", False))
    if "text" in files.columns:
        payload = F.try_parse_json("text")
        is_object = F.coalesce(F.startswith(F.schema_of_variant(payload), F.lit("OBJECT")), F.lit(False))
        verdict = F.when(payload.isNull(), "project.json failed to parse").when(~is_object, "project.json is not an object").when(project_score(payload) < 4, "project.json lacks typical fields")
        found = roots.select("package", verdict.alias("issue")).where("issue is not null")
        tables.append(found.withColumn("blocking", F.col("issue") != "project.json lacks typical fields"))
    if packages is not None:
        tables.append(row(packages.select("package").distinct().join(every, "package", "left_anti"), "folder is empty"))
        every = every.union(packages.select("package")).distinct()
    issues = reduce(DataFrame.unionByName, tables).groupBy("package").agg(F.count_if("blocking").alias("issues"), F.count_if(~F.col("blocking")).alias("notes"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return every.join(issues, "package", "left").select("package", zero(F.col("issues")).alias("issues"), zero(F.col("notes")).alias("notes"), (zero(F.col("issues")) == 0).alias("ok"))


def cache_stats(index: DataFrame, limit_mib: int = 2048) -> DataFrame:
    """entries, files (different digests), mib (whole), limit_mib."""
    digests = index.groupBy("digest").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return digests.agg(F.sum("n").alias("entries"), F.count("*").alias("files"), F.floor(F.sum("size") / (1 << 20)).alias("mib")).withColumn("limit_mib", F.lit(limit_mib))


#: A page's scripts are read up to so many characters together, and each up to so many.
MOST_SCRIPT, MOST_OF_A_SCRIPT = 3 << 20, 1 << 20


def profile_signals(pages: DataFrame, links: DataFrame, scripts: DataFrame | None = None) -> DataFrame:
    """Per page (page_id, url, html) what says how it must be mirrored: counts of its marks, its routes, and a score of what only shows when it runs.

    ``links`` (page_id, page_url, raw): routes are the different paths and queries of those on the page's host, at or below its path. ``scripts``
    (page_id, path, text): its script files, read in path order up to MOST_SCRIPT characters.
    """
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    html = F.coalesce("html", F.lit(""))
    signals = pages.select(
        "page_id", count(html, r"(?i)<script\b[^>]*\bsrc\s*=").alias("scripts"), count(html, r"(?i)<script\b[^>]*\btype\s*=\s*[\"']module[\"']").alias("modules"),
        count(html, r"(?i)\b(?:data-src|data-lazy-src|loading\s*=\s*[\"']lazy)").alias("lazy"), F.rlike(html, F.lit(r"(?i)\bid\s*=\s*[\"'](?:app|root|__next)[\"']")).alias("framework"),
        count(html, r"(?i)/_next/").alias("next"), count(html, r"(?i)<canvas\b").alias("canvas"),
    )
    target = F.regexp_replace(resolve(F.col("page_url"), F.col("raw")), "#.*$", "")
    own = links.select("page_id", "page_url", target.alias("target"))
    bare = lambda c: F.regexp_replace(path(c), "/+$", "")
    inside = (F.lower(netloc("target")) == F.lower(netloc("page_url"))) & ((bare("target") == bare("page_url")) | F.startswith(path("target"), F.concat(bare("page_url"), F.lit("/"))))
    routes = own.where(inside).groupBy("page_id").agg(F.count_distinct(F.struct(path("target"), query("target"))).alias("routes"))
    out = signals.join(routes, "page_id", "left").withColumn("routes", F.coalesce("routes", F.lit(0)))
    names = ("fetches", "observers", "imports", "new_images")
    if scripts is not None:
        read = cap_scan(scripts.where(F.rlike("path", F.lit(r"(?i)\.js$"))).withColumn("size", F.length("text")), "page_id", MOST_SCRIPT, MOST_OF_A_SCRIPT)
        text = F.substr("text", F.lit(1), F.col("take").cast("int"))
        patterns = (r"\bfetch\s*\(", "IntersectionObserver", r"\bimport\s*\(", r"\bnew\s+Image\s*\(")
        bundles = read.select("page_id", *[count(text, p).alias(n) for n, p in zip(names, patterns)]).groupBy("page_id").agg(*[F.sum(n).alias(n) for n in names])
        out = out.join(bundles, "page_id", "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) if scripts is not None else F.lit(0) for n in names})
    has = lambda c: (F.col(c) > 0).cast("int")
    score = 2 * has("next") + (F.col("framework") & (F.col("scripts") > 0)).cast("int") + has("modules") + has("canvas") + has("fetches") + has("observers") + has("new_images")
    return out.withColumn("score", score)


def plan_archive(signals: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """page_id, strategy: classic with a project file, browser for runtime signs, smart for routes, else classic."""
    rows = signals
    if projects is not None:
        rows = rows.join(projects.select("page_id").distinct().withColumn("project", F.lit(True)), "page_id", "left")
    project = F.coalesce(F.col("project"), F.lit(False)) if projects is not None else F.lit(False)
    return rows.select("page_id", F.when(project, "classic").when(F.col("score") >= 2, "browser").when(F.col("routes") > 0, "smart").otherwise("classic").alias("strategy"))


def audit_archives(members: DataFrame, *, most_members: int = 10_000, most_mib: int = 512, most_total_mib: int = 2048, ratio: float = 250.0) -> DataFrame:
    """archive, members, largest, total, unsafe, bombs, ok of archives' members: counts, sizes, compression and paths within limits."""
    mib = 1 << 20
    bomb = (F.col("file_size") > mib) & (F.col("file_size") > ratio * F.greatest("compress_size", F.lit(1)))
    found = members.where("not is_dir").groupBy("archive").agg(F.count("*").alias("members"), F.max("file_size").alias("largest"), F.sum("file_size").alias("total"), F.count_if(~is_safe_member("member")).alias("unsafe"), F.count_if(bomb).alias("bombs"))
    ok = (F.col("members") <= most_members) & (F.col("largest") <= most_mib * mib) & (F.col("total") <= most_total_mib * mib) & (F.col("unsafe") == 0) & (F.col("bombs") == 0)
    return found.withColumn("ok", ok)


def group_aliases(refs: DataFrame, column: str = "url") -> DataFrame:
    """identity, representative (the first in ``ord``), n, of URLs that are one file."""
    return refs.groupBy(cache_identity(column).alias("identity")).agg(F.min_by(column, "ord").alias("representative"), F.count_distinct(column).alias("n"))


def alias_members(refs: DataFrame, column: str = "url") -> DataFrame:
    """identity, url, representative (the first in ``ord``), n (of the identity's different URLs): every URL that is a spelling of a file, once."""
    rows = refs.withColumn("identity", cache_identity(column)).groupBy("identity", F.col(column).alias("url")).agg(F.min("ord").alias("ord"))
    return with_totals(rows, ["identity"], representative=F.min_by("url", F.struct("ord", "url")), n=F.count("*")).drop("ord")


def ref_sources(refs: DataFrame) -> DataFrame:
    """url, owner, n of references (url, owner): every file that a reference is in, once, and in how many it is. One row an owner, so no list grows with the table."""
    return with_totals(refs.select("url", "owner").distinct(), ["url"], n=F.count("*"))


def validate_outputs(files: DataFrame) -> DataFrame:
    """path, refs, inlined, remaining, ok of written projects: fields with a picture, pictures inside, fields that still name one outside; a file of fewer
    than 10 bytes, or that is no JSON object or list, isn't ok."""
    count = lambda p: F.regexp_count("text", F.lit(p))
    refs, inlined = count('"image": ?"'), count("data:image/")
    listed = F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]")))  # what follows a value would else go unseen
    json = F.rlike("text", F.lit(r"^\s*[{\[]")) & listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return files.select("path", refs.alias("refs"), inlined.alias("inlined"), (refs - inlined).alias("remaining"), F.coalesce((F.octet_length("text") >= 10) & json, F.lit(False)).alias("ok"))


def count_failure_lines(logs: DataFrame) -> DataFrame:
    return logs.groupBy("file").agg(F.count_if(F.trim("value") != "").alias("n"))


def summarise_capture(events: DataFrame, key: str = "page", reason: str | None = None) -> DataFrame:
    """key, discovered, downloaded, failed, steps; with ``reason``, a column of it, also blocked: how many requests were held back for each reason."""
    n = lambda t: F.count_if(F.col("type") == t).alias(t)
    out = events.groupBy(key).agg(n("discovered"), n("downloaded"), n("failed"), F.count("*").alias("steps"))
    if reason is None:
        return out
    held = events.where((F.col("type") == "blocked") & F.col(reason).isNotNull()).groupBy(key, reason).agg(F.count("*").alias("n"))
    held = held.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(reason, "n")))).alias("blocked"))  # as many entries as reasons
    return out.join(held, key, "left").withColumn("blocked", F.coalesce("blocked", F.create_map().cast("map<string,bigint>")))


def summarise_fonts(fonts: DataFrame) -> DataFrame:
    """description, n, first of font references (url, description)."""
    return fonts.groupBy("description").agg(F.count("*").alias("n"), F.min("url").alias("first"))


def first_observed(events: DataFrame, key: str, value: str, ts: str = "ts") -> DataFrame:
    return events.groupBy(key).agg(F.min_by(value, F.struct(ts, value)).alias(value))


def queue_multiplicity(queue: DataFrame) -> DataFrame:
    """The queue with ``times`` and ``duplicate``; no row goes."""
    return with_totals(queue, ["url"], times=F.count("*")).withColumn("duplicate", F.col("times") > 1)


def project_stats(projects: DataFrame) -> DataFrame:
    """project_id, rows, objects, backpack, images, title of JSON variants, wrapped in ``app`` or not."""
    body = F.coalesce(F.try_variant_get("payload", "$.app", "variant"), F.col("payload"))
    p = projects.select("project_id", body.alias("b"))
    title = F.coalesce(*[F.try_variant_get("b", f"$.{k}", "string") for k in ("title", "name", "projectTitle")])
    rows = F.try_variant_get("b", "$.rows", "array<variant>")
    out = p.select("project_id", title.alias("title"), F.coalesce(F.size(F.try_variant_get("b", "$.backpack", "array<variant>")), F.lit(0)).alias("backpack"), rows.alias("r"))
    objects = F.flatten(F.transform("r", lambda r: F.coalesce(F.try_variant_get(r, "$.objects", "array<variant>"), F.array().cast("array<variant>"))))
    count = lambda c: F.when(c.isNull(), 0).otherwise(F.greatest(F.size(c), F.lit(0)))
    images = F.filter(objects, lambda o: F.coalesce(F.try_variant_get(o, "$.image", "string"), F.lit("")) != "")
    return out.select("project_id", "title", "backpack", count(F.col("r")).alias("rows"), count(objects).alias("objects"), count(images).alias("images"))
