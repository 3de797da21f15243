"""Joins over references, files, manifests, histories and queues."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import fixed
from lodestack.functions.scalars import update_reason
from lodestack.functions.urls import cache_identity, canonical_url, hostname, netloc, path, scheme
from lodestack.operators.extract import keep_first
from lodestack.operators.filters import screen_candidates
from lodestack.operators.scan import with_totals


def map_routes(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links (url) to pages that are at hand (route, local): link rows with ``local``."""
    return links.join(pages.select(F.col("route").alias("url"), "local"), "url")


def basename(c: str | Column) -> Column:
    return F.lower(F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"([^/]+)$", 1))


def missing_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References (package, ref) that no file (package, path) of the package is, by lower-cased path or by base name anywhere in it."""
    exact = files.select("package", F.lower("path").alias("__p")).distinct()
    names = files.select("package", basename("path").alias("__b")).distinct()
    clean = F.lower(F.regexp_replace("ref", r"^[./]+", ""))
    left = refs.withColumns({"__p": clean, "__b": basename("ref")})
    return left.join(exact, ["package", "__p"], "left_anti").join(names, ["package", "__b"], "left_anti").drop("__p", "__b")


def check_integrity(refs: DataFrame, files: DataFrame) -> DataFrame:
    """owner, ref, ok: does a file exist at one of six places (next to the owner, at the root, in ``public/``; as written and decoded)?"""
    folder = F.regexp_replace("owner", "[^/]*$", "")
    bare = F.regexp_replace("ref", r"[?#].*$", "")
    from lodestack.functions.urls import without_dot_segments

    near = lambda x: F.regexp_replace(without_dot_segments(F.concat(F.lit("/"), folder, x)), "^/", "")
    rooted = lambda x: F.regexp_replace(without_dot_segments(F.concat(F.lit("/"), x)), "^/", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    places = F.array_distinct(F.array(*[p for x in (bare, decoded) for p in (near(x), rooted(x), F.concat(F.lit("public/"), rooted(x)))]))
    tried = refs.select("package", "owner", "ref", F.explode(places).alias("path"))
    there = files.select("package", "path").distinct().withColumn("there", F.lit(True))
    return tried.join(there, ["package", "path"], "left").groupBy("package", "owner", "ref").agg(F.coalesce(F.bool_or("there"), F.lit(False)).alias("ok"))


def diff_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """package, path, status: intact, corrupted (another hash; sizes aren't compared), missing (recorded only), extra (on disk only)."""
    m = manifest.select("package", "path", F.col("sha256").alias("recorded"))
    f = files.select("package", "path", F.col("sha256").alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("recorded").isNull(), "extra").when(F.lower("recorded") == F.lower("found"), "intact").otherwise("corrupted")
    return m.join(f, ["package", "path"], "full_outer").select("package", "path", status.alias("status"))


def diff_history(history: DataFrame, probes: DataFrame) -> DataFrame:
    """url, status, reason: was a URL downloaded before (history) changed since, by what a probe says now?"""
    both = history.where("success").alias("h").join(probes.alias("p"), "url", "left")
    reason = update_reason((F.col("h.etag"), F.col("p.etag")), (F.col("h.last_modified"), F.col("p.last_modified")), (F.col("h.content_length"), F.col("p.content_length")))
    code = F.col("p.status")
    status = F.when(code.isNull() | (code >= 400), "unreachable").when(reason != "", "updated").otherwise("current")
    return both.select("url", status.alias("status"), F.when(code >= 400, F.concat(F.lit("HTTP "), code.cast("string"))).when(code.isNull(), "HTTP request failed").otherwise(reason).alias("reason"))


def lookup_cache(refs: DataFrame, index: DataFrame, files: DataFrame) -> DataFrame:
    """refs (url) with ``digest``, ``hit`` (a file of that content exists) and ``evict`` (the index names a file that is gone or changed)."""
    known = index.select("url", F.lower("digest").alias("digest"))
    there = files.select(F.lower("sha256").alias("digest")).distinct().withColumn("there", F.lit(True))
    hit = F.coalesce(F.col("there"), F.lit(False))
    return refs.join(known, "url", "left").join(there, "digest", "left").select(*[F.col(c) for c in refs.columns], "digest", hit.alias("hit"), (F.col("digest").isNotNull() & ~hit).alias("evict"))


def pending(candidates: DataFrame, *known: DataFrame, on: str = "url") -> DataFrame:
    """Candidates that none of ``known`` has."""
    return reduce(lambda left, k: left.join(k.select(on).distinct(), on, "left_anti"), known, candidates)


def scope_pages(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pages (page_id, url) in the scope of a seed (seed_id, scope_url): same origin, at or below its folder. An equi-join on every folder
    above a page, so that many seeds need no comparison of all pairs."""
    origin = lambda c: F.concat(scheme(c), F.lit("://"), F.lower(netloc(c)))
    parts = F.filter(F.split(F.regexp_replace(path("url"), "[^/]*$", ""), "/"), lambda p: p != "")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.transform(F.slice(parts, 1, n), lambda p: F.concat(p, F.lit("/"))), "")))
    each = pages.select("page_id", "url", origin("url").alias("origin"), F.explode(folders).alias("scope"))
    own = seeds.select("seed_id", origin("scope_url").alias("origin"), F.regexp_replace(F.when(path("scope_url") == "", "/").otherwise(path("scope_url")), "[^/]*$", "").alias("scope"))
    return each.join(own, ["origin", "scope"]).select("seed_id", "page_id", "url")


def attach_headers(df: DataFrame, exact: DataFrame, suffixes: DataFrame, column: str = "url", default: str = "default") -> DataFrame:
    """``df`` with the headers of its host: the exact host's (host, headers), else those of the first suffix (rank, suffix, headers) that fits, else a
    default. Suffixes are looked up by the host's own suffixes, an equi-join."""
    host = hostname(column)
    rows = df.withColumn("__host", host)
    labels = F.split("__host", r"\.")
    hosts = rows.select("__host").distinct()
    own = hosts.select("__host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    by_suffix = own.join(suffixes, "suffix").groupBy("__host").agg(F.min_by("headers", "rank").alias("__suffix"))
    by_host = exact.select(F.col("host").alias("__host"), F.col("headers").alias("__exact"))
    out = rows.join(by_host, "__host", "left").join(by_suffix, "__host", "left")
    return out.withColumn("headers", F.coalesce("__exact", "__suffix", F.lit(default))).drop("__host", "__exact", "__suffix")


def match_viewer(pages: DataFrame, viewers: list[dict], mode: str | Column = "auto", hints: dict[str, Sequence[str]] = fixed.VIEWER_HINTS) -> DataFrame:
    """page_id, viewer, score: of the registered viewers (id, type, name) the one that fits a page (page_id, html) and a download's mode best; of equals the
    first; without any mark no row.

    One for each of its type's hints in the page, in any case of letters, 20 for the remix's own mark, 10 if the mode asks for its type, and, if there is any of
    these, 5 for a name that says it is local. The viewers are a short list in the plan, so each page is read once and no pairs are made.
    """
    low = F.lower("html")
    asked = F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.VIEWER_MODES.items() for x in kv]), F.lit(mode) if isinstance(mode, str) else mode)
    remix = F.contains("html", F.lit(fixed.REMIX_TEMPLATE)) | F.contains(low, F.lit("app.offline.js")) | F.contains(low, F.lit("iccremix"))

    def score(v: dict) -> Column:
        kind = v.get("type", "custom")
        base = sum([F.when(F.contains(low, F.lit(h.lower())), 1).otherwise(0) for h in hints.get(kind, ())], F.lit(0))
        base += F.when(remix & F.lit(kind == "icc_remix"), 20).otherwise(0) + F.when(F.coalesce(asked == kind, F.lit(False)), 10).otherwise(0)
        return base + F.when((base > 0) & F.lit("local" in v.get("name", "").lower()), 5).otherwise(0)

    best = F.array_max(F.array(*[F.struct(score(v).alias("score"), F.lit(-k).alias("order"), F.lit(v["id"]).alias("viewer")) for k, v in enumerate(viewers)]))
    return pages.select("page_id", best.alias("b")).where("b.score > 0").select("page_id", "b.viewer", "b.score")


def fallback_basename(unresolved: DataFrame, saved: DataFrame) -> DataFrame:
    """unresolved (url) with ``local``: the earliest saved file (url, local, ord) of the same base name, else the URL itself."""
    first = keep_first(saved.withColumn("__b", basename(path("url"))), ["__b"], ["ord"]).select("__b", F.col("local").alias("__local"))
    return unresolved.withColumn("__b", basename(path("url"))).join(first, "__b", "left").withColumn("local", F.coalesce("__local", "url")).drop("__b", "__local")


def fan_out(results: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each alias (identity, url) with its identity's result."""
    return aliases.join(results, "identity")


def resolve_auto_modes(queue: DataFrame, probes: DataFrame, preference: str = "folder") -> DataFrame:
    """The queue with mode ``auto`` decided by probes (url, static, structure_ok, failed); other rows pass."""
    ending = F.lit("zip" if preference == "zip" else "folder")
    decided = F.when(F.col("failed"), "embed").when(F.col("static"), F.concat(F.lit("website_"), ending)).when(F.col("structure_ok"), F.concat(F.lit("cyoap_vue_"), ending)).otherwise(F.concat(F.lit("website_"), ending))
    return queue.join(probes, "url", "left").withColumn("mode", F.when(F.col("mode") == "auto", decided).otherwise(F.col("mode"))).select(*queue.columns)


def live_candidates(candidates: DataFrame, probes: DataFrame) -> DataFrame:
    """Candidates (rank, url) that answered 200 or 206, by rank."""
    return candidates.join(probes.where(F.col("status").isin(200, 206)).select("url"), "url", "left_semi")


def requeue(diff: DataFrame, failures: DataFrame) -> DataFrame:
    """New queue rows (url, filename, mode) for what has changed or failed."""
    rows = diff.where("status = 'updated'").select("url").unionByName(failures.select("url"))
    return rows.select("url", F.lit("").alias("filename"), F.lit("auto").alias("mode"))


def resume_queue(queue: DataFrame, completed: DataFrame) -> DataFrame:
    """The queue with ``skip``: completed, and once in the queue only."""
    done = completed.select("url").distinct().withColumn("__done", F.lit(True))
    return with_totals(queue, ["url"], __n=F.count("*")).join(done, "url", "left").withColumn("skip", F.coalesce("__done", F.lit(False)) & (F.col("__n") == 1)).drop("__n", "__done")


def resolve_targets(candidates: DataFrame, validations: DataFrame) -> DataFrame:
    """page, target, reasons: of a page's candidates (page, rank, url) the first that is allowed and valid (url, ok, reason); else the last five reasons."""
    rows = screen_candidates(keep_first(candidates.withColumn("url", canonical_url("url")).where("url is not null and url <> page"), ["page", "url"], ["rank"]))
    rows = rows.withColumnRenamed("reason", "screened").join(validations.select("url", "ok", "reason"), "url", "left")
    good = F.col("allowed") & F.coalesce("ok", F.lit(False))
    why = F.coalesce("screened", "reason", F.lit("not checked"))
    found = rows.groupBy("page").agg(F.min_by(F.when(good, F.col("url")), F.when(good, F.col("rank"))).alias("target"), F.sort_array(F.collect_list(F.when(~good, F.struct("rank", why.alias("why"))))).alias("bad"))
    return found.select("page", "target", F.when(F.col("target").isNull(), F.transform(F.slice("bad", F.greatest(F.size("bad") - 4, F.lit(1)), 5), lambda x: x["why"])).alias("reasons"))


def restrict_to_reachable(files: DataFrame, reachable: DataFrame) -> DataFrame:
    """files (path, ...) without the style files that no page reaches: ``reachable`` (path) is ``reachable_styles``'s result."""
    style = F.rlike("path", F.lit(r"(?i)\.css$"))
    return files.where(~style).unionByName(files.where(style).join(reachable.select("path").distinct(), "path", "left_semi"))


def remove_localised(pending: DataFrame, localised: DataFrame) -> DataFrame:
    """pending (url, ...) without what is at hand already, also under another spelling of the same file (``localised``: url)."""
    known = localised.select(cache_identity("url").alias("__identity")).distinct()
    return pending.withColumn("__identity", cache_identity("url")).join(known, "__identity", "left_anti").drop("__identity")


def patch_media(walk: DataFrame, local: DataFrame) -> DataFrame:
    """project_id, path, field, old, new, use_audio_url: how a project's media fields change when videos are at hand as files.

    ``walk`` is the strings of projects (project_id, path, key, value), ``local`` (url, path) the files. A ``bgmId`` that is such a link, its video's id or
    the file already is replaced, and its object then uses audio files; calls of the player in any text get the file in place of the id.
    """
    video = lambda c: F.regexp_extract(c, r"(?:v=|youtu\.be/)([A-Za-z0-9_-]{11})", 1)
    files = local.select(F.trim("url").alias("url"), F.col("path").alias("new"))
    by_id = files.where(video(F.col("url")) != "").select(video(F.col("url")).alias("ref"), "new")
    names = files.select(F.col("url").alias("ref"), "new").unionByName(by_id).unionByName(files.select(F.col("new").alias("ref"), "new")).groupBy("ref").agg(F.min("new").alias("new"))
    fields = walk.where((F.lower("key") == "bgmid") & (F.trim("value") != "")).withColumn("value", F.trim("value"))
    whole = fields.join(names.withColumnRenamed("ref", "value"), "value").select("project_id", "path", "value", "new")
    rest = fields.join(names.select(F.col("ref").alias("value")), "value", "left_anti").withColumn("ref", video(F.col("value")))
    linked = rest.join(names, "ref").select("project_id", "path", "value", "new")
    patched = whole.unionByName(linked).select("project_id", "path", F.lit("bgmId").alias("field"), F.col("value").alias("old"), "new", F.lit(True).alias("use_audio_url"))
    call = r"""(?i)playVideo\s*\(\s*['"]([A-Za-z0-9_-]{11})['"]\s*\)"""
    calls = walk.select("project_id", "path", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(call), 1))).alias("ref"))
    texts = calls.join(by_id.dropDuplicates(["ref"]), "ref").select("project_id", "path", F.lit("playVideo").alias("field"), F.col("ref").alias("old"), "new", F.lit(False).alias("use_audio_url"))
    return patched.unionByName(texts)
