"""Fixpoint jobs: each level is a join, and ends in a table in the shared folder, so neither plans nor lost executors hurt."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import fixed
from lodestack.functions.urls import extension
from lodestack.operators.extract import image_refs_of, markdown_images
from lodestack.operators.scan import running
from lodestack.shared import discard, written


def _numbered(df: DataFrame, order: list[str], first: int = 0) -> DataFrame:
    """``df`` with ``place``, the rows' numbers in ``order`` from ``first``."""
    return running(df, F.lit(1), order).withColumn("place", F.col("upto") - 1 + first).drop("upto")


def crawl_routes(links: DataFrame, seeds: DataFrame, pages: DataFrame | None = None, *, existing: DataFrame | None = None, max_depth: int = 30, max_pages: int | None = None) -> tuple[DataFrame, dict]:
    """Pages reached from ``seeds`` (url) over ``links`` (url, target, ord), breadth first: (url, depth, place), and what was left.

    Each page is visited once, at its least depth; those at ``max_depth`` aren't expanded, nor are those not in ``pages`` (url), if given. In a level the
    order is that of the parents, then of their links. After ``max_pages`` the crawl stops and says so. Pages in ``existing`` (url) aren't visited again.
    """
    level = seeds.select("url").distinct()
    level = level.join(existing.select("url").distinct(), "url", "left_anti") if existing is not None else level
    level = _numbered(level, ["url"]) if max_pages is not None else level.withColumn("place", F.xxhash64("url"))
    levels = [written(level.select("url", F.lit(0).alias("depth"), "place"))]  # each is written once; all of them are the pages visited
    n, depth, out = levels[0].count(), 0, {"limit": False, "remaining": 0}
    if max_pages is not None and n > max_pages:
        return levels[0].where(F.col("place") < max_pages), {"limit": True, "remaining": n - max_pages}
    while depth < max_depth:
        depth += 1
        known = pages.select("url").distinct() if pages is not None else None
        parents = levels[-1].join(known, "url", "left_semi") if known is not None else levels[-1]
        reach = parents.join(links.select("url", "target", "ord"), "url").groupBy("target").agg(F.min(F.struct("place", "ord")).alias("via"))
        reach = reach.withColumnRenamed("target", "url").join(reduce(DataFrame.unionByName, levels).select("url"), "url", "left_anti")
        reach = reach.join(existing.select("url").distinct(), "url", "left_anti") if existing is not None else reach
        placed = _numbered(reach.select("url", "via.place", "via.ord").withColumnRenamed("place", "parent"), ["parent", "ord", "url"], n) if max_pages is not None else reach.withColumn("place", F.xxhash64("url"))
        # the order within a level matters only to cut it at max_pages, which bounds what a level keeps
        level = written(placed.select("url", F.lit(depth).alias("depth"), "place"))
        found = level.count()
        if not found:
            discard(level)
            break
        if max_pages is not None and n + found > max_pages:
            out = {"limit": True, "remaining": n + found - max_pages}
            levels.append(level.where(F.col("place") < max_pages))
            break
        levels.append(level)
        n += found
    return reduce(DataFrame.unionByName, levels), out


def resume_crawl(links: DataFrame, existing: DataFrame, pages: DataFrame | None = None, *, max_depth: int = 30, max_pages: int | None = None) -> tuple[DataFrame, dict]:
    """A crawl that was cut short, continued: links (url, target, ord) of pages that exist (url) to others are the seeds, and the pages that exist count
    against ``max_pages``. All pages (url, depth, place; those that exist at depth -1), and what was left."""
    have = written(existing.select("url").distinct())
    seeds = links.join(have, "url", "left_semi").select(F.col("target").alias("url")).distinct().join(have, "url", "left_anti")
    left = None if max_pages is None else max(0, max_pages - have.count())
    found, out = crawl_routes(links, seeds, pages, existing=have, max_depth=max_depth, max_pages=left)
    return have.select("url", F.lit(-1).alias("depth"), F.lit(None).cast("long").alias("place")).unionByName(found), out


def reachable_styles(refs: DataFrame, files: DataFrame) -> DataFrame:
    """path of style files that some HTML file reaches: over references (owner, path) of HTML files and imports of reached styles; existing files only."""
    there = files.select("path").distinct()
    links = written(refs.join(there, "path", "left_semi").select(F.col("owner").alias("url"), F.col("path").alias("target"), F.lit(0).alias("ord")).distinct())
    seeds = there.where(F.rlike("path", F.lit(r"(?i)\.html?$"))).select(F.col("path").alias("url"))
    found, _ = crawl_routes(links, seeds, max_depth=1_000_000)
    return found.where(F.rlike("url", F.lit(r"(?i)\.css$"))).select(F.col("url").alias("path"))


def _levels(df: DataFrame, key: str, step: str) -> tuple[DataFrame, list[DataFrame]]:
    """The scalars of every level and the levels with objects and arrays: ``df`` has a column value (variant), ``step`` makes the next level's columns in SQL."""
    nested = F.coalesce(F.rlike(F.schema_of_variant("value"), F.lit("^(OBJECT|ARRAY)<")), F.lit(False))
    leaves, inner, level = [], [], written(df)
    while True:
        leaves.append(level.where(~nested))
        level = level.where(nested)
        if not level.limit(1).count():
            break
        inner.append(level)
        level.createOrReplaceTempView(view := f"level_{uuid.uuid4().hex}")
        level = written(df.sparkSession.sql(f"SELECT {key}, {step} FROM {view} AS t, LATERAL variant_explode(t.value) AS e"))
    return reduce(DataFrame.unionByName, leaves), inner


def nested_levels(df: DataFrame, keys: tuple[str, ...], payload: str) -> list[DataFrame]:
    """The objects and arrays of JSON variants, a table (keys..., payload) for each depth."""
    rows = df.select(*keys, F.col(payload).alias("value")).where("value is not null")
    return [level.select(*keys, F.col("value").alias(payload)) for level in _levels(rows, ", ".join(keys), "e.value")[1]]


def flatten_variant(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, path, value variant) of every scalar at any depth of a JSON variant: a lateral explode per level, written, until no object or array is left."""
    step = "CASE WHEN e.key IS NULL THEN concat(path, '[', e.pos, ']') ELSE concat(path, '.', e.key) END AS path, e.value"
    return _levels(df.select(key, F.lit("$").alias("path"), F.col(payload).alias("value")).where("value is not null"), key, step)[0]


def walk_strings(df: DataFrame, key: str = "project_id", payload: str = "payload") -> DataFrame:
    """key, path, key_name, item, depth, audio, pos, value of every string in JSON variants that is a field's value, or (``item``) in a list that is one.

    ``audio``: the object that has the field says that its sounds are files (``useAudioURL``). Strings in lists of lists are none.
    """
    truth = "coalesce(try_variant_get(t.value, '$.useAudioURL', 'string') NOT IN ('', '0', 'false', '0.0', 'null', '[]', '{}'), false)"
    step = f"""CASE WHEN e.key IS NULL THEN concat(path, '[', e.pos, ']') ELSE concat(path, '.', e.key) END AS path, CASE WHEN e.key IS NULL THEN CASE WHEN item OR key_name IS NULL THEN NULL ELSE key_name END ELSE e.key END AS key_name,
      e.key IS NULL AND NOT item AND key_name IS NOT NULL AS item, depth + 1 AS depth, CASE WHEN e.key IS NULL THEN false ELSE {truth} END AS audio, e.pos AS pos, e.value"""
    none = F.lit(None).cast("string")
    rows = df.select(F.col(key), F.lit("$").alias("path"), none.alias("key_name"), F.lit(False).alias("item"), F.lit(0).alias("depth"), F.lit(False).alias("audio"), F.lit(0).alias("pos"), F.col(payload).alias("value")).where("value is not null")
    leaves, _ = _levels(rows, key, step)
    return leaves.where((F.schema_of_variant("value") == "STRING") & F.col("key_name").isNotNull()).withColumn("value", F.try_variant_get("value", "$", "string"))


def walk_projects(projects: DataFrame, key: str = "project_id", payload: str = "payload") -> DataFrame:
    """key, path, class (image, audio, video), raw of what the strings of project JSON name, at any depth, each once.

    By field: pictures' and sounds' fields, ``bgmId`` (a sound's file or a video, as its object's ``useAudioURL`` says), lists of sounds; by value: links and
    paths with a picture's or sound's extension, pictures in rich text, Markdown and styles, videos in links and player calls. ``data:`` values are nothing.
    """
    rows = walk_strings(df=projects, key=key, payload=payload).withColumn("v", F.trim("value")).where((F.col("v") != "") & ~F.startswith("v", F.lit("data:")))
    v, name = F.col("v"), F.lower("key_name")
    hit = lambda p: F.rlike(v, F.lit(p))
    linked = hit(fixed.VIDEO_LINK) | hit(fixed.SOUND_LINK)
    ext = F.substring(extension(v), 2, 20)
    bare_ext = F.lower(F.regexp_extract(F.regexp_replace(v, r"\?.*$", ""), r"[^/.]\.([^./]*)$", 1))
    one = lambda kind, raw: F.array(F.struct(F.lit(kind).alias("class"), raw.alias("raw")))
    none = F.array().cast("array<struct<class:string,raw:string>>")
    many = lambda kind, raws: F.transform(raws, lambda r: F.struct(F.lit(kind).alias("class"), r.alias("raw")))
    watch = F.concat(F.lit(fixed.WATCH_LINK), v)
    by_ext = lambda e: F.when(e.isin(*fixed.IMAGE_EXTENSIONS), one("image", v)).when(e.isin(*fixed.AUDIO_EXTENSIONS), one("audio", v)).otherwise(none)
    http = F.startswith(v, F.lit("http://")) | F.startswith(v, F.lit("https://"))
    by_field = (
        F.when(name.isin(*[n.lower() for n in fixed.IMAGE_FIELDS]), many("image", image_refs_of(v, True)))
        .when(name == "bgmid", F.when(linked, one("video", v)).when(F.col("audio"), one("audio", v)).when(hit(fixed.VIDEO_ID), one("video", watch)).otherwise(none))
        .when(name.isin(*[n.lower() for n in fixed.AUDIO_FIELDS]), F.when(linked, one("video", v)).otherwise(one("audio", v)))
        .when(http, by_ext(ext)).when(F.contains(v, F.lit("/")) & ~F.rlike(v, F.lit("^(#|javascript:)")) & (F.size(image_refs_of(v)) == 0), by_ext(bare_ext)).otherwise(none)
    )
    calls = F.transform(F.regexp_extract_all(v, F.lit(fixed.VIDEO_ID_IN_TEXT), 1), lambda i: F.concat(F.lit(fixed.WATCH_LINK), i))
    videos = F.transform(F.regexp_extract_all(v, F.lit(fixed.VIDEO_LINK_IN_TEXT), 0), lambda u: F.regexp_replace(u, "[.,;]+$", ""))
    css = F.regexp_extract_all(v, F.lit(r"""(?i)url\(["']?([^"')\s]+\.(?:png|jpg|jpeg|webp|gif|svg|avif|mp3|ogg|wav|woff2?|ttf))["']?\)"""), 1)
    css = F.filter(css, lambda u: ~F.startswith(u, F.lit("data:")))
    css_ext = lambda u: F.lower(F.regexp_extract(F.regexp_replace(u, r"\?.*$", ""), r"\.([^./]*)$", 1))
    pictures = F.filter(css, lambda u: css_ext(u).isin(*fixed.IMAGE_EXTENSIONS))
    sounds = F.filter(css, lambda u: css_ext(u).isin(*fixed.AUDIO_EXTENSIONS))
    field = F.concat(by_field, many("video", calls), many("video", videos), many("image", image_refs_of(v)), many("image", markdown_images(v)), many("image", pictures), many("audio", sounds))
    sound = F.rlike(v, F.lit(rf"\.({'|'.join(fixed.AUDIO_EXTENSIONS)})$"))
    entry = F.when(~name.isin(*fixed.PLAYLIST_FIELDS), none).when(linked, one("video", v)).when(hit(fixed.VIDEO_ID), one("video", watch)).when(sound, one("audio", v)).otherwise(none)
    return rows.select(key, "path", F.explode(F.when(F.col("item"), entry).otherwise(field)).alias("f")).select(key, "path", "f.class", "f.raw").distinct()


def extract_record_urls(records: DataFrame, key: str = "record_id", payload: str = "payload", max_depth: int = 6, most: int = 500) -> DataFrame:
    """key, path, raw of the http(s) links in the link fields of catalogue JSON, in objects nested up to ``max_depth``; of each list only the first ``most`` entries."""
    none = F.lit(None).cast("string")
    step = f"""CASE WHEN e.key IS NULL THEN concat(path, '[', e.pos, ']') ELSE concat(path, '.', e.key) END AS path, e.key AS key_name, depth + 1 AS depth,
      CASE WHEN e.key IS NULL AND e.pos >= {int(most)} THEN NULL ELSE e.value END AS value"""
    rows = records.select(F.col(key), F.lit("$").alias("path"), none.alias("key_name"), F.lit(0).alias("depth"), F.col(payload).alias("value")).where("value is not null")
    leaves, _ = _levels(rows, key, step)
    found = leaves.where(F.col("key_name").isin(*fixed.RECORD_FIELDS) & (F.col("depth") <= max_depth + 1) & (F.schema_of_variant("value") == "STRING")).withColumn("raw", F.try_variant_get("value", "$", "string"))
    return found.where(F.rlike(F.trim("raw"), F.lit("(?i)^https?://"))).select(key, "path", "raw")


def deep_scan(files: DataFrame, responses: DataFrame, scan, max_rounds: int = 6) -> DataFrame:
    """url, round of what is found from ``files`` (path, url, base_url, text) by ``scan`` (-> owner, rule, raw, url) when every answer in ``responses``
    (same columns) is scanned too; ends when nothing new can be fetched, or after ``max_rounds``."""
    known = written(files.select("url").distinct().withColumn("round", F.lit(0)))
    now = files
    for k in range(1, max_rounds + 1):
        new = scan(now).select("url").distinct().join(known.select("url"), "url", "left_anti")
        got = written(responses.join(new, "url", "left_semi"))
        if not got.limit(1).count():
            break
        known = written(known.unionByName(got.select("url").distinct().withColumn("round", F.lit(k))))
        now = got
    return known
