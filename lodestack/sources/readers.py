"""Scans of queues, packages, manifests, histories, logs, archives and telemetry."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions.scalars import project_score

#: Names of a queue's columns.
HEADER_ALIASES = {"url": ("url", "link", "urls", "links"), "filename": ("filename", "name", "output", "title", "file"), "mode": ("mode", "output_mode", "type")}
_HTTP = "(?i)^https?://"


def _queue(df: DataFrame) -> DataFrame:
    rows = df.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("url", "filename", "mode")])
    return rows.where(F.rlike("url", F.lit(_HTTP)))


def read_queue_csv(spark: SparkSession, path: str) -> DataFrame:
    """url, filename, mode of a CSV whose header has one of the usual names; rows without an http(s) URL go, repeated rows stay."""
    df = spark.read.csv(path, header=True, mode="PERMISSIVE", encoding="UTF-8", ignoreLeadingWhiteSpace=True)
    names = {c.strip().lstrip("\ufeff").lower(): c for c in reversed(df.columns)}
    found = {k: next((names[a] for a in aliases if a in names), None) for k, aliases in HEADER_ALIASES.items()}
    if found["url"] is None:
        return spark.createDataFrame([], "url string, filename string, mode string")
    return _queue(df.select(*[(F.col(f"`{c}`") if c else F.lit("")).alias(k) for k, c in found.items()]))


def read_queue_text(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line, or ``url | filename | mode``; blank lines and ``#`` comments go."""
    lines = spark.read.text(path).where(~F.rlike("value", F.lit(r"^\s*(#|$)"))).select(F.split("value", r"\|").alias("p"))
    return _queue(lines.select(*[F.get("p", F.lit(k)).alias(c) for k, c in enumerate(("url", "filename", "mode"))]))


def read_queue_positional(spark: SparkSession, path: str) -> DataFrame:
    """A list without a header: url, filename, mode by position."""
    df = spark.read.csv(path, header=False)
    first = df.limit(1).collect()
    if first and any(str(c or "").strip().lower() in HEADER_ALIASES["url"] for c in first[0]):
        return read_queue_csv(spark, path)
    cols = [F.col(df.columns[k]) if k < len(df.columns) else F.lit("") for k in range(3)]
    rows = df.select(*[c.alias(n) for c, n in zip(cols, ("url", "filename", "mode"))])
    return _queue(rows.where(~F.startswith(F.trim("url"), F.lit("#"))))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def scan_package(spark: SparkSession, root: str, manifest: str = "checksums.json") -> DataFrame:
    """path, size, sha256, mtime of every file under ``root`` but the manifest."""
    base = re.sub(r"^[a-z]+:/*", "/", root.rstrip("/")) + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(base), "")
    return files.select(rel.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("mtime")).where(F.col("path") != manifest)


def _json_documents(spark: SparkSession, path: str) -> DataFrame:
    """v (variant; null if it can't be read): each file is a JSON document, or has one a line."""
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("whole"), F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    each = (F.size("lines") > 1) & F.forall("lines", lambda x: F.rlike(x, F.lit(r"^\s*\{.*\}\s*$")))  # the parser takes the first of several documents
    lines = F.when(each, F.transform("lines", F.try_parse_json)).otherwise(F.array("whole"))
    return text.select(F.explode(lines).alias("v"))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows path, sha256, size) and (issues) of a manifest's ``files``."""
    files = _json_documents(spark, path).select(F.try_variant_get("v", "$.files", "variant").alias("files"))
    files.createOrReplaceTempView("lodestack_manifest")
    rows = spark.sql("SELECT e.key AS path, schema_of_variant(e.value) AS kind, e.value AS value FROM lodestack_manifest, LATERAL variant_explode(files) AS e")
    good = F.startswith("kind", F.lit("OBJECT"))
    entries = rows.where(good).select("path", F.lower(F.try_variant_get("value", "$.sha256", "string")).alias("sha256"), F.try_variant_get("value", "$.size", "long").alias("size"))
    issues = rows.where(~good).select(F.lit("invalid manifest entry").alias("issue")).unionByName(files.where("files is null").select(F.lit("invalid or unreadable").alias("issue")))
    return entries, issues


def _keyed(spark: SparkSession, path: str, view: str) -> DataFrame:
    _json_documents(spark, path).createOrReplaceTempView(view)
    return spark.sql(f"SELECT e.key AS key, e.value AS value, schema_of_variant(e.value) AS kind FROM {view}, LATERAL variant_explode(v) AS e")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    rows = _keyed(spark, path, "lodestack_history").where(F.startswith("kind", F.lit("OBJECT")))
    get = lambda n, t="string": F.try_variant_get("value", f"$.{n}", t).alias(n)
    return rows.select(F.col("key").alias("url"), get("file_name"), get("mode"), get("success", "boolean"), get("last_downloaded").try_cast("timestamp").alias("last_downloaded"), get("etag"), get("last_modified"), get("content_length"))


def read_cache_index(spark: SparkSession, path: str) -> DataFrame:
    rows = _keyed(spark, path, "lodestack_cache").select(F.col("key").alias("url"), F.lower(F.trim(F.try_variant_get("value", "$", "string"))).alias("digest"))
    return rows.where(F.rlike("digest", F.lit("^[0-9a-f]{64}$")))


def read_resume(spark: SparkSession, path: str) -> DataFrame:
    """url, state (completed or failed), updated_at of a saved run; what isn't text goes."""
    v = _json_documents(spark, path)
    at = F.try_variant_get("v", "$.updated_at", "string").alias("updated_at")
    parts = [v.select(F.explode(F.try_variant_get("v", f"$.{s}", "array<variant>")).alias("x"), at).where(F.schema_of_variant("x") == "STRING").select(F.try_variant_get("x", "$", "string").alias("url"), F.lit(s).alias("state"), "updated_at") for s in ("completed", "failed")]
    return parts[0].unionByName(parts[1])


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """section, url, error of a failure log: each row with the time of the header above it."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    head = F.regexp_extract("line", r"^#\s*---\s*(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1)
    section = F.last(F.when(head != "", head), ignorenulls=True).over(Window.partitionBy("file").orderBy("pos"))
    rows = lines.withColumn("section", section).where(~F.rlike("line", F.lit(r"^\s*(#|$)"))).withColumn("p", F.split("line", "\t", 2))
    return rows.select(F.col("section").try_cast("timestamp").alias("section"), F.trim(F.get("p", F.lit(0))).alias("url"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("error"))


def explode_archives(files: DataFrame, depth: int = 2, largest: int = 512 << 20) -> DataFrame:
    """archive, member, is_dir, file_size, compress_size of the ZIP files in (path, content), and of ZIPs in them down to ``depth``; an inner ZIP of over
    ``largest`` bytes is a member like others. One archive's content is in memory at a time."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(name: str, data: bytes, level: int) -> list[tuple]:
            out = []
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for i in z.infolist():
                        out.append((name, i.filename, i.is_dir(), i.file_size, i.compress_size))
                        if level < depth and i.filename.lower().endswith(".zip") and i.file_size <= largest:
                            out += rows(f"{name}!{i.filename}", z.read(i), level + 1)
            except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
                pass
            return out

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(rows(path, content, 1), columns=["archive", "member", "is_dir", "file_size", "compress_size"])

    return files.select("path", "content").mapInPandas(members, "archive string, member string, is_dir boolean, file_size long, compress_size long")


def read_projects(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``payload`` (variant) for rows whose text is a project's JSON, or holds one between its first and last brace."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    rows = df.withColumn("payload", F.coalesce(F.try_parse_json(text), F.try_parse_json(inner)))
    return rows.where(project_score(F.col("payload")) >= 4)


def read_library(df: DataFrame) -> DataFrame:
    return df.where(F.trim(F.coalesce("source_url", F.lit(""))) != "")


def read_telemetry_stream(spark: SparkSession, path: str, schema: str = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") -> DataFrame:
    """Telemetry as a stream, with an event time that takes watermarks."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


#: What a log line says of a job's state, in the order to look for it.
LOG_STATES = (
    ("RESOLVING", "resolving project source|project search start|cyoa\\.cafe detected"), ("FETCHING_ENTRY", "fetching page html|website download started"),
    ("DISCOVERING_ASSETS", "(?s)deep scan|candidate\\(s\\)|found .*asset|asset.*found "), ("REWRITING", "re-analysed:|rewrit|localiz"), ("VERIFYING", "integrity check|verification"),
    ("PACKAGING", "zip created|saving:|finaliz|packag"),
)


def parse_log_events(df: DataFrame, column: str = "line") -> DataFrame:
    """``df`` with a row (type, state, name, done, total, error) per event of a log line.

    A state's words make ``stage_changed``, else a retry ``file_retry``, else "asset:" ``file_completed``. ``[done/total] name`` overrides these: ``asset_discovered``
    with the total, then ``file_completed``, or ``file_failed`` where the line has a cross or says so.
    """
    c, low = F.col(column), F.lower(column)
    pattern = r"\[(\d+)\s*/\s*(\d+)\]\s*(?:✓|✗|FAILED|OK)?\s*(.*)"
    done, total = (F.regexp_extract(c, pattern, g) for g in (1, 2))
    name = F.trim(F.regexp_extract(c, pattern, 3))
    none = F.lit(None).cast("string")

    def one(kind: Column, state: Column = none, own: Column = none, error: Column = none, at: Column = none, of: Column = none) -> Column:
        return F.struct(kind.alias("type"), state.alias("state"), own.alias("name"), at.try_cast("int").alias("done"), of.try_cast("int").alias("total"), error.alias("error"))

    state = none
    for s, p in reversed(LOG_STATES):
        state = F.when(F.rlike(low, F.lit(p)), s).otherwise(state)
    retry = F.contains(low, F.lit("retry")) & F.rlike(low, F.lit("attempt|backoff"))
    asset = F.trim(F.substring_index(c, "Asset:", -1))
    said_failed = F.contains(low, F.lit("failed"))
    failed = said_failed | F.contains(c, F.lit("✗"))
    counted = F.array(one(F.lit("asset_discovered"), of=total), one(F.when(failed, "file_failed").otherwise("file_completed"), own=name, error=F.when(said_failed, c).otherwise(""), at=done))
    events = (
        F.when(done != "", counted).when(state.isNotNull(), F.array(one(F.lit("stage_changed"), state))).when(retry, F.array(one(F.lit("file_retry"))))
        .when(F.contains(low, F.lit("asset:")), F.array(one(F.lit("file_completed"), own=asset)))
    )
    return df.select("*", F.explode(events).alias("e")).select(*df.columns, "e.*")
