"""Sinks: queues, logs, manifests, plans, reports, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.aggregates import project_stats
from lodestack.operators.scan import running
from lodestack.operators.windows import retain_newest


def write_queue(df: DataFrame, path: str, fmt: str) -> None:
    """A queue as CSV or as ``url | filename | mode`` lines; rows without a URL go, an empty mode is ``auto``."""
    rows = df.where(F.trim(F.coalesce("url", F.lit(""))) != "").select("url", F.coalesce("filename", F.lit("")).alias("filename"), F.when(F.coalesce("mode", F.lit("")) == "", "auto").otherwise(F.col("mode")).alias("mode"))
    if fmt == "csv":
        rows.write.csv(path, header=True, emptyValue="")
    elif fmt == "txt":
        rows.select(F.concat_ws(" | ", "url", "filename", "mode").alias("value")).write.text(path)
    else:
        raise ValueError(f"a queue is written as csv or txt, not {fmt}")


def _documents(rows: DataFrame, keys: list[str], entry: Column, most: int = 5000) -> DataFrame:
    """``rows`` dealt into groups of about ``most`` by a hash, each group's ``entry`` values in one sorted array: keys..., chunk, entries."""
    n = max(1, -(-rows.count() // most))
    dealt = rows.withColumns({"chunk": F.pmod(F.xxhash64(entry), F.lit(n)), "entry": entry})
    return dealt.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("entry")).alias("entries"))


def append_failures(df: DataFrame, path: str, run_ts: str) -> None:
    """A run's failures (url, error) added to a log's folder, as sections ``# --- time ---`` of lines ``url<TAB>error``; nothing is overwritten."""
    line = F.concat_ws("\t", "url", F.regexp_replace(F.coalesce("error", F.lit("")), r"[\r\n\t]+", " "))
    sections = _documents(df.where(F.trim(F.coalesce("url", F.lit(""))) != ""), [], line)
    sections.select(F.concat_ws("\n", F.lit(f"# --- {run_ts} ---"), "entries").alias("value")).write.mode("append").text(path)


def write_manifest(files: DataFrame, path: str, created_utc: str) -> None:
    """The manifests of packages' files (package, path, sha256, size) as JSON documents in a folder per package; a large package has several."""
    entry = F.struct("path", F.struct("sha256", "size").alias("file"))
    count = files.groupBy("package").agg(F.count("*").alias("file_count"))
    documents = _documents(files.select("package", "path", "sha256", "size"), ["package"], entry).join(count, "package")
    json = F.to_json(F.struct(F.lit(1).alias("manifest_version"), F.lit(created_utc).alias("created_utc"), "file_count", F.map_from_entries("entries").alias("files")))
    documents.select("package", json.alias("value")).write.partitionBy("package").text(path)


def write_archive_plan(pages: DataFrame, failures: DataFrame, state: dict, policy: dict, path: str) -> None:
    """One JSON row: how many pages and failures, whether a limit ended the crawl, what remained, under which policy."""
    n = pages.agg(F.count("*").alias("pages"), F.max("depth").alias("depth"))
    lost = failures.agg(F.count("*").alias("failures")).first()[0]
    n.select("*", F.lit(lost).alias("failures"), F.lit(state["limit"]).alias("limit_reached"), F.lit(state["remaining"]).alias("remaining"), F.lit(str(sorted(policy.items()))).alias("policy")).coalesce(1).write.json(path)


def render_report(log: DataFrame) -> DataFrame:
    """line_no, text of a report over (kind, local, error): totals, then each kind's count and different files in order, then failures."""
    total = log.agg(F.concat(F.lit("Files: "), F.count_distinct("local"), F.lit(", failures: "), F.count_if(F.coalesce("error", F.lit("")) != "")).alias("text")).select(F.lit(0).alias("section"), F.lit("").alias("kind"), F.lit("").alias("file"), "text")
    kinds = log.groupBy("kind").agg(F.count_distinct("local").alias("n")).select(F.lit(1).alias("section"), "kind", F.lit("").alias("file"), F.concat("kind", F.lit(": "), "n").alias("text"))
    files = log.select("kind", "local").distinct().select(F.lit(1).alias("section"), "kind", F.col("local").alias("file"), F.concat(F.lit("  "), "local").alias("text"))
    failed = log.where(F.coalesce("error", F.lit("")) != "").select(F.lit(2).alias("section"), "kind", F.col("local").alias("file"), F.concat(F.lit("FAILED "), "local", F.lit(": "), "error").alias("text"))
    rows = total.unionByName(kinds).unionByName(files).unionByName(failed)
    return running(rows, F.lit(1), ["section", "kind", "file", "text"]).select(F.col("upto").alias("line_no"), "text")


def upsert_history(history: DataFrame, new: DataFrame, cap: int = 1000) -> DataFrame:
    """The newest row of each URL of both, the ``cap`` newest of those."""
    return retain_newest(history.unionByName(new), cap)


def library_insert(library: DataFrame, new: DataFrame, key: str = "file_path") -> DataFrame:
    """The rows of ``new`` that the library hasn't: those to append."""
    return new.dropDuplicates([key]).join(library.select(key).distinct(), key, "left_anti")


def write_resume(df: DataFrame, path: str, updated_at: str) -> None:
    """(url, state completed or failed) of a run as JSON documents of a bounded number of URLs, to be read again."""
    rows = _documents(df.select("url", "state").distinct(), ["state"], F.col("url"))
    of = lambda state: F.when(F.col("state") == state, F.col("entries")).otherwise(F.array().cast("array<string>")).alias(state)
    rows.select(F.to_json(F.struct(of("completed"), of("failed"), F.lit(updated_at).alias("updated_at"))).alias("value")).write.mode("overwrite").text(path)


def write_results(df: DataFrame, path: str) -> None:
    df.select("status", "url", "mode", "filename", "error").write.csv(path, header=True)


def write_project_metadata(projects: DataFrame, path: str) -> None:
    project_stats(projects).write.json(path)
