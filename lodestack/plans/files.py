"""Queries over ``documents`` as a table of files: package = source, path = lang/doc_id.txt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.scalars import format_bytes, redact, redaction_hits
from lodestack.operators import aggregates as agg
from lodestack.operators import joins as jo
from lodestack.operators import windows as wi
from lodestack.plans.base import Query, register, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_F = "f AS (SELECT doc_id, source AS package, lang || '/' || doc_id || '.txt' AS path, sha256(text) AS sha256, length(text) AS size, text FROM documents)"
_M = "m AS (SELECT package, path, size, CASE WHEN doc_id % 13 = 0 THEN reverse(sha256) ELSE sha256 END AS sha256 FROM f WHERE doc_id % 17 <> 0)"
_D = "d AS (SELECT coalesce(m.package, g.package) AS package, coalesce(m.path, g.path) AS path, CASE WHEN g.sha256 IS NULL THEN 'missing' WHEN m.sha256 IS NULL THEN 'extra' WHEN m.sha256 = g.sha256 THEN 'intact' ELSE 'corrupted' END AS status FROM m FULL JOIN g ON m.package = g.package AND m.path = g.path)"
_G = "g AS (SELECT * FROM f WHERE doc_id % 19 <> 0)"


def _q(sql: str | None = None):
    return register(QUERIES, SQL, sql)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("package"), F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.length("text").cast("long").alias("size"), "text")


def _manifest(files: DataFrame) -> DataFrame:
    return files.where(F.col("doc_id") % 17 != 0).select("package", "path", "size", F.when(F.col("doc_id") % 13 == 0, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))


def _on_disk(files: DataFrame) -> DataFrame:
    return files.where(F.col("doc_id") % 19 != 0)


@_q(f"WITH {_F} SELECT package, path, size, sha256 FROM f")
def package_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("package", "path", "size", "sha256")


@_q(f"WITH {_F} SELECT package, path, first_value(path) OVER (PARTITION BY package, sha256 ORDER BY doc_id, path) AS kept FROM f")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wi.dedup_content(_files(spark, sf_dir), order="doc_id").select("package", "path", "kept")


@_q(f"WITH {_F} SELECT sha256, count(*) AS n, min(doc_id) AS first FROM f GROUP BY 1 HAVING count(*) > 1")
def duplicate_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@_q("WITH p AS (SELECT doc_id AS ord, lang || '/' || (doc_id % 50) || '.txt' AS path FROM documents), n AS (SELECT ord, path, row_number() OVER (PARTITION BY path ORDER BY ord) - 1 AS n FROM p) SELECT ord, path, CASE WHEN n = 0 THEN path ELSE regexp_replace(path, '\\.txt$', '') || '_' || n || '.txt' END AS local FROM n")
def collision_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return wi.assign_paths(d.select(F.col("doc_id").alias("ord"), F.concat("lang", F.lit("/"), F.col("doc_id") % 50, F.lit(".txt")).alias("path"))).select("ord", "path", "local")


@_q(f"WITH {_F}, c AS (SELECT path, size, sum(size) OVER (ORDER BY doc_id, path ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM f) SELECT path, size FROM c WHERE total - (upto - size) > 100000")
def lru_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wi.evict_lru(_files(spark, sf_dir).select("path", "size", F.col("doc_id").alias("mtime")), 100_000).select("path", "size")


@_q(f"WITH {_F}, c AS (SELECT package, path, least(size, 5000) AS take, sum(least(size, 5000)) OVER (PARTITION BY package ORDER BY path ROWS UNBOUNDED PRECEDING) - least(size, 5000) AS before FROM f) SELECT package, path, least(take, 20000 - before) AS take FROM c WHERE before < 20000")
def scan_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wi.cap_scan(_files(spark, sf_dir), "package", 20_000, 5_000).select("package", "path", F.col("take").cast("long").alias("take"))


@_q(f"WITH {_F}, {_M}, {_G}, {_D} SELECT package, status, count(*) AS n FROM d GROUP BY ALL")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    return jo.diff_manifest(_manifest(f), _on_disk(f)).groupBy("package", "status").agg(F.count("*").alias("n"))


@_q(f"""WITH {_F}, {_M}, {_G}, {_D}, r AS (SELECT package, path FROM f WHERE doc_id % 3 = 0), lost AS (SELECT package FROM r WHERE path NOT IN (SELECT path FROM g WHERE g.package = r.package)),
i AS (SELECT package, count(*) FILTER (status <> 'extra') AS b, count(*) FILTER (status = 'extra') AS n FROM d WHERE status <> 'intact' GROUP BY 1), l AS (SELECT package, count(*) AS b FROM lost GROUP BY 1),
j AS (SELECT package, CASE WHEN k IN (1, 2) THEN 1 ELSE 0 END AS b, CASE WHEN k IN (3, 4) THEN 1 ELSE 0 END + CASE WHEN k < 4 THEN 1 ELSE 0 END AS n FROM (SELECT DISTINCT package, ascii(right(package, 1)) % 5 AS k FROM f)),
v AS (SELECT j.package, coalesce(i.b, 0) + coalesce(l.b, 0) + j.b AS issues, coalesce(i.n, 0) + j.n AS notes FROM j LEFT JOIN i USING (package) LEFT JOIN l USING (package))
SELECT package, issues, notes, issues = 0 AS ok FROM v UNION ALL SELECT 'gone', 1, 0, false""")
def package_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a project.json of one of four kinds, or none, in each package; one package has no files."""
    f = _files(spark, sf_dir)
    k = F.ascii(F.right("package", F.lit(1))) % 5
    text = F.get(F.array(*map(F.lit, ('{"rows":[],"title":"t"}', "[1]", "{broken", '{"a":1}'))), k)
    roots = f.select("package").distinct().where(k < 4).select("package", F.lit("project.json").alias("path"), F.lit("r").alias("sha256"), F.length(text).cast("long").alias("size"), text.alias("text"))
    disk = _on_disk(f).select("package", "path", "sha256", "size", F.lit(None).cast("string").alias("text")).unionByName(roots)
    refs = f.where(F.col("doc_id") % 3 == 0).select("package", F.col("path").alias("ref"))
    every = f.select("package").distinct().union(spark.createDataFrame([("gone",)], "package string"))
    return agg.verify_packages(disk, jo.diff_manifest(_manifest(f), disk), jo.missing_refs(refs, disk), every)


@_q(f"WITH {_F}, {_G} SELECT package, path AS ref FROM f WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.package = f.package AND g.path = f.path)")
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    return jo.missing_refs(f.select("package", F.col("path").alias("ref")), _on_disk(f))


@_q(f"WITH {_F}, {_G} SELECT package, count(*) AS refs, count(*) FILTER (EXISTS (SELECT 1 FROM g WHERE g.package = f.package AND g.path = f.path)) AS ok FROM f GROUP BY 1")
def integrity_by_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    refs = f.select("package", F.concat("package", F.lit(".html")).alias("owner"), F.concat(F.lit("./"), "path", F.lit("?v=1")).alias("ref"))
    return jo.check_integrity(refs, _on_disk(f)).groupBy("package").agg(F.count("*").alias("refs"), F.count_if("ok").alias("ok"))


@_q(f"WITH {_F}, {_M}, {_G}, r AS (SELECT m.path AS url, m.sha256 AS digest, m.sha256 IN (SELECT sha256 FROM g) AS hit FROM m) SELECT hit, count(*) AS n, min(url) AS first FROM r GROUP BY 1")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    m = _manifest(f)
    found = jo.lookup_cache(m.select(F.col("path").alias("url")), m.select(F.col("path").alias("url"), F.col("sha256").alias("digest")), _on_disk(f))
    return found.groupBy("hit").agg(F.count("*").alias("n"), F.min("url").alias("first"))


@_q(f"WITH {_F}, s AS (SELECT sha256, count(*) AS n, max(size) AS size FROM f GROUP BY 1) SELECT sum(n)::BIGINT AS entries, count(*) AS files, floor(sum(size) / 1048576)::BIGINT AS mib, 2048 AS limit_mib FROM s")
def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.cache_stats(_files(spark, sf_dir).withColumnRenamed("sha256", "digest"))


@_q(f"WITH {_F}, e AS (SELECT DISTINCT regexp_extract(path, '^([^/]*)', 1) AS kind, path FROM f) SELECT kind, path, count(*) OVER (PARTITION BY kind) AS n FROM e")
def kind_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.files_by_kind(_files(spark, sf_dir).withColumn("kind", F.regexp_extract("path", "^([^/]*)", 1)), "kind", "path")


@_q(f"WITH {_F} SELECT regexp_extract(path, '^([^/]*)', 1) AS kind, count(DISTINCT path) AS n, min(path) AS first, max(path) AS last FROM f GROUP BY 1")
def files_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.summarise_by_kind(_files(spark, sf_dir).withColumn("kind", F.regexp_extract("path", "^([^/]*)", 1)), "kind", "path")


_BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}"
_SECRET = r"""(?i)\b(api[_-]?key|token|password|passwd|secret|cookie|authorization|credential|bearer)\b(\s*[:=]\s*|[''"]?\s*:\s*[''"]?)([^,\s''"}]{6,}|[''"][^''"]{6,}[''"])"""


@_q(f"""WITH b AS (SELECT doc_id, source, len(regexp_extract_all(text, '{_BEARER}')) AS h1, regexp_replace(text, '{_BEARER}', 'Bearer __REDACTED__', 'g') AS t FROM documents)
SELECT doc_id, source, h1 + len(regexp_extract_all(t, '{_SECRET}')) AS hits, sha256(regexp_replace(t, '{_SECRET}', '\\1\\2__REDACTED__', 'g')) AS digest FROM b""")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", redaction_hits(F.col("text")).cast("long").alias("hits"), F.sha2(redact(F.col("text")).cast("binary"), 256).alias("digest"))


@_q("""WITH s AS (SELECT strlen(text)::DOUBLE AS b FROM documents) SELECT CASE WHEN b < 1024 THEN printf('%.0f B', b) WHEN b / 1024 >= 100 THEN printf('%.0f KB', b / 1024) WHEN b / 1024 >= 10 THEN printf('%.1f KB', b / 1024) ELSE printf('%.2f KB', b / 1024) END AS size, count(*) AS n FROM s GROUP BY 1""")
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(format_bytes(F.octet_length("text")).alias("size")).agg(F.count("*").alias("n"))


@_q(f"WITH {_F}, {_M}, {_G} SELECT 'recorded only' AS side, package, count(*) AS n FROM (SELECT package, path FROM m EXCEPT SELECT package, path FROM g) GROUP BY ALL UNION ALL SELECT 'disk only', package, count(*) FROM (SELECT package, path FROM g EXCEPT SELECT package, path FROM m) GROUP BY ALL UNION ALL SELECT 'both', package, count(*) FROM (SELECT package, path FROM m INTERSECT SELECT package, path FROM g) GROUP BY ALL")
def path_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    m, g = _manifest(f).select("package", "path"), _on_disk(f).select("package", "path")
    side = lambda name, df: df.groupBy("package").agg(F.count("*").alias("n")).withColumn("side", F.lit(name))
    return side("recorded only", m.subtract(g)).unionByName(side("disk only", g.subtract(m))).unionByName(side("both", m.intersect(g))).select("side", "package", "n")


