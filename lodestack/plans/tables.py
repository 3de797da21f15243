"""Queries over the star schema: histories, queues, archives and graphs made of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import aggregates as agg
from lodestack.operators import joins as jo
from lodestack.operators.iterate import crawl_routes, resume_crawl
from lodestack.operators.windows import cap_per_group, rank_scripts
from lodestack.plans.base import Query, register, table
from lodestack.shared import written
from lodestack.sources.writers import library_insert

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _q(sql: str | None = None):
    return register(QUERIES, SQL, sql)


_DIFF = """h AS (SELECT o_orderkey::VARCHAR AS url, o_orderstatus AS etag, o_orderpriority AS lm, o_custkey::VARCHAR AS len FROM orders WHERE o_orderkey % 5 <> 0),
p AS (SELECT o_orderkey::VARCHAR AS url, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS etag, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS lm, CASE WHEN o_orderkey % 7 = 0 THEN (o_custkey + 1)::VARCHAR ELSE o_custkey::VARCHAR END AS len, CASE WHEN o_orderkey % 11 = 0 THEN 404 ELSE 200 END AS status FROM orders WHERE o_orderkey % 13 <> 0),
d AS (SELECT h.url, CASE WHEN status IS NULL OR status >= 400 THEN 'unreachable' WHEN h.etag <> p.etag OR h.len <> p.len THEN 'updated' ELSE 'current' END AS status,
CASE WHEN status >= 400 THEN 'HTTP ' || status WHEN status IS NULL THEN 'HTTP request failed' ELSE concat_ws(', ', CASE WHEN h.etag <> p.etag THEN 'ETag' END, CASE WHEN h.len <> p.len THEN 'size ' || h.len || '→' || p.len END) END AS reason FROM h LEFT JOIN p ON h.url = p.url)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    url = k.cast("string").alias("url")
    history = o.where(k % 5 != 0).select(url, F.lit(True).alias("success"), F.col("o_orderstatus").alias("etag"), F.col("o_orderpriority").alias("last_modified"), F.col("o_custkey").cast("string").alias("content_length"))
    probes = o.where(k % 13 != 0).select(
        url, F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("etag"), F.when(k % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("last_modified"),
        (F.col("o_custkey") + F.when(k % 7 == 0, 1).otherwise(0)).cast("string").alias("content_length"), F.when(k % 11 == 0, 404).otherwise(200).alias("status"),
    )
    return jo.diff_history(history, probes)


@_q(f"WITH {_DIFF} SELECT * FROM d")
def history_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@_q(f"WITH {_DIFF} SELECT url, '' AS filename, 'auto' AS mode FROM d WHERE status IN ('updated', 'unreachable')")
def requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _diff(spark, sf_dir)
    return jo.requeue(d, d.where("status = 'unreachable'"))


@_q("SELECT o_orderkey AS file_path FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0")
def library_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_path"))
    return library_insert(o.where("file_path % 3 = 0"), o.where("file_path % 2 = 0"))


@_q("WITH q AS (SELECT o_orderkey, o_custkey AS url, count(*) OVER (PARTITION BY o_custkey) AS times FROM orders) SELECT o_orderkey, url, times, times > 1 AS duplicate FROM q")
def queue_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.queue_multiplicity(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("url")))


@_q("WITH q AS (SELECT o_orderkey, o_custkey AS url, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_orderkey, url, url % 4 = 0 AND n = 1 AS skip FROM q")
def resumed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("url"))
    return jo.resume_queue(q, q.where("url % 4 = 0"))


@_q("WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders) SELECT o_custkey, o_orderkey, n, greatest(c - 3, 0) AS more FROM n WHERE n <= 3")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_per_group(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 3)


@_q("""WITH m AS (SELECT l_orderkey AS archive, (l_extendedprice * 1000)::BIGINT AS size, greatest((l_quantity * 3000)::BIGINT, 1) AS packed FROM lineitem) SELECT archive, count(*) AS members, max(size) AS largest, sum(size)::BIGINT AS total, 0 AS unsafe, count(*) FILTER (size > 1048576 AND size > 250 * packed) AS bombs,
count(*) <= 10000 AND max(size) <= 512 * 1048576 AND sum(size) <= 2048 * 1048576::BIGINT AND count(*) FILTER (size > 1048576 AND size > 250 * packed) = 0 AS ok FROM m GROUP BY 1""")
def archive_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    size, packed = F.round(F.col("l_extendedprice") * 1000).cast("long"), F.round(F.col("l_quantity") * 3000).cast("long")
    members = li.select(F.col("l_orderkey").alias("archive"), F.concat(F.lit("m"), "l_linenumber", F.lit(".bin")).alias("member"), F.lit(False).alias("is_dir"), size.alias("file_size"), packed.alias("compress_size"))
    return agg.audit_archives(members)


@_q("""WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT 's1' AS url, 0 AS depth UNION SELECT g.b, r.depth + 1 FROM r JOIN g ON g.a = r.url WHERE r.depth < 12) SELECT url, min(depth) AS depth FROM r GROUP BY 1""")
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph of suppliers and parts, to its end; the SQL stops after 12 steps, more than it has."""
    s, p = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    li = table(spark, sf_dir, "lineitem")
    one = li.select(s.alias("url"), p.alias("target")).unionByName(li.select(p.alias("url"), s.alias("target"))).distinct().withColumn("ord", F.lit(0))
    found, _ = crawl_routes(written(one), spark.createDataFrame([("s1",)], "url string"), max_depth=1000)
    return found.select("url", "depth")


@_q("""WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), have AS (SELECT DISTINCT a FROM g WHERE starts_with(a, 's') AND substr(a, 2)::INT % 2 = 0),
r AS (SELECT DISTINCT g.b AS url, 0 AS depth FROM g JOIN have USING (a) WHERE g.b NOT IN (SELECT a FROM have) UNION SELECT g.b, r.depth + 1 FROM r JOIN g ON g.a = r.url WHERE r.depth < 12 AND g.b NOT IN (SELECT a FROM have))
SELECT url, min(depth) AS depth FROM r GROUP BY 1 UNION ALL SELECT a, -1 FROM have""")
def resumed_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    li = table(spark, sf_dir, "lineitem")
    one = written(li.select(s.alias("url"), p.alias("target")).unionByName(li.select(p.alias("url"), s.alias("target"))).distinct().withColumn("ord", F.lit(0)))
    have = one.where("url like 's%' and cast(substr(url, 2) as int) % 2 = 0").select("url").distinct()
    return resume_crawl(one, have, max_depth=1000)[0].select("url", "depth")
