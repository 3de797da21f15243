"""Queries that rewrite the references of whole pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.rewrite import rewrite_refs
from lodestack.plans.base import Query, register, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _q(sql: str | None = None):
    return register(QUERIES, SQL, sql)


@_q(r"""WITH p AS (SELECT page_id, url, html, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages),
names AS (SELECT DISTINCT host, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS name FROM p UNION SELECT host, url FROM p),
spelt AS (SELECT host, name FROM names WHERE name <> '' UNION SELECT host, replace(name, '/', '\/') FROM names WHERE name <> ''),
rules AS (SELECT host, '(' || string_agg(regexp_escape(name), '|' ORDER BY length(name) DESC, name) || ')' AS rule FROM spelt GROUP BY host)
SELECT page_id, CASE WHEN rule IS NULL THEN html ELSE regexp_replace(html, rule, 'saved\1', 'g') END AS html FROM p LEFT JOIN rules USING (host)""")
def rewritten_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with every link of its site, and every page's own address, replaced wherever they stand."""
    pages = table(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "://([^/?#]*)", 1))
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("old"))
    names = links.unionByName(pages.select("host", F.col("url").alias("old"))).where("old <> ''").distinct()
    files = pages.select("page_id", "host", F.col("html").alias("text"))
    found = rewrite_refs(files, names.withColumn("new", F.concat(F.lit("saved"), "old")), package="host")
    return found.select("page_id", F.col("text").alias("html"))
