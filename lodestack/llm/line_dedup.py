"""Site-relative line deduplication: lines on too large a share of a site's pages go (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import written

#: Up to so many boilerplate lines (16 bytes each) are broadcast; more are joined by a shuffle, each site in as many parts as that has partitions.
MOST_BROADCAST_LINES = 1_000_000

#: A line is boilerplate on a site where it is on more than this share of the pages and on at least so many.
MAX_RATIO, LEAST_PAGES = 0.05, 3


def _key(line: Column) -> Column:
    """128 bits of a line without white space around it, as struct; lines of a site with one key count as equal."""
    line = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate_lines(df: DataFrame, *, max_ratio: float = MAX_RATIO, least_pages: int = LEAST_PAGES, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Per site the boilerplate lines: site, pages, lines (array of keys).

    Pages of a site with one and the same text count once, as copies say nothing about a site's layout.
    A site's array is short at any size of the site: a page has L lines on average, so at most
    L / max_ratio lines can be on a share ``max_ratio`` of its pages.
    """
    pages = df.select(F.col(f"`{site_col}`").alias("site"), F.col(f"`{text_col}`").cast("string").alias("body")).where("body is not null")
    copy = F.xxhash64("body")
    lines = pages.select("site", copy.alias("copy"), F.explode(F.array_distinct(F.transform(F.filter(F.split("body", "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), _key))).alias("line"))
    totals = pages.groupBy("site").agg(F.count_distinct(copy).alias("pages"))
    found = lines.groupBy("site", "line").agg(F.count_distinct("copy").alias("n")).where(F.col("n") >= least_pages)
    found = found.withColumnRenamed("site", "its").join(totals, F.col("its").eqNullSafe(F.col("site")))
    return found.where(F.col("n") > max_ratio * F.col("pages")).groupBy("site", "pages").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(df: DataFrame, *, max_ratio: float = MAX_RATIO, least_pages: int = LEAST_PAGES, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``df`` with the boilerplate lines taken out of ``text_col``, and two more columns: lines_total, lines_dropped.

    Every row stays, with all its columns. A line counts without the white space around it; lines without a word
    are never boilerplate and stay. A null text stays null with 0 lines; a text all of whose lines are boilerplate
    becomes "". Rows without a site form one site. Repeated rows count once and are all cleaned. A site with fewer than
    ``least_pages`` different texts has no boilerplate. Columns of df named like those added are replaced.

    The counts are pre-aggregated before each shuffle. The short per-site arrays are broadcast up to a bound of their size, so texts stay where
    they are read; beyond it texts are dealt by site and a part of it, so that a hot site isn't one task.
    """
    sites = boilerplate_lines(df, max_ratio=max_ratio, least_pages=least_pages, text_col=text_col, site_col=site_col)
    sites = written(sites.select(F.col("site").alias("__site"), F.col("lines").alias("__lines")))
    few = (sites.agg(F.sum(F.size("__lines"))).first()[0] or 0) <= MOST_BROADCAST_LINES
    kept_cols = [c for c in df.columns if c not in ("lines_total", "lines_dropped")]
    body = F.col(f"`{text_col}`").cast("string")
    own, same = df.select(*[F.col(f"`{c}`") for c in kept_cols]), F.col(f"`{site_col}`").eqNullSafe(F.col("__site"))
    if few:
        own = own.join(F.broadcast(sites), same, "left")
    else:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = sites.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        own = own.withColumn("__of", F.pmod(F.xxhash64(body), F.lit(n)).cast("int")).join(parts, same & (F.col("__of") == F.col("__part")), "left")
    split = F.split(body, "\n", -1)
    clean = F.filter(split, lambda x: ~F.array_contains(F.col("__lines"), _key(x)))
    own = own.withColumn("__kept", F.when(F.col("__lines").isNull(), split).otherwise(clean))
    total, left = F.coalesce(F.size(split), F.lit(0)), F.coalesce(F.size("__kept"), F.lit(0))
    columns = [F.array_join("__kept", "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in kept_cols]
    return own.select(*columns, F.when(body.isNull(), 0).otherwise(total).cast("long").alias("lines_total"), F.when(body.isNull(), 0).otherwise(total - left).cast("long").alias("lines_dropped"))
