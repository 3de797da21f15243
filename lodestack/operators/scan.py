"""Running values over an order, by ranges of it: no task sees more than a range, however large the table or a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.shared import written

#: Groups of at least this share of all rows (and 1,000 rows), so at most 100,000 groups, get their totals by broadcast.
HOT_SHARE = 1e-5


class Scan:
    """A table cut once into ranges of (group, order), and values that run along each group.

    The ranges are written, so later passes see the same ones. A running value is computed within ranges, summed up to one row a range and group, carried
    over those rows, and put together: that works for any associative function, here sums, maxima, the last value, and the row before. Only the carrying
    passes through one task a group, with one row a range.
    """

    def __init__(self, df: DataFrame, order: list[str], group: list[str] | None = None) -> None:
        self.order, self.group = order, group or []
        n = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        self.columns = df.columns
        self.df = written(df.repartitionByRange(n, *self.group, *order).withColumn("__p", F.spark_partition_id()))

    def _carried(self, summary: Column, carry: Column) -> None:
        """``self.df`` with __c: the summaries of a row's earlier ranges, put together by the window function ``carry`` of __s."""
        earlier = Window.partitionBy(*self.group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        each = self.df.groupBy("__p", *self.group).agg(summary.alias("__s"))
        before = each.select(F.col("__p").alias("__q"), *[F.col(c).alias(f"__g_{k}") for k, c in enumerate(self.group)], carry.over(earlier).alias("__c"))
        same = F.col("__p") == F.col("__q")
        for k, c in enumerate(self.group):
            same &= F.col(c).eqNullSafe(F.col(f"__g_{k}"))
        self.df = self.df.join(before, same).drop("__q", *[f"__g_{k}" for k in range(len(self.group))])

    def _within(self) -> Window:
        return Window.partitionBy("__p", *self.group).orderBy(*self.order)

    def _add(self, name: str, value: Column, summary: Column, carry: Column, own: Column, together: Column) -> Scan:
        self.df = self.df.withColumn("__v", value)
        self._carried(summary, carry)
        upto = self._within().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.df = self.df.withColumn("__o", own.over(upto)).withColumn(name, together).drop("__v", "__o", "__c")
        self.columns = [*self.columns, name]
        return self

    def sum(self, name: str, value: Column) -> Scan:
        return self._add(name, value, F.sum("__v"), F.sum("__s"), F.sum("__v"), F.col("__o") + F.coalesce("__c", F.lit(0)))

    def max(self, name: str, value: Column) -> Scan:
        return self._add(name, value, F.max("__v"), F.max("__s"), F.max("__v"), F.greatest("__o", "__c"))

    def last(self, name: str, value: Column) -> Scan:
        """The last value so far that isn't null."""
        newest = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*self.order)))
        return self._add(name, value, newest, F.last("__s", ignorenulls=True), F.last("__v", ignorenulls=True), F.coalesce("__o", "__c"))

    def before(self, name: str, value: Column) -> Scan:
        """The value of the row before; null for a group's first."""
        self.df = self.df.withColumn("__v", F.struct(value.alias("v")))
        self._carried(F.max_by("__v", F.struct(*self.order)), F.last("__s"))
        self.df = self.df.withColumn(name, F.coalesce(F.lag("__v").over(self._within()), "__c")["v"]).drop("__v", "__c")
        self.columns = [*self.columns, name]
        return self

    def result(self) -> DataFrame:
        return self.df.select(*[F.col(f"`{c}`") for c in self.columns])


def running(df: DataFrame, value: Column, order: list[str], group: list[str] | None = None) -> DataFrame:
    """``df`` with ``upto``, the sum of ``value`` up to each row in ``order``, in each ``group`` or over the whole table."""
    return Scan(df, order, group).sum("upto", value).result()


def with_totals(df: DataFrame, group: list[str], **totals: Column) -> DataFrame:
    """``df`` with aggregates of each row's group. Tasks add up before the shuffle; totals of hot groups, a bounded number, go back by broadcast, so their
    rows stay where they are; others are joined by the group. A null is a value of a group."""
    each = df.groupBy(*group).agg(F.count("*").alias("__rows"), *[c.alias(k) for k, c in totals.items()])
    each = written(each.withColumnsRenamed({c: f"__k{k}" for k, c in enumerate(group)}))
    least = max(1000, int((each.agg(F.sum("__rows")).first()[0] or 0) * HOT_SHARE))
    hot, others = each.where(F.col("__rows") >= least), each.where(F.col("__rows") < least)
    same = F.lit(True)
    for k, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"__k{k}"))
    names = [*[F.col(f"`{c}`") for c in df.columns], *totals]
    return df.join(F.broadcast(hot), same).select(*names).unionByName(df.join(F.broadcast(hot), same, "left_anti").join(others, same).select(*names))
