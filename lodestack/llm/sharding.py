"""Shards of near equal bytes by sampled splitters over the key range of the texts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import row_hash, written

#: Least ranges per shard, bytes per range beyond those, the most ranges at all, and sampled keys per range: they bound what the driver holds (ranges
#: x sampled keys).
RANGES_PER_SHARD, RANGE_BYTES, MOST_RANGES, SAMPLES_PER_RANGE = 12, 1 << 30, 16_384, 32

#: A group of equal texts up to this share of a shard lies in one shard.
WHOLE_GROUP = 0.01


class Splitters:
    """Sorted boundaries over (key, tie); range i holds what lies from boundary i-1 up to, not including, boundary i."""

    def __init__(self, points: list[tuple[int, int]]) -> None:
        keys = sorted(k for k, _ in points)
        hot = {a for a, b in zip(keys, keys[1:]) if a == b}
        least = np.iinfo(np.int64).min
        self.points = sorted({(k, t if k in hot else least) for k, t in points})  # only a key that fills ranges alone is cut by the tie
        self.keys = np.array([k for k, _ in self.points], np.int64)
        self.ties = np.array([t for _, t in self.points], np.int64)

    def ranges(self, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        first, last = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        for at in np.flatnonzero(np.bincount(first[last > first], minlength=1)):
            own = (first == at) & (last > first)
            first[own] = at + np.searchsorted(self.ties[at : last[own][0]], tie[own], "right")
        return first


def _with_range(df: DataFrame, splitters: Splitters) -> DataFrame:
    @F.pandas_udf("int")
    def range_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(splitters.ranges(key.to_numpy(np.int64), tie.to_numpy(np.int64)), dtype="int32")

    return df.withColumn("range", range_of("key", "tie"))


def _drawn(df: DataFrame, share: float, target: float, seed: int) -> list[tuple[int, int]]:
    """Splitters about ``target`` bytes apart, from a sample in which a row comes with a chance of size x share."""
    uniform = F.pmod(F.xxhash64(F.lit(seed), "tie"), F.lit(1 << 30)) / float(1 << 30)
    sample = sorted((r.key, r.tie) for r in df.where(uniform < F.col("size") * share).select("key", "tie").collect())
    step = max(1, round(target * share))
    return sample[step::step]


def assign_shards(df: DataFrame, n_shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, seed: int = 7) -> DataFrame:
    """One row per row of ``df``: doc_id, size, text_crc32, law, shard, slot, grown_shard; the shards' sizes are near equal.

    A row's size is the UTF-8 bytes of its text (a null text: none; its CRC is that of "") plus ``overhead``. Rows are ordered by
    a hash of the text and a tie (rows equal in text and id have ties of their own), so copies are neighbours. A sample weighted by size gives the splitters of some ranges per shard; ranges
    of more than twice their due are subdivided by splitters drawn in them, a group of copies by the tie. Then the bytes before each row are
    known exactly from the ranges' totals and a running sum in each range, and say the shard: each shard's size is off by at most its
    border rows or a group of copies of under 1 % of a shard. Slots count from 0 without gaps. Repeated rows each get a slot; rows with a null id
    too. An empty table gives an empty result. Other columns are not read. Only narrow rows (no text) are shuffled.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = written(rows.withColumn("tie", F.xxhash64(F.lit(seed), row_hash("doc_id"), F.monotonically_increasing_id())))  # fixed by writing it
    total = rows.agg(F.sum("size")).first()[0] or 0
    n_ranges = min(MOST_RANGES, max(n_shards * RANGES_PER_SHARD, total // RANGE_BYTES))
    target = max(1.0, total / n_ranges)
    share = SAMPLES_PER_RANGE / target
    points = _drawn(rows, share, target, seed)
    for extra in range(3):
        ranged = _with_range(rows, Splitters(points))
        overfull = [r["range"] for r in ranged.groupBy("range").agg(F.sum("size").alias("b")).where(F.col("b") > 2 * target).select("range").collect()]
        if not overfull or extra == 2:
            break
        more = _drawn(ranged.where(F.col("range").isin(overfull)), share * 4, target / 2, seed + 1 + extra)
        if not set(more) - set(points):
            break
        points += more
    ranged = written(ranged)
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    up_to = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range: at most a few times MOST_RANGES
    starts = sums.select("range", *[F.coalesce(F.sum(c).over(up_to), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows")])
    within = Window.partitionBy("range").orderBy("key", "tie", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("range", "key")
    placed = ranged.withColumns({"upto": F.sum("size").over(within), "row": F.count("*").over(within)})
    placed = placed.withColumns({"group_upto": F.min(F.col("upto") - F.col("size")).over(group), "group_size": F.sum("size").over(group)})
    placed = placed.join(F.broadcast(starts), "range")
    due = max(1.0, total / n_shards)
    middle = F.when(F.col("group_size") <= WHOLE_GROUP * due, F.col("group_upto") + F.col("group_size") / 2).otherwise(F.col("upto") - F.col("size") / 2)
    shard = F.least(F.floor((F.col("bytes_before") + middle) / F.lit(due)), F.lit(n_shards - 1)).cast("int")
    placed = placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("row") - 1).alias("at"))
    placed = written(placed)
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, shards: DataFrame, path: str, *, id_col: str = "doc_id") -> None:
    """Write the rows of ``df`` into one folder per shard, by ``assign_shards``'s result for ids that are unique; a shard's files are in slot order."""
    own = shards.select(F.col("doc_id").alias("__id"), "shard", "slot")
    n = max(1, math.ceil(shards.agg(F.max("shard")).first()[0] or 0) + 1)
    both = df.join(own, F.col(f"`{id_col}`") == F.col("__id")).drop("__id")
    both.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
