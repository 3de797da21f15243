"""Small helpers shared by the training-text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.shared import shared_folder, written
from lodestack.shipping import ship

__all__ = ["shared_folder", "written"]

#: A word is a run of anything but the six ASCII white-space characters.
WORD_SEPARATOR = r"[\x20\x09-\x0D]+"

#: Odd multipliers of the 64-bit mixing steps.
_MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


#: Rows of an Arrow batch between Spark and Python, unless the session asks for fewer: texts are long, and both sides hold a batch whole.
ROWS_PER_BATCH = 1000

#: Bytes of such a batch, and rows that Spark's Parquet reader holds at once (it doubles one array for all their texts), at most.
BYTES_PER_BATCH, ROWS_PER_READ = 2 << 20, 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ROWS_PER_BATCH:
        spark.conf.set(rows, str(ROWS_PER_BATCH))
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH), ("spark.sql.parquet.columnarReaderBatchSize", ROWS_PER_READ)):
        if not 0 < int(spark.conf.get(key).removesuffix("b")) <= most:
            spark.conf.set(key, str(most))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(*cols: str | Column) -> Column:
    """A well-mixed 64-bit value of the columns; nulls count as a value of their own."""
    return F.xxhash64(*[c for col in cols for c in (col, F.isnull(col))])


_CACHE: dict[str, Any] = {}


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task, made by ``make``: one thing at a time, so operators that follow each other don't add up."""
    if name not in _CACHE:
        _CACHE.clear()
        _CACHE[name] = make()
    return _CACHE[name]


class Memory(dict):
    """What a worker has computed before, by key (str or bytes), in at most about ``limit`` bytes.

    A full memory takes nothing more, since what is frequent comes early; when it no longer helps it starts anew.
    """

    #: What Python adds to the bytes of a key and its value.
    EACH = 160

    def __init__(self, limit: int = 32 << 20) -> None:
        super().__init__()
        self.limit, self.held = limit, 0

    def keep(self, found: dict, asked: int, value_bytes: int = 0, missed: int | None = None) -> None:
        """``found``: what a slice had to compute of the ``asked`` different keys that it has. ``missed``: how many were missed, if both count repeats."""
        if self.held >= self.limit and 2 * (len(found) if missed is None else missed) > asked:
            self.clear()
            self.held = 0
        for key, value in found.items():
            if self.held >= self.limit:
                break
            self[key] = value
            self.held += len(key) + self.EACH + (len(value) if value_bytes else 0)


#: A word's hash is the sum of a number for each letter times one for its place; longer words are hashed by xxhash.
_LONGEST = 64
_IS_WHITE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _MULTIPLIERS[1]
    x = (x ^ (x >> np.uint64(27))) * _MULTIPLIERS[2]
    return x ^ (x >> np.uint64(31))


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIERS[0])
_PLACES = mix(np.arange(1001, 1001 + _LONGEST, dtype=np.uint64) * _MULTIPLIERS[0]) | np.uint64(1)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words (runs of anything but ASCII white space), all texts at once."""
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    white = _IS_WHITE[flat]
    edges = np.flatnonzero(np.diff(white, prepend=True))
    start, stop = edges[::2], edges[1::2]
    lengths = stop - start
    letters = flat[~white]
    offsets = np.cumsum(lengths) - lengths
    place = np.minimum(np.arange(len(letters)) - np.repeat(offsets, lengths), _LONGEST - 1)
    value = np.add.reduceat(_LETTERS[letters] * _PLACES[place], offsets) if len(offsets) else np.zeros(0, np.uint64)
    value = mix(value ^ (lengths.astype(np.uint64) * _MULTIPLIERS[0]))
    for k in np.flatnonzero(lengths > _LONGEST):
        value[k] = xxhash.xxh64_intdigest(flat[start[k] : stop[k]].tobytes())
    ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    return np.split(value, ends[:-1])


def freeing(task: Callable) -> Callable:
    """``task`` (batches to batches) that gives memory which it no longer needs back to the system when it ends, as its worker may idle next."""

    def run(batches: Iterable) -> Iterator:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each window of ``n`` word hashes; a sequence shorter than ``n`` counts as one window, an empty one as none."""
    if not len(words):
        return words
    n = min(n, len(words))
    count = len(words) - n + 1
    value = np.full(count, n, np.uint64)
    for k in range(n):
        value = mix((value * _MULTIPLIERS[0]) ^ words[k : k + count])
    return value


def text_slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Pieces of the batches, each with the Python strings of ``column``; a piece holds ``most_bytes`` of text or one row."""
    for batch in batches:
        texts = batch.column(column)
        sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), dtype=float))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0.0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            piece = batch.slice(start, stop - start)
            yield piece, piece.column(column).to_pylist()
            start = stop


def as_documents(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The columns an operator reads, whatever else the input holds; the text as a string."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`") for c in more])


#: Up to so many labelled rows (about 16 bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST_LABELS = 1_000_000


def with_label(documents: DataFrame, labels: DataFrame, label: str, *, label_id: str = "doc_id", how: str = "left", where: Column | None = None) -> DataFrame:
    """``documents`` (doc_id, ...) with the column ``label``; of several labels of an id the largest counts, null ids and labels don't."""
    own = labels.select(F.col(f"`{label_id}`").alias("__id"), F.col(f"`{label}`").cast("int").alias(label)).dropna()
    own = own.where(where) if where is not None else own
    own = own.groupBy("__id").agg(F.max(label).alias(label))
    few = own.limit(MOST_BROADCAST_LABELS + 1).count() <= MOST_BROADCAST_LABELS
    return documents.join(F.broadcast(own) if few else own, F.col("doc_id") == F.col("__id"), how).drop("__id")
