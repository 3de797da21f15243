"""Exact deduplication by an extendible-hash index in the shared folder: a directory that doubles, buckets by key range, owners that compare bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import as_documents, freeing, text_slices, written

#: A bucket is overfull beyond so many bytes of different texts, or beyond its share of a task where that is less (BUCKETS_PER_TASK for each shuffle partition).
BUCKET_BYTES, BUCKETS_PER_TASK = 64 << 20, 8

#: The directory has at most 2^MOST_DEPTH slots (8 bytes each on the driver and in tasks); a bucket of that depth is never split, only longer.
MOST_DEPTH = 20

#: A task that reads texts combines equal ones up to so many bytes of different texts, then passes on what it holds.
COMBINED_BYTES = 16 << 20

#: Groups of at least this share of all rows (and 1,000 rows), so at most 100,000 groups, are joined to their rows by broadcast.
HOT_SHARE = 1e-5

_WHITE = b" \t\n\v\f\r"
_NO_ID = np.iinfo(np.int64).max


class Directory:
    """2^depth slots, one for each value of a key's first ``depth`` bits, each pointing to a bucket; ``local`` is each bucket's own depth."""

    def __init__(self) -> None:
        self.depth, self.slots, self.local, self.first = 0, np.zeros(1, np.int64), [0], [0]

    def bucket(self, key: np.ndarray) -> np.ndarray:
        """The bucket of each 64-bit key."""
        if not self.depth:
            return np.zeros(len(key), np.int64)
        return self.slots[(key.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)]

    def split(self, bucket: int) -> int:
        """Divide a bucket by one more bit; the directory doubles if the bucket's depth is its own. The new bucket's number."""
        if self.local[bucket] == self.depth:
            self.slots = np.repeat(self.slots, 2)
            self.depth += 1
        self.local[bucket] += 1
        new, half = len(self.local), 1 << (self.depth - self.local[bucket])
        middle = (self.first[bucket] >> (64 - self.depth)) + half  # a bucket's slots lie side by side
        self.slots[middle : middle + half] = new
        self.local.append(self.local[bucket])
        self.first.append(middle << (64 - self.depth))
        return new

    def fill(self, load: np.ndarray, capacity: float) -> None:
        """Split the one bucket of a new directory until none holds more than ``capacity``; ``load`` has the bytes of each value of the keys' first bits."""
        sums = np.r_[0, np.cumsum(load)]
        todo = [(0, 0, len(load))]
        while todo:
            bucket, first, last = todo.pop()
            if sums[last] - sums[first] > capacity and last - first > 1:
                middle = (first + last) // 2
                todo += [(bucket, first, middle), (self.split(bucket), middle, last)]

    def owners(self, load: np.ndarray, tasks: int) -> np.ndarray:
        """For each bucket the task that owns it: runs of buckets in the order of their keys, of near equal bytes."""
        step = max(1, len(load) >> self.depth)
        own = np.add.reduceat(load, np.arange(0, len(load), step)) if len(load) else load
        before = np.cumsum(own) - own
        first = np.unique(self.slots, return_index=True)[1]
        return np.minimum(before[first] * tasks // max(1, int(own.sum())), tasks - 1)


def _signed(texts: list[str | None], bits: int) -> tuple[list[bytes], list[bytes], np.ndarray, list[int]]:
    """Of each text: the bytes without white space, their SHA-256, the key (its first ``bits`` bits of 64), and the length in code points."""
    bare = [(t or "").encode("utf-8", "surrogatepass").translate(None, _WHITE) for t in texts]
    digest = [hashlib.sha256(b).digest() for b in bare]
    key = np.frombuffer(b"".join(d[:8] for d in digest), ">u8").astype(np.uint64)
    if bits < 64:
        key &= ~np.uint64((1 << (64 - bits)) - 1)
    return bare, digest, key.view(np.int64), [len(t or "") for t in texts]


def _keyed(rows: DataFrame, bits: int) -> DataFrame:
    """doc_id, key, digest, chars, bytes of each row of ``rows`` (doc_id, text): all but the text."""

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches, "text"):
            bare, digest, key, chars = _signed(texts, bits)
            columns = [piece.column("doc_id"), pa.array(key), pa.array(digest, pa.binary()), pa.array(chars, pa.int64()), pa.array([len(b) for b in bare], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "digest", "chars", "bytes"])

    return rows.mapInArrow(freeing(keyed), "doc_id long, key long, digest binary, chars long, bytes long")


_ENTRY = {"owner": pa.int32(), "bucket": pa.int64(), "key": pa.int64(), "content": pa.binary(), "chars": pa.int64(), "keep_id": pa.int64(), "n": pa.int64()}
_ENTRY_SCHEMA = "owner int, bucket long, key long, content binary, chars long, keep_id long, n long"


def _better(chars: int, doc: int, than: list) -> bool:
    return (-chars, doc) < (-than[0], than[1])


def _entries(rows: DataFrame, directory: Directory, owner_of: np.ndarray, bits: int) -> DataFrame:
    """What each task puts into the index: its different texts with the longest row, then the smallest id, and the number of rows of each."""
    sent = rows.sparkSession.sparkContext.broadcast((directory, owner_of))

    def flushed(held: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        directory, owner_of = sent.value
        content, values = list(held), list(held.values())
        key = np.array([v[3] for v in values], np.int64)
        bucket = directory.bucket(key)
        columns = [pa.array(owner_of[bucket].astype(np.int32)), pa.array(bucket), pa.array(key), pa.array(content, pa.binary()), *[pa.array([v[k] for v in values], pa.int64()) for k in range(3)]]
        whole = pa.RecordBatch.from_arrays(columns, list(_ENTRY))
        for start in range(0, len(content), 500):
            yield whole.slice(start, 500)

    def combined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0
        for piece, texts in text_slices(batches, "text"):
            bare, _, key, chars = _signed(texts, bits)
            for content, k, length, doc in zip(bare, key.tolist(), chars, piece.column("doc_id").to_pylist()):
                doc = _NO_ID if doc is None else doc
                if (best := held.get(content)) is None:
                    held[content] = [length, doc, 1, k]
                    size += len(content) + 300
                else:
                    best[2] += 1
                    if _better(length, doc, best):
                        best[:2] = length, doc
            if size >= COMBINED_BYTES:
                yield from flushed(held)
                held, size = {}, 0
        if held:
            yield from flushed(held)

    return rows.mapInArrow(freeing(combined), _ENTRY_SCHEMA)


def _owned(entries: DataFrame) -> DataFrame:
    """The index: of each different text bucket, key, chain (its number among the key's), digest, content, chars, keep_id, n.

    Each owner goes through its buckets' entries in the order of their keys. What has the same key hangs on one chain; a link is compared byte by byte.
    """
    names = ["bucket", "key", "chain", "digest", "content", "chars", "keep_id", "n"]

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        chain: dict[bytes, list] = {}  # content -> [chars, keep_id, n]; Python compares the bytes of equal hashes
        out: list[tuple] = []
        size = 0

        def close() -> int:
            if at is None:
                return 0
            digests = [hashlib.sha256(content).digest() for content in sorted(chain)]
            if len(set(digests)) < len(chain):
                raise ValueError("two texts have one SHA-256")
            out.extend((*at, k, digest, content, *chain[content]) for k, (digest, content) in enumerate(zip(digests, sorted(chain))))
            return sum(map(len, chain))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), kinds)], names)
            out.clear()
            return batch

        for batch, contents in text_slices(batches, "content"):
            columns = [batch.column(c).to_pylist() for c in ("bucket", "key", "chars", "keep_id", "n")]
            for content, bucket, key, chars, doc, n in zip(contents, *columns):
                if at != (bucket, key):
                    size += close()
                    at, chain = (bucket, key), {}
                    if size >= 1 << 20:
                        yield flush()
                        size = 0
                if (best := chain.get(content)) is None:
                    chain[content] = [chars, doc, n]
                else:
                    best[2] += n
                    if _better(chars, doc, best):
                        best[:2] = chars, doc
        close()
        if out:
            yield flush()

    entries = entries.drop("owner")
    return entries.mapInArrow(freeing(merged), "bucket long, key long, chain long, digest binary, content binary, chars long, keep_id long, n long")


class HashIndex:
    """The different texts of a table by an extendible hash of their bytes: ``entries`` is the index in the shared folder, ``keyed`` the rows' keys."""

    def __init__(self, directory: Directory, entries: DataFrame, keyed: DataFrame) -> None:
        self.directory, self.entries, self.keyed = directory, entries, keyed

    @staticmethod
    def build(rows: DataFrame, *, bucket_bytes: int = BUCKET_BYTES, key_bits: int = 64) -> HashIndex:
        """Index ``rows`` (doc_id long, text). Two scans: one for the keys, from whose bytes the directory grows; one for the texts, which each task
        combines before they go to their owners."""
        spark = rows.sparkSession
        keyed = written(_keyed(rows, key_bits))
        load = _load(spark, keyed, bucket_bytes)
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        directory = Directory()
        directory.fill(load, min(bucket_bytes, load.sum() / (tasks * BUCKETS_PER_TASK)))
        entries = _entries(rows, directory, directory.owners(load, tasks), key_bits)
        dealt = entries.repartitionById(tasks, F.col("owner")).sortWithinPartitions("bucket", "key")
        return HashIndex(directory, written(_owned(dealt)), keyed)

    def groups(self) -> DataFrame:
        """Each row's group: doc_id, chars, digest, keep_id, keep_chars, group_size. Rows find their entry by key and digest; the owner has told apart by
        bytes what shares them, and would have raised where bytes differ under one digest."""
        groups = self.entries.select("key", "digest", "keep_id", F.col("chars").alias("keep_chars"), F.col("n").alias("group_size"))
        least = max(1000, int(self.keyed.count() * HOT_SHARE))
        hot, others = groups.where(F.col("group_size") >= least), groups.where(F.col("group_size") < least)
        names = ["doc_id", "chars", "digest", "keep_id", "keep_chars", "group_size"]
        found = self.keyed.join(F.broadcast(hot), ["key", "digest"]).select(*names)
        rest = self.keyed.join(F.broadcast(hot.select("key", "digest")), ["key", "digest"], "left_anti").join(others, ["key", "digest"]).select(*names)
        return found.unionByName(rest)


def _load(spark: SparkSession, keyed: DataFrame, bucket_bytes: int) -> np.ndarray:
    """Bytes of different texts by the first bits of their keys: 2^n numbers, n as large as the table needs."""
    total = keyed.agg(F.sum("bytes")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(total / bucket_bytes, tasks * BUCKETS_PER_TASK, 1)
    depth = min(MOST_DEPTH, int(wanted).bit_length() + 2)
    one = keyed.groupBy("key").agg(F.max("bytes").alias("bytes"))
    found = one.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("prefix")).agg(F.sum("bytes").alias("bytes")).toArrow()
    load = np.zeros(1 << depth, np.int64)
    load[found.column("prefix").to_numpy().astype(np.int64)] = found.column("bytes").to_numpy()
    return load


def exact_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, key_bits: int = 64) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Two texts are equal if the same bytes are left when the six ASCII white-space characters are deleted. Of equal texts the one of the most code
    points stays, then that with the smallest doc_id (null ids last). A null text counts as empty. ``kept`` is true for rows of keep_id and of
    its length: rows that repeat an id at the same length are one document, though each counts in group_size. ``text_sha256`` is that
    of the normalised text. An empty table gives no rows. Other columns are not read. ``key_bits`` shortens the hash, so that keys collide; the result is the same.
    """
    rows = _documents(df, id_col, text_col)
    found = HashIndex.build(rows, bucket_bytes=bucket_bytes, key_bits=key_bits).groups()
    keep = F.when(F.col("keep_id") != _NO_ID, F.col("keep_id"))
    kept = F.col("doc_id").eqNullSafe(keep) & (F.col("chars") == F.col("keep_chars"))
    return found.select("doc_id", keep.alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``df``, with all their columns, that ``exact_duplicates`` keeps."""
    index = HashIndex.build(_documents(df, id_col, text_col), bucket_bytes=bucket_bytes)
    own = F.sha2(F.regexp_replace(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", ""), 256)
    kept = index.entries.select(F.lower(F.hex("digest")).alias("__digest"), F.when(F.col("keep_id") != _NO_ID, F.col("keep_id")).alias("__id"), F.col("chars").alias("__chars"))
    chars = F.char_length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    same = (own == F.col("__digest")) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")) & (chars == F.col("__chars"))
    return df.join(kept, same, "left_semi")


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return as_documents(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
