"""Benchmark decontamination by templates: numbers, units and names become typed slots, so re-parameterised questions are found too."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import Memory, as_documents, freeing, mix, text_slices, worker_cache, written

#: Words in a window; shorter items are one window of their own length.
WINDOW = 8

#: A document has leaked an item if consistent windows cover this share of the item's words.
LEAST_COVER = 0.4

#: Words that are a unit if they follow a number.
UNITS = frozenset("mm cm m km in ft mi mile miles g kg mg lb lbs oz l ml s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees".split())

#: Up to so many different window hashes (8 bytes each) are sent to the tasks as a filter before the join, and up to so many windows are broadcast.
MOST_SENT_WINDOWS = 500_000

#: Bytes of words that a worker remembers, and of text that it works on at once (some 30 bytes of arrays for each).
WORD_BYTES, SLICE_BYTES = 12 << 20, 1 << 18

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
_CAPITAL, _ENDS, _NUM, _UNIT, _NONE = 1, 2, 4, 8, 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_SLOTS = {kind: np.uint64(xxhash.xxh64_intdigest(f"<{kind}>")) for kind in ("number", "unit", "name")}


class _Words(Memory):
    """By raw word: its literal's hash, the lowest 5 bits of which say what the word may be."""

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode()
        bare = _EDGES.sub("", word)
        flags = 0 if bare else _NONE
        if bare:
            end = word.rindex(bare) + len(bare)
            flags |= _CAPITAL * (bare[0].isupper() and not bare[1:].isupper()) | _ENDS * any(c in word[end:] for c in ".!?:") | _NUM * bool(_NUMBER.fullmatch(bare)) | _UNIT * (bare.lower() in UNITS)
        value = (xxhash.xxh64_intdigest(bare.lower()) & ~31) | flags
        if self.held < self.limit:
            self[raw] = value
            self.held += len(raw) + self.EACH
        return value


class Templates:
    """Texts' words with slots for numbers, units after numbers, and names (capitalised words, not all in capitals, that don't begin a sentence): flat
    arrays over the words of all texts, ``owner`` says whose each is."""

    def __init__(self, texts: list[str | None], words: _Words) -> None:
        raw = [t.encode().split() if t else [] for t in texts]
        owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        flat = list(chain.from_iterable(raw))
        code = np.fromiter(map(words.__getitem__, flat), np.uint64, len(flat))
        full = np.flatnonzero((code & np.uint64(_NONE)) == 0)
        self.raw, self.at, self.owner, code = flat, full, owner[full], code[full]
        self.bounds = np.searchsorted(self.owner, np.arange(len(raw) + 1))
        self.flags = (code & np.uint64(31)).astype(np.int64)
        first = np.r_[True, self.owner[1:] != self.owner[:-1]][: len(code)]
        number = (self.flags & _NUM) > 0
        begins = first | np.r_[True, (self.flags[:-1] & _ENDS) > 0][: len(code)]
        name = ((self.flags & _CAPITAL) > 0) & ~begins & ~number
        unit = ((self.flags & _UNIT) > 0) & np.r_[False, number[:-1]][: len(code)] & ~first
        self.literal = code & ~np.uint64(31)
        self.words = np.select([number, unit, name], list(_SLOTS.values()), self.literal)
        self.slot = number | unit | name

    def hashes(self, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """(length, starts, hashes, exact) of the windows of each length: by slots those of which at least half are literal, and, exact, all by their
        literal words in any case."""
        before = np.r_[0, np.cumsum(self.slot)]
        back = np.multiply.accumulate(np.full(len(self.words), _ODD_INVERSE)) * _ODD  # of the window's place
        sums = [np.r_[np.uint64(0), np.cumsum(own * np.multiply.accumulate(np.full(len(own), _ODD)))] for own in (self.words, self.literal)]
        for length in lengths:
            count = len(self.words) - length + 1
            if count <= 0:
                continue
            whole = self.owner[length - 1 :] == self.owner[:count]
            few = 2 * (before[length:] - before[:-length]) <= length
            for own, start, exact in zip(sums, (np.flatnonzero(whole & few), np.flatnonzero(whole)), (False, True)):
                yield length, start, _named((own[start + length] - own[start]) * back[start], length, exact), exact

    def slots(self, start: int, length: int) -> list[str]:
        """What fills a window's slots, as written but for case and punctuation around it."""
        found = start + np.flatnonzero(self.slot[start : start + length])
        return [_EDGES.sub("", self.raw[self.at[k]].decode()).lower() for k in found]

    def readings(self, start: int, length: int) -> Iterator[tuple[int, list[str]]]:
        """(hash, slots) of a window for each slot that its first word may be in a document, after words that aren't part of it."""
        for kind, flag in (("name", _CAPITAL), ("unit", _UNIT)):
            if not self.slot[start] and self.flags[start] & flag and 2 * (1 + self.slot[start : start + length].sum()) <= length:
                words = np.r_[_SLOTS[kind], self.words[start + 1 : start + length]]
                value = (words * np.multiply.accumulate(np.full(length, _ODD))).sum(keepdims=True)
                yield int(_named(value, length, False).view(np.int64)[0]), [_EDGES.sub("", self.raw[self.at[start]].decode()).lower(), *self.slots(start + 1, length - 1)]


def _named(sums: np.ndarray, length: int, exact: bool) -> np.ndarray:
    """Hashes of windows by the sums of their words times powers of an odd number."""
    return mix(sums ^ np.uint64(exact << 32 | length))


class _Filter:
    """Whether hashes are among sorted ones; a table of their lowest bits answers for most."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes, self.maybe = hashes, np.zeros(1 << 22, bool)
        self.maybe[hashes & np.uint64((1 << 22) - 1)] = True

    def of(self, value: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.maybe[value & np.uint64((1 << 22) - 1)])
        return at[self.hashes[np.minimum(np.searchsorted(self.hashes, value[at]), len(self.hashes) - 1)] == value[at]] if len(self.hashes) else at[:0]


_WINDOW = {"words": pa.int64(), "start": pa.int64(), "length": pa.int64(), "hash": pa.int64(), "slots": pa.list_(pa.string())}


def item_windows(rows: DataFrame) -> DataFrame:
    """(id, key, words, start, length, hash, slots) of the windows of benchmark items (doc_id, text), of WINDOW words or a short item's all; ``key`` is the text's hash."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_cache("template words", lambda: _Words(WORD_BYTES))
        for piece, texts in text_slices(batches, "text", SLICE_BYTES):
            out: list[tuple] = []
            for doc, key, text in zip(piece.column("doc_id").to_pylist(), piece.column("key").to_pylist(), texts):
                own = Templates([text], words)
                total = len(own.words)
                length = min(WINDOW, total)
                if total:
                    for _, start, value, exact in own.hashes([length]):
                        out += [(doc, key, total, s, length, h, [] if exact else own.slots(s, length)) for s, h in zip(start.tolist(), value.view(np.int64).tolist())]
                    out += [(doc, key, total, 0, length, h, slots) for h, slots in own.readings(0, length)]
            types = {"id": piece.schema.field("doc_id").type, "key": pa.int64(), **_WINDOW}
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types.values())], list(types))

    return rows.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(cut, f"id {kind}, key long, words long, start long, length long, hash long, slots array<string>")


def document_windows(rows: DataFrame, lengths: list[int], only: np.ndarray | None) -> DataFrame:
    """(doc_id, key, at, hash, here, reach) of the windows of ``rows`` (doc_id, text), of all ``lengths``. ``only``: sorted hashes to keep; ``reach`` is how
    many of the row's words lie in windows that were kept, so no item of more than reach / least_cover words can have leaked into it."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(only)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keep = worker_cache("template words", lambda: _Words(WORD_BYTES)), None if sent.value is None else _Filter(sent.value)
        for piece, texts in text_slices(batches, "text", SLICE_BYTES):
            own = Templates(texts, words)
            found: list[tuple[np.ndarray, np.ndarray, list]] = []
            edges = np.zeros(len(own.words) + 1, np.int64)
            for length, start, value, exact in own.hashes(lengths):
                if keep is not None:
                    hit = keep.of(value)
                    start, value = start[hit], value[hit]
                edges += np.bincount(start, minlength=len(edges)) - np.bincount(start + length, minlength=len(edges))
                found.append((start, value, [[]] * len(start) if exact else [own.slots(s, length) for s in start.tolist()]))
            start, value = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
            owner = own.owner[start]
            ids = [piece.column(c).take(pa.array(owner)) for c in ("doc_id", "key")]
            reach = np.bincount(own.owner, weights=np.cumsum(edges)[:-1] > 0, minlength=1).astype(np.int64)
            rest = pa.array(start - own.bounds[owner]), pa.array(value.view(np.int64)), pa.array([s for f in found for s in f[2]], pa.list_(pa.string())), pa.array(reach[owner])
            yield pa.RecordBatch.from_arrays([*ids, *rest], ["doc_id", "key", "at", "hash", "here", "reach"])

    return rows.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(freeing(cut), f"doc_id {kind}, key long, at long, hash long, here array<string>, reach long")


def _leaks(df: DataFrame, benchmark: DataFrame, *, least_cover: float, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """doc_id and key (hash of the text) of each leak: item_id, covered, item_words, reparameterised."""
    spark = df.sparkSession
    named = written(item_windows(as_documents(benchmark, item_col, item_text)))
    ids = named.select(F.col("id").alias("item_id"), F.col("key").alias("item")).distinct()
    items = written(named.drop("id").withColumnRenamed("key", "item").distinct())  # items of one text are one
    lengths = [r.length for r in items.select("length").distinct().collect()]
    few = items.limit(MOST_SENT_WINDOWS + 1).count() <= MOST_SENT_WINDOWS
    only = np.sort(items.select("hash").distinct().toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)) if few else None
    small = lambda t: F.broadcast(t) if few else t
    found = document_windows(as_documents(df, id_col, text_col), lengths or [WINDOW], only)

    hits = found.join(small(items), "hash").where(F.col("reach") >= least_cover * F.col("words"))
    hits = hits.withColumn("pairs", F.arrays_zip(F.col("slots").alias("item"), F.col("here").alias("here")))
    places = hits.groupBy("doc_id", "key", "item", "words", (F.col("at") - F.col("start")).alias("shift")).agg(
        F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1))).alias("covers"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    values = F.array_distinct(F.transform("pairs", lambda x: x["item"]))
    there = F.array_distinct(F.transform("pairs", lambda x: x["here"]))
    names = lambda x: F.rlike(x, F.lit(r"^\D*$"))
    consistent = (F.size(values) == F.size("pairs")) & (F.size(F.filter(there, names)) >= F.size(F.filter("pairs", lambda x: names(x["here"]))))
    other = F.exists("pairs", lambda x: x["item"] != x["here"])
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("covers")))).cast("long")  # of an item's words at most
    leaks = places.where(consistent).groupBy("doc_id", "key", "item", F.col("words").alias("item_words")).agg(covered.alias("covered"), F.min(other).alias("reparameterised"))
    return leaks.where(F.col("covered") / F.col("item_words") >= least_cover).join(small(ids), "item").drop("item")


def find_leaks(df: DataFrame, benchmark: DataFrame, *, least_cover: float = LEAST_COVER, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The pairs of a document and an item that it contains: doc_id, item_id, covered, item_words, reparameterised.

    Windows of both sides' templates are joined by hash, those with at least half of their words literal, and beside them all windows by their literal words in
    any case. An item of fewer than WINDOW words is one window of its own length. An item's first word counts as a slot too, where a document may read it
    as one. The windows of one place in a document and one alignment with an item must fill the item's slots consistently: each value of the item stands
    for one value there, and each name there for one of the item; else they say nothing. The item has leaked if the others cover at least
    ``least_cover`` of its words. ``reparameterised``: in no alignment do all slots hold the item's own values. However many items share a window, it counts
    for each of them; a row whose matching windows are too short for an item altogether is not compared with it.

    Null and empty texts match nothing. A row is known by its id and its text: rows equal in both give one result, others of an id (or of a null id) one
    each, also of items. Empty tables give no rows. Other columns are not read. A benchmark of any size works: up to a bound its
    hashes are sent along, so only matching windows leave the tasks that read the texts; beyond it all windows are joined by a shuffle.
    """
    found = _leaks(df, benchmark, least_cover=least_cover, id_col=id_col, text_col=text_col, item_col=item_col, item_text=item_text)
    return found.select("doc_id", "item_id", "covered", "item_words", "reparameterised")


def drop_leaks(df: DataFrame, benchmark: DataFrame, *, least_cover: float = LEAST_COVER, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``df`` without the rows whose text contains an item of ``benchmark``; all columns stay, and so do other rows of the same id."""
    found = _leaks(df, benchmark, least_cover=least_cover, id_col=id_col, text_col=text_col, item_col=item_col, item_text=item_text)
    bad = written(found.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct())
    few = bad.limit(MOST_SENT_WINDOWS + 1).count() <= MOST_SENT_WINDOWS
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col("__key"))
    return df.join(F.broadcast(bad) if few else bad, same, "left_anti")
