"""Packing of token sequences into windows by the sum-of-squares rule, each task on its own documents."""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lodestack.llm.common import Memory, as_documents, freeing, text_slices, worker_cache
from lodestack.llm.token_count import byte_letters

#: Bytes of chunks, with the parts of chunks, that a worker remembers.
CHUNK_BYTES = 32 << 20

#: Bits that tell which chunks were met before, one byte each: what comes once isn't remembered.
MET_BITS = 21

_PUNCTUATION = string.punctuation.encode()

#: Latin letters that have one small letter each; all such words are in NFC.
_LATIN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ChunkIds(Memory):
    """Ids of chunks between ASCII white space, as little-endian bytes.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its chunks, one after another. Where an ASCII letter ends
    what punctuation follows, a chunk's ids are those of its word and of that punctuation, and ASCII letters count in lower case. The library is
    asked once for each such part that a worker meets; its merges alone for words that it neither normalises nor cuts.
    """

    def __init__(self, path: str) -> None:
        super().__init__(CHUNK_BYTES)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.met = np.zeros(1 << MET_BITS, bool)

    def _again(self, found: dict[bytes, bytes]) -> dict[bytes, bytes]:
        """What was met before; two chunks that share a place only make it remember one too many."""
        at = np.fromiter(map(hash, found), np.int64, len(found)) & ((1 << MET_BITS) - 1)
        again = self.met[at]
        self.met[at] = True
        return dict(compress(found.items(), again))

    @staticmethod
    def _split(chunk: bytes) -> tuple[bytes, bytes]:
        word = chunk.rstrip(_PUNCTUATION)
        if not word[-1:].isalpha() or b"<|" in chunk:  # a special token's string is one
            word = chunk
        return word.lower() if word.isascii() else word, chunk[len(word) :]

    def _learned(self, parts: Iterable[bytes]) -> dict[bytes, bytes]:
        out, rest, cut = {}, [], self.merges.tokenize
        for p in parts:
            if not p.isalpha():
                word = p.decode()
                if not _LATIN(word):
                    rest.append(p)
                    continue
                own = word.lower().encode().decode("latin-1").translate(self.letters)  # Latin letters, each with one small one
            else:
                own = p.decode()
            out[p] = array("I", [t.id for t in cut(own)]).tobytes()
        for at in range(0, len(rest), 10_000):
            some = rest[at : at + 10_000]
            got = self.tokenizer.encode_batch_fast([c.decode() for c in some], add_special_tokens=False)
            out.update((c, array("I", e.ids).tobytes()) for c, e in zip(some, got))
        return out

    def _found(self, new: set[bytes]) -> dict[bytes, bytes]:
        """The ids of chunks that aren't remembered, and of their parts that weren't."""
        plain = [c for c in new if c.isalpha() and c.islower()]  # small ASCII letters alone are one part
        found = self._learned(plain)
        split = {c: self._split(c) for c in new.difference(plain)}
        parts = {p for pair in split.values() for p in pair if p and p not in self and p not in found}
        found.update(self._learned(parts))
        part = lambda p: found[p] if p in found else self[p]
        found.update([(c, part(a) + part(b) if b else part(a)) for c, (a, b) in split.items()])
        return found

    def ids(self, texts: list[str | None]) -> list[bytes]:
        chunks = [t.encode().split() if t else [] for t in texts]
        out = [list(map(self.get, own)) for own in chunks]  # one look-up of each chunk, and a second one of what is not remembered
        missed = [c for own, known in zip(chunks, out) for c, ids in zip(own, known) if ids is None]
        if missed:
            found = self._found(set(missed))
            rest = map(found.__getitem__, missed)
            out = [[next(rest) if ids is None else ids for ids in known] for known in out]
            self.keep(self._again(found), sum(map(len, chunks)), 1, len(missed))
        return list(map(b"".join, out))


class Levels:
    """Windows of ``capacity`` tokens; ``count[h]`` of the open ones are filled up to h."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = {}  # by level: windows as [pieces]

    def level_for(self, size: int) -> int:
        """The level that leaves the least sum of squared counts of partly filled windows; 0 is a new window; of equals the fullest."""
        last = self.capacity - size
        before, after = self.count[: last + 1], self.count[size:]
        change = np.where(before > 0, 2 * (after - before) + 2, np.iinfo(np.int64).max)
        if last > 0:
            change[0] = 2 * after[0] + 1
        change[last] = (1 - 2 * before[last] if before[last] else change[last]) if last else -1
        return last - int(np.argmin(change[::-1]))

    def place(self, piece: tuple, size: int) -> list | None:
        """Put a piece into a window; the window, if it is full now."""
        level = self.level_for(size)
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.open.setdefault(level + size, []).append(window)
        self.count[level + size] += 1
        return None

    def rest(self) -> list[list]:
        """The windows that are still open, the fullest first."""
        return [w for level in sorted(self.open, reverse=True) for w in self.open[level]]


def _poured(windows: list[list], capacity: int) -> Iterator[list]:
    """The pieces of partly filled windows in full windows, cut where one ends; the last may stay short.

    The fullest windows stay as they are and are topped up from the emptiest, so few pieces are cut.
    """
    stack = [list(w) for w in windows]
    while stack:
        window = stack.pop(0)
        room = capacity - sum(len(p[2]) // 4 for p in window)
        while room and stack:
            doc, start, ids, total = stack[-1].pop()
            window.append((doc, start, ids[: 4 * room], total))
            if len(ids) > 4 * room:
                stack[-1].append((doc, start + room, ids[4 * room :], total))
            room -= min(room, len(ids) // 4)
            if not stack[-1]:
                stack.pop()
        yield window


def pack_documents(df: DataFrame, vocabulary: str, *, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text by the library (no special tokens added) and ``end_id``; a null or empty text is ``end_id`` alone.
    What fills whole windows of a long document becomes such; the remainder goes, as it comes, to the fill level that leaves the least
    sum of squared counts of partly filled windows. What is still open at a task's end is poured together, so each task leaves at
    most one short sequence. Tasks pack on their own: no shuffle, and memory for the open windows only (at most about one for each
    level). ``sequence_id`` is the task's number x 2^33 plus a count. Repeated rows and null ids are packed like others; an empty table
    gives no rows. Other columns are not read.
    """
    rows = as_documents(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, levels = worker_cache(f"chunks {vocabulary}", lambda: ChunkIds(vocabulary)), Levels(capacity)
        sequence = TaskContext.get().partitionId() << 33
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        out: list[tuple] = []

        def close(window: list) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in window:
                out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))
                offset += len(ids) // 4
            sequence += 1

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, id_type if k == 0 else pa.int64()) for k, c in enumerate(zip(*out) if out else [[]] * len(names))]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        id_type = pa.int64()
        for batch, texts in text_slices(batches, "text"):
            id_type = batch.schema.field("doc_id").type
            for doc, ids in zip(batch.column("doc_id").to_pylist(), chunks.ids(texts)):
                ids += end
                total = len(ids) // 4
                whole = total - total % capacity
                for start in range(0, whole, capacity):
                    close([(doc, start, ids[4 * start : 4 * (start + capacity)], total)])
                if total > whole and (full := levels.place((doc, whole, ids[4 * whole :], total), total - whole)):
                    close(full)
            yield flush()
        for window in _poured(levels.rest(), capacity):
            close(window)
        if out:
            yield flush()

    return rows.mapInArrow(freeing(packed), f"doc_id {kind}, {PIECE}")
