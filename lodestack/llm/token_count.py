"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import Memory, as_documents, freeing, text_slices, worker_cache

#: A pre-token begins at every space or line feed that follows a character other than white space, so texts can be cut there and pieces be remembered;
#: not inside white space of any kind, which the pattern takes by runs. (The \s of re has all characters of the pattern's and four more: a cut less.)
_PIECES = re.compile(r"\s*+\S+(?:[^\S \n]\s*+\S*)*+|\s+").findall

#: Pre-tokens of more bytes than this are merged by an index of ranks, as a round over all of a long one would cost much for few merges.
LONG = 2048


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such vocabularies: printable Latin-1 stands for itself, the others get 256, 257, ..."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class RaggedMerges:
    """The merges of a vocabulary file, applied to many pre-tokens at once."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.first = np.array([vocab[x] for x in byte_letters()], np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = regex.compile(pattern).findall
        self.known = Memory()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; as many as there are merges where there is none."""
        pair = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at], len(self.merged))

    def _long_symbols(self, token: bytes) -> int:
        """``symbols`` of one long pre-token: positions wait under their pair's rank, so a round touches only those of the lowest rank and their
        neighbours; symbols are linked, since they don't move."""
        ids = self.first[np.frombuffer(token, np.uint8)]
        n = len(ids)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n), np.ones(n + 1, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[after[at] < n]
            rank = self._ranks(ids[at], ids[after[at]])
            at, rank = at[rank < len(self.merged)], rank[rank < len(self.merged)]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            starts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]][: len(rank)])
            for r, own in zip(rank[starts].tolist(), np.split(at, starts[1:])):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(own)

        wait(np.arange(n))
        count = n
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[alive[at] & (after[at] < n)]
            at = at[self._ranks(ids[at], ids[after[at]]) == rank]
            if not len(at):
                continue
            heads = np.r_[True, at[1:] != after[at[:-1]]]  # in a run of overlapping places every other one counts, from the left
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(heads, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            right = after[at]
            ids[at], alive[right], after[at] = self.merged[rank], False, after[right]
            before[after[at]] = at
            count -= len(at)
            left = before[at]
            wait(np.unique(np.concatenate([at, left[left >= 0]])))
        return count

    def symbols(self, tokens: list[bytes]) -> np.ndarray:
        """How many symbols each pre-token ends as.

        All pre-tokens lie in one flat array with an owner per symbol. Each round finds the rank of every neighbouring pair, takes
        each owner's lowest rank, and merges that pair wherever the owner has it (of overlapping places the left one).
        An owner without a mergeable pair has ended and leaves the arrays.
        """
        long = {k: self._long_symbols(t) for k, t in enumerate(tokens) if len(t) > LONG}
        tokens = [b"" if k in long else t for k, t in enumerate(tokens)] if long else tokens
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        counts[list(long)] = list(long.values())
        ids = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), counts)
        none = len(self.merged)
        while len(ids) > 1:
            pair = (ids[:-1] << 32) | ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            rank = np.where((self.pairs[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.append(rank, none), starts)
            lengths = np.diff(np.append(starts, len(ids)))
            hit = np.append((rank < none) & (rank == np.repeat(lowest, lengths)[:-1]), False)
            run = np.flatnonzero(hit)
            if len(run):  # in a run of overlapping places every other one counts, from the left
                heads = np.r_[True, np.diff(run) != 1]
                nth = np.arange(len(run)) - np.maximum.accumulate(np.where(heads, np.arange(len(run)), 0))
                hit[run[nth % 2 == 1]] = False
            ids[hit] = self.merged[rank[np.flatnonzero(hit)]]
            stay = np.append(True, ~hit[:-1])
            counts[: len(counts)] -= np.bincount(owner[~stay], minlength=len(counts))
            stay &= np.repeat(lowest < none, lengths)
            ids, owner = ids[stay], owner[stay]
        return counts

    def count(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text; special strings count as one token each, as the library has it."""
        parts = [(self.special.split(t) if self.special else [t]) if t else [] for t in texts]
        pieces = [[p for part in own for p in _PIECES(part)] for own in parts]
        every = set().union(*pieces)
        new = list(every.difference(self.known))
        found: dict[str, int] = {}
        if new:
            words = [self.words(p) for p in new]
            flat = list({w for own in words for w in own})
            sizes = dict(zip(flat, self.symbols([w.encode() for w in flat]).tolist()))
            found = {p: sum(sizes[w] for w in own) for p, own in zip(new, words)}
        out = [sum(found[p] if p in found else self.known[p] for p in own) + max(0, len(split) - 1) for own, split in zip(pieces, parts)]
        self.known.keep(found, len(every))
        return out


def count_tokens(df: DataFrame, vocabulary: str, pattern: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each row, in one pass without a shuffle.

    ``vocabulary`` is a byte-level BPE file (model, merges, added tokens) at a path that every executor has; ``pattern`` splits text
    before the merges. A null or empty text has 0 bytes and tokens; rows may repeat, ids be null; other columns are not read.
    Long texts are handled whole: a batch is cut to pieces of some MB or one row.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = worker_cache(f"merges {vocabulary} {pattern}", lambda: RaggedMerges(vocabulary, pattern))
        for batch, texts in text_slices(batches, "text"):
            n = merges.count(texts)
            n_bytes = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = as_documents(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(freeing(counted), f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
