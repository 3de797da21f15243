"""Exact Jaccard join of shingle sets as a join in a metric space, and the components of its links.

The Jaccard distance d = 1 - |x & y| / |x | y| is a metric; two documents link when d <= r. The join goes by pivots:

1. Pivots are drawn among the sets and thinned until they lie apart. They create Voronoi regions: a set's home is the cell of its nearest pivot, if that
   is within the cells' radius c. By the triangle inequality a set that links to one at home in cell q lies within r of that one, so it is at most
   min(d_nearest + 2 r, c + r) away from q: in this window boundary sets are replicated. A set within r of a pivot links to it at once.
2. Cells that stay overfull, not counting what links to the pivot, are divided again with pivots drawn in them, of a smaller radius. Two sets
   of a cell are compared only if their distances to its pivot differ by at most r.
3. What is c - r or more away from all pivots is the residue; it can link to nothing nearer. Most sets of a corpus are at distance 1 from each other and
   so from all pivots, where no set tells others apart. Among them single shingles are the pivots: the residue's regions are the sets that
   contain a shingle, in one global order (rare ones first), and the window of a set with n shingles is its first n - ceil((1 - r) n) + 1, so two
   sets that link meet in the region of their first common shingle.
4. Regions whose sets are all connected are finished. In the others only sets of different components are compared, those of the largest one with
   those outside it only: a lower bound of the distance (from parity sketches of the sets) excludes pairs, what is left is verified exactly, and
   components that meet are merged before the region is joined again, if it had more to name. Of the pairs of a group of near copies only spanning forests are verified. Large
   regions are compared in blocks of bounded size, each with itself first.

Copies of a set are one node.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import as_documents, freeing, ngram_hashes, text_slices, word_hashes, worker_cache, written
from lodestack.shared import discard

#: At most so many sets, of at most so many shingles each, are pivots of a division: the bound of what the driver and a broadcast hold.
MOST_PIVOTS, PIVOT_SHINGLES = 1024, 4096

#: Least distance between the pivots of a division, and the cells' radius in r: of the first division and of those inside of cells.
APART, RADIUS = 0.5, (2, 2)

#: Cells of more sets than this are divided again, with about so many pivots each and so many times; what then is still overfull lies equally
#: far from all pivots, and is compared in blocks.
OVERFULL, PIVOTS_PER_CELL, MOST_DIVISIONS = 2048, 64, 3

#: Shingles counted together in a task before those met once are dropped (8 bytes each). The others are met again, and come last in the global order.
COUNTED_TOGETHER = 2_000_000

#: Shingles met again are sent along as bits at their lowest HEAVY_BITS bits; of more than a sixteenth as many only those that are met most often. What a bit
#: says wrongly of another shingle changes the order, everywhere alike, and so the work, but no result.
HEAVY_BITS = 26

#: Bytes of text that a worker works on at once.
SLICE_BYTES = 1 << 18

#: Blocks that a large region is compared in.
BLOCK = 512

#: Least 64-bit words of a parity sketch; larger sets have one of as many bits as shingles, to the next power of two, since a full sketch tells nothing apart.
SKETCH_WORDS = 32

#: Up to so many rows of a few numbers are broadcast (32 bytes each); more are joined by a shuffle.
MOST_SENT_ROWS = 1_000_000

#: Rounding of distances never narrows a window.
_EPSILON = 1e-9


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles of lower-cased (A-Z) words; of all its words, if there are fewer than ``width``."""
    return [np.unique(ngram_hashes(own, width)) for own in word_hashes([(t or "").encode().lower() for t in texts])]


def signature(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    value = xxhash.xxh3_128_intdigest(own.tobytes())
    return tuple(int(x) - (1 << 64) * (x >> 63) for x in (value >> 64, value & ((1 << 64) - 1)))


class Signer:
    """A node's number: the first half of a set's signature, or the second one where ``clashes`` (first half: whose second half keeps it) says that
    different sets have the first in common."""

    def __init__(self, clashes: dict[int, int]) -> None:
        self.clashes = clashes

    def __call__(self, own: np.ndarray) -> int:
        sig, low = signature(own)
        return low if self.clashes.get(sig, low) != low else sig


def small_join(df: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``df`` joined to a table of numbers that is broadcast, if it is small by count."""
    return df.join(F.broadcast(small) if small.limit(MOST_SENT_ROWS + 1).count() <= MOST_SENT_ROWS else small, on, how)


class Pivots:
    """Sets that cells form around, and which of them has a shingle. ``of``: the cell that each divides."""

    _MASK = np.uint64((1 << 22) - 1)

    def __init__(self, sets: list[np.ndarray], of: list[int], signatures: list[tuple[int, int]], first: int = 0) -> None:
        self.sets, self.of, self.signatures, self.first = sets, np.array(of, np.int64), signatures, first
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.shingles, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[flat & self._MASK] = True

    def shared(self, own: np.ndarray) -> np.ndarray:
        """How many shingles each pivot has in common with a set."""
        own = own[self.maybe[own & self._MASK]]
        start, stop = np.searchsorted(self.shingles, own, "left"), np.searchsorted(self.shingles, own, "right")
        times = stop - start
        at = np.repeat(start - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum()) if len(own) else start
        return np.bincount(self.owner[at], minlength=len(self.sizes))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"sets": None}  # tasks need the index only

    def thinned(self) -> Pivots:
        """The pivots, in their order, that are at least APART from those before them of the same cell."""
        stays = np.zeros(len(self.sets), bool)
        for k, own in enumerate(self.sets):
            both = self.shared(own)
            near = both / np.maximum(1, self.sizes + len(own) - both) > 1 - APART
            stays[k] = not (near & stays & (self.of == self.of[k])).any()
        keep = np.flatnonzero(stays).tolist()
        return Pivots([self.sets[k] for k in keep], self.of[keep].tolist(), [self.signatures[k] for k in keep], self.first)

    def places(self, own: np.ndarray, of: int, percent: int, radius: int) -> tuple[list[tuple[int, float, bool, bool]], bool, bool]:
        """A set's cells in the division of the cell ``of``, as (cell, distance to its pivot, at home, links to the pivot); whether it belongs to the
        residue, and whether that is its home."""
        r = 1 - percent / 100
        reach = min(1.0, radius * r)
        if np.count_nonzero(self.maybe[own & self._MASK]) < (1 - reach - r - _EPSILON) * len(own):  # so far from any pivot
            return [], True, True
        shared = self.shared(own)
        met = np.flatnonzero((shared > 0) & (self.of == of))
        if not len(met):
            return [], True, True
        union = len(own) + self.sizes[met] - shared[met]
        far = 1 - shared[met] / union
        best = int(np.argmin(far))
        home = far[best] < reach - _EPSILON
        window = far <= min(far[best] + 2 * r, reach + r) + _EPSILON
        links = 100 * shared[met] >= percent * union
        out = [(self.first + int(met[k]), float(far[k]), bool(home and k == best), bool(links[k])) for k in np.flatnonzero(window)]
        return out, bool(far[best] >= reach - r - _EPSILON), not home


_CELL = {"cell": pa.int64(), "at": pa.float64(), "home": pa.bool_(), "links": pa.bool_()}


def signed_documents(rows: DataFrame, pivots: Pivots, width: int, percent: int) -> DataFrame:
    """One pass over the texts: rows (doc_id, key, n, sig, low) for documents, rows (shingle, met) for what several documents of a piece
    share, and rows (sig, low, n, cell, at, home, links) for the cells of sets."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("", dict)  # lets go of what other operators have kept
        pivots = sent.value
        types = {"doc_id": pa.int64(), **dict.fromkeys(("key", "n", "sig", "low", "shingle", "met"), pa.int64()), **_CELL}
        held: dict[tuple, np.ndarray] = {}  # different sets
        shingles = 0

        def batch(**columns) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([c if isinstance(c := columns.get(k, pa.nulls(size, t)), pa.Array) else pa.array(c, t) for k, t in types.items()], list(types))

        def common() -> pa.RecordBatch:
            shingle, met = np.unique(np.concatenate(list(held.values())), return_counts=True)
            often = met >= 2
            return batch(shingle=shingle[often].view(np.int64), met=met[often])

        for piece, texts in text_slices(batches, "text", SLICE_BYTES):
            types["doc_id"] = piece.schema.field("doc_id").type
            sets = shingle_sets(texts, width)
            sigs = [signature(s) if len(s) else (None, None) for s in sets]
            yield batch(doc_id=piece.column("doc_id"), key=piece.column("key"), n=[len(s) for s in sets], sig=[s for s, _ in sigs], low=[x for _, x in sigs])
            cells = []
            for sig, own in zip(sigs, sets):
                if len(own) and sig not in held:
                    held[sig] = own
                    shingles += len(own)
                    cells += [(*sig, len(own), *c) for c in pivots.places(own, 0, percent, RADIUS[0])[0]]
            if cells:
                yield batch(**dict(zip(("sig", "low", "n", "cell", "at", "home", "links"), zip(*cells))))
            if shingles > COUNTED_TOGETHER:
                yield common()
                held.clear()
                shingles = 0
        if held:
            yield common()

    columns = ", ".join(f"{c} long" for c in ("key", "n", "sig", "low", "shingle", "met", "cell"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(freeing(signed), f"doc_id {kind}, {columns}, at double, home boolean, links boolean")


def heavy_bits(met: DataFrame) -> np.ndarray:
    """The bits of the shingles (shingle, met) that are met again, as bytes."""
    counts = written(met.groupBy("shingle").agg(F.sum("met").alias("met")))
    enough, above = 10_001, 0  # the least number of times that a shingle is met for a bit of its own
    for r in counts.groupBy(F.least("met", F.lit(10_000)).alias("met")).agg(F.count("*").alias("n")).orderBy(F.desc("met")).collect():
        above += r.n
        if above > (1 << HEAVY_BITS) // 16:
            break
        enough = r.met
    at = F.col("shingle").bitwiseAND((1 << HEAVY_BITS) - 1)
    words = counts.where(F.col("met") >= enough).groupBy(F.shiftright(at, 5).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(31).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << (HEAVY_BITS - 5), np.uint32)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def windows(rows: DataFrame, heavy: np.ndarray, pivots: Pivots, signer: Signer, width: int, percent: int) -> DataFrame:
    """Each set of the residue in the regions of its window: shingle, n, sig. Copies in one task are one set."""
    sent = rows.sparkSession.sparkContext.broadcast((heavy, pivots))

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (common, pivots), seen = sent.value, set()
        for _, texts in text_slices(batches, "text", SLICE_BYTES):
            out: list[tuple[np.ndarray, int, int]] = []
            for own in shingle_sets(texts, width):
                if not len(own) or (sig := signer(own)) in seen:
                    continue
                seen.add(sig)
                if not pivots.places(own, 0, percent, RADIUS[0])[1]:
                    continue
                size = len(own) - -(-percent * len(own) // 100) + 1
                at = own & np.uint64((1 << HEAVY_BITS) - 1)
                last = (common[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0
                own = np.concatenate([own[~last], own[last]]) if last.any() else own
                out.append((own[:size].view(np.int64), len(own), sig))
            if out:
                lengths = [len(x[0]) for x in out]
                columns = np.concatenate([x[0] for x in out]), np.repeat([x[1] for x in out], lengths), np.repeat([x[2] for x in out], lengths)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shingle", "n", "sig"])

    return rows.select("text").mapInArrow(freeing(dealt), "shingle long, n long, sig long")


def met_again(dealt: DataFrame) -> DataFrame:
    """The rows of ``dealt`` whose shingle comes with another set too, each once: nearly all pivots have one set and are dropped in a stream."""

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None  # the last row
        held_met = False  # whether it has met another set already
        for batch in batches:
            own = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            if held is not None:
                own = {c: np.concatenate([held[c], own[c]]) for c in own}
            if not len(own["sig"]):
                continue
            new = np.r_[True, (own["shingle"][1:] != own["shingle"][:-1]) | (own["sig"][1:] != own["sig"][:-1])]
            own = {c: x[new] for c, x in own.items()}
            same = own["shingle"][1:] == own["shingle"][:-1]
            met = np.r_[held_met if held is not None else False, same] | np.r_[same, False]
            held, held_met = {c: x[-1:] for c, x in own.items()}, bool(met[-1])
            out = np.flatnonzero(met[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in own.values()], list(own))
        if held is not None and held_met:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.values()], list(held))

    return dealt.select("shingle", "n", "sig").repartition("shingle").sortWithinPartitions("shingle", "sig").mapInArrow(freeing(kept), "shingle long, n long, sig long")


def regions(met: DataFrame, percent: int) -> DataFrame:
    """Members (region, sig, n) of the residue's regions of two or more sets. A region of up to OVERFULL sets is cut where the next larger set is
    too large for a link; larger ones are compared in blocks, where sizes exclude pairs as well."""
    met = written(met)
    counts = met.groupBy("shingle").agg(F.count("*").alias("size"))
    large = written(counts.where(F.col("size") > OVERFULL).select("shingle"))  # at most one for OVERFULL rows
    by_size = Window.partitionBy("shingle").orderBy("n", "sig")
    rows = small_join(met, large, "shingle", "left_anti")
    cut = F.coalesce(percent * F.col("n") > 100 * F.lag("n").over(by_size), F.lit(False))
    rows = rows.withColumn("cut", cut.cast("int")).withColumn("part", F.sum("cut").over(by_size))
    part = Window.partitionBy("shingle", "part")
    rows = rows.withColumn("size", F.count("*").over(part)).where("size > 1")
    members = F.sort_array(F.collect_list(F.struct("sig", "n"))).alias("members")  # of OVERFULL sets at most
    small = rows.groupBy("shingle", "part").agg(members).select("members").distinct()  # regions with the same members are one
    small = small.select(F.xxhash64("members").alias("region"), F.inline("members")).select("region", "sig", "n")
    return small.unionByName(small_join(met, large, "shingle", "left_semi").select(F.xxhash64("shingle", F.lit("large")).alias("region"), "sig", "n"))


class Components:
    """Labels (sig, comp) of the nodes met so far; ``merge`` joins components along links."""

    def __init__(self, nodes: DataFrame) -> None:
        self.labels = written(nodes.select("sig", F.col("sig").alias("comp")))

    def of(self, rows: DataFrame, sig: str, comp: str) -> DataFrame:
        return rows.join(self.labels.select(F.col("sig").alias(sig), F.col("comp").alias(comp)), sig)

    def merge(self, links: DataFrame) -> None:
        """Each component takes the smallest label next to it, and that one's, until no link joins two labels."""
        edges = self.of(self.of(links.select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb").select("ca", "cb")
        edges = written(edges.distinct())
        while edges.limit(1).count():
            both = edges.unionByName(edges.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
            near = both.groupBy("ca").agg(F.min("cb").alias("to")).where("to < ca")
            one = written(near)
            further = one.select(F.col("ca").alias("to"), F.col("to").alias("next"))
            near = written(one.join(further, "to", "left").select(F.col("ca").alias("comp"), F.coalesce("next", "to").alias("to")))
            old = self.labels, edges, one, near
            self.labels = written(small_join(self.labels, near, "comp", "left").select("sig", F.coalesce("to", "comp").alias("comp")))
            for c in ("ca", "cb"):
                edges = small_join(edges, near.select(F.col("comp").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
            edges = written(edges.where("ca <> cb").distinct())
            discard(*old)
        discard(edges)


def sketch(own: np.ndarray) -> np.ndarray:
    """The parity of a set's shingles in each of 64 x 2^k bits. Of two sketches the longer one folds to the length of the other."""
    bits = 64 * SKETCH_WORDS
    while bits < len(own):
        bits *= 2
    return np.packbits((np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _apart(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The number of bits in which each of ``others`` differs from ``x``: never more than the sets' difference has shingles."""
    out = np.zeros(len(others), np.int64)
    lengths = np.fromiter(map(len, others), np.int64, len(others))
    for length in np.unique(lengths):
        own, rows, at = x, None, np.flatnonzero(lengths == length)
        rows = np.stack([others[k] for k in at])
        while len(own) > rows.shape[1]:
            own = own[: len(own) // 2] ^ own[len(own) // 2 :]
        while rows.shape[1] > len(own):
            rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
        out[at] = np.bitwise_count((rows ^ own).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return out


def _could_link(n_a: np.ndarray, n_b: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """False where the sets' sizes, or the least size ``apart`` of their difference, exclude a link."""
    both = n_a + n_b
    least = -(-percent * both // (100 + percent))  # of the intersection
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (apart <= both - 2 * least)


def _across(pieces: dict[str, np.ndarray], sketches: list[np.ndarray], percent: int, forests: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of sets of different components that could link, between the sets outside the largest component and all, one of them at home here
    and their distances to the pivot no more than r apart; and whether some were left for later.

    What could link is a graph from these sets to components. Of it ``forests`` edge-disjoint spanning forests are named, nearest pairs first, so the pairs
    are at most as many as there are sets and components, times the forests, while a group of near copies has a pair for every two. With 0 forests, the
    components alone are the nodes, of one forest."""
    every = np.flatnonzero(pieces["inner"] > 0)
    sizes, sigs, at, home = (pieces[c][every] for c in ("n", "sig", "at", "home"))
    r = 1 - percent / 100 + _EPSILON
    names, comp, members = np.unique(pieces["comp"], return_inverse=True, return_counts=True)
    by_set = (members[comp] > 1) & (forests > 0)
    node = np.where(by_set, len(names) + np.arange(len(comp)), comp)
    tree = np.tile(np.arange(len(names) + len(comp)), (max(1, forests), 1))  # of each node, in each forest
    target = comp[every]
    a, b, more = [], [], False
    for x in np.flatnonzero(pieces["outer"] > 0):
        n = pieces["n"][x]
        window = (target != comp[x]) & (np.abs(at - pieces["at"][x]) <= r) & (home | pieces["home"][x])
        near = np.flatnonzero(window & _could_link(n, sizes, np.zeros(1, np.int64), percent))
        if not len(near):
            continue
        apart = _apart(sketches[x], [sketches[k] for k in every[near]])
        fit = _could_link(n, sizes[near], apart, percent)
        near = near[fit][np.argsort(apart[fit], kind="stable")]
        for own in tree:
            met = own[target[near]]
            new = np.flatnonzero(met != own[node[x]])
            trees, first = np.unique(met[new], return_index=True)
            if len(trees):
                chosen = new[first]
                a += [pieces["sig"][x]] * len(chosen)
                b += sigs[near[chosen]].tolist()
                own[np.isin(own, trees)] = own[node[x]]
                near = np.delete(near, chosen)
            if not len(near):
                break
        more |= len(near) > 0
    return np.array(a, np.int64), np.array(b, np.int64), more


def pairs_across(rows: DataFrame, percent: int, forests: int) -> DataFrame:
    """(a, b) to verify, a < b, of the groups (region, inner block, outer block) of ``rows``; a row with a region instead says that it has more."""

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def group_pairs(tab: pa.Table) -> pa.RecordBatch:
            cols = {c: tab.column(c).to_numpy() for c in ("region", "i", "j", "sig", "n", "comp", "inner", "outer", "at")}
            cols["home"] = tab.column("home").to_numpy().astype(bool)
            lists = tab.column("sketch").combine_chunks()
            lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            sketches = [flat[s:e] for s, e in zip(ends[:-1], ends[1:])]
            starts = np.flatnonzero(np.r_[True, (cols["region"][1:] != cols["region"][:-1]) | (cols["i"][1:] != cols["i"][:-1]) | (cols["j"][1:] != cols["j"][:-1])])
            a, b, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for s, e in zip(starts, np.append(starts[1:], len(sketches))):
                x, y, left = _across({c: v[s:e] for c, v in cols.items()}, sketches[s:e], percent, forests)
                a.append(np.minimum(x, y))
                b.append(np.maximum(x, y))
                if left:
                    more.append(int(cols["region"][s]))
            both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            x, y = (pa.concat_arrays([pa.array(v), pa.nulls(len(more), pa.int64())]) for v in both.T)
            regions = pa.concat_arrays([pa.nulls(len(both), pa.int64()), pa.array(more, pa.int64())])
            return pa.RecordBatch.from_arrays([x, y, regions], ["a", "b", "region"])

        for batch in batches:  # sorted by group; the last group of a batch may go on
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            if not rest.num_rows:
                continue
            cols = [rest.column(c).to_numpy() for c in ("region", "i", "j")]
            last = np.flatnonzero(np.any([c != c[-1] for c in cols], axis=0))
            if len(last):
                yield group_pairs(rest.slice(0, last[-1] + 1))
                rest = rest.slice(last[-1] + 1)
        if rest is not None and rest.num_rows:
            yield group_pairs(rest)

    return rows.mapInArrow(freeing(compared), "a long, b long, region long")


def _blocks(members: DataFrame, components: Components, sketches: DataFrame, large: bool = False, diagonal: bool = False) -> DataFrame:
    """The groups to compare: the members of regions of several components, with sketches, by (region, i, j).

    All members are dealt into inner blocks i, those outside the region's largest component into outer blocks j too; each inner block
    meets each outer block, so a group has at most about 2 x BLOCK rows. ``large``: only regions of several groups. ``diagonal``: each block of
    members meets itself only.
    """
    rows = written(components.of(members.drop("n"), "sig", "comp"))
    comps = rows.groupBy("region", "comp").agg(F.count("*").alias("size"))
    largest = comps.groupBy("region").agg(F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("all"))
    largest = largest.where(F.col("top.size") < F.col("all")).select("region", F.col("top.comp").alias("top"), F.ceil(F.col("all") / BLOCK).alias("ni"), F.ceil((F.col("all") - F.col("top.size")) / BLOCK).alias("nj"))
    largest = written(largest.where("ni * nj > 1") if large else largest)
    rows = small_join(rows, largest, "region").withColumn("is_outer", F.col("comp") != F.col("top"))
    rows = rows.join(sketches.select("sig", "n", F.col("own").alias("sketch")), "sig")  # before a member is dealt into several blocks
    i, j = F.pmod(F.xxhash64("sig"), F.col("ni")), F.pmod(F.xxhash64("sig", F.lit(1)), F.col("nj"))
    if diagonal:
        both = rows.withColumns({"i": i, "j": i, "inner": F.lit(1), "outer": F.col("is_outer").cast("int")})
    else:
        inner = rows.withColumns({"i": i, "j": F.explode(F.sequence(F.lit(0).cast("long"), F.col("nj") - 1)), "inner": F.lit(1)})
        inner = inner.withColumn("outer", (F.col("is_outer") & (F.col("j") == j)).cast("int"))
        outer = rows.where("is_outer").withColumns({"j": j, "i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("ni") - 1)), "inner": F.lit(0), "outer": F.lit(1)})
        both = inner.unionByName(outer.where(F.col("i") != i))
    both = both.select("region", "i", "j", "sig", "comp", "inner", "outer", "at", "home", "n", "sketch")
    return both.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j")


def sets_of(rows: DataFrame, signer: Signer, width: int, sketched: bool = False) -> DataFrame:
    """sig, n, own of the different sets of texts."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in text_slices(batches, "text", SLICE_BYTES):
            sets = {signer(own): own for own in shingle_sets(texts, width) if len(own)}
            sets = {k: own for k, own in sets.items() if k not in seen}
            seen.update(sets)
            shown = [sketch(s) for s in sets.values()] if sketched else list(sets.values())
            columns = pa.array(list(sets), pa.int64()), pa.array(list(map(len, sets.values())), pa.int64()), pa.array([x.view(np.int64) for x in shown], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns), ["sig", "n", "own"])

    return rows.select("text").mapInArrow(freeing(made), "sig long, n long, own array<long>").dropDuplicates(["sig"])


class Sets:
    """The nodes' sets, made again from the texts where they are needed: sketches of all that are to be compared, shingles of the few that are
    compared exactly or are pivots."""

    def __init__(self, rows: DataFrame, keys: DataFrame, signer: Signer, width: int, percent: int) -> None:
        """``keys`` (sig, key): the hash of a text with each set."""
        self.rows, self.keys, self.signer, self.width, self.percent = rows, keys, signer, width, percent
        self.sketches: DataFrame | None = None

    def of(self, sigs: DataFrame, sketched: bool = False) -> DataFrame:
        """sig, n and own of the sets ``sigs`` (sig, distinct): the shingles, or their parity in each bit of a sketch."""
        keys = written(self.keys.join(sigs, "sig", "left_semi").select("key").distinct())
        texts = small_join(self.rows.select("text", F.xxhash64("text").alias("key")), keys, "key", "left_semi")
        return written(sets_of(texts, self.signer, self.width, sketched))

    def sketch_all(self, sigs: DataFrame) -> None:
        self.sketches = self.of(sigs, sketched=True)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets link: by their whole intersections, where sizes and sketches don't exclude it."""

        def both(rows: DataFrame, sets: DataFrame) -> DataFrame:
            for k in ("a", "b"):
                rows = rows.join(sets.select(F.col("sig").alias(k), F.col("n").alias(f"n_{k}"), F.col("own").alias(f"s_{k}")), k)
            return rows

        half = lambda s: (F.size(s) / 2).cast("int")
        folded = lambda s: F.zip_with(F.slice(s, F.lit(1), half(s)), F.slice(s, half(s) + 1, half(s)), lambda x, y: x.bitwiseXOR(y))
        s_a, s_b = F.col("s_a"), F.col("s_b")
        s_a, s_b = F.when(F.size(s_a) > F.size(s_b), folded(s_a)).otherwise(s_a), F.when(F.size(s_b) > F.size(s_a), folded(s_b)).otherwise(s_b)
        apart = F.aggregate(F.zip_with(s_a, s_b, lambda x, y: F.coalesce(F.bit_count(x.bitwiseXOR(y)), F.lit(0))), F.lit(0), lambda x, y: x + y)
        sizes = F.col("n_a") + F.col("n_b")
        least = F.ceil(self.percent * sizes / (100 + self.percent))
        near = (100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")) & (apart <= sizes - 2 * least)
        likely = written(both(pairs, self.sketches).where(near).select("a", "b"))
        if not likely.limit(1).count():
            return likely
        sets = self.of(likely.select(F.col("a").alias("sig")).union(likely.select("b")).distinct())
        links = both(likely, sets).where((100 + self.percent) * F.size(F.array_intersect("s_a", "s_b")) >= self.percent * sizes)
        links = written(links.select("a", "b"))
        discard(likely, sets)
        return links


def _collected(sets: DataFrame, most: int, order: Column) -> list[tuple[int, np.ndarray]]:
    """(sig, shingles) of at most ``most`` sets that are small enough for a pivot."""
    rows = sets.where(F.col("n") <= PIVOT_SHINGLES).orderBy(order, "sig").limit(most).collect()
    return [(r.sig, np.array(r.own, np.int64).view(np.uint64)) for r in rows]


def first_pivots(rows: DataFrame, n: int, width: int) -> Pivots:
    """Pivots of the first division: about MOST_PIVOTS texts by a hash, all copies of a text or none, then thinned."""
    drawn = rows.where(F.pmod(F.xxhash64("text", F.lit("pivot")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, MOST_PIVOTS / max(1, n))))
    found = _collected(sets_of(drawn, Signer({}), width), MOST_PIVOTS, F.xxhash64("sig"))
    return Pivots([s for _, s in found], [0] * len(found), [signature(s) for _, s in found]).thinned()


def divided(cells: DataFrame, sets: Sets, percent: int, first: int) -> tuple[DataFrame, DataFrame]:
    """``cells`` (cell, sig, n, at, home, links) with those that are overfull divided, and the links (a, b) to the new pivots. New cells are numbered from ``first``."""
    spark, links = cells.sparkSession, None
    for depth in range(MOST_DIVISIONS):
        counts = cells.where("not links").groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > OVERFULL)
        full = {r.cell: r["size"] for r in counts.orderBy(F.desc("size"), "cell").limit(max(1, MOST_PIVOTS // PIVOTS_PER_CELL)).collect()}
        if not full:
            break
        chance = F.create_map(*[F.lit(x) for c, m in full.items() for x in (c, int((1 << 30) * PIVOTS_PER_CELL / m))])
        inside = cells.where(F.col("cell").isin(list(full)))
        drawn = inside.where(~F.col("links") & F.col("home") & (F.pmod(F.xxhash64("sig", F.lit(depth)), F.lit(1 << 30)) < chance[F.col("cell")]))
        drawn = {r.sig: r.cell for r in drawn.orderBy(F.xxhash64("sig")).limit(2 * MOST_PIVOTS).select("sig", "cell").collect()}
        picked = _collected(sets.of(spark.createDataFrame([(s,) for s in drawn], "sig long")), MOST_PIVOTS, F.xxhash64("sig"))
        pivots = Pivots([s for _, s in picked], [drawn[k] for k, _ in picked], [(k, 0) for k, _ in picked], first).thinned()
        residue = {c: first + len(pivots.sets) + k for k, c in enumerate(full)}
        sent = spark.sparkContext.broadcast((pivots, residue))

        def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, residue = sent.value
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    own = np.array(row["own"], np.int64).view(np.uint64)
                    places, outside, at_home = pivots.places(own, row["cell"], percent, RADIUS[1])
                    places = places + [(residue[row["cell"]], row["at"], at_home, False)] * outside
                    out += [(c, row["sig"], row["n"], at, home and row["home"], link) for c, at, home, link in places]
                columns = list(zip(*out)) if out else [[]] * 6
                types = {"cell": pa.int64(), "sig": pa.int64(), "n": pa.int64(), **{k: v for k, v in _CELL.items() if k != "cell"}}
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], list(types))

        own = sets.of(inside.select("sig").distinct())
        # the residue keeps the distances to the pivot of the cell that was divided, so they still bound what can link
        new = inside.join(own.select("sig", "own"), "sig").select("cell", "sig", "n", "at", "home", "own").mapInArrow(freeing(dealt), "cell long, sig long, n long, at double, home boolean, links boolean")
        new = written(new)
        names = spark.createDataFrame([(first + k, s[0]) for k, s in enumerate(pivots.signatures)], "cell long, a long")
        found = new.where("links").join(F.broadcast(names), "cell").select("a", F.col("sig").alias("b")).where("a <> b").distinct()
        links = found if links is None else links.unionByName(found)
        cells = written(cells.where(~F.col("cell").isin(list(full))).unionByName(new))
        first += len(pivots.sets) + len(full)
    return cells, links if links is not None else spark.createDataFrame([], "a long, b long")


def _nodes(df: DataFrame, *, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (hash of the text), n and comp (a set's component; null without words) of each row."""
    rows = as_documents(df, id_col, text_col)
    n = rows.count()
    pivots = first_pivots(rows, n, width)
    first = written(signed_documents(rows, pivots, width, percent))

    halves = first.where("sig is not null").groupBy("sig").agg(F.min("low").alias("own"), F.max("low").alias("other")).where("own <> other")
    clashes = {r.sig: r.own for r in halves.collect()}  # n^2 / 2^65 rows are to be expected: none, or some hundred of 10^11 sets
    signer = Signer(clashes)
    own = F.try_element_at(F.create_map(*[F.lit(x) for c in clashes.items() for x in c]), F.col("sig")) if clashes else F.lit(None)
    sig = F.when(F.coalesce(own != F.col("low"), F.lit(False)), F.col("low")).otherwise(F.col("sig")).alias("sig")
    documents = first.where("key is not null").select("doc_id", "key", "n", sig)
    common = heavy_bits(first.where("shingle is not null").select("shingle", "met"))

    keys = written(documents.where("sig is not null").groupBy("sig").agg(F.min("key").alias("key")))
    sets = Sets(rows, keys, signer, width, percent)
    centres = df.sparkSession.createDataFrame([(k, signer(s)) for k, s in enumerate(pivots.sets)], "cell long, a long")
    cells = written(first.where("cell is not null").select("cell", sig, "n", "at", "home", "links").distinct())
    links = cells.where("links").join(F.broadcast(centres), "cell").select("a", F.col("sig").alias("b")).where("a <> b").distinct()
    cells, more = divided(cells, sets, percent, len(pivots.sets))
    residue = written(regions(met_again(windows(rows, common, pivots, signer, width, percent)), percent))

    several = written(cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1").select("cell"))
    cells = written(small_join(cells, several, "cell", "left_semi"))
    nodes = written(cells.select("sig").union(residue.select("sig")).distinct())
    components = Components(nodes)
    components.merge(links.unionByName(more))
    spread = components.of(cells, "sig", "comp").groupBy("cell").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("cell")
    cells = small_join(cells, written(spread), "cell", "left_semi")  # cells that are connected are finished
    members = residue.select("region", "sig", "n", F.lit(0.0).alias("at"), F.lit(True).alias("home"))
    members = members.unionByName(cells.select(F.xxhash64("cell", F.lit("cell")).alias("region"), "sig", "n", "at", "home"))
    members = written(members.groupBy("region", "sig", "n").agg(F.min("at").alias("at"), F.max("home").alias("home")))
    sets.sketch_all(members.select("sig").distinct())

    centre = residue.groupBy("region").agg(F.min_by("sig", F.xxhash64("sig")).alias("a"))
    checked = written(small_join(residue, centre, "region").where("sig <> a").select(F.least("a", "sig").alias("a"), F.greatest("a", "sig").alias("b")).distinct())
    if checked.limit(1).count():
        components.merge(sets.verified(checked))
    blocks = written(members.groupBy("region").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("region"))
    first = [(True, True, 0), (True, False, 0)] if blocks.limit(1).count() else []
    rest = written(small_join(members, blocks, "region", "left_semi")) if first else members
    for large, diagonal, forests in chain(first, ((False, False, 4**k) for k in count(1))):
        rest = rest if large or forests > 4 else members
        found = written(pairs_across(_blocks(rest, components, sets.sketches, large, diagonal), percent, forests).distinct())
        new = written(found.where("a is not null").select("a", "b").join(checked, ["a", "b"], "left_anti"))
        if new.limit(1).count():
            components.merge(sets.verified(new))
        more = found.where("a is null").select("region").distinct()
        if not large and not more.limit(1).count():
            break
        if not large:
            rest = written(small_join(rest, more, "region", "left_semi"))  # a region without more has named all that could link
        checked = written(checked.unionByName(new))
    return documents.join(components.labels, "sig", "left").select("doc_id", "key", "n", F.coalesce("comp", "sig").alias("comp"))


def jaccard_components(df: DataFrame, *, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Two documents link when 100 * |x & y| >= ``percent`` * |x | y| for their sets of distinct shingles of ``width`` words (lower-cased A-Z; runs
    of anything but ASCII white space). A text with fewer words is one shingle; one without words, or a null, has none and is linked with
    nothing. Copies of a text link. No pair is left out: no cap on cells, regions, partners or candidates. A shingle is known by 64 bits of hash, a set by 128.

    Repeated rows are returned each. A null doc_id takes part, also where it connects others, and has its component's id (null, if that has none). An
    empty table gives no rows. Other columns are not read. Overfull cells and regions are divided or compared in blocks of bounded size; what reaches
    the driver is bounded: pivots, numbers of overfull cells, and the bits of common shingles.
    """
    nodes = written(_nodes(df, percent=percent, width=width, id_col=id_col, text_col=text_col))
    several = nodes.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows"))
    smallest = written(several.where("rows > 1").drop("rows"))
    return small_join(nodes, smallest, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(df: DataFrame, *, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of documents that link over any number of others: that with the smallest id (null ids last), of equal ids the one whose
    text has the smallest hash, of rows equal in both any. Rows without words aren't linked and stay. A row is known by its id and text, so other rows
    of an id stay. All columns stay."""
    nodes = written(_nodes(df, percent=percent, width=width, id_col=id_col, text_col=text_col).where("comp is not null"))
    rank = F.struct(F.isnull("doc_id").alias("last"), "doc_id", "key")
    best = written(nodes.groupBy("comp").agg(F.min(rank).alias("best"), F.count("*").alias("rows")).where(F.col("rows") > 1))
    each = small_join(nodes, best, "comp").groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.max((F.col("best.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("best.key") == F.col("key"))).alias("__best"), F.count("*").alias("__rows"))
    named = df.withColumn("__row", F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    same = lambda t: F.col(f"`{id_col}`").eqNullSafe(t["__id"]) & (F.col("__row") == t["__key"])
    gone = written(each.where("not __best or __rows > 1").select("__id", "__key"))
    few = gone.limit(MOST_SENT_ROWS + 1).count() <= MOST_SENT_ROWS
    kept = named.join(F.broadcast(gone) if few else gone, same(gone), "left_anti").drop("__row")
    again = written(each.where("__best and __rows > 1").select("__id", "__key"))  # the same id and text more than once
    if again.limit(1).count():
        kept = kept.unionByName(named.join(again, same(again), "left_semi").dropDuplicates([id_col, "__row"]).drop("__row"))
    return kept
