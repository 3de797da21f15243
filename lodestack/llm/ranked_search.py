"""Ranked lexical search: documents that score alike by construction are one class, scored once, whose members follow in the order of their ids."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import as_documents, freeing, text_slices, written

#: Items are searched for in blocks of about so many; only a block's terms, and what its items score, are in memory at once.
BLOCK_ITEMS = 1000

#: Scores of so many classes x items are in memory at once.
CELLS = 1 << 20

#: Length's part in a document's m, of 100.
LENGTH_SHARE = 75

_NO_ID = np.iinfo(np.int64).max
_EXACT = 2**53

#: By byte: A-Z in lower case, other ASCII characters that are no letter or digit as a blank; bytes of other characters stay.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def _item_terms(items: DataFrame) -> DataFrame:
    """item, term, times of ``items`` (item, text)."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches, "text"):
            out = [(item, term, n) for item, text in zip(piece.column("item").to_pylist(), texts) for term, n in Counter(terms(text)).items()]
            columns = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64()))], ["item", "term", "times"])

    return items.select("item", "text").mapInArrow(cut, "item long, term binary, times long")


def _bags(rows: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (all terms), bag of each row with a term. The bag has the text's terms that are in the vocabulary, by their numbers, and how often:
    pairs of 32-bit numbers, so equal bags are equal bytes."""
    sent = rows.sparkSession.sparkContext.broadcast({term: k for k, term in enumerate(vocabulary)})

    def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for piece, texts in text_slices(batches, "text"):
            sizes, found = [], []
            for text in texts:
                own = Counter(terms(text))
                sizes.append(own.total())
                pairs = sorted((number[t], own[t]) for t in own.keys() & number.keys())
                found.append(np.array(pairs, "<u4").tobytes())
            some = pa.array(np.array(sizes) > 0)
            columns = [piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "bag"]).filter(some)

    return rows.mapInArrow(freeing(bags), "doc_id long, n long, bag binary")


def _holders(bags: DataFrame, n_terms: int) -> np.ndarray:
    """How many rows hold each term of the vocabulary; tasks add up before the shuffle."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("bag").to_pylist()), "<u4")[::2], minlength=n_terms)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["term", "df"])

    found = bags.select("bag").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


class Query:
    """A block's items (``ids``) by term: for term t the items ``item[start[t]:start[t + 1]]`` hold it ``times`` times, and it weighs ``weight[t]``."""

    def __init__(self, item: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray, ids: np.ndarray, top: int) -> None:
        self.ids = ids
        order = np.argsort(term, kind="stable")
        self.item, self.times = item[order], times[order]
        self.start = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.weight, self.n_items, self.top = weight, len(ids), top
        most = np.bincount(item, weights=times, minlength=1).max() * max(1, int(weight.max(initial=0))) * 1_000_000
        self.exact = most < _EXACT  # sums in doubles are whole numbers

    def scores(self, bags: list[bytes], m: np.ndarray) -> np.ndarray:
        """The score of each bag (rows) for each item (columns)."""
        pairs = np.frombuffer(b"".join(bags), "<u4").astype(np.int64).reshape(-1, 2)
        row = np.repeat(np.arange(len(bags)), [len(b) // 8 for b in bags])
        term, tf = pairs[:, 0], pairs[:, 1]
        value = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        items = self.start[term + 1] - self.start[term]
        each = np.repeat(np.arange(len(term)), items)
        at = np.arange(len(each)) - np.repeat(np.cumsum(items) - items, items) + self.start[term][each]
        cell, amount = row[each] * self.n_items + self.item[at], value[each] * self.times[at]
        if self.exact:
            flat = np.bincount(cell, weights=amount, minlength=len(bags) * self.n_items).astype(np.int64)
        else:
            flat = np.zeros(len(bags) * self.n_items, np.int64)
            np.add.at(flat, cell, amount)
        return flat.reshape(len(bags), self.n_items)


class Best:
    """For each item the ``top`` best (score, id) so far, the highest score and then the smallest id first, and what comes with them."""

    def __init__(self, n_items: int, top: int) -> None:
        self.top = top
        self.least = np.ones(n_items, np.int64)
        self.item, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.rest: list[tuple] = []

    def add(self, scores: np.ndarray, ids: np.ndarray, rest: list[tuple]) -> None:
        row, item = np.nonzero(scores >= self.least)
        self.item, self.score, self.id = np.r_[self.item, item], np.r_[self.score, scores[row, item]], np.r_[self.id, ids[row]]
        self.rest += [rest[k] for k in row.tolist()]
        order = np.lexsort((self.id, -self.score, self.item))
        place = np.arange(len(order)) - np.searchsorted(self.item[order], self.item[order])
        stay = order[place < self.top]
        self.item, self.score, self.id, self.rest = self.item[stay], self.score[stay], self.id[stay], [self.rest[k] for k in stay.tolist()]
        last = place[place < self.top] == self.top - 1
        self.least[self.item[last]] = self.score[last]  # equal scores may still have a smaller id


def _top_classes(classes: DataFrame, query: Query) -> DataFrame:
    """item, score, first, m, bag: each task's best classes for each item; ``classes`` has first (the smallest id), m, bag."""
    sent = classes.sparkSession.sparkContext.broadcast(query)

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = sent.value
        found, rows = Best(query.n_items, query.top), max(1, CELLS // max(1, query.n_items))
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                piece = batch.slice(start, rows)
                m, ids, bags = piece.column("m").to_numpy(), piece.column("first").to_numpy(), piece.column("bag").to_pylist()
                found.add(query.scores(bags, m), ids, list(zip(m.tolist(), bags)))
        m, bags = zip(*found.rest) if found.rest else ([], [])
        columns = [pa.array(query.ids[found.item]), pa.array(found.score), pa.array(found.id), pa.array(m, pa.int64()), pa.array(bags, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["item", "score", "first", "m", "bag"])

    return classes.mapInArrow(freeing(best), "item long, score long, first long, m long, bag binary")


def _block(rows: DataFrame, items: DataFrame, top: int) -> DataFrame | None:
    """item, rank, doc_id, score of one block of items (item, text)."""
    held = _item_terms(items).toArrow()  # some 1,000 items
    if not held.num_rows:
        return None
    vocabulary = sorted(set(held.column("term").to_pylist()))
    number = {t: k for k, t in enumerate(vocabulary)}
    ids, item = np.unique(held.column("item").to_numpy(), return_inverse=True)
    term = np.array([number[t] for t in held.column("term").to_pylist()])
    bags = written(_bags(rows, vocabulary))
    n_docs, n_terms = bags.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in _holders(bags, len(vocabulary)).tolist()], np.int64)
    query = Query(item, term, held.column("times").to_numpy(), weight, ids, top)

    m = F.expr(f"{100 - LENGTH_SHARE} + (({LENGTH_SHARE}L * n * {n_docs}L) div {n_terms}L)").alias("m")
    own = bags.where(F.length("bag") > 0).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), m, "bag").withColumn("hash", F.xxhash64("m", "bag"))
    same = Window.partitionBy("hash", "m", "bag")  # the hash deals classes out, m and the bag's bytes tell them apart
    members = written(own.withColumn("place", F.row_number().over(same.orderBy("doc_id"))).where(F.col("place") <= top))
    classes = members.where(F.col("place") == 1).select(F.col("doc_id").alias("first"), "m", "bag")
    by_item = Window.partitionBy("item")
    best = _top_classes(classes, query).withColumn("place", F.row_number().over(by_item.orderBy(F.desc("score"), "first"))).where(F.col("place") <= top)
    best = written(best.select("item", "score", "m", "bag").withColumn("hash", F.xxhash64("m", "bag")))
    found = best.join(members.drop("place"), ["hash", "m", "bag"])
    found = found.withColumn("rank", F.row_number().over(by_item.orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= top)
    return found.select("item", "rank", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def rank_documents(df: DataFrame, items: DataFrame, *, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``top`` best rows of ``df`` for each item: item_id, rank (from 1), doc_id, score (above 0), equal scores by ascending doc_id.

    A text's terms are its maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case. With N rows that have a term, L
    their terms in all, df rows that hold a term: its weight is floor(1000 ln((2 N + 2) / (2 df + 1))). With n terms in a row m is
    25 + (75 n N) div L, and the row's score for an item adds weight x ((10^9 tf) div (1000 tf + 8 m)) for each of the item's terms, repeats included.

    Rows that hold the same terms of the items equally often and have the same m score alike for every item: they are one class, known by a hash and by
    its bytes, scored once. Only a class's ``top`` smallest ids, and an item's ``top`` best classes, can be in a result.

    Null and empty texts have no terms and are in no result, neither as rows nor as items. Repeated rows are ranked each, and so are items, known by id and text:
    those equal in both are one. Null ids come last among equals. Empty tables give no rows. Other columns are not read. Items of any number are searched in
    blocks of about BLOCK_ITEMS, each against all rows.
    """
    rows = as_documents(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    named = as_documents(items, item_col, item_text).withColumnRenamed("doc_id", "item_id").distinct()
    named = written(named.withColumn("item", F.monotonically_increasing_id()))
    n_blocks = -(-named.count() // BLOCK_ITEMS) or 1
    out = None
    for k in range(n_blocks):
        found = _block(rows, named.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k), top)
        if found is not None:
            found = written(found) if n_blocks > 1 else found
            out = found if out is None else out.unionByName(found)
    if out is None:
        return named.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return out.join(named.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
