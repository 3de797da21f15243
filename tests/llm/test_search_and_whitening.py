"""Exact deduplication, ranked search and whitening against brute force."""

import hashlib
import math
import random
import re
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from lodestack.llm import ranked_search, whitening
from lodestack.llm.exact_dedup import Directory, HashIndex, drop_copies, exact_duplicates
from lodestack.llm.ranked_search import rank_documents
from lodestack.llm.whitening import characteristic_polynomial, largest_roots, null_space, whiten

# Exact deduplication


def duplicates(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, len(t or "")))
    out = []
    for bare, rows in groups.items():
        keep, chars = min(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        digest = hashlib.sha256(bare.encode()).hexdigest()
        out += [(i, keep, len(rows), i == keep and n == chars, digest) for i, n in rows]
    return sorted(out, key=repr)


def texts(seed, n):
    r = random.Random(seed)
    pool = [" ".join(r.choice(["a", "bb", "cé", "中", "x y"]) for _ in range(r.randint(0, 4))) for _ in range(n // 4)]
    return [(k, r.choice([t, t.replace(" ", "\n\t"), t + "  ", None if r.random() < 0.1 else t])) for k, t in enumerate(r.choice(pool) for _ in range(n))]


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_exact_duplicates_against_brute_force(documents, rows, bits):
    docs = [*texts(bits, 300), (7, "a bb"), (7, "a bb"), (None, "only null"), (None, "dup"), (900, "dup"), (901, "d u p"), (902, "z" * 300_000), (903, " ".join("z" * 300_000))]
    df = documents(*docs).withColumnRenamed("n_chars", "key")
    found = exact_duplicates(df, key_bits=bits)
    assert rows(found) == duplicates(docs)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_exact_duplicates_of_a_hot_text_and_of_nothing(spark, documents, rows, monkeypatch):
    monkeypatch.setattr("lodestack.llm.exact_dedup.COMBINED_BYTES", 2000)
    df = spark.range(6000, numPartitions=7).selectExpr("id AS doc_id", "CASE WHEN id % 3 > 0 THEN 'hot text' ELSE concat('t', id) END AS text")
    found = exact_duplicates(df, bucket_bytes=500)
    assert found.where("group_size = 4000 AND keep_id = 1").count() == 4000
    assert found.where("group_size = 1 AND kept").count() == 2000
    assert exact_duplicates(documents().where("false")).count() == 0


def test_chains_hold_what_shares_a_key(documents):
    index = HashIndex.build(documents((1, "a"), (2, "b"), (3, "a "), (4, "c")).select("doc_id", "text"), key_bits=0)
    assert [tuple(r) for r in index.entries.select("chain", "content", "n").orderBy("chain").collect()] == [(0, bytearray(b"a"), 2), (1, bytearray(b"b"), 1), (2, bytearray(b"c"), 1)]


def test_drop_copies_keeps_rows_whole(documents, rows):
    df = documents((1, "a b"), (2, "a  b"), (3, None), (4, ""), (5, "c"))
    assert rows(drop_copies(df), "doc_id", "text") == [(2, "a  b"), (3, None), (5, "c")]


def test_the_directory_doubles_where_a_bucket_is_overfull():
    load = np.array([90, 1, 1, 1, 1, 1, 1, 4])
    directory = Directory()
    directory.fill(load, 10)
    assert directory.depth == 3 and len(directory.slots) == 8
    assert sorted(directory.local) == [1, 2, 3, 3]  # the upper half was never split
    key = (np.arange(8, dtype=np.uint64) << np.uint64(61)).view(np.int64)
    bucket = directory.bucket(key)
    assert len({bucket[k] for k in (4, 5, 6, 7)}) == 1 and bucket[2] == bucket[3] and len({bucket[0], bucket[1], bucket[2], bucket[4]}) == 4
    owner = directory.owners(load, 4)[bucket]
    assert (np.diff(owner) >= 0).all() and owner[0] == 0 and owner[7] == 3


# Ranked search


def ranked(docs, items, top=10):
    cut = lambda t: [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    own = [(i, cut(t)) for i, t in docs]
    own = [(i, w) for i, w in own if w]
    n_docs, n_terms = len(own), sum(len(w) for _, w in own)
    out = []
    for item, text in set(items):
        found = []
        for i, w in own:
            m = 25 + 75 * len(w) * n_docs // n_terms
            score = 0
            for t in cut(text):
                df = sum(t in x for _, x in own)
                if df and (tf := w.count(t)):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def searchable(seed, n):
    r = random.Random(seed)
    words = ["The", "cat", "café", "x1", "中文", "dog's", " ", "of", "rare%d", "A-b"]
    text = lambda k: " ".join(w % k if "%" in w else w for w in r.choices(words, k=r.randint(0, 9)))
    pool = [text(k) for k in range(n // 3)]
    return [(k, r.choice(pool)) for k in range(n)], [(k, text(k)) for k in range(12)]


@pytest.mark.parametrize("blocks", [1000, 4])
def test_ranked_search_against_brute_force(spark, documents, rows, monkeypatch, blocks):
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", blocks)
    monkeypatch.setattr(ranked_search, "CELLS", 50)
    docs, items = searchable(blocks, 120)
    docs += [(None, "cat cat"), (5, "cat"), (5, "cat"), (300, None), (301, " -- "), (302, "cat " * 20_000)]
    items += [(1, "cat"), (1, "cat"), (50, None), (51, "..."), (52, "unseen words"), (None, "dog")]
    df = documents(*docs).repartition(5).withColumnRenamed("n_chars", "score")
    found = rank_documents(df, spark.createDataFrame(items, "item_id long, text string"))
    assert rows(found) == ranked(docs, items)


def test_ranked_search_of_one_class_and_of_nothing(spark, documents):
    items = spark.createDataFrame([(1, "needle"), (2, "none")], "item_id long, text string")
    df = spark.range(5000, numPartitions=6).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 1 THEN 'needle' ELSE concat('w', id) END AS text")
    assert [r.doc_id for r in rank_documents(df, items).orderBy("rank").collect()] == list(range(1, 20, 2))
    assert rank_documents(df.where("false"), items).count() == 0
    assert rank_documents(df, items.where("false")).count() == 0


def test_scores_beyond_doubles_stay_whole():
    query = ranked_search.Query(np.array([0]), np.array([0]), np.array([10**6]), np.array([30_000]), np.array([0]), 10)
    assert not query.exact
    bag = np.array([0, 3], "<u4").tobytes()
    assert query.scores([bag], np.array([25]))[0, 0] == 10**6 * 30_000 * (3 * 10**9 // 3200)


# Whitening


def determinant_polynomial(matrix):
    """By Faddeev and LeVerrier, in fractions."""
    d = len(matrix)
    a = [[Fraction(v) for v in row] for row in matrix]
    out, m = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        m = [[sum(a[i][x] * m[x][j] for x in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        out.append(-sum(a[i][x] * m[x][i] for i in range(d) for x in range(d)) / k)
    return [int(v) for v in reversed(out)]


@pytest.mark.parametrize("d", [1, 2, 3, 7])
def test_characteristic_polynomial(spark, d):
    r = random.Random(d)
    b = np.array([[r.randint(-(10**6), 10**6) for _ in range(d)] for _ in range(d)], object)
    for matrix in (b @ b.T, np.diag(np.arange(d)).astype(object), np.zeros((d, d), object)):
        assert characteristic_polynomial(spark, matrix) == determinant_polynomial(matrix.tolist())


def test_roots_close_and_multiple():
    p = [1]
    for root in (5, 5, 10**12, 10**12 + 1, 0):
        p = [b - root * a for a, b in zip([*p, 0], [0, *p])]
    found = largest_roots(p, 4, 3 * 10**12)
    assert [m for _, m in found] == [1, 1, 2]
    assert all(abs(x - y) < Decimal(10) ** -40 for (x, _), y in zip(found, (10**12 + 1, 10**12, 5)))


def test_null_space_of_a_multiple_root():
    matrix = np.array([[2, 1, 1], [1, 2, 1], [1, 1, 2]], object)
    v = null_space(matrix, Decimal(1), 2)
    assert np.allclose(v @ v.T, np.eye(2), atol=1e-15) and np.allclose(v.sum(axis=1), 0, atol=1e-15)


def test_whitening_against_numpy(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(400, 6)) @ np.diag([5, 3, 2, 1.5, 0.5, 0.1]) + 1000
    vectors = [*base.tolist(), *base[:150].tolist(), None, [1.0, None, 3.0, 4.0, 5.0, 6.0], [math.nan] * 6, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], []]
    df = spark.createDataFrame([(k, v, k) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, n long").repartition(5)
    got = whiten(df).toPandas().sort_values(["component", "vec_id"])
    x = np.floor(np.float32(base).astype(float) * 256).astype(np.int64)
    one = np.unique(x, axis=0)
    n, s = len(one), one.sum(axis=0)
    centred = one - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    assert set(got.vec_id) == set(range(550)) and set(got.n) == {n}
    every = np.r_[x, x[:150]]
    for k in range(4):
        own = got[got.component == k + 1]
        expected = (every - s / n) @ v[:, -1 - k] / math.sqrt(e[-1 - k])
        sign = np.sign(expected @ own.whitened.to_numpy())
        assert np.allclose(own.whitened, sign * expected, atol=1e-8)
        assert np.allclose(own.explained, e[-1 - k] / e.sum(), rtol=1e-9)
        assert own.deviation.tolist() == ((n * every - s) ** 2).sum(axis=1).tolist()
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_whitening_of_equal_vectors_of_few_dimensions_and_of_nothing(spark):
    frame = lambda *v: spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    assert whiten(frame()).count() == 0
    assert whiten(frame([1.0, 2.0], [1.0, 2.0], None)).count() == 0
    found = whiten(frame([0.0, 0.0], [1.0, 0.0], [2.0, 0.0])).toPandas()
    assert set(found.component) == {1} and np.allclose(sorted(abs(found.whitened)), [0, 1.5**0.5, 1.5**0.5])
    square = whiten(frame([0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0])).toPandas()  # a double eigenvalue
    assert set(square.component) == {1, 2} and np.allclose(square.explained, 0.5) and square.identity_error.iloc[0] < 1e-12
    large = whiten(frame([2.0**40, 1.0], [-(2.0**40), 5.0], [3.0, 7.0])).toPandas()
    assert large.deviation.isna().any() and np.isfinite(large.whitened).all()
    assert whitening.GRID == 256
