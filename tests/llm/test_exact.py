"""Operators with one right answer: against brute force, the tokenizer libraries, and round trips."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as s
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestack.llm import decontaminate, jaccard_join
from lodestack.llm.decontaminate import drop_leaks, find_leaks
from lodestack.llm.jaccard_join import jaccard_components, keep_one_of_each
from lodestack.llm.packing import ChunkIds, Levels, pack_documents
from lodestack.llm.sharding import assign_shards, write_shards
from lodestack.llm.token_count import RaggedMerges, count_tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n", "  a\n\n b ", "it's we'll 1234 ...!?", "<|endoftext|>x <|startoftext|>", "é e\u0301 \u00a0 \u2003 \x85 \x1c", "aaaaaaaa" * 40, "中文 👍🏽", "\t\r\n x"]


def components(docs, percent=80):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rnd, n_groups=8, most=12):
    docs, k = [], 0
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(4))
    shared = [word() for _ in range(30)]
    for _ in range(n_groups):
        base = [word() for _ in range(rnd.choice((3, 6, 20, 60, 200)))]
        for _ in range(rnd.randrange(1, most)):
            own = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 25)):
                own[rnd.randrange(len(own))] = word()
            if rnd.random() < 0.3:
                own += shared
            docs.append((k, " ".join(own) if rnd.random() < 0.8 else " ".join(own).upper()))
            k += 1
    return docs + [(k, None), (k + 1, ""), (k + 2, " \n "), (k + 3, "one two"), (k + 4, "One  TWO")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components(documents, seed, monkeypatch):
    if seed == 2:  # small bounds, so that large regions, blocks and shuffle joins are met
        for name, value in (("OVERFULL", 3), ("BLOCK", 2), ("MOST_SENT_ROWS", 1), ("MOST_PIVOTS", 8), ("PIVOTS_PER_CELL", 2)):
            monkeypatch.setattr(jaccard_join, name, value)
    elif seed == 3:  # no pivots among the sets: all is residue
        monkeypatch.setattr(jaccard_join, "MOST_PIVOTS", 0)
    docs = near_copies(random.Random(seed))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(documents(*docs).withColumn("sig", F.lit(1))).collect()}
    want = components(docs)
    assert got == want and len({c for _, c in want.values()}) < len(docs) - 5
    kept = {r.doc_id for r in keep_one_of_each(documents(*docs)).collect()}
    assert kept == {c for _, c in want.values()}


def test_pairs_of_a_group_are_forests():
    rnd = np.random.default_rng(5)
    base = rnd.integers(1, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.r_[np.delete(base, rnd.integers(0, 300, 8)), rnd.integers(1, 1 << 62, 8).astype(np.uint64)]) for _ in range(120)]
    one = np.ones(120, np.int64)
    pieces = {"sig": np.arange(120), "n": np.array(list(map(len, sets))), "comp": np.arange(120), "inner": one, "outer": one, "at": np.zeros(120), "home": one > 0}
    sketches = [jaccard_join.sketch(x) for x in sets]
    for comps, forests, bound in ((120, 0, 119), (120, 1, 119), (120, 4, 4 * 119), (3, 0, 2), (3, 1, 122)):
        a, b, more = jaccard_join._across(pieces | {"comp": np.arange(120) % comps}, sketches, 80, forests)
        assert len(a) <= bound and more and not (a % comps == b % comps).any()
        tree = np.arange(120) % comps
        for x, y in zip(a, b):
            tree[tree == tree[x]] = tree[y]
        assert len(set(tree)) == 1  # connected as by all pairs
    a, b, more = jaccard_join._across(pieces, sketches, 80, 256)
    assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())} == {(x, y) for y in range(120) for x in range(y)} and not more


def test_only_regions_with_more_are_joined_again(documents, monkeypatch):
    met, dealt = [], jaccard_join._blocks

    def counted(members, components, sketches, large=False, diagonal=False):
        met.append((large, members.select("region").distinct().count()))
        return dealt(members, components, sketches, large, diagonal)

    for name, value in (("OVERFULL", 3), ("BLOCK", 2), ("MOST_PIVOTS", 0), ("_blocks", counted)):
        monkeypatch.setattr(jaccard_join, name, value)
    docs = near_copies(random.Random(4))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(documents(*docs)).collect()}
    assert got == components(docs)
    rounds = [n for large, n in met if not large]
    assert all(n < rounds[0] for large, n in met if large) and all(b < a for a, b in zip(rounds, rounds[1:])), met


def test_signatures_that_clash_in_one_half():
    sets = [np.array([k, k + 1], np.uint64) for k in range(3)]
    whole = [jaccard_join.signature(x) for x in sets]
    assert [jaccard_join.Signer({})(x) for x in sets] == [a for a, _ in whole]
    signer = jaccard_join.Signer({whole[0][0]: whole[0][1], whole[1][0]: whole[1][1] - 1})
    assert [signer(x) for x in sets] == [whole[0][0], whole[1][1], whole[2][0]]


def test_one_row_of_a_group_stays(documents):
    a, b = "one two three four five six seven", "other words that are no copy of anything"
    df = documents((1, a), (2, a), (2, b), (None, a), (3, b), (3, b), (None, None), (None, None), (4, "")).withColumn("key", F.lit(1)).withColumn("comp", F.lit(2))
    kept = sorted((repr(r.doc_id), str(r.text)) for r in keep_one_of_each(df).collect())
    assert kept == sorted([("1", a), ("2", b), ("None", "None"), ("None", "None"), ("4", "")])
    only = documents((None, a), (None, a), (None, b), (7, b + " " + b), (7, b + " " + b))
    assert sorted((r.doc_id is None, r.text) for r in keep_one_of_each(only).collect()) == [(False, b + " " + b), (True, a), (True, b)]
    linked = {repr(r.doc_id): r.component_id for r in jaccard_components(documents((9, a), (None, a), (None, b))).where("doc_id is not null").collect()}
    assert linked == {"9": 9}


def test_jaccard_threshold_and_empty(documents):
    words = [f"w{k}" for k in range(13)]  # 9 shingles
    a, b = " ".join(words), " ".join(words[:12])  # 8 of 9 shared
    c, d = " ".join(f"v{k}" for k in range(8)), " ".join(f"v{k}" for k in range(9))  # 4 of 5: 80 % exactly
    e = " ".join(f"v{k}" for k in range(7))  # 3 of 4 of c: no link
    got = {r.doc_id: r.component_id for r in jaccard_components(documents((5, a), (2, b), (9, c), (7, d), (1, e))).collect()}
    assert got == {5: 2, 2: 2, 9: 7, 7: 7, 1: 1}
    assert jaccard_components(documents().limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(s.text(max_size=40) | s.text(alphabet=list(" \n\t'sabcdetr1,é<|endoftx>"), max_size=60))
def test_counts_are_the_librarys(text):
    own = test_counts_are_the_librarys.__dict__
    if "merges" not in own:
        own["merges"], own["library"] = RaggedMerges(BYTE, public_tokenizers.PATTERN), Tokenizer.from_file(BYTE)
    assert own["merges"].count([text]) == [len(own["library"].encode(text, add_special_tokens=False).ids)]


@settings(max_examples=400, deadline=None)
@given(s.text(alphabet=[*" \n\t\r\v\f\x1c\x1f\x85\xa0\u1680\u2002\u2003\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff", *" \xa0" * 4, *"ab1."], max_size=40))
@example("Name: \u00a0 \u00a0 \u00a0 \u00a0 value").via("merges across spaces")
@example("a \u00a0 \u00a0 \u00a0b")
def test_counts_with_other_white_space(text):
    test_counts_are_the_librarys.hypothesis.inner_test(text)


def test_counts_of_long_runs():
    merges, library = RaggedMerges(BYTE, public_tokenizers.PATTERN), Tokenizer.from_file(BYTE)
    rnd = random.Random(2)
    runs = ["a" * 5001, "ab" * 3000 + "a", "".join(rnd.choice("etaoinshr") for _ in range(200_000)), "é" * 3000, "".join(rnd.choice(["the", "ing", "un", "q"]) for _ in range(4000))]
    assert merges.count(runs) == [len(library.encode(t, add_special_tokens=False).ids) for t in runs]


def test_token_counts(documents):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100, None), (101, "word " * 30_000), (101, "word " * 30_000)]
    library = Tokenizer.from_file(BYTE)
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(documents(*rows).withColumn("n_tokens", F.lit("x")), BYTE, public_tokenizers.PATTERN).collect())
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert got == sorted((*w, w[2] > 512) for w in want)


def test_packing_round_trip(documents):
    rnd = random.Random(7)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100, None), (101, "some words " * 9_000)] + [(200 + k, " ".join(rnd.choice(("alpha", "beta", "Gamma,", "delta-9")) for _ in range(rnd.randrange(1, 900)))) for k in range(300)]
    library = Tokenizer.from_file(WORD)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    pieces = pack_documents(documents(*rows).repartition(3).withColumn("start", F.lit("clash")).withColumn("sequence_id", F.lit(1)), WORD).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert p.length > 0 and p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for own, total in [(sorted(v), len(ids[k])) for k, v in by_doc.items()] + [(sorted(v), sum(n for _, n in v)) for v in by_sequence.values()]:
        at = 0
        for start, n in own:
            assert start == at
            at += n
        assert at == total
    assert set(by_doc) == set(ids)
    fills = [sum(n for _, n in v) for v in by_sequence.values()]
    assert max(fills) <= 4096 and sum(f < 4096 for f in fills) <= 3  # one short sequence a task
    assert pack_documents(documents().limit(0), WORD).count() == 0


@settings(max_examples=100, deadline=None)
@given(s.lists(s.integers(1, 12), max_size=60))
def test_levels_minimise_the_sum_of_squares(sizes):
    own, counts = Levels(12), [0] * 13
    for k, size in enumerate(sizes):
        best = None
        for h in range(12 - size, -1, -1):
            if h and not counts[h]:
                continue
            c = list(counts)
            c[h] -= 1 if h else 0
            c[h + size] += 1 if h + size < 12 else 0
            value = sum(x * x for x in c[1:12])
            if best is None or value < best[0]:
                best = (value, h, c)
        assert own.level_for(size) == best[1]
        own.place((k, 0, b"", 0), size)
        counts = best[2]
        assert own.count[1:12].tolist() == counts[1:12]


def test_sharding(documents, tmp_path):
    rnd = random.Random(4)
    rows = [(k, "x" * rnd.randrange(0, 400) + str(k)) for k in range(3000)] + [(5000 + k, "the same text " * 20) for k in range(1500)] + [(9000, None), (9001, ""), (9002, "y" * 20_000), (None, "n"), (None, "n"), (1, "again")]
    got = assign_shards(documents(*rows).withColumn("key", F.lit("clash")), 40).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 40
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    due = sum(sizes.values()) / 40
    assert all(abs(v - due) <= 20_016 for v in sizes.values()) and sum(abs(v - due) <= 0.03 * due for v in sizes.values()) >= 37
    assert assign_shards(documents().limit(0)).count() == 0
    few = documents(*[(k, f"t{k}") for k in range(50)])
    write_shards(few, assign_shards(few, 4), str(tmp_path / "out"))
    back = few.sparkSession.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(50)) and back.select("shard").distinct().count() == 4


ITEM = "A train leaves at 9 and travels 120 km before Anna meets Bob near the old mill where they count 14 wheels in total"


@pytest.mark.parametrize("sent", [True, False])
def test_leaks(spark, documents, sent, monkeypatch):
    if not sent:
        monkeypatch.setattr(decontaminate, "MOST_SENT_WINDOWS", 0)
    items = spark.createDataFrame([(1, ITEM), (2, "two words"), (3, None), (4, "the quick fox jumps over it")], "item_id long, text string")
    changed = ITEM.replace("9", "7").replace("120", "95").replace("Anna", "Carla").replace("Bob", "Dave").replace("14", "22")
    torn = "Where we met, Anna saw a train leave at 9 and count wheels in total while Bob was near the old mill"
    rows = [(10, f"Before. {ITEM.lower()} after"), (11, f"Before. {changed} after"), (12, torn), (13, None), (14, ""), (15, "clean words only " * 50), (16, " ".join(w + "%%%" for w in ITEM.split())), (17, "so the QUICK fox, jumps over it!"), (10, f"Before. {ITEM.lower()} after"), (18, "far " * 40_000 + ITEM)]
    found = {(r.doc_id, r.item_id): r.reparameterised for r in find_leaks(documents(*rows).withColumn("item_id", F.lit(5)), items).collect()}
    assert set(found) == {(10, 1), (11, 1), (16, 1), (17, 4), (18, 1)}
    assert found[11, 1] and not found[18, 1]
    kept = {r.doc_id for r in drop_leaks(documents(*rows), items).collect()}
    assert {12, 13, 14, 15} <= kept and not kept & {10, 11, 16, 17, 18}
    assert find_leaks(documents().limit(0), items).count() == 0 and find_leaks(documents(*rows), items.limit(0)).count() == 0


def test_slots_must_be_consistent(spark, documents):
    item = "We saw Anna give Bob 5 of the red marbles and then Anna took 5 back from Bob again"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    good = item.replace("Anna", "Cleo").replace("Bob", "Dirk").replace("5", "8")
    bad = "We saw Cleo give Dirk 8 of the red marbles and then Eve took 3 back from Zoe again"
    got = {r.doc_id for r in find_leaks(documents((1, good), (2, bad)), items).collect()}
    assert got == {1}


def plain_template(text):
    """Words of a text as (raw, bare in lower case, slot or None)."""
    words, before, ends = [], None, True
    for raw in re.split(r"[\x20\x09-\x0D]+", text or ""):
        bare = re.sub(r"^[\W_]+|[\W_]+$", "", raw)
        if not bare:
            continue
        number = re.fullmatch(r"[+-]?\d[\d.,:/]*(?:st|nd|rd|th|%)?", bare)
        slot = "number" if number else "unit" if before == "number" and bare.lower() in decontaminate.UNITS else "name" if bare[0].isupper() and not bare[1:].isupper() and not ends else None
        words.append((bare, bare.lower(), slot))
        ends, before = bool(re.search(r"[.!?:]", raw[raw.rindex(bare) + len(bare) :])), "number" if number else None
    return words


def plain_leaks(docs, items):
    """Every document against every item, at every alignment."""
    out = {}
    for item_id, item in items:
        base = plain_template(item)
        length = min(8, len(base))
        readings = [base]
        for slot in ("name", "unit"):
            first = base[0] if base else ("", "", "x")
            fits = slot == "name" and first[0][:1].isupper() and not first[0][1:].isupper() or slot == "unit" and first[1] in decontaminate.UNITS
            if base and first[2] is None and fits:
                readings.append([(*first[:2], slot), *base[1:]])
        for doc_id, text in docs:
            doc = plain_template(text)
            covered, others = set(), []
            for shift in range(-len(base), len(doc)):
                own, pairs = set(), set()
                for at in range(len(base) - length + 1) if base else ():
                    there = doc[shift + at : shift + at + length] if shift + at >= 0 else []
                    if len(there) < length:
                        continue
                    for n, reading in enumerate(readings):
                        here = reading[at : at + length]
                        literal = sum(w[2] is None for w in here)
                        if 2 * literal >= length and (n == 0 or at == 0) and all(a[2] == b[2] and (a[2] or a[1] == b[1]) for a, b in zip(here, there)):
                            own |= set(range(at, at + length))
                            pairs |= {(a[1], b[1]) for a, b in zip(here, there) if a[2]}
                        if n == 0 and all(a[1] == b[1] for a, b in zip(here, there)):
                            own |= set(range(at, at + length))
                named = [b for _, b in pairs if not re.search(r"\d", b)]
                if own and len({a for a, _ in pairs}) == len(pairs) and len(set(named)) == len(named):
                    covered |= own
                    others.append(any(a != b for a, b in pairs))
            if base and len(covered) >= 0.4 * len(base) and covered:
                out[doc_id, item_id] = (len(covered), len(base), min(others))
    return out


def test_leaks_against_brute_force(spark, documents):
    rnd = random.Random(11)
    word = lambda: rnd.choice(["near", "the", "mill", "Anna", "Bob", "Carla", "9", "120", "km", "days", "he", "sees", "runs", "Paris.", "then", "so", "--", "12th", "we", "walk"])
    texts = [" ".join(word() for _ in range(rnd.choice((2, 4, 7, 12, 25)))) for _ in range(12)]
    items = [(k, t) for k, t in enumerate(texts)] + [(50, texts[3]), (51, None), (52, ""), (None, texts[4])]
    docs = []
    for k in range(60):
        own = texts[k % 12].split()
        for _ in range(rnd.choice((0, 0, 1, 3))):
            own[rnd.randrange(len(own))] = word()
        docs.append((k, " ".join([*(word() for _ in range(rnd.randrange(6))), *own[rnd.choice((0, 0, len(own) // 2)) :], *(word() for _ in range(rnd.randrange(6)))])))
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.covered, r.item_words, r.reparameterised) for r in find_leaks(documents(*docs), frame).collect()}
    want = plain_leaks(docs, items)
    assert len(want) > 40
    assert got == want


@pytest.mark.parametrize("m", [1, 50, 51, 500])
def test_leaks_of_a_passage_that_items_share(spark, documents, m):
    shared = " ".join(f"word{k}" for k in range(24))
    items = spark.createDataFrame([(k, f"{shared} " + " ".join(f"own{k}x{j}" for j in range(12))) for k in range(m)], "item_id long, text string")
    found = find_leaks(documents((1, f"before {shared} after"), (2, " ".join(shared.split()[:12]))), items)
    assert sorted((r.doc_id, r.item_id, r.covered) for r in found.collect()) == [(1, k, 24) for k in range(m)]


def test_leaks_by_row(spark, documents):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    half = ITEM.split()
    rows = [(None, f"x {ITEM}"), (None, "harmless"), (7, " ".join(half[:9])), (7, " ".join(half[9:18])), (8, f"y {ITEM}"), (8, "harmless too")]
    found = find_leaks(documents(*rows).withColumn("hash", F.lit(1)), items).collect()
    assert sorted((repr(r.doc_id), r.covered) for r in found if r.covered > 20) == [("8", 24), ("None", 24)] and all(r.covered <= 9 for r in found if r.doc_id == 7)
    assert {"harmless", "harmless too"} <= {r.text for r in drop_leaks(documents(*rows), items).collect()}


def test_leaks_of_items_made_of_slots(spark, documents):
    sums, titles, short = "Compute 12 + 345 - 67 = ? A 290 B 291 C 292 D 293", "The Great Gatsby Meets Moby Dick In Paris And Rome", "Describe the role of old mills"
    items = spark.createDataFrame([(1, sums), (2, titles), (3, short)], "item_id long, text string")
    rows = [(10, f"before. {sums} after"), (11, f"Heading {sums}"), (12, f"see {titles} there"), (13, f"A Heading\n{short} and more"), (14, sums.replace("345", "346").replace("291", "299")), (15, "Compute 12 more things")]
    assert {(r.doc_id, r.item_id) for r in find_leaks(documents(*rows), items).collect()} == {(10, 1), (11, 1), (12, 2), (13, 3)}


def test_chunks_that_come_once_are_not_remembered():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    chunks = ChunkIds(path)
    once, again = ["Zquorvel, blümchenära (dreiß)", "İstanbul ﬁn ét <|x|> don't"], "tiloremu tiloremu, Tiloremu! ÉTÉRELO"
    for texts in ([once[0], again, None, ""], [once[1], again], [again]):
        for text, ids in zip(texts, chunks.ids(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
    assert all(c.encode() in chunks for c in again.split())
    assert not any(c.encode() in chunks for text in once for c in text.split())
