"""Blocks of embedded projects: against a walk over all braces before each name, and in linear time."""

import random
import re
import time

from lodestack.functions import fixed
from lodestack.operators import extract as ex


def plain_blocks(text):
    stack, ends, quote = [], {}, ""
    for m in re.finditer(r"""\\.|["'{}]""", text, re.S):
        c = m.group()
        if c[0] == "\\":
            continue
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "{":
            stack.append(m.start())
        elif stack:
            ends[stack.pop()] = m.end()
    starts = {}
    for marker in (*map(re.escape, fixed.EMBEDDED_MARKERS), *fixed.EMBEDDED_PATTERNS):
        for m in re.finditer(marker, text):
            brace = m.end() - 1 if text[m.end() - 1] == "{" else text.find("{", m.start())
            if brace in ends:
                starts.setdefault(brace)
    for name in fixed.EMBEDDED_NAMES:
        for m in re.finditer(name, text):
            for at in sorted(ends, reverse=True):
                if m.start() - ex.NEAR <= at < m.start() < ends[at] and ends[at] - at > ex.LEAST_BLOCK:
                    starts.setdefault(at)
    return [(at, ends[at]) for at in starts]


def test_blocks_against_a_walk_over_all_braces(monkeypatch):
    rnd = random.Random(3)
    monkeypatch.setattr(ex, "NEAR", 60)
    monkeypatch.setattr(ex, "LEAST_BLOCK", 12)
    parts = ["{", "{", "}", "}", "rows:", "'rows':", '"backpack":', "x", '"', "'", "\\'", "window.__APP__=", "app:{", "return {", "const q = {", "project = f(", " "]
    for _ in range(300):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 60)))
        assert ex.project_blocks(text) == plain_blocks(text), text


def test_blocks_of_a_large_bundle():
    flat = "{" + ",".join('a:{rows:[%d],b:"%s"}' % (k, "x" * 230) for k in range(20_000)) + "}"
    deep = "{rows:" * 20_000 + "}" * 20_000
    for text, n in ((flat, 20_000), (deep, 10_000)):
        begun = time.time()
        assert len(ex.project_blocks(text)) >= n
        assert time.time() - begun < 30


def test_embedded_project_is_found_whole(spark):
    project = '{"rows": [{"id": 1, "objects": [{"rows": []}]}], "backpack": [], "points": [], "title": "a }{ b", "choices": []}'
    files = spark.createDataFrame([("a", f"x={{}};f(function(){{return 1}}, {project})"), ("b", "no braces"), ("c", None)], "path string, text string")
    assert [tuple(r) for r in ex.extract_embedded(files).collect()] == [("a", project)]
