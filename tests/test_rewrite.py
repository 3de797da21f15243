"""Rewriting against a regular expression over all names, the longest first."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestack.operators.rewrite import rewrite_refs

MAPPING = "old string, new string"


def by_regex(text, mapping):
    every = dict(mapping)
    for old, new in mapping.items():
        if old.startswith(("http://", "https://")):
            every.setdefault(old.replace("://", ":/", 1), new)
    for old, new in list(every.items()):
        every.setdefault(old.replace("/", "\\/"), new.replace("/", "\\/"))
    every = {k: v for k, v in every.items() if k}
    names = sorted(every, key=len, reverse=True)
    return re.sub("|".join(map(re.escape, names)), lambda m: every[m[0]], text or "") if names else text or ""


def test_rewrite_once_and_wherever_a_name_stands(spark, rows):
    files = spark.createDataFrame([("f", '{"a":"url1","b":"url2"} a/b.png xa/b.png'), ("e", ""), ("n", None)], "path string, text string")
    m = spark.createDataFrame([("url1", "url2"), ("url2", "final"), ("a/b.png", "L"), ("", "nothing"), (None, "x")], MAPPING)
    assert rows(rewrite_refs(files, m), "path", "text") == [("e", ""), ("f", '{"a":"url2","b":"final"} L xL'), ("n", "")]


def test_rewrite_in_prose_with_one_slash_blanks_queries_and_escapes(spark):
    text = 'See https://c.org/a.png. <img src=https:/c.org/a.png> "my pic.png" ../img/b.png?v=1 img/b.png "img\\/b.png" https:\\/\\/c.org\\/a.png'
    m = {"https://c.org/a.png": "images/a.png", "my pic.png": "images/p.png", "img/b.png": "images/b.png"}
    files = spark.createDataFrame([("f", text, 1)], "path string, text string, package int")
    got = rewrite_refs(files, spark.createDataFrame(list(m.items()), MAPPING)).first()
    assert got.text == 'See images/a.png. <img src=images/a.png> "images/p.png" ../images/b.png?v=1 images/b.png "images\\/b.png" images\\/a.png'
    assert got.text == by_regex(text, m) and got.asDict().keys() == {"path", "text", "package"}


@pytest.mark.parametrize("limits", [(1 << 20, 1 << 20), (12, 40)])
def test_rewrite_against_regex(spark, rows, limits):
    r = random.Random(5)
    word = lambda: "".join(r.choices("ab/", k=r.randint(1, 5)))
    maps = {p: {word(): word() for _ in range(r.randint(0, 12))} for p in ("p", "q", None, "none")} | {"none": {}}
    files = [(k, p, "".join(r.choices("ab/c\\", k=r.randint(0, 60)))) for k in range(60) for p in [r.choice(list(maps))]]
    files.append(files[0])
    df = spark.createDataFrame(files, "path int, package string, text string").repartition(3)
    m = spark.createDataFrame([(p, o, n) for p, own in maps.items() for o, n in own.items()], "package string, old string, new string")
    got = rewrite_refs(df, m, package="package", key_chars=limits[0], text_chars=limits[1])
    assert rows(got, "path", "text") == sorted([(k, by_regex(t, maps[p])) for k, p, t in files], key=repr)


def test_rewrite_of_a_package_of_a_million_names(spark):
    names = spark.range(1_000_000, numPartitions=8).select(F.concat(F.lit("https://cdn.test/pictures/"), F.col("id"), F.lit(".png")).alias("old"), F.concat(F.lit("images/"), F.col("id"), F.lit(".png")).alias("new"))
    files = spark.range(20).select(F.col("id").alias("path"), F.concat(F.lit("x https://cdn.test/pictures/"), F.col("id") * 49_999, F.lit(".png and https:/cdn.test/pictures/7.png; https://cdn.test/pictures/1000000.png")).alias("text"))
    got = {r.path: r.text for r in rewrite_refs(files, names, key_chars=1 << 23).collect()}
    assert got == {k: f"x images/{k * 49_999}.png and images/7.png; https://cdn.test/pictures/1000000.png" for k in range(20)}
