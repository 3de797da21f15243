import pytest
from pyspark.sql import functions as F

from lodestack.functions import urls as u


def one(spark, expr, *values):
    names = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(expr(*[F.col(n) for n in names]).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("http://[2001:db8::1]:8080/a", "http://[2001:db8::1]:8080/a"),
        ("HTTPS://Example.com:443/a/../b/./c/?q=1#f", "https://example.com/b/c/?q=1"),
        ("http://h:8080//x//y", "http://h:8080//x/y"),
        ("ftp://x/y", None),
        ("http:///x", None),
        ("https://a.test./", "https://a.test/"),
        (None, None),
    ],
)
def test_canonical_url(spark, raw, expected):
    assert one(spark, u.canonical_url, raw) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("https://A.test:443//x//y?utm_source=f&ref=1&page=2&e=#t", "https://a.test:443/x/y?page=2&e="), ("https://a.test/x?a=b%20c", "https://a.test/x?a=b+c"), ("https://a.test", "https://a.test/")],
)
def test_route_url(spark, raw, expected):
    assert one(spark, u.route_url, raw) == expected


def test_cache_identity(spark):
    same = {one(spark, u.cache_identity, f"https://x.test/app.js?{q}") for q in ("v=one", "v=two", "dpl=deploy-id")}
    assert same == {"https://x.test/app.js"}
    assert one(spark, u.cache_identity, "https://x.test/image?w=320") != one(spark, u.cache_identity, "https://x.test/image?w=1280")
    assert one(spark, lambda c: u.cache_identity(c, False), "https://x.test?v=1") == "https://x.test"


def test_strip_proxy_archive_sheet(spark):
    assert one(spark, u.strip_document, "https://example.test/a/b/index.html?x=1") == "https://example.test/a/b/"
    proxied = "https://shop.test/a/_next/image?w=64&url=https%3A%2F%2Ffiles.example.org%2Flake%20side.png"
    assert one(spark, u.unwrap_proxy, proxied) == "https://files.example.org/lake side.png"
    assert one(spark, u.unwrap_proxy, "https://shop.test/_next/image?url=%2Flocal.png") is None
    assert one(spark, u.archive_name_url, "Old tale (2).http~~~tales.example.org~v2.zip") == "http://tales.example.org/v2/"
    assert one(spark, u.sheet_export, "https://docs.google.com/spreadsheets/d/1AbC/view?gid=9").endswith("/1AbC/export?format=csv&gid=9")


@pytest.mark.parametrize(("name", "expected"), [("CON", "_CON"), ("nul.json", "_nul.json"), ("CONSOLE", "CONSOLE"), ("my_con_file", "my_con_file"), ("com10", "com10"), ("a%3Ab", "a_b")])
def test_safe_component(spark, name, expected):
    assert one(spark, u.safe_component, name) == expected


def test_safe_members(spark):
    assert one(spark, u.is_safe_member, "../escape.txt") is False
    assert one(spark, u.is_safe_member, "a/b.txt") is True


@pytest.mark.parametrize(
    ("base", "ref", "expected"),
    [
        ("https://h.test/a/b.html", "c.png", "https://h.test/a/c.png"),
        ("https://h.test/a/b.html", "../c.png", "https://h.test/c.png"),
        ("https://h.test/a/b/", "./c/", "https://h.test/a/b/c/"),
        ("https://h.test/a", "/x?y=1", "https://h.test/x?y=1"),
        ("https://h.test/a", "//o.test/x", "https://o.test/x"),
        ("https://h.test/a", "https:/o.test/x", "https://o.test/x"),
        ("https://h.test/a/b?q=1", "?z=2", "https://h.test/a/b?z=2"),
        ("https://h.test", "x.js", "https://h.test/x.js"),
    ],
)
def test_resolve(spark, base, ref, expected):
    assert one(spark, u.resolve, base, ref) == expected


def test_local_paths(spark):
    start = "https://site.example.org/tales/one/"
    cases = {
        ("https://site.example.org/tales/one/js/a.js", None): "js/a.js", ("https://site.example.org/top.css", None): "top.css", ("https://site.example.org/tales/one/pic", "image/jpeg"): "pic.jpg",
        ("https://cdn.example.org/x/font", "font/woff2"): "fonts/font.woff2", ("https://site.example.org/tales/one/", "text/html"): "index.html", ("https://cdn.example.org/project.json", None): "project.json",
        ("https://cdn.example.org/s/" + "l" * 200 + ".png", None): None, ("https://site.example.org/tales/one/a%20b/../c.png?v=2", None): "a b/c.png",
    }
    df = spark.createDataFrame([(k, url, m) for k, (url, m) in enumerate(cases)], "k int, url string, mime string")
    got = {r.k: r.path for r in u.plan_local_paths(df, start).collect()}
    for k, want in enumerate(cases.values()):
        assert got[k] == want or want is None and 100 < len(got[k].removeprefix("images/")) <= 140 and got[k].endswith(".png"), (k, got[k])


def test_record_file_url(spark):
    make = lambda c, r, n: u.record_file_url(F.lit("https://c.test/"), c, r, n)
    assert one(spark, make, "col_1", " r-2 ", "a b/ü~*.png") == "https://c.test/api/files/col_1/r-2/a%20b%2F%C3%BC~%2A.png"
    assert one(spark, make, "col/1", "r", "a") is None and one(spark, make, "c", "r" * 81, "a") is None and one(spark, make, "c", "r", " ") is None


def test_safe_path(spark):
    assert one(spark, u.safe_path, "a\\..\\b%2Fc/./d?.txt") == "a/b_c/d_.txt"
