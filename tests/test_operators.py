from pyspark.sql import functions as F

from lodestack.functions import scalars as sc
from lodestack.operators import aggregates as agg
from lodestack.operators import extract as ex
from lodestack.operators import filters as fl
from lodestack.operators import joins as jo
from lodestack.operators import tags as tg
from lodestack.operators import textscan as ts
from lodestack.operators import windows as wi
from lodestack.operators.iterate import crawl_routes, deep_scan, flatten_variant, reachable_styles, resume_crawl, walk_projects
from lodestack.operators.registry import AnchorLinks, AssetNames, Registry


def pages(spark, *rows):
    return spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def test_links_and_crawl(spark, rows):
    home = "https://tales.example.org/forest"
    p = pages(spark, (home, '<a href="/forest/river?utm_medium=x"> <a id=q href="/account/"> <a href="https://other.example.net/forest/a"> <a href="#map">'), (f"{home}/river", ""), (f"{home}/", '<a href="https://[::zz]/up"><a href="river">'), (None, None))
    links = ex.extract_links(p)
    assert rows(links.where("page_id = 2"), "url") == [(f"{home}/river",)]
    kept = fl.filter_scope(links.where("page_id = 0").withColumn("seed", F.lit(home)))
    assert rows(kept, "url") == [(f"{home}/river",)]
    edges = kept.select(F.col("page_url").alias("url"), F.col("url").alias("target"), "ord")
    seeds = spark.createDataFrame([(home,)], "url string")
    found, state = crawl_routes(edges, seeds, max_depth=5, max_pages=10)
    assert rows(found, "url", "depth") == [(home, 0), (f"{home}/river", 1)] and state == {"limit": False, "remaining": 0}
    found, state = crawl_routes(edges, seeds, max_depth=5, max_pages=1)
    assert found.count() == 1 and state == {"limit": True, "remaining": 1}
    found, state = crawl_routes(edges, seeds, max_depth=0)
    assert found.count() == 1 and not state["limit"]


def test_crawl_order_and_resume(spark, rows):
    edges = spark.createDataFrame([("a", "c", 0), ("a", "b", 1), ("b", "d", 0), ("c", "e", 1), ("c", "f", 0)], "url string, target string, ord int")
    seeds = spark.createDataFrame([("a",)], "url string")
    found, state = crawl_routes(edges, seeds, max_pages=5)
    assert [r.url for r in found.orderBy("place").collect()] == ["a", "c", "b", "f", "e"] and state == {"limit": True, "remaining": 1}
    have = spark.createDataFrame([("a",), ("c",)], "url string")
    found, state = resume_crawl(edges, have, max_pages=4)
    assert rows(found, "url", "depth") == [("a", -1), ("b", 0), ("c", -1), ("e", 0)] and state["limit"] and state["remaining"] == 1
    found, state = resume_crawl(edges, have)
    assert rows(found, "url", "depth") == [("a", -1), ("b", 0), ("c", -1), ("d", 1), ("e", 0), ("f", 0)] and not state["limit"]


def test_crawl_ends_on_cycles(spark, rows):
    edges = spark.createDataFrame([("a", "b", 0), ("b", "a", 0)], "url string, target string, ord int")
    found, _ = crawl_routes(edges, spark.createDataFrame([("a",)], "url string"))
    assert rows(found, "url", "depth") == [("a", 0), ("b", 1)]


def test_text_assets(spark):
    files = spark.createDataFrame(
        [
            ("lib/main.js", "https://play.example.org/lib/main.js", "https://play.example.org/", """p="./lib/tree.avif"; import("./part-77.mjs"); q="url('../sky/dusk.png')"; r=["wind.ogg"]"""),
            ("v/main.js", "https://play.example.org/v/main.js", "https://play.example.org/v/", 'let cover = "cover.jpg", mime = "image/png", t = `${x}.png`, o = {"key.png": 1};'),
            ("v/js/base.js", "https://play.example.org/v/js/base.js", "https://play.example.org/v/", "root = new URL('../', document.currentScript.src); load('skin/dark-mode.css'); load('data.json')"),
            ("s.css", "https://play.example.org/s.css", "https://play.example.org/", """a{background:image-set("one.webp" 1x, url("two.webp") 2x)}"""),
            ("none.js", "https://play.example.org/none.js", "https://play.example.org/", None),
        ],
        "path string, url string, base_url string, text string",
    )
    found = {(r.owner, r.url) for r in ts.scan_text_assets(files).collect()}
    assert {("lib/main.js", f"https://play.example.org/{x}") for x in ("lib/tree.avif", "lib/part-77.mjs", "wind.ogg", "sky/dusk.png")} <= found
    assert {u for o, u in found if o == "v/main.js"} == {"https://play.example.org/v/cover.jpg"}
    assert {u for o, u in found if o == "v/js/base.js"} >= {"https://play.example.org/v/skin/dark-mode.css", "https://play.example.org/v/data.json"}
    assert {u for o, u in found if o == "s.css"} >= {"https://play.example.org/one.webp", "https://play.example.org/two.webp"}


def test_inferred_names(spark, rows):
    files = spark.createDataFrame(
        [("a.js", "let imgFolder = 'pics/'; const imgNames = ['deck/K.png','deck/Q.png', 'https://x/y.png'];"), ("b.js", 'roll = Math.floor(Math.random()*3)+1; "t/"+roll+".gif"'), ("c.js", "{folk:[{code:'elf'},{code:'orc'}]} \"${p.code}.svg\""), ("d.js", '"${p.code}.svg"')],
        "path string, text string",
    )
    assert rows(ts.infer_prefixed_assets(files), "raw") == [("pics/deck/K.png",), ("pics/deck/Q.png",)]
    assert rows(ts.expand_numeric(files), "raw") == [("t/1.gif",), ("t/2.gif",), ("t/3.gif",)]
    assert [tuple(r) for r in ts.expand_properties(files).orderBy("ord").select("path", "raw").collect()] == [("c.js", "elf.svg"), ("c.js", "orc.svg")]


def test_srcset(spark):
    df = spark.createDataFrame([("data:image/gif;base64,R0lGOD,lh 1x, moon.png 2x",)], "srcset string")
    assert [r.raw for r in ex.split_srcset(df).collect()] == ["moon.png"]


def test_manifest_and_verdict(spark, rows):
    m = spark.createDataFrame([("p", "a", "h1", 1), ("p", "b", "h2", 1), ("p", "c", "h3", 1)], "package string, path string, sha256 string, size long")
    f = spark.createDataFrame([("p", "a", "H1", 9), ("p", "b", "hX", 1), ("p", "d", "h4", 1)], "package string, path string, sha256 string, size long")
    d = jo.diff_manifest(m, f)
    assert rows(d, "path", "status") == [("a", "intact"), ("b", "corrupted"), ("c", "missing"), ("d", "extra")]
    none = spark.createDataFrame([], "package string, ref string")
    assert rows(agg.verify_packages(f, d, none)) == [("p", 2, 2, False)]
    texts = {"good": '{"rows":[],"title":"x"}', "plain": '{"a":1}', "list": "[1]", "broken": "{x"}
    files = spark.createDataFrame([(k, "project.json", 5, t) for k, t in texts.items()] + [("good", "empty.png", 0, None), ("good", "failed_urls.txt", 0, None)], "package string, path string, size long, text string")
    same = spark.createDataFrame([], "package string, path string, status string")
    every = spark.createDataFrame([("good",), ("void",)], "package string")
    assert rows(agg.verify_packages(files, same, none, every)) == [("broken", 1, 0, False), ("good", 1, 0, False), ("list", 1, 0, False), ("plain", 0, 1, True), ("void", 1, 0, False)]


def test_integrity(spark, rows):
    refs = spark.createDataFrame([("p", "css/site.css", "../image/a%20b.webp"), ("p", "css/site.css", "gone.woff")], "package string, owner string, ref string")
    files = spark.createDataFrame([("p", "image/a b.webp")], "package string, path string")
    assert rows(jo.check_integrity(refs, files), "ref", "ok") == [("../image/a%20b.webp", True), ("gone.woff", False)]


def test_collisions_take_the_next_free_name(spark):
    import random

    plan = [(0, "f"), (1, "f_1"), (2, "f"), (3, "f"), (4, "a/.rc"), (5, "a/.rc"), (6, "x.tar.gz"), (7, "x.tar.gz"), (8, "F")]
    rnd = random.Random(1)
    plan += [(k, rnd.choice(["p.txt", "p_1.txt", "p_1_1.txt", "p_2.txt", "q.txt", "p"])) for k in range(9, 200)]
    used, want = set(), {}
    for k, path in plan:
        stem, dot, ext = path.rpartition(".") if "." in path.rsplit("/")[-1].lstrip(".") else (path, "", "")
        local, n = path, 1
        while local in used:
            local, n = f"{stem}_{n}{dot}{ext}", n + 1
        used.add(local)
        want[k] = local
    got = wi.assign_paths(spark.createDataFrame(plan, "ord int, path string").repartition(5))
    assert {r.ord: r.local for r in got.collect()} == want and want[2] == "f_2" and want[3] == "f_3"
    assert wi.collisions(got).count() == sum(want[k] != p for k, p in plan)


def test_running_sums_of_large_and_hot_tables(spark):
    n = 3_000_000
    files = spark.range(n).select(F.concat(F.lit("p"), "id").alias("path"), (F.col("id") * 7919 % n).alias("mtime"), (F.col("id") % 5 + 1).alias("size"))
    gone = wi.evict_lru(files, 5_000_000)
    total, left = files.agg(F.sum("size")).first()[0], files.join(gone, "path", "left_anti")
    kept = left.agg(F.sum("size"), F.min("mtime")).first()
    assert kept[0] <= 5_000_000 < kept[0] + 5 and gone.agg(F.max("mtime")).first()[0] < kept[1] and total == 9_000_000
    hot = spark.range(50_000).select((F.col("id") % 100 >= 40).cast("int").alias("g"), "id")
    got = wi.running(hot, F.lit(1), ["id"], ["g"]).groupBy("g").agg(F.count_distinct("upto").alias("n"), F.max("upto").alias("m"), F.count("*").alias("c")).collect()
    assert all(r.n == r.m == r.c for r in got) and len(got) == 2


def test_lru(spark, rows):
    files = spark.createDataFrame([("a", 1, 40), ("b", 2, 30), ("c", 3, 50)], "path string, mtime int, size long")
    assert rows(wi.evict_lru(files, 90), "path") == [("a",)]


def test_backoff_and_speed(spark):
    import random

    rnd = random.Random(4)
    tries = [("D", 1, False), ("d", 2, False), ("d", 3, False), ("d", 4, True), ("d", 5, False)] + [("hot", k, rnd.random() < 0.6) for k in range(700)] + [("down", k, False) for k in range(20)] + [("up", 1, True)]
    df = spark.createDataFrame(tries, "domain string, ts int, ok boolean")
    want = {}
    for name, _, ok in tries:
        b, f = want.get(name.lower(), (0.0, 0))
        want[name.lower()] = (b / 2, max(0, f - 1)) if ok else (min(300.0, b * 2 if b > 0 else 2.0), f + 1)
    assert want["d"] == (8.0, 3)
    folded = wi.folded
    wi.folded = lambda *a, **k: folded(*a, **k, chunk=16)
    try:
        got = {r.domain: (r.backoff, r.fails) for r in wi.domain_backoff(df).collect()}
        samples = spark.createDataFrame([("a", 0, 900.0), ("a", 1, 400.0)] + [("hot", k, rnd.choice([0.0, -1.0, 5.0, float("nan")])) for k in range(300)], "job string, ts int, bytes double")
        speeds = {r.job: r.smoothed for r in wi.ewma_by(samples, "job", "bytes", ["ts"], 0.28).collect()}
        values = samples.groupBy("job").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "bytes"))), lambda x: x["bytes"]).alias("v"))
        whole = {r.job: r.x for r in values.select("job", sc.ewma(F.col("v"), 0.28).alias("x")).collect()}
    finally:
        wi.folded = folded
    assert set(got) == set(want) and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    assert abs(speeds["a"] - 760.0) < 1e-9 and all(abs(speeds[k] - whole[k]) < 1e-9 for k in whole)


def test_redaction(spark):
    cases = {'token = "24be64439e3e49cf"': "token = __REDACTED__", '{"api_key":"sk-1234567"}': '{"api_key":"__REDACTED__"}', "password=abc": "password=abc", "Authorization: Bearer abcdefgh12345": "Authorization: __REDACTED__ __REDACTED__"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.x for r in df.select("t", sc.redact(F.col("t")).alias("x")).collect()}
    assert got == cases


def test_internal_hosts(spark):
    cases = [("http://127.0.0.1:9/x.png", "http://example.com/story/", True), ("http://169.254.169.254/meta", "https://site.org/", True), ("http://127.0.0.1:8000/img/a.png", "http://127.0.0.1:8000/story/", False), ("https://cdn.test/x.png", "https://site.org/", False), ("http://[::1]/x", "https://site.org/", True), ("http://[fe80::1]/x", "https://site.org/", True), ("http://[fd12::1]/x", "https://site.org/", True), ("http://[::ffff:10.0.0.1]/", "https://site.org/", True), ("http://[2606:4700::1111]/x", "https://site.org/", False), ("http://[2001:db8::1]/", "https://site.org/", True), ("http://printer.local/", "https://site.org/", True)]
    df = spark.createDataFrame(cases, "u string, b string, want boolean")
    assert all(r.blocked == r.want for r in fl.screen_internal(df, "u", "b").collect())
    assert not any(r.blocked for r in fl.screen_internal(df, "u", "b", allow=True).collect())


def test_policies_and_modes(spark):
    p = spark.createDataFrame([("UNKNOWN", "bad", "0", "inf", None, "-4", "0")], "strategy string, max_pages string, max_depth string, max_seconds string, scroll_steps string, interactions string, rounds string")
    assert tuple(fl.normalize_policies(p).first()) == ("classic", 300, 0, 1800, 12, 0, 1)
    q = spark.createDataFrame([("ICC-Folder",), ("icc",), ("Pure Website",), ("bogus",), (None,), ("website",), ("cyoap_vue",)], "mode string")
    flags = {r.mode: r for r in fl.normalize_modes(q).collect()}
    assert flags["cyoap_vue"].website and flags["cyoap_vue"].engine == "cyoap_vue" and not flags["website_folder"].website_zip and flags["pure_website"].pure
    assert [r.mode for r in fl.normalize_modes(q).collect()] == ["website_folder", "website_zip", "pure_website", "", "", "website", "cyoap_vue"]


def test_archives(spark, rows):
    m = spark.createDataFrame([("z", "../escape.txt", False, 5, 5), ("y", "a", False, 2 << 20, 1024), ("x", "a", False, 1 << 20, 1)], "archive string, member string, is_dir boolean, file_size long, compress_size long")
    assert rows(agg.audit_archives(m), "archive", "ok") == [("x", True), ("y", False), ("z", False)]


def test_resume_and_targets(spark, rows):
    q = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (3, "c")], "seq int, url string")
    done = spark.createDataFrame([("a",), ("b",)], "url string")
    assert rows(jo.resume_queue(q, done).where("skip"), "seq") == [(0,)]
    c = spark.createDataFrame([("p", 0, "https://github.com/x"), ("p", 1, "https://v.test/story/")], "page string, rank int, url string")
    v = spark.createDataFrame([("https://v.test/story/", True, None)], "url string, ok boolean, reason string")
    assert jo.resolve_targets(c, v).first().target == "https://v.test/story/"


def test_fallbacks(spark):
    f = spark.createDataFrame([("https://h/game/", "https://h/assets/x.png", "images"), ("https://h/game/", "https://h/chunk.js", "js"), ("https://h/game/", "https://h/game/css/img/a.png", "css")], "page_url string, url string, kind string")
    assert {r.candidate for r in ex.fallback_candidates(f).collect()} == {"https://h/game/assets/x.png", "https://h/assets/chunk.js", "https://h/game/a.png"}


def test_styles_and_json(spark, rows):
    refs = spark.createDataFrame([("index.html", "a.css"), ("a.css", "b.css"), ("b.css", "a.css"), ("orphan.css", "c.css")], "owner string, path string")
    files = spark.createDataFrame([(x,) for x in ("index.html", "a.css", "b.css", "c.css", "orphan.css")], "path string")
    assert rows(reachable_styles(refs, files)) == [("a.css",), ("b.css",)]
    df = spark.createDataFrame([(1, '{"a":{"b":[1,{"c":"x"}]},"d":null}')], "id int, t string").withColumn("v", F.parse_json("t"))
    got = {r.path: r.x for r in flatten_variant(df, "id", "v").select("path", F.try_variant_get("value", "$", "string").alias("x")).collect()}
    assert got["$.a.b[0]"] == "1" and got["$.a.b[1].c"] == "x"


def test_project_stats(spark):
    df = spark.createDataFrame([("p", '{"app":{"rows":[{"objects":[{"image":"x.png"},{}]}],"backpack":[],"title":"Wrapped","image":"x.png"}}')], "project_id string, t string").withColumn("payload", F.parse_json("t"))
    r = agg.project_stats(df).first()
    assert (r.title, r.rows, r.objects, r.images, r.backpack) == ("Wrapped", 1, 2, 1, 0)
    assert df.select(sc.project_score(F.col("payload"))).first()[0] >= 4


def test_deep_scan(spark, rows):
    schema = "path string, url string, base_url string, text string"
    files = spark.createDataFrame([("a.js", "https://h/a.js", "https://h/", 'import("./b.js"); "gone.png"')], schema)
    answers = spark.createDataFrame([("b.js", "https://h/b.js", "https://h/", '"c.png"'), ("c.png", "https://h/c.png", "https://h/", "")], schema)
    assert rows(deep_scan(files, answers, ts.scan_text_assets), "url", "round") == [("https://h/a.js", 0), ("https://h/b.js", 1), ("https://h/c.png", 2)]


def test_project_scores(spark):
    cases = {'{"cards":1,"sections":1,"scenes":1,"tabs":1,"choices":1}': 5, '{"styling":1,"cssStyles":2}': 0, '{"portrait":null,"name":1}': 4, '{"app":{"rows":[],"backpack":[],"groups":[]}}': 9, '{"rows":{}}': 1, "[1]": 0, '{"app":[]}': 0, "{oops": 0}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.s for r in df.select("t", sc.project_score(F.try_parse_json("t")).alias("s")).collect()} == cases
    texts = {"x.Image: 1, 'TITLE' : 2": True, "let a = {image:1, other:2}": False, "image2: 1, my_image: 2, $image: 3, title: 1": False, '{"image": !0, "rows": []}': False, '{"image":"a","rows":[]}': True, "": False, '\\"image\\": 1, title: 2': False, "rows: backpack: cards: name:": True}
    df = spark.createDataFrame([(k,) for k in [*texts, None]], "t string")
    got = {r.t: r.s for r in df.select("t", sc.is_project_text(F.col("t")).alias("s")).collect()}
    assert got == texts | {None: False}


def test_image_references(spark):
    cases = {
        ("https:/cdn.example.org/pic", False): ["https://cdn.example.org/pic"], ("//cdn.example.org/pic", False): ["https://cdn.example.org/pic"], ("see https://a.example.org/x.png).", False): ["https://a.example.org/x.png"],
        ("see https://a.example.org/page", False): [], ('<img alt="q" src="//b.example.org/i"> text', False): ["https://b.example.org/i"], ("x.png", True): ["x.png"], ("x.png", False): [], ("<b>x.png", True): [],
        ('<source srcset="one.webp 1x, two.webp 2x">', True): ["one.webp"], ("p{background-image: url('bg.jpg')}", False): ["bg.jpg"], ("data:image/png;base64,xx", True): [], ("", True): [],
    }
    df = spark.createDataFrame([(k, t, b) for k, (t, b) in enumerate(cases)], "k int, t string, b boolean")
    got = {r.k: r.x for r in df.select("k", ex.image_refs_of(F.col("t"), F.col("b")).alias("x")).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_default_candidates_of_known_hosts(spark):
    urls = ["https://me.github.io/repo/", "https://me.neocities.org/a/", "https://x.itch.io/g", "https://s.cyoa.cafe/v/x.html", "https://h.test"]
    df = ex.default_candidates(spark.createDataFrame([(u,) for u in [*urls, None]], "url string"))
    got = {}
    for r in df.orderBy("url", "rank").collect():
        got.setdefault(r.url, []).append(r.candidate)
    assert got[urls[0]][:4] == [f"https://me.github.io/repo/project.{x}" for x in ("json", "txt", "zip")] + ["https://me.github.io/project.json"]
    assert {"https://me.github.io/repo/docs/project.json", "https://me.github.io/repo/gh-pages/project.zip"} <= set(got[urls[0]])
    assert {"https://me.neocities.org/cyoa/project.json", "https://me.neocities.org/game/project.txt"} <= set(got[urls[1]]) and "https://x.itch.io/public/project.json" in got[urls[2]]
    assert "https://s.cyoa.cafe/v/PROJECT.JSON" in got[urls[3]] and got[urls[4]][0] == "https://h.test/project.json" and all(len(v) == len(set(v)) for v in got.values())


def test_media_patches(spark, rows):
    walk = spark.createDataFrame([("p", "$.a", "bgmId", " abcdefghijk "), ("p", "$.b", "bgmId", "https://www.youtube.com/watch?v=abcdefghijk"), ("p", "$.c", "text", "<i onclick=\"playVideo('abcdefghijk')\">"), ("p", "$.d", "bgmId", "audio/k.mp3"), ("p", "$.e", "bgmId", "unknown"), ("p", "$.f", "other", "abcdefghijk")], "project_id string, path string, key string, value string")
    local = spark.createDataFrame([("https://youtu.be/abcdefghijk", "audio/k.mp3")], "url string, path string")
    assert rows(jo.patch_media(walk, local), "path", "field", "new", "use_audio_url") == [("$.a", "bgmId", "audio/k.mp3", True), ("$.b", "bgmId", "audio/k.mp3", True), ("$.c", "playVideo", "audio/k.mp3", False), ("$.d", "bgmId", "audio/k.mp3", True)]


def test_deep_json_and_first_answers(spark, rows):
    deep = '{"a":' * 7 + '{"image":"x.png"}' + "}" * 7
    df = spark.createDataFrame([(1, deep)], "project_id int, t string").withColumn("payload", F.parse_json("t"))
    assert rows(walk_projects(df), "class", "raw") == [("image", "x.png")] and flatten_variant(df, "project_id", "payload").count() == 1
    files = spark.createDataFrame([("old.css", "d1", 3), ("new.css", "d2", 4)], "path string, digest string, size long")
    assert rows(wi.drop_evicted(files.select(F.col("path").alias("url"), "digest"), spark.createDataFrame([("d1",)], "sha256 string"))) == [("new.css", "d2")]


def test_pages_in_place_of_files(spark, rows):
    df = spark.createDataFrame([("text/html", "x", False), ("image/png", " <!DOCTYPE html>", False), ("application/json", '{"a":1}', True), ("application/json", '{"a":1}', False), (None, "PNG", True), ("", '{"error":1}', False)], "mime string, content string, binary boolean")
    assert rows(fl.drop_error_documents(df, binary="binary"), "mime", "binary") == [("application/json", False), (None, True)]


def test_viewers_in_several_spellings_and_galleries(spark, rows):
    v = spark.createDataFrame([(1, "http://a.test/x/../y", 200, "text/html", "<div id='app'>"), (0, "http://a.test/y", 200, "text/html", "prose"), (2, "http://a.test/y/project.txt", 200, "text/plain", "no project"), (3, None, 200, "text/html", "window.APP")], "ord int, url string, status int, mime string, body string")
    assert rows(fl.validate_viewers(v), "url", "reason") == sorted([("http://a.test/x/../y", "already visited"), ("http://a.test/y", "no valid project/viewer signature"), ("http://a.test/y/project.txt", "no valid project/viewer signature"), (None, None)], key=repr)
    g = spark.createDataFrame([("https://arts.test/x",), ("https://i.pximg.net/gallery/1",), ("https://o.test/Gallery/2",), (None,)], "url string")
    assert rows(fl.route_gallery(g, {"arts.test": "arts"})) == sorted([("https://arts.test/x", "arts"), ("https://i.pximg.net/gallery/1", None), ("https://o.test/Gallery/2", "o.test"), (None, None)], key=repr)
    assert {r.extractor for r in fl.route_gallery(g, {}, mode="off").collect()} == {None}
    assert {r.extractor for r in fl.route_gallery(g, {}, mode="force").collect()} == {"arts.test", "i.pximg.net", "o.test", None}


def test_tags_in_one_pass(spark):
    html = """<!-- <a href=no> --><DIV ID='App' data-x = "a > b" hidden><img src=p.png alt="it's"><script type="x">if (a < b) "</div>"</script><style>p{}</style><p title=it's>"""
    tags = tg.tag_table(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")).select("name", tg.attr("id"), tg.attr("data-x"), tg.attr("hidden"), tg.attr("src"), tg.attr("alt"), "body")
    assert [tuple(r) for r in tags.collect()] == [("div", "App", "a > b", "", None, None, None), ("img", None, None, None, "p.png", "it's", None), ("script", None, None, None, None, None, 'if (a < b) "</div>"'), ("style", None, None, None, None, None, "p{}"), ("p", None, None, None, None, None, None)]
    page = spark.createDataFrame([(1, "<script>document.createElement('script').src = base + 'js/app.AB12.js'</script><script src='js\\/x.js'></script><iframe src=v></iframe>")], "page_id int, html string")
    assert [(r.kind, r.body[:12]) for r in tg.extract_scripts(page).orderBy("ord", "kind").collect()] == [("bootstrap", "js/app.AB12."), ("inline", "document.cre"), ("src", "js/x.js"), ("iframe", "v")]


def test_records_and_their_files(spark, rows):
    c = spark.createDataFrame([([" "], None, "http://x"), (["p.png"], None, None), (None, None, "no")], "pages array<string>, iframe_url string, game_url string")
    assert [r["class"] for r in fl.classify_records(c).collect()] == ["linked_viewer", "static_pages", "unknown"]
    r = spark.createDataFrame([("r", ["a.png", "b.txt", "a.png"], ["c.webp"], ["a.png"])], "record string, pages array<string>, previews array<string>, covers array<string>")
    assert rows(ex.explode_record_files(r), "kind", "local") == [("page", "0001_a.png"), ("preview", "0002_c.webp")]


def test_registry(spark, rows):
    r = Registry()
    r.register_scanner("a", lambda df: df.select("raw"))
    r.register_scanner("broken", lambda df: df.select("no_such_column"))
    files = spark.createDataFrame([("x",), ("x",)], "raw string")
    assert rows(r.run_scanners(files)) == [("x",)] and "broken" in r.failed
    try:
        r.register_scanner("a", lambda df: df)
        raise AssertionError
    except ValueError:
        pass
    r.register_detector("none", lambda: F.lit(None).cast("string"))
    r.register_detector("second", lambda: F.col("raw"))
    assert r.run_detectors(files).first().detected.by == "second"
    spark.udtf.register("anchor_links", AnchorLinks)
    pages(spark, ("u", '<a href="/x">')).createOrReplaceTempView("p")
    assert spark.sql("SELECT raw FROM p, LATERAL anchor_links(html)").first().raw == "/x"
    spark.udtf.register("asset_names", AssetNames)
    spark.createDataFrame([("""a="x.png"; b="x.png"; {"y.js": 1}; url('z.woff')""",), (None,)], "t string").createOrReplaceTempView("texts")
    assert rows(spark.sql("SELECT n.* FROM texts, LATERAL asset_names(t) AS n")) == [("css", "z.woff"), ("quoted", "x.png"), ("quoted", "z.woff")]
