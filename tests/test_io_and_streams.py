import json
import zipfile

from pyspark.sql import functions as F

from lodestack.sources import readers as rd
from lodestack.sources import writers as wr
from lodestack.streaming import telemetry as st


def test_queue_round_trip(spark, rows, tmp_path):
    q = spark.createDataFrame([("https://example.test/a/", "A", "website_folder", "x"), ("https://example.test/b/", "", "auto", "y"), ("", "n", "m", "z")], "url string, filename string, mode string, _queue_id string")
    for fmt, read in (("csv", rd.read_queue_csv), ("txt", rd.read_queue_text)):
        wr.write_queue(q, str(tmp_path / fmt), fmt)
        assert rows(read(spark, str(tmp_path / fmt))) == [("https://example.test/a/", "A", "website_folder"), ("https://example.test/b/", "", "auto")]
    (tmp_path / "h.csv").write_text("﻿Title,Links\nx,https://a.test/\ny,ftp://no\n")
    assert rows(rd.read_queue_csv(spark, str(tmp_path / "h.csv"))) == [("https://a.test/", "x", "")]
    (tmp_path / "p.csv").write_text("https://a.test/,n,zip\n#https://b.test/,n,zip\n")
    assert rows(rd.read_queue_positional(spark, str(tmp_path / "p.csv"))) == [("https://a.test/", "n", "zip")]


def test_manifest_history_cache_resume(spark, rows, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"files": {"a": {"sha256": "AB", "size": 1}, "odd.dat": 17}}))
    entries, issues = rd.read_manifest(spark, str(tmp_path / "m.json"))
    assert rows(entries) == [("a", "ab", 1)] and rows(issues) == [("invalid manifest entry",)]
    (tmp_path / "b.json").write_text("{broken")
    assert rows(rd.read_manifest(spark, str(tmp_path / "b.json"))[1]) == [("invalid or unreadable",)]
    (tmp_path / "h.json").write_text(json.dumps({"x": 3, "https://kept.example.org": {"mode": "zip", "success": True}}))
    assert rows(rd.read_history(spark, str(tmp_path / "h.json")), "url", "mode", "success") == [("https://kept.example.org", "zip", True)]
    (tmp_path / "c.json").write_text(json.dumps({"a": [], "b": "beef", "c": "A" * 64}))
    assert rows(rd.read_cache_index(spark, str(tmp_path / "c.json"))) == [("c", "a" * 64)]
    (tmp_path / "r.json").write_text(json.dumps({"completed": ["ok", 1], "failed": ["bad"], "updated_at": "2025"}))
    assert rows(rd.read_resume(spark, str(tmp_path / "r.json"))) == [("bad", "failed", "2025"), ("ok", "completed", "2025")]


def test_failures_package_archives(spark, rows, tmp_path):
    (tmp_path / "f.txt").write_text("# --- 2024-01-01 00:00:00 (2 failed) ---\nu1\te1\n\nu2\te2\n")
    got = rd.read_failures(spark, str(tmp_path / "f.txt")).collect()
    assert [(str(r.section), r.url, r.error) for r in got] == [("2024-01-01 00:00:00", "u1", "e1"), ("2024-01-01 00:00:00", "u2", "e2")]
    root = tmp_path / "pkg"
    (root / "d").mkdir(parents=True)
    (root / "d" / "x.txt").write_text("hello")
    (root / "checksums.json").write_text("{}")
    with zipfile.ZipFile(root / "z.zip", "w") as z:
        z.writestr("docs/readme.txt", "r")
        z.writestr("project.json", "{}")
    files = rd.scan_package(spark, str(root))
    assert rows(files, "path") == [("d/x.txt",), ("z.zip",)]
    from lodestack.operators.windows import rank_members

    assert rows(files, "path", "size")[0] == ("d/x.txt", 5)
    members = rd.explode_archives(spark.read.format("binaryFile").load(str(root / "z.zip")))
    assert rank_members(members).where("place = 1").first().member == "project.json"


def test_log_lines(spark):
    df = spark.createDataFrame([("[3/10] a.png",), ("[4/10] FAILED b.png",), ("Website download started",), ("nothing",)], "line string")
    got = [(r.type, r.state, r.name, r.done, r.total, r.error) for r in rd.parse_log_events(df).collect()]
    assert got == [("asset_discovered", None, None, None, 10, None), ("file_completed", None, "a.png", 3, None, ""), ("asset_discovered", None, None, None, 10, None), ("file_failed", None, "b.png", 4, None, "[4/10] FAILED b.png"), ("stage_changed", "FETCHING_ENTRY", None, None, None, None)]


def test_report(spark):
    log = spark.createDataFrame([("images", "a.png", None), ("images", "a.png", None), ("css", "s.css", "HTTP 404")], "kind string, local string, error string")
    lines = [r.text for r in wr.render_report(log).orderBy("line_no").collect()]
    assert lines == ["Files: 2, failures: 1", "css: 1", "  s.css", "images: 1", "  a.png", "FAILED s.css: HTTP 404"]


def test_what_is_written_can_be_read(spark, rows, tmp_path):
    one = spark.createDataFrame([("u1", "e\t1"), ("u2", None), ("", "x")], "url string, error string")
    for ts in ("2024-01-01 00:00:00", "2024-02-02 10:20:30"):
        wr.append_failures(one, str(tmp_path / "log"), ts)
    got = [(str(r.section), r.url, r.error) for r in rd.read_failures(spark, str(tmp_path / "log")).collect()]
    assert sorted(got) == sorted((ts, *x) for ts in ("2024-01-01 00:00:00", "2024-02-02 10:20:30") for x in (("u1", "e 1"), ("u2", "")))
    files = spark.createDataFrame([("p", f"f{k}", f"{k:064x}", k) for k in range(12_000)] + [("q", "f", "aa", 1)], "package string, path string, sha256 string, size long")
    wr.write_manifest(files, str(tmp_path / "m"), "2024-01-01T00:00:00Z")
    for package in ("p", "q"):
        entries, issues = rd.read_manifest(spark, f"{tmp_path}/m/package={package}")
        assert rows(entries) == rows(files.where(F.col("package") == package), "path", "sha256", "size") and issues.count() == 0
    run = spark.createDataFrame([(f"u{k}", "completed" if k % 3 else "failed") for k in range(9000)], "url string, state string")
    wr.write_resume(run, str(tmp_path / "r"), "2024-01-01")
    assert rows(rd.read_resume(spark, str(tmp_path / "r")), "url", "state") == rows(run) and rd.read_resume(spark, str(tmp_path / "r")).first().updated_at == "2024-01-01"
    results = spark.createDataFrame([("OK", "u", "zip", "f", None, 7)], "status string, url string, mode string, filename string, error string, more int")
    wr.write_results(results, str(tmp_path / "res"))
    assert spark.read.csv(str(tmp_path / "res"), header=True).columns == ["status", "url", "mode", "filename", "error"]
    pages = spark.createDataFrame([("a", 0), ("b", 3)], "url string, depth int")
    wr.write_archive_plan(pages, pages.limit(1), {"limit": True, "remaining": 4}, {"strategy": "smart"}, str(tmp_path / "plan"))
    r = spark.read.json(str(tmp_path / "plan")).first()
    assert (r.pages, r.depth, r.failures, r.limit_reached, r.remaining) == (2, 3, 1, True, 4)
    projects = spark.createDataFrame([("p", '{"rows":[{"objects":[{"image":"x"}]}],"title":"T"}')], "project_id string, t string").withColumn("payload", F.parse_json("t"))
    wr.write_project_metadata(projects, str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).first().title == "T"


def run_stream(spark, tmp_path, name, make, mode="append"):
    src = tmp_path / f"{name}-in"
    rows = [(k, f"2024-01-01 00:0{k // 60}:{k % 60:02d}", k % 2, ("job_started" if k < 2 else "file_completed"), 100.0) for k in range(0, 120)]
    df = spark.createDataFrame(rows, "event_id long, t string, job long, type string, bytes double").withColumn("ts", F.col("t").cast("timestamp")).withColumn("error", F.lit(None).cast("string")).drop("t")
    df.coalesce(1).write.parquet(str(src))
    stream = make(spark.readStream.schema(df.schema).parquet(str(src)))
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name), make(df) if mode == "complete" else df


def test_streams(spark, rows, tmp_path):
    got, want = run_stream(spark, tmp_path, "thr", lambda d: st.throughput(d, "1 minute"), "complete")
    assert rows(got) == rows(want)
    got, batch = run_stream(spark, tmp_path, "dd", lambda d: st.dedup_stream(d, ["job", "type"]))
    assert got.count() == 4
    got, batch = run_stream(spark, tmp_path, "red", lambda d: st.redact_stream(d.withColumn("text", F.lit("password=abcdefgh"))))
    assert got.select("text").distinct().first().text == "password=__REDACTED__"


def test_job_state_stream(spark, tmp_path):
    got, _ = run_stream(spark, tmp_path, "jobs", lambda d: st.job_state_stream(d.withColumn("type", F.when(F.col("event_id") % 4 == 3, "bytes_transferred").otherwise(F.col("type")))), "update")
    s = {r.job: r for r in got.collect()}
    assert s[0].finished == 59 and s[0].state == "DOWNLOADING" and s[0].bytes == 0.0 and s[0].samples >= 59 and len(s[1].history) <= 120
    assert s[1].success == 29 and s[1].bytes == 3000.0 and s[1].peak == 50.0


def test_events_fold_like_their_types_say():
    s = dict(st._NEW)
    s["history"] = []
    fold = lambda now, kind, bytes_=None, total=None, state=None, name=None, error=None: st.apply_event(s, now, kind, bytes_, total, state, name, error)
    fold(0, "queue_started", total=3)
    fold(0, "job_started", total=2)
    assert s["state"] == "RESOLVING" and s["total_jobs"] == 3 and s["progress"] == 0.025
    fold(1, "stage_changed", state="fetching_entry")
    fold(1, "stage_changed", state="nonsense")
    fold(1, "asset_discovered", total=4)
    assert s["state"] == "DISCOVERING_ASSETS" and s["assets_total"] == 4 and abs(s["progress"] - 0.175) < 1e-12
    fold(2, "file_started", name="a")
    fold(2, "response_meta", name="a", total=100)
    fold(2, "response_meta", name="b")
    fold(2.2, "file_progress", bytes_=40)
    fold(2.3, "file_progress", bytes_=30)
    assert s["file"] == "b" and s["bytes"] == 40 and s["known_bytes"] == 100 and not s["size_complete"]
    fold(3, "file_completed", name="a")
    fold(3, "file_skipped")
    fold(4, "file_failed", error="no")
    assert (s["finished"], s["success"], s["skipped"], s["failed"], s["error"]) == (3, 1, 1, 1, "no") and abs(s["progress"] - (0.25 + 0.6 * 0.75)) < 1e-12 and s["peak"] > 0
    fold(4.1, "file_retry")
    assert s["state"] == "RETRYING" and s["retried"] == 1
    fold(5, "stage_changed", state="DISCOVERING_ASSETS")
    assert s["progress"] >= 0.7  # it never goes back
    fold(6, "job_completed")
    assert s["state"] == "COMPLETED_WITH_WARNINGS" and s["progress"] == 1.0 and s["speed"] == 0.0 and s["completed_jobs"] == 1
    fold(7, "job_started")
    assert s["finished"] == 0 and s["error"] == "" and s["completed_jobs"] == 1
    fold(8, "cancelling")
    fold(9, "job_cancelled")
    fold(9, "job_failed", error="x")
    assert s["state"] == "FAILED" and s["cancelled_jobs"] == 1 and s["failed_jobs"] == 1 and s["error"] == "x"
