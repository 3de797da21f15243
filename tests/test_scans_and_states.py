"""Running values by ranges against windows; states of streams against their batch twins."""

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.operators import aggregates as agg
from lodestack.operators import windows as wi
from lodestack.operators.scan import Scan, with_totals
from lodestack.streaming import state, telemetry


@pytest.fixture(scope="module")
def events(spark):
    """3,000 events, of which 60 % are of one job; some values are null."""
    job = F.when(F.col("id") % 5 < 3, 0).when(F.col("id") % 7 != 6, F.col("id") % 7)
    value = F.when(F.col("id") % 3 > 0, F.xxhash64("id", F.lit(1)) % 1000)
    return spark.range(3000, numPartitions=5).select((F.xxhash64("id") % 100_000).alias("t"), "id", job.alias("job"), value.alias("v"))


@pytest.mark.parametrize("group", [["job"], []])
def test_scan_against_windows(events, group):
    w = Window.partitionBy(*group).orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = Scan(events, ["t", "id"], group).sum("s", F.coalesce("v", F.lit(0))).max("m", F.col("v")).last("l", F.col("v")).before("b", F.col("v")).sum("n", F.when(F.col("b").isNull(), 1).otherwise(0)).result()
    want = events.withColumns({"s": F.sum(F.coalesce("v", F.lit(0))).over(upto), "m": F.max("v").over(upto), "l": F.last("v", ignorenulls=True).over(upto), "b": F.lag("v").over(w)}).withColumn("n", F.sum(F.when(F.col("b").isNull(), 1).otherwise(0)).over(upto))
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_totals_of_hot_and_other_groups(events):
    got = with_totals(events, ["job"], n=F.count("*"), m=F.max("v"))
    w = Window.partitionBy("job")
    want = events.withColumns({"n": F.count("*").over(w), "m": F.max("v").over(w)})
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_hot_group_is_not_one_task(spark):
    hot = spark.range(200_000).select(F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") % 5 < 3, 0).otherwise(F.col("id")).alias("job"), (F.col("id") % 1000).cast("double").alias("bytes"))
    found = wi.speed_samples(hot)
    assert found.where("job = 0 and speed is not null").count() == 119_999
    sizes = Scan(hot, ["ts"], ["job"]).df.groupBy("__p").count().agg(F.max("count")).first()[0]
    assert sizes < 200_000 / 4


def test_runs_without_a_key(spark):
    rows = [(0, 5.0), (1, 5.0), (1, 1.0), (9, 2.0), (10, 2.0), (30, 1.0), (None, 7.0)]
    df = spark.createDataFrame(rows, "s int, bytes double").select(F.timestamp_seconds("s").alias("ts"), "bytes")
    got = telemetry.bandwidth_excess(df, 2.0, idle="5 seconds")
    assert sorted((r.start.timestamp(), r.bytes, r.excess) for r in got.collect()) == [(0.0, 11.0, 4.5), (9.0, 4.0, 1.0), (30.0, 1.0, 0.5)]
    many = spark.range(100_000).select(F.timestamp_seconds(F.floor(F.col("id") / 100) * 100 + F.col("id") % 100 / 20).alias("ts"), F.lit(1.0).alias("bytes"))
    assert telemetry.bandwidth_excess(many, 1.0, idle="10 seconds").groupBy("bytes").count().collect()[0].asDict() == {"bytes": 100.0, "count": 1000}


def test_lists_as_rows(spark, rows):
    log = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), (None, "z")], "kind string, local string")
    assert rows(agg.files_by_kind(log), "kind", "local", "n") == [("a", "x", 2), ("a", "y", 2), (None, "z", 1)]
    refs = spark.createDataFrame([("u", 1), ("u", 2), ("u", 2), ("v", 1)], "url string, owner int")
    assert rows(agg.ref_sources(refs), "url", "owner", "n") == [("u", 1, 2), ("u", 2, 2), ("v", 1, 1)]


@pytest.fixture
def streamed(spark, tmp_path):
    """A table as a stream of files of ``n`` rows each, in order, and what the stream gives, batch by batch."""

    def run(df, order, n, make):
        folder = tmp_path / "in"
        for k in range(-(-df.count() // n)):
            df.orderBy(*order).offset(k * n).limit(n).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
        out = []
        query = make(source).writeStream.outputMode(make.mode).option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda b, i: out.append(b.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        return out

    return run


def made(mode, f):
    f.mode = mode
    return f


@pytest.fixture
def attempts(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return e.select(F.concat(F.lit("Host"), F.col("user_id") % 12).alias("domain"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("tie"), ((F.col("event_id") % 7) * 400.0).alias("backoff"))


def test_backoff_stream_is_its_batch_twin(attempts, streamed):
    n = -(-attempts.count() // 5)
    batches = streamed(attempts, ["ts", "tie"], n, made("update", lambda s: state.backoff_stream(s, expires="4000 days")))
    assert sum(map(bool, batches)) == 5
    last = {r.domain: r for b in batches for r in b}
    twin = wi.domain_backoff(attempts.withColumn("ts", F.struct("ts", "tie"))).collect()
    assert {r.domain: (r.attempts, round(r.backoff, 9), r.fails) for r in twin} == {k: (r.attempts, round(r.backoff, 9), r.fails) for k, r in last.items()}


def test_slot_stream_is_its_batch_twin(attempts, streamed):
    n = -(-attempts.count() // 5)
    batches = streamed(attempts, ["ts", "tie"], n, made("append", lambda s: state.slot_stream(s, expires="4000 days")))
    got = {(r.domain, r.tie): r.slot for b in batches for r in b}
    twin = {(r.domain, r.tie): r.slot for r in wi.request_slots(attempts).collect()}
    assert got.keys() == twin.keys() and len(got) == attempts.count() and all(abs(got[k] - twin[k]) < 1e-3 for k in got)


def test_pieces_in_order():
    rows = pd.DataFrame({"ts": [3, 1, 2, 6, 5, 4, 9, 8, 7], "v": range(9)})
    pieces = list(state.in_order(iter([rows[:3], rows[3:6], rows[6:]]), ["ts"], 3))
    assert pd.concat(pieces)["ts"].tolist() == list(range(1, 10)) and [len(p) for p in pieces] == [3, 3, 3] and not list(state.in_order(iter(()), ["ts"]))


def test_states_expire(spark, streamed):
    rows = [("a", 10, False), ("a", 11, False), ("b", 12, False), ("b", 100_000, False), ("b", 100_001, True), ("a", 200_001, False), ("b", 200_002, False)]
    df = spark.createDataFrame(rows, "domain string, s int, ok boolean").select("domain", F.timestamp_seconds("s").alias("ts"), "ok", F.monotonically_increasing_id().alias("tie"))
    batches = streamed(df, ["ts"], 1, made("update", lambda s: state.backoff_stream(s, expires="1 hour", late="1 minute")))
    got = [(r.domain, r.attempts, r.backoff, r.fails) for b in batches for r in b]
    assert got == [("a", 1, 2.0, 1), ("a", 2, 4.0, 2), ("b", 1, 2.0, 1), ("b", 1, 2.0, 1), ("b", 2, 1.0, 0), ("a", 1, 2.0, 1), ("b", 1, 2.0, 1)]


def test_a_job_of_many_events_in_one_batch(spark, streamed):
    df = spark.range(100_000, numPartitions=1).select(F.lit("j").alias("job"), F.timestamp_seconds(F.col("id") + 1000).alias("ts"), F.when(F.col("id") == 0, "job_started").otherwise("bytes_transferred").alias("type"), F.lit(10.0).alias("bytes"))
    (last,), *_ = streamed(df, ["ts"], 100_000, made("update", lambda s: telemetry.job_state_stream(s)))
    assert (last.bytes, last.samples, len(last.history), last.peak) == (999_990.0, 99_999, telemetry.HISTORY, 10.0)
