"""Queries over ``events`` as telemetry: job = user_id, bytes = value, ``error`` is a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.scalars import format_duration
from lodestack.operators import aggregates as agg
from lodestack.operators import windows as wi
from lodestack.plans.base import Query, register, table
from lodestack.sources.writers import upsert_history
from lodestack.streaming import telemetry as st

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _q(sql: str | None = None):
    return register(QUERIES, SQL, sql)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job"), F.col("event_type").alias("type"), F.col("value").alias("bytes"))


@_q("SELECT user_id AS job, count(*) AS n, round(sum(value), 4) AS bytes, time_bucket(INTERVAL 10 MINUTE, ts) AS start FROM events GROUP BY ALL")
def throughput_10m(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = st.throughput(_events(spark, sf_dir))
    return w.select("job", "n", F.round("bytes", 4).alias("bytes"), F.col("start").cast("timestamp_ntz").alias("start"))


@_q("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE AND ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS job, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS bytes FROM s GROUP BY user_id, k""")
def job_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = st.job_sessions(_events(spark, sf_dir))
    return s.select("job", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("bytes", 4).alias("bytes"))


@_q("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r AS (SELECT user_id, k, CASE WHEN value < 0 THEN 0.0::DOUBLE ELSE value END AS s FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.k, CASE WHEN r.s <= 0 THEN greatest(o.value, 0) ELSE 0.28::DOUBLE * greatest(o.value, 0) + 0.72::DOUBLE * r.s END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1) SELECT user_id AS job, round(arg_max(s, k), 4) AS speed, max(k) AS n FROM r GROUP BY 1""")
def ewma_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wi.ewma_by(_events(spark, sf_dir), "job", "bytes", ["ts", "event_id"], 0.28).select("job", F.round("smoothed", 4).alias("speed"), "n")


@_q("""WITH RECURSIVE o AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r AS (SELECT user_id, k, CASE WHEN ok THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS b, CASE WHEN ok THEN 0 ELSE 1 END AS f FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.k, CASE WHEN o.ok THEN r.b / 2 ELSE least(300.0::DOUBLE, CASE WHEN r.b > 0 THEN r.b * 2 ELSE 2.0::DOUBLE END) END, CASE WHEN o.ok THEN greatest(r.f - 1, 0) ELSE r.f + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1) SELECT user_id::VARCHAR AS domain, max(k) AS attempts, round(arg_max(b, k), 6) AS backoff, arg_max(f, k)::BIGINT AS fails FROM r GROUP BY 1""")
def domain_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    attempts = e.select(F.col("job").cast("string").alias("domain"), F.struct("ts", "event_id").alias("ts"), (F.col("type") != "error").alias("ok"))
    return wi.domain_backoff(attempts).withColumn("backoff", F.round("backoff", 6))


@_q("""WITH o AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, (event_id % 7) * 400::DOUBLE AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events), s AS (SELECT user_id, k, t, max(t + b - 0.3::DOUBLE * k) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) + 0.3::DOUBLE * k AS slot FROM o)
SELECT user_id AS domain, count(*) AS n, round(max(slot - t), 3) AS longest_wait FROM s GROUP BY 1""")
def request_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("job").alias("domain"), "ts", ((F.col("event_id") % 7) * 400.0).alias("backoff"))
    return wi.request_slots(rows).groupBy("domain").agg(F.count("*").alias("n"), F.round(F.max("wait"), 3).alias("longest_wait"))


@_q("""WITH p AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 0.025 WHEN 'view' THEN 0.175 WHEN 'click' THEN 0.25 + 0.6 * least(event_id % 12 / 10, 1) WHEN 'error' THEN 0.25 WHEN 'purchase' THEN 0.9825 END::DOUBLE AS v FROM events)
SELECT event_id, round(max(v) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS shown FROM p""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("type") == "signup", "resolving").when(F.col("type") == "view", "DISCOVERING_ASSETS").when(F.col("type") == "click", "DOWNLOADING").when(F.col("type") == "error", "RETRYING").otherwise("PACKAGING")
    rows = _events(spark, sf_dir).withColumns({"state": state, "finished": F.col("event_id") % 12, "total": F.when(F.col("type") == "click", 10)})
    return wi.job_progress(rows).select("event_id", F.round("shown", 6).alias("shown"))


@_q("SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS last_error FROM events")
def last_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("error", F.when(F.col("type") == "error", F.col("event_id")))
    return wi.job_latest(e, ["error"]).select("event_id", "last_error")


@_q("""WITH g AS (SELECT user_id, value, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6 AS gap FROM events), s AS (SELECT user_id, CASE WHEN gap >= 0.5 THEN value / gap END AS speed FROM g) SELECT user_id AS job, count(speed) AS samples, round(max(speed), 6) AS peak FROM s GROUP BY 1""")
def peak_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wi.speed_samples(_events(spark, sf_dir)).groupBy("job").agg(F.count("speed").alias("samples"), F.round(F.max("speed"), 6).alias("peak"))


@_q("SELECT user_id AS url, max(ts) AS last_downloaded, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def history_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), F.col("ts").alias("last_downloaded"), "event_id")
    return upsert_history(e.where(F.col("event_id") % 2 == 0), e.where(F.col("event_id") % 2 == 1), 50)


@_q("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts FROM events) GROUP BY ALL")
def distinct_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), F.col("ts").alias("local"), F.col("event_type").alias("kind"), F.lit("").alias("error"))
    return agg.dedup_log(e).groupBy(F.col("url").alias("user_id"), F.col("kind").alias("event_type")).agg(F.count("*").alias("n"))


@_q("SELECT user_id AS job, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type <> 'purchase') AS others, count(*) FILTER (event_type IN ('purchase', 'signup')) AS succeeded FROM events GROUP BY 1")
def result_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("type") == "purchase", "OK").when(F.col("type") == "signup", "SKIP").when(F.col("type") == "error", "FAIL").otherwise("CANCELLED")
    return agg.summarise_results(_events(spark, sf_dir).withColumn("status", status), "job")


@_q("SELECT user_id AS page, count(*) FILTER (event_type = 'signup' AND event_id % 2 = 0) AS ads, count(*) FILTER (event_type = 'signup' AND event_id % 2 = 1) AS loops, count(*) FILTER (event_type = 'view') AS discovered, count(*) FILTER (event_type = 'purchase') AS downloaded, count(*) FILTER (event_type = 'error') AS failed, count(*) AS steps FROM events GROUP BY 1")
def capture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("type") == "view", "discovered").when(F.col("type") == "purchase", "downloaded").when(F.col("type") == "error", "failed").when(F.col("type") == "signup", "blocked")
    reason = F.when(F.col("event_id") % 2 == 0, "ads").otherwise("loops")
    out = agg.summarise_capture(_events(spark, sf_dir).select(F.col("job").alias("page"), kind.alias("type"), reason.alias("reason")), reason="reason")
    n = lambda r: F.coalesce(F.try_element_at("blocked", F.lit(r)), F.lit(0)).cast("long").alias(r)
    return out.select("page", n("ads"), n("loops"), "discovered", "downloaded", "failed", "steps")


@_q("SELECT user_id AS job, arg_min(event_type, ts) AS type FROM events GROUP BY 1")
def first_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.first_observed(_events(spark, sf_dir), "job", "type")


@_q("WITH n AS (SELECT user_id AS job, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events WHERE event_type <> 'error') SELECT job, event_id FROM n WHERE n = 1")
def first_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumns({"ok": F.col("type") != "error", "rank": F.struct("bytes", "event_id")})
    return wi.first_success(e, "job", "rank").select("job", "event_id")


@_q("WITH d AS (SELECT user_id AS job, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6)::BIGINT AS s FROM events GROUP BY 1) SELECT job, lpad((s // 3600)::VARCHAR, greatest(2, length((s // 3600)::VARCHAR))::INT, '0') || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS took FROM d")
def job_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    return _events(spark, sf_dir).groupBy("job").agg(format_duration(s).alias("took"))


@_q("""WITH g AS (SELECT ts, value, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), w AS (SELECT min(ts) AS start, sum(value::DECIMAL(18, 2))::DOUBLE AS bytes, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS spent FROM s GROUP BY k)
SELECT start, round(bytes, 4) AS bytes, round(greatest(bytes / 0.1::DOUBLE - spent, 0), 4) AS excess FROM w""")
def bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = st.bandwidth_excess(_events(spark, sf_dir).withColumn("bytes", F.col("bytes").cast("decimal(18,2)")), 0.1, idle="5 minutes")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), F.round(F.col("bytes").cast("double"), 4).alias("bytes"), F.round("excess", 4).alias("excess"))
