"""Streams of job events: windows, sessions, de-duplication, and jobs' states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle, TimerValues

from lodestack.functions import fixed
from lodestack.operators.filters import redacted
from lodestack.operators.scan import Scan
from lodestack.streaming.state import Fold, in_order, seconds, stateful


def throughput(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """job, start, bytes, n per tumbling window."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("job", F.window("ts", window).alias("w")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).select("job", F.col("w.start").alias("start"), "bytes", "n")


def bandwidth_excess(events: DataFrame, limit: float, idle: str = "1 second", late: str = "1 hour") -> DataFrame:
    """start, bytes, excess: seconds by which a run of traffic took less than ``limit`` bytes a second allow. A run ends after ``idle`` without any; then the
    account begins anew.

    Runs have no key. Of a table they are found by ranges of time: a row that comes ``idle`` or more after the one before begins a run, and their running
    number is the run's, so no task has all rows. A stream's are session windows.
    """
    spent = lambda: (F.unix_micros("end") - F.unix_micros("start")) / 1e6
    totals = (F.sum("bytes").alias("bytes"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    if events.isStreaming:
        runs = events.withWatermark("ts", late).groupBy(F.session_window("ts", idle).alias("s")).agg(*totals)
    else:
        new = F.when(F.col("before").isNull() | (F.col("ts") >= F.col("before") + F.expr(f"INTERVAL {idle}")), 1).otherwise(0)
        runs = Scan(events.where("ts is not null").select("ts", "bytes"), ["ts"]).before("before", F.col("ts")).sum("run", new).result().groupBy("run").agg(*totals)
    return runs.select("start", "bytes", F.greatest(F.col("bytes") / limit - spent(), F.lit(0.0)).alias("excess"))


def job_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """job, start, end, n, bytes of runs of activity."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    s = rows.groupBy("job", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return s.select("job", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "bytes")


def dedup_stream(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within ``late``; the state of older keys goes."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def queue_progress(events: DataFrame) -> DataFrame:
    """Per queue how many rows are done, and the share."""
    done = F.count_if(F.col("type").isin("job_completed", "job_failed", "job_cancelled"))
    return events.groupBy("queue").agg(done.alias("done"), F.count_if(F.col("type") == "job_queued").alias("total")).withColumn("ratio", F.col("done") / F.greatest("total", F.lit(1)))


def redact_stream(logs: DataFrame, column: str = "text") -> DataFrame:
    return redacted(logs, column)


#: Speeds kept per job.
HISTORY = 120

STATE = (
    "state string, total_jobs long, completed_jobs long, failed_jobs long, cancelled_jobs long, assets_total long, finished long, success long, failed long, skipped long, retried long, "
    "file_bytes double, bytes double, known_bytes double, size_complete boolean, sample_bytes double, speed double, average double, peak double, samples long, progress double, "
    "file string, error string, started double, last double, history array<double>"
)

_NEW_JOB = {
    "assets_total": None, "finished": 0, "success": 0, "failed": 0, "skipped": 0, "retried": 0, "file_bytes": 0.0, "bytes": 0.0, "known_bytes": 0.0, "size_complete": True, "sample_bytes": 0.0,
    "speed": 0.0, "average": 0.0, "peak": 0.0, "samples": 0, "progress": 0.0, "file": "", "error": "", "history": [],
}
_NEW = {"state": "IDLE", "total_jobs": 0, "completed_jobs": 0, "failed_jobs": 0, "cancelled_jobs": 0, "started": None, "last": None, **_NEW_JOB}

#: Columns of events besides job, ts and type, all of which may be null.
DETAILS = ("bytes", "total", "state", "name", "error")


def _moved(s: dict, state: str) -> None:
    """The job is in ``state`` now; its progress never goes back."""
    if state not in fixed.STAGE_BANDS:
        return
    a, b = fixed.STAGE_BANDS[state]
    share = min(1.0, max(0.0, s["finished"] / s["assets_total"])) if s["assets_total"] else 0.0
    value = a + (b - a) * share if state in ("DOWNLOADING", "RETRYING") else (a + b) / 2 if a != b else b
    s["state"], s["progress"] = state, min(1.0, max(s["progress"], value))
    if state in ("COMPLETED", "COMPLETED_WITH_WARNINGS"):
        s["progress"] = 1.0
    if state in ("COMPLETED", "COMPLETED_WITH_WARNINGS", "FAILED", "CANCELLED"):
        s["speed"] = 0.0


def _sampled(s: dict, now: float, force: bool, alpha: float) -> None:
    """A speed sample at least every half second, and after each file."""
    if s["last"] is None:
        s["last"] = now
        return
    gap = now - s["last"]
    if gap <= 0 or (gap < 0.5 and not force):
        return
    instant = s["sample_bytes"] / gap
    s["speed"] = instant if s["speed"] <= 0 else alpha * instant + (1 - alpha) * s["speed"]
    s["sample_bytes"], s["last"], s["samples"], s["peak"] = 0.0, now, s["samples"] + 1, max(s["peak"], instant)
    s["history"] = [*s["history"], s["speed"]][-HISTORY:]
    if s["started"] is not None and now > s["started"]:
        s["average"] = s["bytes"] / (now - s["started"])


def apply_event(s: dict, now: float, kind: str, bytes_: float | None, total: float | None, state: str | None, name: str | None, error: str | None, alpha: float = 0.28) -> None:
    """Fold one event into a job's state."""
    n = max(0.0, bytes_ or 0.0)
    if kind == "queue_started":
        s |= _NEW | {"total_jobs": int(total or 0), "started": now, "last": now}
        _moved(s, "RESOLVING")
    elif kind == "job_started":
        s |= _NEW_JOB | {"started": now, "last": now, "total_jobs": max(s["total_jobs"], int(total or s["total_jobs"] or 1))}
        _moved(s, "RESOLVING")
    elif kind == "stage_changed":
        _moved(s, (state or "").upper())
    elif kind == "asset_discovered":
        s["assets_total"] = max(s["assets_total"] or 0, int(total) if total is not None else s["finished"] + 1)
        _moved(s, "DISCOVERING_ASSETS")
    elif kind == "file_started":
        s["file"], s["file_bytes"] = name or "", 0.0
        _moved(s, "DOWNLOADING")
    elif kind == "response_meta":
        s["file"] = name or s["file"]
        if total is None:
            s["size_complete"] = False
        else:
            s["known_bytes"] += max(0.0, total)
    elif kind in ("bytes_transferred", "speed_bytes", "file_progress"):
        more = max(0.0, n - s["file_bytes"]) if kind == "file_progress" else n
        for c in ("sample_bytes", "bytes", "file_bytes"):
            s[c] += more
        if kind == "file_progress":
            _moved(s, "DOWNLOADING")
    elif kind in ("file_completed", "file_failed", "file_skipped"):
        s["finished"] += 1
        s[{"file_completed": "success", "file_failed": "failed", "file_skipped": "skipped"}[kind]] += 1
        if kind == "file_completed":
            s["file"] = name or s["file"]
            _sampled(s, now, True, alpha)
        elif kind == "file_failed":
            s["error"] = error or s["error"]
        _moved(s, "DOWNLOADING")
    elif kind == "file_retry":
        s["retried"] += 1
        _moved(s, "RETRYING")
    elif kind == "job_completed":
        s["completed_jobs"] += 1
        _moved(s, "COMPLETED_WITH_WARNINGS" if int(total or s["failed"]) else "COMPLETED")
    elif kind == "job_failed":
        s["failed_jobs"] += 1
        s["error"] = error or "Download failed"
        _moved(s, "FAILED")
    elif kind == "job_cancelled":
        s["cancelled_jobs"] += 1
        _moved(s, "CANCELLED")
    elif kind == "cancelling":
        _moved(s, "CANCELLING")
    _sampled(s, now, False, alpha)


def job_state_stream(events: DataFrame, alpha: float = 0.28, expires: str = "1 day", late: str = "1 hour") -> DataFrame:
    """job and its state after each batch: (job, ts, type, bytes, total, state, name, error) events folded in time order.

    17 types: queue_started, job_started (both begin anew), stage_changed, asset_discovered, file_started, response_meta (of a file once: see
    ``dedup_stream``), bytes_transferred, speed_bytes, file_progress, file_completed, file_failed, file_skipped, file_retry, job_completed
    (``total``: failed files, else those counted), job_failed, job_cancelled, cancelling; others only take a speed sample. The state is one row of
    numbers a job and a list of its last HISTORY speeds; a job that is silent for ``expires`` of event time is forgotten. Events over ``late`` are dropped. A
    batch's events are folded in the order of time, with at most 2 HELD_ROWS of them in memory.
    """
    kind = events.schema["job"].dataType.simpleString()
    for c in DETAILS:
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("double" if c in ("bytes", "total") else "string"))
    rows = events.withWatermark("ts", late).select("job", "ts", "type", *[F.col(c).cast("double" if c in ("bytes", "total") else "string").alias(c) for c in DETAILS])
    return stateful(rows, "job", JobFold(alpha, expires), f"job {kind}, {STATE}")


class JobFold(Fold):
    """A job's numbers as a value, its speeds as a list."""

    def __init__(self, alpha: float, expires: str) -> None:
        super().__init__(expires)
        self.alpha = alpha
        self.names = [x.strip().split()[0] for x in STATE.split(",") if "history" not in x]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.numbers = handle.getValueState("numbers", ", ".join(x for x in STATE.split(",") if "history" not in x))
        self.speeds = handle.getListState("speeds", "speed double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        s = _NEW | (dict(zip(self.names, self.numbers.get())) if self.numbers.exists() else {})
        s["history"] = [v for (v,) in self.speeds.get()] if self.speeds.exists() else []
        value = lambda x: None if pd.isna(x) else x
        last = self.seen()
        for piece in in_order(rows, ["ts"]):
            for now, r in zip(seconds(piece["ts"]).tolist(), piece.itertuples()):
                s = dict(_NEW) if now - last > self.wait else s
                last = now
                apply_event(s, now, r.type, *(value(getattr(r, c)) for c in DETAILS), alpha=self.alpha)
        self.numbers.update(tuple(s[n] for n in self.names))
        if s["history"]:
            self.speeds.put([(v,) for v in s["history"]])
        self.alive(last, timerValues)
        yield pd.DataFrame([{"job": key[0], **{n: s[n] for n in self.names}, "history": s["history"]}])

    def forget(self) -> None:
        self.numbers.clear()
        self.speeds.clear()


def speed_stream(events: DataFrame, alpha: float = 0.28) -> DataFrame:
    """job, speed, average, peak, samples, history (the last HISTORY smoothed speeds) after each batch."""
    return job_state_stream(events, alpha).select("job", "speed", "average", "peak", "samples", "history")
