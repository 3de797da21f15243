"""Folds of streams with a state of bounded size a key, which ends when the key is silent; backoffs and request slots of domains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Of a key's rows in a batch so many are held to bring them into order; Spark hands them over in pieces that needn't be in the order of time.
HELD_ROWS = 100_000


def in_order(pieces: Iterator[pd.DataFrame], by: list[str], held_rows: int | None = None) -> Iterator[pd.DataFrame]:
    """The rows of ``pieces`` in the order of ``by``, again in pieces; exactly so if no row is more than ``held_rows`` rows out of place."""
    most, held = held_rows or HELD_ROWS, []
    for piece in pieces:
        held.append(piece)
        if sum(map(len, held)) >= 2 * most:
            rows = pd.concat(held).sort_values(by, kind="stable")
            yield rows.iloc[:-most]
            held = [rows.iloc[-most:]]
    if held:
        yield pd.concat(held).sort_values(by, kind="stable")


def seconds(ts: pd.Series) -> np.ndarray:
    return ts.astype("datetime64[us]").astype("int64").to_numpy() / 1e6


class Fold(StatefulProcessor):
    """A fold of a key's rows. Its state goes when the key has been silent for ``expires`` of event time: a timer removes it, and a row that comes later than
    that begins anew even where the watermark has not got so far."""

    def __init__(self, expires: str) -> None:
        self.wait = pd.Timedelta(expires).total_seconds()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long, seen double")

    def seen(self) -> float:
        """When the key had its last row; infinitely late for a new one."""
        return self.due.get()[1] if self.due.exists() else np.inf

    def alive(self, seconds: float, timers: TimerValues) -> None:
        """The key had a row at ``seconds``: its end moves on."""
        at = max(int(seconds * 1000), timers.getCurrentWatermarkInMs()) + int(self.wait * 1000)
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(at)
        self.due.update((at, seconds))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        self.due.clear()
        return iter(())

    def forget(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


def stateful(rows: DataFrame, key: str, fold: Fold, schema: str, mode: str = "Update") -> DataFrame:
    """``rows`` (with a watermark) folded by ``key``. State is kept by RocksDB, so it may outgrow memory."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return rows.groupBy(key).transformWithStateInPandas(fold, schema, mode, "EventTime")


class BackoffFold(Fold):
    """attempts, backoff and fails of a domain."""

    def __init__(self, base: float, most: float, expires: str) -> None:
        super().__init__(expires)
        self.base, self.most = base, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("backoff", "attempts long, backoff double, fails long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, backoff, fails = self.state.get() if self.state.exists() else (0, 0.0, 0)
        last = self.seen()
        for piece in in_order(rows, ["ts", "tie"]):
            for now, ok in zip(seconds(piece["ts"]).tolist(), piece["ok"].tolist()):
                if now - last > self.wait:
                    n, backoff, fails = 0, 0.0, 0
                n, last = n + 1, now
                if ok:
                    backoff, fails = backoff / 2, max(0, fails - 1)
                else:
                    backoff, fails = min(self.most, backoff * 2) if backoff > 0 else self.base, fails + 1
        self.state.update((n, backoff, fails))
        self.alive(last, timerValues)
        yield pd.DataFrame({"domain": [key[0]], "attempts": [n], "backoff": [backoff], "fails": [fails]})

    def forget(self) -> None:
        self.state.clear()


def backoff_stream(attempts: DataFrame, base: float = 2.0, most: float = 300.0, expires: str = "1 day", late: str = "1 hour") -> DataFrame:
    """domain, attempts, backoff, fails after each batch of attempts (domain, ts, ok; ``tie`` orders those of one time): as ``domain_backoff`` of a table.

    A batch's attempts are folded in the order of time, with at most 2 HELD_ROWS of them in memory; null ``ok`` is a failure. A domain that
    is silent for ``expires`` begins anew. Attempts over ``late`` are dropped.
    """
    tie = F.col("tie").cast("long") if "tie" in attempts.columns else F.lit(0).cast("long")
    rows = attempts.withWatermark("ts", late).select(F.lower("domain").alias("domain"), "ts", F.coalesce(F.col("ok").cast("boolean"), F.lit(False)).alias("ok"), tie.alias("tie"))
    return stateful(rows, "domain", BackoffFold(base, most, expires), "domain string, attempts long, backoff double, fails long")


class SlotFold(Fold):
    """The last slot of a domain."""

    def __init__(self, gap: float, expires: str) -> None:
        super().__init__(expires)
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("slot", "slot double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        slot = self.state.get()[0] if self.state.exists() else -np.inf
        last = -np.inf
        for piece in in_order(rows, ["ts", "tie"]):
            now = seconds(piece["ts"])
            steps = self.gap * np.arange(1, len(piece) + 1)
            ready = now + np.maximum(np.nan_to_num(piece["backoff"].to_numpy(float)), 0.0) - steps
            own = np.maximum(np.maximum.accumulate(ready), slot) + steps  # the slot before is that of place 0
            slot, last = float(own[-1]), max(last, float(now[-1]))
            yield pd.DataFrame({"domain": key[0], "ts": piece["ts"], "tie": piece["tie"], "slot": own, "wait": own - now})
        self.state.update((slot,))
        self.alive(max(last, slot), timerValues)

    def forget(self) -> None:
        self.state.clear()


def slot_stream(attempts: DataFrame, gap: float = 0.3, expires: str = "1 day", late: str = "1 hour") -> DataFrame:
    """domain, ts, tie, slot, wait of each attempt (domain, ts, backoff; ``tie`` orders those of one time), as it comes: as ``request_slots`` of a table.

    Order, silence and lateness as in ``backoff_stream``; a domain's silence begins at its last slot.
    """
    tie = F.col("tie").cast("long") if "tie" in attempts.columns else F.lit(0).cast("long")
    rows = attempts.withWatermark("ts", late).select(F.col("domain").cast("string").alias("domain"), "ts", F.col("backoff").cast("double").alias("backoff"), tie.alias("tie"))
    return stateful(rows, "domain", SlotFold(gap, expires), "domain string, ts timestamp, tie long, slot double, wait double", "Append")
