"""Request rate and failures of a call log, as a stream or a batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dialoom.functions.ordered import longest_runs

RATE_LIMIT = 50      # calls per minute


def request_rate(calls: DataFrame, limit: int = RATE_LIMIT, length: str = "1 minute", slide: str = "10 seconds",
                 watermark: str | None = None) -> DataFrame:
    """(window_start, window_end, calls, failures, over_limit) of a call log (ts, ok).

    With ``watermark`` on a stream, late calls are dropped and a window is emitted once it is over.
    """
    rows = calls.withWatermark("ts", watermark) if watermark else calls
    counts = rows.groupBy(F.window("ts", length, slide)).agg(
        F.count("*").alias("calls"), F.sum((~F.col("ok")).cast("bigint")).alias("failures"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                         "calls", "failures", (F.col("calls") > limit).alias("over_limit"))


def failure_streaks(calls: DataFrame, key: Column, order: Column, limit: int = 5) -> DataFrame:
    """(key, longest, pause): the longest row of failures per key, and whether it reaches ``limit``."""
    state = F.when(F.col("ok"), "ok").otherwise("failed")
    runs = longest_runs(calls, key, order, state, only="failed")
    return runs.withColumn("pause", F.col("longest") >= limit)


class _Streak(StatefulProcessor):
    """The running row of failures of one key. Calls wait until the watermark has passed them, so they count in the order of their time."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at BIGINT, place BIGINT, ok BOOLEAN")
        self.counts = handle.getValueState("counts", "run BIGINT, longest BIGINT, pauses BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        fresh = [tuple(r) for pdf in rows for r in pdf[["at", "place", "ok"]].itertuples(index=False)]
        self.waiting.appendList([(int(a), int(p), bool(k)) for a, p, k in fresh])
        self.handle.registerTimer(min(int(r[0]) for r in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        over = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] <= over], [r for r in rows if r[0] > over]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0])
        else:
            self.waiting.clear()
        run, longest, pauses = self.counts.get() if self.counts.exists() else (0, 0, 0)
        for _, _, ok in due:
            run = 0 if ok else run + 1
            longest = max(longest, run)
            pauses += run == self.limit
        if due:
            self.counts.update((run, longest, pauses))
            yield pd.DataFrame({"key": [str(key[0])], "until": [due[-1][0]], "run": [run], "longest": [longest], "pauses": [pauses], "pause": [run >= self.limit]})

    def close(self) -> None:
        pass


def failure_pauses(calls: DataFrame, key: str, place: str, limit: int = 5, watermark: str = "5 minutes") -> DataFrame:
    """A stream of (key, until, run, longest, pauses, pause): one row for a key whenever the watermark has passed more of its calls (ts, ok).

    ``until`` (milliseconds) is the time of its last call that counts; calls of one time count in the order of the integer ``place``. run is the row of failures that
    ends there, longest the longest one so far, pauses how often one has reached ``limit``; pause says that calls should rest now. A call later than the watermark is
    dropped, calls that the watermark has not passed are not counted yet. State is kept by key in RocksDB: set
    ``spark.sql.streaming.stateStore.providerClass`` to its provider before the query starts. The calls of one key are one sequence, so a key is one task's work; it
    holds the calls of one watermark delay.
    """
    rows = calls.select(F.col(key).cast("string").alias("key"), "ts", F.unix_millis("ts").alias("at"), F.col(place).cast("bigint").alias("place"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return rows.withWatermark("ts", watermark).groupBy("key").transformWithStateInPandas(
        _Streak(limit), "key STRING, until BIGINT, run BIGINT, longest BIGINT, pauses BIGINT, pause BOOLEAN", "append", "eventTime")
