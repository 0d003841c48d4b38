"""Streaming forms of the usage reports: daily roll-up and rate limit."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.usage import COST, tokens
from ..sources.usage_log import parse_usage_lines


def stream_usage_log(spark: SparkSession, path: str, *, max_files: int = 100) -> DataFrame:
    """The JSON log as a stream of records; broken lines are skipped as in batch."""
    return parse_usage_lines(spark.readStream.option("maxFilesPerTrigger", max_files).text(path))


def stream_usage_daily(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """Measures of `usage_daily` per tenant and day, for update mode.

    Without a watermark every record counts, whatever the order of the files; the
    state has one row per tenant and day. A watermark lets old days leave the state
    of an endless stream; records that come later than it are then left out, and
    the drains of this package refuse to lose any.
    """
    timed = stream.withColumn("_at", F.to_timestamp("timestamp"))
    if watermark is not None:
        timed = timed.withWatermark("_at", watermark)
    return (
        timed.groupBy("tenant_id", F.window("_at", "1 day").alias("w"))
        .agg(
            F.count("*").alias("total_calls"),
            F.count_if(F.col("status") == "success").alias("success_calls"),
            F.count_if(~F.col("status").eqNullSafe("success")).alias("error_calls"),
            F.sum(tokens()).alias("total_tokens"),
            F.round(F.sum(F.col("cost_usd").cast(COST)), 4).cast("double").alias("total_cost_usd"),
        )
        .select("tenant_id", F.date_format("w.start", "yyyy-MM-dd").alias("date"), "total_calls", "success_calls",
                "error_calls", "total_tokens", "total_cost_usd")
    )


#: Waiting attempts kept as one value of the state, and verdicts given at a time.
STORED_TOGETHER, GIVEN_TOGETHER = 1_024, 100_000


class _RateGate(StatefulProcessor):
    """Per key: times of admitted attempts within the window, `burst` at most, and attempts that the watermark has not passed.

    An attempt is decided when the watermark passes it, for then no earlier one can
    come any more. The waiting attempts of a micro-batch are kept in order of time, in
    runs of bounded length, with an index of (first time, number) per run. So each is
    written and read once; of a micro-batch, only the run that the watermark cuts is
    written again.
    """

    def __init__(self, burst: int, span: int):
        self.burst, self.span = burst, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "us array<bigint>")
        self.index = handle.getValueState("index", "runs binary")
        self.waiting = handle.getMapState("waiting", "first bigint, number bigint", "us binary")

    def _indexed(self) -> np.ndarray:
        return np.frombuffer(self.index.get()[0] if self.index.exists() else b"", dtype=np.int64).reshape(-1, 2)

    def _keep(self, index: np.ndarray, us: np.ndarray) -> np.ndarray:
        """Store sorted times as runs; the index with them."""
        number = int(index[:, 1].max()) + 1 if len(index) else 0
        added = []
        for i in range(0, len(us), STORED_TOGETHER):
            run = us[i : i + STORED_TOGETHER]
            added.append((int(run[0]), number + len(added)))
            self.waiting.updateValue(added[-1], (run.tobytes(),))
        return np.concatenate([index, np.array(added, dtype=np.int64).reshape(-1, 2)])

    def _wait(self, index: np.ndarray) -> None:
        self.index.update((index.tobytes(),))
        if len(index):
            self.handle.registerTimer(-(-int(index[:, 0].min()) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        us = [part["us"].to_numpy(dtype=np.int64) for part in rows]
        if sum(map(len, us)):
            self._wait(self._keep(self._indexed(), np.sort(np.concatenate(us))))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        index = self._indexed()
        reached = index[:, 0] <= passed
        if not reached.any():
            return
        due, left = [], index[~reached]
        for first, number in index[reached].tolist():
            run = np.frombuffer(self.waiting.getValue((first, number))[0], dtype=np.int64)
            self.waiting.removeKey((first, number))
            cut = int(np.searchsorted(run, passed, side="right"))
            due.append(run[:cut])
            left = self._keep(left, run[cut:])
        self._wait(left)
        kept = deque(self.kept.get()[0] if self.kept.exists() else [])
        due = np.sort(np.concatenate(due))
        for i in range(0, len(due), GIVEN_TOGETHER):
            us = due[i : i + GIVEN_TOGETHER]
            admitted = _gate(us.tolist(), self.burst, self.span, kept)
            yield pd.DataFrame({"key": pd.Series([key[0]] * len(us), dtype=object), "us": us, "admitted": admitted})
        self.kept.update((list(kept),))


def stream_rate_limit(stream: DataFrame, burst: int = 10, window_seconds: float = 1.0, *, key: str = "tenant_id",
                      time: str = "timestamp", watermark: str | None = None) -> DataFrame:
    """Admit or refuse every attempt; refused attempts do not use up the window.

    With a watermark the stream is for append mode: each attempt is decided once,
    when the watermark has passed it, and the state of a key holds `burst` times and
    the attempts younger than the watermark. Attempts that come later than it are
    left out by Spark, and the drains of this package then fail. Such a query keeps
    its state in RocksDB, which is set for the session.

    Without a watermark the stream is for complete mode over a finite log whose files
    may come in any order: each micro-batch gives all verdicts on what has come so
    far. There a pause of a whole window empties the gate, so a key's time line falls
    into runs that are decided on their own, as session windows.
    """
    span = round(window_seconds * 1_000_000)
    timed = stream.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("_at"))
    if watermark is not None:
        stream.sparkSession.conf.set(
            "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        decided = timed.withWatermark("_at", watermark).filter("_at IS NOT NULL").select(
            F.coalesce("key", F.lit("")).alias("key"), F.col("_at").alias("at"), F.unix_micros("_at").alias("us"))
        verdicts = decided.groupBy("key").transformWithStateInPandas(
            _RateGate(burst, span), outputStructType="key string, us long, admitted boolean", outputMode="Append", timeMode="EventTime")
        return verdicts.select(F.nullif(F.col("key"), F.lit("")).alias(key), F.timestamp_micros("us").alias("at"), "admitted")

    @F.pandas_udf("array<boolean>")
    def decided_run(runs: pd.Series) -> pd.Series:
        return runs.map(lambda times: _gate(times, burst, span, deque()))

    runs = timed.groupBy("key", F.session_window("_at", f"{span} microseconds")).agg(
        F.array_sort(F.collect_list(F.unix_micros("_at"))).alias("us"))
    verdicts = runs.select("key", F.explode(F.arrays_zip("us", decided_run("us").alias("admitted"))).alias("v"))
    return verdicts.select(F.col("key").alias(key), F.timestamp_micros("v.us").alias("at"), F.col("v.admitted").alias("admitted"))


def _gate(times: Sequence[int], burst: int, span: int, kept: deque[int]) -> list[bool]:
    """Verdicts on sorted times: admitted while fewer than `burst` of `kept`, the admitted ones, were in the window before."""
    out = []
    for now in times:
        while kept and now - kept[0] >= span:
            kept.popleft()
        out.append(len(kept) < burst)
        if out[-1]:
            kept.append(now)
    return out
