"""Keyed state with timers: folders that count once they stopped changing, and locks that go stale.

Time is a column of the stream and timers follow its watermark, so runs repeat exactly; with ``mode="ProcessingTime"`` timers follow the
clock. State lives in the stream's checkpoint and survives a restart. The session must set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTLED = "key string, fingerprint string, since timestamp, settled timestamp"
LOCKED = "key string, owner string, event string, at timestamp"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One key's rows of a batch by time and tie."""
    return pd.concat(list(rows)).sort_values(["ts", "tie"], kind="stable")


#: Milliseconds of a row without a time, which comes last.
NO_TIME = -(1 << 63) // 1_000_000


def _by_time(rows: Iterator[pd.DataFrame]) -> list[tuple]:
    """(ms, tie, fingerprint) of one key's rows of a batch by time and tie, as plain values: a frame for each key takes longer than its rows."""
    found = [r for part in rows for r in zip(part["ms"].tolist(), part["tie"].tolist(), part["fingerprint"].tolist())]
    missing = lambda x: x is None or x != x
    return sorted(found, key=lambda r: (r[0] == NO_TIME, r[0], missing(r[1]), 0 if missing(r[1]) else r[1]))


def _time(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class _Settling(StatefulProcessor):
    """State: the fingerprint seen last, since when, the one that was reported last, and the timer that is set."""

    def __init__(self, settle_ms: int, clock: bool) -> None:
        self.settle, self.clock = settle_ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "fingerprint string, since long, reported string, timer long")

    def _report(self, key: str, seen: list) -> list[tuple]:
        if seen[0] == seen[2]:
            return []
        seen[2] = seen[0]
        return [(key, seen[0], seen[1])]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, out = list(self.state.get() or (None, 0, None, -1)), []
        before = seen[3]
        for ms, _, fingerprint in _by_time(rows):
            at = timerValues.getCurrentProcessingTimeInMs() if self.clock else ms
            if seen[3] >= 0 and at >= seen[1] + self.settle:  # settled before this row came
                out += self._report(key[0], seen)
                seen[3] = -1
            if fingerprint != seen[0]:
                seen[0], seen[1], seen[3] = fingerprint, at, at + self.settle
        if before != seen[3]:
            if before >= 0:
                self.handle.deleteTimer(before)
            if seen[3] >= 0:
                self.handle.registerTimer(seen[3])
        self.state.update(tuple(seen))
        if out:
            yield pd.DataFrame(out, columns=["key", "fingerprint", "since"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = list(self.state.get())
        out, seen[3] = self._report(key[0], seen), -1
        self.state.update(tuple(seen))
        if out:
            yield pd.DataFrame(out, columns=["key", "fingerprint", "since"])

    def close(self) -> None:
        pass


class _Locks(StatefulProcessor):
    """State: owner, since when, and the timer that frees the lock."""

    def __init__(self, stale_ms: int, clock: bool) -> None:
        self.stale, self.clock = stale_ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "owner string, since long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.state.get() or (None, 0, -1))
        out, before = [], held[2]
        for ts, owner, action in _in_order(rows)[["ts", "owner", "action"]].itertuples(index=False):
            at = timerValues.getCurrentProcessingTimeInMs() if self.clock else ts.value // 1_000_000
            if held[0] is not None and at > held[1] + self.stale:
                out.append((key[0], held[0], "stale", _time(held[1] + self.stale)))
                held = [None, 0, -1]
            if action == "release":
                mine = held[0] == owner
                out.append((key[0], owner, "released" if mine else "ignored", _time(at)))
                held = [None, 0, -1] if mine else held
            elif held[0] is None:
                held = [owner, at, at + self.stale + 1]
                out.append((key[0], owner, "acquired", _time(at)))
            else:
                out.append((key[0], owner, "busy", _time(at)))
        if before != held[2]:
            if before >= 0:
                self.handle.deleteTimer(before)
            if held[2] >= 0:
                self.handle.registerTimer(held[2])
        self.state.update(tuple(held))
        yield pd.DataFrame(out, columns=["key", "owner", "event", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        self.state.update((None, 0, -1))
        yield pd.DataFrame([(key[0], held[0], "stale", _time(held[1] + self.stale))], columns=["key", "owner", "event", "at"])

    def close(self) -> None:
        pass


def _run(rows: DataFrame, processor: StatefulProcessor, schema: str, mode: str, late: str) -> DataFrame:
    rows = rows.withColumn("tie", F.col("tie") if "tie" in rows.columns else F.lit(0))
    rows = rows.withWatermark("ts", late) if mode == "EventTime" else rows
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode)


def settled(observations: DataFrame, seconds: float, mode: str = "EventTime", late: str = "0 seconds") -> DataFrame:
    """Stream (key, fingerprint, since, settled): fingerprints that stayed for ``seconds`` and differ from the one reported before.

    observations: a stream (key string, fingerprint string, ts timestamp, and tie to order equal times). A timer reports a key that gets no more
    rows once the watermark passes; a row that comes later reports what had settled before it, so the rows don't depend on how the
    stream is cut into batches. A key's rows must come in the order of batches; later ones than ``late`` are dropped by the watermark.
    """
    settle = int(seconds * 1000)
    rows = observations.withColumn("ms", F.coalesce(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(NO_TIME)))
    found = _run(rows, _Settling(settle, mode != "EventTime"), "key string, fingerprint string, since long", mode, late)
    return found.select("key", "fingerprint", F.timestamp_millis("since").alias("since"), F.timestamp_millis(F.col("since") + settle).alias("settled"))


def locks(requests: DataFrame, hours: float = 6.0, mode: str = "EventTime", late: str = "0 seconds") -> DataFrame:
    """Stream (key, owner, event, at) of lock requests (key, owner, action acquire or release, ts, and tie): acquired, busy, released, ignored or stale.

    One owner holds a key. A lock older than ``hours`` is freed by its timer or by the next request, whichever comes first. A release by another than the holder
    is ignored.
    """
    return _run(requests, _Locks(int(hours * 3_600_000), mode != "EventTime"), LOCKED, mode, late)
