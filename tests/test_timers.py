"""Timers over keyed state: results don't depend on batches, and state survives restarts."""

import datetime as dt
import tempfile

import pytest
from stratum.streaming import inbox, timers

DAY = dt.datetime(2024, 1, 1)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def run(spark, batches, make, schema):
    """Each batch is a run of its own on the same checkpoint, so the stream is stopped and started between them."""
    timers.use_rocksdb(spark)
    base, out = tempfile.mkdtemp(), []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = make(inbox.changes(spark, f"{base}/in", schema))
        inbox.run_available(stream, lambda df, n: df.write.mode("append").parquet(f"{base}/out"), f"{base}/checkpoint")
    return sorted(tuple(r) for r in spark.read.parquet(f"{base}/out").collect())


ROWS = [("a", "x", 0), ("a", "y", 10), ("a", "y", 30), ("a", "z", 45), ("b", "x", 5), ("a", "y", 50), ("b", "w", 60), ("b", "x", 65), ("a", "y", 100), ("c", "q", 101), ("b", "x", 200), ("d", "last", 230)]
#: y stays from 10 to 45 and is reported; z goes after five minutes; y comes back but was reported; b's first x stays, its second was reported
WANT = [("a", "y", at(10), at(40)), ("b", "x", at(5), at(35)), ("c", "q", at(101), at(131))]


@pytest.mark.parametrize("cuts", [[12], [1, 4, 7, 12]])
def test_settled(spark, cuts):
    rows = [(k, f, at(m)) for k, f, m in sorted(ROWS, key=lambda r: r[2])]
    batches = [rows[a:b] for a, b in zip([0, *cuts], cuts)]
    assert run(spark, batches, lambda s: timers.settled(s, 1800), "key string, fingerprint string, ts timestamp") == WANT


def test_locks(spark):
    rows = [("r", "a", "acquire", 0), ("r", "b", "acquire", 10), ("r", "b", "release", 11), ("r", "a", "release", 20), ("r", "b", "acquire", 30), ("s", "x", "acquire", 40), ("r", "c", "acquire", 30 + 361), ("s", "y", "acquire", 40 + 359), ("t", "z", "acquire", 2000)]
    rows = [(k, o, a, at(m)) for k, o, a, m in sorted(rows, key=lambda r: r[3])]
    want = [("r", "a", "acquired", at(0)), ("r", "a", "released", at(20)), ("r", "b", "acquired", at(30)), ("r", "b", "busy", at(10)), ("r", "b", "ignored", at(11)), ("r", "b", "stale", at(390)), ("r", "c", "acquired", at(391)), ("r", "c", "stale", at(751)), ("s", "x", "acquired", at(40)), ("s", "x", "stale", at(400)), ("s", "y", "busy", at(399)), ("t", "z", "acquired", at(2000))]
    schema = "key string, owner string, action string, ts timestamp"
    for cuts in ([9], [2, 5, 9]):
        assert run(spark, [rows[a:b] for a, b in zip([0, *cuts], cuts)], timers.locks, schema) == want


def test_settled_by_the_clock(spark):
    """Processing-time timers: a fingerprint is reported by a timer alone, after a second without rows."""
    import time

    timers.use_rocksdb(spark)
    base = tempfile.mkdtemp()
    schema = "key string, fingerprint string, ts timestamp"
    spark.createDataFrame([("a", "x", DAY), ("b", "y", DAY)], schema).write.parquet(f"{base}/in")
    stream = timers.settled(inbox.changes(spark, f"{base}/in", schema), 1.0, "ProcessingTime")
    q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/c").format("memory").queryName("by_clock").trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("by_clock").count() < 2:
            time.sleep(0.5)
        assert {(r.key, r.fingerprint) for r in spark.table("by_clock").collect()} == {("a", "x"), ("b", "y")}
    finally:
        q.stop()
