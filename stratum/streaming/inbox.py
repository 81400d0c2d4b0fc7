"""An inbox whose files count once they have stopped changing, as a stream and in batch form, and upserts of stage state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def changes(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """A stream of Parquet change rows from a folder; ``files``: how many of its files a batch takes at most."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def fingerprint(files: DataFrame, path: str, size: str, mtime: str, by: list[str]) -> DataFrame:
    """(by, fingerprint): a hash of the sorted names, sizes and times of a folder; files still being uploaded (.part) don't count."""
    rows = files.where(~F.col(path).endswith(".part"))
    return rows.groupBy(*by).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(path, size, mtime)))), 256).alias("fingerprint"))


def settled_sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, end, n): bursts of changes that were followed by a pause of at least ``gap``. Works on streams with a watermark on ``ts``."""
    s = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions_by_gap(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """The same bursts by one window pass: a change at least ``seconds`` after the one before begins a burst."""
    w = W.partitionBy(key).orderBy(ts)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.withColumn("_new", F.coalesce((at - F.lag(at).over(w) >= seconds * 1_000_000).cast("int"), F.lit(1)))
    rows = rows.withColumn("burst", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(key, "burst").agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n"))


def upsert(spark: SparkSession, batch: DataFrame, path: str, key: list[str], version: str) -> None:
    """Keeps the newest row of each key in a Parquet table of versions: path/v=<n>, the highest complete one being current."""
    cur = latest(spark, path)
    rows = batch if cur is None else cur[0].unionByName(batch)
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), version).alias("x")).select("x.*")
    newest.write.mode("overwrite").parquet(f"{path}/v={0 if cur is None else cur[1] + 1:08d}")


def latest(spark: SparkSession, path: str) -> tuple[DataFrame, int] | None:
    """The current version of a table kept by ``upsert`` and its number."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    done = [f.getPath().getName() for f in fs.listStatus(where) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    if not done:
        return None
    name = max(done)
    return spark.read.parquet(f"{path}/{name}"), int(name.removeprefix("v="))


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes what is there, batch by batch, and stops; one writer at a time."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()


def run_pages(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Writes what ``work`` makes of each batch to path/batch=<n> before the next one begins, so a run that was stopped goes on from there.

    A batch that is done again replaces its own rows. With ``changes(..., files=1)`` a batch is one page's file.
    """
    run_available(stream, lambda rows, n: work(rows).write.mode("overwrite").parquet(f"{path}/batch={n}"), checkpoint)
