"""Status rollups, queues over a fixed domain, ready nodes of a dependency graph, logs with a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import Scratch, reachable


def rollup(rows: DataFrame, by: list[str], status: str, order: list[str], done: str, otherwise: str = "partial") -> DataFrame:
    """(by, status, n): the first status of ``order`` that any row has, ``done`` when all rows have it, else ``otherwise``."""
    any_ = [F.when(F.bool_or(F.col(status) == s), s) for s in order]
    all_ = F.when(F.bool_and(F.col(status) == done), done)
    return rows.groupBy(*by).agg(F.coalesce(*any_, all_, F.lit(otherwise)).alias("status"), F.count("*").alias("n"))


def zero_filled(rows: DataFrame, domain: DataFrame, status: str, by: list[str] | None = None) -> DataFrame:
    """Counts for every status of the fixed domain, and every group that occurs when ``by`` is given. The whole domain is one array that each group explodes."""
    by = by or []
    counts = rows.groupBy(*by, status).agg(F.count("*").alias("_n"))
    frame = domain.select(status).distinct()
    if by:
        whole = frame.agg(F.array_sort(F.collect_set(status))).first()[0]
        frame = rows.select(*by).distinct().withColumn(status, F.explode(F.lit(whole)))
    return frame.join(counts, [*by, status], "left").select(*by, status, F.coalesce("_n", F.lit(0).cast("bigint")).alias("n"))


def ready(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, verdict) of pending nodes: ready, blocked (a requirement failed or is blocked) or waiting.

    nodes: name, status; edges: child, parent, kind (requires or observes). What is required must be completed or skipped;
    what is observed must have ended.
    """
    state = edges.join(nodes.select(F.col("name").alias("parent"), F.col("status").alias("p")), "parent", "left")
    must, fine = F.col("kind") == "requires", F.col("p").isin("completed", "skipped")
    ended = F.col("p").isin("completed", "skipped", "failed", "blocked")
    judged = state.groupBy(F.col("child").alias("name")).agg(F.bool_and(F.when(must, fine).otherwise(ended)).alias("ok"), F.bool_or(must & F.col("p").isin("failed", "blocked")).alias("bad"))
    out = nodes.where("status = 'pending'").join(judged, "name", "left")
    return out.select("name", F.when(F.coalesce("bad", F.lit(False)), "blocked").when(F.coalesce("ok", F.lit(True)), "ready").otherwise("waiting").alias("verdict"))


def invalidated(spark: SparkSession, edges: DataFrame, changed: DataFrame, scratch: Scratch) -> DataFrame:
    """(node): changed nodes and all that depend on them."""
    return reachable(spark, edges, changed, scratch)


def capped_log(events: DataFrame, by: list[str], order: list[Column], limit: int = 300) -> DataFrame:
    """The last rows of each group; the rank filter runs before the shuffle too."""
    w = W.partitionBy(*by).orderBy(*order)
    return events.withColumn("age", F.row_number().over(w)).where(F.col("age") <= limit)


def hide_children(reports: DataFrame, ident: str, mark: str = "_map_") -> DataFrame:
    """Rows without those named after an existing parent."""
    child = reports.withColumn("_p", F.substring_index(ident, mark, 1)).where(F.col(ident).contains(mark))
    hidden = child.join(reports.select(F.col(ident).alias("_p")).distinct(), "_p", "left_semi").select(ident)
    return reports.join(hidden, ident, "left_anti")


def reusable(rows: DataFrame, cache: DataFrame, on: list[str]) -> DataFrame:
    """Column reuse: whether a cached result has the same fingerprint columns."""
    return rows.join(cache.select(*on, F.lit(True).alias("_hit")).dropDuplicates(on), on, "left").withColumn("reuse", F.coalesce("_hit", F.lit(False))).drop("_hit")
