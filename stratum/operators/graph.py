"""Tables in the shared folder, connected components and reachability."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where it is unset, a local session (tests) gets a temporary one; a cluster is refused."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stratum-"))
        found = sc.getCheckpointDir()
    return found


class Scratch:
    """Tables written below the shared folder; reading them back cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, **options: str) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.base}/t{self.n}"
        df.write.parquet(path, **options)
        return self.spark.read.schema(df.schema).parquet(path), path

    def table(self, df: DataFrame, **options: str) -> DataFrame:
        return self.write(df, **options)[0]

    def drop(self, path: str) -> None:
        """Removes a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame, scratch: Scratch, src: str = "a", dst: str = "b") -> DataFrame:
    """Connected components of an undirected edge list by alternating large-star and small-star rounds.

    Returns (node, root) for every node of ``edges``, root being the smallest node that it reaches. Each round keeps at most
    as many edges as it got and the number of rounds grows with the logarithm of the longest path. Minima are aggregated
    before they are shuffled. The join back on a hub's key brings its edges, two integers each, into one task, which sorts
    and spills as any; a hub's rows are never gathered into one value. Self loops, repeated edges and null ends are ignored.
    """
    cur = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    cur, path = scratch.write(cur)
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        nxt, nxt_path = scratch.write(out.where("u <> v").distinct())
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(path)
        cur, path = nxt, nxt_path
        if mark == seen:
            break
        seen = mark
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def reachable(spark: SparkSession, edges: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """(node) all nodes downstream of ``seeds`` (node), themselves included, along ``edges`` (child, parent).

    Each round joins the frontier alone, so the work is one pass over each edge that is reached; cycles end by themselves.
    """
    seen = front = scratch.table(seeds.select("node").distinct())
    while True:
        new = front.join(edges, front.node == edges.parent).select(F.col("child").alias("node")).distinct()
        front = scratch.table(new.join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def list_ranks(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, list, seq, n, closed): the place of every node of linked lists (node, next), next being null at the end of a list.

    Each node has one row and is the next of one node at most. A list is named by its first node, a closed one by its smallest, where it is
    cut; n counts its nodes. Pointers jump to twice the distance in each round and carry the smallest node that they passed: two windows that
    follow each other hold the same smallest node only where they overlap, on a ring. So the rounds grow with the logarithm of the
    longest list. Nodes are compared by their own order; a next without a row of its own ends its list too.
    """
    known = links.select(F.col("node").alias("_k"))
    own = links.join(known, F.col("next") == F.col("_k"), "left").select("node", F.col("_k").alias("to"))
    heads = own.select("node").join(own.where("to is not null").select(F.col("to").alias("node")), "node", "left_anti")

    def jump(rows: DataFrame) -> DataFrame:
        """rows (node, to) as (node, to, d, low, last): to is null and last is the end for all nodes of open lists; low is the smallest node of closed ones."""
        state, path = scratch.write(rows.select("node", "to", F.when(F.col("to").isNull(), 0).otherwise(1).cast("bigint").alias("d"), F.col("node").alias("low"), F.when(F.col("to").isNull(), F.col("node")).alias("last"), F.lit(False).alias("same")))
        while state.where("to is not null and not same").limit(1).count():
            ahead = state.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("low").alias("low2"), F.col("last").alias("last2"))
            moved = state.where("to is not null").join(ahead, "to").select("node", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"), F.least("low", "low2").alias("low"), F.col("last2").alias("last"), (F.col("low") == F.col("low2")).alias("same"))
            nxt, nxt_path = scratch.write(state.where("to is null").unionByName(moved))
            scratch.drop(path)
            state, path = nxt, nxt_path
        return state

    def placed(state: DataFrame, starts: DataFrame, closed: bool) -> DataFrame:
        first = state.join(starts, "node", "left_semi").select(F.col("node").alias("list"), "last", (F.col("d") + 1).alias("n"))
        return state.join(first, "last").select("node", "list", (F.col("n") - 1 - F.col("d")).alias("seq"), "n", F.lit(closed).alias("closed"))

    state = jump(own)
    out = placed(state.where("to is null"), heads, False)
    rings = state.where("to is not null").select("node", "low")
    if rings.isEmpty():
        return out
    cut = own.join(rings, "node").select("node", F.when(F.col("to") != F.col("low"), F.col("to")).alias("to"))
    starts = rings.select(F.col("low").alias("node")).distinct()
    return out.unionByName(placed(jump(cut), starts, True))
