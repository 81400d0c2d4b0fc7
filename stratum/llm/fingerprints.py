"""Document fingerprints: 128-bit SimHash of weighted term hashes, and search by permuted block tables. DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: Two counters of 32 bits in one sum: bit i and bit i + 32 of a hash.
PAIR = 0x0000000100000001
#: Ids per bucket, buckets per group, and groups that one window may order, when each document is given the next one.
IDS, GROUP, FEW = 512, 4096, 100_000
#: Rows of a bucket beyond which it is split, and bits of the text's hash that split the rows of one id.
MANY, SPLIT = 4096, 12
NO_ID = -(1 << 54)
#: Rows of three integers that may be broadcast.
MAX_BROADCAST = 200_000


def terms(text: Column) -> Column:
    """Lower-case words of the whole text."""
    return F.split(F.lower(text), "[\\x20\\x09-\\x0D]+")


def weight(term: Column) -> Column:
    """Long words are rare words: the weight is the length in bytes, 12 at most. A text's weights never sum to more than its bytes, so 32 bits hold them."""
    return F.least(F.octet_length(term), F.lit(12)).cast("long")


def hashes(term: Column) -> list[Column]:
    return [F.xxhash64(term), F.xxhash64(term, F.lit(7))]


def fingerprint(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, hi, lo): each row's 128 bits, where signed votes of its weighted term hashes are positive. ``keys`` must tell rows apart.

    Null and empty texts have fingerprint zero. Terms are exploded and summed in one stage when ``df`` is already dealt by one of the keys.
    """
    word = df.select(*keys, F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    word = word.select(*keys, weight(F.col("term")).alias("w"), *(h.alias(f"h{i}") for i, h in enumerate(hashes(F.col("term")))))
    sums = [F.sum(F.col("w") * F.shiftrightunsigned(f"h{k}", i).bitwiseAND(F.lit(PAIR))).alias(f"s{k}_{i}") for k in range(2) for i in range(32)]
    voted = word.groupBy(*keys).agg(F.sum("w").alias("total"), *sums)

    def bits(k: int) -> Column:
        low = [F.when(2 * F.col(f"s{k}_{i}").bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("total"), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(32)]
        high = [F.when(2 * F.shiftrightunsigned(f"s{k}_{i}", 32) > F.col("total"), F.lit((1 << i + 32) - (1 << 64) * (i == 31))).otherwise(F.lit(0)) for i in range(32)]
        out = low[0]
        for x in [*low[1:], *high]:
            out = out + x.cast("long")
        return out.cast("long")

    return voted.select(*keys, bits(0).alias("hi"), bits(1).alias("lo"))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def hex128(hi: str, lo: str) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(c)), 16, "0") for c in (hi, lo)))


def following(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, next): each of the distinct ``bucket`` numbers with the next larger one; the largest with the smallest.

    Numbers are compared within groups of GROUP; the first numbers of the groups are found their next ones in the same way,
    until so few groups are left that one small window orders them. 64-bit numbers end after five levels.
    """
    near = buckets.withColumn("g", F.expr(f"bucket div {GROUP}"))
    near = scratch.table(near.withColumn("near", F.lead("bucket").over(W.partitionBy("g").orderBy("bucket"))))
    firsts = scratch.table(near.groupBy("g").agg(F.min("bucket").alias("first")))
    if firsts.count() > FEW:
        after = following(firsts.select(F.col("g").alias("bucket")), scratch).select(F.col("bucket").alias("g"), F.col("next").alias("_g"))
    else:
        whole = W.orderBy("g")
        after = firsts.select("g", F.coalesce(F.lead("g").over(whole), F.min("g").over(whole)).alias("_g"))
    after = after.join(firsts.select(F.col("g").alias("_g"), "first"), "_g").select("g", F.col("first").alias("far"))
    return near.join(after, "g").select("bucket", F.coalesce("near", "far").alias("next"))


def with_next(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(bucket, sub, rn, guest, key, text, next_text): each row with the text of the next row by key, the last with the first.

    Rows of one key stand in the order of their text's hash. Rows are dealt into buckets of IDS ids; a bucket of more than
    MANY rows, as many rows of one id or without one make it, is split by id and by hash, which keeps the order. A bucket also
    gets the first row of the next one as a guest, and keeps it so that later windows over the bucket see it too.
    """
    order = F.shiftrightunsigned("h", 64 - SPLIT)
    rows = docs.select(F.coalesce(F.expr(f"`{key}` div {IDS}"), F.lit(NO_ID)).alias("bucket"), key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    many = scratch.table(docs.groupBy(F.coalesce(F.expr(f"`{key}` div {IDS}"), F.lit(NO_ID)).alias("bucket")).agg(F.count("*").alias("n")).where(f"n > {MANY}").select("bucket"))
    n = many.count()
    if n:
        fine = ((F.coalesce(F.col(key) - F.col("bucket") * IDS, F.lit(0)) + IDS) * (1 << SPLIT) + order).cast("long")
        split = many.withColumn("_many", F.lit(True))
        rows = rows.join(F.broadcast(split) if n <= MAX_BROADCAST else split, "bucket", "left").withColumn("sub", F.when(F.col("_many"), fine).otherwise(0)).drop("_many")
    else:
        rows = rows.withColumn("sub", F.lit(0).cast("long"))
    # without a split the first row of a bucket is the one of its smallest id, which needs no text
    first = F.min(F.struct(key, order.alias("o"), "h")) if n else F.min(F.struct(key))
    heads = scratch.table(rows.groupBy("bucket", "sub").agg(first.alias("head")))
    chain = heads.select(F.col("bucket").alias("host"), F.col("sub").alias("hostsub"), F.lead("sub").over(W.partitionBy("bucket").orderBy("sub")).alias("s"))
    tops = heads.groupBy("bucket").agg(F.min("sub").alias("top"))
    after = following(tops.select("bucket"), scratch).select(F.col("bucket").alias("host"), F.col("next").alias("bucket")).join(tops, "bucket")
    order_ = chain.join(after, "host").select("host", "hostsub", F.when(F.col("s").isNotNull(), F.col("host")).otherwise(F.col("bucket")).alias("bucket"), F.coalesce("s", "top").alias("sub"))
    firsts = scratch.table(order_.join(heads, ["bucket", "sub"]))
    if firsts.count() <= MAX_BROADCAST:  # beyond, both sides of the join are shuffled
        firsts = F.broadcast(firsts)
    met = rows.join(firsts, ["bucket", "sub"]).where(F.col(key).eqNullSafe(F.col(f"head.{key}")))
    if n:
        met = met.where(F.col("h") == F.col("head.h"))
    one = F.min(F.struct(order.alias("o"), "h", key, "text"))
    guests = met.groupBy("host", "hostsub").agg(one.alias("x")).select(F.col("host").alias("bucket"), F.col("hostsub").alias("sub"), f"x.{key}", "x.text", "x.h", F.lit(1).alias("guest"))
    both = rows.withColumn("guest", F.lit(0)).unionByName(guests)
    w = W.partitionBy("bucket", "sub").orderBy("guest", key, order, "h", "text")
    return both.select("*", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("next_text"))


def edited(text: str = "text", other: str = "next_text") -> Column:
    """The text whose last half is replaced by as many code points of the other text's start."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), n - half), F.substring(F.col(other), F.lit(1), half))


def document_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """(key, n_chars, edited_sha256, hi, lo, ehi, elo, nhi, nlo) for every row: its fingerprint, its edited text's and the next row's.

    Null texts count as empty (fingerprint zero), null keys come first, rows with equal keys follow each other by their text's
    hash, a single row is its own next one. Keys are integers. Other columns are left out; an empty table gives an empty one.
    Rows that agree in key and text are ordered in one task.
    """
    scratch = scratch or Scratch(docs.sparkSession, "fingerprints")
    rows = with_next(docs, scratch, text, key)
    rows = rows.select("bucket", "sub", "rn", "guest", key, F.char_length("text").cast("long").alias("n_chars"), "text", F.when(F.col("guest") == 0, edited()).alias("edited"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    keys = ["bucket", "sub", "rn", "guest", key, "n_chars", "sha", "which"]
    pair = F.posexplode(F.array("text", "edited")).alias("which", "s")
    prints = fingerprint(rows.select("bucket", "sub", "rn", "guest", key, "n_chars", "sha", pair), keys, "s")
    pick = lambda c, i: F.max(F.when(F.col("which") == i, F.col(c)))
    one = prints.groupBy(*keys[:-1]).agg(pick("hi", 0).alias("hi"), pick("lo", 0).alias("lo"), pick("hi", 1).alias("ehi"), pick("lo", 1).alias("elo"))
    w = W.partitionBy("bucket", "sub").orderBy("rn")
    one = one.select("*", F.lead("hi").over(w).alias("nhi"), F.lead("lo").over(w).alias("nlo"))
    return scratch.table(one.where("guest = 0").select(key, "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "hi", "lo", "ehi", "elo", "nhi", "nlo"))


def block_keys(radius: int, lead: int = 1) -> list[tuple[int, int]]:
    """Masks (hi, lo) of the permuted block tables: radius + lead blocks, of which each table puts ``lead`` in front.

    Any two fingerprints within the radius agree on some ``lead`` of the blocks.
    """
    n = radius + lead
    edges = [128 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [(m >> 64, m & (1 << 64) - 1) for m in (sum(c) for c in combinations(blocks, lead))]


def search(prints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """(hi, lo, ohi, olo, n): all fingerprints of ``prints`` within ``radius`` bits of each of ``queries``, with the number of rows they stand for.

    Both sides are collapsed to distinct fingerprints first. A pair is reported by the first table in which it agrees, so
    nothing is deduplicated afterwards; a hot key is split by AQE as any skewed equi-join.
    """
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    tables = block_keys(radius)
    keys = lambda p: F.posexplode(F.array(*[F.xxhash64(F.lit(t), F.col(f"{p}hi").bitwiseAND(F.lit(signed(a))), F.col(f"{p}lo").bitwiseAND(F.lit(signed(b)))) for t, (a, b) in enumerate(tables)]))
    left = queries.select("hi", "lo").distinct().select("hi", "lo", keys("").alias("t", "k"))
    right = prints.groupBy(F.col("hi").alias("ohi"), F.col("lo").alias("olo")).agg(F.count("*").alias("n")).select("ohi", "olo", "n", keys("o").alias("u", "k"))
    agree = [(F.col("hi").bitwiseXOR(F.col("ohi")).bitwiseAND(F.lit(signed(a))) == 0) & (F.col("lo").bitwiseXOR(F.col("olo")).bitwiseAND(F.lit(signed(b))) == 0) for a, b in tables]
    first = F.lit(len(tables))
    for t, ok in reversed([*enumerate(agree)]):
        first = F.when(ok, F.lit(t)).otherwise(first)
    met = left.join(right, "k").where((F.col("t") == F.col("u")) & (F.col("t") == first))
    return met.where(distance((F.col("hi"), F.col("lo")), (F.col("ohi"), F.col("olo"))) <= radius).select("hi", "lo", "ohi", "olo", "n")


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    """n_near: for ids divisible by 100, how many other documents have a fingerprint within 3 bits; null for the rest."""
    prints = document_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    asked = F.col("doc_id") % 100 == 0
    found = search(prints, prints.where(asked)).groupBy("hi", "lo").agg((F.sum("n") - 1).alias("n_near"))
    rows = prints.where(asked).join(found, ["hi", "lo"], "left").unionByName(prints.where(~F.coalesce(asked, F.lit(False))).withColumn("n_near", F.lit(None).cast("long")))
    near = lambda a, b: 1 - distance((F.col("hi"), F.col("lo")), (F.col(a), F.col(b))) / F.lit(128.0)
    return rows.select("doc_id", "n_chars", "edited_sha256", hex128("hi", "lo").alias("fingerprint"), hex128("ehi", "elo").alias("edited_fingerprint"), near("ehi", "elo").alias("near_edited"), near("nhi", "nlo").alias("near_next"), "n_near")
