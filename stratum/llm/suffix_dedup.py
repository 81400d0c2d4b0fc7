"""Removal of long byte strings that occur more than once, by aligned suffix orders and common prefixes.

A suffix array of a whole corpus can't be spread over executors, so it is built in aligned blocks that hold all that matters:

1. Each text's anchors are the leftmost smallest k-gram hashes of all windows of ``length`` bytes. Equal windows have equal
   anchors at equal offsets, so they meet in the group of that anchor. Only anchors that occur twice go on.
2. A group's windows are laid under each other with their anchors in one column. From the last column to the first, a
   stable sort by one byte turns the suffix order of column c + 1 into that of column c, together with the common prefixes
   of neighbours: the suffix arrays and LCP arrays of all columns at once.
3. In a column's suffix order, neighbours that share ``length`` bytes form runs of equal windows. The longest previous factor
   of a suffix is its common prefix with the previous or the next suffix of smaller rank (rank: order of the texts and their
   positions), so it reaches ``length`` just where the run holds a smaller rank: for all of a run but its minimum. Run minima
   decide this in one pass; the pointers of previous and next smaller ranks give the same rows at seven times the cost.

Groups of over GROUP windows aren't laid out in one task: their windows are hashed and counted by key instead.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import Scratch, cut, free

#: Bytes of the k-gram under an anchor; texts are read in pieces of PIECE bytes; rows laid out at once; rows of a group at most.
GRAM, PIECE, ROWS, GROUP = 128, 1 << 20, 4096, 1 << 14
BASE = 0x9E3779B97F4A7C15


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    mul = lambda b: np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, b, np.uint64))])
    return mul(BASE), mul(pow(BASE, -1, 1 << 64))


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-gram of at most PIECE bytes."""
    up, down = _powers(PIECE)
    s = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(up[: len(x)] * (x.astype(np.uint64) + np.uint64(1)), out=s[1:])
    h = (s[k:] - s[:-k]) * down[: len(x) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(raw: bytes, length: int, k: int) -> list[tuple[int, int, int, int]]:
    """(hash, position, first window, last window) of each anchor: the leftmost smallest k-gram of the windows that start there to there."""
    out, w = [], length - k + 1
    for at in range(0, max(len(raw) - length + 1, 0), PIECE - length + 1):
        x = np.frombuffer(raw, np.uint8)[at : at + PIECE]
        if len(x) < length:
            break
        h = gram_hashes(x, k)
        keyed = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(keyed) // w) * w, np.iinfo(np.uint64).max)
        padded[: len(keyed)] = keyed
        blocks = padded.reshape(-1, w)
        before = np.minimum.accumulate(blocks, 1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        n = len(x) - length + 1
        low = (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        last = np.append(first[1:], n) - 1
        pos = low[first]
        out += zip(h[pos].view(np.int64).tolist(), (pos + at).tolist(), (first + at).tolist(), (last + at).tolist())
    return out


def identity(raw: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _scan(batches, length: int, k: int, kind: pa.DataType):
    item = pa.struct([("h", pa.int64()), ("pos", pa.int64()), ("p0", pa.int64()), ("p1", pa.int64())])
    for batch in batches:
        for part in cut(batch, 1, 256):
            raws = [(t or "").encode() for t in part.column(1).to_pylist()]
            found = [anchors(r, length, k) for r in raws]
            flat = [a for f in found for a in f]
            cols = [np.array(c, np.int64) for c in zip(*flat)] if flat else [np.zeros(0, np.int64)] * 4
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in cols], fields=list(item)))
            ids = list(zip(*map(identity, raws)))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(kind), pa.array(ids[0], pa.int64()), pa.array(ids[1], pa.int64()), pa.array(map(len, raws), pa.int64()), part.column(2), lists], names=["id", "t1", "t2", "n_bytes", "th", "anchors"])


def _contexts(batches, length: int, most: int):
    """Per candidate anchor the bytes of its windows, or for a large group the hash of each window; some megabytes at a time."""
    names = ["h", "id", "t1", "t2", "pos", "p0", "p1", "ctx", "windows"]
    item = [pa.field("a", pa.int64()), pa.field("b", pa.int64())]

    def pack(rows: list[tuple], hashes: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
        types = [pa.int64(), kind, *[pa.int64()] * 5, pa.binary()]
        pairs = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        ends = np.cumsum([0, *(len(h) // 16 for h in hashes)])
        windows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], fields=item))
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), types)), windows], names=names)

    seen: set[tuple] = set()  # rows of one id and text come together and are laid out once; beyond the bound again, which changes nothing
    for batch in batches:
        kind = batch.schema.field("id").type
        rows, hashes, size = [], [], 0
        for part in cut(batch, "text", 32):
            for r in part.to_pylist():
                raw, node = (r["text"] or "").encode(), (r["id"], r["t1"], r["t2"])
                if node in seen or identity(raw) != node[1:]:
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(node)
                for c in r["own"]:
                    p0, p1 = c["p0"], c["p1"]
                    ctx = raw[p0 : p1 + length] if c["n"] <= most else None
                    own = b"" if ctx is not None else b"".join([hashlib.blake2b(raw[p : p + length], digest_size=16).digest() for p in range(p0, p1 + 1)])
                    rows.append((c["h"], r["id"], r["t1"], r["t2"], c["pos"], p0, p1, ctx))
                    hashes.append(own)
                    size += 200 + len(ctx or own)
                    if size > 4 << 20:
                        yield pack(rows, hashes, kind)
                        rows, hashes, size = [], [], 0
        if rows:
            yield pack(rows, hashes, kind)


def suffix_orders(group: np.ndarray, data: np.ndarray, starts: int):
    """For each of the columns starts-1 .. 0: (column, order, differs).

    ``order`` lists the rows by group and then by the suffix that starts in this column; differs[i] is the column where rows
    order[i-1] and order[i] first differ, so differs[i] - column is their common prefix (below zero for different groups).
    """
    n, width = data.shape
    order = np.argsort(group, kind="stable")
    g = group[order].astype(np.int64)
    same = np.concatenate([[False], g[1:] == g[:-1]])
    differs = np.where(same, width, -1)
    base = g * 512  # groups stay where they are, so this holds for every column
    for c in range(width - 1, -1, -1):
        key = base + data[order, c]
        if not (key[1:] >= key[:-1]).all():
            perm = np.argsort(key, kind="stable")
            order, sorted_key = order[perm], key[perm]
            a, b = perm[:-1], perm[1:]
            eq = sorted_key[1:] == sorted_key[:-1]
            spans = np.stack([a[eq] + 1, b[eq] + 1], 1).ravel()
            least = np.minimum.reduceat(np.append(differs, width), spans)[::2] if len(spans) else spans
            new = np.full(n, -1, np.int64)
            new[1:][eq] = least
            key = sorted_key
            differs = new
        unequal = np.concatenate([[False], key[1:] != key[:-1]])
        differs = np.where(unequal, np.where(same, c, -1), differs)
        differs[0] = -1
        if c < starts:
            yield c, order, differs


def repeats(group: np.ndarray, rank: np.ndarray, p0: np.ndarray, p1: np.ndarray, pos: np.ndarray, ctx: list[bytes], length: int, k: int, keep_first: bool) -> list[tuple[int, int, int]]:
    """(row, first, last): runs of window starts that occur elsewhere, or, to keep the first, that have a longest previous factor of ``length``."""
    w = length - k + 1
    data = np.full((len(ctx), w - 1 + length), 256, np.int16)
    for i, c in enumerate(ctx):
        at = w - 1 - (pos[i] - p0[i])
        data[i, at : at + len(c)] = np.frombuffer(c, np.uint8)
    hit = np.zeros((len(ctx), w + 1), bool)
    for c, order, differs in suffix_orders(group, data, w):
        linked = differs - c >= length
        if not linked.any():
            continue
        either = linked | np.append(linked[1:], False)
        if keep_first:  # all of a run but its smallest rank have a longest previous factor of this length
            head = np.flatnonzero(~linked)
            first = np.repeat(np.minimum.reduceat(rank[order], head), np.diff(np.append(head, len(order))))
            either &= rank[order] > first
        hit[order[either], c + 1] = True
    column = np.arange(-1, w)
    hit &= (column >= (w - 1 - pos + p0)[:, None]) & (column <= (w - 1 - pos + p1)[:, None])  # beyond its windows a row is filled up
    edge = np.diff(np.concatenate([hit, np.zeros((len(ctx), 1), bool)], 1).astype(np.int8), axis=1)
    rows, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    shift = pos[rows] - (w - 1)
    return list(zip(rows.tolist(), (begin + shift).tolist(), (end - 1 + shift).tolist()))


def _resolve(batches, length: int, k: int, keep_first: bool):
    """Rows come sorted by anchor; whole groups are laid out together, some thousand rows at a time."""
    names = ["id", "t1", "t2", "start", "end"]
    held: list[dict] = []
    kind = None

    def flush(rows: list[dict]):
        # a row of the table that is there twice is one text
        rows = list({(r["h"], r["id"], r["t1"], r["t2"], r["pos"], r["p0"]): r for r in rows}.values())
        seq = sorted(range(len(rows)), key=lambda i: (rows[i]["id"], rows[i]["t1"], rows[i]["t2"], rows[i]["pos"]))
        rank = np.empty(len(rows), np.int64)
        rank[seq] = np.arange(len(rows))
        keys = np.array([r["h"] for r in rows])
        group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
        col = lambda c: np.array([r[c] for r in rows])
        found = repeats(group, rank, col("p0"), col("p1"), col("pos"), [r["ctx"] for r in rows], length, k, keep_first)
        if found:
            out = [(rows[i]["id"], rows[i]["t1"], rows[i]["t2"], a, b + length) for i, a, b in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [kind, *[pa.int64()] * 4])], names=names)

    for batch in batches:
        kind = batch.schema.field("id").type
        for at in range(0, batch.num_rows, 1024):
            held += batch.slice(at, 1024).to_pylist()
            if len(held) >= ROWS:
                last = held[-1]["h"]
                cut = next((i for i in range(len(held) - 1, -1, -1) if held[i]["h"] != last), -1) + 1
                if cut:
                    yield from flush(held[:cut])
                    held = held[cut:]
    if held:
        yield from flush(held)


def merge(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of byte ranges."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]


def _remove(batches, length: int, keep_first: bool, carry: list[str]):
    """The columns of ``carry`` come first, then the text and what is known of it."""
    for batch in batches:
        for part in cut(batch, len(carry), 256):
            rows = []
            for text, known in zip(part.column(len(carry)).to_pylist(), part.column(len(carry) + 1).to_pylist()):
                raw = (text or "").encode()
                own = next((x for x in known or () if identity(raw) == (x["t1"], x["t2"])), None)
                spans: list[tuple[int, int]] = []
                if own:
                    copy = own["copies"] > 1 and len(raw) >= length
                    whole = copy and (not keep_first or not own["first"])
                    spans = [(0, len(raw))] if whole else merge([(x["start"], x["end"]) for x in own["spans"] or ()], len(raw))
                kept, last = [], 0
                for a, b in spans:
                    kept.append(raw[last:a])
                    last = b
                kept.append(raw[last:])
                rows.append((len(raw), sum(b - a for a, b in spans), len(spans), b"".join(kept)))
            cols = zip(*rows)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(carry))), *(pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.binary()]))], names=[*carry, "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 400, keep_first: bool = True, most: int = GROUP, carry: list[str] | None = None, text: str = "text", key: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary): every whole text as UTF-8 without the bytes of repeated strings.

    ``carry`` names the columns that go along instead of the key alone; one named like a result is left out.

    A byte goes when a string of ``length`` bytes that covers it also starts elsewhere in the table, in its own text or
    another; with ``keep_first`` when such a string starts earlier, texts standing in the order of their smallest key.
    Strings are judged on the input and never cross texts. Null texts count as empty. Repeated rows are copies of each
    other; with ``keep_first`` those with the smallest key stay. Null keys are one key before all others (an integer key of
    -2^63 counts as null); rows of one key, or without one, meet what is known of their own text only. ``kept`` may cut a character in two (kept_text drops the halves). Groups of over ``most`` anchors
    are counted by window. Equal texts are collapsed before anchors are compared, so a hot group of copies is one row. Long
    texts come alone, and a hot window's positions are merged to runs before a text's are gathered. Columns of any name can
    be carried; an empty table gives an empty one.
    """
    k = min(GRAM, max(1, length // 3))
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    name = docs.schema[key].dataType.simpleString()
    number = name in ("tinyint", "smallint", "int", "bigint")
    if number:
        name, kind, ident = "bigint", pa.int64(), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long"))
    else:
        name, kind, ident = "string", pa.string(), F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit(""))
    whole = F.col(text).cast("string")
    own_hash = F.xxhash64(F.coalesce(whole, F.lit("")))  # rows of one id, or without one, meet what is known of their own text only
    source = docs.select(ident.alias("id"), whole.alias("text"), own_hash.alias("th"))
    scan = scratch.table(source.mapInArrow(partial(_scan, length=length, k=k, kind=kind), f"id {name}, t1 bigint, t2 bigint, n_bytes bigint, th bigint, anchors array<struct<h: bigint, pos: bigint, p0: bigint, p1: bigint>>"))
    texts = scan.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("id").alias("rep"))
    long = scan.where("size(anchors) > 0").join(texts, ["t1", "t2"]).where("id = rep")
    marks = scratch.table(long.select("id", "t1", "t2", "th", F.inline("anchors")).distinct())
    twice = scratch.table(marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))  # a plain table, for AQE as below
    own = marks.join(twice, "h").groupBy("id", "th", "t1", "t2").agg(F.collect_list(F.struct("h", "pos", "p0", "p1", "n")).alias("own"))
    placed = source.join(own, ["id", "th"]).drop("th")
    found = placed.mapInArrow(partial(_contexts, length=length, most=most), f"h bigint, id {name}, t1 bigint, t2 bigint, pos bigint, p0 bigint, p1 bigint, ctx binary, windows array<struct<a: bigint, b: bigint>>")
    found = scratch.table(found)

    cold = found.where("ctx is not null").drop("windows").repartition("h").sortWithinPartitions("h")
    runs = cold.mapInArrow(partial(_resolve, length=length, k=k, keep_first=keep_first), f"id {name}, t1 bigint, t2 bigint, start bigint, end bigint")
    hot = found.where("ctx is null").select("id", "t1", "t2", "p0", F.posexplode("windows").alias("i", "w")).select("id", "t1", "t2", (F.col("p0") + F.col("i")).alias("p"), "w.a", "w.b").distinct()
    hot = scratch.table(hot)  # both sides of the join are plain tables, so that AQE can split a hot window
    counted = scratch.table(hot.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("id", "t1", "t2", "p")).alias("least")).where("n > 1"))
    again = hot.join(counted, ["a", "b"])
    if keep_first:
        again = again.where(F.struct("id", "t1", "t2", "p") > F.col("least"))
    island = F.col("p") - F.row_number().over(W.partitionBy("t1", "t2").orderBy("p"))
    again = again.select("t1", "t2", "p", island.alias("i")).groupBy("t1", "t2", "i").agg(F.min("p").alias("start"), (F.max("p") + length).alias("end"))
    runs = runs.select("t1", "t2", "start", "end").unionByName(scratch.table(again.select("t1", "t2", "start", "end")))
    spans = runs.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    told = scan.select("id", "t1", "t2", "th").distinct().join(texts, ["t1", "t2"]).join(spans, ["t1", "t2"], "left").where("copies > 1 or spans is not null")
    told = told.groupBy("id", "th").agg(F.collect_list(F.struct("t1", "t2", "copies", (F.col("id") == F.col("rep")).alias("first"), "spans")).alias("own"))
    carry = [c for c in carry or [key] if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    text_, id_, hash_, own_ = (free(c, carry) for c in ("_text", "_id", "_hash", "_own"))
    rows = docs.select(*(F.col(f"`{c}`") for c in carry), whole.alias(text_), ident.alias(id_), own_hash.alias(hash_))
    rows = rows.join(told.select(F.col("id").alias(id_), F.col("th").alias(hash_), F.col("own").alias(own_)), [id_, hash_], "left").drop(id_, hash_)
    more = [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [StructField("kept", BinaryType())]
    return rows.mapInArrow(partial(_remove, length=length, keep_first=keep_first, carry=carry), StructType([docs.schema[c] for c in carry] + more))


def kept_text(kept: str = "kept") -> Column:
    """The kept bytes as text; bytes of characters that a cut left incomplete are dropped."""
    raw = F.col(kept).cast("string")
    return F.coalesce(F.try_validate_utf8(raw), F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))


def op5_suffix(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``text``: what is left of each text."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_first=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), kept_text().alias("text"))
