"""Near-duplicate groups from SimHash fingerprints by covering locality-sensitive hashing.

For radius r each of the 64 bits gets a non-zero vector of r+1 bits, and each of the 2^(r+1)-1 non-zero vectors v gives the
mask of those bits whose vector has an odd product with v. The vectors of r differing bits span r dimensions at most, so
some v is orthogonal to all of them and its mask leaves all of them out: the pair agrees under that mask, in that table.
"""

from __future__ import annotations

from collections import defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, components, cut

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
#: Members of a bucket that are compared as they are; larger buckets are split by a second set of masks. Results don't depend on it.
BUCKET = 1 << 14
#: Bits that a sketch may differ in beyond ``far`` before the exact similarity decides.
SLACK = 16
#: Shingles of a group that are compared in one task; larger groups are dealt in pairs of blocks.
BLOCK = 1 << 22
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Its powers multiply the words of a shingle, so words in another order give another sum.
PLACE = 0x9E3779B97F4A7C15


def masks(radius: int, bits: list[int] | range = range(64)) -> list[int]:
    """Bit masks such that any two words differing in at most ``radius`` of ``bits`` agree under one of them."""
    n = 1 << radius + 1
    return [sum(1 << b for i, b in enumerate(bits) if (v & (1 + i % (n - 1))).bit_count() & 1) for v in range(1, n)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words_of(text: str | None) -> list[bytes]:
    """Whole text with A-Z in lower case, cut at the bytes 0x20 and 0x09 to 0x0D."""
    return (text or "").encode().translate(LOWER).split()


def shingle_hashes(words: list[bytes], size: int, seed: int = SEED):
    """Arrays of the XXH64 of each shingle, repeats included; fewer words than ``size`` are one shingle, none gives none."""
    if not words:
        return
    buf = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        s, e = starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist()
        yield np.array([digest(buf[i:j], seed) for i, j in zip(s, e)], np.uint64)


def _sums(one: np.ndarray) -> np.ndarray:
    """Column sums of rows of bytes 0 or 1, eight columns at a time; 255 rows don't overflow a byte."""
    lanes = one.view(np.uint64)
    return sum(lanes[at : at + 255].sum(0).view(np.uint8).astype(np.int64) for at in range(0, len(lanes), 255))


def vote(parts, weights=None) -> np.ndarray:
    """Per bit 1 where the (weighted) majority of hashes has it: 64 bits per hash column."""
    total, bits = 0, 0
    for i, h in enumerate(parts):
        one = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        if weights is None:
            bits, total = bits + _sums(one), total + len(h)
        else:
            bits, total = bits + weights[i] @ one.astype(np.float32), total + weights[i].sum()
    if not total:
        return np.zeros(1, np.uint64)
    return np.packbits(2 * bits > total, bitorder="little").view(np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash over word shingles; zero without words."""
    return int(vote(shingle_hashes(words_of(text), size))[0])


def mixed(h: np.ndarray, n: int) -> np.ndarray:
    """n further 64-bit hashes of each hash, by a multiply-xorshift mixer with n odd multipliers."""
    out = np.empty((len(h), n), np.uint64)
    for k in range(n):
        x = (h ^ (h >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 + 2 * (0x632BE59BD9B4E019 * k % (1 << 62))) % (1 << 64))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = x ^ (x >> np.uint64(32))
    return out


def numbered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of several texts as numbers, one text after another, the places where texts begin and the last ends, and the hash and length of each number's word."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    parts = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in map(words_of, texts)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in number), np.uint64, len(number))
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.cumsum([0, *map(len, parts)]), hashes, np.fromiter(map(len, number), np.int64, len(number))


def word_fingerprints(ids: np.ndarray, at: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, n: int) -> list[list[int]]:
    """n independent 64-bit SimHashes of each text over distinct words, weighted by count and length (up to 12 bytes); shared short words weigh little."""
    prints, weights, out = mixed(hashes, n), np.minimum(sizes, 12), np.zeros((len(at) - 1, n), np.uint64)
    for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        own, counts = np.unique(ids[s:e], return_counts=True)
        cuts = range(CHUNK, len(own), CHUNK)
        if s < e:
            out[i] = vote((prints[w] for w in np.split(own, cuts)), np.split((counts * weights[own]).astype(np.float32), cuts))
    return out.view(np.int64).tolist()


def shingle_sets(ids: np.ndarray, at: np.ndarray, hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """Distinct shingles of each text in order, as sums of their words' hashes, each times the multiplier of its place; fewer words than ``size`` are one shingle, none gives none."""
    h, out = hashes[ids], []
    times = [np.uint64(pow(PLACE, j + 1, 1 << 64)) for j in range(size)]
    rolled = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for j, m in enumerate(times):
        rolled += h[j : j + len(rolled)] * m
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        if e - s >= size:
            own = np.sort(rolled[s : e - size + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        else:
            own = (h[s:e] * np.array(times[: e - s], np.uint64)).sum(keepdims=True)[: e - s]
        out.append(own)
    return out


def sketches(sets: list[np.ndarray], n: int) -> list[list[int]]:
    """64·n SimHash bits over each set of distinct shingles: the share of differing bits grows with the angle between two sets."""
    out, at = np.zeros((len(sets), n), np.uint64), np.cumsum([0, *map(len, sets)]).tolist()
    hashes = mixed(np.concatenate([np.zeros(0, np.uint64), *sets]), n)
    for i, (s, e) in enumerate(zip(at, at[1:])):
        if s < e:
            out[i] = vote(hashes[j : min(j + CHUNK, e)] for j in range(s, e, CHUNK))
    return out.view(np.int64).tolist()


def identity(shingles: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))


def _prints(batches, size: int, words_fps: int, check: int, kind: pa.DataType, key: str):
    for batch in batches:
        for part in cut(batch, 1, 256, 4 << 20):
            texts = part.column(1).to_pylist()
            if check:
                ids, at, hashes, sizes = numbered(texts)
                own = shingle_sets(ids, at, hashes, size)
                fps = word_fingerprints(ids, at, hashes, sizes, words_fps)
                checks = [[*bits, identity(x), len(x)] for bits, x in zip(sketches(own, check), own)]
            else:
                fps = [[signed(int(vote(shingle_hashes(words_of(t), size))[0]))] for t in texts]
                checks = [[] for _ in texts]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(kind), pa.array(fps, pa.list_(pa.int64())), pa.array(checks, pa.list_(pa.int64()))], names=[key, "fps", "check"])


def _sets(batches, size: int):
    for batch in batches:
        for part in cut(batch, 1, 256, 4 << 20):
            own = shingle_sets(*numbered(part.column(1).to_pylist())[:3], size)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(identity, own), pa.int64()), pa.array((x.tobytes() for x in own), pa.binary())], names=["m", "same", "shingles"])


def forest(order: np.ndarray, near) -> list[tuple[int, int]]:
    """A spanning forest of the rows in ``order``; near(x, left) tells which of the rows left are linked to x."""
    out, left = [], order
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(x, left)
            hits = left[hit]
            if len(hits):
                out += [(int(x), int(h)) for h in hits]
                queue += hits.tolist()
                left = left[~hit]
    return out


def _within(prints: np.ndarray, x: int, left: np.ndarray, far: int) -> np.ndarray:
    return np.bitwise_count(prints[left] ^ prints[x]).sum(1) <= far


def links(members: np.ndarray, prints: np.ndarray, far: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of prints (rows of 64-bit words) within ``far`` bits among the members of one bucket."""
    found = forest(np.argsort(members, kind="stable"), lambda x, left: _within(prints, x, left, far))
    return [(int(members[x]), int(members[y])) for x, y in found]


def _links(batches, far: int):
    for batch in batches:
        a, b = [], []
        lists = batch.column(0)
        flat, sizes = lists.flatten(), np.asarray(lists.value_lengths())
        ids, prints = flat.field(0).to_numpy(), flat.field(1)
        if len(ids):
            prints = prints.flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        at = 0
        for n in sizes.tolist():
            for x, y in links(ids[at : at + n], prints[at : at + n], far):
                a.append(x)
                b.append(y)
            at += n
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def blocks(members: list[int], weights: list[int], most: int) -> list[list[int]]:
    """Lists of members in which every pair meets; a list's weights add up to ``most`` as far as single members allow."""
    if sum(weights) <= most:
        return [members]
    parts, size = [[]], 0
    for m, w in zip(members, weights):
        if parts[-1] and size + w > most // 2:
            parts.append([])
            size = 0
        parts[-1].append(m)
        size += w
    return [p + q for i, p in enumerate(parts) for q in parts[i + 1 :]] or parts


def _groups(batches, reach: int, far: int, check: int, most: int):
    """Members of a bucket that pairs within ``reach`` bits of its fingerprint and ``far`` bits of the sketch connect."""
    for batch in batches:
        lists, out = batch.column(0), []
        flat, sizes = lists.flatten(), np.asarray(lists.value_lengths())
        if not len(flat):
            continue
        ids = flat.field(0).to_numpy()
        prints = flat.field(1).flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        at = 0
        for n in sizes.tolist():
            own, p = ids[at : at + n], prints[at : at + n]
            near = lambda x, left: _within(p[:, :1], x, left, reach) & _within(p[:, 1 : 1 + check], x, left, far)  # noqa: B023, E731
            group: dict[int, list[int]] = {}
            for x, y in forest(np.argsort(own, kind="stable"), near):  # x is in a group already, or opens one
                g = group.setdefault(x, [x])
                g.append(y)
                group[y] = g
            for g in {id(g): g for g in group.values()}.values():
                g.sort(key=lambda i: int(own[i]))  # noqa: B023
                out += blocks(own[g].tolist(), p[g, 2 + check].tolist(), most)
            at += n
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], names=["members"])


def _exact(batches, reach: int, far: int, least: float, words: int, check: int, all_masks: list[int]):
    """Links of each group, whose rows come one after another: pairs that meet under a mask of a fingerprint and differ in at most ``reach`` of its bits, are within ``far`` bits of the sketch, and share ``least`` of their shingles."""
    cover = np.array(all_masks, np.uint64)

    def linked(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids = rows.column("m").to_numpy()
        fps = rows.column("fps").flatten().to_numpy().view(np.uint64).reshape(len(ids), words)
        prints = rows.column("check").flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)[:, :check]
        own = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in own])
        codes = np.unique(np.concatenate(own), return_inverse=True)[1].astype(np.int64)
        own = np.split(codes, np.cumsum(sizes)[:-1])
        mark = np.zeros(codes.max(initial=0) + 1, bool)

        def near(x: int, left: np.ndarray) -> np.ndarray:
            hit = _within(prints, x, left, far)
            differs = fps[left[hit]] ^ fps[x]
            met = (differs[:, :, None] & cover == 0).any(2)
            hit[hit] = (met & (np.bitwise_count(differs) <= reach)).any(1)
            mark[own[x]] = True
            for i in np.flatnonzero(hit):
                both = np.count_nonzero(mark[own[left[i]]])
                hit[i] = both >= least * (sizes[x] + sizes[left[i]] - both) - 1e-9
            mark[own[x]] = False
            return hit

        found = np.array(forest(np.argsort(ids, kind="stable"), near), np.int64).reshape(-1, 2)
        return ids[found[:, 0]], ids[found[:, 1]]

    def table(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        g, found = batch.column("g").to_numpy(), []
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            if held and g[s] != last:
                found.append(linked(held))
                held = []
            held.append(batch.slice(s, e - s))
            last = g[s]
        if found:
            yield table(found)
    if held:
        yield table([linked(held)])


def _keys(n: int, all_masks: list[int]) -> Column:
    """One 64-bit key per fingerprint and mask. Keys of different tables or masked words may meet by chance only, which adds comparisons."""
    one = lambda f, t, m: F.xxhash64(F.lit(f * len(all_masks) + t), F.get("fps", F.lit(f)).bitwiseAND(F.lit(signed(m))))
    return F.array(*[one(f, t, m) for f in range(n) for t, m in enumerate(all_masks)])


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3, words: int = 0, check: int = 4, far: int = 48, reach: int = 6, least: float = 0.8, text: str = "text", key: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """(key, fp bigint, component): every document with its fingerprint and the smallest key that near links reach.

    words = 0: one fingerprint over shingles of ``size`` words; documents are linked when at most ``radius`` bits differ, and
    every such pair meets in a table. words = n: n fingerprints over weighted words. Pairs that agree under a mask of one of
    them, as all within the radius do, and differ in at most ``reach`` of its bits are candidates, if at most ``far`` + SLACK
    bits differ of a sketch of 64·``check`` bits over the distinct shingles (64 of 256 leave a Jaccard similarity of 0.8 some
    four standard deviations). They are linked when the exact Jaccard similarity of their shingles is ``least`` or more.

    Null texts count as empty; empty texts share fingerprint zero and are linked. Keys are integers; repeated keys give
    repeated rows; a null key gives a null component unless its fingerprint is shared. Other columns are left out. Equal
    fingerprints (words = n: equal shingles too) are collapsed before anything else, so a hot group of copies is one row. A
    bucket of over BUCKET members is split by a second set of masks over the bits that its own mask leaves out, such that
    pairs within the radius (words = n: within ``reach``) still meet; links are judged alike in all buckets. Links of a bucket
    are a spanning forest, never all pairs. Shingle sets are read for candidates only, and by groups of at most BLOCK shingles.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    kind, name = to_arrow_type(docs.schema[key].dataType), docs.schema[key].dataType.simpleString()
    source = docs.select(key, F.col(text).cast("string").alias(text))
    work = partial(_prints, size=size, words_fps=words, check=check if words else 0, kind=kind, key=key)
    prints = scratch.table(source.mapInArrow(work, f"`{key}` {name}, fps array<bigint>, check array<bigint>"))
    nodes = scratch.table(prints.groupBy("fps", "check").agg(F.min(key).cast("long").alias("m")).where("m is not null"))

    first = masks(radius)
    rows = nodes.select("m", F.posexplode(_keys(max(words, 1), first)).alias("t", "k"))
    sizes = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    judged = F.col("check") if words else F.col("fps")
    table, which = F.pmod("t", F.lit(len(first))), F.expr(f"t div {len(first)}").cast("int")
    if words:
        judged = F.concat(F.array(F.get("fps", which)), judged)
    rows = scratch.table(rows.join(sizes, "k")).join(nodes, "m").select("k", "t", "n", "m", "fps", judged.alias("print"))
    free = [[b for b in range(64) if not m >> b & 1] for m in first]
    second = F.array(*[F.array(*[F.lit(signed(m | s)) for s in masks(reach if words else radius, bits)]) for m, bits in zip(first, free)])
    cold = rows.where(F.col("n") <= BUCKET).select("k", "m", "print")
    hot = rows.where(F.col("n") > BUCKET)
    split = F.transform(F.get(second, table), lambda m, i: F.xxhash64(F.col("k"), i, F.get(F.col("fps"), which).bitwiseAND(m)))
    hot = hot.select(F.explode(split).alias("k"), "m", "print")
    lists = cold.unionByName(hot).groupBy("k").agg(F.collect_list(F.struct("m", "print")).alias("members")).where("size(members) > 1").select("members")
    if words:
        far += SLACK
        groups = lists.mapInArrow(partial(_groups, reach=reach, far=far, check=check, most=BLOCK), "members array<bigint>")
        placed = scratch.table(groups.select(F.xxhash64("members").alias("g"), F.explode("members").alias("m")).distinct())
        chosen = source.select(F.col(key).cast("long").alias("m"), text).join(placed.select("m").distinct(), "m", "left_semi")
        sets = scratch.table(chosen.mapInArrow(partial(_sets, size=size), "m bigint, same bigint, shingles binary").distinct())
        full = placed.join(nodes.withColumn("same", F.get("check", F.lit(check))), "m").join(sets, ["m", "same"])
        full = full.select("g", "m", "fps", "check", "shingles").repartition("g").sortWithinPartitions("g")
        edges = full.mapInArrow(partial(_exact, reach=reach, far=far, least=least, words=words, check=check, all_masks=first), "a bigint, b bigint")
    else:
        edges = lists.mapInArrow(partial(_links, far=radius), "a bigint, b bigint")
    stars = components(edges, scratch)
    named = nodes.join(stars, nodes.m == stars.node, "left").select("fps", "check", F.coalesce("root", "m").alias("component"))
    fp = F.get("fps", F.lit(0)).alias("fp")
    if words:
        return prints.join(named, ["fps", "check"], "left").select(key, fp, "component")
    return prints.select(key, fp).join(named.select(fp, "component"), "fp", "left").select(key, "fp", "component")


def keep_first(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its group; rows without a key stay."""
    found = near_duplicates(docs, key=key, **how)
    kept = found.where(F.col(key) == F.col("component")).select(key).distinct()
    return docs.join(kept, key, "left_semi").select(docs.columns).unionByName(docs.where(F.col(key).isNull()))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
