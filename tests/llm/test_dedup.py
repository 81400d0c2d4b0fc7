"""Near-duplicates, fingerprints and repeated strings against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratum.llm import fingerprints, simhash_dedup, suffix_dedup
from stratum.llm.common import Scratch

SCHEMA = "doc_id long, text string, fp string, n_bytes string, component string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 300))] for _ in range(25)]
    docs = [None, "", " \t\n", "One", "one", "ONE two", "É é", " ".join(words * 30)]
    for b in base:
        docs.append(" ".join(b))
        for _ in range(4):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = rng.choice(words)
            docs.append(rng.choice([" ", "  ", "\n"]).join(c))
    rows = list(enumerate(docs, 10))
    rng.shuffle(rows)
    return [*rows, rows[3], rows[3]]


def reference_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_masks_cover_every_pair():
    for radius, bits in ((3, range(64)), (2, range(64)), (3, [1, 5, 9, 10, 33, 60])):
        found, rng = simhash_dedup.masks(radius, bits), random.Random(1)
        for _ in range(3000):
            diff = sum(1 << b for b in rng.sample(list(bits), rng.randint(0, radius)))
            assert any(not diff & m for m in found)


@pytest.mark.parametrize("bucket", [2, 1024])
def test_near_duplicates(spark, corpus, bucket, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BUCKET", bucket)
    got = simhash_dedup.near_duplicates(frame(spark, corpus)).collect()
    prints = {i: reference_print(t) for i, t in corpus}
    ids = sorted(prints)
    comp = {i: i for i in ids}
    while True:
        new = {i: min(comp[j] for j in ids if (prints[i] ^ prints[j]).bit_count() <= 3) for i in ids}
        if new == comp:
            break
        comp = new
    assert sorted((r.doc_id, r.fp % 2**64, r.component) for r in got) == sorted((i, prints[i], comp[i]) for i, _ in corpus)
    assert len(set(comp.values())) < len(ids)


def test_dense_bucket(spark):
    """Thousands of fingerprints in one bucket and one component, and others beside it."""
    rng = np.random.default_rng(0)
    fps = np.unique(np.concatenate([[0], *(1 << rng.integers(0, 14, 3000, dtype=np.uint64) | 1 << rng.integers(0, 14, 3000, dtype=np.uint64) for _ in range(1)), rng.integers(0, 2**63, 50, dtype=np.uint64)]).astype(np.uint64))
    pairs = simhash_dedup.links(np.arange(len(fps)), fps[:, None], 3)
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(b)] = root(a)
    assert len(pairs) < len(fps)
    for i, j in itertools.combinations(range(0, len(fps), 3), 2):
        if int(fps[i] ^ fps[j]).bit_count() <= 3:
            assert root(i) == root(j)


def test_pipeline_form_finds_copies(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows, truth = [], {}
    for g in range(40):
        base = [rng.choice(words) for _ in range(400)]
        for c in range(3):
            w = list(base)
            for _ in range(4 * c):
                w[rng.randrange(400)] = rng.choice(words)
            rows.append((10 * g + c, " ".join(w)))
            truth[10 * g + c] = 10 * g
    kept = simhash_dedup.keep_first(frame(spark, rows), radius=3, size=5, words=4, check=4, far=48)
    assert kept.columns == ["doc_id", "text", "fp", "n_bytes", "component"]
    kept = {r.doc_id for r in kept.collect()}
    assert {truth[i] for i in kept} == set(truth.values()) and len(kept) <= 41


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert simhash_dedup.near_duplicates(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert fingerprints.document_fingerprints(empty).count() == 0


def brute(docs, length, first):
    count, seen = collections.Counter(), {}
    raws = [(i, (t or "").encode()) for i, t in sorted(docs)]
    for i, b in raws:
        for p in range(len(b) - length + 1):
            count[b[p : p + length]] += 1
            seen.setdefault(b[p : p + length], (i, p))
    out = {}
    for i, b in raws:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if count[s] > 1 and (not first or seen[s] != (i, p)):
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), runs, bytes(c for c, x in zip(b, gone) if not x))
    return out


@pytest.mark.parametrize(("length", "first", "most"), [(40, False, 1 << 14), (40, True, 1 << 14), (90, True, 2), (90, False, 2)])
def test_repeats(spark, length, first, most):
    rng = random.Random(length)
    base = ["".join(rng.choice("abc é\n") for _ in range(300)) for _ in range(6)]
    docs = []
    for i in range(80):
        t = ""
        for _ in range(rng.randint(0, 4)):
            b, a = rng.choice(base), rng.randint(0, 250)
            t += b[a : rng.randint(a, 300)] + (rng.choice("xyz") if rng.random() < 0.5 else "")
        docs.append((i, "a" * rng.randint(0, 200) if rng.random() < 0.1 else t))
    docs[5], docs[7], docs[9] = (5, None), (7, docs[8][1]), (9, docs[8][1])
    got = suffix_dedup.remove_repeats(frame(spark, docs), length=length, keep_first=first, most=most).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == brute(docs, length, first)


def test_repeated_rows_keep_first(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdef ") for _ in range(300))
    rows = [(1, text), (1, text), (2, "x" + text), (None, text[:100])]
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=50).collect()
    assert sorted((r.doc_id or -1, len(r.kept)) for r in got) == [(-1, 100), (1, 200), (1, 200), (2, 1)]


def test_long_texts_cross_pieces(spark, monkeypatch):
    rng = random.Random(6)
    raw = bytes(rng.randrange(97, 123) for _ in range(3000))
    whole = suffix_dedup.anchors(raw, 60, 20)
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    cut = suffix_dedup.anchors(raw, 60, 20)
    assert {(p, s) for _, p, a, b in whole for s in range(a, b + 1)} == {(p, s) for _, p, a, b in cut for s in range(a, b + 1)}


def test_fingerprints(spark, corpus):
    rows = sorted({i: t for i, t in corpus}.items())
    got = {r.doc_id: r for r in fingerprints.document_fingerprints(frame(spark, rows)).collect()}
    by_text = {}
    for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        edit = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        g = got[i]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert by_text.setdefault(t, (g.hi, g.lo)) == (g.hi, g.lo)
        assert (g.nhi, g.nlo) == (got[j].hi, got[j].lo)
        bits = [0] * 128
        total = 0
        for w in re.split("[\x20\x09-\x0d]+", t.lower()):
            weight = min(len(w.encode()), 12)
            total += weight
            h0 = xxhash.xxh64_intdigest(w.encode(), 42)
            h1 = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), h0)
            for b in range(64):
                bits[b] += weight * (h0 >> b & 1)
                bits[64 + b] += weight * (h1 >> b & 1)
        assert (g.hi % 2**64, g.lo % 2**64) == tuple(sum(1 << b for b in range(64) if 2 * bits[k + b] > total) for k in (0, 64))


def test_far_ids_and_single_rows(spark):
    rows = [(5, "a b"), (10**12, "c d"), (3 * 10**12, "e f"), (None, "n")]
    got = {r.doc_id: (r.nhi, r.nlo) for r in fingerprints.document_fingerprints(frame(spark, rows)).collect()}
    own = {r.doc_id: (r.hi, r.lo) for r in fingerprints.document_fingerprints(frame(spark, rows)).collect()}
    assert got == {None: own[5], 5: own[10**12], 10**12: own[3 * 10**12], 3 * 10**12: own[None]}
    one = fingerprints.document_fingerprints(frame(spark, [(1, "abcdef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_search(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(128) for _ in range(20)]
    fps = [b ^ sum(1 << rng.randrange(128) for _ in range(rng.randint(0, 5))) for b in base for _ in range(6)]
    s = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(s(f >> 64), s(f % 2**64)) for f in fps], "hi long, lo long")
    found = fingerprints.search(df, df.limit(30), 3).collect()
    asked = {(r.hi, r.lo) for r in df.limit(30).collect()}
    full = lambda hi, lo: (hi % 2**64) << 64 | lo % 2**64
    want = {(full(*q), f): fps.count(f) for q in asked for f in fps if (full(*q) ^ f).bit_count() <= 3}
    assert {(full(r.hi, r.lo), full(r.ohi, r.olo)): r.n for r in found} == want and len(found) == len(want)


def test_components_survive_self_loops(spark):
    from stratum.llm.common import components

    out = components(spark.createDataFrame([(1, 1), (2, 3), (3, 4)], "a long, b long"), Scratch(spark, "t"))
    assert sorted(map(tuple, out.collect())) == [(2, 2), (3, 2), (4, 2)]
    assert F is not None


def changed(rng, base, words, n):
    out = list(base)
    for at in rng.sample(range(0, len(base), 5), n):
        out[at] = rng.choice(words) + "x"
    return out


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_links_need_exact_similarity(spark):
    """Pairs of a Jaccard similarity of 0.6 to 0.8, which the sketch alone would often link, stay apart."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = []
    for g in range(60):
        base = [rng.choice(words) for _ in range(400)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(changed(rng, base, words, 10 + g % 8)))]
    near = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    assert 0.6 < min(near) < 0.7 and 0.75 < max(near) < 0.8
    got = simhash_dedup.near_duplicates(frame(spark, rows), size=5, words=4).collect()
    assert sorted(r.component for r in got) == list(range(120))


def test_pipeline_form_is_the_same_for_all_buckets(spark, monkeypatch):
    """Buckets that are split, and groups that are dealt in blocks, give the same components."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    rows = []
    for g in range(10):
        base = [rng.choice(words) for _ in range(300)]
        rows += [(20 * g + c, " ".join(changed(rng, base, words, c))) for c in range(20)]
    got = []
    for bucket, block in ((1 << 14, 1 << 22), (2, 1 << 22), (1 << 14, 1500)):
        monkeypatch.setattr(simhash_dedup, "BUCKET", bucket)
        monkeypatch.setattr(simhash_dedup, "BLOCK", block)
        got.append({r.doc_id: r.component for r in simhash_dedup.near_duplicates(frame(spark, rows), size=5, words=4).collect()})
    assert got[0] == got[1] == got[2]
    assert 10 <= len(set(got[0].values())) < 200


def signed(x):
    return x - 2**64 if x >> 63 else x


@pytest.mark.parametrize(("many", "few", "group"), [(4096, 100_000, 4096), (3, 1, 4)])
def test_next_documents(spark, monkeypatch, many, few, group):
    """Sparse, negative, repeated and missing ids, whichever way buckets are split and ordered."""
    monkeypatch.setattr(fingerprints, "MANY", many)
    monkeypatch.setattr(fingerprints, "FEW", few)
    monkeypatch.setattr(fingerprints, "GROUP", group)
    rng = random.Random(3)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(40)] + list(range(-20, 900, 7)) + [5] * 30 + [None] * 20
    rows = [(i, f"text {n} of {i}" + " é" * rng.randint(0, 3)) for n, i in enumerate(ids)] + [(77_777, None), (77_778, "")]
    rng.shuffle(rows)
    got = fingerprints.with_next(frame(spark, rows), Scratch(spark, "t")).where("guest = 0").select("doc_id", "text", "next_text").collect()
    h = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    rank = lambda r: (r[0] is not None, r[0] or 0, h(r[1]) >> 52, signed(h(r[1])), r[1])
    want = sorted(((i, t or "") for i, t in rows), key=rank)
    assert sorted(((r.doc_id, r.text, r.next_text) for r in got), key=repr) == sorted(((i, t, u) for (i, t), (_, u) in zip(want, want[1:] + want[:1])), key=repr)


def test_op10_columns(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(0, 260, 2)] + [(1, None), (301, "é" * 9)]
    rows += [(401, rows[50][1])]
    frame(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op10_fingerprints(spark, str(tmp_path)).collect()}
    rows.sort()

    def bits(t):
        votes, total = [0] * 128, 0
        for w in re.split("[\x20\x09-\x0d]+", (t or "").lower()):
            weight = min(len(w.encode()), 12)
            total += weight
            h0 = xxhash.xxh64_intdigest(w.encode(), 42)
            both = h0 << 64 | xxhash.xxh64_intdigest((7).to_bytes(4, "little"), h0)
            votes = [v + weight * (both >> (127 - b) & 1) for b, v in enumerate(votes)]
        return int("".join("1" if 2 * v > total else "0" for v in votes), 2)

    full = {i: bits(t) for i, t in rows}
    for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        edit = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (f"{full[i]:032x}", f"{bits(edit):032x}")
        assert (r.near_edited, r.near_next) == (1 - (full[i] ^ bits(edit)).bit_count() / 128, 1 - (full[i] ^ full[j]).bit_count() / 128)
        assert r.n_near == (sum((full[i] ^ f).bit_count() <= 3 for f in full.values()) - 1 if i % 100 == 0 else None)


@pytest.mark.parametrize("first", [False, True])
def test_many_texts_of_one_key(spark, first):
    """Texts that all share a key, or have none, and rows that repeat give what texts with keys of their own give."""
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdef ") for _ in range(80))
    texts = ["".join(rng.choice("ghijkl ") for _ in range(300)) + shared + "".join(rng.choice("mnopq ") for _ in range(50)) for _ in range(3000)]
    own = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, list(enumerate(texts))), length=50, keep_first=first, carry=["doc_id", "text"]).collect()}
    for keys in ([None] * 3000, [7] * 3000):
        got = suffix_dedup.remove_repeats(frame(spark, list(zip(keys, texts))), length=50, keep_first=first, carry=["text"]).collect()
        assert len(got) == 3000
        if not first:
            assert {r.text: bytes(r.kept) for r in got} == {r.text: bytes(r.kept) for r in own.values()}
        else:  # which text stands first among equals of a key is free
            assert sum(r.n_removed == 0 for r in got) == sum(r.n_removed == 0 for r in own.values()) == 1
    doubled = suffix_dedup.remove_repeats(frame(spark, [(None, shared * 2)] * 4000 + [(None, "z" * 20 + shared)]), length=50, keep_first=False).collect()
    assert sorted({(r.n_removed, len(r.kept)) for r in doubled}) == [(80, 20), (160, 0)]


def test_clashing_columns_and_null_strings(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdef ") for _ in range(300))
    df = spark.createDataFrame([(None, text, "a", "b", "c"), ("", "x" + text, "a", "b", "c"), ("k", text[:60], "a", "b", "c")], "doc_id string, text string, _text string, _own string, _id string")
    got = suffix_dedup.remove_repeats(df, length=50, carry=df.columns).collect()
    assert sorted((r.doc_id is not None, r.doc_id or "", len(r.kept), r._text + r._own + r._id) for r in got) == [(False, "", 300, "abc"), (True, "", 1, "abc"), (True, "k", 0, "abc")]
    assert spark.createDataFrame([(bytearray("aé".encode()[:2]),)], "kept binary").select(suffix_dedup.kept_text()).first()[0] == "a"


def test_shingle_sets_of_many_texts():
    """Sets of texts taken together have the sizes and overlaps of their word tuples, also where words recur in another order."""
    rng = random.Random(3)
    texts = [None, "", "a", "a b", "b a", "a b c d e", "A b  c d e f", "a b c b a", "b a c a b", *(" ".join(rng.choice("abc") for _ in range(rng.randrange(300))) for _ in range(60))]
    plain = []
    for t in texts:
        w = (t or "").lower().split()
        plain.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    ids, at, hashes, sizes = simhash_dedup.numbered(texts)
    got = [set(x.tolist()) for x in simhash_dedup.shingle_sets(ids, at, hashes, 5)]
    assert [len(x) for x in got] == [len(x) for x in plain]
    assert all(len(a & b) == len(x & y) for a, x in zip(got, plain) for b, y in zip(got, plain))
    assert [len(x) for x in simhash_dedup.sketches([np.array(sorted(x), np.uint64) for x in got], 4)] == [4] * len(texts)
