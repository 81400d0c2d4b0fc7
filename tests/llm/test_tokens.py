"""Fill-in-the-middle, alignment of tokenizers and the sentencepiece form of byte-level BPE, against plain computations."""

import base64
import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratum.llm import align, bpe, fim, pieces
from stratum.llm import queries as llm

SF = "/root/testdata/sf0.001"
ALPHABET = " \n\t\r\x0b\x0c\x1c\x85\xa0　aébß'sltdrevm123٣½Ⅷ.,!-_▁日本한😀👩‍👧́​﻿\x00\xad<>PSM"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = ["", None, " ", "  ", "\t \n", "a", " a ", "a b c d e f g", "<P>", "x <S> y", "q <M>", "a<b P> <", "<|endoftext|> <s></s><unk>", "▁x", "two words " * 3000, "😀" * 300, "ﬁ ﬀ Å", "word  word   word", "same text", "same text"]
    out += ["".join(rng.choice(ALPHABET) if rng.random() < 0.9 else rng.choice(["the ", "  ", "\n\n", "<P", "hello "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [*enumerate(out), (None, "a text without a key"), (7, "one key, another text"), (7, "one key, another text")]


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 0, "x", 1.0, "y") for i, t in rows], "doc_id long, text string, n int, Form string, links double, _row string").repartition(3)


def fim_by_hand(key, text):
    """The rule as it is stated, unit by unit."""
    text = text or ""
    units = [m[0] for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]
    hexes = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(hexes[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n, (lo, hi) = len(units), sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fim(spark, rows):
    made = fim.transform(frame(spark, rows))
    assert made.columns == ["doc_id", "text", "links", "_row", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    got = made.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "spm", "psm"}
    for r in got:
        assert tuple(r[4:9]) == fim_by_hand(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
    assert sorted(Counter((r.doc_id, r.text) for r in got).items(), key=repr) == sorted(Counter(rows).items(), key=repr)
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fim_long_text(spark):
    text = "word \n" * 400_000 + " " * 1_000_000 + "x" * 1_000_000
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).repartition(2)
    out = fim.transform(docs).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    assert {tuple(r) for r in out.select("n", F.sha2("back", 256)).distinct().collect()} == {(400_001, hashlib.sha256(text.encode()).hexdigest())}
    assert out.where("form <> 'plain' and prefix_chars + middle_chars <= length(text)").count() > 5


def test_fim_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = fim.op11_fim(spark, SF)
    want = duckdb.sql(llm.ORACLES["op11_fim"]).select(", ".join(got.columns)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def align_by_hand(texts):
    """n_a, n_b, n_groups, groups and links of each text by walking over bytes."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in letters} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in letters)}
    for text in texts:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        sa = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
        sb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ib)]
        if not text or b"".join(sa) != (" " + text).encode() or b"".join(sb) != (" " + text).encode():
            yield 0, 0, 0, "", []
            continue
        of_a, of_b = [i for i, s in enumerate(sa) for _ in s], [i for i, s in enumerate(sb) for _ in s]
        links = list(dict.fromkeys(zip(of_a, of_b)))
        groups = [([], [])]
        for k, (i, j) in enumerate(zip(of_a, of_b)):
            last = [k + 1 == len(o) or o[k + 1] != o[k] for o in (of_a, of_b)]
            for g, x, end in zip(groups[-1], (ia[i], ib[j]), last):
                if end:
                    g.append(str(x))
            if all(last):
                groups.append(([], []))
        yield len(ia), len(ib), len(groups) - 1, ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups[:-1]), [(ia[i], ib[j]) for i, j in links]


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_alignment(spark, rows, monkeypatch, most):
    monkeypatch.setattr(align, "MAX_BROADCAST", most)
    want = list(align_by_hand([t for _, t in rows]))
    documents = Counter(p for *_, links in want for p in set(links))
    best = defaultdict(int)
    for (x, _), n in documents.items():
        best[x] = max(best[x], n)
    expected = Counter()
    for (key, _), (n_a, n_b, n_groups, groups, links) in zip(rows, want):
        expected[key, n_a, n_b, n_groups, len(links), sum(documents[p] == best[p[0]] for p in links), sum(documents[p] for p in links), groups, tuple(sorted(x << 32 | y for x, y in links))] += 1
    made = align.align_documents(frame(spark, rows))
    out = align.link_scores(made.select("doc_id", F.size("a_ids").alias("n_a"), F.size("b_ids").alias("n_b"), "n_groups", "groups", "links"))
    got = Counter((*r[:-1], tuple(r.links)) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "links").collect())
    assert got == expected
    assert sum(n for (_, n_a, *_), n in got.items() if n_a) > 200 and any(x[7].count(",") for x in got)


def test_alignment_of_nothing(spark):
    none = align.align_documents(spark.createDataFrame([], "doc_id long, text string"))
    assert align.link_scores(none.select("doc_id", "links")).count() == 0
    only = align.align_documents(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert [tuple(r) for r in align.link_scores(only.select("n_groups", "groups", "links")).collect()] == [(0, "", [], 0, 0, 0)] * 2


def test_alignment_query(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in align.op12_alignment(spark, SF).collect()}
    assert len(got) == len(texts)
    for (i, _), (n_a, n_b, n_groups, groups, links) in zip(texts, align_by_hand([t for _, t in texts])):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (n_a, n_b, n_groups, len(links), hashlib.sha256(groups.encode()).hexdigest() if n_a else "")


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces(spark, rows, library):
    got = Counter((r.doc_id, r.ids, r.decoded) for r in pieces.encode_column(frame(spark, rows)).collect())
    want = Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[i, struct.pack(f"<{len(ids)}I", *ids), (t or "").encode()] += 1
    assert got == want
    assert pieces.encode_column(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_every_token_stays_whole(name):
    coder = pieces.load(public_tokenizers.path(name), public_tokenizers.PATTERN)
    rng = random.Random(1)
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    assert {r: coder.table[r] for r in ranks.values()} == {r: t for t, r in ranks.items()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for _ in range(3000):
        word = "".join(chr(rng.choice([rng.randint(97, 122), rng.randint(0xC0, 0x17F), rng.randint(0x400, 0x45F), rng.randint(0x4E00, 0x4FFF)])) for _ in range(rng.randint(1, 12)))
        assert list(struct.unpack(f"<{len(x := coder.encode(word)) // 4}I", x)) == library.encode_ordinary(word)


@pytest.mark.parametrize("text", ["a" * 300_000, "é!" * 100_000, " " * 1_000_000 + "x", "\n" * 1_000_000, "ab1 " * 200_000])
def test_pieces_long_texts(text, library):
    coder = pieces.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = coder.encode(text)
    assert coder.decode(ids).decode() == text
    if not text.isspace() and text[0] != " ":  # the library's pattern overflows on long white space
        assert list(memoryview(ids).cast("I")) == library.encode_ordinary(text)


def test_alignment_keeps_few_chunks(monkeypatch):
    """Finished chunks are kept in two small generations, with the same ids as without any."""
    monkeypatch.setattr(align, "KEPT", 40)
    a, b = align.load.__wrapped__(align.tokenizer_path()), align.Pieces(align.tokenizer_path("piece_bpe_32k.model"))
    texts = [" ".join(f"word{i * k % 301}, the ä{k}" for i in range(1, 60)) for k in range(1, 9)] + ["", None, "a  b"]
    b.learn(texts)
    for t in filter(None, texts):
        assert a.encode_part(" " + t) == bpe.Bpe(align.tokenizer_path()).encode_plain(" " + t)
        assert b.encode(t) == b.encode_plain(t)
    for kept in (a.words, b.chunks):
        assert 0 < len(kept) <= 40 and len(kept.older) <= 40
    assert len(a.merged) <= 41
