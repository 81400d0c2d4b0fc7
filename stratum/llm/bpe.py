"""Byte-level BPE encoding and decoding.

Words are merged with the contiguous rank array: a list holds the parts between boundaries and a parallel list the rank of
each adjacent pair; the minimum is found by a scan, its boundary deleted, and the two neighbouring ranks refreshed. The
pre-tokenizer's pattern decides what a word is; words recur, so each worker keeps a bounded table of finished ones.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = 1 << 60
#: Finished words that a worker keeps; beyond it the table starts anew.
MAX_WORDS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Irregular(Exception):
    """White space meets white space, so chunks can't be encoded one by one."""


class Words(dict):
    """text chunk -> ids as little-endian unsigned 32-bit integers. A chunk stands after one space unless it begins with a line feed."""

    def __init__(self, bpe: Bpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MAX_WORDS:
            self.clear()
        out = self.make(chunk)
        if len(chunk) <= 64:
            self[chunk] = out
        return out

    def make(self, chunk: str) -> bytes:
        feed = chunk[:1] == "\n"
        inner = chunk[feed:]
        if not inner or inner[0].isspace() or inner[-1].isspace():
            raise Irregular
        return self.bpe.encode_plain(chunk if feed else " " + chunk)


class Bpe:
    """A tokenizers file (model BPE, ByteLevel) read into merge ranks; ``encode`` and ``decode`` give what that library gives."""

    def __init__(self, path: str, most: int = MAX_WORDS) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_alphabet(), spec["model"]["vocab"]
        raw = lambda token: bytes(letters[c] for c in token)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.first = [0] * 256
        for c, b in letters.items():
            self.first[b] = vocab[c]
        self.pairs = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.table = [b""] * size
        for token, i in vocab.items():
            self.table[i] = raw(token)
        for token, i in self.special.items():
            self.table[i] = token.encode()
        self.lengths = np.fromiter(map(len, self.table), np.int64, size)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words, self.find = Words(self), regex.compile(PATTERN).findall
        self.merged: dict[str, bytes] = {}
        self.most = most

    def merge(self, word: bytes) -> list[int]:
        """The contiguous rank array of one word. A pair's rank sorts before its result, so the leftmost lowest rank is taken."""
        parts, get = [self.first[b] for b in word], self.pairs.get
        ranks = [get(a << 20 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [low & 0xFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 20 | parts[i + 1], NO_RANK)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """The same result for a word of thousands of bytes: a heap of ranks over linked parts instead of scans of one array."""
        import heapq

        n, get = len(word), self.pairs.get
        parts, nxt, prev = [self.first[b] for b in word], [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 20 | parts[i + 1], NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], nxt[i] = low & 0xFFFFF, -1, nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            for k in (prev[i], i):
                if k >= 0 and nxt[k] >= 0 and (r := get(parts[k] << 20 | parts[nxt[k]], NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (r, k, parts[k], parts[nxt[k]]))
        return [p for p in parts if p >= 0]

    def encode_plain(self, text: str) -> bytes:
        """Any text without special tokens, by the pattern."""
        out, known = [], self.merged
        if len(known) >= self.most:
            known.clear()
        for word in self.find(text):
            ids = known.get(word)
            if ids is None:
                raw = word.encode()
                parts = self.merge(raw) if len(raw) <= 512 else self.merge_long(raw)
                ids = struct.pack(f"<{len(parts)}I", *parts)
                if len(word) <= 64:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode_part(self, text: str) -> bytes:
        # where no two white-space characters meet, the pattern never joins one chunk with the next
        head, *rest = text.replace("\n", " \n").split(" ")
        if head[-1:].isspace():
            return self.encode_plain(text)
        words = self.words
        try:
            return self.encode_plain(head) + b"".join([words[x] for x in rest])
        except Irregular:
            return self.encode_plain(text)

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if not self.split or not self.split.search(text):
            return self.encode_part(text) if text else b""
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [self.encode_part(text[at : m.start()]), struct.pack("<I", self.special[m[0]])]
            at = m.end()
        return b"".join([*out, self.encode_part(text[at:])])

    def encode_offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and n x 2 offsets in code points; special tokens are read as plain text. A token that holds a part of a character spans all of it."""
        ids = np.frombuffer(self.encode_part(text) if text else b"", "<u4")
        nth = np.cumsum(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80)
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return ids, np.stack([nth[ends - sizes] - 1, nth[ends - 1]], axis=1)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_column(docs: DataFrame, name: str, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, ids binary, decoded text) of every whole text; null texts count as empty. One pass, no shuffle.

    name: file of the tokenizers folder, unless ``path`` names one that all executors can read. Repeated keys give repeated
    rows; other columns are left out, so none can clash. An empty table gives an empty one.
    """

    def run(batches):
        bpe = load(path or tokenizer_path(name))
        for batch in batches:
            for part in cut(batch, 1):
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.string())], names=[key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, ids binary, decoded string")


def n_tokens(ids: str = "ids") -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    out = encode_column(spark.read.parquet(f"{sf_dir}/documents.parquet"), "byte_bpe_50k.json")
    return out.select("doc_id", n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
