"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's whole windows are emitted as they are; its rest goes to
the open window that it fits best. When it fits none and all windows are open, the fullest is topped up with the head of
the rest and emitted. At the end of a partition the open windows are poured together, so one at most is left over; the
leftovers of groups of partitions are then packed by the same rule until one group remains.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.taskcontext import TaskContext

from .common import Scratch, cut
from .bpe import byte_alphabet, load, tokenizer_path

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of this length or more overflows the library's pattern; such texts are encoded by the own merges, with the same ids.
MAX_BLANKS = 50_000
#: Partitions whose leftovers meet in one task of the next round.
MERGE = 4096
PIECE = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class Encoder:
    """Whole texts to little-endian unsigned 32-bit ids, as the tokenizers file (byte-level BPE) gives them."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.coder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.blanks, self.path = regex.compile(r"\s{%d}" % MAX_BLANKS), path

    def encode(self, text: str) -> bytes:
        if len(text) >= MAX_BLANKS and self.blanks.search(text):
            return load(self.path).encode(text)
        return self.coder.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Windows:
    """The open windows of one partition. A piece is (key, start, ids, doc_tokens); windows come out as lists of pieces.

    A document's ids are walked through by a view, so a long one is copied once."""

    def __init__(self, width: int, n_open: int) -> None:
        self.width, self.n_open = width, n_open
        self.open: list[list] = []
        self.used: list[int] = []

    def add(self, piece: tuple):
        key, start, ids, total = piece
        ids = memoryview(ids)
        while ids:
            n = len(ids) // 4
            if n >= self.width:
                yield [(key, start, bytes(ids[: 4 * self.width]), total)]
                start, ids = start + self.width, ids[4 * self.width :]
                continue
            best = max((u, i) for i, u in enumerate(self.used) if u + n <= self.width)[1] if any(u + n <= self.width for u in self.used) else None
            if best is None and len(self.open) < self.n_open:
                self.open.append([])
                self.used.append(0)
                best = len(self.open) - 1
            if best is not None:
                self.open[best].append((key, start, bytes(ids), total))
                self.used[best] += n
                if self.used[best] == self.width:
                    yield self.take(best)
                return
            full = self.used.index(max(self.used))
            room = self.width - self.used[full]
            self.open[full].append((key, start, bytes(ids[: 4 * room]), total))
            start, ids = start + room, ids[4 * room :]
            yield self.take(full)

    def take(self, i: int) -> list:
        self.used.pop(i)
        return self.open.pop(i)

    def pour(self):
        """Pours the open windows together; at most one stays open."""
        pieces = [p for _, w in sorted(zip(self.used, self.open), key=lambda x: -x[0]) for p in w]
        self.open, self.used, self.n_open = [], [], 1
        for p in pieces:
            yield from self.add(p)


def _emit(key: str, kind: pa.DataType, windows, round_: int):
    """Rows of finished windows in batches; ids are unique by round, partition and number. The leftover has no id yet."""
    pid, n, rows = TaskContext.get().partitionId(), 0, []

    def batch():
        cols = list(zip(*rows))
        types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "part"])

    for window, done in windows:
        seq, at = (round_ << 56 | pid << 32 | n, 0) if done else (None, 0)
        n += done
        for k, start, ids, total in window:
            rows.append((k, start, len(ids) // 4, ids, total, seq, at, pid))
            at += len(ids) // 4
        if len(rows) >= 2000:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


def pack(docs: DataFrame, width: int = 2048, n_open: int = 16, end_id: int = 1, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """Pieces (key, start, length, ids, doc_tokens, sequence_id, offset) of all documents, packed into windows of ``width`` ids.

    A document is its text's ids (null: empty) and then ``end_id``, so every document has a piece. Repeated keys are packed
    one by one; other columns are left out, so none can clash. An empty table gives an empty one. Memory holds ``n_open``
    windows and one document. Finished windows are written to the shared folder once, so ids stay the same when an
    executor is lost later; at most one window of the whole corpus is not full.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    kind = to_arrow_type(docs.schema[key].dataType)
    out = f"`{key}` {docs.schema[key].dataType.simpleString()}, {PIECE}, part int"
    end = int(end_id).to_bytes(4, "little")

    def first(batches):
        enc, win = encoder(path or tokenizer_path()), Windows(width, n_open)

        def finished():
            for b in batches:
                for part in cut(b, 1, 256):
                    for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        ids = (enc.encode(t) if t else b"") + end
                        for w in win.add((k, 0, ids, len(ids) // 4)):
                            yield w, True
            for w in win.pour():
                yield w, True
            for w in win.open:
                yield w, False

        yield from _emit(key, kind, finished(), 0)

    def again(round_: int, final: bool):
        def run(batches):
            win = Windows(width, n_open)

            def finished():
                for b in batches:
                    for r in b.to_pylist():
                        for w in win.add((r[key], r["start"], r["ids"], r["doc_tokens"])):
                            yield w, True
                for w in win.pour():
                    yield w, True
                for w in win.open:
                    yield w, final

            yield from _emit(key, kind, finished(), round_)

        return run

    source = docs.select(key, F.col(text).cast("string").alias(text))
    packed = scratch.table(source.mapInArrow(first, out))
    done, rest, round_ = [packed.where("sequence_id is not null")], packed.where("sequence_id is null"), 0
    groups = (packed.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        groups, round_ = -(-groups // MERGE), round_ + 1
        near = rest.withColumn("part", F.expr(f"part div {MERGE}").cast("int")).repartition(groups, "part").sortWithinPartitions("part", key, "start")
        packed = scratch.table(near.mapInArrow(again(round_, groups == 1), out))
        done.append(packed.where("sequence_id is not null"))
        if groups == 1:
            break
        rest = packed.where("sequence_id is null")
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole.drop("part")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pieces(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def pieces(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    return packed.select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
