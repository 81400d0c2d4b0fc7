"""Byte-level BPE through a sentencepiece model that is written straight from a vocabulary of ranks.

Bytes become printable characters, every token becomes a piece scored by its negative rank, and the model neither normalises nor
adds white space; so the library's merges (best score first, leftmost among equals) are those of the ranks. The pre-tokenizer's
matches are encoded each for itself, and ids are decoded by the inverse of the byte mapping.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MAX_WORDS, Bpe, Words, byte_alphabet, n_tokens, tokenizer_path
from .common import cut, read


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _block(field: int, body: bytes) -> bytes:
    """A length-delimited field of the protobuf wire format."""
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def serialise(names: Iterable[str]) -> bytes:
    """A sentencepiece model (type BPE, identity normalisation) with an unknown piece of id 0 and then ``names`` by rising rank.

    Fixed values: the numbers of the fields of ModelProto (1 pieces, 2 trainer_spec, 3 normalizer_spec), SentencePiece (1 piece, 2 score, 3 type), TrainerSpec
    (3 model_type, 40 to 43 ids of special pieces) and NormalizerSpec (1 name, 3 to 5 switches); 2 is the type UNKNOWN and the model type BPE.
    """
    piece = lambda name, score, kind: _block(1, _block(1, name.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + _varint(kind))
    number = lambda field, n: _varint(field << 3) + _varint(n & (1 << 64) - 1)
    trainer = number(3, 2) + number(40, 0) + number(41, -1) + number(42, -1) + number(43, -1)
    normalizer = _block(1, b"identity") + number(3, 0) + number(4, 0) + number(5, 0)
    return b"".join([piece("<unk>", 0.0, 2), *(piece(n, -float(i), 1) for i, n in enumerate(names)), _block(2, trainer), _block(3, normalizer)])


class Ranks(Bpe):
    """A file of ranks (base64 token, blank, rank per line) as a sentencepiece model. Ranks below 2^24 are exact as scores.

    Texts are cut into chunks and finished chunks kept as in ``Bpe``; pre-tokens are merged by the model.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            ranks = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(bytes.strip, f)))
        back = byte_alphabet()
        self.letters = {b: c for c, b in back.items()}
        self.ids = [rank for rank, _ in ranks]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise("".join(map(self.letters.__getitem__, token)) for _, token in ranks))
        # decoding reads the model's own pieces
        self.table = {rank: bytes(map(back.__getitem__, self.model.id_to_piece(i + 1))) for i, rank in enumerate(self.ids)}
        self.find, self.words, self.split = regex.compile(pattern).findall, Words(self), None
        self.merged: dict[str, bytes] = {}

    def encode_word(self, word: str) -> bytes:
        mapped = "".join(map(self.letters.__getitem__, word.encode()))
        whole = self.model.piece_to_id(mapped)  # a word that is a token stays whole, whatever its merges are
        found = [whole] if whole else self.model.encode(mapped)
        return struct.pack(f"<{len(found)}I", *(self.ids[i - 1] for i in found))

    def encode_plain(self, text: str) -> bytes:
        out, known = [], self.merged
        if len(known) >= MAX_WORDS:
            known.clear()
        for word in self.find(text):
            ids = known.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(word) <= 64:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, memoryview(ids).cast("I")))


@lru_cache(2)
def load(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def encode_column(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids binary, decoded binary) of every whole text; null texts count as empty, and an empty text has no ids. One pass, no shuffle.

    path and pattern: a file of ranks that all executors can read, and its pre-tokenizer, by default those of the tokenizers folder. Texts are
    cut before blanks and line feeds first, so the pattern must never join a word with a blank or line feed after it, nor two words over one blank.
    Strings of special tokens are plain text. Repeated keys give repeated rows, null keys stay null, ties between equal pairs go to the left; other
    columns are left out, so none can clash. An empty table gives an empty one. Words of any length take time and memory in proportion
    (times a logarithm); a worker holds one slice of a batch, and at most ``MAX_WORDS`` finished words and chunks of up to 64 characters.
    """

    def run(batches):
        import public_tokenizers

        coder = load(path or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
        for batch in batches:
            for part in cut(batch, 1):
                ids = [coder.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.binary())], names=[key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids binary, decoded binary")


def op13_pieces(spark, sf_dir: str) -> DataFrame:
    out = encode_column(read(spark, sf_dir, "documents"))
    return out.select("doc_id", n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
