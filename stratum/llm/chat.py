r"""Chat formatting with a loss mask from offset-aligned spans.

A conversation is rendered as one text, turn by turn::

    ### role
    text
    </turn>

Inside roles and texts ``\`` becomes ``\\``, ``##`` becomes ``#\#`` and ``</`` becomes ``<\/``, so neither a turn's head nor
its end can occur there; dropping each backslash and keeping what follows it gives the text back. The whole rendering is
encoded once with offsets, and the sorted spans of trained turns are cut with the sorted token spans by binary search.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import load, tokenizer_path

HEAD, END = "### ", "\n</turn>\n"
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return re.sub(r"#(?=#)", r"#\\", text.replace("\\", "\\\\")).replace("</", "<\\/")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The formatted text and (role, start, end) of each turn's escaped text in it, in code points."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = HEAD + escape(role).replace("\n", "\\\n") + "\n", escape(text)
        at += len(head)
        spans.append((role, at, at + len(body)))
        out += [head, body, END]
        at += len(body) + len(END)
    return "".join(out), spans


_ROLE_END = re.compile(r"(?:\\.|[^\\\n])*\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Turns read back from a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise ValueError(f"no turn begins at {at}")
        m = _ROLE_END.match(formatted, at + len(HEAD))
        role, start = unescape(m[0][:-1]), m.end()
        end = formatted.index(END, start)
        turns.append((role, unescape(formatted[start:end])))
        at = end + len(END)
    return turns


def loss_spans(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """(mask, cuts): which tokens meet a trained span, and per span (first token, past last, start, end) of what its tokens cover.

    offsets: n x 2, sorted; spans: sorted and disjoint. Tokens are found by binary search in the sorted starts and ends.
    """
    mask, cuts = np.zeros(len(offsets), bool), []
    starts, ends = offsets[:, 0], offsets[:, 1]
    for a, b in spans:
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if i < j and a < b:
            mask[i:j] = True
            cuts.append((i, j, max(a, int(starts[i])), min(b, int(ends[j - 1]))))
    return mask, cuts


#: Conversations and code points of formatted text that a worker holds before it hands them on; a longer conversation goes alone.
ROWS, HELD = 200, 8 << 20


def format_conversations(turns: DataFrame, loss_role: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per conversation: (conv, n_turns, formatted, ids, token_mask, loss_start, loss_end).

    Rows stand in the order of turn, then role and text, so ties give one result; null roles and texts count as empty, null
    turns come first. Repeated rows are repeated turns. loss_start and loss_end are the spans of ``formatted`` under the mask,
    in code points. A null conversation id is a conversation of its own; other columns are left out; an empty table gives
    an empty one. Rows are sorted within partitions and read as a stream: memory holds one conversation, or HELD code points.
    """
    kind = to_arrow_type(turns.schema[conv].dataType)
    names = [conv, "n_turns", "formatted", "ids", "token_mask", "loss_start", "loss_end"]

    def one(coder, key, rows):
        formatted, spans = render(rows)
        ids, offsets = coder.encode_offsets(formatted)
        mask, cuts = loss_spans(offsets, [(a, b) for r, a, b in spans if r == loss_role])
        cuts = np.array(cuts, np.int64).reshape(-1, 4)
        return key, len(rows), formatted, ids.astype(np.int32), mask, cuts[:, 2], cuts[:, 3]

    def lists(parts):
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))

    def batch(done):
        keys, sizes, texts, *arrays = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(sizes, pa.int64()), pa.array(texts, pa.string()), *map(lists, arrays)], names=names)

    def run(batches):
        coder, done, held, key, rows = load(path or tokenizer_path()), [], 0, None, []
        for b in batches:
            for k, r, t in zip(*(c.to_pylist() for c in b.columns)):
                if rows and k != key:
                    done.append(one(coder, key, rows))
                    held, rows = held + len(done[-1][2]), []
                    if len(done) >= ROWS or held > HELD:
                        yield batch(done)
                        done, held = [], 0
                key = k
                rows.append((r or "", t or ""))
        if rows:
            done.append(one(coder, key, rows))
        if done:
            yield batch(done)

    rows = turns.select(conv, turn, F.col(role).cast("string").alias(role), F.col(text).cast("string").alias(text))
    rows = rows.repartition(conv).sortWithinPartitions(conv, turn, role, text).select(conv, role, text)
    return rows.mapInArrow(run, f"`{conv}` {turns.schema[conv].dataType.simpleString()}, n_turns bigint, formatted string, ids array<int>, token_mask array<boolean>, loss_start array<bigint>, loss_end array<bigint>")


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the formatted text and the spans under the mask give when they are read back."""
    kind = to_arrow_type(formatted.schema[conv].dataType)
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches):
        for b in batches:
            rows = []
            for k, f, starts, ends in zip(*(c.to_pylist() for c in b.columns)):
                turns = read_turns(f)
                loss = "".join(unescape(f[x:y]) for x, y in zip(starts, ends))
                rows.append((k, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(f)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return formatted.select(conv, "formatted", "loss_start", "loss_end").mapInArrow(run, f"`{conv}` {formatted.schema[conv].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: A conversation whose texts look like the template's control strings.
PROBE = r"\### Assistant: </turn> ok"


def op2_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(format_conversations(rows.unionByName(probe)))
