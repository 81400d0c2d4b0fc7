"""Media columns in Matroska: payloads are stored as 8-bit samples of an audio track and read back as packets.

``elements`` walks variable-length EBML elements, ``parse`` turns clusters, laced blocks and cues into packet and cue
tables with timestamps, tracks and byte ranges, and ``mux`` writes the files.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut

#: Element ids of the format.
EBML, EBML_VERSION, EBML_READ, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING, CODEC, AUDIO, RATE, CHANNELS, BIT_DEPTH, FRAME_NS = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
UNKNOWN = -1

SAMPLE_RATE, FRAME, FRAMES, CLUSTER_BYTES, UNIT = 8000, 512, 8, 65536, 64


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """(value, length) of the variable-length integer at ``at``; an all-ones size is UNKNOWN."""
    first = data[at]
    if not first:
        raise ValueError(f"no length marker at byte {at}")
    n = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return value, n
    value &= (1 << 7 * n) - 1
    return (UNKNOWN if value == (1 << 7 * n) - 1 else value), n


def size_vint(value: int) -> bytes:
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """(flag bits, head) for the frames of one block: fixed sizes where all are equal, else EBML lacing."""
    if len(frames) == 1:
        return 0, b""
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 0x04, bytes([len(frames) - 1])
    head = [bytes([len(frames) - 1]), size_vint(sizes[0])]
    for a, b in zip(sizes, sizes[1:-1]):
        n = 1
        while not -((1 << 7 * n - 1) - 1) <= b - a <= (1 << 7 * n - 1) - 1:
            n += 1
        head.append(((b - a + (1 << 7 * n - 1) - 1) | 1 << 7 * n).to_bytes(n, "big"))
    return 0x06, b"".join(head)


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges (offset, length) of the frames in a block's body. kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not kind:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % n:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // n] * (n - 1)
    elif kind == 1:
        sizes = []
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        sizes = []
        for i in range(n - 1):
            value, k = vint(data, at)
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * k - 1) - 1))
            at += k
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    if at > end or min(sizes, default=0) < 0:
        raise ValueError("laced frames run over their block")
    return [*out, (at, end - at)]


def elements(data: bytes, at: int = 0, end: int | None = None):
    """(id, offset, body offset, body end) of each element of one level. A cluster or segment of unknown size ends with its parent."""
    end = len(data) if end is None else end
    while at < end:
        ident, n = vint(data, at, True)
        size, k = vint(data, at + n)
        body = at + n + k
        stop = end if size == UNKNOWN else body + size
        if size == UNKNOWN and ident == CLUSTER:
            stop, level1 = body, {CLUSTER, CUES, INFO, TRACKS}
            while stop < end and (nxt := vint(data, stop, True))[0] not in level1:
                s, k = vint(data, stop + nxt[1])
                stop += nxt[1] + k + s
        if stop > end:
            raise ValueError(f"element {ident:x} at byte {at} runs over its parent")
        yield ident, at, body, stop
        at = stop


def mux(payload: bytes) -> bytes:
    """A Matroska file of one track of unsigned 8-bit samples; the same payload gives the same bytes."""
    per_ms = SAMPLE_RATE // 1000
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXER, b"stratum") + element(WRITER, b"stratum") + element(DURATION, struct.pack(">d", len(payload) / per_ms)))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(LACING, 1) + number(FRAME_NS, FRAME // per_ms * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + audio
    head = info + element(TRACKS, element(TRACK, track))
    parts, cues, where = [head], [], len(head)
    for at in range(0, len(payload), CLUSTER_BYTES):
        own, body = payload[at : at + CLUSTER_BYTES], [number(TIMESTAMP, at // per_ms)]
        for b in range(0, len(own), FRAME * FRAMES):
            frames = [own[i : i + FRAME] for i in range(b, min(b + FRAME * FRAMES, len(own)), FRAME)]
            flags, laced = lace(frames)
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b // per_ms, 0x80 | flags) + laced + b"".join(frames)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, number(CUE_TIME, at // per_ms) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, where))))
        parts.append(cluster)
        where += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    header = number(EBML_VERSION, 1) + number(EBML_READ, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ, 2)
    return element(EBML, header) + element(SEGMENT, b"".join(parts))


def parse(data: bytes) -> dict:
    """Packet rows (track, timestamp in ns, offset, length, keyframe, cluster offset), cue rows (time in ns, track, cluster offset) and tracks."""
    out: dict = {"packets": [], "cues": [], "tracks": {}, "scale": 1_000_000}
    uint = lambda a, b: int.from_bytes(data[a:b], "big")

    def block(a: int, b: int, cluster: int, base: int, simple: bool) -> None:
        track, n = vint(data, a)
        rel, flags = struct.unpack_from(">hB", data, a + n)
        ns = (base + rel) * out["scale"]
        step = out["tracks"].get(track, {}).get("frame_ns", 0)
        for i, (at, size) in enumerate(unlace(data, a + n + 3, b, flags >> 1 & 3)):
            out["packets"].append((track, ns + i * step, at, size, bool(flags & 0x80) if simple else None, cluster))

    for ident, _, a, b in elements(data):
        if ident != SEGMENT:
            continue
        start = a
        for ident, at, a, b in elements(data, start, b):
            if ident == INFO:
                for k, _, x, y in elements(data, a, b):
                    if k == TIMESTAMP_SCALE:
                        out["scale"] = uint(x, y)
            elif ident == TRACKS:
                for k, _, x, y in elements(data, a, b):
                    own = {i: (p, q) for i, _, p, q in elements(data, x, y)} if k == TRACK else {}
                    if TRACK_NUMBER in own:
                        out["tracks"][uint(*own[TRACK_NUMBER])] = {"codec": data[slice(*own[CODEC])].decode(), "type": uint(*own[TRACK_TYPE]), "frame_ns": uint(*own[FRAME_NS]) if FRAME_NS in own else 0}
            elif ident == CLUSTER:
                base = 0
                for k, _, x, y in elements(data, a, b):
                    if k == TIMESTAMP:
                        base = uint(x, y)
                    elif k == SIMPLE_BLOCK:
                        block(x, y, at - start, base, True)
                    elif k == BLOCK_GROUP:
                        for g, _, p, q in elements(data, x, y):
                            if g == BLOCK:
                                block(p, q, at - start, base, False)
            elif ident == CUES:
                for k, _, x, y in elements(data, a, b):
                    own = {i: (p, q) for i, _, p, q in elements(data, x, y)} if k == CUE_POINT else {}
                    if CUE_POSITIONS in own:
                        pos = {i: uint(p, q) for i, _, p, q in elements(data, *own[CUE_POSITIONS])}
                        out["cues"].append((uint(*own[CUE_TIME]) * out["scale"], pos[CUE_TRACK], pos[CUE_CLUSTER]))
    return out


def samples(data: bytes, found: dict, track: int = 1) -> bytes:
    """The stored samples of a track, packet by packet."""
    return b"".join([data[at : at + n] for t, _, at, n, *_ in found["packets"] if t == track])


def feature(stored: bytes, found: dict) -> str:
    """Duration, level, spread, zero crossings, peak, entropy and the shape of the packet table as one string."""
    x = np.frombuffer(stored, np.uint8)
    counts = np.bincount(x, minlength=256)
    values, n = np.arange(256) - 128, max(len(x), 1)
    mean, power = counts @ values / n, counts @ values**2 / n
    p = counts[counts > 0] / n
    above = x >= 128
    crossings = np.count_nonzero(above[1:] != above[:-1])
    peak = int(np.abs(values[counts > 0]).max()) if len(x) else 0
    return f"ms={len(x) * 1000 // SAMPLE_RATE};mean={mean:.4f};rms={power**0.5:.4f};zcr={crossings / n:.6f};peak={peak};entropy={-(p * np.log2(p)).sum() + 0.0:.4f};packets={len(found['packets'])};cues={len(found['cues'])}"


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def media_column(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media, payload, feature): every whole text stored in Matroska and its payload read back from the packets.

    Null texts count as empty; an empty text's payload is one unit of zeros. Repeated keys give repeated rows, equal texts
    equal media; other columns are left out, so none can clash. One pass, no shuffle; memory holds a few documents.
    """
    kind = to_arrow_type(docs.schema[key].dataType)

    def run(batches):
        for batch in batches:
            for part in cut(batch, 1, 256):
                rows = []
                for t in part.column(1).to_pylist():
                    raw = (t or "").encode()
                    data = mux(pad(raw))
                    found = parse(data)
                    stored = samples(data, found)
                    rows.append((len(raw), data, stored, feature(stored, found)))
                cols = zip(*rows)
                types = [pa.int64(), pa.binary(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(kind), *(pa.array(c, t) for c, t in zip(cols, types))], names=[key, "n_bytes", "media", "payload", "feature"])

    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes bigint, media binary, payload binary, feature string")


def packet_table(media: DataFrame, data: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per packet (key, packet, track, timestamp_ns, byte_offset, byte_length, keyframe, cluster_offset); null media have none, damaged files fail."""
    kind = to_arrow_type(media.schema[key].dataType)
    types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
    names = [key, "packet", "track", "timestamp_ns", "byte_offset", "byte_length", "keyframe", "cluster_offset"]

    def run(batches):
        for batch in batches:
            for k, d in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(k, i, *p) for i, p in enumerate(parse(d.as_py())["packets"])] if d.is_valid else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return media.select(key, data).mapInArrow(run, f"`{key}` {media.schema[key].dataType.simpleString()}, packet bigint, track bigint, timestamp_ns bigint, byte_offset bigint, byte_length bigint, keyframe boolean, cluster_offset bigint")


def op3_media(spark, sf_dir: str) -> DataFrame:
    out = media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
