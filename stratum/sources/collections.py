"""GeoJSON feature collections of any size: one huge file is read by many tasks, each a range of bytes.

A range in the middle of a file doesn't show whether it starts inside a text, nor how deep. So the ranges are first summed up for both cases
(quotes, change and least of the depth); a window over these sums tells the state at each start. Only ranges that touch the outermost
object are read for its members, and then each range gives the features that start in it. Nothing but sums of ranges is ordered by file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import Scratch

#: Bytes of one range, and of one read within it.
RANGE = 64 << 20
READ = 4 << 20

FEATURE = "type string, geometry struct<type: string, coordinates: string>, properties string, _corrupt_record string"
KIND = np.zeros(256, np.int8)
KIND[[ord(c) for c in '"']] = 1
KIND[[ord(c) for c in "{["]] = 2
KIND[[ord(c) for c in "}]"]] = 3


class Bytes:
    """Ranges of one file on any file system that Arrow knows."""

    def __init__(self, path: str) -> None:
        scheme, _, rest = path.partition(":")
        if not rest or scheme == "file":
            system, inner = fs.LocalFileSystem(), "/" + rest.lstrip("/") if rest else path
        else:
            host, _, tail = rest.lstrip("/").partition("/")
            system, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
            inner = f"{base.rstrip('/')}/{tail}"
        self.file = system.open_input_file(inner)
        self.size = self.file.size()

    def __enter__(self) -> Bytes:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def at(self, start: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - start)), start)

    def blocks(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        while start < min(end, self.size):
            raw = self.at(start, min(READ, end - start))
            yield start, raw
            start += len(raw)

    def escaped(self, start: int) -> bool:
        """Whether an odd run of backslashes ends before this byte."""
        run = 0
        while run < start:
            step = min(4096, start - run)
            raw = self.at(start - run - step, step)
            bare = len(raw.rstrip(b"\\"))
            run += len(raw) - bare
            if bare:
                break
        return run % 2 == 1


def marks(raw: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places and kinds of brackets and of quotes that end or start a text, and whether the next byte is escaped."""
    b = np.frombuffer(raw, np.uint8)
    slash = b == 92
    if escaped and len(b):
        slash[0] = False
    at = np.flatnonzero(KIND[b])
    kind = KIND[b[at]]
    gone = np.zeros(0, np.int64)
    if slash.any():
        p = np.flatnonzero(slash)
        first = np.flatnonzero(np.diff(p, prepend=-2) > 1)
        length = np.diff(first, append=len(p))
        gone = (p[first] + length)[length % 2 == 1]
    after = bool(len(gone)) and int(gone[-1]) == len(b)
    if escaped and len(b):
        gone = np.append(gone, 0)
    keep = (kind != 1) | ~np.isin(at, gone)
    return at[keep], kind[keep], after if len(b) else escaped


def steps(kind: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(change of depth, inside a text before) for each mark, and the state behind the last one."""
    quotes = np.cumsum(kind == 1)
    before = (quotes - (kind == 1) + inside) % 2
    change = np.where(kind == 2, 1, np.where(kind == 3, -1, 0)) * (before == 0)
    return change, before, int((inside + (quotes[-1] if len(quotes) else 0)) % 2)


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _sums(batches):
    """Per range: parity of its quotes, and change and least of the depth if it starts outside (0) or inside (1) a text."""
    for r in _rows(batches):
        out = {"parity": 0, "d0": 0, "m0": 0, "d1": 0, "m1": 0}
        with Bytes(r["path"]) as f:
            escaped = f.escaped(r["start"])
            for _, raw in f.blocks(r["start"], r["end"]):
                _, kind, escaped = marks(raw, escaped)
                for h in (0, 1):
                    change = np.cumsum(steps(kind, (out["parity"] + h) % 2)[0])
                    if len(change):
                        out[f"m{h}"] = min(out[f"m{h}"], out[f"d{h}"] + int(change.min()))
                        out[f"d{h}"] += int(change[-1])
                out["parity"] = (out["parity"] + int((kind == 1).sum())) % 2
        yield pa.RecordBatch.from_pylist([r | out], schema=pa.schema([("path", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), *((n, pa.int64()) for n in ("parity", "d0", "m0", "d1", "m1"))]))


def _state(f: Bytes, r: dict, end: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks from the start of a range with (place, kind, inside a text before, depth behind) of their marks."""
    escaped, inside, depth = f.escaped(r["start"]), r["inside"], r["depth"]
    for start, raw in f.blocks(r["start"], end):
        at, kind, escaped = marks(raw, escaped)
        change, before, inside = steps(kind, inside)
        behind = depth + np.cumsum(change)
        depth = int(behind[-1]) if len(behind) else depth
        yield start, raw, at, kind, before, behind


def _text(f: Bytes, start: int) -> tuple[str | None, int]:
    """The text whose opening quote stands at ``start``, and the place behind it; None where the file ends first or it isn't JSON."""
    held, n = b"", 256
    while len(held) < min(n, f.size - start):
        held = f.at(start, n)
        at, kind, _ = marks(held, False)
        quotes = at[kind == 1]
        if len(quotes) > 1:
            try:
                return json.loads(held[: quotes[1] + 1], strict=False), start + int(quotes[1]) + 1
            except ValueError:
                return None, start + int(quotes[1]) + 1
        n *= 8
    return None, f.size


def _skip(f: Bytes, start: int) -> int:
    """The next byte that isn't white space."""
    while raw := f.at(start, 4096):
        bare = raw.lstrip(b" \t\r\n")
        start += len(raw) - len(bare)
        if bare:
            break
    return start


def _members(batches):
    """Of the outermost object: where the array of features opens, its name, and where containers end."""
    schema = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("what", pa.string()), ("value", pa.string())])
    for r in _rows(batches):
        out = []
        with Bytes(r["path"]) as f:
            for start, _, at, kind, before, behind in _state(f, r, r["end"]):
                out += [(r["path"], start + int(p), "end", None) for p in at[(kind == 3) & (before == 0) & (behind == 1)]]
                for p in at[(kind == 1) & (before == 0) & (behind == 1)]:
                    key, stop = _text(f, start + int(p))
                    if key not in ("features", "name") or f.at(stop := _skip(f, stop), 1) != b":":
                        continue
                    stop = _skip(f, stop + 1)
                    first = f.at(stop, 1)
                    if key == "features" and first == b"[":
                        out.append((r["path"], stop, key, None))
                    elif key == "name" and first == b'"':
                        out.append((r["path"], stop, key, _text(f, stop)[0]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * 4, schema)], schema=schema)


def _features(batches):
    """The whole text of each object that starts in the range at the depth of features; what the file's end cuts off comes as it is."""
    schema = pa.schema([("path", pa.string()), ("layer", pa.string()), ("at", pa.int64()), ("feature", pa.string())])

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    for r in _rows(batches):
        rows, size, held, since = [], 0, [], None
        with Bytes(r["path"]) as f:
            for start, raw, at, kind, before, behind in _state(f, r, r["size"]):
                if start >= r["end"] and since is None:
                    break
                out = before == 0
                edge = out & (((kind == 2) & (behind == 3)) | ((kind == 3) & (behind == 2)))
                cursor = 0
                for p, k in zip(at[edge].tolist(), kind[edge].tolist()):
                    place = start + p
                    if k == 2 and raw[p] == 123 and since is None and r["opens"] < place < min(r["closes"], r["end"]):
                        since, cursor = place, p
                    elif k == 3 and since is not None:
                        held.append(raw[cursor : p + 1])
                        text = b"".join(held).decode("utf-8", "replace")
                        rows.append((r["path"], r["layer"], since, text))
                        held, since, size = [], None, size + len(text)
                        if size > READ:
                            yield pack(rows)
                            rows, size = [], 0
                        if place >= r["end"]:
                            break
                if since is not None:
                    held.append(raw[cursor:])
                elif start + len(raw) >= r["end"]:
                    break
            if since is not None:
                rows.append((r["path"], r["layer"], since, b"".join(held).decode("utf-8", "replace")))
        if rows:
            yield pack(rows)


def ranges(spark: SparkSession, root: str, size: int = RANGE, glob: str = "*.{json,geojson}") -> tuple[DataFrame, int]:
    """(path, size, start, end) of the files below a folder (or of one file), and how many ranges there are; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", F.col("length").alias("size")).where("size > 0")
    n = files.agg(F.sum(F.ceil(F.col("size") / size))).first()[0] or 0
    parts = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long"))).alias("start"))
    return parts.withColumn("end", F.least(F.col("start") + size, "size")), max(1, min(int(n), 50_000))


def collection(spark: SparkSession, root: str, layer: str | None = None, size: int = RANGE, glob: str = "*.{json,geojson}") -> DataFrame:
    """(path, layer, at, geom_type, coordinates, properties, corrupt): the features of all collections below a folder.

    ``layer`` is the collection's own name, else the file's; a layer given reads the features of its files only. ``at`` is the byte where the
    feature starts, so (path, at) is a key; coordinates and properties are JSON text, and corrupt is the text of what doesn't parse. Files
    without an array of features give nothing, and where a file ends within its features those before are kept and the cut one is
    corrupt. A second member of the same name in the outermost object replaces the first. No task holds more than its block and one feature.
    """
    parts, n = ranges(spark, root, size, glob)
    scratch = Scratch(spark, "collection")
    sums = scratch.table(parts.repartition(n).mapInArrow(_sums, "path string, size bigint, start bigint, end bigint, parity bigint, d0 bigint, m0 bigint, d1 bigint, m1 bigint"))
    earlier = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    known = sums.withColumn("inside", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2)
    pick = lambda c: F.when(F.col("inside") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    known = known.withColumn("change", pick("d")).withColumn("least", pick("m"))
    known = scratch.table(known.withColumn("depth", F.coalesce(F.sum("change").over(earlier), F.lit(0))).select("path", "size", "start", "end", "inside", "depth", "least"))
    outer = known.where("depth + least <= 1")
    events = scratch.table(outer.repartition(min(n, 200)).mapInArrow(_members, "path string, pos bigint, what string, value string"))
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    opens = events.where("what = 'features'").groupBy("path").agg(F.max("pos").alias("opens"))
    named = events.where("what = 'name'").groupBy("path").agg(F.max_by("value", "pos").alias("layer"))
    closes = events.where("what = 'end'").join(opens, "path").where("pos > opens").groupBy("path").agg(F.min("pos").alias("closes"))
    bounds = opens.join(closes, "path", "left").join(named, "path", "left").withColumn("layer", F.coalesce("layer", stem))
    if layer is not None:
        bounds = bounds.where(F.col("layer") == layer)
    placed = known.join(bounds, "path").withColumn("closes", F.coalesce("closes", "size")).where("start < closes and end > opens")
    found = placed.repartition(n).mapInArrow(_features, "path string, layer string, at bigint, feature string")
    f = found.withColumn("f", F.from_json("feature", FEATURE, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return f.select("path", "layer", "at", F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"), F.col("f._corrupt_record").alias("corrupt"))
