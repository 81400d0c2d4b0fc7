"""Shapefiles as a Spark data source: attributes and geometries, read by ranges of records, with predicates on attributes pushed to the reader.

``spark.read.format("shapefile").load("/data/survey.shp")`` after ``spark.dataSource.register(ShapefileSource)``. Predicates are pushed where
``spark.sql.python.filterPushdown.enabled`` is on. The three files must lie where workers can open them.
"""

from __future__ import annotations

import math
import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

#: Records of one task, unless the option recordsPerTask says otherwise.
RECORDS = 100_000
GEOMETRY = "shape_type int, parts array<array<array<double>>>"


@dataclass
class Field:
    name: str
    kind: str
    start: int
    size: int
    places: int

    @property
    def type(self) -> str:
        if self.kind == "L":
            return "boolean"
        if self.kind in "NF":
            return "bigint" if not self.places and self.size <= 18 and self.kind == "N" else "double"
        return "string"

    def value(self, row: bytes, encoding: str):
        raw = row[self.start : self.start + self.size].split(b"\0")[0].strip()
        if self.kind == "L":
            return {b"T": True, b"t": True, b"Y": True, b"y": True, b"F": False, b"f": False, b"N": False, b"n": False}.get(raw)
        if not raw or raw.strip(b"*") == b"":
            return None
        if self.type == "string":
            return raw.decode(encoding, "replace")
        try:
            return int(raw) if self.type == "bigint" else float(raw)
        except ValueError:
            return None


class Table:
    """The head of an attribute table: number of records, their size, and fields."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.count, self.head, self.size = struct.unpack("<4xIHH20x", f.read(32))
            self.fields, at = [], 1
            while (raw := f.read(32)) and raw[0] != 0x0D:
                name, kind, size, places = raw[:11].split(b"\0")[0].decode("latin-1"), chr(raw[11]), raw[16], raw[17]
                self.fields.append(Field(name, kind, at, size, places))
                at += size


def geometry(raw: bytes) -> tuple[int, list | None]:
    """(type, parts) of one shape; heights and measures are left out, a null shape has no parts."""
    kind = struct.unpack_from("<i", raw)[0]
    base = kind % 10 if kind in (1, 3, 5, 8, 11, 13, 15, 18, 21, 23, 25, 28) else 0
    if base == 1:
        return kind, [[list(struct.unpack_from("<2d", raw, 4))]]
    if base == 8:
        n = struct.unpack_from("<i", raw, 36)[0]
        xy = struct.unpack_from(f"<{2 * n}d", raw, 40)
        return kind, [[list(p) for p in zip(xy[::2], xy[1::2])]]
    if base in (3, 5):
        m, n = struct.unpack_from("<2i", raw, 36)
        starts = [*struct.unpack_from(f"<{m}i", raw, 44), n]
        xy = struct.unpack_from(f"<{2 * n}d", raw, 44 + 4 * m)
        points = [list(p) for p in zip(xy[::2], xy[1::2])]
        return kind, [points[a:b] for a, b in zip(starts, starts[1:])]
    return kind, None


class ShapefileSource(DataSource):
    """Columns: the attributes by their names, then shape_type and parts (array of parts, points and coordinates). Deleted records are left out.

    Options: path (the .shp file), recordsPerTask, encoding (else that of the .cpg file, else UTF-8). Blank and overflown numbers are null.
    """

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        fields = Table(_beside(self.options["path"], "dbf")).fields
        return ", ".join([*(f"`{f.name}` {f.type}" for f in fields), GEOMETRY])

    def reader(self, schema) -> DataSourceReader:
        return ShapefileReader(dict(self.options))


def _beside(path: str, suffix: str) -> str:
    """The file of the same name with another suffix, in either case."""
    base = os.path.splitext(path.removeprefix("file://"))[0]
    return next((p for p in (f"{base}.{suffix}", f"{base}.{suffix.upper()}") if os.path.exists(p)), f"{base}.{suffix}")


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.step = options["path"], int(options.get("recordspertask", options.get("recordsPerTask", RECORDS)))
        cpg = _beside(self.path, "cpg")
        self.encoding = options.get("encoding") or (open(cpg).read().strip() if os.path.exists(cpg) else "utf-8")
        self.tests: list[tuple[str, tuple | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality, IN and IS NOT NULL on attributes; the others go back to Spark."""
        names = {f.name for f in Table(_beside(self.path, "dbf")).fields}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in names and isinstance(f, EqualTo):
                self.tests.append((name, (f.value,)))
            elif name in names and isinstance(f, In):
                self.tests.append((name, tuple(f.value)))
            elif name in names and isinstance(f, IsNotNull):
                self.tests.append((name, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        n = Table(_beside(self.path, "dbf")).count
        return [InputPartition(i) for i in range(max(1, math.ceil(n / self.step)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        table = Table(_beside(self.path, "dbf"))
        first, fields = partition.value * self.step, {f.name: f for f in table.fields}
        n = min(self.step, table.count - first)
        with open(_beside(self.path, "dbf"), "rb") as rows, open(_beside(self.path, "shx"), "rb") as index, open(_beside(self.path, "shp"), "rb") as shapes:
            rows.seek(table.head + first * table.size)
            for i in range(first, first + n):
                row = rows.read(table.size)
                if row[:1] == b"*":
                    continue
                wanted = True
                for name, values in self.tests:
                    v = fields[name].value(row, self.encoding)
                    wanted = wanted and v is not None and (values is None or v in values)
                if not wanted:
                    continue
                index.seek(100 + 8 * i)
                at, words = struct.unpack(">2i", index.read(8))
                shapes.seek(2 * at + 8)
                yield (*(f.value(row, self.encoding) for f in table.fields), *geometry(shapes.read(2 * words)))
