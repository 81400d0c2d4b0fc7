"""Pages of PDF files: cross-reference tables and streams, object streams and the page tree, one row per page.

Only the structure is read, nothing is rendered. Spark reads and deals out the files; a file is parsed where it lies.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import discover

OUT = "path string, pdf_page int, n_pages int, width double, height double, rotation int, error string"
#: Bytes that one compressed stream of a file's structure may have when unpacked; a larger one is an error.
MAX_STREAM = 1 << 28
MAX_DEPTH = 64
_TOKEN = re.compile(rb"(?:[\0\t\n\x0c\r ]|%[^\r\n]*)*+(<<|>>|\[|\]|\(|<[0-9A-Fa-f\0\t\n\x0c\r ]*>|/[^\0\t\n\x0c\r ()<>\[\]{}/%]*|[^\0\t\n\x0c\r ()<>\[\]{}/%]+)")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+obj\b")
_REFERENCE = re.compile(rb"[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+R(?![A-Za-z])")
_INTEGER, _DECIMAL, _ESCAPE = re.compile(rb"[+-]?\d+"), re.compile(rb"[+-]?(\d+\.\d*|\.\d+)"), re.compile(rb"\\.|[()]", re.S)
_START, _XREF, _HEAD, _TRAILER = re.compile(rb"startxref[\0\t\n\x0c\r ]+(\d+)"), re.compile(rb"[\0\t\n\x0c\r ]*xref"), re.compile(rb"[\0\t\n\x0c\r ]*(\d+)[\0\t\n\x0c\r ]+(\d+)(?=[\0\t\n\x0c\r ])"), re.compile(rb"[\0\t\n\x0c\r ]*trailer")
_ENTRY = re.compile(rb"[\0\t\n\x0c\r ]*(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+([nf])")


class Damaged(ValueError):
    """A file whose pages can't be found."""


class Ref(int):
    """A reference to an object by its number."""


def parse(data: bytes, at: int, depth: int = 0):
    """(value, end) of the object at a place: dictionaries, lists, numbers, names as text with their slash, references, and None for null and strings."""
    m = _TOKEN.match(data, at)
    if not m or depth > MAX_DEPTH:
        raise Damaged("object expected")
    token, at = m[1], m.end()
    if token == b"<<" or token == b"[":
        close, items = (b">>" if token == b"<<" else b"]"), []
        while True:
            m = _TOKEN.match(data, at)
            if not m:
                raise Damaged("open dictionary or list")
            if m[1] == close:
                break
            value, at = parse(data, at, depth + 1)
            items.append(value)
        return (dict(zip(items[::2], items[1::2])) if token == b"<<" else items), m.end()
    if token == b"(":
        level = 1
        for m in _ESCAPE.finditer(data, at):
            level += (m[0] == b"(") - (m[0] == b")")
            if not level:
                return None, m.end()
        raise Damaged("open string")
    if token[:1] == b"/":
        return token.decode("latin-1"), at
    if _INTEGER.fullmatch(token):
        m = _REFERENCE.match(data, at)
        return (Ref(token), m.end()) if m else (int(token), at)
    if _DECIMAL.fullmatch(token):
        return float(token), at
    return None, at


def unpredicted(data: bytes, width: int) -> bytes:
    """Rows of PNG predictors undone, one byte a sample."""
    out, last = bytearray(), bytearray(width)
    for i in range(0, len(data) - width, width + 1):
        kind, row = data[i], bytearray(data[i + 1 : i + 1 + width])
        for j in range(width):
            a, b, c = (row[j - 1], last[j], last[j - 1]) if j else (0, last[j], 0)
            nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            row[j] = (row[j] + (0, a, b, (a + b) // 2, nearest)[kind if kind < 5 else 0]) & 255
        out += row
        last = row
    return bytes(out)


class Pdf:
    """The objects of one file by number, found through its cross-references, or by a search for objects where those are damaged."""

    def __init__(self, data: bytes) -> None:
        self.data, self.places, self.trailer, self.held = data, {}, {}, {}
        try:
            self.read_references()
            self.found = self.pages()
        except (Damaged, ValueError, IndexError, KeyError, TypeError, AttributeError, zlib.error):
            self.places, self.trailer, self.held = {}, {}, {}
            self.search()

    def read_references(self) -> None:
        start = _START.search(self.data[self.data.rfind(b"startxref") :] if b"startxref" in self.data else b"")
        if not start:
            raise Damaged("no startxref")
        todo, seen = [int(start[1])], set()
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            m = _XREF.match(self.data, at)
            trailer = self.read_table(m.end()) if m else self.read_stream(at)
            self.trailer = trailer | self.trailer
            # newer tables come first and win
            todo += [int(trailer[k]) for k in ("/Prev", "/XRefStm") if isinstance(trailer.get(k), int)]

    def read_table(self, at: int) -> dict:
        while m := _HEAD.match(self.data, at):
            at = m.end()
            for number in range(int(m[1]), int(m[1]) + int(m[2])):
                e = _ENTRY.match(self.data, at)
                if not e:
                    raise Damaged("bad table of cross-references")
                at = e.end()
                if e[3] == b"n":
                    self.places.setdefault(number, (1, int(e[1])))
        m = _TRAILER.match(self.data, at)
        if not m:
            raise Damaged("no trailer")
        return parse(self.data, m.end())[0]

    def read_stream(self, at: int) -> dict:
        head, body = self.stream(at)
        w, size = head["/W"], head["/Size"]
        index, rows, width = head.get("/Index", [0, size]), iter(range(0, len(body), sum(w))), w
        for first, n in zip(index[::2], index[1::2]):
            for number, i in zip(range(first, first + n), rows):
                cut = [i, i + width[0], i + width[0] + width[1], i + sum(width)]
                kind, a, b = (int.from_bytes(body[x:y], "big") for x, y in zip(cut, cut[1:]))
                if (kind if width[0] else 1) in (1, 2):
                    self.places.setdefault(number, (kind if width[0] else 1, a, b))
        return head

    def search(self) -> None:
        """Objects by their heads, the last of each number; then those inside object streams."""
        found = {int(m[1]): (1, m.start()) for m in _OBJECT.finditer(self.data)}
        self.places = dict(found)
        for number, (_, at) in sorted(found.items()):
            try:
                head = parse(self.data, _OBJECT.match(self.data, at).end())[0]
                if isinstance(head, dict) and head.get("/Type") == "/ObjStm":
                    self.places |= {n: (2, number, 0) for n in self.inner(number) if n not in found}
                elif isinstance(head, dict) and head.get("/Type") == "/Catalog":
                    self.trailer["/Root"] = Ref(number)
            except (Damaged, zlib.error, ValueError, TypeError, KeyError):
                continue
        if "/Root" not in self.trailer:
            inner = [n for n, p in self.places.items() if p[0] == 2 and isinstance(v := self.get(Ref(n)), dict) and v.get("/Type") == "/Catalog"]
            if not inner:
                raise Damaged("no page tree")
            self.trailer["/Root"] = Ref(inner[-1])
        self.found = self.pages()

    def stream(self, at: int) -> tuple[dict, bytes]:
        m = _OBJECT.match(self.data, at) or _OBJECT.search(self.data, at, at + 32)
        if not m:
            raise Damaged("object expected")
        head, end = parse(self.data, m.end())
        s = re.compile(rb"[\0\t\n\x0c\r ]*stream(\r\n|\n|\r)").match(self.data, end)
        if not s or not isinstance(head, dict):
            raise Damaged("stream expected")
        length = self.get(head.get("/Length"))
        if not isinstance(length, int) or not re.compile(rb"[\0\t\n\x0c\r ]*endstream").match(self.data, s.end() + length):
            length = self.data.find(b"endstream", s.end()) - s.end()
        raw = self.data[s.end() : s.end() + max(length, 0)]
        filters = [f for f in ([head.get("/Filter")] if not isinstance(head.get("/Filter"), list) else head["/Filter"]) if f]
        if filters == ["/FlateDecode"]:
            unpack = zlib.decompressobj()
            raw = unpack.decompress(raw, MAX_STREAM)
            if unpack.unconsumed_tail:
                raise Damaged("stream too large")
            options = self.get(head.get("/DecodeParms")) or {}
            options = (options[0] or {}) if isinstance(options, list) else options
            if options.get("/Predictor", 1) >= 10:
                raw = unpredicted(raw, options.get("/Columns", 1))
        elif filters:
            raise Damaged("unknown filter")
        return head, raw

    def inner(self, number: int) -> dict[int, object]:
        """The objects of an object stream."""
        if number not in self.held:
            head, body = self.stream(self.places[number][1])
            pairs = [int(x) for x in body[: head["/First"]].split()]
            self.held[number] = {n: parse(body, head["/First"] + at)[0] for n, at in zip(pairs[: 2 * head["/N"] : 2], pairs[1 : 2 * head["/N"] : 2])}
        return self.held[number]

    def get(self, value):
        """An object itself where it is a reference."""
        for _ in range(MAX_DEPTH):
            if not isinstance(value, Ref):
                return value
            place = self.places.get(int(value))
            if not place:
                return None
            if place[0] == 2:
                value = self.inner(place[1]).get(int(value))
                continue
            m = _OBJECT.match(self.data, place[1]) or _OBJECT.search(self.data, place[1], place[1] + 32)
            if not m or int(m[1]) != int(value):
                raise Damaged("object is not where the table says")
            value = parse(self.data, m.end())[0]
        raise Damaged("references in a ring")

    def pages(self) -> list[tuple]:
        """(width, height, rotation) of each page in order; box and rotation are inherited."""
        root = self.get(self.trailer.get("/Root"))
        if not isinstance(root, dict) or "/Pages" not in root:
            raise Damaged("encrypted" if "/Encrypt" in self.trailer else "no page tree")
        out, stack, seen = [], [(root["/Pages"], {})], set()
        while stack:
            ref, above = stack.pop()
            if isinstance(ref, Ref):
                if int(ref) in seen:
                    raise Damaged("page tree in a ring")
                seen.add(int(ref))
            node = self.get(ref)
            if not isinstance(node, dict):
                raise Damaged("page is missing")
            own = above | {k: node[k] for k in ("/MediaBox", "/Rotate") if k in node}
            kids = self.get(node.get("/Kids"))
            if isinstance(kids, list):
                stack += [(k, own) for k in reversed(kids)]
                continue
            box = [self.get(v) for v in self.get(own.get("/MediaBox")) or []]
            sized = len(box) == 4 and all(isinstance(v, (int, float)) for v in box)
            turn = self.get(own.get("/Rotate"))
            out.append((abs(float(box[2] - box[0])) if sized else None, abs(float(box[3] - box[1])) if sized else None, turn % 360 if isinstance(turn, int) else 0))
        return out


def page_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, pdf_page, n_pages, width, height, rotation, error): one row per page of each file, pages from 0; a damaged file is one row with an error.

    Box sizes are in points, null where a page has none. A null content is damaged, a file without pages gives no row, repeated files repeated rows.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    pages = Pdf(data.as_py() or b"").found
                    rows += [(name, i, len(pages), *p, None) for i, p in enumerate(pages)]
                except (Damaged, ValueError, IndexError, KeyError, TypeError, AttributeError, zlib.error) as e:  # whatever a damaged file holds
                    rows.append((name, None, None, None, None, None, str(e) if isinstance(e, Damaged) else "damaged"))
            if rows:
                types = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in OUT.split(", ")])

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, OUT)


def discover_pages(spark: SparkSession, root: str) -> DataFrame:
    """Scans below a folder, one row per image and per PDF page: (path, relative_path, source_kind, size_bytes, modified, pdf_page, error).

    Only PDF files are opened. A page's size is its file's share, one byte at least.
    """
    found = discover(spark, root)
    images = found.where("source_kind = 'image'").select("*", F.lit(None).cast("int").alias("pdf_page"), F.lit(None).cast("string").alias("error"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root).select("path", "content")
    pages = page_rows(files).select("path", "pdf_page", "n_pages", "error")
    pdfs = found.where("source_kind = 'pdf'").join(pages, "path").withColumn("size_bytes", F.greatest(F.lit(1), F.floor(F.col("size_bytes") / F.coalesce("n_pages", F.lit(1)))).cast("bigint"))
    return images.unionByName(pdfs.drop("n_pages"))
