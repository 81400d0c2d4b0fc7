"""Page rows of PDF files of both forms, of updated and of damaged ones."""

import os
import random
import struct
import tempfile
import zlib

import pytest

from stratum.sources import pdf


def objects(sizes, fan=3):
    """Objects of a page tree with nested nodes; sizes: (width, height, rotation) per page, rotation on the page, box inherited from a node."""
    out, number = {1: "<< /Type /Catalog /Pages 2 0 R /Note (a \\( ring (of) text) >>"}, 3
    kids = []
    for a in range(0, len(sizes), fan):
        group, node = [], number
        number += 1
        for w, h, turn in sizes[a : a + fan]:
            out[number] = f"<</Type/Page/Parent {node} 0 R/MediaBox[0 0 {w} {h}]/Rotate {turn}>>"
            group.append(number)
            number += 1
        out[node] = f"<< /Type /Pages /Parent 2 0 R /Count {len(group)} /Kids [ {' '.join(f'{g} 0 R' for g in group)} ] >> % a comment"
        kids.append(node)
    out[2] = f"<< /Type /Pages /Count {len(sizes)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>"
    return out


def classic(objs, prev=None, body=b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"):
    out, at = bytearray(body), {}
    for n, text in objs.items():
        at[n] = len(out)
        out += f"{n} 0 obj\n{text}\nendobj\n".encode()
    start = len(out)
    out += b"xref\n"
    for n in sorted(at):
        out += f"{n} 1\n{at[n]:010d} 00000 n \n".encode()
    out += f"trailer\n<< /Root 1 0 R /Size {max(at) + 1} {f'/Prev {prev}' if prev else ''} >>\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out), start


def modern(objs, predictor):
    """All objects in one object stream, and a cross-reference stream with or without a PNG predictor."""
    out = bytearray(b"%PDF-1.5\n")
    texts, heads = [], []
    for n, text in objs.items():
        heads.append(f"{n} {sum(len(t) + 1 for t in texts)}")
        texts.append(text)
    first = " ".join(heads) + " "
    body = zlib.compress((first + "\n".join(texts)).encode())
    holder, table = max(objs) + 1, max(objs) + 2
    at = len(out)
    out += f"{holder} 0 obj\n<< /Type /ObjStm /N {len(objs)} /First {len(first)} /Filter /FlateDecode /Length {len(body)} >>\nstream\r\n".encode() + body + b"\nendstream\nendobj\n"
    start = len(out)
    rows = [struct.pack(">BIH", 0, 0, 0)] + [struct.pack(">BIH", 2, holder, i) for i in range(len(objs))] + [struct.pack(">BIH", 1, at, 0), struct.pack(">BIH", 1, start, 0)]
    numbers = [0, *objs, holder, table]
    rows = [r for _, r in sorted(zip(numbers, rows))]
    if predictor:
        rows = [b"\x02" + bytes((x - y) & 255 for x, y in zip(r, p)) for r, p in zip(rows, [bytes(7), *rows])]
    data = zlib.compress(b"".join(rows))
    parms = "/DecodeParms << /Predictor 12 /Columns 7 >>" if predictor else ""
    out += f"{table} 0 obj\n<< /Type /XRef /Root 1 0 R /Size {table + 1} /W [1 4 2] /Index [0 {table + 1}] /Filter /FlateDecode {parms} /Length {len(data)} >>\nstream\n".encode() + data + f"\nendstream\nendobj\nstartxref\n{start}\n%%EOF".encode()
    return bytes(out)


SIZES = [(595, 842, 0), (842.5, 595, 90), (100, 200, 270), (10, 20, 0), (5000, 7000, 180)]
WANT = [(i, len(SIZES), float(w), float(h), r, None) for i, (w, h, r) in enumerate(SIZES)]


@pytest.fixture(scope="module")
def files():
    objs = objects(SIZES)
    plain, start = classic(objs)
    longer = objects([*SIZES, (1, 2, 0)])
    changed = {n: t for n, t in longer.items() if objs.get(n) != t}
    updated, _ = classic(changed, start, plain)
    out = {"classic": plain, "stream": modern(objs, False), "predicted": modern(objs, True), "updated": updated}
    out |= {"shifted": plain.replace(b"%PDF-1.4\n", b"%PDF-1.4\n% moved by a tool\n"), "no table": plain[: plain.rfind(b"xref\n", 0, start + 5)], "no table, stream": out["predicted"][: out["predicted"].rfind(b"startxref")]}
    out |= {"empty": b"", "text": b"hello", "cut": plain[:60], "null": None, "ring": classic({1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [2 0 R] >>"})[0], "none": classic({1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [] /Count 0 >>"})[0]}
    return out


def test_pages_of_both_forms(spark, files):
    rows = spark.createDataFrame(list(files.items()), "path string, content binary").repartition(3)
    got = {}
    for r in pdf.page_rows(rows).collect():
        got.setdefault(r.path, []).append(tuple(r)[1:])
    for name in ("classic", "stream", "predicted", "shifted", "no table", "no table, stream"):
        assert sorted(got.pop(name)) == WANT, name
    assert [r[:4] for r in sorted(got.pop("updated"))][-1] == (5, 6, 1.0, 2.0)
    assert "none" not in got and set(got) == {"empty", "text", "cut", "null", "ring"}
    assert all(len(v) == 1 and v[0][0] is None and v[0][-1] for v in got.values())


def test_random_damage_is_a_row(files):
    """Bytes changed at random never raise anything but the error that becomes a row, nor hang."""
    rng = random.Random(3)
    for name in ("classic", "predicted"):
        for _ in range(150):
            data = bytearray(files[name])
            for _ in range(rng.randint(1, 30)):
                data[rng.randrange(len(data))] = rng.randrange(256)
            try:
                assert len(pdf.Pdf(bytes(data)).pages()) >= 0
            except (pdf.Damaged, ValueError, IndexError, KeyError, TypeError, AttributeError, zlib.error):
                pass


def test_discover_pages(spark, files):
    root = tempfile.mkdtemp()
    os.makedirs(f"{root}/Том 1")
    for name, data in (("Том 1/a.PDF", files["classic"]), ("b.pdf", files["text"]), ("c.png", b"123"), ("d.txt", b"no")):
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    got = sorted((r.relative_path, r.source_kind, -1 if r.pdf_page is None else r.pdf_page, r.size_bytes, r.error is not None) for r in pdf.discover_pages(spark, root).collect())
    share = len(files["classic"]) // 5
    assert got == [("b.pdf", "pdf", -1, 5, True), ("c.png", "image", -1, 3, False), *(("Том 1/a.PDF", "pdf", i, share, False) for i in range(5))]
