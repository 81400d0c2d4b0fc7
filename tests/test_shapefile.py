"""The shapefile source against files written record by record."""

import struct
import tempfile

import pytest

from stratum.sources.shapefile import ShapefileSource

ROWS = [("7", "p1", 5, 1.5, True, (3, [[(0.0, 1.0), (2.0, 3.0)], [(4.0, 5.0), (6.0, 7.0), (8.0, 9.0)]])), ("7", "Профиль", None, None, None, (1, [[(10.0, 20.0)]])), ("8", "p3", -3, 2.25, False, (5, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]])), (None, "", 9, 0.0, True, (0, None)), ("7", "gone", 1, 1.0, True, (1, [[(0.0, 0.0)]])), ("9", "m", 12, -1.0, False, (8, [[(1.0, 2.0), (3.0, 4.0)]]))]


def shape(kind, parts):
    if kind == 0:
        return struct.pack("<i", 0)
    points = [p for part in parts for p in part]
    if kind == 1:
        return struct.pack("<i2d", 1, *points[0])
    xy = [v for p in points for v in p]
    box = struct.pack("<4d", 0, 0, 0, 0)
    if kind == 8:
        return struct.pack("<i", 8) + box + struct.pack(f"<i{len(xy)}d", len(points), *xy)
    starts = [sum(len(p) for p in parts[:i]) for i in range(len(parts))]
    return struct.pack("<i", kind) + box + struct.pack(f"<2i{len(parts)}i{len(xy)}d", len(parts), len(points), *starts, *xy)


def write(rows, damaged=()):
    base = f"{tempfile.mkdtemp()}/survey"
    fields = [(b"N_RGF", b"C", 6, 0), (b"N_PROF", b"C", 20, 0), (b"N", b"N", 8, 0), (b"X", b"N", 12, 3), (b"OK", b"L", 1, 0)]
    shp, shx = bytearray(100), bytearray(100)
    size = 1 + sum(f[2] for f in fields)
    dbf = bytearray(struct.pack("<B3xIHH20x", 3, len(rows), 32 + 32 * len(fields) + 1, size))
    for name, kind, n, places in fields:
        dbf += struct.pack("<11sc4xBB14x", name, kind, n, places)
    dbf += b"\r"
    for i, (rgf, prof, n, x, ok, geom) in enumerate(rows):
        body = b"\xff" * 8 if i in damaged else shape(*geom)
        shx += struct.pack(">2i", len(shp) // 2, (2 if i in damaged else len(body) // 2))
        shp += struct.pack(">2i", i + 1, len(body) // 2) + (body[:1] if i in damaged else body)
        put = lambda v, w: (b"" if v is None else str(v).encode()).ljust(w)[:w]
        dbf += (b"*" if prof == "gone" else b" ") + put(rgf, 6) + put(prof, 20) + put(n, 8).strip().rjust(8) + (b"*" * 12 if x is None else f"{x:12.3f}".encode()) + {True: b"T", False: b"F", None: b"?"}[ok]
    for suffix, data in (("shp", shp), ("shx", shx), ("DBF", dbf)):
        with open(f"{base}.{suffix}", "wb") as f:
            f.write(data)
    return f"{base}.shp"


@pytest.fixture
def source(spark):
    spark.dataSource.register(ShapefileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    return spark.read.format("shapefile")


def plain(r):
    return (r.N_RGF, r.N_PROF, r.N, r.X, r.OK, (r.shape_type, r.parts and [[tuple(p) for p in part] for part in r.parts]))


@pytest.mark.parametrize("step", [1, 2, 100])
def test_all_records(source, step):
    df = source.option("recordsPerTask", step).load(write(ROWS))
    assert dict(df.dtypes)["N"] == "bigint" and dict(df.dtypes)["X"] == "double"
    want = [(a, b or None, *rest) for a, b, *rest in ROWS if b != "gone"]
    assert sorted(map(plain, df.collect()), key=repr) == sorted(map(tuple, want), key=repr)
    assert source.load(write([])).count() == 0


def test_pushed_predicates_skip_records(source):
    """Shapes that a predicate on attributes leaves out aren't read at all: theirs are damaged here."""
    path = write(ROWS, damaged={2, 3, 5})
    found = source.load(path).where("N_RGF = '7'")
    assert sorted(r.N_PROF for r in found.collect()) == ["p1", "Профиль"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan shapefile" in plan and "Filter" not in plan.replace("RuntimeFilters", "")  # nothing is left for Spark to test
    assert [r.N_PROF for r in source.load(path).where("N in (5, 77) and X > 1").collect()] == ["p1"]
    with pytest.raises(Exception):
        source.load(path).collect()
