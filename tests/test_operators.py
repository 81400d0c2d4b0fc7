"""Operators against brute force on small data."""

import itertools
import math
import random

from pyspark.sql import functions as F

from stratum.operators import chunking, contours, entities, greedy, routing, spatial, surface
from stratum.operators.graph import Scratch, components
from stratum.sources import readers, writers
from stratum.streaming import inbox


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: root(x) for x in parent}


def test_knn(spark):
    rng = random.Random(5)
    pts = [(i, rng.uniform(0, 100) ** 1.5, rng.uniform(0, 30)) for i in range(120)]
    got = {}
    for r in spatial.knn(spark.createDataFrame(pts, "k long, x double, y double"), "k", 4, 2.0, Scratch(spark, "t")).collect():
        got.setdefault(r.k, []).append((r.rank, r.neighbour))
    for k, x, y in pts:
        want = sorted((math.hypot(x - a, y - b), j) for j, a, b in pts if j != k)[:4]
        assert [n for _, n in sorted(got[k])] == [j for _, j in want]


def test_crossings(spark):
    rng = random.Random(7)
    seg = [(i, i % 3, *(rng.uniform(0, 20) for _ in range(4))) for i in range(60)]
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    want = set()
    for s, t in itertools.combinations(seg, 2):
        a, b, c, d = s[2:4], s[4:6], t[2:4], t[4:6]
        if s[1] != t[1] and side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
            want.add((s[0], t[0]))
    df = spark.createDataFrame(seg, "k long, g int, x1 double, y1 double, x2 double, y2 double")
    assert {tuple(r) for r in surface.segment_crossings(df, "k", "g", 3.0).collect()} == want


def test_part_budget(spark):
    rows = spark.createDataFrame([(1, ["x" * 5, "y" * 10, "z" * 20, "w"])], "k long, l array<string>")
    assert [r.n_lines for r in chunking.parts(rows, "l", 20, ["k"]).orderBy("part").collect()] == [2, 1, 1]


def test_band(spark):
    rows = [(1, v) for v in (1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 3.5, 3.6, 3.7)] + [(2, 1.0)]
    got = contours.value_band(spark.createDataFrame(rows, "g int, v double"), "v", ["g"], 0.1).collect()
    assert [(r.g, round(r.low, 6), round(r.high, 6), r.n) for r in got] == [(1, 0.9, 1.6, 6)]


def test_votes(spark):
    rows = [(1, -2.8, i) for i in range(4)] + [(1, -2.9, 5), (1, -2.9, 6), (2, -2.8, 1), (2, -2.9, 2)]
    got = {r.l: (r.v, r.verdict) for r in contours.votes(spark.createDataFrame(rows, "l int, v double, o int"), "l", "v", "o").collect()}
    assert got == {1: (-2.8, "confident"), 2: (-2.8, "conflict")}


def test_suppress(spark):
    boxes = [("a", 1, 0.9, 0.0, 0.0, 10.0, 10.0), ("a", 2, 0.8, 1.0, 1.0, 9.0, 9.0), ("a", 3, 0.7, 20.0, 0.0, 30.0, 10.0)]
    df = spark.createDataFrame(boxes, "g string, k int, s double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.k for r in greedy.suppress(df, "g", "k", "s").collect()) == [1, 3]


def test_affine(spark):
    pts = [(1.0, 2.0), (3.0, 5.0), (-1.0, 4.0), (0.0, 0.0), (7.0, 1.0)]
    df = spark.createDataFrame([(x, y, 3 + 2 * x - 0.5 * y) for x, y in pts], "x double, y double, t double").withColumn("g", F.lit(1))
    r = spatial.affine_fit(df, "x", "y", "t", ["g"]).first()
    assert max(abs(r.a - 3), abs(r.b - 2), abs(r.c + 0.5)) < 1e-9


def test_harmonic_range_and_components(spark):
    cells = [(r, c, 10.0 * r if c in (0, 5) else None, 1.0) for r in range(6) for c in range(6)] + [(20, 20, None, 1.0), (30, 30, 7.0, 2.0)]
    df = spark.createDataFrame(cells, "row long, col long, fixed double, weight double")
    out = surface.harmonic(surface.constrained(surface.cell_components(df, Scratch(spark, "t")), "fixed")).collect()
    assert len(out) == 37
    z = {(r.row, r.col): r.z for r in out}
    assert abs(z[30, 30] - 7) < 1e-6 and all(-1e-6 <= v <= 50 + 1e-6 for v in z.values())


def test_contours_of_a_plane(spark):
    grid = spark.createDataFrame([(r, c, float(r + c)) for r in range(3) for c in range(3)], "row long, col long, z double")
    seg = surface.contour_segments(grid.withColumn("z", F.col("z") + 0.25), 1.0)
    for s in seg.collect():
        assert abs(s.x1 + s.y1 + 0.25 - s.level) < 1e-9 and abs(s.x2 + s.y2 + 0.25 - s.level) < 1e-9
    lines = surface.contour_lines(seg, Scratch(spark, "t")).collect()
    assert sorted(r.level for r in lines) == [1.0, 2.0, 3.0, 4.0] and not any(r.closed for r in lines)


def test_bilinear(spark):
    grid = spark.createDataFrame([(r, c, 2.0 * r + 3.0 * c if (r, c) != (0, 0) else None) for r in range(3) for c in range(3)], "row long, col long, z double")
    pts = spark.createDataFrame([(1, 1.5, 1.25), (2, 0.5, 0.5), (3, 9.0, 9.0), (4, 2.0, 2.0)], "k int, x double, y double")
    got = {r.k: r.z for r in surface.bilinear(pts, grid, 0.0, 0.0, 1.0, "k").collect()}
    assert got == {1: 7.0, 2: None, 3: None, 4: 10.0}


def test_cps3_and_xyz(spark, tmp_path):
    grid = spark.createDataFrame([(r, c, float(c), float(r), float(r + c) if (r, c) != (1, 1) else None) for r in range(3) for c in range(3)], "row long, col long, x double, y double, z double")
    lines = [r.line for r in surface.cps3_lines(grid).orderBy("n").collect()]
    values = [float(v) for line in lines for v in line.split()]
    assert values == [2.0, 1.0, 0.0, 3.0, 1e30, 1.0, 4.0, 3.0, 2.0] and len(lines[0].split()) == 5
    assert surface.xyz_lines(grid).count() == 8
    writers.write_cps3(grid, str(tmp_path / "g"))
    text = spark.read.text(str(tmp_path / "g")).collect()
    assert text[0].value.startswith("FSASCI") and len(text) == 7


def test_densify_keeps_ends(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 3.0, 0.0), (1, 2, 3.0, 4.0), (2, 0, 1.0, 1.0), (3, 0, 0.0, 0.0), (3, 1, 0.5, 0.0)]
    out = spatial.densify(spark.createDataFrame(rows, "l int, s int, x double, y double"), "l", "s", 1.0).collect()
    got = {k: [(round(r.x, 9), round(r.y, 9)) for r in sorted((r for r in out if r.l == k), key=lambda r: r.i)] for k in (1, 2, 3)}
    assert got == {1: [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (3, 2), (3, 3), (3, 4)], 2: [], 3: [(0, 0), (0.5, 0)]}


def test_aliases_lose_no_pair(spark):
    from difflib import SequenceMatcher

    rng = random.Random(11)
    names = [(i, "".join(rng.choice("аби") for _ in range(rng.randint(4, 8)))) for i in range(60)]
    df = spark.createDataFrame(names, "k long, n string").withColumn("kind", F.lit("well"))
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(names, 2) if len(a) >= 5 and 0.78 <= SequenceMatcher(None, a, b).ratio() < 1}
    assert {(r.first, r.second) for r in entities.alias_candidates(df, "k", "n", "kind").collect()} == want


def test_router_replies(spark):
    rows = [("a", '```json\n{"pages": [{"index": 0, "kind": "map", "confidence": 1.7}, {"index": 1, "kind": "poem"}]}\n```'), ("b", "no"), ("c", '{"pages": []}')]
    got = {(r.b, r["index"]): (r.kind, r.confidence, r.error) for r in routing.parse_decisions(spark.createDataFrame(rows, "b string, r string"), "b", "r").collect()}
    assert got[("a", 0)] == ("map", 1.0, None) and got[("a", 1)][2] == "unknown kind: poem" and got[("b", None)][2] == "not an object" and got[("c", None)][2] == "no pages"


def test_ocr_shapes(spark):
    rows = [(1, '{"rec_texts": ["a", "b"], "rec_scores": [0.5, 0.9], "rec_polys": [[[0, 0]], [[1, 1]]]}'), (2, '{"lines": [{"text": "c", "score": 0.7}]}'), (3, '{"text": "d"}\n{"text": "e", "score": 1}\n'), (4, "junk")]
    got = sorted((r.k, r.line_no, r.text, r.score) for r in readers.ocr_lines(spark.createDataFrame(rows, "k int, t string"), "t", "k").collect() if r.text)
    assert [(k, n, t) for k, n, t, _ in got] == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d"), (3, 1, "e")]


def test_archive(spark, tmp_path):
    import zipfile

    import pytest

    spark.dataSource.register(readers.ArchiveSource)
    good, bad = tmp_path / "a.zip", tmp_path / "b.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("d/x.txt", "hi")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../x.txt", "hi")
    assert [(r.name, r.size, bytes(r.content)) for r in spark.read.format("archive").load(str(good)).collect()] == [("d/x.txt", 2, b"hi")]
    with pytest.raises(Exception, match="refused"):
        spark.read.format("archive").load(str(bad)).collect()


def test_discover(spark, tmp_path):
    for p in ("Том 1/Текст/2.jpg", "Том 1/Текст/10.JPG", "x/r.pdf", "x/n.txt"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"1")
    got = readers.discover(spark, str(tmp_path))
    assert sorted(r.source_kind for r in got.collect()) == ["image", "image", "pdf"]


def test_intake(spark):
    roots = spark.createDataFrame([("in/A b",), ("in/C",), ("in/D",)], "root string")
    known = spark.createDataFrame([("IN/c", "C"), ("other", "D")], "root string, report_id string")
    got = {r.root: r.report_id for r in readers.intake(roots, known, "root", "report_id").collect()}
    assert set(got) == {"in/A b", "in/D"} and got["in/A b"] == "A_b" and len(got["in/D"]) == 10


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "state")
    inbox.upsert(spark, spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, s string, v int"), path, ["k"], "v")
    inbox.upsert(spark, spark.createDataFrame([(1, "c", 2)], "k int, s string, v int"), path, ["k"], "v")
    assert sorted((r.k, r.s) for r in inbox.latest(spark, path)[0].collect()) == [(1, "c"), (2, "b")]


def test_unsupported_rings(spark):
    from stratum.operators import traces

    box = lambda k, level, x, y, s: [(k, level, i, x + a * s, y + b * s) for i, (a, b) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])]
    rows = box(1, 100.0, 0.0, 0.0, 10.0) + box(2, 110.0, 3.0, 3.0, 2.0) + box(3, 100.0, 50.0, 50.0, 4.0) + box(4, 200.0, 80.0, 80.0, 4.0) + box(5, 150.0, 4.0, 4.0, 0.5)
    rings = spark.createDataFrame(rows, "ring int, level double, seq int, x double, y double")
    sources = spark.createDataFrame([(200.0, 81.0, 79.0), (150.0, 90.0, 90.0)], "level double, x double, y double")
    assert sorted(r.ring for r in traces.unsupported_rings(rings, "ring", "level", sources, 10.0, 3.0, 4.0).collect()) == [3, 5]


def test_thinning_keeps_topology():
    import numpy as np

    from stratum.operators import raster

    img = np.zeros((20, 30), bool)
    img[5:9, 3:27] = True
    out = raster.thinned(img)
    assert out.any() and not (out & ~img).any() and (out.sum(0) <= 1).all() and out.sum() >= 18


def test_simplify_keeps_corners(spark):
    from stratum.operators import traces

    rows = [(1, i, float(i), 0.0) for i in range(10)] + [(1, 10 + i, 9.0, float(i + 1)) for i in range(9)]
    got = traces.simplify(spark.createDataFrame(rows, "l int, s int, x double, y double"), "l", "s", 0.1).collect()
    assert sorted(r.s for r in got) == [0, 9, 18]


def test_thin_plate_on_a_plane(spark):
    from stratum.operators import raster

    rng = random.Random(2)
    pts = [(1, x, y, 2.0 + 0.5 * x - 0.25 * y) for x, y in ((rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(20))]
    for r in raster.thin_plate(spark.createDataFrame(pts, "map int, x double, y double, value double"), "map", 5.0).collect():
        assert abs(r.z - (2.0 + 0.5 * r.x - 0.25 * r.y)) < 1e-4


def test_thin_plate_in_the_hull(spark):
    """Marks in a triangle: nodes outside it are blank, though near."""
    from stratum.operators import raster

    pts = [(1, x, y, 2.0 + 0.5 * x) for x, y in ((0.0, 0.0), (20.0, 0.0), (0.0, 20.0), (5.0, 5.0))]
    got = raster.thin_plate(spark.createDataFrame(pts, "map int, x double, y double, value double"), "map", 5.0, hull=True).collect()
    assert len(got) == 25 and all((r.z is not None) == (r.x + r.y <= 20) for r in got)
    line = raster.thin_plate(spark.createDataFrame([(1, v, v, v) for v in (0.0, 10.0, 20.0)], "map int, x double, y double, value double"), "map", 5.0, hull=True).collect()
    assert all((r.z is not None) == (r.x == r.y) for r in line)


def test_interval_and_corridor(spark):
    from stratum.operators import traces

    values = spark.createDataFrame([(1, v / 10) for v in range(1, 12)] + [(2, 0.1), (2, 0.2)], "g int, v double")
    got = {r.g: r.step for r in contours.infer_interval(contours.interval_support(values, "v", ["g"]), ["g"]).collect()}
    assert got == {1: 0.1}
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 2.0, 0.0), (4, 50.0, 0.0)], "k int, x double, y double")
    assert {r.k: r.corridor for r in traces.corridor(pts, "k", 1.5).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_ordinals_of_many_rows(spark):
    scratch = Scratch(spark, "t")
    rows = scratch.table(spark.range(0, 300_000, 1, 4).select(F.col("id").alias("k"), F.lpad(F.col("id").cast("string"), 20, "0").alias("path")))
    got = scratch.table(routing.with_ordinals(rows, "path", scratch))
    assert tuple(got.agg(F.count("*"), F.count_if(F.col("ordinal") != F.col("k") + 1)).first()) == (300_000, 0)


def test_nearest_among_close_points(spark):
    """Right points far closer than the radius meet few left points, with the rows of all pairs."""
    rng = random.Random(8)
    left = [(k, rng.uniform(0, 200), rng.uniform(0, 200)) for k in range(60)] + [(60, 290.0, 100.0), (61, 900.0, 0.0)]
    right = [(k, float(rng.randrange(200)), float(rng.randrange(200))) for k in range(3000)] + [(5000, 200.0, 100.0)]
    want = {}
    for k, x, y in left:
        d = min((math.hypot(x - u, y - v), r) for r, u, v in right)
        if d[0] <= 100:
            want[k] = d[1]
    a, b = spark.createDataFrame(left, "l long, x double, y double"), spark.createDataFrame(right, "r long, x double, y double")
    assert {r.l: r.r for r in spatial.nearest(a, b, 100.0, "l", "r").collect()} == want and 60 in want and 61 not in want
    assert spatial.fine_radius(b, 100.0, 4.0) < 10
