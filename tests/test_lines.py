"""Lists, ordered lines, straight segments, label matches and transforms against plain computations."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.operators import lines, profiles, surface, traces
from stratum.operators.graph import Scratch, list_ranks
from stratum.plans import registry

ABOUT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def test_list_ranks(spark):
    rng = random.Random(5)
    names = rng.sample(range(-(10**12), 10**12), 400)
    lists, rings = [names[:1], names[1:3], names[3:140], names[140:145]], [names[150:151], names[151:153], names[153:250], names[250:257]]
    rows = [(a, b) for x in lists for a, b in zip(x, [*x[1:], None])] + [(a, b) for x in rings for a, b in zip(x, x[1:] + x[:1])]
    rng.shuffle(rows)
    got = {r.node: tuple(r)[1:] for r in list_ranks(spark.createDataFrame(rows, "node long, next long"), Scratch(spark, "t")).collect()}
    assert len(got) == len(rows)
    for x in lists:
        assert [got[v] for v in x] == [(x[0], i, len(x), False) for i in range(len(x))]
    for x in rings:
        at = x.index(min(x))
        assert [got[v] for v in x[at:] + x[:at]] == [(min(x), i, len(x), True) for i in range(len(x))]
    assert list_ranks(spark.createDataFrame([], "node long, next long"), Scratch(spark, "t")).count() == 0


def walked(pixels):
    """Lines of one map's pixels by walking, as sets of undirected pixel sequences; rings by their pixels."""
    near = {p: [(p[0] + a, p[1] + b) for a, b in ABOUT if (p[0] + a, p[1] + b) in pixels] for p in pixels}
    nodes, seen, out = {p for p in pixels if len(near[p]) != 2}, set(), []
    for start in sorted(nodes):
        for first in near[start]:
            if (start, first) in seen:
                continue
            path = [start, first]
            while path[-1] not in nodes:
                path.append(next(q for q in near[path[-1]] if q != path[-2]))
            seen |= {(path[0], path[1]), (path[-1], path[-2])}
            out.append(min(path, path[::-1]))
    left = pixels - nodes - {p for path in out for p in path}
    while left:
        start = min(left)
        path = [start, min(near[start])]
        while path[-1] != start:
            path.append(next(q for q in near[path[-1]] if q != path[-2]))
        out.append(path)
        left -= set(path)
    return out


def test_paths(spark):
    rng = random.Random(2)
    maps = {m: {(rng.randint(0, 25), rng.randint(0, 25)) for _ in range(n)} for m, n in (("a", 90), ("b", 180))}
    ring = {(0, 1), (0, 2), (1, 3), (2, 3), (3, 2), (3, 1), (2, 0), (1, 0)}
    maps |= {"ring": ring, "both": {(r + 10, c) for r, c in ring} | {(5, 5), (30, 30)}, "loop": {(0, 0), (0, 1), (1, 2), (1, 1), (-1, -1), (-1, 1)}, "long": {(0, c) for c in range(300)}}
    df = spark.createDataFrame([(m, r, c) for m, ps in maps.items() for r, c in ps], "map string, row int, col int")
    got = defaultdict(list)
    for r in lines.paths(df, "map", Scratch(spark, "t")).collect():
        got[r.map, r.line].append((r.seq, (r.row, r.col), r.n, r.closed))
    seen = defaultdict(list)
    for (m, _), v in got.items():
        v.sort()
        assert [x[0] for x in v] == list(range(len(v))) and {x[2] for x in v} == {len(v)}
        seen[m].append([x[1] for x in v])
    assert {m: sorted(map(tuple, seen[m])) for m in maps} == {m: sorted(map(tuple, walked(ps))) for m, ps in maps.items()}
    assert any(v[0][3] for v in got.values())


def test_joined(spark):
    """Three pieces of one straight line, one of them drawn backward, a piece alone, and a ring of two half circles."""
    pieces = {1: [(x, 0.0) for x in range(0, 30)], 2: [(x, 0.0) for x in range(64, 33, -1)], 3: [(x, 0.0) for x in range(67, 99)], 4: [(x, 500.0) for x in range(40)]}
    circle = [(900 + 200 * math.cos(t / 200), 900 + 200 * math.sin(t / 200)) for t in range(1256)]
    pieces |= {5: circle[5:600], 6: circle[605:] + circle[:1]}
    rows = spark.createDataFrame([("m", k, i, float(x), float(y)) for k, v in pieces.items() for i, (x, y) in enumerate(v)], "map string, line long, seq int, x double, y double")
    scratch = Scratch(spark, "t")
    ends = traces.tangents(rows, "line", "seq").withColumn("map", F.lit("m"))
    links = lines.bridges(ends, "map", "line", scratch)
    got = defaultdict(list)
    for r in lines.joined(rows, links, "map", "line", "seq", scratch).collect():
        got[r.whole].append((r.seq, r.x, r.y, r.parts, r.closed))
    for v in got.values():
        v.sort()
        assert [x[0] for x in v] == list(range(len(v)))
    assert [x[1:3] for x in got[1]] == [*pieces[1], *pieces[2][::-1], *pieces[3]] and got[1][0][3:] == (3, False)
    assert [x[1:3] for x in got[4]] == pieces[4] and got[4][0][3:] == (1, False)
    assert [x[1:3] for x in got[5]] == pieces[5] + pieces[6] and got[5][0][3:] == (2, True)
    wholes = {r.line: r.whole for r in lines.stitch(ends, "map", "line", scratch).collect()}
    assert wholes == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}


def test_contour_paths(spark):
    """Level lines of two cones and a slope: each follows its level, keeps the higher ground on its left, and closes where it should."""
    cone = lambda r, c: 40 - math.hypot(r - 15.3, c - 14.7)
    slope = lambda r, c: 1.3 * c + 0.21 * r
    rows = [(m, r, c, f(r, c)) for m, f in (("cone", cone), ("slope", slope)) for r in range(31) for c in range(31)]
    df = spark.createDataFrame(rows, "map string, row int, col int, z double")
    segments = surface.contour_segments(df, 5.0, ["map"])
    out = surface.contour_paths(segments, Scratch(spark, "t"), ["map"])
    got = defaultdict(list)
    for r in out.collect():
        got[r.map, r.level, r.line].append((r.seq, r.x, r.y, r.n, r.closed, r.length))
    used = 0
    for (m, level, _), v in got.items():
        v.sort()
        xy = np.array([x[1:3] for x in v])
        f = cone if m == "cone" else slope
        assert v[0][3] == len(v) and np.allclose(np.hypot(*np.diff(xy, axis=0).T).sum(), v[0][5])
        assert max(abs(f(y, x) - level) for x, y in xy) < 0.1
        # closed lines run about the top with it on their left: clockwise for rows that grow downward
        area = ((xy[:-1, 0] * xy[1:, 1]) - (xy[1:, 0] * xy[:-1, 1])).sum() / 2
        assert v[0][4] == (m == "cone" and level >= 30) == bool((xy[0] == xy[-1]).all()) and (not v[0][4] or area < 0)
        used += len(v) - 1
    short = surface.contour_paths(segments, Scratch(spark, "t"), ["map"], 0, 0.0)
    assert short.count() - short.select("line").distinct().count() == segments.count() >= used
    top = {r.map: r for r in surface.topology(out, 1.0, ["map"]).collect()}
    assert (top["cone"].closed, top["cone"].crossing_pairs, top["slope"].closed) == (sum(k[0] == "cone" and k[1] >= 30 for k in got), 0, 0)
    crossed = spark.createDataFrame([("m", 1.0, 1, 0, 0.0, 0.0, False), ("m", 1.0, 1, 1, 9.0, 9.0, False), ("m", 2.0, 2, 0, 0.0, 9.0, False), ("m", 2.0, 2, 1, 9.0, 0.0, False)], "map string, level double, line long, seq long, x double, y double, closed boolean")
    assert [tuple(r) for r in surface.topology(crossed, 2.0, ["map"]).collect()] == [("m", 2, 2, 0, 1)]


def test_hough(spark):
    rng = random.Random(7)
    ink = {(40, c) for c in range(10, 200)} | {(r, 60 + r) for r in range(120)} | {(150, c) for c in range(0, 80)} | {(150, c) for c in range(120, 220)}
    ink |= {(rng.randint(0, 220), rng.randint(0, 220)) for _ in range(150)}
    df = spark.createDataFrame([("m", r, c) for r, c in ink], "map string, row int, col int")
    scratch = Scratch(spark, "t")
    seg = scratch.table(profiles.hough_segments(df, "map", 60, 70.0, 8.0, scratch))
    found = sorted((round(r.x1), round(r.y1), round(r.x2), round(r.y2)) for r in seg.collect() if r.k in (90 * 2, 135 * 2))
    ends = sorted(tuple(sorted([(a, b), (c, d)])) for a, b, c, d in found)
    near = lambda a, b: all(abs(p - q) <= 8 for x, y in zip(a, b) for p, q in zip(x, y))
    for want in (((10, 40), (199, 40)), ((60, 0), (179, 119)), ((0, 150), (79, 150)), ((120, 150), (219, 150))):
        assert any(near(want, e) for e in ends)
    left = {(r.row, r.col) for r in profiles.without_profiles(df, seg, "map", 3.0).collect()}
    drawn = {(40, c) for c in range(10, 200)} | {(r, 60 + r) for r in range(120)}
    assert not left & drawn and len(left) > 100
    segs = [(r.x1, r.y1, r.x2, r.y2) for r in seg.collect()]

    def far(r, c):
        for x1, y1, x2, y2 in segs:
            t = max(0, min(1, ((c - x1) * (x2 - x1) + (r - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
            if math.hypot(c - x1 - t * (x2 - x1), r - y1 - t * (y2 - y1)) <= 1.5 + 1e-9:
                return False
        return True

    assert left == {p for p in ink if far(*p)}


@pytest.mark.parametrize("count, wrong", [(12, 4), (3, 0), (4, 0), (2, 0)])
def test_robust_transform(spark, count, wrong):
    """A known transform is recovered with a third of the matches false; two lines at right angles alone don't fix the shift along none."""
    rng = random.Random(count)
    scale, turn, dx, dy = 7.5, 0.7, -1500.0, 4200.0
    move = lambda x, y: (scale * (math.cos(turn) * x + math.sin(turn) * y) + dx, scale * (math.sin(turn) * x - math.cos(turn) * y) + dy)
    rows = []
    for k in range(count):
        x, y, a = rng.uniform(0, 3000), rng.uniform(0, 3000), math.pi * k / count + rng.uniform(-0.05, 0.05)
        p, q = move(x, y), move(x + math.cos(a), y + math.sin(a))
        d = math.hypot(q[0] - p[0], q[1] - p[1])
        n = ((p[1] - q[1]) / d, (q[0] - p[0]) / d)
        if k < wrong:
            p, n = (p[0] + rng.uniform(9e3, 3e4), p[1] - rng.uniform(9e3, 3e4)), (math.cos(rng.uniform(0, 3)), math.sin(1.0))
            n = tuple(v / math.hypot(*n) for v in n)
        rows.append(("m", k, x, y, x + 800 * math.cos(a), y + 800 * math.sin(a), p[0], p[1], *n))
    df = spark.createDataFrame(rows, "map string, k int, x1 double, y1 double, x2 double, y2 double, u double, v double, nx double, ny double")
    got = profiles.robust_transform(df, "map", "k", Scratch(spark, "t")).collect()
    assert len(got) == 1 and got[0].matches == count
    r = got[0]
    if count >= 3:
        assert r.inliers == count - wrong and abs(r.scale - scale) < 1e-6 and abs(math.remainder(r.turn - turn, 2 * math.pi)) < 1e-6
        assert abs(r.dx - dx) < 1e-3 and abs(r.dy - dy) < 1e-3 and r.rms < 1e-3
    else:
        assert r.inliers is None


def test_label_lines_far_and_doubled(spark):
    """A line known by two points ten thousand pixels away is found, and of two labels of one profile the better one stays."""
    t = math.radians(33.0)
    far = ("m", 1, 500 + 1e4 * math.cos(t), 500 + 1e4 * math.sin(t), 500 + 1.1e4 * math.cos(t), 500 + 1.1e4 * math.sin(t), 33.0)
    other = ("m", 2, 0.0, 900.0, 10.0, 900.0, 0.0)
    turned = ("m", 3, 800.0, 0.0, 800.0 + 10 * math.cos(math.radians(179.0)), 10 * math.sin(math.radians(179.0)), 179.0)
    own = spark.createDataFrame([far, other, turned], "map string, line int, x double, y double, x1 double, y1 double, angle double")
    labels = spark.createDataFrame([("m", 7, "p", 0.9, 510.0, 500.0, 30.0), ("m", 8, "p", 0.95, 490.0, 500.0, 40.0), ("m", 9, "q", 0.5, 500.0, 490.0, 33.0), ("m", 10, "p", 0.9, 700.0, 4.0, 2.0), ("m", 11, "p", 0.9, 5000.0, 100.0, 90.0)], "map string, label int, profile string, score double, x double, y double, angle double")
    got = {(r.label, r.line) for r in lines.label_lines(labels, own, "map", "label", "line").collect()}
    assert got == {(7, 1), (8, 1), (9, 1), (10, 3)}
    best = {(r.label, r.profile, r.line, r.score) for r in lines.label_lines(labels, own, "map", "label", "line", profile="profile", score="score").collect()}
    assert best == {(8, "p", 1, 0.95), (9, "q", 1, 0.5), (10, "p", 3, 0.9)}


def test_label_lines_against_all_pairs(spark):
    rng = random.Random(4)
    own, labels = [], []
    for k in range(60):
        x, y, a = rng.uniform(0, 4000), rng.uniform(0, 4000), rng.uniform(0, 179.99)
        own.append(("m", k, x, y, x + 300 * math.cos(math.radians(a)), y + 300 * math.sin(math.radians(a)), a))
    labels = [("m", k, rng.uniform(0, 4000), rng.uniform(0, 4000), rng.uniform(0, 179.99)) for k in range(80)]
    want = Counter()
    for _, k, x, y, a in labels:
        met = []
        for _, line, x0, y0, x1, y1, t in own:
            d, g = abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / math.hypot(x1 - x0, y1 - y0), abs(a - t) % 180
            g = min(g, 180 - g)
            if d <= 45 and g <= 20:
                met.append((round(d + 1.5 * g, 6), line))
        if met:
            want[k, min(met)[1], min(met)[0]] += 1
    got = lines.label_lines(spark.createDataFrame(labels, "map string, label int, x double, y double, angle double"), spark.createDataFrame(own, "map string, line int, x double, y double, x1 double, y1 double, angle double"), "map", "label", "line")
    assert Counter((r.label, r.line, round(r.cost, 6)) for r in got.collect()) == want and len(want) > 10


@pytest.mark.parametrize("bx, cx, by_, cy", [(2.0, 0.7, 0.4, 2.1), (2.0, -0.7, 0.3, 2.1), (1.0, 0.3, -0.9, 1.4)])
def test_georeference_is_delaunay(spark, bx, cx, by_, cy):
    """Values on the lattice equal those of the triangles whose circumcircles hold no other node, found by trying all triples."""
    rng = random.Random(1)
    z = {(r, c): rng.uniform(0, 50) for r in range(5) for c in range(5)}
    at = {p: np.array([3 + bx * p[1] + cx * p[0], -7 + by_ * p[1] + cy * p[0]]) for p in z}
    triangles, names = [], sorted(z)
    for i, a in enumerate(names):
        for j, b in enumerate(names[:i]):
            for c in names[:j]:
                m = np.array([at[b] - at[a], at[c] - at[a]])
                if abs(np.linalg.det(m)) < 1e-9:
                    continue
                centre = np.linalg.solve(m, (m * m).sum(1) / 2)
                if all(np.hypot(*(at[p] - at[a] - centre)) >= np.hypot(*centre) - 1e-9 for p in names):
                    triangles.append((a, b, c))
    want = {}
    size = 0.8
    xs, ys = zip(*at.values())
    for i in range(math.floor(min(ys) / size + 1e-9), math.ceil(max(ys) / size - 1e-9) + 1):
        for j in range(math.floor(min(xs) / size + 1e-9), math.ceil(max(xs) / size - 1e-9) + 1):
            for a, b, c in triangles:
                w = np.linalg.solve(np.array([[*at[p], 1] for p in (a, b, c)]).T, [j * size, i * size, 1])
                if (w >= -1e-9).all():
                    want[round(j * size, 6), round(i * size, 6)] = w @ [z[a], z[b], z[c]]
    grid = spark.createDataFrame([("m", r, c, v) for (r, c), v in z.items()], "map string, row int, col int, z double")
    fits = spark.createDataFrame([("m", 3.0, bx, cx, -7.0, by_, cy)], "map string, ax double, bx double, cx double, ay double, by_ double, cy double")
    got = {(round(r.x, 6), round(r.y, 6)): r.z for r in lines.georeference(grid, fits, "map", size).collect()}
    assert got.keys() == want.keys() and len(got) > 30
    assert all(abs(got[p] - want[p]) < 1e-6 for p in got)
    blank = lines.georeference(grid.where("not (row = 2 and col = 2)"), fits, "map", size)
    assert 0 < blank.count() < len(got)
    side = lines.cell_side(grid.withColumn("col", F.col("col") * 4), fits, "map").first()
    assert abs(side["size"] - math.sqrt(abs(bx * cy - cx * by_) * 4)) < 1e-9


def test_bridges_of_many_ends_at_one_place(spark):
    """Ends at one place are joined in few rounds in the order of their lines, never an end to its own line's."""
    scratch = Scratch(spark, "t")
    ends = [("m", k, "stop", 0.0, 0.0, 1.0, 0.0) for k in range(40)] + [("m", k, "start", 1.0, 0.0, -1.0, 0.0) for k in range(100, 140)]
    ends += [("m", 200, "start", 500.0, 0.0, 1.0, 0.0), ("m", 200, "stop", 502.0, 0.0, -1.0, 0.0)]
    ends += [("r", 300 + k, e, x, 0.0, d, 0.0) for k in range(2) for e, x, d in (("start", 0.0, 1.0), ("stop", 2.0, -1.0))]
    got = lines.bridges(spark.createDataFrame(ends, "map string, line long, end string, x double, y double, dx double, dy double"), "map", "line", scratch)
    got = {tuple(r) for r in got.collect()}
    assert {r for r in got if r[0] < 200} == {(k, "stop", k + 100, "start") for k in range(40)}
    assert {r for r in got if r[0] >= 200} == {(300, "start", 301, "stop"), (300, "stop", 301, "start")}
    assert scratch.n < 60


def test_stitched_lines_takes_every_line(spark, monkeypatch):
    """Every line of the table that has two points or more brings both its ends to stitching."""
    monkeypatch.setattr(lines, "stitch", lambda ends, *a: ends)
    sf = "/root/testdata/sf0.001"
    got = registry.QUERIES["stitched_lines"](spark, sf).groupBy("line").agg(F.count("*").alias("n"))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag", "l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"))
    assert got.count() == got.where("n = 2").count() == rows.where("a < b").count() > 0
