"""Work that grows with the rows where many of them lie close together or are copies."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stratum.operators import lines, retrieval, spatial, surface, traces
from stratum.operators.graph import Scratch
from stratum.plans import registry
from stratum.sources import pdf


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def roots(points: dict, radius: float) -> dict:
    left, out = set(points), {}
    while left:
        first = min(left)
        todo = [first]
        left.discard(first)
        while todo:
            k = todo.pop()
            out[k] = first
            near = [o for o in left if math.dist(points[k], points[o]) <= radius]
            left.difference_update(near)
            todo += near
    return out


@pytest.fixture
def dense():
    """Two dense spots, a sparse field, copies of a point, and points at exactly the radius."""
    r = random.Random(7)
    spots = [(r.gauss(0, 6), r.gauss(0, 6)) for _ in range(300)] + [(60 + r.gauss(0, 6), r.gauss(0, 6)) for _ in range(300)]
    spots += [(r.uniform(-300, 300), r.uniform(-300, 300)) for _ in range(200)] + [(500.0, 500.0)] * 100 + [(i * 10.0, 1000.0) for i in range(20)] + [(i * 10.5, 2000.0) for i in range(5)]
    return dict(enumerate(spots))


def frame(spark, points: dict):
    return spark.createDataFrame([(k, *p) for k, p in points.items()], "k long, x double, y double")


def test_clusters_of_dense_points(spark, dense, monkeypatch):
    edges, whole = [], spatial.components
    monkeypatch.setattr(spatial, "components", lambda e, *a: edges.append(e.count()) or whole(e, *a))
    for radius in (10.0, 3.0):
        got = {r.k: r.component for r in spatial.clusters(frame(spark, dense), "k", radius, Scratch(spark, "t")).collect()}
        assert got == roots(dense, radius)
    assert sum(edges) < 5 * len(dense)


def test_clusters_of_cells_whose_outermost_points_lie_apart(spark):
    """Two cells of a comb meet by inner points alone; null and infinite coordinates link nothing."""
    points = {i: p for i, p in enumerate([(0.1, 0.1), (0.1, 6.9), (6.9, 0.1), (6.9, 6.9), (6.8, 3.5), (13.0, 0.1), (16.6, 3.5), (20.9, 0.1), (20.9, 6.9), (15.0, 6.9)])}
    rows = frame(spark, points).unionByName(spark.createDataFrame([(90, None, 1.0), (91, float("nan"), 1.0), (92, float("inf"), 1.0), (93, float("inf"), 1.0)], "k long, x double, y double"))
    got = {r.k: r.component for r in spatial.clusters(rows, "k", 9.9, Scratch(spark, "t")).collect()}
    assert got == roots(points, 9.9) | {k: k for k in (90, 91, 92, 93)}


def test_corridor_of_dense_points(spark, dense, monkeypatch):
    met, whole = [], spatial.within

    def within(*args):
        out = whole(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(spatial, "within", within)
    got = {r.k: r.corridor for r in traces.corridor(frame(spark, dense), "k", 10.0).collect()}
    assert got == {k: sum(math.dist(p, q) <= 10.0 for q in dense.values()) >= 3 for k, p in dense.items()}
    assert sum(met) < 3 * len(dense)


def test_proximity_joins_are_dealt_by_cells(spark):
    points = spark.range(50).selectExpr("id AS k", "id % 7 * 1.0D AS x", "id % 5 * 1.0D AS y")
    assert "Broadcast" not in plan(spatial.within(points, points, 1.5))
    assert "Broadcast" not in plan(lines.dash_links(points.selectExpr("1 AS map", "*", "0.0D AS angle", "0.1D AS elongation"), "map", "k", 1.5))
    near = lambda d: {(r.l.k, r.r.k) for r in d.collect()}
    assert near(spatial.pairs(points, "k", 1.5)) == {p for p in near(spatial.within(points, points, 1.5)) if p[0] < p[1]}


def test_quantiles_in_bins(spark):
    """Exact as percentile, with outliers, infinities, NaN, nulls and a group of one value; no task aggregates a group's values."""
    r = random.Random(3)
    rows = [("a", r.gauss(0, 1) * 10 ** r.randint(-9, 9)) for _ in range(3000)] + [("b", 1.5)] * 7 + [("c", None)] + [("d", v) for v in (float("inf"), float("-inf"), float("nan"), 1e308, -1e308, 0.0, 5e-324)] + [(None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {x.g: tuple(x)[1:] for x in spatial.quantiles(df, "v", [0.5, 0.95], ["g"], Scratch(spark, "t")).collect()}
    want = {x.g: tuple(x)[1:] for x in df.groupBy("g").agg(F.count("v"), F.percentile("v", F.lit(0.5)), F.percentile("v", F.lit(0.95))).where("g is null or g <> 'c'").collect()}
    assert repr(got.keys()) and {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}
    assert "percentile" not in plan(spatial.residuals(df, F.col("v"), ["g"]))
    assert spatial.residuals(df.where("g = 'a'"), F.col("v"), []).first().n == 3000


def test_consolidate_copies(spark, monkeypatch):
    """Copies are linked once; the gap is taken along the smaller key of any two copies."""
    edges, whole = [], lines.components
    monkeypatch.setattr(lines, "components", lambda e, *a: edges.append(e.count()) or whole(e, *a))
    rows = [(1, 10 + i, 0.0, 0.0, 100.0, 0.0) for i in range(60)] + [(1, 5 + 90 * i, 150.0, 1.0, 250.0, 1.0) for i in range(2)] + [(2, 200 + i, 0.0, 0.0, 100.0, 0.0) for i in range(3)] + [(None, 300, 0.0, 0.0, 100.0, 0.0), (None, 301, 0.0, 0.0, 100.0, 0.0)]
    df = spark.createDataFrame(rows, "m int, k long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.m, r.line): r.support for r in lines.consolidate(df, "m", "k", 50.0, Scratch(spark, "t")).collect() if r.m}
    assert got == {(1, 5): 62, (2, 200): 3} and sum(edges) < 5


def test_vector_candidates(spark, monkeypatch):
    """The best of many vectors and copies by matrices: few pairs are scored; odd vectors come last."""
    seen, whole = [], retrieval._candidates

    def candidates(*args):
        out = whole(*args)
        seen.append(out.where("near is not null").count())
        return out

    monkeypatch.setattr(retrieval, "_candidates", candidates)
    r = random.Random(5)
    vectors = [[r.gauss(0, 1) for _ in range(8)] for _ in range(1500)] + [[1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]] * 1500 + [[1.0] * 7, None]
    df = spark.createDataFrame(list(enumerate(vectors)), "k long, v array<double>").repartition(3)
    got = {}
    for x in retrieval.vector_topk(df, df.where("k % 100 = 0"), "k", "v").collect():
        got.setdefault(x.query, {})[x.rank] = x.k
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6)
    for q in range(0, 3000, 100):
        want = sorted((k for k in range(3000) if k != q), key=lambda k: (-cos(vectors[q], vectors[k]), k))[:5]
        assert [got[q][n] for n in range(1, 6)] == want
    assert seen and seen[0] < 30 * 3000 / 4


def test_vectors_that_cannot_be_multiplied(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [1.0]), (100, None)], "k long, v array<double>")
    rows = retrieval.vector_topk(df, df.where("k % 100 = 0"), "k", "v").collect()
    assert [r.k for r in sorted(rows, key=lambda r: r["rank"]) if r.query == 0] == [1, 2, 3, 100]
    assert [r.k for r in sorted(rows, key=lambda r: r["rank"]) if r.query == 100] == [0, 1, 2, 3]


def test_pdf_is_read_once_and_dealt_out(spark, monkeypatch):
    calls, whole = [], pdf.Pdf.pages
    monkeypatch.setattr(pdf.Pdf, "pages", lambda self: calls.append(1) or whole(self))
    data = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] >>\nendobj\n3 0 obj\n<< /Type /Page /MediaBox [0 0 5 7] >>\nendobj\n"
    assert pdf.Pdf(data).found == [(5.0, 7.0, 0)] and len(calls) == 1
    assert registry.QUERIES["pdf_page_rows"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_grid_constraints_lists_no_pairs(spark, monkeypatch):
    """Crossing segments are pruned as by their pairs, chains of losers included."""
    r = random.Random(11)
    seg = [(k, k % 2, r.randrange(4), r.uniform(0, 300), r.uniform(0, 300), r.uniform(0, 300), r.uniform(0, 300)) for k in range(150)]
    seg = spark.createDataFrame(seg, "k long, map long, g int, x1 double, y1 double, x2 double, y2 double")
    state = spark.range(150).selectExpr("id AS k", "id % 9 <> 0 AS accepted", "id % 40 = 1 AS direct_label", "id % 7 * 0.1D AS residual", "CASE WHEN id % 50 = 3 THEN double('NaN') ELSE id % 5 * 0.1D END AS spread", "id % 3 * 0.1D AS coverage")
    pairs = surface.segment_crossings(seg, "k", "g", 60.0, ["map"]).select("first", "second")
    want = {tuple(map(str, x)) for x in lines.prune_crossings(state, pairs, "k", Scratch(spark, "t")).collect()}
    got = {tuple(map(str, x)) for x in lines.prune_crossing_segments(state, seg, "k", "g", 60.0, ["map"], Scratch(spark, "t")).collect()}
    assert got == want and any("crosses" in x[-1] for x in got)
    monkeypatch.setattr(surface, "segment_crossings", None)
    assert registry.QUERIES["grid_constraints"](spark, "/root/testdata/sf0.001").count() == 10


def test_crossings_are_neither_broadcast_nor_shuffled_again(spark):
    seg = spark.range(60).selectExpr("id AS k", "id % 3 AS g", "id % 7 * 3.0D AS x1", "id % 5 * 4.0D AS y1", "id % 11 * 3.0D AS x2", "id % 13 * 2.0D AS y2")
    out = surface.segment_crossings(seg, "k", "g", 2.0)
    rows = [(r["first"], r["second"]) for r in out.collect()]
    assert len(rows) == len(set(rows)) > 0
    assert set(rows) == {(r["first"], r["second"]) for r in surface.segment_crossings(seg, "k", "g", 1000.0).collect()}
    assert "Broadcast" not in plan(out) and "HashAggregate" not in plan(out)


def test_label_lines_of_dense_lines(spark, monkeypatch):
    """Labels in a field of lines and their copies, some far from all: the rows of all pairs, while a label meets few lines."""
    r = random.Random(11)
    line = lambda: (r.uniform(0, 300), r.uniform(0, 300), float(r.randrange(180)) if r.random() < 0.5 else r.uniform(0, 179.99))
    fan = [line() for _ in range(1500)] * 2
    own = [("m", k, x, y, x + 10 * math.cos(math.radians(t)), y + 10 * math.sin(math.radians(t)), t) for k, (x, y, t) in enumerate(fan)] + [("n", 9000, 0.0, 0.0, 10.0, 0.0, 0.0), ("n", 9001, math.nan, 0.0, 10.0, 0.0, 0.0)]
    labels = [("m", k, r.uniform(0, 300), r.uniform(0, 300), float(r.randrange(180))) for k in range(200)]
    labels += [("m", 200 + k, r.uniform(2000, 5000), 0.0, r.uniform(0, 179.0)) for k in range(20)] + [("n", 300, 500.0, 40.0, 178.0), ("n", 301, 500.0, 46.0, 0.0), ("n", 302, math.inf, 0.0, 0.0)]
    want = set()
    for m, k, x, y, a in labels:
        met = []
        for n, i, x0, y0, x1, y1, t in own:
            d, g = abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / math.hypot(x1 - x0, y1 - y0), abs(a - t) % 180
            g = min(g, 180 - g)
            if m == n and d <= 45 and g <= 20:
                met.append((round(d + 1.5 * g, 6), i))
        want |= {(k, min(met)[1])} if met else set()
    met, whole = spark.sparkContext.accumulator(0), lines.G.line_distance

    @F.udf("double")
    def counted(d):
        met.add(1)
        return d

    monkeypatch.setattr(lines.G, "line_distance", lambda *c: counted(whole(*c)))
    rows = lambda v: spark.createDataFrame(v, "map string, k long, x double, y double, " + ("x1 double, y1 double, " if len(v[0]) > 5 else "") + "angle double")
    got = lines.label_lines(rows(labels), rows(own).withColumnRenamed("k", "line"), "map", "k", "line")
    assert {(v.k, v.line) for v in got.collect()} == want and len(want) > 200
    assert met.value < 100 * len(labels)
