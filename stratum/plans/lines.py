"""Chains of pixels, values of lines, georeferenced grids and line transforms, over several maps at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lines, raster, spatial, surface, traces
from ..operators.graph import Scratch
from .registry import query, table

INK_SQL = "SELECT DISTINCT l_returnflag AS map, l_quantity::BIGINT AS row, l_suppkey % 60 AS col FROM lineitem WHERE (l_quantity::BIGINT + l_suppkey % 60) % 4 = 0"
TOUCH_SQL = "p JOIN p q ON p.map = q.map AND abs(p.row - q.row) <= 1 AND abs(p.col - q.col) <= 1 AND (p.row, p.col) <> (q.row, q.col)"


@query(f"""
WITH RECURSIVE p AS ({INK_SQL}), t AS (SELECT p.map, p.row * 1000 + p.col AS a, q.row * 1000 + q.col AS b FROM {TOUCH_SQL}), d AS (SELECT p.map, p.row * 1000 + p.col AS a, count(t.b) AS n FROM p LEFT JOIN t ON p.map = t.map AND p.row * 1000 + p.col = t.a GROUP BY ALL),
i AS (SELECT map, a FROM d WHERE n = 2), e AS (SELECT t.map, t.a, t.b FROM t JOIN i x ON t.map = x.map AND t.a = x.a JOIN i y ON t.map = y.map AND t.b = y.a),
r(map, a, b) AS (SELECT map, a, a FROM i UNION SELECT r.map, r.a, e.b FROM r JOIN e ON r.map = e.map AND r.b = e.a), c AS (SELECT map, a, min(b) AS c FROM r GROUP BY ALL),
n AS (SELECT DISTINCT t.map, t.a, c.c FROM t JOIN c ON t.map = c.map AND t.b = c.a JOIN d ON d.map = t.map AND d.a = t.a WHERE d.n <> 2),
k AS (SELECT map, c, count(*) AS inner_pixels FROM c GROUP BY ALL), m AS (SELECT map, c, count(*) AS nodes FROM n GROUP BY ALL)
SELECT map, inner_pixels, coalesce(nodes, 0) AS nodes, count(*) AS chains FROM k LEFT JOIN m USING (map, c) GROUP BY ALL
UNION ALL SELECT t.map, 0, 2, count(*) FROM t JOIN d x ON t.map = x.map AND t.a = x.a JOIN d y ON t.map = y.map AND t.b = y.a WHERE x.n <> 2 AND y.n <> 2 AND t.a < t.b GROUP BY 1
""")
def skeleton_chains(spark, sf_dir):
    ink = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("map"), F.col("l_quantity").cast("bigint").alias("row"), (F.col("l_suppkey") % 60).alias("col")).where("(row + col) % 4 = 0").distinct()
    out = lines.chains(ink, "map", Scratch(spark, "chains"))
    sizes = out.groupBy("map", "chain").agg(F.count_if(~F.col("node")).alias("inner_pixels"), F.count_if(F.col("node")).alias("nodes"))
    return sizes.groupBy("map", "inner_pixels", "nodes").agg(F.count("*").alias("chains"))


@query("""
WITH l AS (SELECT o_orderkey // 3000 AS map, o_orderkey AS label, o_totalprice / 1000 AS x, o_custkey % 97 * 4.0 AS y, round(o_orderkey % 14 * 0.1, 1) AS v FROM orders WHERE o_orderkey % 2 = 0),
w AS (SELECT o_orderkey // 3000 AS map, o_orderkey AS vertex, o_custkey % 9 AS line, o_totalprice / 1000 + 1 AS x, o_custkey % 89 * 4.0 AS y FROM orders WHERE o_orderkey % 2 = 1),
g AS (SELECT map, v, coalesce((v - lag(v) OVER (PARTITION BY map ORDER BY v) > 0.8)::INT, 0) AS new FROM l), u AS (SELECT map, v, sum(new) OVER (PARTITION BY map ORDER BY v ROWS UNBOUNDED PRECEDING) AS run FROM g),
a AS (SELECT map, run, count(*) AS n, min(v) AS lo, max(v) AS hi FROM u GROUP BY ALL), b AS (SELECT *, sum(n) OVER (PARTITION BY map) AS total, row_number() OVER (PARTITION BY map ORDER BY n DESC, hi - lo, lo) AS k FROM a),
z AS (SELECT map, lo - 0.1 AS low, hi + 0.1 AS high FROM b WHERE k = 1 AND total >= 6 AND n >= greatest(3, total * 0.25)),
f AS (SELECT l.* FROM l LEFT JOIN z USING (map) WHERE low IS NULL OR v BETWEEN low AND high),
h AS (SELECT l.map, w.line, row_number() OVER (PARTITION BY l.label ORDER BY sqrt((l.x - w.x) ** 2 + (l.y - w.y) ** 2), w.vertex) AS k FROM l JOIN w ON l.map = w.map AND w.line IN (0, 2, 5) AND sqrt((l.x - w.x) ** 2 + (l.y - w.y) ** 2) <= 87.5 WHERE l.label % 202 = 0),
d AS (SELECT f.map, f.label, f.v, w.vertex, w.line, sqrt((f.x - w.x) ** 2 + (f.y - w.y) ** 2) AS d FROM f JOIN w ON f.map = w.map AND w.line NOT IN (0, 4) AND NOT EXISTS (SELECT 1 FROM h WHERE h.map = w.map AND h.line = w.line AND k = 1)),
e AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vertex) AS k FROM d WHERE d <= 70), c AS (SELECT map, line, v, count(*) AS c, min(label) AS first FROM e WHERE k = 1 GROUP BY ALL),
t AS (SELECT map, line, sum(c) AS total, count(*) AS kinds FROM c GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY map, line ORDER BY c DESC, first) AS k FROM c)
SELECT map, line, v AS value, c AS votes, total::BIGINT AS total, CASE WHEN (kinds = 1 OR c >= 2 * (total - c)) AND line <> 7 THEN 'confident' ELSE 'conflict' END AS verdict FROM o JOIN t USING (map, line) WHERE k = 1
""")
def assign_lines(spark, sf_dir):
    """Labels against lines on maps of 3,000 orders: line 0 is a leak, line 4 too short, line 7 under suspicion; lines 2 and 5 are straight, and leaks where a profile's number lies by."""
    rows, by = table(spark, sf_dir, "orders"), F.expr("o_orderkey div 3000").alias("map")
    x, k = F.col("o_totalprice") / 1000, F.col("o_custkey")
    labels = rows.where("o_orderkey % 2 = 0").select(by, F.col("o_orderkey").alias("label"), x.alias("x"), (k % 97 * 4.0).alias("y"), F.round(F.col("o_orderkey") % 14 * 0.1, 1).alias("value"))
    vertices = rows.where("o_orderkey % 2 = 1").select(by, F.col("o_orderkey").alias("vertex"), (k % 9).alias("line"), (x + 1).alias("x"), (k % 89 * 4.0).alias("y"))
    n = F.col("line")
    stats = vertices.select("map", "line").distinct().withColumns({"length": F.when(n == 4, 60.0).when(n == 7, 120.0).otherwise(500.0), "straightness": F.when(n == 0, 0.02).when(n == 7, 0.005).when(n.isin(2, 5), 0.05).otherwise(0.5)})
    return lines.assign(labels, vertices, stats, "map", "line", "label", 0.1, profiles=labels.where("label % 202 = 0").select("map", "label", "x", "y"))


@query("""
WITH g AS (SELECT l_returnflag AS map, floor(l_quantity / 5)::BIGINT AS row, floor(l_discount * 100 / 2 + 0.25)::BIGINT AS col, avg(l_extendedprice / 1000) AS z FROM lineitem GROUP BY 1, 2, 3),
q AS (SELECT *, 2.0 AS bx, CASE map WHEN 'A' THEN 0.0 WHEN 'N' THEN 0.7 ELSE -0.7 END AS cx, CASE map WHEN 'A' THEN 0.0 WHEN 'N' THEN 0.4 ELSE 0.3 END AS by_, 2.1 AS cy FROM g), f AS (SELECT *, 10.0 + bx * col + cx * row AS mx, 5.0 + by_ * col + cy * row AS my FROM q),
b AS (SELECT map, bx, cx, by_, cy, floor(min(mx) / 1.5 + 1e-9)::BIGINT AS c0, ceil(max(mx) / 1.5 - 1e-9)::BIGINT AS c1, floor(min(my) / 1.5 + 1e-9)::BIGINT AS r0, ceil(max(my) / 1.5 - 1e-9)::BIGINT AS r1 FROM f GROUP BY 1, 2, 3, 4, 5),
n AS (SELECT *, unnest(range(c0, c1 + 1)) AS c FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM b)), t AS (SELECT *, (cy * (c * 1.5 - 10) - cx * (r * 1.5 - 5)) / (bx * cy - cx * by_) AS x, (bx * (r * 1.5 - 5) - by_ * (c * 1.5 - 10)) / (bx * cy - cx * by_) AS y FROM n),
k AS (SELECT *, floor(x)::BIGINT AS fc, floor(y)::BIGINT AS fr, x - floor(x) AS u, y - floor(y) AS v, (bx + cx) ** 2 + (by_ + cy) ** 2 <= (bx - cx) ** 2 + (by_ - cy) ** 2 + 1e-9 AS d FROM t),
w AS (SELECT map, r, r0, c, c0, fr, fc, unnest(CASE WHEN d AND u >= v THEN [{i: 0, j: 0, w: 1 - u}, {i: 0, j: 1, w: u - v}, {i: 1, j: 1, w: v}] WHEN d THEN [{i: 0, j: 0, w: 1 - v}, {i: 1, j: 0, w: v - u}, {i: 1, j: 1, w: u}] WHEN u + v <= 1 THEN [{i: 0, j: 0, w: 1 - u - v}, {i: 0, j: 1, w: u}, {i: 1, j: 0, w: v}] ELSE [{i: 1, j: 1, w: u + v - 1}, {i: 1, j: 0, w: 1 - u}, {i: 0, j: 1, w: 1 - v}] END) AS s FROM k)
SELECT w.map, r - r0 AS row, c - c0 AS col, round(sum(z * s.w) FILTER (s.w > 1e-12), 5) AS z FROM w LEFT JOIN g ON g.map = w.map AND g.row = fr + s.i AND g.col = fc + s.j GROUP BY 1, 2, 3 HAVING count(*) FILTER (s.w > 1e-12 AND z IS NULL) = 0
""")
def georeferenced(spark, sf_dir):
    """Three maps: one straight, and two turned and sheared, whose triangles lie along either diagonal."""
    by, flag = F.col("l_returnflag").alias("map"), F.col("map")
    grid = table(spark, sf_dir, "lineitem").groupBy(by, F.floor(F.col("l_quantity") / 5).alias("row"), F.floor(F.col("l_discount") * 100 / 2 + 0.25).alias("col")).agg(F.avg(F.col("l_extendedprice") / 1000).alias("z"))
    turn = lambda a, n, r: F.when(flag == "A", a).when(flag == "N", n).otherwise(r)
    fits = grid.select("map").distinct().withColumns({"ax": F.lit(10.0), "bx": F.lit(2.0), "cx": turn(0.0, 0.7, -0.7), "ay": F.lit(5.0), "by_": turn(0.0, 0.4, 0.3), "cy": F.lit(2.1)})
    return lines.georeference(grid, fits, "map", 1.5).select("map", "row", "col", F.round("z", 5).alias("z"))


@query("""
WITH s AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS x, avg(l_discount * 100) AS y, var_pop(l_quantity) AS xx, var_pop(l_discount * 100) AS yy, covar_pop(l_quantity, l_discount * 100) AS xy FROM lineitem GROUP BY 1), g AS (SELECT *, (xx + yy) / 2 AS m, sqrt(((xx - yy) / 2) ** 2 + xy ** 2) AS d FROM s)
SELECT l_suppkey, n, round(x, 5) AS x, round(y, 5) AS y, round(CASE WHEN degrees(atan2(2 * xy, xx - yy) / 2) < 0 THEN degrees(atan2(2 * xy, xx - yy) / 2) + 180 ELSE degrees(atan2(2 * xy, xx - yy) / 2) END, 4) AS angle, round(CASE WHEN m + d > 0 THEN sqrt(greatest(m - d, 0) / (m + d)) END, 5) AS elongation FROM g
""")
def main_axis(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return lines.main_axis(rows, ["l_suppkey"]).select("l_suppkey", "n", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round("angle", 4).alias("angle"), F.round("elongation", 5).alias("elongation"))


@query("""
WITH a AS (SELECT s_suppkey AS label, s_nationkey % 3 AS map, s_suppkey % 7 AS profile, s_suppkey % 11 / 10.0 AS score, (s_suppkey % 101) * 7.0 AS x, s_acctbal / 20 AS y, (s_suppkey * 37 % 180)::DOUBLE AS t FROM supplier), b AS (SELECT c_custkey AS line, c_nationkey % 3 AS map, (c_custkey % 101) * 7.0 AS x, c_acctbal / 20 AS y, (c_custkey * 53 % 180)::DOUBLE AS t FROM customer),
m AS (SELECT a.map, profile, score, label, line, abs(cos(radians(b.t)) * (a.y - b.y) - sin(radians(b.t)) * (a.x - b.x)) AS d, least((((a.t - b.t) % 180) + 180) % 180, 180 - (((a.t - b.t) % 180) + 180) % 180) AS g FROM a JOIN b ON a.map = b.map),
k AS (SELECT *, row_number() OVER (PARTITION BY map, label ORDER BY round(d + 1.5 * g, 6), line) AS r FROM m WHERE d <= 45 + 1e-9 AND g <= 20),
f AS (SELECT *, row_number() OVER (PARTITION BY map, profile, line ORDER BY score DESC, label) AS s FROM k WHERE r = 1)
SELECT map, label, profile, line, score::DOUBLE AS score, round(d + 1.5 * g, 5) AS cost FROM f WHERE s = 1
""")
def label_lines(spark, sf_dir):
    """Labels against infinite lines, of which ten pixels are known; a line keeps the best label of each of seven profiles."""
    s, c, k = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer"), F.col("s_suppkey")
    labels = s.select((F.col("s_nationkey") % 3).alias("map"), k.alias("label"), (k % 7).alias("profile"), (k % 11 / 10).alias("score"), (k % 101 * 7.0).alias("x"), (F.col("s_acctbal") / 20).alias("y"), (k * 37 % 180).cast("double").alias("angle"))
    own = c.select((F.col("c_nationkey") % 3).alias("map"), F.col("c_custkey").alias("line"), (F.col("c_custkey") % 101 * 7.0).alias("x"), (F.col("c_acctbal") / 20).alias("y"), (F.col("c_custkey") * 53 % 180).cast("double").alias("angle"))
    own = own.withColumns({"x1": F.col("x") + 10 * F.cos(F.radians("angle")), "y1": F.col("y") + 10 * F.sin(F.radians("angle"))})
    return lines.label_lines(labels, own, "map", "label", "line", profile="profile", score="score").withColumn("cost", F.round("cost", 5))


@query("SELECT s_suppkey, round(3 * (cos(radians(30)) * s_suppkey + sin(radians(30)) * s_acctbal) + 5, 4) AS x, round(3 * (sin(radians(30)) * s_suppkey - cos(radians(30)) * s_acctbal) - 7, 4) AS y, s_suppkey::DOUBLE AS back_x, round(s_acctbal, 4) AS back_y FROM supplier")
def similarity(spark, sf_dir):
    how = (F.lit(3.0), F.lit(30.0), F.lit(5.0), F.lit(-7.0), F.lit(True))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", lines.similarity(F.col("s_suppkey").cast("double"), F.col("s_acctbal"), *how).alias("p"))
    rows = rows.withColumn("b", lines.similarity_back(F.col("p.x"), F.col("p.y"), *how))
    return rows.select("s_suppkey", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"), F.round("b.x", 4).alias("back_x"), F.round("b.y", 4).alias("back_y"))


@query("""
WITH d AS (SELECT c_custkey // 500 AS map, c_custkey AS k, (c_custkey % 101) * 7.0 AS x, c_acctbal / 20 AS y, (c_custkey * 53 % 180)::DOUBLE AS t FROM customer WHERE c_custkey % 5 <> 0),
p AS (SELECT a.map, a.k AS first, b.k AS second, a.t AS t1, b.t AS t2, degrees(atan2(b.y - a.y, b.x - a.x)) AS l, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM d a JOIN d b ON a.map = b.map AND a.k < b.k),
g AS (SELECT *, (((t1 - t2) % 180) + 180) % 180 AS a, (((t1 - l) % 180) + 180) % 180 AS b, (((t2 - l) % 180) + 180) % 180 AS c FROM p WHERE distance <= 200)
SELECT map, first, second, round(distance, 5) AS distance FROM g WHERE greatest(least(a, 180 - a), least(b, 180 - b), least(c, 180 - c)) <= 15
""")
def dash_links(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 500").alias("map"), F.col("c_custkey").alias("k"), (F.col("c_custkey") % 101 * 7.0).alias("x"), (F.col("c_acctbal") / 20).alias("y"), (F.col("c_custkey") * 53 % 180).cast("double").alias("angle"), F.when(F.col("c_custkey") % 5 == 0, 0.9).otherwise(0.1).alias("elongation"))
    return lines.dash_links(rows, "map", "k", 200.0).withColumn("distance", F.round("distance", 5))


@query(f"WITH p AS ({INK_SQL}) SELECT map, row, col FROM p WHERE row BETWEEN 3 AND 46 AND col BETWEEN 3 AND 46")
def inside_border(spark, sf_dir):
    ink = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("map"), F.col("l_quantity").cast("bigint").alias("row"), (F.col("l_suppkey") % 60).alias("col")).where("(row + col) % 4 = 0").distinct()
    sizes = ink.select("map").distinct().withColumns({"height": F.lit(50), "width": F.lit(50)})
    return lines.inside_border(ink, sizes, "map", 3)


@query("""
WITH s AS (SELECT s_nationkey % 2 AS map, s_suppkey AS k, s_suppkey % 4 AS g, (s_suppkey % 101) * 10.0 AS x1, s_acctbal / 10 AS y1, (s_suppkey * 7 % 101) * 10.0 AS x2, s_acctbal / 10 + 150 AS y2 FROM supplier),
p AS (SELECT a.map, a.k AS first, b.k AS second, (b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1) AS p, (b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1) AS q, (a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1) AS r, (a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1) AS s FROM s a JOIN s b ON a.map = b.map AND a.k < b.k AND a.g <> b.g)
SELECT map, first, second FROM p WHERE sign(p) * sign(q) < 0 AND sign(r) * sign(s) < 0
""")
def crossings(spark, sf_dir):
    return surface.segment_crossings(_segments(spark, sf_dir), "k", "g", 120.0, ["map"])


def _segments(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 2).alias("map"), k.alias("k"), (k % 4).alias("g"), (k % 101 * 10.0).alias("x1"), (F.col("s_acctbal") / 10).alias("y1"), (k * 7 % 101 * 10.0).alias("x2"), (F.col("s_acctbal") / 10 + 150).alias("y2"))


@query()
def grid_constraints(spark, sf_dir):
    """Crossing lines of two maps: labels override, the weaker of each crossing pair goes."""
    seg = _segments(spark, sf_dir)
    k = F.col("k")
    rows = seg.select("k", (k % 50 * -0.1).alias("value"), (k % 40 * -0.1).alias("inferred"), (k % 3 != 0).alias("accepted"), (k % 17 == 0).alias("profile_suspect"), (k % 7 * 0.01).alias("residual"), (k % 5 * 0.1).alias("spread"), (k % 11 * 0.1).alias("coverage"))
    return lines.grid_constraints(rows, seg.where("k % 4 = 0").select("k", (k * -0.2).alias("label")), None, "k", Scratch(spark, "grid"), seg, "g", 120.0, ["map"])


@query()
def stitched_lines(spark, sf_dir):
    """Lines that continue each other over growing gaps, on three maps."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("map"), F.col("l_orderkey").alias("line"), "l_linenumber", (F.col("l_orderkey") % 97 * 11.0 + F.col("l_linenumber") * 3).alias("x"), (F.col("l_orderkey") % 5 * 40.0 + F.col("l_linenumber")).alias("y"))
    rows = rows.withColumn("line", F.xxhash64("map", "line"))
    ends = traces.tangents(rows, "line", "l_linenumber").join(rows.select("map", "line").distinct(), "line")
    return lines.stitch(ends, "map", "line", Scratch(spark, "stitch"))


@query(f"WITH p AS ({INK_SQL}), n AS (SELECT map, row, col FROM p WHERE row > 25) SELECT map, count(*) AS n, min(row) AS top FROM n GROUP BY 1")
def ink_rows(spark, sf_dir):
    gray = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("map"), F.col("l_quantity").cast("bigint").alias("row"), (F.col("l_suppkey") % 60).alias("col")).where("(row + col) % 4 = 0").distinct()
    return raster.ink(gray.withColumn("v", F.when(F.col("row") > 25, 10).otherwise(200)), "v").groupBy("map").agg(F.count("*").alias("n"), F.min("row").alias("top"))


@query("""
WITH a AS (SELECT c_nationkey % 3 AS map, c_custkey AS k, (c_custkey % 101) * 7.0 AS x, c_acctbal / 20 AS y, (c_custkey % 10) * 0.1 AS v FROM customer), b AS (SELECT s_nationkey % 3 AS map, -s_suppkey - 1 AS k, (s_suppkey % 101) * 7.0 AS x, s_acctbal / 20 AS y, (s_suppkey % 10) * 0.1 AS v FROM supplier),
d AS (SELECT b.map, b.k, abs(b.v - a.v) AS e, row_number() OVER (PARTITION BY b.k ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), a.k) AS r FROM b JOIN a ON a.map = b.map AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 40)
SELECT map, count(*) AS matched, count(*) FILTER (e <= 0.08 + 1e-9) AS agreeing, round(count(*) FILTER (e <= 0.08 + 1e-9) / count(*), 6) AS rate FROM d WHERE r = 1 GROUP BY 1
""")
def reading_agreement(spark, sf_dir):
    point = lambda t, k, n, b, key: table(spark, sf_dir, t).select((F.col(n) % 3).alias("map"), key.alias("k"), (F.col(k) % 101 * 7.0).alias("x"), (F.col(b) / 20).alias("y"), (F.col(k) % 10 * 0.1).alias("v"))
    a = point("customer", "c_custkey", "c_nationkey", "c_acctbal", F.col("c_custkey"))
    b = point("supplier", "s_suppkey", "s_nationkey", "s_acctbal", -F.col("s_suppkey") - 1)
    return spatial.agreement(a, b, "k", "v", 20.0, ["map"]).withColumn("rate", F.round("rate", 6))


@query("""
WITH r AS (SELECT o_orderkey, o_orderkey // 3000 AS map, 'PR ' || (o_custkey % 40) || ' m' AS text, (o_orderkey % 11) / 10.0 AS score, o_totalprice / 100 AS x, o_custkey * 1.0 AS y, o_custkey % 7 - 3.0 AS dy FROM orders WHERE o_orderkey % 13 <> 0)
SELECT map, o_orderkey, n_nationkey::VARCHAR AS profile_id, round((x + 5) / 2, 5) AS x, round((y + dy / 2 + 2) / 2, 5) AS y, round(CASE WHEN dy < 0 THEN degrees(atan2(dy, 10)) + 180 ELSE degrees(atan2(dy, 10)) END, 5) AS angle
FROM r JOIN nation ON regexp_replace(text, '[^0-9]', '', 'g') = n_nationkey::VARCHAR WHERE score >= 0.8
""")
def profile_labels(spark, sf_dir):
    """Orders as readings of profile names, every 13th without a fourth corner, against the nations as inventory."""
    x, y, dy = F.col("o_totalprice") / 100, F.col("o_custkey") * 1.0, F.col("o_custkey") % 7 - 3.0
    corners = [F.array(x, y), F.array(x + 10, y + dy), F.array(x + 10, y + dy + 4), F.array(x, y + 4)]
    polygon = F.when(F.col("o_orderkey") % 13 == 0, F.array(*corners[:3])).otherwise(F.array(*corners))
    readings = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 3000").alias("map"), "o_orderkey", F.concat(F.lit("PR "), (F.col("o_custkey") % 40).cast("string"), F.lit(" m")).alias("text"), (F.col("o_orderkey") % 11 / 10).alias("score"), polygon.alias("polygon"))
    out = lines.profile_labels(readings, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("profile_id")), "map", "text", "profile_id", 0.5)
    return out.select("map", "o_orderkey", "profile_id", *(F.round(c, 5).alias(c) for c in ("x", "y", "angle")))


@query("""
WITH RECURSIVE s AS (SELECT c_custkey AS k, c_nationkey AS map, (c_custkey * 37 % 400) * 1.0::DOUBLE AS x1, (c_custkey * 91 % 400) * 1.0::DOUBLE AS y1, 60.0::DOUBLE + c_custkey % 7 * 20 AS len, (c_custkey * 7 % 12 * 15.0 + c_custkey % 5 * 0.9)::DOUBLE AS t FROM customer),
h AS (SELECT *, cos(radians(t)) AS c, sin(radians(t)) AS n, x1 + len * cos(radians(t)) AS x2, y1 + len * sin(radians(t)) AS y2, cos(radians(t)) * y1 - sin(radians(t)) * x1 AS rho FROM s WHERE len >= 90),
p AS (SELECT a.k AS a, b.k AS b FROM h a JOIN h b ON a.map = b.map AND a.k < b.k AND least(abs(a.t - b.t) % 180, 180 - abs(a.t - b.t) % 180) <= 3 AND abs(a.rho - b.rho) <= 24
  AND greatest(a.x1 * a.c + a.y1 * a.n, least(b.x1 * a.c + b.y1 * a.n, b.x2 * a.c + b.y2 * a.n)) <= least(a.x2 * a.c + a.y2 * a.n, greatest(b.x1 * a.c + b.y1 * a.n, b.x2 * a.c + b.y2 * a.n)) + 180),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(a, b) AS (SELECT k, k FROM h UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT a AS k, min(b) AS line FROM r GROUP BY 1),
q AS (SELECT map, line, x1 AS x, y1 AS y FROM h JOIN m USING (k) UNION ALL SELECT map, line, x2, y2 FROM h JOIN m USING (k)),
z AS (SELECT map, line, count(*) // 2 AS support, avg(x) AS mx, avg(y) AS my, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS th FROM q GROUP BY 1, 2)
SELECT map, line, support, round(max((x - mx) * cos(th) + (y - my) * sin(th)) - min((x - mx) * cos(th) + (y - my) * sin(th)), 4) AS length FROM q JOIN z USING (map, line) GROUP BY 1, 2, 3
""")
def consolidated_lines(spark, sf_dir):
    k = F.col("c_custkey")
    t, length = F.radians(k * 7 % 12 * 15.0 + k % 5 * 0.9), F.lit(60.0) + k % 7 * 20
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("map"), k.alias("k"), (k * 37 % 400 * 1.0).alias("x1"), (k * 91 % 400 * 1.0).alias("y1"), t.alias("t"), length.alias("len"))
    rows = rows.select("map", "k", "x1", "y1", (F.col("x1") + F.col("len") * F.cos("t")).alias("x2"), (F.col("y1") + F.col("len") * F.sin("t")).alias("y2"))
    return lines.consolidate(rows, "map", "k", 90.0, Scratch(spark, "segments")).select("map", "line", "support", F.round("length", 4).alias("length"))


@query("""
WITH g AS (SELECT l_returnflag AS map, l_quantity::BIGINT AS row, round(l_discount * 100)::BIGINT AS col, CASE WHEN (l_quantity::BIGINT + round(l_discount * 100)::BIGINT) % 7 > 0 THEN max(round(l_extendedprice)) END AS z FROM lineitem GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY map ORDER BY col, row DESC) - 1 AS k FROM g), s AS (SELECT map, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1, min(z) AS z0, max(z) AS z1, count(DISTINCT row) AS nr, count(DISTINCT col) AS nc, count(*) AS n, count(z) AS f FROM g GROUP BY 1),
o AS (SELECT map, 'cps3' AS file, k // 5 + 5 AS n, string_agg(printf('%.8E', coalesce(z, 1e30)), ' ' ORDER BY k) AS line FROM k GROUP BY 1, k // 5
UNION ALL SELECT map, 'cps3', unnest([0, 1, 2, 3, 4]), unnest(['FSASCI 0 1 COMPUTED 0 1E30 0', 'FSATTR 0 0', printf('FSLIMI %.6f %.6f %.6f %.6f %.6f %.6f', 2.0 * c0, 2.0 * c1, 4.0 * r0, 4.0 * r1, z0, z1), printf('FSNROW %d %d', nr, nc), printf('FSXINC %.6f %.6f', 2.0 * (c1 - c0) / greatest(nc - 1, 1), 4.0 * (r1 - r0) / greatest(nr - 1, 1))]) FROM s
UNION ALL SELECT map, 'xyz', row * 2147483648 + col, printf('%.3f %.3f %.3f', 2.0 * col, 4.0 * row, z) FROM g WHERE z IS NOT NULL
UNION ALL SELECT map, 'json', 0, '{"coordinate_system":"local_pixel_coordinates","georeferenced":false,"grid_role":"interpolation_between_traced_contours","cells":' || n || ',"filled":' || f || '}' FROM s)
SELECT * FROM o
""")
def local_exports(spark, sf_dir):
    """Every line of every export file of three maps."""
    row, col = F.col("l_quantity").cast("bigint"), F.round(F.col("l_discount") * 100).cast("bigint")
    grid = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("map"), row.alias("row"), col.alias("col")).agg(F.max(F.round("l_extendedprice")).alias("z"))
    grid = grid.select("map", "row", "col", (F.col("col") * 2.0).alias("x"), (F.col("row") * 4.0).alias("y"), F.when((F.col("row") + F.col("col")) % 7 > 0, F.col("z")).alias("z"))
    return surface.local_exports(grid, "map")


SPECKS_SQL = "SELECT DISTINCT l_returnflag AS map, l_quantity::BIGINT AS row, l_suppkey % 60 AS col FROM lineitem WHERE l_partkey * 7919 % 1000 < 30"


def _specks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_partkey * 7919 % 1000 < 30")
    return rows.select(F.col("l_returnflag").alias("map"), F.col("l_quantity").cast("bigint").alias("row"), (F.col("l_suppkey") % 60).alias("col")).distinct()


@query(f"""
WITH RECURSIVE p AS ({SPECKS_SQL}), t AS (SELECT p.map, p.row * 1000 + p.col AS a, q.row * 1000 + q.col AS b FROM {TOUCH_SQL}), d AS (SELECT map, a, count(*) <> 2 AS node FROM t GROUP BY ALL),
s AS (SELECT t.map, a, b, x.node AS an, y.node AS bn FROM t JOIN d x USING (map, a) JOIN (SELECT map, a AS b, node FROM d) y USING (map, b)),
w(map, a0, b0, a, b, bn, seq) AS (SELECT map, a, b, a, b, bn, 1 FROM s WHERE an UNION ALL SELECT w.map, a0, b0, s.a, s.b, s.bn, seq + 1 FROM w JOIN s ON w.map = s.map AND s.a = w.b AND s.b <> w.a WHERE NOT w.bn),
k AS (SELECT map, a0, b0, seq AS n FROM w WHERE bn AND (a0, b0) < (b, a)), o AS (SELECT w.map, a0, b0, w.seq, w.b, n + 1 AS n, false AS closed FROM w JOIN k USING (map, a0, b0)),
r(map, a, b) AS (SELECT map, a, a FROM d WHERE NOT node UNION SELECT r.map, r.a, s.b FROM r JOIN s ON r.map = s.map AND r.b = s.a AND NOT s.an AND NOT s.bn),
c AS (SELECT map, a, min(b) AS c, count(*) AS n FROM r GROUP BY ALL), f AS (SELECT * FROM c WHERE (map, c) NOT IN (SELECT map, c FROM c JOIN s USING (map, a) WHERE bn)),
z(map, a0, b0, a, b, seq, n) AS (SELECT f.map, f.a, min(s.b), f.a, min(s.b), 1, any_value(n) FROM f JOIN s USING (map, a) WHERE f.a = f.c GROUP BY f.map, f.a UNION ALL SELECT z.map, a0, b0, s.a, s.b, seq + 1, n FROM z JOIN s ON z.map = s.map AND s.a = z.b AND s.b <> z.a WHERE seq < n),
u AS (SELECT * FROM o UNION ALL SELECT map, a0, b0, 0, a0, n, false FROM (SELECT DISTINCT map, a0, b0, n FROM o) UNION ALL SELECT map, a0, b0, seq, b, n + 1, true FROM z UNION ALL SELECT map, a, min(b), 0, a, any_value(n) + 1, true FROM f JOIN s USING (map, a) WHERE f.a = f.c GROUP BY map, a)
SELECT map, a0 // 1000 AS row0, a0 % 1000 AS col0, b0 // 1000 AS row1, b0 % 1000 AS col1, seq::BIGINT AS seq, b // 1000 AS row, b % 1000 AS col, n::BIGINT AS n, closed FROM u
""")
def skeleton_paths(spark, sf_dir):
    """Every pixel of every line of three maps of specks, in order; a line is named by its first two pixels."""
    out = lines.paths(_specks(spark, sf_dir), "map", Scratch(spark, "paths"))
    first = out.where("seq < 2").groupBy("map", "line").agg(F.min_by("row", "seq").alias("row0"), F.min_by("col", "seq").alias("col0"), F.max_by("row", "seq").alias("row1"), F.max_by("col", "seq").alias("col1"))
    return out.join(first, ["map", "line"]).select("map", "row0", "col0", "row1", "col1", "seq", "row", "col", "n", "closed")


@query()
def joined_lines(spark, sf_dir):
    """The vertices of stitched skeleton lines of three maps in their order."""
    scratch = Scratch(spark, "joined")
    vertices = scratch.table(lines.paths(_specks(spark, sf_dir), "map", scratch).where("not closed and n >= 4").select("map", "line", "seq", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y")))
    ends = traces.tangents(vertices, "line", "seq").join(vertices.select("map", "line").distinct(), "line")
    links = lines.bridges(ends, "map", "line", scratch, [(6.0, 0.82), (12.0, 0.93)])
    return lines.joined(vertices, links, "map", "line", "seq", scratch)


GRID_SQL = "SELECT l_returnflag AS map, floor(l_quantity / 5)::BIGINT AS row, floor(l_discount * 100 / 2 + 0.25)::BIGINT AS col, round(avg(l_extendedprice / 1000), 6) AS z FROM lineitem GROUP BY 1, 2, 3"
CASES_SQL = "(VALUES " + ", ".join(f"({c}, '{e}')" for c, s in surface.CASES.items() for e in s.split()) + ") t(k, seg)"


def _grid(spark, sf_dir):
    by = F.col("l_returnflag").alias("map")
    return table(spark, sf_dir, "lineitem").groupBy(by, F.floor(F.col("l_quantity") / 5).alias("row"), F.floor(F.col("l_discount") * 100 / 2 + 0.25).alias("col")).agg(F.round(F.avg(F.col("l_extendedprice") / 1000), 6).alias("z"))


LEVELS_SQL = f"""g AS ({GRID_SQL}), q AS (SELECT a.map, a.row, a.col, a.z AS z1, b.z AS z2, c.z AS z4, d.z AS z8 FROM g a JOIN g b ON b.map = a.map AND b.row = a.row AND b.col = a.col + 1 JOIN g c ON c.map = a.map AND c.row = a.row + 1 AND c.col = a.col + 1 JOIN g d ON d.map = a.map AND d.row = a.row + 1 AND d.col = a.col),
l AS (SELECT *, unnest(range(ceil(least(z1, z2, z4, z8) / 0.5)::INT, floor(greatest(z1, z2, z4, z8) / 0.5)::INT + 1)) AS i FROM q), k AS (SELECT *, i * 0.5 AS v, (z1 > i * 0.5)::INT + 2 * (z2 > i * 0.5)::INT + 4 * (z4 > i * 0.5)::INT + 8 * (z8 > i * 0.5)::INT AS k FROM l),
p AS (SELECT map, i, row, col, seg, unnest([1, 2]) AS e, CASE WHEN substr(seg, unnest([1, 2]), 1) = 't' THEN [0, row, col] WHEN substr(seg, unnest([1, 2]), 1) = 'b' THEN [0, row + 1, col] WHEN substr(seg, unnest([1, 2]), 1) = 'l' THEN [1, row, col] ELSE [1, row, col + 1] END AS edge,
  CASE substr(seg, unnest([1, 2]), 1) WHEN 't' THEN col + (v - z1) / (z2 - z1) WHEN 'b' THEN col + (v - z8) / (z4 - z8) WHEN 'l' THEN col ELSE col + 1 END AS x, CASE substr(seg, unnest([1, 2]), 1) WHEN 'l' THEN row + (v - z1) / (z8 - z1) WHEN 'r' THEN row + (v - z2) / (z4 - z2) WHEN 't' THEN row ELSE row + 1 END AS y FROM k JOIN {CASES_SQL} USING (k)),
s AS (SELECT a.map, a.i, a.edge AS a, b.edge AS b, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a JOIN p b ON (a.map, a.i, a.row, a.col, a.seg) = (b.map, b.i, b.row, b.col, b.seg) AND a.e = 1 AND b.e = 2),
w(map, i, line, b, seq, x, y, d) AS (SELECT map, i, a, b, 1, x2, y2, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE (t.map, t.i, t.b) = (s.map, s.i, s.a)) UNION ALL SELECT s.map, s.i, line, s.b, seq + 1, s.x2, s.y2, d + sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) FROM w JOIN s ON (s.map, s.i, s.a) = (w.map, w.i, w.b)),
r(map, i, a, b) AS (SELECT map, i, a, b FROM s UNION SELECT r.map, r.i, r.a, s.b FROM r JOIN s ON (s.map, s.i, s.a) = (r.map, r.i, r.b)), c AS (SELECT map, i, a FROM r GROUP BY ALL HAVING bool_or(a = b) AND a = min(b)),
z(map, i, line, b, seq, x, y, d) AS (SELECT map, i, a, b, 1, x2, y2, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) FROM s SEMI JOIN c USING (map, i, a) UNION ALL SELECT s.map, s.i, line, s.b, seq + 1, s.x2, s.y2, d + sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) FROM z JOIN s ON (s.map, s.i, s.a) = (z.map, z.i, z.b) WHERE z.b <> z.line),
u AS (SELECT *, false AS closed FROM w UNION ALL SELECT *, true FROM z), m AS (SELECT map, i, line, max(seq) + 1 AS n, max(d) AS length FROM u GROUP BY ALL HAVING max(seq) >= 3 AND max(d) >= 2),
v AS (SELECT map, i, line, seq, x, y, closed FROM u UNION ALL SELECT s.map, s.i, s.a, 0, x1, y1, closed FROM s JOIN u ON (u.map, u.i, u.line, u.seq) = (s.map, s.i, s.a, 1))"""


@query(f"""
WITH RECURSIVE {LEVELS_SQL}
SELECT map, i * 0.5::DOUBLE AS level, line[1] = 1 AS down, line[2] AS row, line[3] AS col, seq::BIGINT AS seq, round(x, 5) AS x, round(y, 5) AS y, n::BIGINT AS n, round(length, 5) AS length, closed FROM v JOIN m USING (map, i, line)
""")
def contour_paths(spark, sf_dir):
    """Every vertex of every level line of three maps; a line is named by the cell edge that it starts from."""
    segments = surface.contour_segments(_grid(spark, sf_dir), 0.5, ["map"])
    out = surface.contour_paths(segments, Scratch(spark, "levels"), ["map"])
    first = out.where("seq = 0").select("line", (F.col("y") % 1 != 0).alias("down"), F.floor("y").alias("row"), F.floor("x").alias("col"))
    return out.join(first, "line").select("map", "level", "down", "row", "col", "seq", *(F.round(c, 5).alias(c) for c in ("x", "y")), "n", F.round("length", 5).alias("length"), "closed")


@query(f"""
WITH RECURSIVE {LEVELS_SQL}
SELECT map, count(*) AS lines, count(DISTINCT i) AS levels, count(*) FILTER (closed) AS closed, 0::BIGINT AS crossing_pairs FROM v JOIN m USING (map, i, line) WHERE seq = 0 GROUP BY 1
""")
def contour_topology(spark, sf_dir):
    """Lines, levels and rings of three maps; level lines of one surface don't cross."""
    out = surface.contour_paths(surface.contour_segments(_grid(spark, sf_dir), 0.5, ["map"]), Scratch(spark, "levels"), ["map"])
    return surface.topology(out, 1.0, ["map"])


@query("""
WITH g AS (SELECT l_suppkey % 20 AS map, l_linenumber AS k, avg(l_extendedprice) * (1 + l_suppkey % 20 % 3 * 0.3) AS z FROM lineitem GROUP BY 1, 2, l_suppkey % 20 % 3),
v AS (SELECT l_suppkey % 20 AS map, min(l_extendedprice) AS v0, quantile_cont(l_extendedprice, 0.7) AS v1 FROM lineitem GROUP BY 1) SELECT g.map, min(z) >= any_value(v0) - 1e-6 AND max(z) <= any_value(v1) + 1e-6 AS kept FROM g JOIN v USING (map) GROUP BY 1
""")
def range_preserved(spark, sf_dir):
    """Grids of means, of which some are stretched, against the range of their values up to the 70th percentile."""
    by = (F.col("l_suppkey") % 20).alias("map")
    rows = table(spark, sf_dir, "lineitem").select(by, F.col("l_linenumber").alias("k"), F.col("l_extendedprice").alias("v"))
    grid = rows.groupBy("map", "k").agg(F.avg("v").alias("z")).withColumn("z", F.col("z") * (1 + F.col("map") % 3 * 0.3))
    top = rows.groupBy("map").agg(F.percentile("v", F.lit(0.7)).alias("v")).unionByName(rows.groupBy("map").agg(F.min("v").alias("v")))
    return surface.range_kept(grid, top, "v", ["map"])
