"""Labels, points, lines, grids and their exports, on business tables that stand in for map readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contours, spatial, surface
from ..operators.graph import Scratch
from ..sources import writers
from .registry import query, table


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 101 * 10.0).alias("x"), F.col("c_acctbal").alias("y"))


def _paths(spark, sf_dir):
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    return table(spark, sf_dir, "events").select("user_id", "event_id", (ts / 3600).alias("x"), F.col("value").alias("y"))


PATH_SQL = "SELECT user_id, event_id, (epoch_us(ts) / 1e6 - 1704067200) / 3600 AS x, value AS y FROM events"
CELL_SQL = "SELECT floor(l_quantity / 5)::BIGINT AS row, floor(l_discount * 100 / 2 + 0.25)::BIGINT AS col, sum(l_extendedprice / 1000 * (1 + l_tax)) / sum(1 + l_tax) AS z, max(1 + l_tax) AS weight, count(*) AS n, max(l_extendedprice / 1000) - min(l_extendedprice / 1000) > 1 AS conflict FROM lineitem GROUP BY 1, 2"


def _cells(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 100 / 2 + 0.25).alias("x"), (F.col("l_quantity") / 5).alias("y"), (F.col("l_extendedprice") / 1000).alias("v"), "l_tax")
    return surface.burn(points, "v", 1 + F.col("l_tax"), 1.0)


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, -((round(l_extendedprice * 100)::BIGINT + 10000) // 20000 / 100) AS v FROM lineitem), s AS (SELECT *, round_even(v / 0.1, 0) * 0.1 AS s FROM v)
SELECT l_orderkey, l_linenumber, CASE WHEN v >= 0 THEN NULL WHEN abs(v - s) <= 0.03 THEN round(s, 3) END AS snapped FROM s
""")
def label_snap(spark, sf_dir):
    """Prices over 20,000 as labels of two digits, halves of cents away from zero."""
    label = F.concat(F.lit("−"), F.replace(F.format_string("%.2f", F.round(F.col("l_extendedprice") / 20000, 2)), F.lit("."), F.lit(",")))
    snapped = T.label_value(label, 0.1, 0.03)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", snapped.alias("snapped"))


@query("""
WITH v AS (SELECT o_custkey, o_totalprice / 100000 AS v FROM orders), g AS (SELECT o_custkey, v, coalesce((v - lag(v) OVER w > 0.8)::INT, 0) AS new FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY v)),
r AS (SELECT o_custkey, v, sum(new) OVER (PARTITION BY o_custkey ORDER BY v ROWS UNBOUNDED PRECEDING) AS run FROM g), a AS (SELECT o_custkey, run, count(*) AS n, min(v) AS lo, max(v) AS hi FROM r GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, hi - lo, lo) AS k FROM a)
SELECT o_custkey, round(lo - 0.1, 7) AS low, round(hi + 0.1, 7) AS high, n FROM b WHERE k = 1 AND total >= 6 AND n >= greatest(3, total * 0.25)
""")
def value_band(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_totalprice") / 100000).alias("v"))
    return contours.value_band(rows, "v", ["o_custkey"], 0.1).select("o_custkey", F.round("low", 7).alias("low"), F.round("high", 7).alias("high"), "n")


@query("""
WITH u AS (SELECT DISTINCT p_brand, round(p_retailprice / 1000, 3) AS v FROM part), s(step) AS (VALUES (0.5::DOUBLE), (0.25), (0.2), (0.1), (0.05), (0.025), (0.02), (0.01)),
r AS (SELECT p_brand, step, round(v - floor(v / step) * step, 6) AS rem FROM u, s), q AS (SELECT p_brand, step, rem, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT a.p_brand, a.step, a.rem, sum(CASE WHEN least(abs(a.rem - b.rem), a.step - abs(a.rem - b.rem)) <= least(0.012, a.step * 0.15) + 1e-9 THEN b.n ELSE 0 END) / sum(b.n) AS share, sum(b.n) AS total FROM q a JOIN q b ON a.p_brand = b.p_brand AND a.step = b.step GROUP BY ALL)
SELECT p_brand, step, round(max(share), 4) AS support, max(total)::BIGINT AS levels FROM h GROUP BY ALL
""")
def interval_inference(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", (F.col("p_retailprice") / 1000).alias("v"))
    return contours.interval_support(rows, "v", ["p_brand"])


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS c, min(event_id) AS f FROM events GROUP BY ALL), t AS (SELECT user_id, sum(c) AS total, count(*) AS kinds FROM c GROUP BY 1), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, f) AS k FROM c)
SELECT user_id, event_type, c AS votes, total::BIGINT AS total, CASE WHEN kinds = 1 OR c >= 2 * (total - c) THEN 'confident' ELSE 'conflict' END AS verdict FROM b JOIN t USING (user_id) WHERE k = 1
""")
def majority_vote(spark, sf_dir):
    return contours.votes(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("""
WITH r AS (SELECT l_suppkey * 20 + l_linenumber AS map, CASE WHEN l_quantity < 20 THEN '-' || printf('%.1f', l_quantity / 10) WHEN l_quantity < 40 THEN '−' || (l_quantity * 100)::INT ELSE '' || (l_quantity * 40)::INT END AS t, 1 - l_discount * 4 AS s FROM lineitem),
k AS (SELECT map, CASE WHEN t[1] IN ('-', '−') THEN 'label' WHEN length(t) IN (3, 4) AND t::INT BETWEEN 500 AND 5000 THEN 'mark' END AS kind, CASE WHEN t[1] IN ('-', '−') THEN t[2:]::DOUBLE / CASE WHEN t[2:]::DOUBLE >= 100 THEN 1000 ELSE 1 END END AS v FROM r WHERE s >= 0.75),
g AS (SELECT map, v, coalesce((v - lag(v) OVER (PARTITION BY map ORDER BY v) > 0.8)::INT, 0) AS new FROM k WHERE kind = 'label'), u AS (SELECT map, v, sum(new) OVER (PARTITION BY map ORDER BY v) AS run FROM g), a AS (SELECT map, run, count(*) AS n, min(v) AS lo, max(v) AS hi FROM u GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (PARTITION BY map) AS total, row_number() OVER (PARTITION BY map ORDER BY n DESC, hi - lo, lo) AS q FROM a), z AS (SELECT map, lo - 0.1 AS low, hi + 0.1 AS high FROM b WHERE q = 1 AND total >= 6 AND n >= greatest(3, total * 0.25)),
e AS (SELECT map, count(*) AS retained, count(DISTINCT round(v, 3)) AS levels FROM k LEFT JOIN z USING (map) WHERE kind = 'label' AND (low IS NULL OR v BETWEEN low AND high) GROUP BY 1), c AS (SELECT map, count(*) FILTER (kind = 'label') AS labels, count(*) FILTER (kind = 'mark') AS marks FROM k GROUP BY 1),
o AS (SELECT DISTINCT map, coalesce(labels, 0) AS labels, coalesce(marks, 0) AS marks, coalesce(retained, 0) AS retained, coalesce(levels, 0) AS levels, (1000 + map % 7 * 300) / 1000 AS aspect FROM r LEFT JOIN c USING (map) LEFT JOIN e USING (map)),
f AS (SELECT *, (retained >= 5 AND levels >= 3) OR (marks >= 20 AND retained >= 3) AS good FROM o)
SELECT map, labels, marks, retained, levels, round(aspect, 4) AS aspect, good AND aspect <= 2.5 AS eligible, concat_ws(',', CASE WHEN NOT good THEN 'insufficient_depth_label_evidence' END, CASE WHEN aspect > 2.5 THEN 'extreme_aspect_ratio' END) AS reasons FROM f
""")
def reading_kinds(spark, sf_dir):
    """Suppliers' lines of one number as maps: labels in km and in m, marks, and images of seven shapes."""
    rows, q = table(spark, sf_dir, "lineitem"), F.col("l_quantity")
    text = F.when(q < 20, F.concat(F.lit("-"), F.format_string("%.1f", q / 10))).when(q < 40, F.concat(F.lit("−"), (q * 100).cast("int").cast("string"))).otherwise((q * 40).cast("int").cast("string"))
    rows = rows.select((F.col("l_suppkey") * 20 + F.col("l_linenumber")).alias("map"), text.alias("t"), (1 - F.col("l_discount") * 4).alias("s"))
    sizes = rows.select("map").distinct().select("map", (F.col("map") % 7 * 300 + 1000).alias("height"), F.lit(1000).alias("width"))
    out = contours.eligibility(rows, ["map"], "t", "s", sizes=sizes)
    return out.select("map", "labels", "marks", "retained", "levels", F.round("aspect", 4).alias("aspect"), "eligible", F.array_join("reasons", ",").alias("reasons"))


@query("""
WITH p AS (SELECT c_custkey, (c_custkey % 101) * 10.0::DOUBLE AS x, c_acctbal AS y FROM customer), d AS (SELECT a.c_custkey, b.c_custkey AS o, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, b.y AS v FROM p a JOIN p b ON a.c_custkey <> b.c_custkey),
k AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, o) AS r FROM d), m AS (SELECT c_custkey, median(v) AS m FROM k WHERE r <= 6 GROUP BY 1)
SELECT c_custkey, x, y FROM p JOIN m USING (c_custkey) WHERE abs(y - m) <= 30
""")
def knn_median_filter(spark, sf_dir):
    points, scratch = _customers(spark, sf_dir), Scratch(spark, "knn")
    near = spatial.knn(points, "c_custkey", 6, 50.0, scratch)
    return spatial.local_median_filter(points, near, "c_custkey", "y", 30.0, 7)


@query("""
WITH RECURSIVE p AS (SELECT c_custkey, (c_custkey % 101) * 10.0::DOUBLE AS x, c_acctbal AS y FROM customer), e AS (SELECT a.c_custkey AS a, b.c_custkey AS b FROM p a JOIN p b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 25 AND a.c_custkey <> b.c_custkey),
r(a, b) AS (SELECT c_custkey, c_custkey FROM p UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS c_custkey, min(b) AS component FROM r GROUP BY 1
""")
def radius_components(spark, sf_dir):
    return spatial.clusters(_customers(spark, sf_dir), "c_custkey", 25.0, Scratch(spark, "clusters")).select("c_custkey", "component")


@query("""
WITH s AS (SELECT s_suppkey, (s_suppkey % 101) * 10.0::DOUBLE AS x, s_acctbal AS y FROM supplier), c AS (SELECT c_custkey, (c_custkey % 101) * 10.0::DOUBLE AS x, c_acctbal AS y FROM customer),
d AS (SELECT s_suppkey, c_custkey, sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2) AS distance FROM s, c), k AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY distance, c_custkey) AS r FROM d WHERE distance <= 120)
SELECT s_suppkey, c_custkey, round(distance, 6) AS distance FROM k WHERE r = 1
""")
def nearest_assign(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 101 * 10.0).alias("x"), F.col("s_acctbal").alias("y"))
    return spatial.nearest(s, _customers(spark, sf_dir), 120.0, "s_suppkey", "c_custkey").withColumn("distance", F.round("distance", 6))


@query(f"SELECT row, col, round(z, 6) AS z, round(weight, 6) AS weight, n, conflict FROM ({CELL_SQL})")
def cell_burn(spark, sf_dir):
    return _cells(spark, sf_dir).select("row", "col", F.round("z", 6).alias("z"), F.round("weight", 6).alias("weight"), "n", "conflict")


@query("SELECT l_returnflag, count(*) AS n, round(sqrt(avg(r * r)), 4) AS rmse, round(quantile_cont(abs(r), 0.5), 4) AS median_abs, round(quantile_cont(abs(r), 0.95), 4) AS p95_abs, round(max(abs(r)), 4) AS max_abs FROM (SELECT l_returnflag, l_extendedprice / 1000 - l_quantity AS r FROM lineitem) GROUP BY 1")
def constraint_quality(spark, sf_dir):
    out = spatial.residuals(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice") / 1000 - F.col("l_quantity"), ["l_returnflag"])
    return out.select("l_returnflag", "n", *(F.round(c, 4).alias(c) for c in ("rmse", "median_abs", "p95_abs", "max_abs")))


@query(f"""
WITH p AS ({PATH_SQL}), d AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
e AS (SELECT user_id, count(*) AS n, coalesce(sum(d), 0) AS length, min_by(x, event_id) AS x0, min_by(y, event_id) AS y0, max_by(x, event_id) AS x1, max_by(y, event_id) AS y1 FROM d GROUP BY 1)
SELECT user_id, max(n) AS n, round(max(length), 4) AS length, round(max(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)), 4) AS chord, round(CASE WHEN max(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)) < 1 THEN 0 ELSE max(abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0))) / max((x1 - x0) ** 2 + (y1 - y0) ** 2) END, 4) AS straightness FROM p JOIN e USING (user_id) GROUP BY 1
""")
def polyline_stats(spark, sf_dir):
    out = spatial.polyline_stats(_paths(spark, sf_dir), "user_id", "event_id")
    return out.select("user_id", "n", *(F.round(c, 4).alias(c) for c in ("length", "chord", "straightness")))


@query(f"""
WITH p AS ({PATH_SQL}), s AS (SELECT user_id, event_id, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS d FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), t AS (SELECT user_id, sum(d) AS total FROM s GROUP BY 1)
SELECT user_id, greatest(2, ceil(total / 200)::INT + 1)::BIGINT AS n FROM t WHERE total > 0
""")
def densify(spark, sf_dir):
    return spatial.densify(_paths(spark, sf_dir), "user_id", "event_id", 200.0).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_extendedprice) AS mt, var_pop(l_quantity) AS xx, var_pop(l_discount) AS yy, covar_pop(l_quantity, l_discount) AS xy, covar_pop(l_quantity, l_extendedprice) AS xt, covar_pop(l_discount, l_extendedprice) AS yt FROM lineitem GROUP BY 1),
f AS (SELECT *, (xt * yy - yt * xy) / (xx * yy - xy * xy) AS b, (yt * xx - xt * xy) / (xx * yy - xy * xy) AS c FROM s)
SELECT l_returnflag, n, round(mt - b * mx - c * my, 3) AS a, round(b, 3) AS b, round(c, 3) AS c FROM f
""")
def affine_fit(spark, sf_dir):
    out = spatial.affine_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "n", *(F.round(c, 3).alias(c) for c in "abc"))


@query(f"""
WITH g AS (SELECT row, col, round(z, 6) AS z FROM ({CELL_SQL})), q AS (SELECT a.row, a.col, a.z AS z1, b.z AS z2, c.z AS z4, d.z AS z8 FROM g a JOIN g b ON b.row = a.row AND b.col = a.col + 1 JOIN g c ON c.row = a.row + 1 AND c.col = a.col + 1 JOIN g d ON d.row = a.row + 1 AND d.col = a.col),
l AS (SELECT *, unnest(range(ceil(least(z1, z2, z4, z8) / 0.5)::INT, floor(greatest(z1, z2, z4, z8) / 0.5)::INT + 1)) * 0.5 AS level FROM q),
k AS (SELECT row, col, level, (z1 > level)::INT + 2 * (z2 > level)::INT + 4 * (z4 > level)::INT + 8 * (z8 > level)::INT AS "case" FROM l)
SELECT row, col, level::DOUBLE AS level, "case", CASE WHEN "case" IN (5, 10) THEN 2 ELSE 1 END::BIGINT AS n FROM k WHERE "case" BETWEEN 1 AND 14
""")
def marching_squares(spark, sf_dir):
    grid = _cells(spark, sf_dir).withColumn("z", F.round("z", 6))
    return surface.contour_segments(grid, 0.5).groupBy("row", "col", "level", "case").agg(F.count("*").alias("n"))


@query()
def contour_lines(spark, sf_dir):
    grid = _cells(spark, sf_dir).withColumn("z", F.round("z", 6))
    return surface.contour_lines(surface.contour_segments(grid, 0.5), Scratch(spark, "lines")).select("level", "segments", F.round("length", 6).alias("length"), "closed")


@query()
def harmonic_solve(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("fixed", F.when((F.col("row") + F.col("col")) % 3 == 0, F.col("z")))
    placed = surface.constrained(surface.cell_components(cells, Scratch(spark, "grid")), "fixed")
    return surface.harmonic(placed).select("component", "row", "col", F.round("z", 4).alias("z"))


@query(f"WITH g AS ({CELL_SQL}) SELECT row, col, printf('%.3f', col::DOUBLE) || ' ' || printf('%.3f', row::DOUBLE) || ' ' || printf('%.3f', round(z, 3)) AS line FROM g")
def xyz_export(spark, sf_dir):
    grid = _cells(spark, sf_dir).select("row", "col", F.col("col").alias("x"), F.col("row").alias("y"), F.round("z", 3).alias("z"))
    return surface.xyz_lines(grid)


@query(f"""
WITH g AS ({CELL_SQL}), k AS (SELECT row_number() OVER (ORDER BY col, row DESC) AS k, round(z, 3) AS z FROM g)
SELECT (k - 1) // 5 AS n, count(*) AS n_values, sum(z)::DECIMAL(18, 3)::DOUBLE AS total FROM k GROUP BY 1
""")
def cps3_export(spark, sf_dir):
    grid = _cells(spark, sf_dir).withColumn("z", F.round("z", 3))
    lines = surface.cps3_lines(grid).select("n", F.explode(F.split("line", " ")).alias("v"))
    return lines.groupBy(F.col("n").cast("bigint").alias("n")).agg(F.count("*").alias("n_values"), F.sum(F.col("v").cast("double")).cast("decimal(18,3)").cast("double").alias("total"))


@query("""
WITH p AS (SELECT user_id, event_id, event_type, round(value, 2) AS y FROM events)
SELECT user_id, count(*)::INT AS n_points, min_by(event_type, event_id) AS kind, min_by(y, event_id) AS y0, max_by(y, event_id) AS y1 FROM p GROUP BY 1
""")
def geojson_feature(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("kind"), F.col("event_id").cast("double").alias("x"), F.round("value", 2).alias("y"))
    features = writers.line_features(rows, "user_id", "event_id", ["kind"])
    back = F.from_json("feature", "struct<geometry: struct<coordinates: array<array<double>>>, properties: struct<kind: string>>")
    c = features.select("user_id", back.alias("f")).select("user_id", F.col("f.geometry.coordinates").alias("c"), F.col("f.properties.kind").alias("kind"))
    return c.select("user_id", F.size("c").alias("n_points"), "kind", F.element_at(F.element_at("c", 1), 2).alias("y0"), F.element_at(F.element_at("c", -1), 2).alias("y1"))
