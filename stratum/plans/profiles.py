"""Survey profiles: straight segments and their mask, and the transform of labelled lines, on several maps at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles
from ..operators.graph import Scratch
from .lines import INK_SQL
from .registry import query, table

SEGMENTS_SQL = f"""p AS ({INK_SQL} AND l_partkey % 20 > 0), a AS (SELECT k, cos(radians(k * 5.0)) AS c, sin(radians(k * 5.0)) AS s FROM range(36) t(k)),
w AS (SELECT map, row, col, k, floor(col * c + row * s + 0.5)::BIGINT AS rho, row * c - col * s AS t FROM p, a), v AS (SELECT map, k, rho, count(*) AS votes FROM w GROUP BY ALL HAVING count(*) >= 20),
m AS (SELECT map, votes, k AS k0, rho AS rho0, k + i AS ki, rho + j AS rj FROM v, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
b AS (SELECT map, (ki + 36) % 36 AS k, CASE WHEN ki BETWEEN 0 AND 35 THEN rj ELSE -rj END AS rho, min((-votes, k0, rho0)) AS best FROM m GROUP BY ALL),
h AS (SELECT v.* FROM v JOIN b USING (map, k, rho) WHERE best = (-votes, k, rho)),
g AS (SELECT w.*, coalesce((t - lag(t) OVER u > 6)::INT, 0) AS new FROM w SEMI JOIN h USING (map, k, rho) WINDOW u AS (PARTITION BY map, k, rho ORDER BY t, row, col)),
r AS (SELECT *, sum(new) OVER (PARTITION BY map, k, rho ORDER BY t, row, col ROWS UNBOUNDED PRECEDING) AS run FROM g),
s AS (SELECT map, k, rho, run, count(*) AS pixels, min(t) AS a, max(t) AS b FROM r GROUP BY ALL HAVING max(t) - min(t) >= 20),
e AS (SELECT map, k, rho, run, pixels, rho * c - a * s AS x1, rho * s + a * c AS y1, rho * c - b * s AS x2, rho * s + b * c AS y2 FROM (SELECT s.*, a.c, a.s FROM s JOIN a USING (k)))"""


def _pixels(spark, sf_dir):
    ink = table(spark, sf_dir, "lineitem").where("l_partkey % 20 > 0").select(F.col("l_returnflag").alias("map"), F.col("l_quantity").cast("bigint").alias("row"), (F.col("l_suppkey") % 60).alias("col"))
    return ink.where("(row + col) % 4 = 0").distinct()


@query(f"WITH {SEGMENTS_SQL} SELECT map, k::INT AS k, rho, run::BIGINT AS run, pixels, round(x1, 5) AS x1, round(y1, 5) AS y1, round(x2, 5) AS x2, round(y2, 5) AS y2 FROM e")
def hough_segments(spark, sf_dir):
    """Straight runs of pixels on three maps, at steps of five degrees."""
    out = profiles.hough_segments(_pixels(spark, sf_dir), "map", 20, 20.0, 6.0, Scratch(spark, "hough"), 36)
    return out.select("map", "k", "rho", "run", "pixels", *(F.round(c, 5).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(f"""
WITH {SEGMENTS_SQL}, d AS (SELECT p.map, row, col, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, greatest(0, least(1, ((col - x1) * (x2 - x1) + (row - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS f FROM p JOIN e ON p.map = e.map)
SELECT map, row, col FROM p ANTI JOIN (SELECT map, row, col FROM d WHERE sqrt((col - x1 - f * dx) ** 2 + (row - y1 - f * dy) ** 2) <= 1.5 + 1e-9) USING (map, row, col)
""")
def profile_mask(spark, sf_dir):
    """Pixels that are left when the straight segments, three pixels wide, are taken away."""
    pixels, scratch = _pixels(spark, sf_dir), Scratch(spark, "hough")
    segments = scratch.table(profiles.hough_segments(pixels, "map", 20, 20.0, 6.0, scratch, 36))
    return profiles.without_profiles(pixels, segments, "map", 3.0)


@query("""
WITH m AS (SELECT c_nationkey AS map, c_custkey % 9000 + 1500 AS height, c_custkey % 12000 + 1000 AS width FROM customer), s AS (SELECT map, height, width, greatest(0.5, least(height, width) / 8000) AS s FROM m)
SELECT map, height, width, s AS scale, greatest(55, round_even(110 * s, 0))::INT AS component_span, greatest(150, round_even(300 * s, 0))::INT AS votes, greatest(250, round_even(500 * s, 0))::INT AS length, greatest(6, round_even(12 * s, 0))::INT AS gap, greatest(3, round_even(9 * s, 0))::INT AS width_px,
greatest(30, round_even(60 * s, 0))::INT AS border, greatest(75, round_even(150 * s, 0))::INT AS path_points, greatest(7, 14 * s) AS dash_least, 150 * s AS dash_most FROM s
""")
def pixel_limits(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("map"), (k % 9000 + 1500).alias("height"), (k % 12000 + 1000).alias("width"))
    limits = profiles.pixel_limits(F.col("height"), F.col("width"))
    return rows.select("map", "height", "width", *(limits[n].alias("width_px" if n == "width" else n) for n in ("scale", "component_span", "votes", "length", "gap", "width", "border", "path_points", "dash_least", "dash_most")))


def _fit_sql(name: str, rows: str, key: str) -> str:
    """Tables that fit the samples ``rows`` (key, h, a, b, nx, ny, t) per key: scale, turn, dx, dy."""
    return f"""{name}_t AS (SELECT {key}, atan2(avg(sin(2 * h)), avg(cos(2 * h))) / 2 AS th FROM {rows} GROUP BY {key}), {name}_g AS (SELECT r.*, th, a * cos(th) + b * sin(th) AS g FROM {rows} r JOIN {name}_t USING ({key})),
{name}_s AS (SELECT {key}, th, sum(nx * nx) AS xx, sum(nx * ny) AS xy, sum(ny * ny) AS yy, sum(nx * g) AS xg, sum(ny * g) AS yg, sum(g * g) AS gg, sum(nx * t) AS xt, sum(ny * t) AS yt, sum(g * t) AS tg FROM {name}_g GROUP BY ALL),
{name}_d AS (SELECT *, xx * (yy * gg - yg * yg) - xy * (xy * gg - yg * xg) + xg * (xy * yg - yy * xg) AS d FROM {name}_s),
{name}_q AS (SELECT {key}, th, (xt * (yy * gg - yg * yg) - xy * (yt * gg - yg * tg) + xg * (yt * yg - yy * tg)) / d AS dx, (xx * (yt * gg - yg * tg) - xt * (xy * gg - yg * xg) + xg * (xy * tg - yt * xg)) / d AS dy, (xx * (yy * tg - yt * yg) - xy * (xy * tg - yt * xg) + xt * (xy * yg - yy * xg)) / d AS sc FROM {name}_d),
{name} AS (SELECT {key}, CASE WHEN sc < 0 THEN (th + pi() + 2 * pi()) % (2 * pi()) ELSE th END AS turn, least(40, greatest(2, abs(sc))) AS scale, dx, dy FROM {name}_q)"""


@query(f"""
WITH r AS (SELECT s_suppkey // 12 AS map, s_suppkey AS k, radians(s_suppkey * 47 % 180) AS al, (s_suppkey * 97 % 600)::DOUBLE AS x1, (s_suppkey * 61 % 600)::DOUBLE AS y1, s_suppkey % 10 < 3 AS wrong FROM supplier),
w AS (SELECT *, x1 + 200 * cos(al) AS x2, y1 + 200 * sin(al) AS y2, CASE WHEN wrong THEN radians(k * 31 % 180) ELSE 0.3 - al END AS be FROM r),
m AS (SELECT map, k, x1, y1, x2, y2, 5 * (cos(0.3) * x1 + sin(0.3) * y1) + 1000 + k % 7 + CASE WHEN wrong THEN 5000 ELSE 0 END AS u, 5 * (sin(0.3) * x1 - cos(0.3) * y1) - 2000 - k % 5 AS v, -sin(be) AS nx, cos(be) AS ny, ((degrees(al) % 180) + 180) % 180 AS g FROM w),
h AS (SELECT *, radians(g + ((degrees(atan2(ny, nx)) + 90) % 180 + 180) % 180) AS h FROM m), i AS (SELECT unnest(range(7)) / 6 AS i),
p AS (SELECT map, k, h, nx, ny, nx * u + ny * v AS t, nx * (x1 + (x2 - x1) * i) - ny * (y1 + (y2 - y1) * i) AS a, nx * (y1 + (y2 - y1) * i) + ny * (x1 + (x2 - x1) * i) AS b FROM h, i),
c AS (SELECT a.map, a.k AS k1, b.k AS k2, c.k AS k3, greatest(least(abs(a.g - b.g), 180 - abs(a.g - b.g)), least(abs(a.g - c.g), 180 - abs(a.g - c.g)), least(abs(b.g - c.g), 180 - abs(b.g - c.g))) AS turn FROM h a JOIN h b ON a.map = b.map AND a.k < b.k JOIN h c ON a.map = c.map AND b.k < c.k),
z AS (SELECT map, k1, k2, k3, unnest([k1, k2, k3]) AS k FROM c WHERE turn >= 25), zp AS (SELECT (z.map, k1, k2, k3) AS id, p.* FROM z JOIN p USING (map, k)),
{_fit_sql("f", "zp", "id")},
e AS (SELECT id, p.map, p.k, scale, sqrt(avg((scale * (a * cos(turn) + b * sin(turn)) + nx * dx + ny * dy - t) ** 2)) AS e FROM f JOIN p ON p.map = f.id[1] GROUP BY ALL),
n AS (SELECT id, map, count(*) AS n, median(e) AS med, list(k) AS inl FROM e WHERE e <= greatest(300, scale * 25) GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY map ORDER BY n DESC, med, id) AS r FROM n),
bp AS (SELECT p.map AS id, p.* FROM o JOIN p ON p.map = o.map AND list_contains(inl, p.k) WHERE r = 1), {_fit_sql("j", "bp", "id")}
SELECT j.id AS map, round(scale, 5) AS scale, round(turn, 5) AS turn, round(dx, 3) AS dx, round(dy, 3) AS dy, any_value(o.n)::INT AS inliers, (SELECT count(*) FROM h WHERE h.map = j.id) AS matches, round(sqrt(avg((scale * (a * cos(turn) + b * sin(turn)) + nx * j.dx + ny * j.dy - t) ** 2)), 4) AS rms
FROM j JOIN bp USING (id) JOIN o ON o.map = j.id AND o.r = 1 GROUP BY j.id, scale, turn, dx, dy
""")
def robust_transform(spark, sf_dir):
    """Maps of twelve labelled lines, three in ten of them wrong, against lines that a known transform made."""
    k, t = F.col("s_suppkey"), 0.3
    wrong, x1, y1, al = k % 10 < 3, (k * 97 % 600).cast("double"), (k * 61 % 600).cast("double"), F.radians(k * 47 % 180)
    be = F.when(wrong, F.radians(k * 31 % 180)).otherwise(t - al)
    c, s = F.cos(F.lit(t)), F.sin(F.lit(t))
    u, v = 5 * (c * x1 + s * y1) + 1000 + k % 7 + F.when(wrong, 5000).otherwise(0), 5 * (s * x1 - c * y1) - 2000 - k % 5
    rows = table(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 12").alias("map"), k.alias("k"), x1.alias("x1"), y1.alias("y1"), (x1 + 200 * F.cos(al)).alias("x2"), (y1 + 200 * F.sin(al)).alias("y2"), u.alias("u"), v.alias("v"), (-F.sin(be)).alias("nx"), F.cos(be).alias("ny"))
    out = profiles.robust_transform(rows, "map", "k", Scratch(spark, "fit"))
    return out.select("map", F.round("scale", 5).alias("scale"), F.round("turn", 5).alias("turn"), F.round("dx", 3).alias("dx"), F.round("dy", 3).alias("dy"), "inliers", "matches", F.round("rms", 4).alias("rms"))
