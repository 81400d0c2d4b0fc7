"""Batch runs, artifacts, views, traced lines and rasters, on tables that stand in for a report's files and readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import batch, contours, evidence, raster, spatial, status, traces
from ..operators.graph import Scratch
from ..sources import readers
from .maps import PATH_SQL, _paths
from .registry import query, table

JOB_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'accepted' WHEN '2-HIGH' THEN 'review' WHEN '3-MEDIUM' THEN 'not_applicable' WHEN '4-NOT SPECIFIED' THEN 'duplicate' ELSE CASE WHEN o_totalprice > 400000 THEN 'failed' ELSE 'accepted' END END"


def _jobs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.expr(JOB_SQL).alias("status"))


@query(f"""
WITH j AS (SELECT o_custkey, {JOB_SQL} AS s FROM orders)
SELECT o_custkey, count(*) AS candidates, count(*) FILTER (s <> 'duplicate') AS processed, count(*) FILTER (s = 'duplicate') AS duplicates, count(*) FILTER (s = 'accepted') AS accepted, count(*) FILTER (s = 'review') AS review, count(*) FILTER (s = 'not_applicable') AS not_applicable, count(*) FILTER (s = 'failed') AS failed,
  CASE WHEN count(*) FILTER (s IN ('review', 'failed')) > 0 THEN 'review' WHEN count(*) FILTER (s = 'accepted') > 0 THEN 'accepted' ELSE 'not_applicable' END AS quality FROM j GROUP BY 1
""")
def batch_quality(spark, sf_dir):
    return batch.batch_metrics(_jobs(spark, sf_dir), ["o_custkey"], "status")


@query(f"SELECT o_orderkey, CASE WHEN s = 'accepted' AND t = 'P' THEN 'review' ELSE s END AS status, CASE WHEN s = 'accepted' AND t = 'P' THEN 1 ELSE 0 END AS n_reasons FROM (SELECT o_orderkey, o_orderstatus AS t, {JOB_SQL} AS s FROM orders)")
def chart_downgrade(spark, sf_dir):
    rows = _jobs(spark, sf_dir).select("o_orderkey", "status", F.when(F.col("o_orderstatus") == "P", "chart").otherwise("map").alias("content_type"), F.array().cast("array<string>").alias("reasons"))
    return batch.downgraded(rows, "status", "content_type", "reasons").select("o_orderkey", "status", F.size("reasons").alias("n_reasons"))


@query("""
WITH g AS (SELECT 'jobs/' || p_partkey || '/' || p_type AS path, p_type AS name FROM part WHERE p_size < 20), o AS (SELECT CASE WHEN p_size > 30 THEN 'jobs/' ELSE 'old/' END || p_partkey || '/' || p_type AS path, p_type AS name FROM part)
SELECT path, name FROM g UNION ALL SELECT path, name FROM o WHERE name NOT IN ('ECONOMY') AND path NOT LIKE 'jobs/%' AND path NOT IN (SELECT path FROM g)
""")
def preserved_artifacts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    path = lambda root: F.concat(root, F.col("p_partkey").cast("string"), F.lit("/"), "p_type").alias("path")
    new = part.where("p_size < 20").select(path(F.lit("jobs/")), F.col("p_type").alias("name"))
    old = part.select(path(F.when(F.col("p_size") > 30, "jobs/").otherwise("old/")), F.col("p_type").alias("name"))
    return batch.preserved(old, new, "path", "name", ["ECONOMY"], "jobs/")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > 0 AND l_linestatus = 'O' AND l_returnflag <> 'R' AND l_discount < 0.05")
def trusted_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("value"), F.when(F.col("l_linestatus") == "O", "isoline").otherwise("frame").alias("kind"), F.when(F.col("l_returnflag") == "R", "flagged").alias("verdict"), F.when(F.col("l_discount") < 0.05, "label").otherwise("inferred").alias("source"))
    return batch.trusted(rows).select("l_orderkey", "l_linenumber")


@query(f"""
WITH j AS (SELECT o_custkey, o_orderkey, {JOB_SQL} AS s, o_orderstatus AS q FROM orders)
SELECT c_custkey, c_name, arg_max(s, o_orderkey) AS job_status, arg_max(q, o_orderkey) AS quality FROM customer LEFT JOIN j ON c_custkey = o_custkey WHERE c_custkey NOT IN (SELECT o_custkey FROM j WHERE s IN ('not_applicable', 'failed', 'duplicate')) GROUP BY ALL
""")
def map_payload(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("job"), "status", F.col("o_orderstatus").alias("quality"))
    return batch.map_payload(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), jobs, "c_custkey")


@query("SELECT a.s_name AS ident, b.s_name || '_map' AS related FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND starts_with(b.s_name || '_map', a.s_name) UNION ALL SELECT s_name, s_name FROM supplier UNION ALL SELECT s_name || '_map', s_name || '_map' FROM supplier")
def related_runs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("ident"), F.col("s_nationkey").alias("root"))
    return batch.related_runs(s.unionByName(s.withColumn("ident", F.concat("ident", F.lit("_map")))), "ident", "root")


@query("SELECT url, 'source-' || (row_number() OVER (PARTITION BY split_part(url, '/', 4) ORDER BY url) - 1) AS artifact_id, CASE WHEN url LIKE '%.html' THEN 'document' ELSE 'other' END AS category, CASE WHEN url LIKE '%.html' THEN 'text/html' ELSE 'application/octet-stream' END AS media_type FROM pages")
def artifact_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("url", F.split("url", "/")[3].alias("g"))
    return batch.positional_ids(rows, "source", ["url"], ["g"]).select("url", "artifact_id", batch.upload_category("url").alias("category"), T.media_type("url").alias("media_type"))


@query("""
WITH n AS (SELECT doc_id, n_chars::INT AS n, ceil(n_chars / 700)::INT AS c FROM documents)
SELECT doc_id, CASE WHEN n <= 700 THEN [0] ELSE list_transform(range(c), lambda i: round_even(i * (n - 700) / (c - 1), 0)::INT) END AS starts FROM n
""")
def tile_starts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", batch.tile_starts(F.col("n_chars").cast("int"), 700).alias("starts"))


@query("SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber))::INT AS line_no FROM lineitem")
def reading_order(spark, sf_dir):
    return batch.reading_order(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], "l_linenumber", "l_quantity").drop("l_quantity")


@query("""
WITH n AS (SELECT p_brand || '-' || p_size % 10 AS report, count(*) FILTER (p_type = 'ECONOMY') AS n_economy, count(*) FILTER (p_type = 'NONE') AS n_none, array_to_string(list_sort(coalesce(list(DISTINCT p_name) FILTER (p_type = 'ECONOMY'), [])), ',') AS names FROM part WHERE p_size < 40 GROUP BY 1),
a AS (SELECT p_brand || '-' || p_size % 10 AS report, p_type AS agent, CASE WHEN sum(p_partkey) % 9 = 0 THEN NULL WHEN sum(p_partkey) % 9 = 1 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN sum(p_partkey) % 5 = 0 THEN 'review' WHEN sum(p_partkey) % 5 < 4 THEN 'pass' END AS qc FROM part WHERE p_size % 10 < 8 GROUP BY 1, 2),
s AS (SELECT report, string_agg(agent || '=' || coalesce(qc, '-'), ',' ORDER BY agent) AS qc, CASE WHEN bool_or(status IS DISTINCT FROM 'completed') THEN 'failed' WHEN bool_or(coalesce(qc = 'review', false)) THEN 'review' ELSE 'completed' END AS status FROM a GROUP BY 1)
SELECT coalesce(n.report, s.report) AS report, coalesce(n_economy, 0) AS n_economy, coalesce(n_none, 0) AS n_none, coalesce(names, '') AS names, coalesce(qc, '') AS qc, coalesce(status, 'completed') AS status FROM n FULL JOIN s ON n.report = s.report
""")
def report_bundle(spark, sf_dir):
    """Brands and sizes as reports, types as agents; some reports have no agents, some no entities."""
    part, report = table(spark, sf_dir, "part"), F.concat_ws("-", "p_brand", (F.col("p_size") % 10).cast("string")).alias("report")
    n = F.sum("p_partkey")
    agents = part.where("p_size % 10 < 8").groupBy(report, F.col("p_type").alias("agent")).agg(F.when(n % 9 == 1, "failed").when(n % 9 > 1, "completed").alias("status"), F.when(n % 5 == 0, "review").when(n % 5 < 4, "pass").alias("qc"))
    out = batch.bundle(part.where("p_size < 40").select(report, "p_type", "p_name"), "report", "p_type", "p_name", ["ECONOMY", "NONE"], agents)
    verdicts = F.array_join(F.transform(F.array_sort(F.map_entries("qc")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-")))), ",")
    return out.select("report", out.counts["ECONOMY"].alias("n_economy"), out.counts["NONE"].alias("n_none"), F.array_join(out.names["ECONOMY"], ",").alias("names"), verdicts.alias("qc"), "status")


@query("SELECT event_type, count(*) AS requests, count(*) FILTER (value < 1) AS errors, round(avg(value), 2) AS latency FROM events GROUP BY 1")
def service_metrics(spark, sf_dir):
    return batch.service_metrics(table(spark, sf_dir, "events"), ["event_type"], "value", F.col("value") < 1)


@query("SELECT split_part(url, '/', 3) AS root, count(*) FILTER (url LIKE '%.html') AS scans FROM pages GROUP BY 1 HAVING scans > 0")
def scan_roots(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", r"^\w+://", ""), r"\.html$", ".pdf").alias("path"))
    return readers.report_roots(files, "path")


@query("SELECT s_name || CASE WHEN s_suppkey % 3 = 0 THEN '_map_1' ELSE '' END AS ident FROM supplier UNION ALL SELECT s_name || '_map_2' FROM supplier WHERE s_suppkey % 3 = 0")
def visible_reports(spark, sf_dir):
    """Reports without the map runs of existing parents: every supplier divisible by three has no parent here, the others hide theirs."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("ident"))
    third = s.where("s_suppkey % 3 = 0").withColumn("ident", F.explode(F.array(F.concat("ident", F.lit("_map_1")), F.concat("ident", F.lit("_map_2")))))
    rest = s.where("s_suppkey % 3 <> 0").withColumn("ident", F.explode(F.array("ident", F.concat("ident", F.lit("_map_1")))))
    return status.hide_children(third.unionByName(rest).select("ident"), "ident")


@query("SELECT o_orderkey, c.o IS NOT NULL AS reuse FROM orders LEFT JOIN (SELECT DISTINCT o_orderkey AS o, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F') c ON c.o = o_orderkey AND c.p = o_totalprice")
def result_reuse(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return status.reusable(rows, rows.where("o_orderstatus = 'F'"), ["o_orderkey", "o_totalprice"]).select("o_orderkey", "reuse")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_nationkey < 12 THEN 'accepted' ELSE 'review' END AS status, array_to_string(list_filter([CASE WHEN c_acctbal <= 0 THEN 'a' END, 'b', CASE WHEN c_nationkey >= 12 THEN 'c' END], lambda x: x IS NOT NULL), ',') AS reasons FROM customer")
def combined_verdict(spark, sf_dir):
    a, b = F.col("c_acctbal") > 0, F.col("c_nationkey") < 12
    st = lambda ok: F.when(ok, "accepted").otherwise("review")
    both = evidence.combined_quality(st(a), evidence.reasons(("a", ~a), ("b", F.lit(True))), st(b), evidence.reasons(("b", F.lit(True)), ("c", ~b)))
    return table(spark, sf_dir, "customer").select("c_custkey", both.alias("q")).select("c_custkey", "q.status", F.array_join("q.reasons", ",").alias("reasons"))


@query("""
WITH p AS (SELECT c_custkey, (c_custkey % 101) * 10.0::DOUBLE AS x, c_acctbal AS y FROM customer)
SELECT a.c_custkey, count(*) >= 3 AS corridor FROM p a JOIN p b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 40 GROUP BY 1
""")
def profile_corridor(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 101 * 10.0).alias("x"), F.col("c_acctbal").alias("y"))
    return traces.corridor(p, "c_custkey", 40.0).select("c_custkey", "corridor")


@query("""
WITH s AS (SELECT s_suppkey AS id, (s_suppkey % 101) * 10.0::DOUBLE AS x, s_acctbal AS y FROM supplier), c AS (SELECT c_custkey + 1000000 AS id, (c_custkey % 101) * 10.0::DOUBLE AS x, c_acctbal AS y FROM customer)
SELECT id FROM s UNION ALL SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2) <= 100)
""")
def fused_readings(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 101 * 10.0).alias("x"), F.col("s_acctbal").alias("y"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000000).alias("id"), (F.col("c_custkey") % 101 * 10.0).alias("x"), F.col("c_acctbal").alias("y"))
    return spatial.fuse(s, c, "id", 100.0).select("id")


@query("""
WITH s AS (SELECT s_suppkey, s_nationkey, (s_suppkey % 101) * 10.0::DOUBLE AS x, s_acctbal AS y FROM supplier), c AS (SELECT c_custkey, c_mktsegment, (c_custkey % 101) * 10.0::DOUBLE AS x, c_acctbal AS y FROM customer),
d AS (SELECT s_suppkey, s_nationkey, c_mktsegment, row_number() OVER (PARTITION BY s_suppkey ORDER BY sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2), c_custkey) AS r FROM s, c WHERE sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2) <= 120),
v AS (SELECT c_mktsegment, s_nationkey, count(*) AS c, min(s_suppkey) AS f FROM d WHERE r = 1 GROUP BY ALL), t AS (SELECT c_mktsegment, sum(c) AS total, count(*) AS kinds FROM v GROUP BY 1), b AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c DESC, f) AS k FROM v)
SELECT c_mktsegment, s_nationkey, c AS votes, total::BIGINT AS total, CASE WHEN kinds = 1 OR c >= 2 * (total - c) THEN 'confident' ELSE 'conflict' END AS verdict FROM b JOIN t USING (c_mktsegment) WHERE k = 1
""")
def assign_values(spark, sf_dir):
    labels = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 101 * 10.0).alias("x"), F.col("s_acctbal").alias("y"))
    vertices = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vertex"), "c_mktsegment", (F.col("c_custkey") % 101 * 10.0).alias("x"), F.col("c_acctbal").alias("y"))
    return traces.assign_values(labels, vertices, "c_mktsegment", "s_suppkey", "s_nationkey", 120.0)


@query("""
WITH p AS (SELECT l_suppkey, CASE WHEN l_discount > 0.02 THEN l_quantity / 10 END AS z FROM lineitem), s AS (SELECT l_suppkey, count(*) AS n, count(z) AS f, round_even(median(abs(z)) / 0.1, 0) * 0.1 AS snapped, quantile_cont(abs(z), 0.9) - quantile_cont(abs(z), 0.1) AS spread FROM p GROUP BY 1),
r AS (SELECT l_suppkey, median(abs(abs(z) - snapped)) AS residual FROM p JOIN s USING (l_suppkey) GROUP BY 1)
SELECT l_suppkey, round(f / n, 6) AS coverage, round(-snapped, 6) AS value, round(spread, 6) AS spread, round(residual, 6) AS residual, f / n >= 0.2 AND f >= 5 AND residual <= 1.2 AND spread <= 4 AS accepted FROM s JOIN r USING (l_suppkey)
""")
def trace_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_discount") > 0.02, F.col("l_quantity") / 10).alias("z"))
    out = traces.surface_values(rows, "l_suppkey", "z", 0.1, most_spread=4.0, most_residual=1.2)
    return out.select("l_suppkey", *(F.round(c, 6).alias(c) for c in ("coverage", "value", "spread", "residual")), "accepted")


@query("SELECT l_returnflag, count(*) AS candidates, count(e) AS compared, round(median(e), 6) AS median_error, round(quantile_cont(e, 0.9), 6) AS p90_error, round(avg((e <= 5)::INT), 6) AS within_rate FROM (SELECT l_returnflag, CASE WHEN l_tax > 0.01 THEN abs(l_quantity - l_extendedprice / 2000) END AS e FROM lineitem) GROUP BY 1")
def label_crosscheck(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice") / 2000).alias("p"))
    out = traces.crosscheck(rows, ["l_returnflag"], "l_quantity", "p", 5.0)
    return out.select("l_returnflag", "candidates", "compared", *(F.round(c, 6).alias(c) for c in ("median_error", "p90_error", "within_rate")))


@query(f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM ({PATH_SQL})),
e AS (SELECT user_id, 'start' AS "end", min_by(x, a) AS x, min_by(y, a) AS y, max_by(x, a) AS qx, max_by(y, a) AS qy FROM p WHERE a <= 12 GROUP BY 1 UNION ALL SELECT user_id, 'stop', min_by(x, b), min_by(y, b), max_by(x, b), max_by(y, b) FROM p WHERE b <= 12 GROUP BY 1)
SELECT user_id, "end", round((x - qx) / sqrt((x - qx) ** 2 + (y - qy) ** 2), 4) AS dx, round((y - qy) / sqrt((x - qx) ** 2 + (y - qy) ** 2), 4) AS dy FROM e WHERE (x - qx) ** 2 + (y - qy) ** 2 > 0
""")
def end_tangents(spark, sf_dir):
    return traces.tangents(_paths(spark, sf_dir), "user_id", "event_id").select("user_id", "end", F.round("dx", 4).alias("dx"), F.round("dy", 4).alias("dy"))


@query()
def simplified_lines(spark, sf_dir):
    return traces.simplify(_paths(spark, sf_dir), "user_id", "event_id", 5.0)


@query("""
WITH u AS (SELECT DISTINCT p_brand, round(p_retailprice / 1000, 3) AS v FROM part), s(step) AS (VALUES (0.5::DOUBLE), (0.25), (0.2), (0.1), (0.05)),
r AS (SELECT p_brand, step, round(v - floor(v / step) * step, 6) AS rem FROM u, s), q AS (SELECT p_brand, step, rem, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT a.p_brand, a.step, a.rem, sum(CASE WHEN least(abs(a.rem - b.rem), a.step - abs(a.rem - b.rem)) <= least(0.012, a.step * 0.15) + 1e-9 THEN b.n ELSE 0 END) / sum(b.n) AS share, sum(b.n) AS total FROM q a JOIN q b ON a.p_brand = b.p_brand AND a.step = b.step GROUP BY ALL),
m AS (SELECT p_brand, step, round(max(share), 4) AS support FROM h WHERE total >= 3 GROUP BY ALL), b AS (SELECT p_brand, max(support) AS best, max(CASE WHEN support >= 0.7 THEN step END) AS sure FROM m GROUP BY 1)
SELECT p_brand, max(step) AS step FROM m JOIN b USING (p_brand) WHERE (sure IS NOT NULL AND step = sure) OR (sure IS NULL AND support >= best - 0.12) GROUP BY 1
""")
def contour_step(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", (F.col("p_retailprice") / 1000).alias("v"))
    return contours.infer_interval(contours.interval_support(rows, "v", ["p_brand"]), ["p_brand"]).select("p_brand", "step")


def _pixels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.lit(1).alias("map"), (F.col("l_partkey") % 90).alias("row"), (F.col("l_suppkey") % 80).alias("col"), F.col("l_quantity")).groupBy("map", "row", "col").agg(F.min("l_quantity").alias("gray"))


PIXEL_SQL = "SELECT l_partkey % 90 AS row, l_suppkey % 80 AS col FROM lineitem GROUP BY 1, 2 HAVING min(l_quantity) < 4"


@query(f"""
WITH p AS ({PIXEL_SQL}) SELECT a.row, a.col, count(b.row) AS degree, count(b.row) <> 2 AS node FROM p a LEFT JOIN p b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col) GROUP BY ALL
""")
def skeleton_degrees(spark, sf_dir):
    return raster.skeleton_degrees(raster.ink(_pixels(spark, sf_dir), "gray", 4), "map").select("row", "col", "degree", "node")


@query(f"""
WITH RECURSIVE p AS (SELECT *, row * 1000 + col AS id FROM ({PIXEL_SQL})), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.id <> b.id), r(a, b) AS (SELECT id, id FROM p UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS id, min(b) AS root FROM r GROUP BY 1), x AS (SELECT root, count(*) AS area, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM c JOIN p USING (id) GROUP BY 1)
SELECT area, r0, r1, c0, c1 FROM x WHERE greatest(r1 - r0, c1 - c0) + 1 >= 3
""")
def pixel_components(spark, sf_dir):
    return raster.pixel_components(raster.ink(_pixels(spark, sf_dir), "gray", 4), "map", Scratch(spark, "pixels"), 3).select("area", "r0", "r1", "c0", "c1")


@query()
def thinned_raster(spark, sf_dir):
    return raster.thin(raster.ink(_pixels(spark, sf_dir), "gray", 10), "map")


@query()
def smooth_surface(spark, sf_dir):
    marks = table(spark, sf_dir, "supplier").select(F.lit(1).alias("map"), (F.col("s_suppkey") % 101 * 10.0).alias("x"), (F.col("s_acctbal") / 20).alias("y"), F.col("s_nationkey").cast("double").alias("value"))
    return raster.thin_plate(marks, "map", 50.0, hull=True).withColumn("z", F.round("z", 4))


@query("SELECT vec_id, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v))) > 0 AS nonzero, list_sum(list_transform(range(1, 64), lambda i: (embedding[i + 1] > embedding[i])::INT))::INT AS rising FROM embeddings")
def vector_features(spark, sf_dir):
    rising = F.aggregate(G.rising_bits("embedding"), F.lit(0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.sqrt(G.dot("embedding", "embedding")) > 0).alias("nonzero"), rising.alias("rising"))
