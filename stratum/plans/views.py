"""Stages, jobs, agents, readings and scalar rules, on business tables that stand in for reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import retrieval, routing, spatial, surface, views
from .registry import query, table

STAGE_SQL = "SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'ocr' WHEN o_orderkey % 3 = 1 THEN 'markdown' ELSE 'index' END AS stage, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderkey AS moment FROM orders"


def _updates(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    return table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.when(k == 0, "ocr").when(k == 1, "markdown").otherwise("index").alias("stage"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
        F.col("o_orderkey").alias("at"),
        F.create_map(F.lit("pages"), F.col("o_orderkey") % 100, F.col("o_orderstatus"), F.lit(1).cast("bigint")).alias("metrics"),
    )


@query(f"""
WITH u AS ({STAGE_SQL}), s AS (SELECT o_custkey, stage, arg_max(status, moment) AS status FROM u GROUP BY ALL), d AS (SELECT o_custkey, count(*) AS n FROM s WHERE status = 'completed' AND stage IN ('ocr', 'markdown') GROUP BY 1)
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'running' WHEN c_acctbal > 3000 AND coalesce(n, 0) = 2 THEN 'completed' WHEN c_acctbal > 3000 THEN 'running' WHEN c_acctbal > 0 THEN 'failed' ELSE 'pending' END AS worker_status FROM customer LEFT JOIN d ON c_custkey = o_custkey
""")
def worker_status(spark, sf_dir):
    stages = _updates(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey"), "stage").agg(F.max_by("status", "at").alias("status"))
    status = F.when(F.col("c_acctbal") > 3000, "running").when(F.col("c_acctbal") > 0, "failed")
    reports = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 7 == 0).alias("lock"), status.alias("status"))
    return views.worker_status(reports, stages, "c_custkey", ["ocr", "markdown"]).select("c_custkey", "worker_status")


@query(f"""
WITH u AS ({STAGE_SQL}), d AS (SELECT DISTINCT o_custkey, unnest(['ocr', 'markdown', 'index', 'export']) AS stage FROM orders),
s AS (SELECT o_custkey, stage, arg_max(status, moment) AS st, count(*) FILTER (status = 'running') AS n, min(moment) FILTER (status = 'running') AS a, max(moment) FILTER (status IN ('completed', 'failed')) AS z, arg_max(moment % 100, moment) AS pages FROM u GROUP BY ALL)
SELECT d.o_custkey, d.stage, coalesce(st, 'pending') AS status, coalesce(n, 0) AS attempts, a AS started_at, z AS finished_at, pages FROM d LEFT JOIN s ON d.o_custkey = s.o_custkey AND d.stage = s.stage
""")
def stage_states(spark, sf_dir):
    out = views.stage_states(_updates(spark, sf_dir), "o_custkey", ["ocr", "markdown", "index", "export"])
    return out.withColumn("pages", F.element_at("metrics", "pages")).drop("metrics")


@query("""
WITH j AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'accepted' END AS r, CASE WHEN p_size % 2 = 0 THEN p_size END AS pid, p_size % 4 = 0 AS alive FROM part)
SELECT p_partkey, CASE WHEN r IS NOT NULL THEN r WHEN pid IS NOT NULL AND NOT alive THEN 'failed' ELSE 'queued' END AS state, CASE WHEN r IS NULL AND pid IS NOT NULL AND NOT alive THEN 'worker_exited_without_manifest' END AS error FROM j
""")
def job_view(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "accepted").alias("r"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("pid"), (F.col("p_size") % 4 == 0).alias("alive"), F.lit("queued").alias("s"))
    return views.job_view(rows, "r", "pid", "alive", "s").select("p_partkey", "state", "error")


@query(r"""
WITH j AS (SELECT p_partkey, replace(p_name, ' ', '-') || CASE p_partkey % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.tiff' WHEN 2 THEN '.exe' ELSE '' END AS n, p_retailprice / 1000 - 0.5 AS s, p_size::BIGINT * 8000000 AS b, CASE p_partkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'review' ELSE 'failed' END AS st FROM part)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 4 > 1 THEN 'suffix' END, CASE WHEN s <= 0 OR s > 1 THEN 'scale' END, CASE WHEN b > 262144000 THEN 'size' END], lambda x: x IS NOT NULL), ',') AS refused, p_partkey % 4 = 3 AND st <> 'failed' AS georeferenceable FROM j
""")
def job_guards(spark, sf_dir):
    k = F.col("p_partkey")
    ending = F.when(k % 4 == 0, ".PNG").when(k % 4 == 1, ".tiff").when(k % 4 == 2, ".exe").otherwise("")
    status = F.when(k % 3 == 0, "accepted").when(k % 3 == 1, "review").otherwise("failed")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), ending).alias("n"), (F.col("p_retailprice") / 1000 - 0.5).alias("s"), (F.col("p_size").cast("bigint") * 8_000_000).alias("b"), status.alias("st"))
    return rows.select("p_partkey", F.array_join(views.refusals("n", "s", "b"), ",").alias("refused"), views.georeferenceable("n", "st").alias("georeferenceable"))


@query("SELECT o_custkey, arg_max(o_orderkey || '.json', (o_orderdate, o_orderkey || '.json')) AS path FROM orders GROUP BY 1")
def latest_manifest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(".json")).alias("path"), "o_orderdate")
    return views.latest(rows, ["o_custkey"], "path", "o_orderdate")


@query("""
WITH a AS (SELECT l_orderkey, count(*) AS n, coalesce(round(sum((1 - l_discount)::DECIMAL(20, 10)) FILTER (l_linenumber <> 2)::DOUBLE / count(*) FILTER (l_linenumber <> 2), 9), 0) AS c FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, count(*) AS n, round(sum((1 - l_tax)::DECIMAL(20, 10))::DOUBLE / count(*), 9) AS c FROM lineitem WHERE l_quantity > 10 GROUP BY 1)
SELECT a.l_orderkey, CASE WHEN (a.n < 3 OR a.c < 0.93) AND b.c > a.c THEN b.n ELSE a.n END AS lines, round(CASE WHEN (a.n < 3 OR a.c < 0.93) AND b.c > a.c THEN b.c ELSE a.c END, 6) AS confidence, CASE WHEN (a.n < 3 OR a.c < 0.93) AND b.c > a.c THEN 'enhanced_retry' ELSE 'original' END AS preprocessing FROM a LEFT JOIN b USING (l_orderkey)
""")
def ocr_retry(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    first = views.confidence(rows.withColumn("s", F.when(F.col("l_linenumber") != 2, 1 - F.col("l_discount"))), ["l_orderkey"], "s")
    second = views.confidence(rows.where("l_quantity > 10").withColumn("s", 1 - F.col("l_tax")), ["l_orderkey"], "s")
    return views.better_reading(first, second, ["l_orderkey"]).withColumn("confidence", F.round("confidence", 6))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 20 BETWEEN 20 AND 980 AND l_suppkey % 1000 BETWEEN 20 AND 820 THEN 'map_body' ELSE 'outside' END AS zone, coalesce(1 - l_discount * 4, 0) < 0.8 AS unreadable FROM lineitem
""")
def readable_zone(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 20).alias("x"), (F.col("l_suppkey") % 1000).alias("y"), (1 - F.col("l_discount") * 4).alias("s"))
    return rows.withColumns(views.readable("x", "y", F.lit(1000.0), F.lit(1000.0), "s")).select("l_orderkey", "l_linenumber", "zone", "unreadable")


MESSAGES = ["Only 2 traced contours passed QC", "2 traced contours passed QC", "need at least one array to concatenate (0)", "Cannot infer contour interval from fewer than three labels", "Only that", "Only 4 valid depth constraints; at least 5 are required"]


@query("SELECT p_partkey, p_partkey % 6 IN (0, 2, 3, 5) AS too_little FROM part")
def support_messages(spark, sf_dir):
    message = F.get(F.lit(MESSAGES), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", message.alias("m")).select("p_partkey", views.too_little("m").alias("too_little"))


@query("""
SELECT s_nationkey, sha256('v1[' || string_agg('{"id":' || s_suppkey || ',"path":"' || s_name || '","kind":' || CASE WHEN s_suppkey % 2 = 0 THEN '"map"' ELSE 'null' END || '}', ',' ORDER BY s_suppkey) || ']') AS signature FROM supplier GROUP BY 1
""")
def map_signature(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("id"), F.col("s_name").alias("path"), F.when(F.col("s_suppkey") % 2 == 0, "map").alias("kind"))
    return views.signature(rows, ["s_nationkey"], "id", ["id", "path", "kind"], "v1")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size * 10 END AS width, CASE WHEN p_size % 2 = 0 THEN p_partkey::INT + 1 END AS height FROM part")
def pixel_size(spark, sf_dir):
    said = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("scan "), (F.col("p_size") * 10).cast("string"), F.lit("x"), (F.col("p_partkey") + 1).cast("string"), F.lit(" px"))).otherwise("no size")
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("t")).select("p_partkey", views.pixel_size("t").alias("s")).select("p_partkey", "s.width", "s.height")


PIXEL_SQL = "SELECT DISTINCT l_returnflag AS map, l_quantity::BIGINT AS row, l_suppkey % 40 AS col FROM lineitem"


def _pixels(spark, sf_dir, where):
    return table(spark, sf_dir, "lineitem").where(where).select(F.col("l_returnflag").alias("map"), F.col("l_quantity").cast("bigint").alias("row"), (F.col("l_suppkey") % 40).alias("col")).distinct()


@query(f"WITH a AS ({PIXEL_SQL} WHERE l_tax > 0.02), b AS ({PIXEL_SQL} WHERE l_discount > 0.04) SELECT *, (map, row, col) IN (SELECT (map, row, col) FROM b) AS shared FROM a")
def mask_pixels(spark, sf_dir):
    a, b = _pixels(spark, sf_dir, "l_tax > 0.02"), _pixels(spark, sf_dir, "l_discount > 0.04")
    by = ["map"]
    return views.masked(a, b, by).withColumn("shared", F.lit(True)).unionByName(views.masked(a, b, by, keep=False).withColumn("shared", F.lit(False)))


@query(f"""
WITH b AS ({PIXEL_SQL} WHERE l_discount > 0.04), r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS map, round_even(l_quantity * 4.5 * 0.25, 0)::BIGINT AS row, round_even(l_suppkey % 150 * 0.25, 0)::BIGINT AS col FROM lineitem)
SELECT l_orderkey, l_linenumber, (map, row, col) IN (SELECT (map, row, col) FROM b) AS on_mask FROM r
""")
def readings_on_mask(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("map"), (F.col("l_quantity") * 4.5).alias("y"), (F.col("l_suppkey") % 150).cast("double").alias("x"))
    return views.on_mask(rows, _pixels(spark, sf_dir, "l_discount > 0.04"), ["map"], 0.25).select("l_orderkey", "l_linenumber", "on_mask")


@query("SELECT o_custkey, array_to_string(list_sort(list_filter(list_distinct(list(o_orderpriority)), lambda x: x NOT IN ('1-URGENT', '2-HIGH'))), ',') AS unknown FROM orders GROUP BY 1")
def forced_stages(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("f"))
    return rows.select("o_custkey", F.array_join(views.unknown_stages("f", ["1-URGENT", "2-HIGH"]), ",").alias("unknown"))


@query("SELECT o_custkey, arg_min(o_orderpriority, printf('%08d', o_orderkey)) FILTER (o_orderstatus <> 'F') AS dataset FROM orders GROUP BY 1")
def dataset_id(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).otherwise("  ").alias("dataset"), F.format_string("%08d", "o_orderkey").alias("path"))
    return views.first_known(rows, ["o_custkey"], "dataset", "path")


@query("""
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'running' ELSE 'completed' END AS s, list(o_orderkey || '.tif' ORDER BY o_orderkey) FILTER (o_orderstatus = 'F') AS a FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
i AS (SELECT *, CASE WHEN s IS NULL THEN 'map_adapter_waiting' WHEN s <> 'completed' THEN 'map_result_incomplete' WHEN coalesce(len(a), 0) = 0 THEN 'map_artifacts_missing' END AS issue FROM r)
SELECT c_custkey, CASE WHEN issue IS NULL THEN 'completed' ELSE 'blocked' END AS status, issue, CASE WHEN issue IS NULL THEN len(a) ELSE 0 END::INT AS artifacts, CASE WHEN issue IS NULL AND c_custkey % 3 > 0 THEN 'completed' ELSE 'review' END AS export, CASE WHEN c_custkey % 4 = 0 THEN 'registry' WHEN len(a) > 0 THEN 'items' ELSE 'none' END AS source FROM i
""")
def agent_states(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct(F.concat(F.col("o_orderkey").cast("string"), F.lit(".tif")).alias("name"), F.lit("p").alias("path"), (F.col("o_orderstatus") == "F").alias("exists"))).alias("artifacts"))
    k = F.col("c_custkey") % 5
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 1, "running").when(k > 1, "completed").alias("status")).join(own, "c_custkey", "left")
    there = F.exists("artifacts", lambda x: x.exists)
    source = views.first_source(("registry", F.col("c_custkey") % 4 == 0), ("items", there), ("none", F.lit(True)))
    out = views.map_agent(rows, "c_custkey", "status", "artifacts").withColumn("quality", F.when(F.col("c_custkey") % 3 == 0, "review"))
    return out.join(rows.select("c_custkey", source.alias("source")), "c_custkey").select("c_custkey", "status", "issue", F.size("artifacts").alias("artifacts"), views.export_status("status", "quality").alias("export"), "source")


@query("""
WITH s AS (SELECT c_custkey AS k, c_acctbal AS a, coalesce(len(list(o_orderkey) FILTER (o_orderkey IS NOT NULL)), 0) AS n, coalesce(bool_and(o_orderstatus = 'F'), true) AS f FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT k AS c_custkey, unnest(['routing', 'ocr', 'markdown', 'ragflow', 'agents', 'maps', 'bundle']) AS stage,
  unnest([k % 3 <> 0 AND k % 4 <> 0, n > 0 AND f, a > 100 AND f, k % 5 <= k % 7 AND k % 2 = 0, n > 0 AND f, k % 2 = 0 AND k % 3 = 0, k % 11 >= greatest(k % 7, k % 9) AND k % 8 <> 1 AND k % 3 <> 2]) AS valid FROM s
""")
def stage_validators(spark, sf_dir):
    k = F.col("c_custkey")
    ids = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set(F.col("o_orderkey").cast("string")).alias("all"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string"))).alias("f"), F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")))).alias("agents"))
    rows = table(spark, sf_dir, "customer").join(own, "c_custkey", "left").select(
        "c_custkey",
        F.when(k % 3 != 0, "completed").otherwise("running").alias("routing_status"), F.when(k % 4 == 0, F.array(F.lit("x"))).alias("route_vlm"),
        ids(F.col("all")).alias("ocr_queued"), ids(F.col("all")).alias("ocr_expected"), ids(F.col("f")).alias("ocr_results"), F.col("c_acctbal").alias("markdown_bytes"), ids(F.col("f")).alias("markdown_pages"),
        (k % 7).alias("index_time"), (k % 5).alias("markdown_time"), F.lit("d").alias("document_id"), F.when(k % 2 == 0, "DONE").otherwise("RUNNING").alias("index_run"), F.coalesce("agents", F.create_map().cast("map<string,string>")).alias("agents"),
        F.when(k % 2 == 0, "completed").otherwise("failed").alias("map_status"), (k % 3).cast("string").alias("map_signature"), F.lit("0").alias("manifest_signature"),
        (k % 11).alias("bundle_time"), (k % 9).alias("map_time"), F.when(k % 8 == 1, -k).otherwise(k).alias("bundle_report"), F.when(k % 3 == 2, "failed").when(k % 3 == 1, "review").otherwise("completed").alias("bundle_status"), k.alias("report_id"),
    )
    rules = views.validators()
    return rows.select("c_custkey", F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.coalesce(v, F.lit(False)).alias("valid")) for s, v in rules.items()))).alias("x")).select("c_custkey", "x.stage", "x.valid")


@query("SELECT page_id, replace('page:' || page_id, ':', '_') || '.html' AS input_name FROM pages WHERE page_id % 3 <> 0")
def ocr_pending(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("page"), F.lit("a/b.HTML").alias("path"), F.array(F.lit("toc")).alias("reasons"), "page_id")
    queue = views.ocr_queue(pages, "page", "path", "reasons")
    left = views.pending(queue, pages.where("page_id % 3 = 0"), "page")
    return left.select(F.regexp_extract("page", r"(\d+)$", 1).cast("bigint").alias("page_id"), "input_name")


@query("SELECT o_custkey, count(*) AS parts, sum(o_orderkey % 50)::BIGINT AS chunks, bool_or(o_orderstatus = 'F') AS uploaded FROM orders GROUP BY 1")
def ingest_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 50).alias("chunks"), (F.col("o_orderstatus") == "F").alias("uploaded"))
    return views.ingest_summary(rows, ["o_custkey"])


@query("SELECT s_nationkey, array_to_string(list(s_name || '/a = b.tif' ORDER BY s_suppkey), '|') AS paths, sum(CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey * 7 END)::BIGINT AS bytes FROM supplier GROUP BY 1")
def archive_listing(spark, sf_dir):
    size = F.when(F.col("s_suppkey") % 5 == 0, "n/a").otherwise((F.col("s_suppkey") * 7).cast("string"))
    block = F.concat(F.lit("Path = "), "s_name", F.lit("/a = b.tif\r\nSize = "), size, F.lit("\r\nAttributes = A"))
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", block.alias("b")))).alias("l"))
    text = F.concat(F.lit("Path = archive\r\nSize = 99\r\n----------\r\n"), F.array_join(F.transform("l", lambda x: x.b), "\r\n\r\n"), F.lit("\r\n"))
    return rows.select("s_nationkey", text.alias("t")).select("s_nationkey", views.listing("t").alias("x")).select("s_nationkey", F.array_join("x.paths", "|").alias("paths"), "x.bytes")


@query("""
WITH a AS (SELECT o_custkey, 'agent' AS agent, o_orderkey || '.x' AS name, 'f/' || o_orderkey AS path, 'text/plain' AS media_type FROM orders UNION ALL SELECT o_custkey, 'intake', 'graphics_contact_sheet', 'f/' || min(o_orderkey), 'image/jpeg' FROM orders GROUP BY 1 HAVING min(o_orderkey) % 2 = 0)
SELECT o_custkey, agent, name, path, media_type, split_part(path, '/', 2)::BIGINT % 2 = 0 AS exists, CASE WHEN split_part(path, '/', 2)::BIGINT % 2 = 0 THEN split_part(path, '/', 2)::BIGINT * 3 END AS size_bytes FROM a
""")
def report_artifacts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("path", F.concat(F.lit("f/"), F.col("o_orderkey").cast("string")))
    agents = o.groupBy("o_custkey").agg(F.collect_list(F.struct(F.concat(F.col("o_orderkey").cast("string"), F.lit(".x")).alias("name"), "path", F.lit("text/plain").alias("media_type"))).alias("artifacts")).withColumn("agent", F.lit("agent"))
    contact = o.groupBy("o_custkey").agg(F.min_by("path", "o_orderkey").alias("path"))
    return views.artifact_rows(agents, "o_custkey", o.where("o_orderkey % 2 = 0").select("path", (F.col("o_orderkey") * 3).alias("size")), contact)


@query("SELECT round(l_tax, 2) AS value, count(*) AS n, count(DISTINCT l_orderkey) AS pages FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def value_distribution(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy(F.round("l_tax", 2).alias("value")).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("pages"))


@query(r"""
SELECT p_partkey, 'page:' || printf('%05d', p_partkey) || ',page_00007.jpg' AS refs, list_sort(list_distinct(['text:' || printf('%05d', p_partkey), 'text:00007']))[1] AS first_page, CASE WHEN p_size % 2 = 0 THEN p_name ELSE left(trim('  ' || repeat(p_type, 20)), 90) END AS name, replace(p_name, ' ', '_') || '_1.tif' AS safe, 3::INT AS blocks FROM part
""")
def text_scalars(spark, sf_dir):
    five = F.format_string("%05d", "p_partkey")
    text = F.concat(F.lit("[SOURCE_PAGE: page:"), five, F.lit("; path=a] x [SOURCE_PAGE: page_00007.jpg] y"))
    named = T.entity_name(F.lit("well"), F.col("p_size"), [F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("  ")], F.concat(F.lit("  "), F.repeat("p_type", F.lit(20))))
    blocks = F.size(F.split(F.concat(F.lit("head\n## page:1\na\n## page:2 "), "p_name"), r"(?m)(?=^## page:)"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.source_refs(text), ",").alias("refs"), F.get(T.page_ids(text), F.lit(0)).alias("first_page"), named.alias("name"), T.safe_name(F.concat(F.lit("a/b/"), "p_name", F.lit("&&1.tif"))).alias("safe"), blocks.alias("blocks"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 + 1 AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, round(x + w / 2, 6) AS cx, round(y + 1, 6) AS cy, round(greatest(0, least(x + w, 30) - greatest(x, 20)) * greatest(0, least(y + 2, 6) - greatest(y, 4)) / least(greatest(1, w * 2), 20), 6) AS overlap, round((x * 2 + 1), 6) AS moved,
  round(least((x * 7) % 180, 180 - (x * 7) % 180), 6) AS angle, round(abs(4 * y - 3 * x) / 5, 6) AS distance, least(greatest(round_even((x - 1) / 5, 0)::BIGINT, 0), 8)::INT AS snapped, round(1 + 2 * x + 3 * y, 6) AS mapped FROM b
""")
def geometry_scalars(spark, sf_dir):
    x, y, w = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100 + 1
    quad = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + 2), F.array(x, y + 2))
    fixed = F.struct(F.lit(20.0).alias("x0"), F.lit(4.0).alias("y0"), F.lit(30.0).alias("x1"), F.lit(6.0).alias("y1"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", y.alias("y"), quad.alias("q")).withColumns({"c": G.centroid("q"), "b": G.bounds("q")})
    zero, r = F.lit(0.0), lambda c: F.round(c, 6)
    return rows.select(
        "l_orderkey", "l_linenumber", r("c.x").alias("cx"), r("c.y").alias("cy"), r(G.overlap_of_smaller(F.col("b"), fixed)).alias("overlap"), r(G.shift_scale("q", 1.0, 0.0, 2.0)[0][0]).alias("moved"),
        r(G.angle_between(x * 7, zero)).alias("angle"), r(G.line_distance(x, F.col("y"), zero, zero, F.lit(4.0), F.lit(3.0))).alias("distance"), G.snap("l_quantity", 1.0, 5.0, 8).cast("int").alias("snapped"), r(G.affine(x, F.col("y"), F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("mapped"),
    )


@query("SELECT l_returnflag AS map, round(l_quantity, 3) AS x, round(l_discount, 3) AS y, round(median(l_extendedprice), 4) AS z FROM lineitem GROUP BY 1, 2, 3")
def median_of_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("map"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_extendedprice").alias("z"))
    return surface.median_of_duplicates(rows, "z", ["map"]).withColumn("z", F.round("z", 4))


@query("SELECT l_suppkey AS component, count(*) AS n, median(l_quantity) AS x, round(median(l_extendedprice), 4) AS y FROM lineitem GROUP BY 1")
def cluster_medians(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("component"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return spatial.cluster_medians(rows, ["x", "y"]).withColumn("y", F.round("y", 4))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'full_text_corpus' WHEN 1 THEN 'explicit_toc' ELSE '' END AS reasons, p_size % 3 <> p_partkey % 3 AS changed FROM part")
def strategy_upgrade(spark, sf_dir):
    role = lambda c: F.when(c % 3 == 0, "text").when(c % 3 == 1, "toc").otherwise("graphic")
    rows = table(spark, sf_dir, "part").select("p_partkey", routing.fast_ocr_reasons(role(F.col("p_size"))).alias("new"), routing.fast_ocr_reasons(role(F.col("p_partkey"))).alias("old"))
    return rows.select("p_partkey", F.array_join("new", ",").alias("reasons"), routing.needs_upgrade("old", "new").alias("changed"))


@query("""
WITH q AS (SELECT conv_id, turn, 'какие структуры и скважины ' || turn AS question FROM conversations WHERE turn % 2 = 0), e AS (SELECT p_partkey AS entity, CASE p_size % 3 WHEN 0 THEN 'structure' WHEN 1 THEN 'well' ELSE 'map' END AS kind FROM part WHERE p_partkey < 40)
SELECT question, kind, count(*) AS n FROM (SELECT DISTINCT question FROM q), e WHERE kind IN ('structure', 'well') GROUP BY ALL
""")
def question_facts(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("turn % 2 = 0").select(F.concat(F.lit("какие структуры и скважины "), F.col("turn").cast("string")).alias("question")).distinct()
    kind = F.when(F.col("p_size") % 3 == 0, "structure").when(F.col("p_size") % 3 == 1, "well").otherwise("map")
    entities = table(spark, sf_dir, "part").where("p_partkey < 40").select(F.col("p_partkey").alias("entity"), kind.alias("kind"))
    return retrieval.facts_for(asked, "question", entities, "kind", {"structure": ["структур"], "well": ["скважин"], "map": ["карт"]}).groupBy("question", "kind").agg(F.count("*").alias("n"))
