"""Registry, routing, queues and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence, routing, status
from ..operators.graph import Scratch
from ..sources import pdf
from ..streaming import inbox, timers
from .registry import query, table

PATH_SQL = "CASE lang WHEN 'fr' THEN 'Том 1/Текст/' WHEN 'de' THEN 'Том 2/Графика/' WHEN 'es' THEN 'Оглавление/' ELSE source || '/' END || doc_id || '.jpg'"
ROLE_SQL = "CASE WHEN p LIKE '%оглав%' THEN 'toc' WHEN p LIKE '%выборк%' THEN 'sample' WHEN p LIKE '%екст/%' THEN 'text' WHEN p LIKE '%график%' THEN 'graphic' ELSE 'unknown' END"


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH_SQL).alias("path"))


def _roles(spark, sf_dir):
    return _paths(spark, sf_dir).withColumn("r", routing.path_role("path")).select("doc_id", "path", "r.role", "r.volume")


@query(r"""
WITH k AS (SELECT url, array_to_string(list_transform(regexp_extract_all(lower(url), '\d+|\D+'), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN lpad(x, 20, '0') ELSE x END), '') AS key FROM pages)
SELECT url, row_number() OVER (ORDER BY key, url) AS ordinal, printf('page:%05d', row_number() OVER (ORDER BY key, url)) AS page_id FROM k
""")
def page_registry(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("url")
    return routing.with_ordinals(rows, "url", Scratch(spark, "registry")).select("url", "ordinal", "page_id")


@query(rf"""
WITH d AS (SELECT doc_id, {PATH_SQL} AS path FROM documents), l AS (SELECT *, lower(regexp_replace(path, '[^/]*$', '')) AS p FROM d)
SELECT doc_id, {ROLE_SQL} AS role, CASE WHEN path LIKE 'Том %' THEN split_part(path, '/', 1) END AS volume, doc_id::INT AS number,
  {ROLE_SQL} = 'unknown' AS route_vlm, {ROLE_SQL} = 'graphic' AS deep_processing FROM l
""")
def path_role(spark, sf_dir):
    route, deep = routing.initial_flags("role")
    return _roles(spark, sf_dir).select("doc_id", "role", "volume", T.last_number("path").alias("number"), route.alias("route_vlm"), deep.alias("deep_processing"))


@query(rf"""
WITH d AS (SELECT doc_id, lower(regexp_replace({PATH_SQL}, '[^/]*$', '')) AS p FROM documents), r AS (SELECT doc_id, {ROLE_SQL} AS role FROM d)
SELECT doc_id, role, CASE role WHEN 'text' THEN 'full_text_corpus' ELSE 'explicit_toc' END AS reason FROM r WHERE role IN ('text', 'toc')
""")
def fast_ocr_queue(spark, sf_dir):
    rows = _roles(spark, sf_dir).withColumn("reasons", routing.fast_ocr_reasons("role")).where(F.size("reasons") > 0)
    return rows.select("doc_id", "role", F.array_join("reasons", ",").alias("reason"))


@query(rf"""
WITH d AS (SELECT doc_id, lower(regexp_replace({PATH_SQL}, '[^/]*$', '')) AS p FROM documents), r AS (SELECT doc_id, {ROLE_SQL} AS o FROM d),
k AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'map' WHEN quality = 0 THEN 'table' ELSE 'blank' END AS kind, quality::DOUBLE AS confidence FROM labels),
j AS (SELECT r.*, kind, confidence FROM r LEFT JOIN k USING (doc_id)),
n AS (SELECT *, CASE WHEN kind IS NULL THEN o WHEN o IN ('toc', 'text') THEN o WHEN o IN ('graphic', 'sample') THEN 'graphic' WHEN kind = 'map' THEN 'graphic' WHEN kind = 'table' THEN 'text' ELSE 'unknown' END AS role FROM j)
SELECT doc_id, role, CASE WHEN kind IS NULL THEN o = 'unknown' ELSE false END AS route_vlm,
  CASE WHEN kind IS NULL THEN o = 'graphic' WHEN o = 'graphic' THEN true WHEN o IN ('toc', 'text', 'sample') THEN false ELSE kind = 'map' END AS deep_processing,
  kind AS content_type, confidence AS routing_confidence, CASE WHEN kind IS NULL THEN NULL WHEN o <> 'unknown' THEN 'path+preview_vlm' ELSE 'preview_vlm' END AS role_source, role IN ('text', 'toc') AS fast_ocr FROM n
""")
def route_decisions(spark, sf_dir):
    route, deep = routing.initial_flags("role")
    pages = _roles(spark, sf_dir).select("doc_id", "role", F.col("role").alias("path_role"), route.alias("route_vlm"), deep.alias("deep_processing"), routing.fast_ocr_reasons("role").alias("fast_ocr_reasons"))
    kind = F.when(F.col("toxic") == 1, "map").when(F.col("quality") == 0, "table").otherwise("blank")
    decisions = table(spark, sf_dir, "labels").select("doc_id", kind.alias("kind"), F.col("quality").cast("double").alias("confidence"))
    out = routing.apply_decisions(pages, decisions, "doc_id")
    return out.select("doc_id", "role", "route_vlm", "deep_processing", "content_type", "routing_confidence", "role_source", "fast_ocr")


@query("SELECT event_type AS role, count(*) AS n, count(*) FILTER (value > 10) AS large FROM events GROUP BY 1")
def role_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("role")).agg(F.count("*").alias("n"), F.count_if(F.expr("value > 10")).alias("large"))


ROUTES = {"view": ["rag"], "click": ["rag", "map"], "error": ["review"], "purchase": ["rag", "map", "review"]}


@query("""
WITH r(event_type, route) AS (VALUES ('view', 'rag'), ('click', 'rag'), ('click', 'map'), ('error', 'review'), ('purchase', 'rag'), ('purchase', 'map'), ('purchase', 'review'))
SELECT route, count(*) AS n, count(DISTINCT user_id) AS users FROM events JOIN r USING (event_type) GROUP BY 1
""")
def multi_route_explode(spark, sf_dir):
    return routing.exploded_routes(table(spark, sf_dir, "events"), "event_type", ROUTES).groupBy("route").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 12 AS batch, (row_number() OVER (ORDER BY event_id) - 1) % 4 AS shard FROM events")
def batch_shard(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.lpad(F.col("event_id").cast("string"), 20, "0").alias("path"))
    ranked = routing.with_ordinals(rows, "path", Scratch(spark, "batches"))
    return routing.batches(ranked, "ordinal").select("event_id", F.col("batch").cast("bigint").alias("batch"), F.col("shard").cast("bigint").alias("shard"))


@query("""
WITH s AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status FROM orders)
SELECT o_custkey, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'partial' END AS status, count(*) AS n FROM s GROUP BY 1
""")
def stage_rollup(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return status.rollup(table(spark, sf_dir, "orders").select("o_custkey", state.alias("status")), ["o_custkey"], "status", ["failed"], "completed")


@query("""
WITH d(status) AS (VALUES ('F'), ('O'), ('P'), ('X'))
SELECT status, count(o_orderkey) AS n FROM d LEFT JOIN orders ON o_orderstatus = status GROUP BY 1
""")
def zero_filled_queue(spark, sf_dir):
    domain = spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "status string")
    return status.zero_filled(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")), domain, "status")


@query("""
WITH w AS (SELECT o_orderkey, o_custkey, o_orderstatus = 'P' AS pending, sum((o_orderstatus = 'P')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS waiting, 2 - sum((o_orderstatus = 'O')::INT) OVER (PARTITION BY o_custkey) AS free FROM orders)
SELECT o_orderkey, o_custkey, pending AND waiting <= free AS admitted FROM w
""")
def admission(spark, sf_dir):
    rows = routing.admit(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "P", 2, ["o_orderdate", "o_orderkey"], ["o_custkey"])
    return rows.select("o_orderkey", "o_custkey", "admitted")


EDGES = [("bundle", "rag", "requires"), ("rag", "markdown", "requires"), ("markdown", "ocr", "requires"), ("ocr", "routing", "requires"), ("map", "routing", "requires"), ("qc", "rag", "requires"), ("qc", "map", "observes"), ("export", "qc", "requires"), ("export", "map", "observes")]


NODE_SQL = "SELECT p_partkey AS name, CASE p_size % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'failed' WHEN 3 THEN 'blocked' ELSE 'pending' END AS status FROM part"
EDGE_SQL = "SELECT p_partkey AS child, (p_partkey * 7 + 3) % 200 AS parent, CASE WHEN p_size % 2 = 0 THEN 'requires' ELSE 'observes' END AS kind FROM part UNION ALL SELECT p_partkey, (p_partkey + p_size) % 200, 'observes' FROM part WHERE p_size > 20"


def _graph(spark, sf_dir):
    """Parts as nodes of a graph of dependencies."""
    part, k, size = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    state = F.when(size % 6 == 0, "completed").when(size % 6 == 1, "skipped").when(size % 6 == 2, "failed").when(size % 6 == 3, "blocked").otherwise("pending")
    first = part.select(k.alias("child"), ((k * 7 + 3) % 200).alias("parent"), F.when(size % 2 == 0, "requires").otherwise("observes").alias("kind"))
    return part.select(k.alias("name"), state.alias("status")), first.unionByName(part.where("p_size > 20").select(k.alias("child"), ((k + size) % 200).alias("parent"), F.lit("observes").alias("kind")))


@query(f"WITH RECURSIVE e AS ({EDGE_SQL}), r(node) AS (SELECT p_partkey FROM part WHERE p_size = 13 UNION SELECT child FROM e JOIN r ON parent = node) SELECT node FROM r")
def dag_invalidate(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    return status.invalidated(spark, edges, table(spark, sf_dir, "part").where("p_size = 13").select(F.col("p_partkey").alias("node")), Scratch(spark, "dag"))


@query(f"""
WITH n AS ({NODE_SQL}), e AS ({EDGE_SQL}), s AS (SELECT child, kind = 'requires' AS must, p.status AS p FROM e LEFT JOIN n p ON p.name = parent),
j AS (SELECT child, bool_and(CASE WHEN must THEN p IN ('completed', 'skipped') ELSE p <> 'pending' END) AS ok, bool_or(must AND p IN ('failed', 'blocked')) AS bad FROM s GROUP BY 1)
SELECT name, CASE WHEN bad THEN 'blocked' WHEN ok THEN 'ready' ELSE 'waiting' END AS verdict FROM n JOIN j ON child = name WHERE status = 'pending'
""")
def dag_ready(spark, sf_dir):
    return status.ready(*_graph(spark, sf_dir))


@query("SELECT event_type, event_id, age FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INT AS age FROM events) WHERE age <= 300")
def event_cap(spark, sf_dir):
    return status.capped_log(table(spark, sf_dir, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_type", "event_id", "age")


@query("""
WITH g AS (SELECT l_partkey AS p, count(*) FILTER (l_returnflag = 'N') AS confident, count(*) FILTER (l_returnflag = 'R') AS conflicting, count(*) FILTER (l_quantity > 49) AS crossings, count(DISTINCT l_suppkey) + l_partkey % 40 AS levels, count(*) FILTER (l_linestatus = 'F') AS closed, count(*) // 4 AS support, count(*) AS compared, count(*) FILTER (l_discount < 0.055) / count(*) AS within_rate, max(l_tax) * 1000 AS p95 FROM lineitem GROUP BY 1),
m AS (SELECT *, p % 20 AS ids, p % 3 = 0 AS preserving, 100 + p % 100 AS interval, p % 7 > 0 AS kept, CASE WHEN p % 5 > 0 THEN p % 10 / 10 END AS inferred FROM g),
r AS (SELECT *, list_filter([CASE WHEN confident < 3 THEN 'fewer_than_3_direct_contours' END, CASE WHEN conflicting >= 3 AND conflicting / greatest(1, confident + conflicting) > 0.35 THEN 'high_direct_contour_conflict_rate' END, CASE WHEN crossings > 0 THEN 'contour_crossings' END,
  CASE WHEN closed > greatest(8, least(greatest(1, levels) * 2, greatest(1, support) * 2)) THEN 'excessive_closed_contours' END, CASE WHEN levels > 40 THEN 'excessive_contour_levels' END, CASE WHEN preserving AND ids < 10 THEN 'weak_profile_network_evidence' END, CASE WHEN preserving THEN 'trace_preserving_reconstruction_requires_review' END,
  CASE WHEN compared >= 10 AND within_rate < 0.6 THEN 'low_label_surface_agreement' END, CASE WHEN p95 > interval * 0.5 THEN 'constraint_error_exceeds_half_interval' END, CASE WHEN NOT kept THEN 'value_range_not_preserved' END, CASE WHEN inferred < 0.7 THEN 'low_contour_interval_confidence' END], lambda x: x IS NOT NULL) AS reasons FROM m)
SELECT p AS l_partkey, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) = 0 THEN 'accepted' ELSE 'review' END AS status FROM r
""")
def quality_reasons(spark, sf_dir):
    """Parts as maps: every one of the eleven rules holds for some and not for others; the interval's support is unknown for each fifth."""
    p = F.col("l_partkey")
    m = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count_if(F.expr("l_returnflag = 'N'")).alias("confident"), F.count_if(F.expr("l_returnflag = 'R'")).alias("conflicting"), F.count_if(F.expr("l_quantity > 49")).alias("crossings"), F.count_distinct("l_suppkey").alias("_s"),
        F.count_if(F.expr("l_linestatus = 'F'")).alias("closed"), F.floor(F.count("*") / 4).alias("support"), F.count("*").alias("compared"), (F.count_if(F.expr("l_discount < 0.055")) / F.count("*")).alias("within_rate"), (F.max("l_tax") * 1000).alias("p95_error_m"),
    )
    m = m.withColumns({"levels": F.col("_s") + p % 40, "profile_ids": p % 20, "preserving": p % 3 == 0, "interval_m": 100 + p % 100, "range_kept": p % 7 > 0, "interval_support": F.when(p % 5 > 0, p % 10 / 10)})
    return evidence.quality(m).select("l_partkey", F.array_join("reasons", ",").alias("reasons"), "status")


@query("""
WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM f)
SELECT user_id, burst::BIGINT AS burst, min(ts) AS start, max(ts) AS last, count(*) AS n FROM b GROUP BY ALL
""")
def settle_window(spark, sf_dir):
    return inbox.sessions_by_gap(table(spark, sf_dir, "events"), "user_id", "ts", 1800).select("user_id", F.col("burst").cast("bigint").alias("burst"), "start", "last", "n")


@query()
def stream_settle(spark, sf_dir):
    """The same bursts by a stream over the table with session windows, processed as far as data is there."""
    import uuid

    scratch = Scratch(spark, "stream")
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(scratch.write(table(spark, sf_dir, "events"))[1])
    rows = source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    out = f"{scratch.base}/out"
    inbox.run_available(inbox.settled_sessions(rows, "user_id", "ts", "30 minutes"), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/b={i}-{uuid.uuid4().hex}"), f"{scratch.base}/ckpt")
    return spark.read.schema("user_id bigint, start timestamp, end timestamp, n bigint").option("recursiveFileLookup", True).parquet(out)



@query("""
WITH o AS (SELECT user_id::VARCHAR AS key, event_type AS f, epoch_us(ts) // 1000 AS ms, event_id FROM events), c AS (SELECT *, lag(f) OVER (PARTITION BY key ORDER BY ms, event_id) AS before FROM o),
s AS (SELECT key, f, ms, lead(ms) OVER (PARTITION BY key ORDER BY ms, event_id) AS until FROM c WHERE before IS DISTINCT FROM f),
t AS (SELECT key, f, ms, lag(f) OVER (PARTITION BY key ORDER BY ms) AS reported FROM s WHERE coalesce(until, (SELECT max(ms) FROM o)) >= ms + 21600000)
SELECT key, f AS fingerprint, ms AS since_ms, ms + 21600000 AS settled_ms FROM t WHERE reported IS DISTINCT FROM f
""")
def settled_folders(spark, sf_dir):
    """Users as folders, event types as fingerprints: those that stayed for six hours, by timers over keyed state in a stream."""
    import uuid

    scratch, own = Scratch(spark, "timers"), spark.newSession()
    timers.use_rocksdb(own)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("fingerprint"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"))
    source = own.readStream.schema(rows.schema).parquet(scratch.write(rows)[1])
    out = f"{scratch.base}/out"
    inbox.run_available(timers.settled(source, 21600), lambda b, i: b.write.parquet(f"{out}/b={i}-{uuid.uuid4().hex}"), f"{scratch.base}/ckpt")
    done = spark.read.schema(timers.SETTLED).option("recursiveFileLookup", True).parquet(out)
    return done.select("key", "fingerprint", F.unix_millis("since").alias("since_ms"), F.unix_millis("settled").alias("settled_ms"))


@query("""
WITH c AS (SELECT c_custkey, unnest(range(c_custkey % 7)) AS i, c_custkey % 7 AS n FROM customer)
SELECT c_custkey::VARCHAR AS path, i::INT AS pdf_page, n::INT AS n_pages, (500 + c_custkey % 90 + i)::DOUBLE AS width, 700::DOUBLE AS height, (i % 4 * 90)::INT AS rotation FROM c
UNION ALL SELECT c_custkey::VARCHAR, NULL, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 91 = 0
""")
def pdf_page_rows(spark, sf_dir):
    """Customers as files of up to six pages with a table of cross-references; each 91st has a second file that breaks off."""
    k = F.col("c_custkey")
    n = (k % 7).cast("int")
    rows = table(spark, sf_dir, "customer").select("c_custkey", n.alias("n"))
    # a small file of keys makes many files: 5,000 go to a task, by number, as partitions of few bytes would be put together again
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, rows.count() // 5000 + 1), "c_custkey")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    kids = F.array_join(F.transform(numbers, lambda i: F.concat((i + 3).cast("string"), F.lit(" 0 R"))), " ")
    page = lambda i: F.format_string("%d 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d 700] /Rotate %d >>\nendobj\n", i + 3, 500 + k % 90 + i, i % 4 * 90)
    objects = F.concat(F.array(F.lit("1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"), F.concat(F.lit("2 0 obj\n<< /Type /Pages /Kids ["), kids, F.lit("] >>\nendobj\n"))), F.transform(numbers, page))
    rows = rows.withColumn("objects", objects)
    head = "%PDF-1.4\n"
    place = lambda i: F.aggregate(F.slice("objects", 1, i), F.lit(len(head)), lambda a, x: a + F.length(x))
    entries = F.array_join(F.transform(F.sequence(F.lit(0), F.size("objects") - 1), lambda i: F.format_string("%010d 00000 n \n", place(i))), "")
    end = F.concat(F.lit("xref\n1 "), F.size("objects").cast("string"), F.lit("\n"), entries, F.lit("trailer\n<< /Root 1 0 R >>\nstartxref\n"), place(F.size("objects")).cast("string"), F.lit("\n%%EOF\n"))
    whole = rows.select("c_custkey", F.concat(F.lit(head), F.array_join("objects", ""), end).alias("content"))
    cut = whole.where("c_custkey % 91 = 0").withColumn("content", F.substring("content", 1, 30))
    return pdf.page_rows(whole.unionByName(cut).withColumn("content", F.col("content").cast("binary")), "c_custkey").drop("error")
