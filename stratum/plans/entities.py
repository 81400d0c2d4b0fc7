"""Evidence, citations and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import entities, evidence
from .registry import query, table

SLUG_SQL = "coalesce(nullif(trim(regexp_replace(translate(lower({c}), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-'), ''), 'unnamed')"


@query("""
WITH r AS (SELECT doc_id AS id FROM labels UNION SELECT conv_id * 3 FROM conversations)
SELECT id AS doc_id, d.doc_id IS NOT NULL AS "exists", coalesce(d.source, 'unknown') AS role FROM r LEFT JOIN documents d ON d.doc_id = id
""")
def source_index(spark, sf_dir):
    refs = table(spark, sf_dir, "labels").select("doc_id").unionByName(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 3).alias("doc_id")))
    return evidence.source_index(refs, table(spark, sf_dir, "documents"), "doc_id", "source")


@query("SELECT doc_id, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def evidence_invalid_anti(spark, sf_dir):
    allowed = table(spark, sf_dir, "documents").where("lang = 'en'")
    return evidence.invalid(table(spark, sf_dir, "labels").select("doc_id", "toxic"), allowed, "doc_id")


@query("""
WITH g AS (SELECT source, list(DISTINCT lang) AS cited FROM documents GROUP BY 1)
SELECT source, array_to_string(list_sort(list_filter(['de', 'en', 'es', 'fr', 'ru'], lambda x: NOT list_contains(cited, x))), ',') AS missing, array_to_string(list_sort(list_filter(cited, lambda x: x NOT IN ('en', 'fr'))), ',') AS invalid FROM g
""")
def evidence_missing_set(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("cited"))
    all_, ok = (F.array(*map(F.lit, x)) for x in (["de", "en", "es", "fr", "ru"], ["en", "fr"]))
    return rows.select("source", F.array_join(evidence.missing(all_, F.col("cited")), ",").alias("missing"), F.array_join(evidence.missing(F.col("cited"), ok), ",").alias("invalid"))


@query("""
WITH i AS (SELECT l_orderkey AS item, CASE WHEN l_linestatus = 'O' THEN [l_suppkey] ELSE [] END AS e, l_returnflag AS agent FROM lineitem),
w AS (SELECT agent, count(*) FILTER (len(e) = 0) AS items_without_evidence FROM i GROUP BY 1), r AS (SELECT DISTINCT agent, unnest(e) AS ref FROM i), b AS (SELECT agent, list_sort(list(ref)) AS l FROM r WHERE ref NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1)
SELECT agent, items_without_evidence, coalesce(len(l), 0)::INT AS n_invalid, CASE WHEN l IS NULL AND items_without_evidence = 0 THEN 'pass' ELSE 'review' END AS status FROM w LEFT JOIN b USING (agent)
""")
def evidence_qc(spark, sf_dir):
    none = F.array().cast("array<bigint>")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("agent"), F.when(F.col("l_linestatus") == "O", F.array("l_suppkey")).otherwise(none).alias("e"))
    allowed = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("ref"))
    out = evidence.evidence_qc(items, "agent", "e", allowed, "ref")
    return out.select("agent", "items_without_evidence", F.size("invalid").alias("n_invalid"), "status")


@query("SELECT c_mktsegment AS agent, list_sort(list(DISTINCT c_nationkey)) AS sources FROM customer WHERE c_acctbal < 0 GROUP BY 1")
def verification_queue(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("agent"), F.when(F.col("c_acctbal") < 0, "review").otherwise("pass").alias("status"), F.array("c_nationkey").alias("e"))
    return evidence.verification_queue(rows, "agent", "status", "e")


@query("SELECT *, only_left = 0 AND only_right = 0 AS same FROM (SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_left, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_right)")
def queue_equality(spark, sf_dir):
    return evidence.same_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT p_partkey, CASE WHEN NOT regexp_matches(p_brand, '[0-9]') OR regexp_matches(p_brand, '[оОoO]') THEN true ELSE false END AS suspicious FROM part")
def suspicious_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", evidence.suspicious_id("p_brand").alias("suspicious"))


@query(f"SELECT c_custkey AS key, 'customer:' || {SLUG_SQL.format(c='c_name')} AS entity_id FROM customer UNION ALL SELECT p_partkey, 'part:' || {SLUG_SQL.format(c='p_name')} FROM part")
def entity_slug(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), T.entity_id(F.lit("customer"), "c_name").alias("entity_id"))
    return a.unionByName(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), T.entity_id(F.lit("part"), "p_name").alias("entity_id")))


@query(f"""
SELECT 'part:' || {SLUG_SQL.format(c='p_name')} AS entity_id, min_by(p_name, p_partkey) AS name, min_by(p_size, p_partkey) AS size, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS evidence, (count(*) - 1)::INT AS n_observations, (list_sum(list(p_size)) - min_by(p_size, p_partkey))::BIGINT AS later_sizes FROM part GROUP BY 1
""")
def entity_merge(spark, sf_dir):
    out = entities.merge(table(spark, sf_dir, "part"), F.lit("part"), F.col("p_name"), "p_partkey", F.array("p_brand"), F.struct("p_size"))
    later = F.aggregate("observations", F.lit(0).cast("bigint"), lambda s, x: s + x.p_size)
    return out.select("entity_id", "name", F.col("attributes.p_size").alias("size"), F.array_join("evidence", ",").alias("evidence"), F.size("observations").alias("n_observations"), later.alias("later_sizes"))


@query()
def alias_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("key")).withColumn("kind", F.lit("part"))
    return entities.alias_candidates(names, "key", "p_name", "kind")


@query("SELECT 'missing_evidence' AS code, count(*) AS n FROM (SELECT p_name FROM part GROUP BY 1 HAVING max(p_size) < 50) HAVING count(*) > 0")
def entity_issues(spark, sf_dir):
    rows = entities.merge(table(spark, sf_dir, "part"), F.lit("part"), F.col("p_name"), "p_partkey", F.when(F.col("p_size") >= 50, F.array("p_brand")).otherwise(F.array().cast("array<string>")), F.struct("p_size"))
    none = rows.sparkSession.createDataFrame([], "first string, second string")
    return entities.issues(rows, none).groupBy("code").agg(F.count("*").alias("n"))
