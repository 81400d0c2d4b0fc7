"""Files of the inbox: kinds, archives that are packed from a table and expanded again, and collections with layers, written and read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators.graph import Scratch
from ..sources import collections, expand
from .registry import query, table


@query("""
WITH f AS (SELECT p_partkey, p_size % 5 AS k, replace(p_brand, '#', '-') || '-' || p_partkey AS n FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'archive' WHEN 1 THEN 'policy' WHEN 2 THEN 'container' WHEN 3 THEN 'archive' ELSE 'unsupported' END AS kind,
  CASE k WHEN 0 THEN n WHEN 3 THEN n || '.tar' END AS destination, k = 4 AS unsupported FROM f
""")
def inbox_files(spark, sf_dir):
    """Parts as files of an inbox: archives of two suffixes, policies, files in folders, and others, which are listed as unsupported."""
    n = F.concat(F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"))
    k = F.col("p_size") % 5
    path = F.when(k == 0, F.concat(n, F.lit(".ZIP"))).when(k == 1, F.concat(n, F.lit(".zip.policy.json"))).when(k == 2, F.concat(n, F.lit("/scan.zip"))).when(k == 3, F.concat(n, F.lit(".tar.gz"))).otherwise(F.concat(n, F.lit(".docx")))
    files = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    kinds = expand.inbox(files, "path")
    listed = expand.unsupported(kinds, spark.createDataFrame([], expand.OUTCOME)).select("path", F.lit(True).alias("unsupported"))
    return files.join(kinds, "path").join(listed, "path", "left").select("p_partkey", "kind", "destination", F.coalesce("unsupported", F.lit(False)).alias("unsupported"))


@query(r"""
WITH m AS (SELECT p_partkey // 2000 AS b, replace(p_brand, '#', '-') AS member, count(*) AS n_lines,
    md5(string_agg(p_partkey || ';' || p_name, chr(10) ORDER BY p_partkey)) AS digest FROM part GROUP BY 1, 2)
SELECT 'parts-' || b AS destination, member, n_lines, digest, 'expanded' AS status, count(*) OVER (PARTITION BY b) AS files FROM m
""")
def expanded_archives(spark, sf_dir):
    """Parts packed into an archive for each 2,000 keys, expanded by the sink twice (the second run finds all of them known), and read back."""
    line = F.concat_ws(";", F.col("p_partkey").cast("string"), "p_name")
    rows = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 2000).alias("b"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("member"))
    texts = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda r: r.line), "\n").alias("text"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for member, text in zip(part["member"], part["text"]):
                z.writestr(f"{member}.txt", text)
        b = part["b"].iloc[0]
        return pd.DataFrame({"path": [f"parts-{b}.zip"], "destination": [f"parts-{b}"], "content": [out.getvalue()]})

    scratch = Scratch(spark, "inbox")
    archives = scratch.table(texts.groupBy("b").applyInPandas(pack, "path string, destination string, content binary"))
    spark.dataSource.register(expand.ExpandedSink)
    root = f"{scratch.base}/expanded".removeprefix("file://").replace("file:", "", 1)
    for _ in range(2):
        archives.write.format("expanded").mode("append").save(root)
    told = expand.outcomes(spark, root).select("destination", "status", "files")
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select("value", F.split("_metadata.file_path", "/").alias("p"))
    read = files.select(F.element_at("p", -2).alias("destination"), F.regexp_replace(F.element_at("p", -1), r"\.txt$", "").alias("member"), (F.regexp_count("value", F.lit("\n")) + 1).cast("long").alias("n_lines"), F.md5("value").alias("digest"))
    return read.join(told, "destination").select("destination", "member", "n_lines", "digest", "status", "files")


@query("SELECT c_custkey, c_mktsegment AS layer, 'Point' AS geom_type, c_custkey % 101 * 10.0::DOUBLE AS x, c_acctbal AS y, c_name AS name FROM customer")
def vector_layers(spark, sf_dir):
    """Customers written as collections named by their segment, one for each 5,000 keys, and read back by ranges of 256 KiB."""
    at = F.array((F.col("c_custkey") % 101 * 10.0), F.col("c_acctbal"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), at.alias("coordinates")).alias("geometry"), F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).alias("properties")))
    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 5000).alias("b"), F.col("c_mktsegment").alias("layer"), F.col("c_custkey").alias("n"), F.concat(F.lit(","), feature).alias("line"))
    ends = rows.groupBy("b", "layer").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    head = F.concat(F.lit('{"type":"FeatureCollection","name":'), F.to_json(F.struct("layer")), F.lit(',"features":['))
    head = F.replace(F.replace(head, F.lit(':{"layer":'), F.lit(":")), F.lit('},"features"'), F.lit(',"features"'))
    edges = ends.select("b", "layer", (F.col("first") - 1).alias("n"), head.alias("line")).unionByName(ends.select("b", "layer", (F.col("last") + 1).alias("n"), F.lit("]}").alias("line")))
    lines = rows.join(ends, ["b", "layer"]).withColumn("line", F.when(F.col("n") == F.col("first"), F.substr("line", F.lit(2))).otherwise(F.col("line"))).select("b", "layer", "n", "line").unionByName(edges)
    scratch = Scratch(spark, "layers")
    named = lines.select(F.concat_ws("-", F.col("b").cast("string"), F.xxhash64("layer").cast("string")).alias("file"), "n", "line")
    named.repartition("file").sortWithinPartitions("file", "n").select("file", "line").write.partitionBy("file").text(f"{scratch.base}/files")
    out = collections.collection(spark, f"{scratch.base}/files", size=1 << 18, glob="*.txt")
    p = F.from_json("properties", "id bigint, name string")
    c = F.from_json("coordinates", "array<double>")
    return out.select(p.id.alias("c_custkey"), "layer", "geom_type", c[0].alias("x"), c[1].alias("y"), p["name"].alias("name"))
