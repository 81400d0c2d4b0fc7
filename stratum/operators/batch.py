"""Batch runs over a report's maps: artifacts, duplicates, verdicts, metrics, and views over reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def preserved(old: DataFrame, generated: DataFrame, path: str, name: str, made_here: list[str], root: str) -> DataFrame:
    """Earlier artifacts that stay: not of a generated kind, not below the jobs folder, and not made anew under the same path."""
    kept = old.where(~F.col(name).isin(made_here) & ~F.startswith(F.col(path), F.lit(root)))
    return generated.unionByName(kept.join(generated.select(path).distinct(), path, "left_anti").select(generated.columns))


def batch_metrics(jobs: DataFrame, by: list[str], status: str) -> DataFrame:
    """(by, candidates, processed, duplicates, accepted, review, not_applicable, failed, quality) of a batch of maps."""
    n = lambda s: F.count_if(F.col(status) == s)
    out = jobs.groupBy(*by).agg(F.count("*").alias("candidates"), F.count_if(F.col(status) != "duplicate").alias("processed"), n("duplicate").alias("duplicates"), n("accepted").alias("accepted"), n("review").alias("review"), n("not_applicable").alias("not_applicable"), n("failed").alias("failed"))
    return out.withColumn("quality", F.when((F.col("review") > 0) | (F.col("failed") > 0), "review").when(F.col("accepted") > 0, "accepted").otherwise("not_applicable"))


def downgraded(jobs: DataFrame, status: str, content_type: str, reasons: str) -> DataFrame:
    """Accepted maps on pages routed as charts go to review with a reason more."""
    hit = (F.col(status) == "accepted") & (F.col(content_type) == "chart")
    return jobs.withColumns({reasons: F.when(hit, F.array_append(reasons, F.lit("chart_routed_page"))).otherwise(F.col(reasons)), status: F.when(hit, "review").otherwise(F.col(status))})


def trusted(lines: DataFrame, include_inferred: bool = False) -> DataFrame:
    """Valued isolines that no check flagged; inferred values only on demand. Null verdicts count as not flagged."""
    ok = F.col("value").isNotNull() & (F.col("kind") == "isoline") & ~F.col("verdict").eqNullSafe("flagged")
    return lines.where(ok if include_inferred else ok & (F.col("source") == "label"))


def map_payload(artifacts: DataFrame, jobs: DataFrame, page: str) -> DataFrame:
    """Artifacts with the status and quality of their page's latest job (column job), without those of pages that hold no map; artifacts without a job stay."""
    j = jobs.groupBy(page).agg(F.max_by(F.struct("status", "quality"), "job").alias("j")).select(page, F.col("j.status").alias("job_status"), F.col("j.quality").alias("quality"))
    gone = jobs.where(F.col("status").isin("not_applicable", "failed", "duplicate")).select(page).distinct()
    return artifacts.join(gone, page, "left_anti").join(j, page, "left")


def related_runs(runs: DataFrame, ident: str, root: str) -> DataFrame:
    """(ident, related): runs of the same root whose id extends the other's. The root is an equi-join key."""
    a, b = runs.alias("a"), runs.alias("b")
    on = (F.col(f"a.{root}") == F.col(f"b.{root}")) & F.startswith(F.col(f"b.{ident}"), F.col(f"a.{ident}"))
    return a.join(b, on).select(F.col(f"a.{ident}").alias(ident), F.col(f"b.{ident}").alias("related"))


def positional_ids(artifacts: DataFrame, prefix: str, order: list[str], group: list[str]) -> DataFrame:
    """Column artifact_id: prefix and position from 0 within the group."""
    return artifacts.withColumn("artifact_id", F.concat(F.lit(f"{prefix}-"), (F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1).cast("string")))


def pinned_first(rows: DataFrame, ident: str, pin: str) -> DataFrame:
    return rows.orderBy(F.col(ident) != pin, ident)


def upload_category(name: Column | str) -> Column:
    """archive, document, map, table or other, by suffix and by words in the name."""
    name = F.lower(F.col(name) if isinstance(name, str) else name)
    suffix = F.regexp_extract(name, r"\.([^./]+)$", 1)
    is_map = name.rlike("карт|map|contour|изолин")
    return F.when(suffix.isin("zip", "tar", "gz", "rar", "7z"), "archive").when(suffix.isin("shp", "geojson", "grd") | (is_map & suffix.isin("png", "jpg", "jpeg", "tif", "tiff", "pdf")), "map").when(suffix.isin("csv", "xls", "xlsx"), "table").when(suffix.isin("pdf", "png", "jpg", "jpeg", "tif", "tiff", "txt", "html"), "document").otherwise("other")


def tile_starts(length: Column | str, tile: int) -> Column:
    """Starts of tiles spread evenly over a side: one tile when it fits, else as few as cover it, rounded half to even."""
    n = F.col(length) if isinstance(length, str) else length
    count = F.ceil(n / tile).cast("int")
    spread = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.rint(i * (n - tile) / F.greatest(count - 1, F.lit(1))).cast("int"))
    return F.when(n <= tile, F.array(F.lit(0))).otherwise(spread)


def reading_order(lines: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Column line_no: lines from top to bottom, then from left to right."""
    return lines.withColumn("line_no", F.row_number().over(W.partitionBy(*group).orderBy(y, x)))


def bundle(entities: DataFrame, by: str, kind: str, name: str, kinds: list[str], agents: DataFrame | None = None) -> DataFrame:
    """(by, counts map, names map): entities of each report by kind, kinds without entities with zero and an empty list.

    agents: (by, agent, status, qc), one row per agent of a report. With them a report also has qc (map of agent to its verdict, null where it gave none) and status:
    failed where an agent isn't completed, else review where a verdict says so, else completed; reports of agents without entities are there too.
    """
    counts = [F.count_if(F.col(kind) == k) for k in kinds]
    names = [F.array_sort(F.collect_set(F.when(F.col(kind) == k, F.col(name)))) for k in kinds]
    keys = F.array(*map(F.lit, kinds))
    rows = entities.select(by, kind, name)
    if agents is not None:
        rows = rows.unionByName(agents.select(by).distinct(), allowMissingColumns=True)
    out = rows.groupBy(by).agg(F.map_from_arrays(keys, F.array(*counts)).alias("counts"), F.map_from_arrays(keys, F.array(*names)).alias("names"))
    if agents is None:
        return out
    failed, review = F.bool_or(F.coalesce(F.col("status") != "completed", F.lit(True))), F.bool_or(F.coalesce(F.col("qc") == "review", F.lit(False)))
    verdicts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", "qc"))))
    own = agents.groupBy(by).agg(verdicts.alias("qc"), F.when(failed, "failed").when(review, "review").otherwise("completed").alias("status"))
    return out.join(own, by, "left").withColumns({"qc": F.coalesce("qc", F.create_map().cast("map<string,string>")), "status": F.coalesce("status", F.lit("completed"))})


def service_metrics(calls: DataFrame, by: list[str], latency: str, error: Column) -> DataFrame:
    """(by, requests, errors, average latency in seconds rounded to hundredths, zero without calls)."""
    return calls.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if(error).alias("errors"), F.round(F.coalesce(F.avg(latency), F.lit(0.0)), 2).alias("latency"))
