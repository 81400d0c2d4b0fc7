"""References to sources, their checks, and quality control of extracted items and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def source_index(refs: DataFrame, pages: DataFrame, on: str, role: str) -> DataFrame:
    """Distinct references with exists and role; a reference without a page is kept with role unknown."""
    known = pages.select(on, F.col(role).alias("_role"), F.lit(True).alias("_there")).dropDuplicates([on])
    out = refs.select(on).distinct().join(known, on, "left")
    return out.select(on, F.coalesce("_there", F.lit(False)).alias("exists"), F.coalesce("_role", F.lit("unknown")).alias("role"))


def invalid(refs: DataFrame, allowed: DataFrame, on: str) -> DataFrame:
    """References that no allowed source has."""
    return refs.join(allowed.select(on).distinct(), on, "left_anti")


def missing(cited: Column | str, valid: Column | str) -> Column:
    """Cited elements that aren't valid, sorted."""
    return F.array_sort(F.array_except(T.lit_col(cited), T.lit_col(valid)))


def evidence_qc(items: DataFrame, group: str, evidence: str, allowed: DataFrame, ref: str) -> DataFrame:
    """(group, status, invalid, items_without_evidence): review when an item has no evidence or a reference isn't allowed."""
    without = items.groupBy(group).agg(F.count_if(F.coalesce(F.size(evidence), F.lit(0)) <= 0).alias("items_without_evidence"))
    refs = items.select(group, F.explode(evidence).alias(ref)).distinct()
    bad = invalid(refs, allowed, ref).groupBy(group).agg(F.array_sort(F.collect_set(ref)).alias("invalid"))
    out = without.join(bad, group, "left").withColumn("invalid", F.coalesce("invalid", F.array().cast(bad.schema["invalid"].dataType)))
    return out.withColumn("status", F.when((F.size("invalid") == 0) & (F.col("items_without_evidence") == 0), "pass").otherwise("review"))


def suspicious_id(c: Column | str) -> Column:
    """A well's number without a digit, or with a letter O in it."""
    c = F.trim(F.coalesce(T.lit_col(c), F.lit("")))
    return ~c.rlike(r"\d") | c.rlike("[оОoO]")


def verification_queue(agents: DataFrame, agent: str, status: str, evidence: str) -> DataFrame:
    """Agents under review with their sorted distinct sources."""
    rows = agents.where(F.col(status) == "review").select(agent, F.explode_outer(evidence).alias("ref"))
    return rows.groupBy(agent).agg(F.array_sort(F.collect_set("ref")).alias("sources"))


def same_sets(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """One row: whether two queues hold the same ids, and how many only one of them holds."""
    left, right = a.select(on).distinct().withColumn("_a", F.lit(1)), b.select(on).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, on, "full")
    return both.agg(F.count_if(F.expr("_b is null")).alias("only_left"), F.count_if(F.expr("_a is null")).alias("only_right")).withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def reasons(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)), lambda x: x.isNotNull())


def quality(metrics: DataFrame) -> DataFrame:
    """Columns reasons and status of a digitized map from its metrics.

    metrics: confident, conflicting, crossings, levels, closed, support, profile_ids, preserving, compared, within_rate,
    p95_error_m, interval_m, range_kept, interval_support. Null metrics raise no reason. The names of the reasons are fixed values.
    """
    c = F.col
    total = c("confident") + c("conflicting")
    closure = F.greatest(F.lit(8), F.least(F.greatest(F.lit(1), c("levels")) * 2, F.greatest(F.lit(1), c("support")) * 2))
    found = reasons(
        ("fewer_than_3_direct_contours", c("confident") < 3),
        ("high_direct_contour_conflict_rate", (c("conflicting") >= 3) & (c("conflicting") / F.greatest(F.lit(1), total) > 0.35)),
        ("contour_crossings", c("crossings") > 0),
        ("excessive_closed_contours", c("closed") > closure),
        ("excessive_contour_levels", c("levels") > 40),
        ("weak_profile_network_evidence", c("preserving") & (c("profile_ids") < 10)),
        ("trace_preserving_reconstruction_requires_review", c("preserving")),
        ("low_label_surface_agreement", (c("compared") >= 10) & (c("within_rate") < 0.6)),
        ("constraint_error_exceeds_half_interval", c("p95_error_m") > c("interval_m") * 0.5),
        ("value_range_not_preserved", ~c("range_kept")),
        ("low_contour_interval_confidence", c("interval_support") < 0.7),
    )
    return metrics.withColumn("reasons", found).withColumn("status", F.when(F.size("reasons") == 0, "accepted").otherwise("review"))


def combined_quality(a: Column, a_reasons: Column, b: Column, b_reasons: Column) -> Column:
    """struct<status, reasons> of two verdicts: accepted only when both are; reasons keep their first order."""
    status = F.when((a == "accepted") & (b == "accepted"), "accepted").otherwise("review")
    return F.struct(status.alias("status"), F.array_distinct(F.concat(a_reasons, b_reasons)).alias("reasons"))
