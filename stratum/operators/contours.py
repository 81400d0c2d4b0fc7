"""Values of contour labels and lines: bands, intervals, votes and observed measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Contour steps in km, largest first.
STEPS = [0.5, 0.25, 0.2, 0.1, 0.05, 0.025, 0.02, 0.01]


def value_band(values: DataFrame, value: str, by: list[str], interval: float) -> DataFrame:
    """(by, low, high, n): the largest run of values without a gap, widened by the interval.

    A gap is wider than four intervals and 0.8. Groups need six values; the run needs three and a quarter of them. Of equal
    runs the narrower wins, then the lower.
    """
    limit = max(4 * interval, 0.8)
    w = W.partitionBy(*by).orderBy(value)
    rows = values.where(F.col(value).isNotNull()).withColumn("_new", F.coalesce((F.col(value) - F.lag(value).over(w) > limit).cast("int"), F.lit(0)))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy(*by, "_run").agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    best = runs.groupBy(*by).agg(F.sum("n").alias("total"), F.max_by(F.struct("n", "lo", "hi"), F.struct("n", F.negate(F.col("hi") - F.col("lo")), F.negate("lo"))).alias("b"))
    best = best.where((F.col("total") >= 6) & (F.col("b.n") >= F.greatest(F.lit(3.0), F.col("total") * 0.25)))
    return best.select(*by, (F.col("b.lo") - interval).alias("low"), (F.col("b.hi") + interval).alias("high"), F.col("b.n").alias("n"))


def interval_support(values: DataFrame, value: str, by: list[str], steps: list[float] = STEPS) -> DataFrame:
    """(by, step, support): the best share, over anchors, of distinct values that lie on the step's levels through the anchor.

    Anchors matter by their remainder alone, so values are counted per remainder and compared within a group's remainders.
    """
    unique = values.select(*by, F.round(value, 3).alias("v")).where("v is not null").distinct()
    rest = unique.withColumn("step", F.explode(F.array(*map(F.lit, steps)))).withColumn("rem", F.round(F.pmod(F.col("v"), F.col("step")), 6))
    rest = rest.groupBy(*by, "step", "rem").agg(F.count("*").alias("n"))
    other = rest.select(*by, "step", F.col("rem").alias("rem2"), F.col("n").alias("n2"))
    gap = F.abs(F.col("rem") - F.col("rem2"))
    near = F.least(gap, F.col("step") - gap) <= F.least(F.lit(0.012), F.col("step") * 0.15) + 1e-9
    met = rest.join(other, [*by, "step"]).groupBy(*by, "step", "rem").agg(F.sum(F.when(near, F.col("n2")).otherwise(0)).alias("hits"), F.sum("n2").alias("total"))
    return met.groupBy(*by, "step").agg(F.round(F.max(F.col("hits") / F.col("total")), 4).alias("support"), F.max("total").alias("levels"))


def infer_interval(support: DataFrame, by: list[str], least: float = 0.7) -> DataFrame:
    """(by, step, support): the largest step of 0.05 or more with enough support, else the largest near the best; three levels at least."""
    rows = support.where((F.col("step") >= 0.05) & (F.col("levels") >= 3))
    best = rows.groupBy(*by).agg(F.max("support").alias("best"), F.max(F.when(F.col("support") >= least, F.col("step"))).alias("sure"))
    near = rows.join(best, by).where(F.col("step") == F.coalesce("sure", F.col("step"))).where(F.col("sure").isNotNull() | (F.col("support") >= F.col("best") - 0.12))
    top = near.groupBy(*by).agg(F.max(F.struct("step", "support")).alias("t"))
    return top.select(*by, "t.step", "t.support")


def votes(rows: DataFrame, line: str, value: str, order: str, suspect: str | None = None) -> DataFrame:
    """(line, value, votes, total, verdict): the most frequent value, of equal ones the first seen.

    Confident when it stands alone or outweighs all others twice, and the line isn't suspected; otherwise a conflict.
    """
    extra = [F.max(suspect).alias("_s")] if suspect else [F.lit(False).alias("_s")]
    counts = rows.groupBy(line, value).agg(F.count("*").alias("c"), F.min(order).alias("first"), *extra)
    top = counts.groupBy(line).agg(F.max_by(F.struct(value, "c"), F.struct("c", F.negate("first"))).alias("t"), F.sum("c").alias("total"), F.count("*").alias("kinds"), F.max("_s").alias("_s"))
    sure = ((F.col("kinds") == 1) | (F.col("t.c") >= 2 * (F.col("total") - F.col("t.c")))) & ~F.col("_s")
    return top.select(line, F.col(f"t.{value}").alias(value), F.col("t.c").alias("votes"), "total", F.when(sure, "confident").otherwise("conflict").alias("verdict"))


def measurements(readings: DataFrame, text: str) -> DataFrame:
    """Readings with kind (label or mark) and value in km: signed labels with up to three decimals, marks of 500 to 5000 m."""
    clean = F.translate(F.trim(text), ",−–", ".--")
    signed = clean.rlike(r"^-[0-9]+(?:\.[0-9]{1,3})?$")
    number = clean.try_cast("double")
    mark = clean.rlike(r"^[0-9]{3,4}$") & number.between(500, 5000)
    value = F.when(signed, F.when(F.abs(number) >= 100, number / 1000).otherwise(number)).when(mark, number / 1000)
    return readings.withColumns({"kind": F.when(signed, "label").when(mark, "mark"), "value": value})


#: Fixed value: how much longer than wide a map's image may be.
MOST_ASPECT = 2.5


def eligibility(readings: DataFrame, by: list[str], text: str, score: str, least_score: float = 0.75, sizes: DataFrame | None = None) -> DataFrame:
    """(by, labels, retained, levels, marks, aspect, eligible, reasons): whether a map's readings hold enough depth labels or marks.

    sizes: (by, height, width) of the maps' images; one much longer than wide isn't eligible, and aspect is null without a size. The names of the reasons are
    fixed values.
    """
    rows = measurements(readings.where(F.coalesce(score, F.lit(0.0)) >= least_score), text).where("kind is not null").withColumn("v", F.abs("value"))
    labels = rows.where("kind = 'label'")
    band = value_band(labels, "v", by, 0.1).select(*by, "low", "high")
    kept = labels.join(band, by, "left").where("low is null or v between low and high").groupBy(*by).agg(F.count("*").alias("retained"), F.count_distinct(F.round("v", 3)).alias("levels"))
    out = readings.select(*by).distinct().join(rows.groupBy(*by).agg(F.count_if(F.expr("kind = 'label'")).alias("labels"), F.count_if(F.expr("kind = 'mark'")).alias("marks")), by, "left").join(kept, by, "left").fillna(0, ["labels", "marks", "retained", "levels"])
    if sizes is not None:
        out = out.join(sizes.select(*by, (F.greatest("height", "width") / F.greatest(F.lit(1), F.least("height", "width"))).alias("aspect")), by, "left")
    else:
        out = out.withColumn("aspect", F.lit(None).cast("double"))
    good = ((F.col("retained") >= 5) & (F.col("levels") >= 3)) | ((F.col("marks") >= 20) & (F.col("retained") >= 3))
    long = F.coalesce(F.col("aspect") > MOST_ASPECT, F.lit(False))
    reasons = F.filter(F.array(F.when(~good, F.lit("insufficient_depth_label_evidence")), F.when(long, F.lit("extreme_aspect_ratio"))), lambda x: x.isNotNull())
    return out.withColumns({"eligible": good & ~long, "reasons": reasons})
