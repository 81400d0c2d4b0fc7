"""Traced lines: values from labels and from a surface, cleanup of rings, tangents, simplification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import contours, spatial


def assign_values(labels: DataFrame, vertices: DataFrame, line: str, label: str, value: str, radius: float) -> DataFrame:
    """(line, value, votes, total, verdict): each label votes for the line of its nearest vertex within the radius.

    labels: ``label``, x, y, value; vertices: ``line``, vertex, x, y. Nearest vertices come from grid cells, votes from one
    aggregation; labels without a vertex in reach don't vote.
    """
    near = spatial.nearest(labels, vertices, radius, label, "vertex").select(label, "vertex")
    met = near.join(vertices.select("vertex", line), "vertex").join(labels.select(label, value), label)
    return contours.votes(met, line, value, label)


def surface_values(samples: DataFrame, line: str, z: str, interval: float, least_coverage: float = 0.2, most_spread: float = 0.4, most_residual: float = 0.12) -> DataFrame:
    """(line, coverage, value, spread, residual, accepted) from a surface's depths at points along each line; null depths are blanks."""
    v = F.abs(z)
    s = samples.groupBy(line).agg(F.count("*").alias("n"), F.count(z).alias("filled"), F.percentile(v, F.lit(0.5)).alias("m"), (F.percentile(v, F.lit(0.9)) - F.percentile(v, F.lit(0.1))).alias("spread"))
    s = s.withColumn("snapped", F.rint(F.col("m") / interval) * interval)
    r = samples.join(s.select(line, "snapped"), line).groupBy(line).agg(F.percentile(F.abs(v - F.col("snapped")), F.lit(0.5)).alias("residual"))
    out = s.join(r, line).withColumn("coverage", F.col("filled") / F.col("n"))
    good = (F.col("coverage") >= least_coverage) & (F.col("filled") >= 5) & (F.col("residual") <= most_residual) & (F.col("spread") <= most_spread)
    return out.select(line, "coverage", F.negate("snapped").alias("value"), "spread", "residual", F.coalesce(good, F.lit(False)).alias("accepted"))


def crosscheck(pairs: DataFrame, by: list[str], observed: str, predicted: str, interval: float) -> DataFrame:
    """(by, candidates, compared, median_error, p90_error, within_rate) of observations against a surface; null predictions aren't compared."""
    e = F.abs(F.col(observed) - F.col(predicted))
    return pairs.groupBy(*by).agg(F.count("*").alias("candidates"), F.count(e).alias("compared"), F.percentile(e, F.lit(0.5)).alias("median_error"), F.percentile(e, F.lit(0.9)).alias("p90_error"), F.avg((e <= interval).cast("int")).alias("within_rate"))


def corridor(readings: DataFrame, key: str, radius: float, least: int = 3, on: list[str] | None = None) -> DataFrame:
    """Column corridor: at least ``least`` readings of the map (``on``), itself included, lie within the radius.

    A cell whose points all lie within the radius decides for all of them where it holds enough; points of cells with fewer alone are
    looked up, so each point meets a bounded number of them.
    """
    on, side = on or [], radius * spatial.CELL_SHARE
    at = [*on, G.cell("x", side).alias("sx"), G.cell("y", side).alias("sy")]
    rows = readings.where(spatial._finite("x") & spatial._finite("y")).select(*on, key, "x", "y", *at[len(on):])
    cells = rows.groupBy(*on, "sx", "sy").agg(F.count("*").alias("_c"))
    held = rows.join(cells, [*on, "sx", "sy"])
    few = spatial.within(held.where(F.col("_c") < least).select(*on, key, "x", "y"), rows.select(*on, key, "x", "y"), radius, on)
    met = few.groupBy(F.col(f"l.{key}").alias(key)).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    sure = held.where(F.col("_c") >= least).select(key).unionByName(met).distinct().withColumn("corridor", F.lit(True))
    return readings.join(sure, key, "left").withColumn("corridor", F.coalesce("corridor", F.lit(False)))


def tangents(vertices: DataFrame, line: str, seq: str, n: int = 12) -> DataFrame:
    """(line, end, x, y, dx, dy): outward directions at both ends, taken over the first and last n points; points alone have none."""
    up, down = W.partitionBy(line).orderBy(seq), W.partitionBy(line).orderBy(F.desc(seq))
    rows = vertices.withColumns({"_a": F.row_number().over(up), "_b": F.row_number().over(down)})
    parts = []
    for end, rank in (("start", "_a"), ("stop", "_b")):
        own = rows.where(F.col(rank) <= n).groupBy(line).agg(F.min_by(F.struct("x", "y"), rank).alias("p"), F.max_by(F.struct("x", "y"), rank).alias("q"))
        d = F.hypot(F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y"))
        parts.append(own.where(d > 0).select(line, F.lit(end).alias("end"), "p.x", "p.y", ((F.col("p.x") - F.col("q.x")) / d).alias("dx"), ((F.col("p.y") - F.col("q.y")) / d).alias("dy")))
    return parts[0].unionByName(parts[1])


def unsupported_rings(rings: DataFrame, ring: str, level: str, sources: DataFrame, interval: float, distance: float, side: float, on: list[str] | None = None) -> DataFrame:
    """Ids (and ``on``, the map) of closed lines that neither a source of their level lies near nor a ring of the next level contains or is contained by.

    rings: ``ring``, level, seq, x, y in drawing order without the closing point; sources: level, x, y. A ring's first vertex
    stands for it in the containment test, which meets rings in the cells of their boxes' rows and counts crossings of a ray.
    """
    on = on or []
    levels = F.abs(F.col("l._level") - F.col("r._level")) <= max(1.0, interval * 0.05)
    a = rings.select(*on, F.col(ring).alias("_ring"), F.col(level).cast("double").alias("_level"), "x", "y")
    b = sources.select(*on, F.col(level).cast("double").alias("_level"), "x", "y")
    near = spatial.within(a, b, distance, on).where(levels).select(*(F.col(f"l.{c}").alias(c) for c in on), F.col("l._ring").alias(ring)).distinct()
    w = W.partitionBy(*on, ring).orderBy("seq")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    seg = rings.select(*on, F.col(ring).alias("outer"), F.col(level).cast("double").alias("ol"), "x", "y", nxt("x").alias("x2"), nxt("y").alias("y2"))
    seg = seg.withColumn("cy", F.explode(F.sequence(F.floor(F.least("y", "y2") / side), F.floor(F.greatest("y", "y2") / side))))
    first = rings.groupBy(*on, ring).agg(F.min_by(F.struct(F.col("x").alias("px"), F.col("y").alias("py"), F.col(level).cast("double").alias("pl")), "seq").alias("p")).select(*on, F.col(ring).alias("inner"), "p.*")
    first = first.withColumn("cy", F.floor(F.col("py") / side))
    hit = (F.col("y") > F.col("py")) != (F.col("y2") > F.col("py"))
    right = F.col("px") < (F.col("x2") - F.col("x")) * (F.col("py") - F.col("y")) / (F.col("y2") - F.col("y")) + F.col("x")
    step = F.abs(F.abs(F.col("ol") - F.col("pl")) - interval) <= interval * 0.1
    met = seg.join(first, [*on, "cy"]).where((F.col("outer") != F.col("inner")) & step & hit).where(right)
    nested = met.groupBy(*on, "outer", "inner").agg((F.count("*") % 2).alias("odd")).where("odd = 1")
    fine = near.unionByName(nested.select(*on, F.col("outer").alias(ring))).unionByName(nested.select(*on, F.col("inner").alias(ring)))
    return rings.select(*on, ring).distinct().join(fine.distinct(), [*on, ring], "left_anti")


def _simplified(x: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices kept by Douglas-Peucker, with a stack in place of recursion."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    stack = [(0, len(x) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d, inner = x[b] - x[a], x[a + 1 : b] - x[a]
        n = np.hypot(*d)
        off = np.abs(d[0] * inner[:, 1] - d[1] * inner[:, 0]) / n if n else np.hypot(inner[:, 0], inner[:, 1])
        i = int(off.argmax())
        if off[i] > tolerance:
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return np.flatnonzero(keep)


def simplify(vertices: DataFrame, line: str, seq: str, tolerance: float) -> DataFrame:
    """(line, seq, x, y): vertices kept by Douglas-Peucker; a line is one task's work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        kept = pdf.iloc[_simplified(pdf[["x", "y"]].to_numpy(float), tolerance)]
        return pd.DataFrame({line: kept.g, seq: kept.s, "x": kept.x, "y": kept.y})

    kind = dict(vertices.dtypes)
    src = vertices.select(F.col(line).alias("g"), F.col(seq).alias("s"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return src.groupBy("g").applyInPandas(run, f"`{line}` {kind[line]}, `{seq}` {kind[seq]}, x double, y double")
