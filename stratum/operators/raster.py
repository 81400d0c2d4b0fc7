"""Binary rasters in long form (map, row, col): components, thinning, skeleton nodes, smooth surfaces from scattered depths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Scratch, components

NEIGHBOURS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def ink(gray: DataFrame, value: str, limit: int = 128) -> DataFrame:
    """Dark pixels."""
    return gray.where(F.col(value) < limit).drop(value)


def pixel_components(pixels: DataFrame, by: str, scratch: Scratch, least_span: int = 1) -> DataFrame:
    """(by, component, area, r0, r1, c0, c1) of 8-connected pixels; components of a smaller span (the box's longer side) are left out."""
    at = pixels.withColumn("_id", F.xxhash64(by, "row", "col"))
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in NEIGHBOURS[4:])))
    moved = at.select(by, F.col("_id").alias("a"), "row", "col", moves.alias("m")).select(by, "a", (F.col("row") + F.col("m.a")).alias("row"), (F.col("col") + F.col("m.b")).alias("col"))
    edges = moved.join(at.select(by, "row", "col", F.col("_id").alias("b")), [by, "row", "col"]).select("a", "b")
    roots = components(edges, scratch)
    placed = at.join(roots, at._id == roots.node, "left").withColumn("component", F.coalesce("root", "_id"))
    boxes = placed.groupBy(by, "component").agg(F.count("*").alias("area"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    return boxes.where(F.greatest(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")) + 1 >= least_span)


def skeleton_degrees(pixels: DataFrame, by: str) -> DataFrame:
    """(by, row, col, degree, node): 8-neighbour counts by an equi-join; pixels of another degree than two are nodes."""
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in NEIGHBOURS)))
    moved = pixels.select(by, "row", "col", moves.alias("m")).select(by, (F.col("row") + F.col("m.a")).alias("row"), (F.col("col") + F.col("m.b")).alias("col"))
    counts = moved.groupBy(by, "row", "col").agg(F.count("*").alias("degree"))
    return pixels.join(counts, [by, "row", "col"], "left").select(by, "row", "col", F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree")).withColumn("node", F.col("degree") != 2)


def thinned(img: np.ndarray) -> np.ndarray:
    """Thinning to one pixel by two alternating passes (Zhang and Suen)."""
    img = np.pad(img.astype(bool), 1)
    while True:
        before = img.copy()
        for odd in (0, 1):
            n = [np.roll(img, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            count = sum(x.astype(np.int8) for x in n)
            turns = sum((~a & b).astype(np.int8) for a, b in zip(n, n[1:] + n[:1]))
            up, right, down, left = n[0], n[2], n[4], n[6]
            open_ = (~(up & right & down) & ~(right & down & left)) if not odd else (~(up & right & left) & ~(up & down & left))
            img = img & ~(img & (count >= 2) & (count <= 6) & (turns == 1) & open_)
        if (img == before).all():
            return img[1:-1, 1:-1]


def thin(pixels: DataFrame, by: str) -> DataFrame:
    """(by, row, col) of each map's skeleton; a map is one task's work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf.row.min(), pdf.col.min()
        img = np.zeros((pdf.row.max() - r0 + 1, pdf.col.max() - c0 + 1), bool)
        img[pdf.row - r0, pdf.col - c0] = True
        r, c = np.nonzero(thinned(img))
        return pd.DataFrame({by: pdf.g.iloc[0], "row": r + r0, "col": c + c0})

    src = pixels.select(F.col(by).alias("g"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    return src.groupBy("g").applyInPandas(run, f"`{by}` {dict(pixels.dtypes)[by]}, row bigint, col bigint")


def in_hull(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which points of q lie in the convex hull of p, its border included: half-plane tests with the hull's edges."""
    pts = np.unique(p, axis=0)
    slack = 1e-9 * max(float(np.ptp(pts, axis=0).max()), 1.0)
    hull: list[np.ndarray] = []
    for side in (pts, pts[::-1]):
        part: list[np.ndarray] = []
        for x in side:
            while len(part) > 1 and (part[-1][0] - part[-2][0]) * (x[1] - part[-2][1]) <= (part[-1][1] - part[-2][1]) * (x[0] - part[-2][0]):
                part.pop()
            part.append(x)
        hull += part[:-1]
    inside = ((q >= pts.min(0) - slack) & (q <= pts.max(0) + slack)).all(1)
    for a, b in zip(hull, hull[1:] + hull[:1]):
        d = b - a
        inside &= d[0] * (q[:, 1] - a[1]) - d[1] * (q[:, 0] - a[0]) >= -slack * np.hypot(*d)
    return inside


def thin_plate(marks: DataFrame, by: str, step: float, smoothing: float = 1e4, nearest: int = 50, reach: float = 400.0, hull: bool = False) -> DataFrame:
    """(by, row, col, x, y, z): a smoothing thin-plate surface on a lattice from marks (x, y, value).

    Each node solves for its nearest marks; nodes farther than ``reach`` from all marks are blank, with ``hull`` also those
    outside the marks' convex hull. A map is one task's work.
    """

    def kernel(d: np.ndarray) -> np.ndarray:
        return np.where(d > 0, d * d * np.log(np.maximum(d, 1e-300)), 0.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, v = pdf[["x", "y"]].to_numpy(float), pdf.value.to_numpy(float)
        xs, ys = (np.arange(np.floor(p[:, i].min() / step), np.ceil(p[:, i].max() / step) + 1) * step for i in (0, 1))
        rows = []
        nodes = np.stack(np.meshgrid(xs, ys), -1).reshape(-1, 2)
        inside = (in_hull(p, nodes) if hull else np.ones(len(nodes), bool)).reshape(len(ys), len(xs))
        for i, y in enumerate(ys):
            for j, x in enumerate(xs):
                d = np.hypot(p[:, 0] - x, p[:, 1] - y)
                own = np.argsort(d, kind="stable")[:nearest]
                z = None
                if d[own[0]] <= reach and inside[i, j]:
                    q, m = p[own] - (x, y), len(own)
                    a = np.zeros((m + 3, m + 3))
                    a[:m, :m] = kernel(np.hypot(q[:, None, 0] - q[None, :, 0], q[:, None, 1] - q[None, :, 1])) + smoothing * np.eye(m)
                    a[:m, m:] = np.column_stack([np.ones(m), q])
                    a[m:, :m] = a[:m, m:].T
                    w = np.linalg.lstsq(a, np.concatenate([v[own], np.zeros(3)]), rcond=None)[0]
                    z = float(kernel(np.hypot(q[:, 0], q[:, 1])) @ w[:m] + w[m])
                rows.append((pdf.g.iloc[0], i, j, x, y, z))
        return pd.DataFrame(rows, columns=[by, "row", "col", "x", "y", "z"])

    src = marks.select(F.col(by).alias("g"), "x", "y", F.col("value").cast("double").alias("value"))
    return src.groupBy("g").applyInPandas(run, f"`{by}` {dict(marks.dtypes)[by]}, row bigint, col bigint, x double, y double, z double")
