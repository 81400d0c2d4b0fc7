"""Order-dependent greedy selections within one image, map or group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, group: str, order: str, bits: str, share: float) -> DataFrame:
    """(group, order, kept): in order, a row is kept when it differs in more than ``share`` of its bits from all kept before it.

    Each decision needs those before it, so a group is one task's work, as a report's pages are.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        x = np.array(pdf.b.tolist(), bool)
        kept: list[int] = []
        for i in range(len(x)):
            if not kept or ((x[kept] != x[i]).mean(1) > share).all():
                kept.append(i)
        flag = np.zeros(len(x), bool)
        flag[kept] = True
        return pd.DataFrame({group: pdf.g, order: pdf.o, "kept": flag})

    src = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(bits).alias("b"))
    kind = dict(rows.dtypes)
    return src.groupBy("g").applyInPandas(run, f"`{group}` {kind[group]}, `{order}` {kind[order]}, kept boolean")


def suppress(boxes: DataFrame, group: str, key: str, score: str, limit: float = 0.45) -> DataFrame:
    """(group, key): boxes (x0, y0, x1, y1) kept by falling score when none kept before covers ``limit`` of the smaller area."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "k"], ascending=[False, True])
        b = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float)
        area = np.maximum(1.0, (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]))
        kept: list[int] = []
        for i in range(len(b)):
            k = np.array(kept, int)
            w = np.minimum(b[k, 2], b[i, 2]) - np.maximum(b[k, 0], b[i, 0])
            h = np.minimum(b[k, 3], b[i, 3]) - np.maximum(b[k, 1], b[i, 1])
            if not ((np.maximum(w, 0) * np.maximum(h, 0)) / np.minimum(area[k], area[i]) >= limit).any():
                kept.append(i)
        return pd.DataFrame({group: pdf.g.iloc[kept], key: pdf.k.iloc[kept]})

    src = boxes.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(score).alias("s"), "x0", "y0", "x1", "y1")
    kind = dict(boxes.dtypes)
    return src.groupBy("g").applyInPandas(run, f"`{group}` {kind[group]}, `{key}` {kind[key]}")
