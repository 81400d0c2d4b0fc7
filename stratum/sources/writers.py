"""Writers: GeoJSON, XYZ and CPS-3 text."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import surface


def feature_json(geometry: str, coordinates: Column, properties: Column) -> Column:
    """A GeoJSON feature as text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geometry).alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def line_features(vertices: DataFrame, line: str, seq: str, properties: list[str]) -> DataFrame:
    """(line, feature): each polyline as a LineString; properties are the line's first values."""
    g = vertices.groupBy(line).agg(F.array_sort(F.collect_list(F.struct(seq, "x", "y"))).alias("v"), *(F.min_by(p, seq).alias(p) for p in properties))
    coords = F.transform("v", lambda p: F.array(p.x, p.y))
    return g.select(line, feature_json("LineString", coords, F.struct(*properties)).alias("feature"))


def write_geojson(features: DataFrame, path: str, feature: str = "feature") -> None:
    """One feature per line (newline-delimited GeoJSON), in as many files as there are partitions."""
    features.select(F.col(feature).alias("value")).write.mode("overwrite").text(path)


def write_xyz(grid: DataFrame, path: str) -> None:
    surface.xyz_lines(grid).orderBy("row", "col").select("line").write.mode("overwrite").text(path)


def write_cps3(grid: DataFrame, path: str) -> None:
    """One file of header and body; a grid is bounded by the cell limit of a map, so one task writes it."""
    head = surface.cps3_header(grid).select(F.posexplode("lines").alias("n", "line")).select((F.col("n") - 100).cast("long").alias("n"), "line")
    body = surface.cps3_lines(grid).select(F.col("n").cast("long").alias("n"), "line")
    head.unionByName(body).repartition(1).sortWithinPartitions("n").select("line").write.mode("overwrite").text(path)


def npz_files(grid: DataFrame, by: str) -> DataFrame:
    """(by, content): each map's grid (by, row, col, x, y, z) as a NumPy archive of x, y and z; missing cells are not a number. A map's cell limit bounds a task."""

    def one(cells: pd.DataFrame) -> pd.DataFrame:
        (row, rows), (col, cols) = (np.unique(cells[c], return_inverse=True) for c in ("row", "col"))
        x, y, z = np.full(len(col), np.nan), np.full(len(row), np.nan), np.full((len(row), len(col)), np.nan)
        x[cols], y[rows], z[rows, cols] = cells["x"], cells["y"], cells["z"]
        out = io.BytesIO()
        np.savez_compressed(out, x=x, y=y, z=z)
        return pd.DataFrame({by: cells[by].iloc[:1], "content": [out.getvalue()]})

    wanted = grid.select(by, "row", "col", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    return wanted.groupBy(by).applyInPandas(one, f"`{by}` {grid.schema[by].dataType.simpleString()}, content binary")


def write_table(df: DataFrame, path: str) -> None:
    """Parquet by the commit protocol: readers see the old table or the new one."""
    df.write.mode("overwrite").parquet(path)
