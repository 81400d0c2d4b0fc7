"""Shared plumbing of the operators: tables in the shared folder, components, and reading the test tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import Scratch, components, shared_dir

__all__ = ["Scratch", "components", "cut", "free", "read", "shared_dir"]


def cut(batch: pa.RecordBatch, column: str | int, rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``rows`` rows and ``size`` bytes of one column, one row at least: very long texts come alone."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and (i - start >= rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def free(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores as it takes to clash with none of ``taken``; names are compared without case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
