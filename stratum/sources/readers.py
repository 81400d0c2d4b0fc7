"""Readers. Paths are given to Spark alone, so any store that it reads will do."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Suffixes of scans.
SUFFIXES = ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "pdf"]


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative_path, source_kind, size_bytes, modified) of the scans below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*").load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    relative = F.when(F.instr("path", root.rstrip("/") + "/") > 0, F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)).otherwise(F.col("path"))
    return files.where(suffix.isin(SUFFIXES)).select("path", relative.alias("relative_path"), F.when(suffix == "pdf", "pdf").otherwise("image").alias("source_kind"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def tolerant_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON; what doesn't parse comes as nulls with its text in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


OCR_LINE = "array<struct<text: string, score: double, polygon: array<array<double>>>>"


def ocr_lines(raw: DataFrame, text: str, key: str) -> DataFrame:
    """(key, line_no, text, score, polygon) from OCR results in any of three shapes.

    One object with parallel arrays rec_texts, rec_scores and rec_polys; one object with lines; or one line object per text
    line. Blank texts are dropped, missing scores stay null, and a row of no shape gives nothing.
    """
    v = raw.select(key, F.col(text).alias("_t"), F.try_parse_json(text).alias("_v"))
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    parallel = F.arrays_zip(get("$.rec_texts", "array<string>").alias("text"), get("$.rec_scores", "array<double>").alias("score"), get("$.rec_polys", "array<array<array<double>>>").alias("polygon"))
    each = F.transform(F.filter(F.split("_t", "\n"), lambda s: F.trim(s) != ""), lambda s: F.from_json(s, "struct<text: string, score: double, polygon: array<array<double>>>"))
    lines = F.when(get("$.rec_texts", "array<string>").isNotNull(), F.transform(parallel, lambda x: F.struct(x.text.alias("text"), x.score.alias("score"), x.polygon.alias("polygon"))))
    lines = lines.when(get("$.lines", OCR_LINE).isNotNull(), get("$.lines", OCR_LINE)).otherwise(F.filter(each, lambda x: x.text.isNotNull()))
    lines = F.filter(lines, lambda x: F.trim(x.text) != "")
    return v.select(key, F.posexplode(lines).alias("line_no", "x")).select(key, "line_no", "x.text", "x.score", "x.polygon")


def npz_grids(spark: SparkSession, root: str) -> DataFrame:
    """(path, row, col, x, y, z) of the grids in NumPy archives with the arrays x (columns), y (rows) and z; cells that are not a number are null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(root).select("path", "content")

    def cells(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                with np.load(io.BytesIO(content.as_buffer())) as f:
                    x, y, z = (np.asarray(f[n], np.float64) for n in "xyz")
                step = max(1, (1 << 18) // max(len(x), 1))
                for top in range(0, len(y), step):
                    rows, cols = np.meshgrid(np.arange(top, min(top + step, len(y))), np.arange(len(x)), indexing="ij")
                    r, c = rows.ravel(), cols.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(r)), pa.array(r, pa.int64()), pa.array(c, pa.int64()), pa.array(x[c]), pa.array(y[r]), pa.array(z[r, c], from_pandas=True)], names=["path", "row", "col", "x", "y", "z"])

    return files.mapInArrow(cells, "path string, row bigint, col bigint, x double, y double, z double")


def geojson_features(raw: DataFrame, text: str, key: str) -> DataFrame:
    """(key, feature, geom_type, coordinates, properties) of feature collections; coordinates and properties as JSON text."""
    schema = "struct<features: array<struct<geometry: struct<type: string, coordinates: string>, properties: string>>>"
    rows = raw.select(key, F.posexplode(F.from_json(text, schema).features).alias("feature", "f"))
    return rows.select(key, "feature", F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


class ArchiveSource(DataSource):
    """``spark.read.format("archive").load(path)``: members of one zip or tar file as (name, size, content).

    Names that leave the archive's folder (absolute, or with ..) are refused, and so is an archive whose members exceed
    the option maxBytes together.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "name string, size bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)


class _ArchiveReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.most = options["path"], int(options.get("maxBytes", 1 << 30))

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        import tarfile
        import zipfile

        def safe(name: str) -> bool:
            parts = name.replace("\\", "/").split("/")
            return not name.startswith(("/", "\\")) and ".." not in parts and ":" not in parts[0]

        total = 0
        if zipfile.is_zipfile(self.path):
            with zipfile.ZipFile(self.path) as z:
                for m in z.infolist():
                    if not m.is_dir():
                        total += m.file_size
                        if not safe(m.filename) or total > self.most:
                            raise ValueError(f"refused archive member {m.filename!r}")
                        yield m.filename, m.file_size, z.read(m)
        else:
            with tarfile.open(self.path) as t:
                for m in t:
                    if m.isfile():
                        total += m.size
                        if not safe(m.name) or total > self.most:
                            raise ValueError(f"refused archive member {m.name!r}")
                        yield m.name, m.size, t.extractfile(m).read()


def connector(rows: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str, parallel: int | None = None) -> DataFrame:
    """Rows sent to an outside service by an injected function, batch by batch; ``parallel`` bounds concurrent calls.

    The function is tried three times, waiting one and two seconds in between. Filters belong before this call: nothing
    is pushed below it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in batches:
            for wait in (1, 2, None):
                try:
                    yield call(batch)
                    break
                except Exception:
                    if wait is None:
                        raise
                    time.sleep(wait)

    return (rows.repartition(parallel) if parallel else rows).mapInPandas(run, schema)


def captured_calls(rows: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str, parallel: int | None = None, waits: tuple[float, ...] = (1, 2)) -> DataFrame:
    """Results of an injected function page by page, with a column error: what failed for good is a row with its key and message, and stops nothing else.

    schema: the columns of the function's results, ``key`` among them. A batch whose call fails is called again row by row, each row once more after every
    wait. Results of one call come together, so a lost task calls its batch again.
    """
    names = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        def once(part: pd.DataFrame, tries: tuple) -> pd.DataFrame:
            for wait in (*tries, None):
                try:
                    return call(part).assign(error=None)
                except Exception as e:  # whatever the service raises is the page's result
                    if wait is None:
                        return pd.DataFrame({key: part[key], "error": f"{type(e).__name__}: {e}"})
                    time.sleep(wait)

        for batch in batches:
            whole = once(batch, ())
            parts = [whole] if not len(whole) or whole["error"].isna().all() else [once(batch.iloc[i : i + 1], waits) for i in range(len(batch))]
            for part in parts:
                plain = part.reindex(columns=[*names, "error"]).astype(object)
                yield plain.where(plain.notna(), None)

    return (rows.repartition(parallel) if parallel else rows).mapInPandas(run, f"{schema}, error string")


def stage_verdict(results: DataFrame, queue: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, queued, done, failed, missing, status, first_error): completed where every page of the queue has a result without an error, else failed.

    results: (by, key, error), the last word on each page. The pages that failed are the rows of ``results`` with an error; only the least message is told here.
    """
    last = results.groupBy(*by, key).agg(F.bool_or(F.col("error").isNull()).alias("_ok"), F.min("error").alias("_e"))
    met = queue.select(*by, key).distinct().join(last, [*by, key], "left")
    out = met.groupBy(*by).agg(F.count("*").alias("queued"), F.count_if("_ok").alias("done"), F.count_if(~F.col("_ok")).alias("failed"), F.count_if(F.col("_ok").isNull()).alias("missing"), F.min(F.when(~F.col("_ok"), F.col("_e"))).alias("first_error"))
    return out.withColumn("status", F.when(F.col("done") == F.col("queued"), "completed").otherwise("failed"))


def cached_calls(rows: DataFrame, cache: DataFrame, key: str, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results from the cache by content key, and from ``call`` for the keys that it lacks."""
    known = cache.join(rows.select(key).distinct(), key, "left_semi")
    return known.unionByName(call(rows.dropDuplicates([key]).join(cache.select(key).distinct(), key, "left_anti")))


def report_roots(files: DataFrame, path: str) -> DataFrame:
    """(root, scans): the top folders that hold scans."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    rows = files.select(F.regexp_extract(path, r"^([^/]+)/", 1).alias("root"), suffix.isin(SUFFIXES).cast("int").alias("s"))
    return rows.where("root <> ''").groupBy("root").agg(F.sum("s").alias("scans")).where("scans > 0")


def intake(roots: DataFrame, known: DataFrame, root: str, ident: str) -> DataFrame:
    """New roots with an id: those not known by their lower-case name; an id that is taken gets eight hex digits of the root's SHA-1."""
    fresh = roots.join(known.select(F.lower(root).alias("_k")).distinct(), F.lower(roots[root]) == F.col("_k"), "left_anti")
    taken = known.select(F.col(ident).alias("_i")).distinct().withColumn("_taken", F.lit(True))
    name = F.regexp_replace(F.regexp_extract(root, r"([^/]*)$", 1), r"[^\p{L}\p{N}._-]+", "_")
    out = fresh.withColumn("_i", name).join(taken, "_i", "left")
    return out.withColumn(ident, F.when(F.col("_taken"), F.concat("_i", F.lit("-"), F.left(F.sha1(F.col(root).cast("binary")), F.lit(8)))).otherwise(F.col("_i"))).drop("_i", "_taken")


def upload_names(files: DataFrame, name: str, order: str) -> DataFrame:
    """Column stored: a clean name, numbered from the second file of the same name on."""
    from pyspark.sql import Window as W

    from ..functions.text import safe_name

    rows = files.withColumn("_c", safe_name(name))
    n = F.row_number().over(W.partitionBy("_c").orderBy(order))
    stem, suffix = F.regexp_extract("_c", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("_c", r"(\.[^.]*)$", 1)
    return rows.withColumn("_n", n).withColumn("stored", F.when(F.col("_n") == 1, F.col("_c")).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), suffix))).drop("_c", "_n")
