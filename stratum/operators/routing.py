"""Page registry, roles, queues and routing decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import Scratch

#: Page kinds, and those that need the graphic workers.
KINDS = ["text", "toc", "map", "seismic_section", "profile_scheme", "chart", "table", "photo", "other_graphic", "blank"]
GRAPHIC = ["map", "seismic_section", "profile_scheme", "chart", "other_graphic"]


def with_ordinals(pages: DataFrame, path: str, scratch: Scratch) -> DataFrame:
    """Columns ordinal (from 1, in natural order of the path) and page_id.

    The order is global, so ranks are found within ranges of the sort key and shifted by the ranges' counts; no task sees more
    than one range. Ties are broken by the path itself. The ranges are written once, as a second run may cut or number them otherwise.
    """
    keyed = pages.withColumn("_key", T.natural_key(path)).repartitionByRange("_key", path)
    keyed = scratch.table(keyed.withColumn("_part", F.spark_partition_id()))
    ranked = keyed.withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy("_key", path)))
    ends = keyed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = ends.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    out = ranked.join(F.broadcast(before), "_part").withColumn("ordinal", (F.col("_before") + F.col("_rank")).cast("bigint"))
    return out.withColumn("page_id", F.format_string("page:%05d", "ordinal")).drop("_key", "_part", "_rank", "_before")


def path_role(path: Column | str) -> Column:
    """struct<role, volume> from the directories of a path: contents before samples before text before graphics."""
    parts = F.split(T.lit_col(path), "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    has = lambda what: F.exists(folders, lambda p: F.lower(p).contains(what))
    text = F.exists(folders, lambda p: F.lower(p).endswith("екст"))
    role = F.when(has("оглав"), "toc").when(has("выборк"), "sample").when(text, "text").when(has("график"), "graphic").otherwise("unknown")
    volume = F.get(F.filter(folders, lambda p: p.rlike(r"(?iu)^[tт]ом(?![\p{L}\p{N}_])")), F.lit(0))
    return F.struct(role.alias("role"), volume.alias("volume"))


def initial_flags(role: Column | str) -> tuple[Column, Column]:
    """(route_vlm, deep_processing) before any decision."""
    role = T.lit_col(role)
    return role == "unknown", role == "graphic"


def fast_ocr_reasons(role: Column | str) -> Column:
    """Why a page goes to fast OCR; empty when it doesn't."""
    role = T.lit_col(role)
    return F.when(role == "text", F.array(F.lit("full_text_corpus"))).when(role == "toc", F.array(F.lit("explicit_toc"))).otherwise(F.array().cast("array<string>"))


def needs_upgrade(old: Column | str, new: Column | str) -> Column:
    """Whether two sets differ."""
    old, new = T.lit_col(old), T.lit_col(new)
    return (F.size(F.array_except(old, new)) > 0) | (F.size(F.array_except(new, old)) > 0)


def parse_decisions(replies: DataFrame, batch: str, reply: str) -> DataFrame:
    """(batch, index, kind, confidence, error): one row per page of a classifier's reply.

    Fences are stripped, confidences clamped to [0, 1]; a reply that isn't an object and an unknown kind are errors.
    """
    value = replies.select(batch, T.json_object(reply).alias("v"))
    pages = F.try_variant_get("v", "$.pages", "array<struct<index: int, kind: string, confidence: double>>")
    rows = value.select(batch, "v", F.explode_outer(pages).alias("p"))
    kind = F.trim(F.coalesce(F.col("p.kind"), F.lit("")))
    error = F.when(F.col("v").isNull(), "not an object").when(F.col("p").isNull(), "no pages").when(~kind.isin(KINDS), F.concat(F.lit("unknown kind: "), kind))
    return rows.select(batch, F.col("p.index").alias("index"), kind.alias("kind"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("p.confidence", F.lit(0.0)))).alias("confidence"), error.alias("error"))


def apply_decisions(pages: DataFrame, decisions: DataFrame, on: str = "page_id") -> DataFrame:
    """Pages with role, flags and role_source after the decisions (kind, confidence); a role told by the path wins.

    pages: ``on``, role, path_role, route_vlm, deep_processing, fast_ocr_reasons. Pages without a decision stay as they are.
    """
    d = decisions.select(on, "kind", F.col("confidence").alias("_confidence"))
    joined = pages.join(d, on, "left")
    told, kind = F.col("kind").isNotNull(), F.col("kind")
    origin = F.when(F.col("path_role") != "unknown", F.col("path_role")).otherwise(F.coalesce("role", F.lit("unknown")))
    drawn = F.when(kind == "toc", "toc").when(kind.isin("text", "table"), "text").when(kind.isin(*GRAPHIC, "photo"), "graphic").otherwise("unknown")
    role = F.when(origin.isin("toc", "text"), origin).when(origin.isin("graphic", "sample"), "graphic").otherwise(drawn)
    deep = F.when(origin == "graphic", True).when(origin.isin("toc", "text", "sample"), False).otherwise(kind.isin(GRAPHIC))
    out = joined.select(
        *[c for c in pages.columns if c not in ("role", "route_vlm", "deep_processing", "fast_ocr_reasons")],
        F.when(told, role).otherwise(F.col("role")).alias("role"),
        F.when(told, False).otherwise(F.col("route_vlm")).alias("route_vlm"),
        F.when(told, deep).otherwise(F.col("deep_processing")).alias("deep_processing"),
        kind.alias("content_type"),
        F.col("_confidence").alias("routing_confidence"),
        F.when(told, F.when(origin != "unknown", "path+preview_vlm").otherwise("preview_vlm")).alias("role_source"),
        "fast_ocr_reasons",
    )
    fresh = fast_ocr_reasons("role")
    out = out.withColumn("fast_ocr_reasons", F.when(F.col("content_type").isNotNull(), fresh).otherwise(F.array_union("fast_ocr_reasons", fresh)))
    return out.withColumn("fast_ocr", F.size("fast_ocr_reasons") > 0)


def restore_path_roles(pages: DataFrame) -> DataFrame:
    """Roles told by the path take the place of decided ones; graphic and sample pages leave fast OCR."""
    told, graphic = F.col("path_role") != "unknown", F.col("path_role").isin("graphic", "sample")
    return pages.withColumns(
        {
            "role": F.when(told, F.col("path_role")).otherwise(F.col("role")),
            "role_source": F.when(told, F.lit("path")).otherwise(F.col("role_source")),
            "fast_ocr": F.col("fast_ocr") & ~graphic,
            "fast_ocr_reasons": F.when(graphic, F.array().cast("array<string>")).otherwise(F.col("fast_ocr_reasons")),
            "deep_processing": F.when(graphic, F.col("path_role") == "graphic").otherwise(F.col("deep_processing")),
        }
    )


def exploded_routes(rows: DataFrame, kind: str, routes: dict[str, list[str]]) -> DataFrame:
    """One row per route of each row; a kind may take several routes."""
    pairs = F.create_map(*(x for k, v in routes.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return rows.withColumn("route", F.explode(F.element_at(pairs, F.col(kind))))


def batches(rows: DataFrame, ordinal: str, size: int = 12, shards: int = 4) -> DataFrame:
    """Columns batch and shard from an ordinal that begins with 1."""
    at = F.col(ordinal) - 1
    return rows.withColumns({"batch": F.expr(f"(`{ordinal}` - 1) div {size}"), "shard": F.pmod(at, F.lit(shards)), "sheet_row": F.expr(f"pmod(`{ordinal}` - 1, {size}) div 4"), "sheet_col": F.pmod(at, F.lit(4))})


def admit(rows: DataFrame, active: Column, pending: Column, limit: int, order: list[str], group: list[str]) -> DataFrame:
    """Column admitted: pending rows start in order until the group's active rows reach the limit."""
    w = W.partitionBy(*group)
    waiting = F.sum(pending.cast("int")).over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    free = F.lit(limit) - F.sum(active.cast("int")).over(w)
    return rows.withColumn("admitted", pending & (waiting <= free))
