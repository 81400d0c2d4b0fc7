"""Views over reports, stages, agents and map jobs, and the rules that guard them. Projections and aggregates that combine early."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import Scratch

ENDED = ["completed", "failed"]
#: Suffixes of map images, and the most bytes of one.
IMAGES, MAX_BYTES = ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"], 250 << 20
#: What a failed reconstruction says when its map holds too little.
SUPPORT = ["traced contours passed QC", "trusted contours; at least 3 required", "valid depth constraints; at least 5 are required"]
NO_ARRAYS, FEW_LABELS = "need at least one array to concatenate", "Cannot infer contour interval from fewer than three labels"


def worker_status(reports: DataFrame, stages: DataFrame, by: str, base: list[str]) -> DataFrame:
    """``reports`` (by, lock, status) with worker_status: running under a lock, completed where a stale run has all base stages.

    stages: (by, stage, status), one row per stage.
    """
    done = stages.where(F.col("stage").isin(base) & (F.col("status") == "completed")).groupBy(by).agg(F.count_distinct("stage").alias("_n"))
    stale = (F.col("status") == "running") & (F.coalesce("_n", F.lit(0)) == len(base))
    out = reports.join(done, by, "left")
    return out.withColumn("worker_status", F.when(F.col("lock"), "running").when(stale, "completed").otherwise(F.coalesce("status", F.lit("pending")))).drop("_n")


def stage_states(updates: DataFrame, by: str, stages: list[str]) -> DataFrame:
    """(by, stage, status, attempts, started_at, finished_at, metrics) of every stage of each report; stages without an update are pending.

    updates: (by, stage, status, at, metrics map). A stage starts with its first running update and ends with its last terminal
    one; later metrics win.
    """
    at = F.col("at")
    known = updates.groupBy(by, "stage").agg(
        F.max_by("status", at).alias("_s"),
        F.count_if(F.col("status") == "running").alias("_n"),
        F.min(F.when(F.col("status") == "running", at)).alias("started_at"),
        F.max(F.when(F.col("status").isin(ENDED), at)).alias("finished_at"),
        F.array_sort(F.collect_list(F.struct("at", F.map_entries("metrics").alias("m")))).alias("_m"),
    )
    whole = F.flatten(F.transform("_m", lambda x: x.m))
    last = F.filter(whole, lambda x, i: ~F.exists(F.slice(whole, i + 2, F.greatest(F.size(whole), F.lit(1))), lambda y: y.key == x.key))
    frame = updates.select(by).distinct().withColumn("stage", F.explode(F.lit(stages)))
    out = frame.join(known, [by, "stage"], "left")
    metrics = F.map_from_entries(F.coalesce(last, F.array().cast(whole_type(updates))))
    return out.select(by, "stage", F.coalesce("_s", F.lit("pending")).alias("status"), F.coalesce("_n", F.lit(0)).alias("attempts"), "started_at", "finished_at", metrics.alias("metrics"))


def whole_type(updates: DataFrame) -> str:
    kind = updates.schema["metrics"].dataType
    return f"array<struct<key: {kind.keyType.simpleString()}, value: {kind.valueType.simpleString()}>>"


def artifact_rows(agents: DataFrame, by: str, files: DataFrame, contact: DataFrame) -> DataFrame:
    """(by, agent, name, path, media_type, exists, size_bytes): all agents' artifacts and each report's contact sheet, if it has one.

    agents: (by, agent, artifacts array<struct<name, path, media_type>>); files: (path, size); contact: (by, path).
    """
    own = agents.select(by, "agent", F.inline("artifacts"))
    sheet = contact.join(files.select("path"), "path", "left_semi").select(by, F.lit("intake").alias("agent"), F.lit("graphics_contact_sheet").alias("name"), "path", F.lit("image/jpeg").alias("media_type"))
    size = files.groupBy("path").agg(F.max("size").alias("size_bytes"))
    out = own.select(by, "agent", "name", "path", "media_type").unionByName(sheet).join(size, "path", "left")
    return out.select(by, "agent", "name", "path", "media_type", F.col("size_bytes").isNotNull().alias("exists"), "size_bytes")


def job_view(jobs: DataFrame, result: str, pid: str, alive: str, status: str) -> DataFrame:
    """Columns state and error of map jobs: a result's status, failed for a worker that ended without one, else the job's own."""
    lost = F.col(result).isNull() & F.col(pid).isNotNull() & ~F.coalesce(F.col(alive), F.lit(False))
    return jobs.withColumns({"state": F.when(F.col(result).isNotNull(), F.col(result)).when(lost, "failed").otherwise(F.col(status)), "error": F.when(lost, "worker_exited_without_manifest")})


def refusals(name: str, scale: str, size: str) -> Column:
    """Why a map may not be digitized: its suffix, a scale outside (0, 1], too many bytes; empty when it may."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    rules = [("suffix", ~suffix.isin(IMAGES)), ("scale", ~((F.col(scale) > 0) & (F.col(scale) <= 1))), ("size", F.col(size) > MAX_BYTES)]
    return F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(True)), F.lit(code)) for code, rule in rules)), lambda x: x.isNotNull())


def georeferenceable(name: str, status: str) -> Column:
    """A plain output name, and a result that was accepted or is under review."""
    return F.col(name).rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,79}$") & F.col(status).isin("accepted", "review")


def latest(rows: DataFrame, by: list[str], path: str, mtime: str) -> DataFrame:
    """(by, path): the file that changed last, of equal ones the last by name."""
    return rows.groupBy(*by).agg(F.max_by(path, F.struct(mtime, path)).alias(path))


def confidence(lines: DataFrame, by: list[str], score: str) -> DataFrame:
    """(by, lines, confidence): how many lines a page has, and the mean of their known scores to nine digits, zero without any.

    Scores are summed as decimals of ten digits, so the order of the rows doesn't matter; one that is no number isn't known.
    """
    known = F.col(score).try_cast("decimal(20,10)")
    mean = F.round(F.sum(known).cast("double") / F.nullif(F.count(known), F.lit(0)), 9)
    return lines.groupBy(*by).agg(F.count("*").alias("lines"), F.coalesce(mean, F.lit(0.0)).alias("confidence"))


def better_reading(original: DataFrame, enhanced: DataFrame, by: list[str], least_lines: int = 3, least: float = 0.93) -> DataFrame:
    """(by, lines, confidence, preprocessing): the second reading of a page where the first is poor and the second surer.

    Both hold (by, lines, confidence); a page without a second reading keeps its first.
    """
    second = enhanced.select(*by, F.struct("lines", "confidence", F.lit("enhanced_retry").alias("preprocessing")).alias("_e"))
    poor = (F.col("lines") < least_lines) | (F.col("confidence") < least)
    first = F.struct("lines", "confidence", F.lit("original").alias("preprocessing"))
    out = original.join(second, by, "left").withColumn("_b", F.when(poor & (F.col("_e.confidence") > F.col("confidence")), F.col("_e")).otherwise(first))
    return out.select(*by, "_b.lines", "_b.confidence", "_b.preprocessing")


def readable(x: str, y: str, width: Column, height: Column, score: str, least: float = 0.8) -> dict[str, Column]:
    """Columns zone (map_body or outside, by the line's centre) and unreadable."""
    inside = F.col(x).between(0.02 * width, 0.98 * width) & F.col(y).between(0.02 * height, 0.82 * height)
    return {"zone": F.when(F.coalesce(inside, F.lit(False)), "map_body").otherwise("outside"), "unreadable": F.coalesce(F.col(score), F.lit(0.0)) < least}


def too_little(message: str) -> Column:
    """Whether an error says that a map holds too little, rather than that something broke."""
    m = F.col(message)
    some = F.lit(False)
    for phrase in SUPPORT:
        some = some | m.contains(phrase)
    return F.coalesce((m.startswith("Only ") & some) | m.contains(NO_ARRAYS) | (m == FEW_LABELS), F.lit(False))


def signature(rows: DataFrame, by: list[str], order: str, columns: list[str], version: str) -> DataFrame:
    """(by, signature): SHA-256 over the version and the rows as JSON in order. Rows come together as one short text each."""
    one = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, one.alias("_j")))), lambda x: x["_j"]), ",")
    return rows.groupBy(*by).agg(F.sha2(F.concat(F.lit(version), F.lit("["), text, F.lit("]")), 256).alias("signature"))


def pixel_size(text: str) -> Column:
    """struct<width, height> of "4000 x 3000 px" as written without spaces; nulls without it."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"(\d{1,9})x(\d{1,9})\s*px", i), F.lit("")).cast("int")
    return F.struct(part(1).alias("width"), part(2).alias("height"))


def disjoint_pairs(pairs: DataFrame, a: str, b: str, score: str, scratch: Scratch) -> DataFrame:
    """(a, b, score) of a greedy choice by falling score, ties by a and b: no end is used twice.

    Each round takes the pairs that are the best of both their ends, all at once; the pairs taken one by one would be the same,
    since nothing better touches them. Their ends leave, and the rest go on.
    """
    left, chosen = scratch.table(pairs.select(a, b, score).where(F.col(a) != F.col(b)).distinct()), None
    while True:
        ends = left.select("*", F.explode(F.array(a, b)).alias("_end"))
        order = W.partitionBy("_end").orderBy(F.desc(score), a, b)
        best = ends.withColumn("_r", F.row_number().over(order)).where("_r = 1").groupBy(a, b, score).agg(F.count("*").alias("_n")).where("_n = 2").drop("_n")
        best = scratch.table(best)
        if best.isEmpty():
            return chosen if chosen is not None else left
        chosen = best if chosen is None else chosen.unionByName(best)
        gone = best.select(F.explode(F.array(a, b)).alias("_g")).distinct()
        left = left.join(gone, F.col(a) == F.col("_g"), "left_anti").join(gone, F.col(b) == F.col("_g"), "left_anti")
        left = scratch.table(left)


def masked(pixels: DataFrame, mask: DataFrame, by: list[str], keep: bool = True) -> DataFrame:
    """Pixels (by, row, col) that a mask holds, or those that it doesn't."""
    return pixels.join(mask.select(*by, "row", "col").distinct(), [*by, "row", "col"], "left_semi" if keep else "left_anti")


def on_mask(readings: DataFrame, mask: DataFrame, by: list[str], scale: float, out: str = "on_mask") -> DataFrame:
    """Column ``out``: whether the reading's centre (x, y), scaled and rounded half to even, is a pixel of the map's mask."""
    known = mask.select(*by, "row", "col").distinct().withColumn("_m", F.lit(True))
    at = readings.withColumns({"row": F.rint(F.col("y") * scale).cast("bigint"), "col": F.rint(F.col("x") * scale).cast("bigint")})
    return at.join(known, [*by, "row", "col"], "left").withColumn(out, F.coalesce("_m", F.lit(False))).drop("_m", "row", "col")


def unknown_stages(forced: str, allowed: list[str], fail: bool = False) -> Column:
    """Forced stages that aren't allowed, sorted; with ``fail`` any of them is an error."""
    bad = F.array_sort(F.array_except(forced, F.lit(allowed)))
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("unknown stages: "), F.array_join(bad, ", "))).cast("array<string>")).otherwise(bad) if fail else bad


def first_known(rows: DataFrame, by: list[str], value: str, path: str) -> DataFrame:
    """(by, value): the first value in the order of paths that isn't blank."""
    filled = F.nullif(F.trim(value), F.lit(""))
    return rows.groupBy(*by).agg(F.min_by(filled, F.when(filled.isNotNull(), F.col(path))).alias(value))


def map_agent(results: DataFrame, by: str, status: str, artifacts: str) -> DataFrame:
    """(by, status, issue, artifacts): blocked until a result is completed and has an artifact that exists.

    artifacts: array<struct<name, path, exists>>; a null status is a missing result.
    """
    there = F.filter(F.coalesce(F.col(artifacts), F.array().cast(results.schema[artifacts].dataType)), lambda x: x.exists)
    issue = F.when(F.col(status).isNull(), "map_adapter_waiting").when(F.col(status) != "completed", "map_result_incomplete").when(F.size(there) == 0, "map_artifacts_missing")
    return results.select(by, F.when(issue.isNull(), "completed").otherwise("blocked").alias("status"), issue.alias("issue"), F.when(issue.isNull(), F.transform(there, lambda x: x["name"])).otherwise(F.array().cast("array<string>")).alias("artifacts"))


def export_status(status: str, quality: str) -> Column:
    """completed when the map agent completed and its quality isn't under review."""
    return F.when((F.col(status) == "completed") & ~F.col(quality).eqNullSafe("review"), "completed").otherwise("review")


def first_source(*sources: tuple[str, Column]) -> Column:
    """The name of the first source that exists."""
    return F.coalesce(*(F.when(F.coalesce(there, F.lit(False)), F.lit(name)) for name, there in sources))


def validators(r: str = "") -> dict[str, Column]:
    """The rules of a report's stages over one row of its state.

    Columns: routing_status, route_vlm, ocr_queued, ocr_expected (arrays of page ids), ocr_results (pages with a result),
    markdown_bytes, markdown_pages, index_time, markdown_time, document_id, index_run, agents (map of agent to status),
    map_status, map_signature, manifest_signature, bundle_time, map_time, bundle_report, bundle_status, report_id.
    """
    c = lambda name: F.col(f"{r}{name}")
    covers = lambda have, want: F.size(F.array_except(want, have)) == 0
    return {
        "routing": (c("routing_status") == "completed") & (F.size(F.coalesce(c("route_vlm"), F.array().cast("array<string>"))) == 0),
        "ocr": covers(c("ocr_queued"), c("ocr_expected")) & covers(c("ocr_expected"), c("ocr_queued")) & (F.size(c("ocr_queued")) > 0) & covers(c("ocr_results"), c("ocr_queued")),
        "markdown": (c("markdown_bytes") > 100) & covers(c("markdown_pages"), c("ocr_expected")),
        "ragflow": (c("index_time") >= c("markdown_time")) & (c("document_id") != "") & (c("index_run") == "DONE"),
        "agents": (F.size(c("agents")) > 0) & F.forall(F.map_values(c("agents")), lambda s: s == "completed"),
        "maps": (c("map_status") == "completed") & (c("map_signature") == c("manifest_signature")),
        "bundle": (c("bundle_time") >= F.greatest(c("index_time"), c("map_time"))) & (c("bundle_report") == c("report_id")) & c("bundle_status").isin("completed", "review"),
    }


def ocr_queue(pages: DataFrame, page: str, path: str, reasons: str) -> DataFrame:
    """(page, input_name, path, reasons): queue rows of selected pages, with a name that a file system takes."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return pages.select(page, F.concat(F.replace(page, F.lit(":"), F.lit("_")), suffix).alias("input_name"), path, reasons)


def pending(queue: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    return queue.join(finished.select(key).distinct(), key, "left_anti")


def ingest_summary(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, parts, chunks, uploaded) of a report's parts in the index."""
    return parts.groupBy(*by).agg(F.count("*").alias("parts"), F.sum("chunks").alias("chunks"), F.bool_or("uploaded").alias("uploaded"))


def listing(text: str) -> Column:
    """struct<paths, bytes> of an archiver's technical listing: blocks of "key = value" lines behind a dashed line; sizes that aren't numbers count nothing."""
    body = F.element_at(F.split(text, "----------", 2), 2)
    blocks = F.split(F.replace(F.coalesce(body, F.lit("")), F.lit("\r"), F.lit("")), "\n\n")
    field = lambda b, name: F.get(F.filter(F.split(b, "\n"), lambda s: F.trim(F.substring_index(s, " = ", 1)) == name), F.lit(0))
    value = lambda b, name: F.trim(F.substring(field(b, name), F.instr(field(b, name), " = ") + 3, F.char_length(field(b, name))))
    paths = F.filter(F.transform(blocks, lambda b: value(b, "Path")), lambda p: p.isNotNull() & (p != ""))
    sizes = F.transform(blocks, lambda b: F.coalesce(value(b, "Size").try_cast("bigint"), F.lit(0).cast("bigint")))
    return F.struct(paths.alias("paths"), F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bytes"))
