"""Lines from pixels and their values: chains of skeleton pixels, crossing lines of different levels, whole value assignment, georeferenced grids, line and point transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import contours, raster, spatial, surface
from .graph import Scratch, components, list_ranks

#: Gaps in pixels that stitching bridges, and how well both ends must be aligned for each.
STITCHES = [(6.0, 0.82), (45.0, 0.93), (130.0, 0.965), (210.0, 0.985)]


def chains(pixels: DataFrame, by: str, scratch: Scratch) -> DataFrame:
    """(by, chain, row, col, node) of each map's skeleton: runs of pixels of degree two, with the nodes that they end in.

    Pixels of degree two that touch are one component; a node belongs to each chain that it touches, and two nodes that touch
    are a chain of their own. A chain is named by its smallest pixel number.
    """
    at = raster.skeleton_degrees(pixels, by).withColumn("_id", F.xxhash64(by, "row", "col"))
    at = scratch.table(at)
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in raster.NEIGHBOURS)))
    moved = at.select(by, F.col("_id").alias("p"), F.col("node").alias("pn"), "row", "col", moves.alias("m")).select(by, "p", "pn", (F.col("row") + F.col("m.a")).alias("row"), (F.col("col") + F.col("m.b")).alias("col"))
    touch = scratch.table(moved.join(at.select(by, "row", "col", F.col("_id").alias("q"), F.col("node").alias("qn")), [by, "row", "col"]).select(by, "p", "pn", "q", "qn"))
    roots = components(touch.where("not pn and not qn and p < q").select(F.col("p").alias("a"), F.col("q").alias("b")), scratch)
    inner = at.where("not node").join(roots.withColumnRenamed("node", "_n"), F.col("_id") == F.col("_n"), "left")
    inner = scratch.table(inner.select(by, F.coalesce("root", "_id").alias("chain"), F.col("_id"), "row", "col", "node"))
    own = inner.select(by, "chain", "row", "col", "node")
    ends = touch.where("pn and not qn").join(inner.select(F.col("_id").alias("q"), "chain"), "q").select(F.col("p").alias("_id"), "chain").distinct()
    ends = at.join(ends, "_id").select(by, "chain", "row", "col", "node")
    pairs = touch.where("pn and qn and p < q").select(F.xxhash64("p", "q").alias("chain"), F.explode(F.array("p", "q")).alias("_id"))
    pairs = at.join(pairs, "_id").select(by, "chain", "row", "col", "node")
    return own.unionByName(ends).unionByName(pairs)


def paths(pixels: DataFrame, by: str, scratch: Scratch) -> DataFrame:
    """(by, line, seq, row, col, n, closed): each map's skeleton as lines of pixels in their order.

    A line runs over pixels of degree two from node to node; two nodes that touch are a line of two pixels. It starts at the end with
    the smaller (row, col), a loop from one node on its smaller side; a ring without a node starts and ends at its smallest pixel. Steps between touching
    pixels are ranked in both directions, and the one that starts right is kept. Pixels without neighbours are no line.
    """
    at = raster.skeleton_degrees(pixels.select(by, F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col")).distinct(), by)
    at = at.select(by, F.struct("row", "col").alias("q"), F.col("node").alias("qn"))
    moves = F.explode(F.array(*(F.struct((F.col("q.row") + a).alias("row"), (F.col("q.col") + b).alias("col")) for a, b in raster.NEIGHBOURS)))
    moved = at.select(by, F.col("q").alias("p"), F.col("qn").alias("pn"), moves.alias("q"))
    steps = moved.join(at, [by, "q"]).withColumn("node", F.xxhash64(by, "p.row", "p.col", "q.row", "q.col"))
    steps = scratch.table(steps)
    pairs = steps.where("pn and qn and p < q").select(by, F.col("node").alias("line"), F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("seq"), "p"), F.struct(F.lit(1).cast("bigint").alias("seq"), F.col("q").alias("p")))).alias("v"), F.lit(2).cast("bigint").alias("n"), F.lit(False).alias("closed")).select(by, "line", "v.seq", "v.p", "n", "closed")
    own = steps.where("not (pn and qn)")
    ahead = own.where("not pn").select(by, F.col("p").alias("q"), F.col("node").alias("next"), F.col("q").alias("_w"))
    links = own.where("not qn").join(ahead, [by, "q"]).where("_w <> p").select("node", "next")
    links = links.unionByName(own.where("qn").select("node", F.lit(None).cast("bigint").alias("next")))
    ranked = scratch.table(own.join(list_ranks(links, scratch), "node"))
    ends = ranked.where("not closed").groupBy("list").agg(F.min_by(F.struct("p", "q"), "seq").alias("a"), F.max_by(F.struct(F.col("q").alias("p"), F.col("p").alias("q")), "seq").alias("b"))
    kept = ends.where("a < b").select("list", F.lit(0).cast("bigint").alias("_from"))
    first = ranked.where("closed").groupBy(by, "list").agg(F.min(F.struct("p", "q", "seq")).alias("a"))
    first = first.groupBy(by, "a.p").agg(F.min(F.struct("a.q", "list", "a.seq")).alias("b")).select("b.list", F.col("b.seq").alias("_from"))
    whole = ranked.join(kept.unionByName(first), "list").withColumn("seq", F.pmod(F.col("seq") - F.col("_from"), F.col("n")))
    named = whole.join(whole.where("seq = 0").select("list", F.col("node").alias("line"), F.col("p").alias("_p")), "list")
    tails = named.where("seq = 0").select(by, "line", "seq", "p", (F.col("n") + 1).alias("n"), "closed")
    heads = named.select(by, "line", (F.col("seq") + 1).alias("seq"), F.col("q").alias("p"), (F.col("n") + 1).alias("n"), "closed")
    return tails.unionByName(heads).unionByName(pairs).select(by, "line", "seq", "p.row", "p.col", "n", "closed")


def stitch_pairs(ends: DataFrame, by: str, line: str, gap: float, alignment: float, own: str | None = None) -> DataFrame:
    """(by, line, end, line2, end2, distance) of line ends that one pass of stitching may join.

    ends: (by, line, end, x, y, dx, dy) with outward directions, as ``traces.tangents`` gives them. Ends meet within the gap; they
    must point at each other, and along the bridge where it is longer than three pixels. ``own`` names a column whose equal values never meet.
    """
    met = spatial.within(ends, ends, gap, [by]).where(F.struct(f"l.{line}", "l.end") < F.struct(f"r.{line}", "r.end")).where(F.col(f"l.{line}") != F.col(f"r.{line}"))
    if own:
        met = met.where(F.col(f"l.{own}").isNull() | F.col(f"r.{own}").isNull() | (F.col(f"l.{own}") != F.col(f"r.{own}")))
    dot = lambda ax, ay, bx, by_: F.col(ax) * bx + F.col(ay) * by_
    facing = dot("l.dx", "l.dy", -F.col("r.dx"), -F.col("r.dy"))
    bx, by_ = (F.col("r.x") - F.col("l.x")) / F.col("distance"), (F.col("r.y") - F.col("l.y")) / F.col("distance")
    along = F.least(dot("l.dx", "l.dy", bx, by_), -F.col("r.dx") * bx - F.col("r.dy") * by_)
    good = (facing >= alignment) & ((F.col("distance") <= 3) | (along >= alignment))
    return met.where(good).select(F.col(f"l.{by}").alias(by), F.col(f"l.{line}").alias(line), F.col("l.end").alias("end"), F.col(f"r.{line}").alias(f"{line}2"), F.col("r.end").alias("end2"), "distance")


def bridges(ends: DataFrame, by: str, line: str, scratch: Scratch, stitches: list[tuple[float, float]] = STITCHES) -> DataFrame:
    """(line, end, line2, end2) of line ends that stitching joins, each end at most once.

    The gaps grow; at each, an end is joined to the nearest free end that may be joined, pairs by rising distance, so no end is
    used twice and no line is closed on itself by one bridge. Ends of one place and direction differ by nothing that a pair depends
    on, so places are paired: of two places that are each other's nearest, the free ends of both are joined in the order of their lines until
    one place has none left. Equal distances go by a hash of the places, which keeps chains of ties, and so the rounds, short. Ends that
    could close their own line are places of their own.
    """
    both = ends.groupBy(by, line).agg(F.min("end").alias("e"), F.max("end").alias("f"), *(f(c, "end").alias(f"{c}{n}") for f, n in ((F.min_by, 1), (F.max_by, 2)) for c in ("x", "y", "dx", "dy"))).where("e < f")
    reach, least = max(g for g, _ in stitches), min(a for _, a in stitches)
    far, bx, by_ = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = F.least(F.col("dx1") * bx + F.col("dy1") * by_, -F.col("dx2") * bx - F.col("dy2") * by_)
    close = (F.col("dx1") * F.col("dx2") + F.col("dy1") * F.col("dy2") <= -least) & (far <= reach) & ((far <= 3) | (along >= least * far - 1e-9))
    alone = both.where(close).select(by, line, F.lit(True).alias("_own"))
    place = F.xxhash64(by, "x", "y", "dx", "dy", F.when(F.col("_own"), F.col(line)))
    kept = ends.join(alone, [by, line], "left").withColumn("p", place).withColumn("_i", F.row_number().over(W.partitionBy("p").orderBy(line, "end")).cast("bigint") - 1)
    kept = scratch.table(kept.select(by, line, "end", "x", "y", "dx", "dy", "_own", "p", "_i"))
    free = scratch.table(kept.groupBy("p").agg(*(F.first(c).alias(c) for c in (by, "x", "y", "dx", "dy")), F.min(F.when(F.col("_own"), F.col(line))).alias("own"), F.count("*").alias("n")).withColumn("used", F.lit(0).cast("bigint")))
    taken = None
    for gap, alignment in stitches:
        at = free.where("used < n").select(by, F.col("p").alias("k"), F.lit("").alias("end"), "x", "y", "dx", "dy", F.col("own").alias("_o"))
        found = stitch_pairs(at, by, "k", gap, alignment, "_o").select("k", "k2", F.struct("distance", F.xxhash64("k", "k2").alias("h"), "k", "k2").alias("d"))
        left = scratch.table(found)
        while not left.isEmpty():
            best = left.select("d", F.explode(F.array("k", "k2")).alias("p")).groupBy("p").agg(F.min("d").alias("d"))
            pairs = best.groupBy("d").agg(F.count("*").alias("c")).where("c = 2").select(F.col("d.k").alias("k"), F.col("d.k2").alias("k2"))
            own = lambda c: free.select(F.col("p").alias(c), F.col("n").alias(f"{c}n"), F.col("used").alias(f"{c}u"))
            m = F.least(F.col("kn") - F.col("ku"), F.col("k2n") - F.col("k2u"))
            now = scratch.table(pairs.join(own("k"), "k").join(own("k2"), "k2").select("k", "k2", "ku", "k2u", m.alias("m")))
            taken = now if taken is None else taken.unionByName(now)
            more = now.select(F.explode(F.array(F.col("k"), F.col("k2"))).alias("p"), "m")
            free = scratch.table(free.join(more, "p", "left").withColumn("used", F.col("used") + F.coalesce("m", F.lit(0))).drop("m"))
            gone = free.where("used >= n").select("p")
            left = left.join(gone.withColumnRenamed("p", "k"), "k", "left_anti").join(gone.withColumnRenamed("p", "k2"), "k2", "left_anti")
            left = scratch.table(left.select("k", "k2", "d"))
    kind = dict(ends.dtypes)[line]
    if taken is None:
        return scratch.table(ends.limit(0).select(line, "end", F.col(line).alias(f"{line}2"), F.col("end").alias("end2")))
    steps = taken.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("i")).select("k", (F.col("ku") + F.col("i")).alias("i"), "k2", (F.col("k2u") + F.col("i")).alias("i2"))
    end = lambda k, i, n: kept.select(F.col("p").alias(k), F.col("_i").alias(i), F.struct(F.col(line).cast(kind).alias("l"), F.col("end").alias("e")).alias(n))
    met = steps.join(end("k", "i", "_a"), ["k", "i"]).join(end("k2", "i2", "_b"), ["k2", "i2"])
    met = met.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return scratch.table(met.select(F.col("a.l").alias(line), F.col("a.e").alias("end"), F.col("b.l").alias(f"{line}2"), F.col("b.e").alias("end2")))


def stitch(ends: DataFrame, by: str, line: str, scratch: Scratch, stitches: list[tuple[float, float]] = STITCHES) -> DataFrame:
    """(line, whole): the number of the stitched line that each line becomes part of, the smallest of its parts; see ``bridges``."""
    links = bridges(ends, by, line, scratch, stitches)
    roots = components(links.select(F.col(line).alias("a"), F.col(f"{line}2").alias("b")), scratch)
    lines = ends.select(line).distinct()
    return lines.join(roots, lines[line] == roots.node, "left").select(line, F.coalesce("root", line).alias("whole"))


def joined(vertices: DataFrame, links: DataFrame, by: str, line: str, seq: str, scratch: Scratch) -> DataFrame:
    """(by, whole, seq, x, y, parts, closed): the vertices of lines in the order in which bridges (line, end, line2, end2) join them.

    Every line is ranked in both directions: after its stop comes the line that is bridged to it, forward from a start and backward from a
    stop. Of the two ways through a joined line the one with the smaller first part is kept, or the one that takes a line alone forward. A whole
    is named by its first part; a ring of bridges is opened before its smallest part. Lines are long (bigint) numbers, unique over maps.
    """
    w = W.partitionBy(line).orderBy(seq)
    rows = vertices.select(by, line, seq, "x", "y").withColumn("_i", F.row_number().over(w).cast("bigint") - 1)
    sizes = rows.groupBy(by, line).agg(F.count("*").alias("_n"))
    # a direction of a line is one number: twice the line, and one more for backward
    both = links.select(line, "end", f"{line}2", "end2").unionByName(links.select(F.col(f"{line}2").alias(line), F.col("end2").alias("end"), F.col(line).alias(f"{line}2"), F.col("end").alias("end2")))
    way = lambda c, back: F.struct(F.col(c).alias("k"), back.alias("b"))
    leave = both.select(way(line, F.col("end") == "start").alias("node"), way(f"{line}2", F.col("end2") == "stop").alias("next"))
    ways = sizes.select(F.explode(F.array(way(line, F.lit(False)), way(line, F.lit(True)))).alias("node")).join(leave, "node", "left")
    ranked = scratch.table(list_ranks(ways, scratch))
    kept = ranked.groupBy("list").agg(F.min_by("node", "seq").alias("a"), F.max_by("node", "seq").alias("b"), F.min("node").alias("low"), F.first("closed").alias("_c"))
    # a way back starts with the last part, turned; a ring's two ways both start at its smallest part
    right = F.when(F.col("_c"), ~F.col("low.b")).otherwise((F.col("a.k") < F.col("b.k")) | ((F.col("a.k") == F.col("b.k")) & ~F.col("a.b")))
    order = ranked.join(kept.where(right).select("list"), "list").select("node.k", "node.b", "list", F.col("seq").alias("_s"), "n", "closed")
    order = order.select(F.col("k").alias(line), F.col("b").alias("_b"), F.col("list.k").alias("whole"), "_s", F.col("n").alias("parts"), "closed").join(sizes, line)
    before = W.partitionBy("whole").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    order = order.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    at = F.col("_at") + F.when(F.col("_b"), F.col("_n") - 1 - F.col("_i")).otherwise(F.col("_i"))
    return rows.drop(by).join(order, line).select(by, "whole", at.alias("seq"), "x", "y", "parts", "closed")


def _weakness(key: str) -> Column:
    doubt = F.coalesce(F.nullif("residual", F.lit(0.0)), F.lit(1.0)) + F.coalesce(F.nullif("spread", F.lit(0.0)), F.lit(1.0))
    return F.struct((~F.coalesce("direct_label", F.lit(False))).cast("int").alias("w"), doubt.alias("d"), F.negate(F.coalesce("coverage", F.lit(0.0))).alias("c"), F.col(key).alias("k"))


def prune_crossings(lines: DataFrame, crossings: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``lines`` with accepted and rejection_reason after the weaker of every two crossing lines of different levels is rejected.

    lines: (key, accepted, direct_label, residual, spread, coverage); crossings: (first, second) of different levels. Weaker is
    the one without a label of its own, then the one with more residual and spread, then with less coverage, then the later.
    Each round rejects the losers of the pairs whose winner loses to no accepted line itself, all at once, until no pair is left.
    """
    state = scratch.table(lines.withColumn("rejection_reason", F.lit(None).cast("string")))
    while True:
        live = state.where("accepted").select(F.col(key).alias("_k"), _weakness(key).alias("_w"))
        pairs = crossings.join(live.select(F.col("_k").alias("first"), F.col("_w").alias("w1")), "first").join(live.select(F.col("_k").alias("second"), F.col("_w").alias("w2")), "second")
        duels = scratch.table(pairs.select(F.when(F.col("w1") > F.col("w2"), F.col("first")).otherwise(F.col("second")).alias("loser"), F.when(F.col("w1") > F.col("w2"), F.col("second")).otherwise(F.col("first")).alias("winner")).distinct())
        sure = duels.join(duels.select(F.col("loser").alias("winner")).distinct(), "winner", "left_anti").select(F.col("loser").alias(key)).distinct().withColumn("_out", F.lit(True))
        if duels.isEmpty():
            return state
        out = state.join(sure, key, "left")
        state = scratch.table(out.withColumns({"accepted": F.col("accepted") & F.col("_out").isNull(), "rejection_reason": F.when(F.col("_out"), "crosses_different_level").otherwise(F.col("rejection_reason"))}).drop("_out"))


def prune_crossing_segments(lines: DataFrame, segments: DataFrame, key: str, group: str, size: float, by: list[str], scratch: Scratch) -> DataFrame:
    """``prune_crossings`` of lines that are segments (by, key, group, x1, y1, x2, y2), those of one group being of one level, with the same rows.

    No pair is listed: a round asks which lines a stronger one crosses, and which of these a line crosses that none does.
    """
    state = scratch.table(lines.withColumn("rejection_reason", F.lit(None).cast("string")))
    live = scratch.table(segments.join(state.where("accepted").select(key, _weakness(key).alias("_w")), key))
    while True:
        lost = scratch.table(surface.crossed(live, live, key, group, size, by, "_w"))
        if lost.isEmpty():
            break
        sure = scratch.table(surface.crossed(live.join(lost, key, "left_semi"), live.join(lost, key, "left_anti"), key, group, size, by, "_w"))
        out = state.join(sure.withColumn("_out", F.lit(True)), key, "left")
        state = scratch.table(out.withColumns({"accepted": F.col("accepted") & F.col("_out").isNull(), "rejection_reason": F.when(F.col("_out"), "crosses_different_level").otherwise(F.col("rejection_reason"))}).drop("_out"))
        # whom no stronger one crosses is settled with all whom it crosses
        live = scratch.table(live.join(lost, key, "left_semi").join(sure, key, "left_anti"))
    return state


def grid_constraints(lines: DataFrame, direct: DataFrame, crossings: DataFrame | None, key: str, scratch: Scratch, segments: DataFrame | None = None, group: str = "g", size: float = 120.0, by: list[str] | None = None) -> DataFrame:
    """Traced lines after direct labels override inferred values and crossings are pruned, with value_source.

    lines: (key, value, inferred, accepted, profile_suspect, residual, spread, coverage); direct: (key, label). Crossings are pairs (first, second), or
    those of ``segments`` (by, key, group, x1, y1, x2, y2), which are not listed.
    """
    own = direct.select(key, F.col("label").alias("_label"))
    hit = F.col("_label").isNotNull() & ~F.coalesce("profile_suspect", F.lit(False))
    out = lines.join(own, key, "left").withColumn("direct_label", hit)
    out = out.withColumns({"value": F.when(hit, F.col("_label")).otherwise(F.col("value")), "inferred": F.when(hit, F.col("_label")).otherwise(F.col("inferred")), "accepted": hit | F.col("accepted")}).drop("_label")
    out = prune_crossings(out, crossings, key, scratch) if segments is None else prune_crossing_segments(out, segments, key, group, size, by or [], scratch)
    out = out.withColumn("value", F.coalesce("value", "inferred"))
    return out.withColumn("value_source", F.when(F.col("direct_label"), "direct_ocr").when(F.col("value").isNotNull(), "surface_interpolation").otherwise("unassigned"))


def line_marks(stats: DataFrame) -> DataFrame:
    """Columns leak and suspect of lines (length, straightness) that are too straight to be contours."""
    return stats.withColumns({"leak": (F.col("straightness") < 0.035) & (F.col("length") > 400), "suspect": (F.col("straightness") < 0.01) & (F.col("length") > 100)})


def assign(labels: DataFrame, vertices: DataFrame, stats: DataFrame, by: str, line: str, label: str, interval: float, profiles: DataFrame | None = None, reach: float = 70.0) -> DataFrame:
    """(by, line, value, votes, total, verdict): labels of each map vote for the values of its lines.

    labels: (by, label, x, y, value); vertices: (by, line, vertex, x, y); stats: (by, line, length, straightness); profiles:
    (by, label, x, y), numbers of survey profiles. A profile number marks the nearest straight line within 1.25 of the reach as
    a leak. Values outside the map's main band are left out; a label votes for the line of its nearest vertex within the reach,
    leaks and short lines aside; lines under suspicion end in conflict.
    """
    marked = line_marks(stats)
    if profiles is not None:
        straight = marked.where("length >= 140 and straightness < 0.08").select(by, line)
        near = spatial.nearest(profiles, vertices.join(straight, [by, line], "left_semi"), reach * 1.25, label, "vertex", [by])
        leaks = near.join(vertices.select("vertex", by, line), "vertex").select(by, line).distinct().withColumn("_leak", F.lit(True))
        marked = marked.join(leaks, [by, line], "left").withColumn("leak", F.col("leak") | F.coalesce("_leak", F.lit(False))).drop("_leak")
    band = contours.value_band(labels, "value", [by], interval).select(by, "low", "high")
    kept = labels.join(band, by, "left").where("low is null or value between low and high").drop("low", "high")
    fit = marked.where(~F.col("leak") & (F.col("length") >= max(80.0, reach * 0.75))).select(by, line, "suspect")
    near = spatial.nearest(kept, vertices.join(fit, [by, line], "left_semi"), reach, label, "vertex", [by])
    met = near.join(vertices.select("vertex", by, line), "vertex").join(kept.select(label, "value"), label).join(fit, [by, line])
    met = met.withColumn("_line", F.struct(by, line))
    return contours.votes(met, "_line", "value", label, "suspect").select(f"_line.{by}", f"_line.{line}", "value", "votes", "total", "verdict")


def cell_size(det: Column, dx: Column, dy: Column) -> Column:
    """The side of a target cell of the same area as a source cell."""
    return F.sqrt(F.greatest(F.abs(det) * dx * dy, F.lit(1e-9)))


def georeference(grid: DataFrame, fits: DataFrame, by: str, size: float, most: int = 4_000_000) -> DataFrame:
    """(by, row, col, x, y, z): each map's grid (by, row, col, z) on a lattice of map coordinates.

    fits: (by, ax, bx, cx, ay, by_, cy), map coordinates as affine functions of col and row. A target node is carried back by the
    inverse and read on the Delaunay triangle of the grid's nodes that it lies in: the images of cells are equal parallelograms, whose shorter
    diagonal parts them (rectangles: the one from the first corner). A node outside, or in a triangle with a blank corner, is left out. A map of
    over ``most`` nodes is refused.
    """
    from . import surface

    at = grid.where("z is not null").join(fits, by).withColumns({"mx": F.col("ax") + F.col("bx") * F.col("col") + F.col("cx") * F.col("row"), "my": F.col("ay") + F.col("by_") * F.col("col") + F.col("cy") * F.col("row")})
    edge = lambda f, c, e: f(F.col(c) / size + e).cast("bigint")
    box = at.groupBy(by).agg(F.min("mx").alias("x0"), F.max("mx").alias("x1"), F.min("my").alias("y0"), F.max("my").alias("y1"))
    box = box.select(by, edge(F.floor, "x0", 1e-9).alias("c0"), edge(F.ceil, "x1", -1e-9).alias("c1"), edge(F.floor, "y0", 1e-9).alias("r0"), edge(F.ceil, "y1", -1e-9).alias("r1"))
    n = (F.col("c1") - F.col("c0") + 1) * (F.col("r1") - F.col("r0") + 1)
    rows = F.when(n > most, F.raise_error(F.lit("target grid has too many cells")).cast("array<bigint>")).otherwise(F.sequence("r0", "r1"))
    nodes = box.select(by, "c0", "r0", "c1", F.explode(rows).alias("r")).select(by, "c0", "r0", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    nodes = nodes.join(fits, by).withColumns({"tx": F.col("c") * F.lit(size), "ty": F.col("r") * F.lit(size)})
    det = F.col("bx") * F.col("cy") - F.col("cx") * F.col("by_")
    u, v = F.col("tx") - F.col("ax"), F.col("ty") - F.col("ay")
    back = nodes.withColumns({"x": (F.col("cy") * u - F.col("cx") * v) / det, "y": (F.col("bx") * v - F.col("by_") * u) / det, "node": F.struct("r", "c")})
    # lengths of the images of the diagonals (1, 1) and (1, -1)
    first = F.hypot(F.col("bx") + F.col("cx"), F.col("by_") + F.col("cy")) <= F.hypot(F.col("bx") - F.col("cx"), F.col("by_") - F.col("cy")) + 1e-9
    z = surface.triangular(back.select(by, "node", "x", "y", first.alias("first")), grid, "node", [by])
    out = back.join(z, [by, "node"]).where("z is not null")
    return out.select(by, (F.col("r") - F.col("r0")).alias("row"), (F.col("c") - F.col("c0")).alias("col"), F.col("tx").alias("x"), F.col("ty").alias("y"), "z")


def georeference_verdict(controls: Column, p95: Column, size: float) -> Column:
    """accepted with four control points or more and a 95 % error of half a cell at most."""
    return F.when((controls >= 4) & (p95 <= size * 0.5), "accepted").otherwise("review")


def cell_side(grid: DataFrame, fits: DataFrame, by: str) -> DataFrame:
    """(by, size): the side of a target cell for each map, from the fit and the median steps of its grid's columns and rows; one where a map has one of them."""
    def steps(c: str) -> DataFrame:
        own = grid.select(by, F.col(c).alias("v")).distinct()
        own = own.withColumn("d", F.col("v") - F.lag("v").over(W.partitionBy(by).orderBy("v")))
        return own.groupBy(by).agg(F.coalesce(F.percentile("d", F.lit(0.5)), F.lit(1.0)).alias(f"d_{c}"))

    det = F.col("bx") * F.col("cy") - F.col("cx") * F.col("by_")
    return fits.join(steps("col"), by).join(steps("row"), by).select(by, cell_size(det, F.col("d_col"), F.col("d_row")).alias("size"))


def main_axis(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, x, y, angle, elongation): centre, direction in degrees of [0, 180) and the ratio of the small to the large spread of point groups."""
    s = points.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    mean, gap = (F.col("xx") + F.col("yy")) / 2, F.hypot((F.col("xx") - F.col("yy")) / 2, F.col("xy"))
    angle = F.pmod(F.degrees(F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2), F.lit(180.0))
    ratio = F.when(mean + gap > 0, F.sqrt(F.greatest(mean - gap, F.lit(0.0)) / (mean + gap)))
    return s.select(*by, "n", "x", "y", angle.alias("angle"), ratio.alias("elongation"))


def label_lines(labels: DataFrame, lines: DataFrame, by: str, label: str, line: str, distance: float = 45.0, angle: float = 20.0, profile: str | None = None, score: str | None = None) -> DataFrame:
    """(by, label, line, cost): each label's best line by distance and one and a half times the angle between them.

    labels: (by, label, x, y, angle); lines: (by, line, x, y, x1, y1, angle) with (x, y) and (x1, y1) two points of the infinite line and angle its direction in degrees of
    [0, 180). A line lies in one band of direction and of distance from the origin; a label looks up all bands that lines within its limits can lie in, so the join is
    exact and compares no other pairs. Where lines lie close, labels are looked up within a small cost first, which doubles; one that has found a line has no better
    beyond that cost, and only the rest go on, so the pairs that meet grow with the labels and not with the density of lines. Of copies of a line the smallest stands for all.
    Costs count to six digits and the distance to nine, as the last bits depend on how a line is given; ties go to the smaller line. With ``profile`` and ``score``, columns of the labels, only the label with the
    highest score is kept of those that give one line the same profile, ties to the smaller label.
    """
    extra, most = [c for c in (profile, score) if c], distance + 1.5 * angle
    scratch, tasks = Scratch(labels.sparkSession, "labels"), labels.sparkSession.sparkContext.defaultParallelism
    own = labels.select(by, F.struct(by, label, *extra).alias("_k"), "x", "y", "angle").where(spatial._finite("x") & spatial._finite("y") & spatial._finite("angle"))
    open_ = scratch.table(own.repartition(tasks, by, "x", "y", "angle"))
    rho = lambda t, x, y: F.cos(F.radians(t)) * F.col(y) - F.sin(F.radians(t)) * F.col(x)
    rows = lines.select(by, F.col("x").alias("_x0"), F.col("y").alias("_y0"), F.col("x1").alias("_x1"), F.col("y1").alias("_y1"), F.col("angle").cast("double").alias("_t"), F.col(line).alias("_line"))
    rows = rows.groupBy(by, "_x0", "_y0", "_x1", "_y1", "_t").agg(F.min("_line").alias("_line")).where("_x0 <> _x1 or _y0 <> _y1").where(spatial._finite("_t"))
    # bands go by the direction from point to point, as distances do; the angle given may differ by a little
    rows = rows.withColumn("_f", F.pmod(F.degrees(F.atan2(F.col("_y1") - F.col("_y0"), F.col("_x1") - F.col("_x0"))), F.lit(180.0)))
    rows = scratch.table(rows.where(~F.isnan("_f")).withColumn("_o", rho(F.col("_f"), "_x0", "_y0")))
    slip = (rows.agg(F.max(G.angle_between(F.col("_f"), F.col("_t")))).first()[0] or 0.0) + 1e-6

    def bands(cost: float) -> tuple[DataFrame, float, int, float, float]:
        """The lines in bands fit for a cost, with the limit of the angle, the number of bands of direction, the limit of the distance and a band's width in pixels."""
        turn, reach = min(angle, cost / 1.5) + slip, min(distance, cost) + 1e-6
        turns = max(int(1800 // turn), 1)
        return rows.withColumns({"_b": F.least(F.floor(F.col("_f") * turns / 180), F.lit(turns - 1)), "_c": F.floor(F.col("_o") / (2 * reach))}), turn, turns, reach, 2 * reach

    cost, last, out = most, None, None
    for _ in range(30):  # halved until the band of a line holds two in the mean, or halving parts them no more
        sizes = bands(cost)[0].groupBy(by, "_b", "_c").agg(F.count("*").cast("double").alias("n"))
        mean = sizes.agg(F.sum(F.col("n") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0.0))).first()[0]
        if mean is None or mean <= 2 or (last is not None and mean > last * 0.95):
            break
        last, cost = mean, cost / 2
    while True:
        cost = most if cost > most * 0.75 else cost
        laid, turn, turns, reach, cell = bands(cost)
        near = F.array_distinct(F.transform(F.sequence(F.floor((F.col("angle") - turn) * turns / 180), F.floor((F.col("angle") + turn) * turns / 180)), lambda b: F.pmod(b, F.lit(turns))))
        seen = open_.withColumn("_b", F.explode(near))
        middle, slack = rho((F.col("_b") + 0.5) * 180 / turns, "x", "y"), F.hypot("x", "y") * F.radians(F.lit(90 / turns)) + reach
        seen = seen.withColumn("_c", F.explode(F.sequence(F.floor((middle - slack) / cell), F.floor((middle + slack) / cell))))
        met = seen.join(laid.hint("merge"), [by, "_b", "_c"])
        met = met.withColumns({"_d": G.line_distance(F.col("x"), F.col("y"), F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1")), "_a": G.angle_between(F.col("angle"), F.col("_t"))}).where((F.col("_d") <= distance + 1e-9) & (F.col("_a") <= angle))
        met = met.withColumn("_s", F.struct(F.round(F.col("_d") + 1.5 * F.col("_a"), 6).alias("c"), "_line", (F.col("_d") + 1.5 * F.col("_a")).alias("cost")))
        if cost < most:
            met = met.where(F.col("_s.c") <= cost - 1e-6)
        best = met.groupBy("_k").agg(F.min("_s").alias("b"))
        if cost < most:
            best = scratch.table(best)
            open_ = scratch.table(open_.join(best.select("_k"), "_k", "left_anti"))
        out = best if out is None else out.unionByName(best)
        if cost >= most or open_.isEmpty():
            break
        cost *= 2
    best = out.select(f"_k.{by}", f"_k.{label}", *(f"_k.{c}" for c in extra), F.col("b._line").alias(line), "b.cost")
    if not profile or not score:
        return best.select(by, label, line, "cost")
    first = best.groupBy(by, profile, line).agg(F.min(F.struct(F.negate(score).alias("s"), F.col(label).alias("label"), "cost")).alias("f"))
    return first.select(by, F.col("f.label").alias(label), profile, line, F.negate("f.s").alias(score), "f.cost")


def similarity(x: Column, y: Column, scale: Column, degrees: Column, dx: Column, dy: Column, mirrored: Column) -> Column:
    """struct<x, y> of a point scaled, mirrored in its ordinate where ``mirrored`` says so, turned and moved."""
    v = F.when(mirrored, -y).otherwise(y)
    c, s = F.cos(F.radians(degrees)) * scale, F.sin(F.radians(degrees)) * scale
    return F.struct((c * x - s * v + dx).alias("x"), (s * x + c * v + dy).alias("y"))


def similarity_back(x: Column, y: Column, scale: Column, degrees: Column, dx: Column, dy: Column, mirrored: Column) -> Column:
    """struct<x, y>: the point that ``similarity`` carries to (x, y)."""
    c, s = F.cos(F.radians(degrees)) / scale, F.sin(F.radians(degrees)) / scale
    u, v = x - dx, y - dy
    w = c * v - s * u
    return F.struct((c * u + s * v).alias("x"), F.when(mirrored, -w).otherwise(w).alias("y"))


def dash_links(dashes: DataFrame, by: str, key: str, gap: float, angle: float = 15.0) -> DataFrame:
    """(by, first, second, distance) of dashes (by, key, x, y, angle, elongation) that continue each other.

    Long dashes alone (elongation under 0.35) whose centres lie within the gap, with directions alike and both along the link.
    """
    long = dashes.where("elongation < 0.35").select(by, key, "x", "y", "angle")
    met = spatial.pairs(long, key, gap, [by])
    link = F.degrees(F.atan2(F.col("r.y") - F.col("l.y"), F.col("r.x") - F.col("l.x")))
    alike = [G.angle_between(F.col("l.angle"), F.col("r.angle")), G.angle_between(F.col("l.angle"), link), G.angle_between(F.col("r.angle"), link)]
    return met.where(F.greatest(*alike) <= angle).select(F.col(f"l.{by}").alias(by), F.col(f"l.{key}").alias("first"), F.col(f"r.{key}").alias("second"), "distance")


def inside_border(pixels: DataFrame, sizes: DataFrame, by: str, margin: int) -> DataFrame:
    """Pixels (by, row, col) that keep the margin to all sides of their map (by, height, width)."""
    out = pixels.join(sizes, by)
    return out.where(F.col("row").between(margin, F.col("height") - 1 - margin) & F.col("col").between(margin, F.col("width") - 1 - margin)).select(pixels.columns)


def profile_labels(readings: DataFrame, inventory: DataFrame, by: str, text: str, profile: str, scale: float, least: float = 0.8) -> DataFrame:
    """Readings (by, text, score, polygon) whose digits name a profile of the inventory, with its id, the middle (x, y) of their scaled polygon and the angle of its first edge.

    Readings under the least score, or whose polygon hasn't four corners, name none; ids are text and equal digit by digit.
    """
    p = F.col("polygon")
    mean = lambda i: F.aggregate(p, F.lit(0.0), lambda s, q: s + q[i]) / 4 * scale
    edge = lambda i: p[1][i] - p[0][i]
    named = readings.where((F.col("score") >= least) & (F.size("polygon") == 4)).withColumn(profile, F.regexp_replace(text, r"\P{Nd}", ""))
    known = inventory.select(F.col(profile).cast("string").alias(profile)).distinct()
    angle = F.pmod(F.degrees(F.atan2(edge(1), edge(0))), F.lit(180.0))
    return named.join(known, profile).select(*(c for c in readings.columns if c != "polygon"), profile, mean(0).alias("x"), mean(1).alias("y"), angle.alias("angle"))


def consolidate(segments: DataFrame, by: str, key: str, least: float, scratch: Scratch, angle: float = 3.0, offset: float = 24.0, gap: float = 180.0) -> DataFrame:
    """(by, line, support, x, y, x1, y1, angle, length): lines through the segments (by, key, x1, y1, x2, y2) that continue each other.

    Segments of at least the least length are linked when their angles, their distances from the origin and the gap along the
    one with the smaller key stay within the limits; they meet in cells of angle and distance. Each component's ends are fitted by
    their main axis, and ``line`` is its smallest key. Keys are unique over maps.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rows = segments.select(by, F.col(key).alias("k"), "x1", "y1", "x2", "y2", F.hypot(dx, dy).alias("len"), F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0)).alias("t")).where(F.col("len") >= least)
    c, s, turns = F.cos(F.radians("t")), F.sin(F.radians("t")), max(int(180 // angle), 1)
    rows = rows.withColumn("rho", (c * (F.col("y1") + F.col("y2")) - s * (F.col("x1") + F.col("x2"))) / 2)
    # copies continue each other, so one stands for all; the gap is taken along whichever has a smaller key than some copy of the other
    rows = rows.withColumn("lone", F.when(F.col(by).isNull() | ~(F.abs("rho") < 1e300), F.col("k")))  # nothing continues these
    alike = [by, "x1", "y1", "x2", "y2", "lone", "len", "t", "rho"]
    single = scratch.table(rows.groupBy(*alike).agg(F.min("k").alias("k"), F.max("k").alias("most")))
    cells = single.withColumns({"ct": F.least(F.floor(F.col("t") * turns / 180), F.lit(turns - 1)), "cr": F.floor(F.col("rho") / offset)})
    near = lambda n, w: F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: w(F.col(n) + d))))
    spread = cells.withColumn("ct", near("ct", lambda v: F.pmod(v, F.lit(turns)))).withColumn("cr", near("cr", lambda v: v))
    a, b = spread.alias("a"), cells.hint("merge").alias("b")
    met = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.ct") == F.col("b.ct")) & (F.col("a.cr") == F.col("b.cr")) & (F.col("a.k") < F.col("b.most")) & (F.col("a.k") != F.col("b.k")))
    along = lambda p, i: (F.col(f"{p}.x{i}") * (F.col("a.x2") - F.col("a.x1")) + F.col(f"{p}.y{i}") * (F.col("a.y2") - F.col("a.y1"))) / F.col("a.len")
    lo, hi = (lambda p: F.least(along(p, 1), along(p, 2))), (lambda p: F.greatest(along(p, 1), along(p, 2)))
    linked = (G.angle_between(F.col("a.t"), F.col("b.t")) <= angle) & (F.abs(F.col("a.rho") - F.col("b.rho")) <= offset) & (F.greatest(lo("a"), lo("b")) <= F.least(hi("a"), hi("b")) + gap)
    stars = components(met.where(linked).select(F.col("a.k").alias("a"), F.col("b.k").alias("b")), scratch)
    lead = single.join(stars, single.k == stars.node, "left").select(*(F.col(v).alias(f"_{v}") for v in alike[:6]), F.coalesce("root", "k").alias("line"))
    same = F.lit(True)
    for v in alike[:6]:
        same &= F.col(v).eqNullSafe(F.col(f"_{v}"))
    named = rows.join(lead, same)
    ends = named.select(by, "line", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select(by, "line", "p.x", "p.y")
    axis = main_axis(ends, [by, "line"]).select(by, "line", F.col("x").alias("mx"), F.col("y").alias("my"), "angle", (F.col("n") / 2).cast("bigint").alias("support"))
    u, v = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    at = u * (F.col("x") - F.col("mx")) + v * (F.col("y") - F.col("my"))
    out = ends.join(axis, [by, "line"]).groupBy(by, "line", "mx", "my", "angle", "support").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where(F.col("hi") - F.col("lo") >= least)
    point = lambda d: (F.col("mx") + u * F.col(d), F.col("my") + v * F.col(d))
    (x0, y0), (x1, y1) = point("lo"), point("hi")
    return out.select(by, "line", "support", x0.alias("x"), y0.alias("y"), x1.alias("x1"), y1.alias("y1"), "angle", (F.col("hi") - F.col("lo")).alias("length"))
