"""Gridded surfaces in long form (map, row, col, x, y, z): burning, components, harmonic fill, sampling, contour segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from .graph import Scratch, components, list_ranks


def median_of_duplicates(points: DataFrame, value: str, by: list[str] | None = None, digits: int = 3) -> DataFrame:
    """One row per rounded coordinate with the median of its values."""
    keys = [*(by or []), F.round("x", digits).alias("x"), F.round("y", digits).alias("y")]
    return points.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias(value))


def burn(points: DataFrame, value: str, weight: Column, size: float, by: list[str] | None = None, conflict: float = 1.0) -> DataFrame:
    """(by, row, col, z, weight, n, conflict): the weighted mean of each grid cell; conflict when its values spread too far.

    Sums combine before the shuffle, so a hot cell costs no more than another.
    """
    by = by or []
    v, w = F.col(value), F.col("_w")
    rows = points.withColumn("_w", weight).select(*by, G.cell("y", size).alias("row"), G.cell("x", size).alias("col"), value, "_w")
    return rows.groupBy(*by, "row", "col").agg((F.sum(v * w) / F.sum(w)).alias("z"), F.max(w).alias("weight"), F.count("*").alias("n"), (F.max(v) - F.min(v) > conflict).alias("conflict"))


def cell_components(cells: DataFrame, scratch: Scratch, width: int = 1 << 31, by: list[str] | None = None) -> DataFrame:
    """Cells (by, row, col, ..) with the component of their edge neighbours: the smallest cell number row * width + col, or a hash of map and cell where ``by`` tells maps apart."""
    by = by or []
    at = cells.withColumn("_id", F.xxhash64(*by, "row", "col") if by else F.col("row") * F.lit(width) + F.col("col"))
    right = at.select(*by, F.col("_id").alias("a"), F.col("row"), (F.col("col") + 1).alias("col"))
    down = at.select(*by, F.col("_id").alias("a"), (F.col("row") + 1).alias("row"), F.col("col"))
    edges = right.unionByName(down).join(at.select(*by, "row", "col", F.col("_id").alias("b")), [*by, "row", "col"]).select("a", "b")
    roots = components(edges, scratch)
    return at.join(roots, at._id == roots.node, "left").select(*cells.columns, F.coalesce("root", "_id").alias("component"))


def constrained(cells: DataFrame, fixed: str) -> DataFrame:
    """Cells of components that hold a fixed value."""
    return cells.join(cells.where(F.col(fixed).isNotNull()).select("component").distinct(), "component", "left_semi")


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """One component: weighted discrete Laplace equations by conjugate gradients."""
    rows, cols = pdf.row.to_numpy(), pdf.col.to_numpy()
    where = {(r, c): i for i, (r, c) in enumerate(zip(rows, cols))}
    pairs = np.array([(i, j) for (r, c), i in where.items() for n in ((r, c + 1), (r + 1, c)) if (j := where.get(n)) is not None], np.int64).reshape(-1, 2)
    a, b = pairs[:, 0], pairs[:, 1]
    n = len(pdf)
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    f = pdf.fixed.to_numpy(float)
    w = np.where(np.isnan(f), 0.0, pdf.weight.to_numpy(float))
    diag, rhs = degree + w, w * np.nan_to_num(f)

    def apply(x: np.ndarray) -> np.ndarray:
        return diag * x - np.bincount(a, x[b], n) - np.bincount(b, x[a], n)

    x = np.full(n, np.nanmean(f))
    r = rhs - apply(x)
    z = r / diag
    p, rz = z.copy(), r @ z
    for _ in range(10 * n + 50):
        if np.sqrt(r @ r) <= 1e-10 * max(1.0, np.sqrt(rhs @ rhs)):
            break
        q = apply(p)
        step = rz / (p @ q)
        x, r = x + step * p, r - step * q
        z = r / diag
        rz, old = r @ z, rz
        p = z + rz / old * p
    return pd.DataFrame({"component": pdf.component, "row": rows, "col": cols, "z": x})


def harmonic(cells: DataFrame, by: str = "component") -> DataFrame:
    """(component, row, col, z): each component's smoothest surface through its weighted fixed cells (columns fixed, weight).

    A component is one task's work: maps are bounded by their grid limit, and many are solved side by side. Values stay
    within the range of the fixed ones.
    """
    rows = cells.select(F.col(by).cast("long").alias("component"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("fixed").cast("double").alias("fixed"), F.col("weight").cast("double").alias("weight"))
    return rows.groupBy("component").applyInPandas(_solve, "component bigint, row bigint, col bigint, z double")


def bilinear(points: DataFrame, grid: DataFrame, x0: float, y0: float, size: float, key: str, by: list[str] | None = None) -> DataFrame:
    """(by, key, z): the value of the point's map (``by``) at each point by one equi-join on four cell indices; null outside and beside blanks."""
    by = by or []
    at = points.select(*by, key, ((F.col("x") - x0) / size).alias("u"), ((F.col("y") - y0) / size).alias("v"))
    at = at.withColumns({"c": F.floor("u").cast("bigint"), "r": F.floor("v").cast("bigint")})
    corners = F.explode(F.array(*(F.struct((F.col("r") + i).alias("row"), (F.col("c") + j).alias("col"), ((F.col("v") - F.col("r")) if i else (1 - F.col("v") + F.col("r"))).alias("wr"), ((F.col("u") - F.col("c")) if j else (1 - F.col("u") + F.col("c"))).alias("wc")) for i in (0, 1) for j in (0, 1))))
    rows = at.select(*by, key, corners.alias("_at")).select(*by, key, "_at.row", "_at.col", (F.col("_at.wr") * F.col("_at.wc")).alias("w"))
    met = rows.join(grid.select(*by, "row", "col", "z"), [*by, "row", "col"], "left").where((F.col("w") > 0) | F.col("z").isNotNull())
    return met.groupBy(*by, key).agg(F.when(F.count_if(F.col("z").isNull() & (F.col("w") > 0)) == 0, F.sum(F.col("z") * F.col("w"))).alias("z"))


def triangular(points: DataFrame, grid: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(by, key, z): values at points (by, key, x, y, first) in cells of a grid, each cell parted by one diagonal; null outside and at blank corners.

    first: whether the diagonal runs from the cell's first corner to the opposite one, else between the other two. A point meets the three corners of its
    triangle by one equi-join.
    """
    at = points.select(*by, key, "first", F.floor("x").cast("bigint").alias("c"), F.floor("y").cast("bigint").alias("r"), F.col("x").alias("u"), F.col("y").alias("v"))
    u, v = F.col("u") - F.col("c"), F.col("v") - F.col("r")
    corner = lambda i, j, w: F.struct((F.col("r") + i).alias("row"), (F.col("c") + j).alias("col"), w.alias("w"))
    along = F.when(u >= v, F.array(corner(0, 0, 1 - u), corner(0, 1, u - v), corner(1, 1, v))).otherwise(F.array(corner(0, 0, 1 - v), corner(1, 0, v - u), corner(1, 1, u)))
    across = F.when(u + v <= 1, F.array(corner(0, 0, 1 - u - v), corner(0, 1, u), corner(1, 0, v))).otherwise(F.array(corner(1, 1, u + v - 1), corner(1, 0, 1 - u), corner(0, 1, 1 - v)))
    rows = at.select(*by, key, F.explode(F.when(F.col("first"), along).otherwise(across)).alias("_at")).select(*by, key, "_at.row", "_at.col", "_at.w")
    met = rows.join(grid.select(*by, "row", "col", "z"), [*by, "row", "col"], "left")
    return met.groupBy(*by, key).agg(F.when(F.count_if(F.col("z").isNull() & (F.col("w") > 1e-12)) == 0, F.sum(F.when(F.col("w") > 1e-12, F.col("z") * F.col("w")))).alias("z"))


#: Edges that a contour crosses in each of the 16 cases of marching squares (t top, r right, b bottom, l left);
#: corners count 1, 2, 4, 8 from the upper left clockwise. Saddles separate the high corners.
CASES = {1: "lt", 2: "tr", 3: "lr", 4: "rb", 5: "lt rb", 6: "tb", 7: "lb", 8: "bl", 9: "bt", 10: "tr bl", 11: "br", 12: "rl", 13: "rt", 14: "tl"}


def contour_segments(grid: DataFrame, interval: float, by: list[str] | None = None) -> DataFrame:
    """(by, level, row, col, case, x1, y1, x2, y2, e1, e2): segments of the level lines at multiples of the interval by marching squares.

    The corners of a cell meet by three equi-joins; cells beside blanks give nothing. Coordinates are in cells. Segments have the higher
    ground on their left; e1 and e2 (struct<down, row, col>) name the cell edges that they come from and lead to, so segments of one level meet at equal edges.
    """
    by = by or []
    g = grid.where("z is not null").select(*by, "row", "col", "z")
    shifted = lambda dr, dc, name: g.select(*by, (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("z").alias(name))
    keys = [*by, "row", "col"]
    cells = g.withColumnRenamed("z", "z1").join(shifted(0, 1, "z2"), keys).join(shifted(1, 1, "z4"), keys).join(shifted(1, 0, "z8"), keys)
    low, high = F.least("z1", "z2", "z4", "z8"), F.greatest("z1", "z2", "z4", "z8")
    k0, k1 = F.ceil(low / interval).cast("int"), F.floor(high / interval).cast("int")
    cells = cells.withColumn("level", F.explode(F.when(k1 >= k0, F.transform(F.sequence(k0, k1), lambda k: k * F.lit(interval))).otherwise(F.array().cast("array<double>"))))
    case = sum((F.when(F.col(f"z{b}") > F.col("level"), b).otherwise(0) for b in (1, 2, 4, 8)), F.lit(0))
    table = F.create_map(*(x for c, s in CASES.items() for x in (F.lit(c), F.array(*map(F.lit, s.split())))))
    cells = cells.withColumn("case", case).where("case between 1 and 14").withColumn("seg", F.explode(F.element_at(table, F.col("case"))))
    cut = lambda a, b: (F.col("level") - F.col(a)) / (F.col(b) - F.col(a))

    def point(edge: Column) -> tuple[Column, Column]:
        x = F.when(edge == "t", F.col("col") + cut("z1", "z2")).when(edge == "b", F.col("col") + cut("z8", "z4")).when(edge == "r", F.col("col") + 1.0).otherwise(F.col("col").cast("double"))
        y = F.when(edge == "l", F.col("row") + cut("z1", "z8")).when(edge == "r", F.col("row") + cut("z2", "z4")).when(edge == "b", F.col("row") + 1.0).otherwise(F.col("row").cast("double"))
        return x, y

    (xa, ya), (xb, yb) = point(F.substring("seg", 1, 1)), point(F.substring("seg", 2, 1))
    side = lambda e: F.struct(e.isin("l", "r").alias("down"), (F.col("row") + (e == "b").cast("int")).cast("bigint").alias("row"), (F.col("col") + (e == "r").cast("int")).cast("bigint").alias("col"))
    e1, e2 = side(F.substring("seg", 1, 1)), side(F.substring("seg", 2, 1))
    return cells.select(*by, "level", "row", "col", "case", xa.alias("x1"), ya.alias("y1"), xb.alias("x2"), yb.alias("y2"), e1.alias("e1"), e2.alias("e2"))


def contour_lines(segments: DataFrame, scratch: Scratch, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """(by, level, line, segments, length, closed): segments joined where their rounded ends meet."""
    keys = [*(by or []), "level"]
    node = lambda x, y: F.xxhash64(*keys, F.round(x, digits), F.round(y, digits))
    rows = segments.withColumns({"a": node("x1", "y1"), "b": node("x2", "y2")})
    roots = components(rows.select("a", "b"), scratch)
    placed = rows.join(roots, rows.a == roots.node).withColumnRenamed("root", "line")
    ends = placed.select("line", F.explode(F.array("a", "b")).alias("n")).groupBy("line", "n").agg((F.count("*") % 2).alias("odd")).groupBy("line").agg((F.sum("odd") == 0).alias("closed"))
    return placed.groupBy(*keys, "line").agg(F.count("*").alias("segments"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length")).join(ends, "line")


def contour_paths(segments: DataFrame, scratch: Scratch, by: list[str] | None = None, least_points: int = 4, least_length: float = 2.0) -> DataFrame:
    """(by, level, line, seq, x, y, n, length, closed): level lines as vertices in their order, from ``contour_segments``.

    Each cell edge starts one segment of a level at most and ends one at most, so the edges form lists, which are ranked. The higher
    ground lies on a line's left. A closed line starts and ends at its smallest edge (those across before those down, then by row and column). Lines of fewer
    points or less length (in cells) are left out; ``line`` is a hash of the first edge.
    """
    keys = [*(by or []), "level"]
    edge = lambda e: F.struct(*keys, F.col(f"{e}.down"), F.col(f"{e}.row"), F.col(f"{e}.col"))
    rows = scratch.table(segments.select(*keys, edge("e1").alias("node"), edge("e2").alias("next"), "x1", "y1", "x2", "y2"))
    # the last edge of an open line starts no segment
    last = rows.select(F.col("next").alias("node")).join(rows.select("node"), "node", "left_anti").withColumn("next", F.lit(None).cast(rows.schema["next"].dataType))
    ranked = list_ranks(rows.select("node", "next").unionByName(last), scratch)
    placed = scratch.table(rows.join(ranked, "node").withColumn("line", F.xxhash64("list")).drop("list"))
    points = (F.col("n") + F.col("closed").cast("int")).alias("n")
    size = placed.groupBy("line").agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length"))
    size = size.where(F.col("length") >= least_length)
    starts = placed.where("seq = 0").select(*keys, "line", F.lit(0).cast("bigint").alias("seq"), F.col("x1").alias("x"), F.col("y1").alias("y"), points, "closed")
    ends = placed.select(*keys, "line", (F.col("seq") + 1).alias("seq"), F.col("x2").alias("x"), F.col("y2").alias("y"), points, "closed")
    return starts.unionByName(ends).where(F.col("n") >= least_points).join(size, "line").select(*keys, "line", "seq", "x", "y", "n", "length", "closed")


def range_kept(grid: DataFrame, marks: DataFrame, value: str, by: list[str], slack: float = 1e-6) -> DataFrame:
    """(by, kept): whether each map's grid stays within the range of the values that it was made from; null for a grid without values or cells."""
    own = grid.groupBy(*by).agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    given = marks.groupBy(*by).agg(F.min(value).alias("v0"), F.max(value).alias("v1"))
    return own.join(given, by, "left").select(*by, ((F.col("z0") >= F.col("v0") - slack) & (F.col("z1") <= F.col("v1") + slack)).alias("kept"))


def topology(vertices: DataFrame, size: float, by: list[str]) -> DataFrame:
    """(by, lines, levels, closed, crossing_pairs) of each map's level lines (by, level, line, seq, x, y, closed): pairs of lines of any levels that properly cross.

    Lines are unique over maps; segments meet in cells of the given size.
    """
    w = W.partitionBy("line").orderBy("seq")
    seg = vertices.select(*by, "line", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"), F.xxhash64("line", "seq").alias("_k")).where("x2 is not null")
    met = segment_crossings(seg, "_k", "line", size, by, ["line"]).select(*by, F.array_sort(F.array("first_line", "second_line")).alias("p")).distinct()
    crossing = met.groupBy(*by).agg(F.count("*").alias("crossing_pairs"))
    lines = vertices.where("seq = 0").groupBy(*by).agg(F.count("*").alias("lines"), F.count_distinct("level").alias("levels"), F.count_if("closed").alias("closed"))
    return lines.join(crossing, by, "left").withColumn("crossing_pairs", F.coalesce("crossing_pairs", F.lit(0).cast("bigint")))


def segment_crossings(segments: DataFrame, key: str, group: str, size: float, by: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Pairs (by, first, second, and first_ and second_ of the columns ``carry``) of one map (``by``) and different groups whose segments (x1, y1, x2, y2) properly cross; segments meet in the cells of their boxes.

    Keys are unique. A pair is given by the first cell that both boxes hold, so pairs are neither shuffled nor compared again; cells are dealt to tasks in any case.
    """
    span = lambda lo, hi: F.sequence(F.floor(F.least(lo, hi) / size), F.floor(F.greatest(lo, hi) / size))
    by = by or []
    carry = carry or []
    low = lambda c: F.floor(F.least(f"{c}1", f"{c}2") / size).alias(f"{c}0")
    rows = segments.select(*dict.fromkeys([*by, key, group, *carry]), "x1", "y1", "x2", "y2", low("x"), low("y"), F.explode(span(F.col("x1"), F.col("x2"))).alias("cx"), span(F.col("y1"), F.col("y2")).alias("ys")).withColumn("cy", F.explode("ys")).drop("ys")
    a, b = rows.alias("a"), rows.hint("merge").alias("b")
    side = lambda p, q, r: F.signum((F.col(f"{q}.x2") - F.col(f"{q}.x1")) * (F.col(f"{p}.y{r}") - F.col(f"{q}.y1")) - (F.col(f"{q}.y2") - F.col(f"{q}.y1")) * (F.col(f"{p}.x{r}") - F.col(f"{q}.x1")))
    crosses = (side("a", "b", 1) * side("a", "b", 2) < 0) & (side("b", "a", 1) * side("b", "a", 2) < 0)
    same = F.lit(True)
    for c in by:
        same &= F.col(f"a.{c}") == F.col(f"b.{c}")
    same &= (F.col("a.cx") == F.greatest("a.x0", "b.x0")) & (F.col("a.cy") == F.greatest("a.y0", "b.y0"))
    met = a.join(b, same & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & (F.col(f"a.{group}") != F.col(f"b.{group}")))
    return met.where(crosses).select(*(F.col(f"a.{c}").alias(c) for c in by), F.col(f"a.{key}").alias("first"), F.col(f"b.{key}").alias("second"), *(F.col(f"{side_}.{c}").alias(f"{name}_{c}") for c in carry for side_, name in (("a", "first"), ("b", "second"))))


def crossed(segments: DataFrame, others: DataFrame, key: str, group: str, size: float, by: list[str], weakness: str) -> DataFrame:
    """(key) of the segments that a stronger one of ``others`` of their map and of another group properly crosses: ``segment_crossings`` asked for one partner alone.

    ``weakness`` is an ordered column; less is stronger. The join ends at a row's first partner, so where segments lie close it doesn't grow with the pairs. Cells
    without a stronger one are left out beforehand.
    """
    at = [*by, "cx", "cy"]
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.least(lo, hi) / size), F.floor(F.greatest(lo, hi) / size)))
    cells = lambda df: df.select(*by, F.col(key).alias("k"), F.col(group).alias("g"), F.col(weakness).alias("w"), "x1", "y1", "x2", "y2", span(F.col("x1"), F.col("x2")).alias("cx")).withColumn("cy", span(F.col("y1"), F.col("y2")))
    rows, right = cells(segments), cells(others)
    # of each cell the strongest of a group, and of the other groups: whom neither beats, nobody there does
    tops = right.groupBy(*at, "g").agg(F.min("w").alias("top"))
    first = tops.groupBy(*at).agg(F.min(F.struct("top", "g")).alias("t")).select(*at, F.col("t.g").alias("tg"), F.col("t.top").alias("t1"))
    tops = tops.join(first, at).groupBy(*at, "tg", "t1").agg(F.min(F.when(F.col("g") != F.col("tg"), F.col("top"))).alias("t2"))
    rows = rows.join(tops, at).where(F.when(F.col("g") != F.col("tg"), F.col("t1")).otherwise(F.col("t2")) < F.col("w")).drop("tg", "t1", "t2")
    a, b = rows.alias("a"), right.hint("merge").alias("b")
    side = lambda p, q, r: F.signum((F.col(f"{q}.x2") - F.col(f"{q}.x1")) * (F.col(f"{p}.y{r}") - F.col(f"{q}.y1")) - (F.col(f"{q}.y2") - F.col(f"{q}.y1")) * (F.col(f"{p}.x{r}") - F.col(f"{q}.x1")))
    same = (F.col("a.g") != F.col("b.g")) & (F.col("b.w") < F.col("a.w")) & (side("a", "b", 1) * side("a", "b", 2) < 0) & (side("b", "a", 1) * side("b", "a", 2) < 0)
    for c in at:
        same &= F.col(f"a.{c}") == F.col(f"b.{c}")
    return a.join(b, same, "left_semi").select(F.col("a.k").alias(key)).distinct()


def cps3_lines(grid: DataFrame, order: str = "n", by: list[str] | None = None) -> DataFrame:
    """(by, n, line): body of each map's CPS-3 grid: column by column, rows from the top, five values a line, blanks as 1E30.

    Cells are ranked within their column and shifted by the cells of the columns before, so a window spans one column, or the
    column counts of a map.
    """
    by = by or []
    before = grid.groupBy(*by, "col").agg(F.count("*").alias("_n"))
    before = before.select(*by, "col", (F.sum("_n").over(W.partitionBy(*by).orderBy("col")) - F.col("_n")).alias("_before"))
    own = grid.select(*by, "row", "col", "z", F.row_number().over(W.partitionBy(*by, "col").orderBy(F.desc("row"))).alias("_k"))
    ranked = own.join(before, [*by, "col"]).withColumn("k", F.col("_k") + F.col("_before"))
    value = F.format_string("%.8E", F.coalesce("z", F.lit(1e30)))
    rows = ranked.select(*by, F.expr("(k - 1) div 5").alias(order), "k", value.alias("v"))
    return rows.groupBy(*by, order).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x.v), " ").alias("line"))


def cps3_header(grid: DataFrame, x: str = "x", y: str = "y", by: list[str] | None = None) -> DataFrame:
    """One row of header lines per map (``by``) from the grid's limits."""
    by = by or []
    s = grid.groupBy(*by).agg(*(f(c).alias(f"{n}{c}") for c in (x, y, "z") for n, f in (("lo_", F.min), ("hi_", F.max))), F.count_distinct("row").alias("rows"), F.count_distinct("col").alias("cols"))
    d = lambda c, n: (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / F.greatest(F.col(n) - 1, F.lit(1))
    limits = F.format_string("FSLIMI %.6f %.6f %.6f %.6f %.6f %.6f", *(F.col(f"{n}{c}").cast("double") for c in (x, y, "z") for n in ("lo_", "hi_")))
    return s.select(*by, F.array(F.lit("FSASCI 0 1 COMPUTED 0 1E30 0"), F.lit("FSATTR 0 0"), limits, F.format_string("FSNROW %d %d", "rows", "cols"), F.format_string("FSXINC %.6f %.6f", d(x, "cols"), d(y, "rows"))).alias("lines"))


def xyz_lines(grid: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, row, col, line): filled cells with three decimals."""
    return grid.where("z is not null").select(*(by or []), "row", "col", F.format_string("%.3f %.3f %.3f", F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double")).alias("line"))


def local_exports(grid: DataFrame, by: str) -> DataFrame:
    """(by, file, n, line): the lines of each map's exchange files in pixel coordinates, in the order of n: cps3, xyz and json (one line that describes the map).

    A map that isn't georeferenced says so; all its cells count, filled or not.
    """
    head = cps3_header(grid, by=[by]).select(by, F.posexplode("lines").alias("n", "line"))
    body = cps3_lines(grid, by=[by]).select(by, (F.col("n") + 5).alias("n"), "line")
    xyz = xyz_lines(grid, [by]).select(by, F.lit("xyz").alias("file"), (F.col("row").cast("bigint") * (1 << 31) + F.col("col")).alias("n"), "line")
    about = F.to_json(F.struct(F.lit("local_pixel_coordinates").alias("coordinate_system"), F.lit(False).alias("georeferenced"), F.lit("interpolation_between_traced_contours").alias("grid_role"), "cells", "filled"))
    meta = grid.groupBy(by).agg(F.count("*").alias("cells"), F.count("z").alias("filled")).select(by, F.lit("json").alias("file"), F.lit(0).cast("bigint").alias("n"), about.alias("line"))
    cps3 = head.select(by, F.lit("cps3").alias("file"), F.col("n").cast("bigint").alias("n"), "line").unionByName(body.select(by, F.lit("cps3").alias("file"), F.col("n").cast("bigint").alias("n"), "line"))
    return cps3.unionByName(xyz).unionByName(meta)
