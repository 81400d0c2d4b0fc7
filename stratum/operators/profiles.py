"""Survey profiles on maps: straight segments of pixels by a Hough accumulator, their mask, and the transform that lays labelled lines on an inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from .graph import Scratch

#: Angle in degrees that some lines of a triple must differ by, limits of the scale, and the error that an inlier may have.
LEAST_TURN, SCALES, LEAST_ERROR, ERROR_PER_SCALE = 25.0, (2.0, 40.0), 300.0, 25.0


def pixel_limits(height: Column, width: Column) -> dict[str, Column]:
    """Limits in pixels that grow with a map's resolution: scale, component and dash spans, segment votes, length, gap and width, border, line and path lengths."""
    scale = F.greatest(F.lit(0.5), F.least(height, width) / 8000.0)
    grown = lambda least, per: F.greatest(F.lit(least), F.rint(scale * per).cast("int"))
    return {
        "scale": scale, "component_span": grown(55, 110), "dash_least": F.greatest(F.lit(7.0), scale * 14), "dash_most": scale * 150, "dash_area": F.greatest(F.lit(6.0), scale * 12),
        "votes": grown(150, 300), "length": grown(250, 500), "gap": grown(6, 12), "width": grown(3, 9), "border": grown(30, 60), "line_span": grown(50, 100), "path_points": grown(75, 150),
    }


def _turned(k: Column, steps: int) -> tuple[Column, Column]:
    t = k * F.lit(180.0 / steps)
    return F.cos(F.radians(t)), F.sin(F.radians(t))


def hough_peaks(pixels: DataFrame, by: str, votes: int, steps: int = 360) -> DataFrame:
    """(by, k, rho, votes): lines x cos t + y sin t = rho at t = k * 180 / steps degrees, rho rounded to pixels, with at least as many pixels.

    pixels: (by, row, col), each once; x is col and y is row. A pixel votes once at each angle, and votes combine before the shuffle. A
    line is kept when none of the eight beside it has more votes, or as many and a smaller (k, rho); past the last angle the sign of rho turns.
    """
    at = pixels.select(by, "row", "col", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k"))
    c, s = _turned(F.col("k"), steps)
    cells = at.groupBy(by, "k", F.floor(F.col("col") * c + F.col("row") * s + 0.5).alias("rho")).agg(F.count("*").alias("votes")).where(F.col("votes") >= votes)
    rank = F.struct(F.negate("votes").alias("v"), "k", "rho")
    beside = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    moved = cells.select(by, rank.alias("r"), beside.alias("m")).select(by, "r", (F.col("r.k") + F.col("m.i")).alias("_k"), (F.col("r.rho") + F.col("m.j")).alias("_rho"))
    over = (F.col("_k") < 0) | (F.col("_k") >= steps)
    moved = moved.select(by, "r", F.pmod("_k", F.lit(steps)).alias("k"), F.when(over, -F.col("_rho")).otherwise(F.col("_rho")).alias("rho"))
    best = moved.groupBy(by, "k", "rho").agg(F.min("r").alias("r"))
    return cells.join(best, [by, "k", "rho"]).where((F.col("r.k") == F.col("k")) & (F.col("r.rho") == F.col("rho"))).select(by, "k", "rho", "votes")


def hough_segments(pixels: DataFrame, by: str, votes: int, length: float, gap: float, scratch: Scratch, steps: int = 360) -> DataFrame:
    """(by, k, rho, run, pixels, x1, y1, x2, y2): runs of a peak's pixels without a gap over ``gap`` and of at least ``length``, ends on the line.

    Only the angles of a map's peaks are looked up again, by an equi-join on angle and rho; a window spans one line's pixels.
    """
    pixels = pixels.select(by, "row", "col").distinct()
    peaks = scratch.table(hough_peaks(pixels, by, votes, steps))
    c, s = _turned(F.col("k"), steps)
    rho = F.floor(F.col("col") * c + F.col("row") * s + 0.5)
    met = pixels.join(peaks.select(by, "k").distinct(), by).withColumn("rho", rho).join(peaks.select(by, "k", "rho"), [by, "k", "rho"])
    w = W.partitionBy(by, "k", "rho").orderBy("t", "row", "col")
    met = met.withColumn("t", F.col("row") * c - F.col("col") * s)
    met = met.withColumn("_new", F.coalesce((F.col("t") - F.lag("t").over(w) > gap).cast("int"), F.lit(0)))
    runs = met.withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(by, "k", "rho", "run").agg(F.count("*").alias("pixels"), F.min("t").alias("a"), F.max("t").alias("b"))
    x, y = (lambda t: F.col("rho") * c - F.col(t) * s), (lambda t: F.col("rho") * s + F.col(t) * c)
    return runs.where(F.col("b") - F.col("a") >= length).select(by, "k", "rho", "run", "pixels", x("a").alias("x1"), y("a").alias("y1"), x("b").alias("x2"), y("b").alias("y2"))


def on_segments(pixels: DataFrame, segments: DataFrame, by: str, reach: float) -> DataFrame:
    """(by, row, col) of the pixels within ``reach`` of a segment (by, x1, y1, x2, y2); they meet in the cells about points along it."""
    side = max(2 * reach, 8.0)
    n = F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / side).cast("int")
    rows = segments.select(by, "x1", "y1", "x2", "y2", F.greatest(n, F.lit(1)).alias("n"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i"))
    at = lambda c: F.floor((F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * F.col("i") / F.col("n")) / side)
    about = F.explode(F.array(*(F.struct((at("x") + i).alias("cx"), (at("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    cells = rows.select(by, "x1", "y1", "x2", "y2", about.alias("c")).select(by, "x1", "y1", "x2", "y2", "c.cx", "c.cy").distinct()
    own = pixels.select(by, "row", "col", F.floor(F.col("col") / side).alias("cx"), F.floor(F.col("row") / side).alias("cy"))
    met = own.join(cells, [by, "cx", "cy"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    u, v, whole = F.col("col") - F.col("x1"), F.col("row") - F.col("y1"), F.greatest(dx * dx + dy * dy, F.lit(1e-12))
    along = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (u * dx + v * dy) / whole))
    return met.where(F.hypot(u - along * dx, v - along * dy) <= reach + 1e-9).select(by, "row", "col").distinct()


def without_profiles(pixels: DataFrame, segments: DataFrame, by: str, width: float) -> DataFrame:
    """Pixels that don't lie on a segment drawn with the given width."""
    return pixels.join(on_segments(pixels, segments, by, width / 2), [by, "row", "col"], "left_anti")


#: Additive sums of a match, from which any set of matches is fitted.
SUMS = ["n", "xx", "xy", "yy", "xa", "xb", "ya", "yb", "aa", "ab", "bb", "xt", "yt", "ta", "tb", "tt", "s2", "c2"]


def match_sums(matches: DataFrame, by: str, match: str, samples: int = 7) -> DataFrame:
    """(by, match, angle, sums) of matches (by, match, x1, y1, x2, y2, u, v, nx, ny): a line on the map, and a point and the unit normal of its line in the inventory.

    A mirrored rotation by t carries a sample (x, y) of the map's line, seen along the normal, to a cos t + b sin t with a = nx x - ny y
    and b = nx y + ny x. The sums over all samples hold all that fits and errors need.
    """
    i = F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    rows = matches.select(by, match, "x1", "y1", "x2", "y2", "nx", "ny", (F.col("nx") * F.col("u") + F.col("ny") * F.col("v")).alias("t"), i.alias("i"))
    at = lambda c: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * F.col("i") / (samples - 1)
    rows = rows.withColumns({"a": F.col("nx") * at("x") - F.col("ny") * at("y"), "b": F.col("nx") * at("y") + F.col("ny") * at("x")})
    angle = F.pmod(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))), F.lit(180.0))
    hint = F.radians(angle + F.pmod(F.degrees(F.atan2("ny", "nx")) + 90, F.lit(180.0))) * 2
    product = {"x": "nx", "y": "ny", "a": "a", "b": "b", "t": "t"}
    sums = [F.sum(F.col(product[c[0]]) * F.col(product[c[1]])).alias(c) for c in SUMS[1:16]]
    return rows.groupBy(by, match).agg(F.count("*").cast("double").alias("n"), *sums, F.first(F.sin(hint)).alias("s2"), F.first(F.cos(hint)).alias("c2"), F.first(angle).alias("angle"))


def solve_sums(rows: DataFrame) -> DataFrame:
    """``rows`` of sums with scale, turn (radians), dx and dy of the least squares transform; null where the lines don't fix one.

    The turn is the mean of the matches' hints, doubled as directions of lines are; scale and shift solve three normal equations. A negative scale is
    a turn by half a circle more.
    """
    c = F.col
    out = rows.withColumn("_t", F.atan2("s2", "c2") / 2)
    out = out.withColumns({"_c": F.cos("_t"), "_s": F.sin("_t")})
    out = out.withColumns({"_xg": c("_c") * c("xa") + c("_s") * c("xb"), "_yg": c("_c") * c("ya") + c("_s") * c("yb"), "_tg": c("_c") * c("ta") + c("_s") * c("tb"), "_gg": c("_c") * c("_c") * c("aa") + 2 * c("_c") * c("_s") * c("ab") + c("_s") * c("_s") * c("bb")})
    det = lambda m: m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    m, rhs = [c(x) for x in ("xx", "xy", "_xg", "xy", "yy", "_yg", "_xg", "_yg", "_gg")], [c("xt"), c("yt"), c("_tg")]
    put = lambda j: det([rhs[i // 3] if i % 3 == j else m[i] for i in range(9)])
    out = out.withColumn("_d", det(m))
    safe = F.when(F.abs("_d") > 1e-9 * c("xx") * c("yy") * c("_gg"), c("_d"))
    scale = put(2) / safe
    out = out.withColumns({"dx": put(0) / safe, "dy": put(1) / safe, "_scale": scale})
    turn = F.when(c("_scale") < 0, F.pmod(c("_t") + F.lit(3.141592653589793), F.lit(6.283185307179586))).otherwise(c("_t"))
    out = out.withColumns({"scale": F.least(F.greatest(F.abs("_scale"), F.lit(SCALES[0])), F.lit(SCALES[1])), "turn": F.when(c("_scale").isNotNull(), turn)})
    return out.select(*rows.columns, "scale", "turn", "dx", "dy")


def squares(fit: str, match: str) -> Column:
    """Sum of a match's squared errors under a fit, from its sums."""
    f, m = (lambda x: F.col(f"{fit}.{x}")), (lambda x: F.col(f"{match}.{x}"))
    c, s = F.cos(f("turn")), F.sin(f("turn"))
    g = lambda x: c * m(f"{x}a") + s * m(f"{x}b")
    gg = c * c * m("aa") + 2 * c * s * m("ab") + s * s * m("bb")
    fixed = f("dx") * f("dx") * m("xx") + 2 * f("dx") * f("dy") * m("xy") + f("dy") * f("dy") * m("yy") - 2 * (f("dx") * m("xt") + f("dy") * m("yt")) + m("tt")
    return F.greatest(f("scale") * f("scale") * gg + 2 * f("scale") * (f("dx") * g("x") + f("dy") * g("y") - (c * m("ta") + s * m("tb"))) + fixed, F.lit(0.0))


def robust_transform(matches: DataFrame, by: str, match: str, scratch: Scratch) -> DataFrame:
    """(by, scale, turn, dx, dy, inliers, matches, rms): each map's transform by the consensus of all triples of matches.

    Every three matches whose lines differ enough in direction are fitted; the fit with most inliers wins, then the one with the smaller median
    error of those, then the first triple. It is fitted again on its inliers, if there are three. Maps without such a triple are fitted on all
    matches, and inliers is null. Triples and tests grow with the fourth power of a map's matches, which are label readings; maps are side by side.
    """
    own = scratch.table(match_sums(matches, by, match))
    part = lambda name: own.select(by, *(F.col(x).alias(f"{x}{name}") for x in (match, "angle", *SUMS)))
    three = part(1).join(part(2), by).where(F.col(f"{match}1") < F.col(f"{match}2")).join(part(3), by).where(F.col(f"{match}2") < F.col(f"{match}3"))
    turn = F.greatest(*(G.angle_between(F.col(f"angle{i}"), F.col(f"angle{j}")) for i, j in ((1, 2), (1, 3), (2, 3))))
    three = three.where(turn >= LEAST_TURN).select(by, F.array(*(f"{match}{i}" for i in (1, 2, 3))).alias("triple"), *((F.col(f"{x}1") + F.col(f"{x}2") + F.col(f"{x}3")).alias(x) for x in SUMS))
    fits = solve_sums(three).where("scale is not null").select(by, "triple", "scale", "turn", "dx", "dy")
    error = F.sqrt(squares("f", "m") / F.col("m.n"))
    met = fits.alias("f").join(own.alias("m"), by).select(by, "f.triple", "f.scale", F.col(f"m.{match}").alias("_m"), error.alias("e"))
    met = met.where(F.col("e") <= F.greatest(F.lit(LEAST_ERROR), F.col("scale") * ERROR_PER_SCALE))
    ranked = met.groupBy(by, "triple").agg(F.count("*").alias("n"), F.percentile("e", F.lit(0.5)).alias("median"), F.collect_list("_m").alias("inliers"))
    best = scratch.table(ranked.groupBy(by).agg(F.min(F.struct(F.negate("n").alias("n"), "median", "triple", "inliers")).alias("b")).select(by, "b.triple", "b.inliers"))
    first = fits.join(best, [by, "triple"]).select(by, "scale", "turn", "dx", "dy", "inliers")
    total = lambda rows: rows.groupBy(by).agg(*(F.sum(x).alias(x) for x in SUMS))
    again = solve_sums(total(own.join(best.where(F.size("inliers") >= 3).select(by, F.explode("inliers").alias(match)), [by, match])))
    rest = solve_sums(total(own.join(best, by, "left_anti")))
    pick = lambda df, inliers: df.select(by, "scale", "turn", "dx", "dy", inliers.alias("inliers"))
    few = first.where(F.size("inliers") < 3).select(by, "scale", "turn", "dx", "dy", F.lit(None).cast(best.schema["inliers"].dataType).alias("_over"), F.size("inliers").alias("inliers"))
    more = again.join(best, by).select(by, "scale", "turn", "dx", "dy", F.col("inliers").alias("_over"), F.size("inliers").alias("inliers"))
    none = pick(rest, F.lit(None).cast("int")).withColumn("_over", F.lit(None).cast(best.schema["inliers"].dataType))
    chosen = few.unionByName(more).unionByName(none)
    met = chosen.alias("f").join(own.alias("m"), by).where(F.col("f._over").isNull() | F.array_contains(F.col("f._over"), F.col(f"m.{match}")))
    rms = met.groupBy(by).agg(F.sqrt(F.sum(squares("f", "m")) / F.sum("m.n")).alias("rms"))
    sizes = own.groupBy(by).agg(F.count("*").alias("matches"))
    return chosen.drop("_over").join(sizes, by).join(rms, by).select(by, "scale", "turn", "dx", "dy", "inliers", "matches", "rms")
