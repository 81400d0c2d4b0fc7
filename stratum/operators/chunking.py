"""Lines, parts under a character budget, and provenance markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Lines whose part numbers are gathered at once.
STRIDE = 256


def lines(text: Column | str) -> Column:
    """Trimmed non-empty lines without page markers."""
    raw = F.split(F.replace(T.lit_col(text), F.lit("\r"), F.lit("")), "\n")
    bare = lambda s: F.when(s.contains("[SOURCE_PAGE"), F.regexp_replace(s, T.MARKER, "")).otherwise(s)
    return F.filter(F.transform(raw, lambda s: F.trim(bare(s))), lambda s: s != "")


def without_repeats(items: Column) -> Column:
    """An array without elements equal to the one before. The array is bound by a lambda, so it is computed once, not for each element."""
    kept = lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))
    return F.get(F.transform(F.array(items), kept), F.lit(0))


def clean(text: Column | str, limit: int = 2200) -> Column:
    """Lines without markers and direct repeats, joined and truncated."""
    return T.truncate(F.array_join(without_repeats(lines(text)), "\n"), limit)


def part_numbers(items: Column, budget: int) -> Column:
    """For each line the number of its part, from 1: a part ends before the line that would take it over the budget.

    A line counts its length and one; a line longer than the budget is a part of its own.
    """
    none, lists = F.array().cast("array<int>"), F.array().cast("array<array<int>>")
    state = lambda part, used, out, done: F.struct(part.alias("part"), used.alias("used"), out.alias("out"), done.alias("done"))

    def step(acc: Column, s: Column) -> Column:
        n = F.char_length(s) + 1
        new = (acc.part == 0) | (acc.used + n > budget)
        part = F.when(new, acc.part + 1).otherwise(acc.part)
        return state(part, F.when(new, n).otherwise(acc.used + n), F.array_append(acc.out, part), acc.done)

    def run(acc: Column, some: Column) -> Column:
        return F.aggregate(some, state(acc.part, acc.used, none, acc.done), step, lambda x: state(x.part, x.used, none, F.array_append(x.done, x.out)))

    def numbers(a: Column) -> Column:
        # appending copies an array, so numbers are gathered by blocks of lines
        some = F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(STRIDE)), lambda i: F.slice(a, i + 1, STRIDE))
        return F.flatten(F.aggregate(some, state(F.lit(0), F.lit(0), none, lists), run, lambda x: x.done))

    return F.get(F.transform(F.array(items), numbers), F.lit(0))


def parts(rows: DataFrame, items: str, budget: int, keys: list[str]) -> DataFrame:
    """(keys, part, n_lines, content): the parts of each row's lines."""
    zipped = rows.select(*keys, F.posexplode(F.arrays_zip(F.col(items).alias("line"), part_numbers(F.col(items), budget).alias("part"))).alias("i", "x"))
    grouped = zipped.select(*keys, "i", "x.line", "x.part").groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    return grouped.select(*keys, "part", F.size("l").alias("n_lines"), F.array_join(F.transform("l", lambda x: x.line), "\n").alias("content"))


def provenance(pages: DataFrame, page: str, path: str, texts: str, budget: int = 6000) -> DataFrame:
    """(page, part, section): marked lines of each page under a heading that names the part when there are several."""
    fixed = F.transform(F.filter(texts, lambda s: F.trim(s) != ""), lambda s: T.numeric_ocr(F.trim(s)))
    marked = pages.select(page, F.transform(fixed, lambda s: F.concat(T.marker(page, path), F.lit(" "), s)).alias("l")).where(F.size("l") > 0)
    out = parts(marked.withColumn("n", F.size("l")), "l", budget, [page, "n"])
    heading = F.concat(F.lit("## "), F.col(page), F.when(F.col("n") > F.col("n_lines"), F.concat(F.lit(" part:"), F.col("part").cast("string"))).otherwise(F.lit("")))
    return out.select(page, "part", F.concat(heading, F.lit("\n\n"), "content", F.lit("\n")).alias("section"))


def blocks(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, block, content): a text cut before each page heading."""
    return docs.select(*keys, F.posexplode(F.split(text, r"(?m)(?=^## page:)")).alias("block", "content")).where("content <> ''")
