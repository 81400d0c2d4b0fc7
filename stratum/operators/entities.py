"""Entities: merging by stable id, alias candidates, issue lists."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T


def merge(items: DataFrame, kind: Column, name: Column, order: str, evidence: Column, attributes: Column) -> DataFrame:
    """One row per stable id: the first item's name and attributes, sorted evidence, later attributes as observations."""
    rows = items.select(T.entity_id(kind, name).alias("entity_id"), kind.alias("entity_type"), name.alias("name"), F.col(order).alias("o"), evidence.alias("e"), attributes.alias("a"))
    first = F.min_by(F.struct("entity_type", "name", "a"), "o")
    seen = F.array_sort(F.collect_list(F.struct("o", "a")))
    out = rows.groupBy("entity_id").agg(first.alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("e")))).alias("evidence"), seen.alias("s"))
    later = F.transform(F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), lambda x: x.a)
    return out.select("entity_id", "f.entity_type", "f.name", F.col("f.a").alias("attributes"), "evidence", later.alias("observations"), F.when(F.size("evidence") > 0, "extracted").otherwise("review").alias("status"))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks (Ratcliff-Obershelp)."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def alias_candidates(names: DataFrame, key: str, name: str, kind: str, low: float = 0.78, least: int = 5) -> DataFrame:
    """Pairs (first, second, ratio) of one kind whose canonical names are alike but not equal.

    Names meet by length and by a shared bigram: a ratio of ``low`` leaves no pair without one, and bounds the lengths, so
    nothing is lost against comparing all pairs. Each name is paired with the later ones by key.
    """
    rows = names.select(F.col(key).alias("k"), F.col(kind).alias("kind"), T.canonical_name(name).alias("n")).withColumn("len", F.char_length("n"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.col("len") - 1, F.lit(1))), lambda i: F.substring(F.col("n"), i, F.lit(2))))
    grams = rows.withColumn("g", F.explode(grams))
    a, b = grams.alias("a"), grams.alias("b")
    bound = 2 * F.least("a.len", "b.len") / (F.col("a.len") + F.col("b.len")) >= low
    met = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.k") < F.col("b.k")) & (F.col("a.len") >= least) & bound)
    pairs = met.select(F.col("a.k").alias("first"), F.col("b.k").alias("second"), F.col("a.n").alias("x"), F.col("b.n").alias("y")).distinct()
    return pairs.withColumn("ratio", ratio("x", "y")).where((F.col("ratio") >= low) & (F.col("ratio") < 1)).select("first", "second", "ratio")


def issues(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(code, entity_ids): entities without evidence, and pairs that may be one."""
    bare = entities.where(F.size("evidence") == 0).select(F.lit("missing_evidence").alias("code"), F.array("entity_id").alias("entity_ids"))
    return bare.unionByName(aliases.select(F.lit("possible_alias").alias("code"), F.array("first", "second").alias("entity_ids")))
