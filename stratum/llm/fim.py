"""Fill-in-the-middle transformation of texts, undone exactly.

A pandas UDF over Arrow batches cuts each text into units by one pass of the pattern; only the units' end offsets are kept, in a
compact array, and two of them slice the text. All choices come from a digest of the document's key, so they are the same on
every run and cluster.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, read

#: A unit is a word with the white space before it, or white space at the end; marks of the three parts.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OUT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def ends(text: str, find) -> array:
    """End offsets of the units in code points, four bytes each."""
    return array("I", (m.end() for m in find(text)))


def draws(seed: int, key: str) -> list[int]:
    """Four numbers below 2^32 from the digest of seed and key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def parts(text: str, cuts: array, h1: int, h2: int) -> tuple[str, str, str]:
    """Prefix, middle and suffix; both cuts lie after 0 to n units."""
    n = len(cuts)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (cuts[lo - 1] if lo else 0), (cuts[hi - 1] if hi else 0)
    return text[:a], text[a:b], text[b:]


def transform_column(key: Column, text: Column, seed: int = 42, rate: int = 50, spm: int = 80) -> Column:
    """struct<n, form, prefix_chars, middle_chars, output, output_sha256> of a text; see ``transform``."""

    @F.pandas_udf(OUT)
    def run(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        find, rows = regex.compile(UNIT).finditer, []
        for k, t in zip(keys, texts):
            t, form, sizes = t or "", "plain", (None, None)
            cuts = ends(t, find)
            h1, h2, h3, h4 = draws(seed, k or "")
            out = t
            if t and h3 % 100 < rate and not any(m in t for m in (PREFIX, SUFFIX, MIDDLE)):
                p, m, s = parts(t, cuts, h1, h2)
                form, sizes = ("spm" if h4 % 100 < spm else "psm"), (len(p), len(m))
                out = f"{SUFFIX}{s}{PREFIX}{p}{MIDDLE}{m}" if form == "spm" else f"{PREFIX}{p}{SUFFIX}{s}{MIDDLE}{m}"
            rows.append((len(cuts), form, *sizes, out, hashlib.sha256(out.encode()).hexdigest()))
        frame = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
        return frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return run(key.cast("string"), text.cast("string"))


def restore(output: Column, form: Column) -> Column:
    """The exact text from an output and its form. Texts that hold a mark themselves are plain, so the marks part the others unambiguously."""
    p = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(p[1], p[3], p[2])).when(form == "spm", F.concat(p[2], p[3], p[1])).otherwise(output)


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars, output and output_sha256.

    ``rate`` percent of the texts are cut at two of their unit bounds into prefix, middle and suffix; ``spm`` percent of those put
    the suffix first, the others the prefix. Null texts count as empty; empty texts and those that hold a mark stay plain, with null
    sizes. A null key draws like an empty one; rows of one key and text give equal rows. A caller's column of a result's name is
    replaced; all others are kept. An empty table gives an empty one. One pass without a shuffle; a worker holds an Arrow
    batch (64 MB by Spark's default, one row at least) and four bytes for each unit of one text.
    """
    made = free("_fim", docs.columns)
    names = ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    low = {x.lower() for x in names}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in low]
    out = docs.withColumn(made, transform_column(F.col(key), F.col(text), seed, rate, spm))
    return out.select(*kept, *(F.col(f"{made}.{x}") for x in names))


def op11_fim(spark, sf_dir: str) -> DataFrame:
    out = transform(read(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", restored.alias("restored_sha256"))
