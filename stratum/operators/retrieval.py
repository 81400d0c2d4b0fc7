"""Keyword and hybrid retrieval, saved answers, and the quality of answers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from .graph import Scratch


def keyword_topk(docs: DataFrame, key: str, text: str, words: list[str], k: int = 8) -> DataFrame:
    """Rows with the most keyword occurrences, ties by key: (key, score, rank)."""
    scored = docs.select(key, T.keyword_score(text, words).cast("bigint").alias("score")).where("score > 0")
    top = scored.orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)))


#: Fixed value: two similarities that differ by more when they are multiplied in blocks differ after rounding, too.
SLACK = 2e-6


def _candidates(items: DataFrame, queries: DataFrame, key: str, k: int) -> DataFrame:
    """(query, key, near) of all pairs that may be among a query's k best: items (key, v) meet the broadcast queries (query, qv) as matrices.

    A task leaves out a pair only if k others of its own and the query itself are nearer by the slack. Vectors that can't be multiplied (null, of
    another length, not finite, without length) go with all the others, near being null.
    """
    held = items.sparkSession.sparkContext.broadcast(queries.toArrow())
    kinds = dict(queries.dtypes)["query"], dict(items.dtypes)[key]

    def units(column) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Places and unit vectors by length, and the places of the rest."""
        places: dict[int, list[int]] = {}
        rows = [np.array([] if v is None or None in v else v, float) for v in column.to_pylist()]
        for n, v in enumerate(rows):
            usable = len(v) and np.isfinite(v).all() and 1e-100 < np.abs(v).max() < 1e100
            places.setdefault(len(v) if usable else 0, []).append(n)
        rest = np.array(places.pop(0, []), int)
        stacked = {d: np.array([rows[n] for n in at]) for d, at in places.items()}
        return {d: (np.array(places[d]), m / np.linalg.norm(m, axis=1, keepdims=True)) for d, m in stacked.items()}, rest

    def run(batches):
        asked, own = held.value.combine_chunks(), None
        names = asked["query"].combine_chunks()
        sides, odd = units(asked["qv"])
        best = {d: np.full((len(at), k + 1), -np.inf) for d, (at, _) in sides.items()}

        def pairs(q, n, near=None):
            near = pa.nulls(len(q), pa.float64()) if near is None else pa.array(near)
            return pa.RecordBatch.from_arrays([names.take(pa.array(q)), own.take(pa.array(n)), near], names=["query", key, "near"])

        for batch in batches:
            own = batch.column(0)
            parts, rest = units(batch.column(1))
            for d, (at, m) in parts.items():
                for s, (asks, v) in sides.items():
                    if s != d:
                        yield pairs(np.repeat(asks, len(at)), np.tile(at, len(asks)))
                        continue
                    near = v @ m.T
                    top = np.partition(near, -(k + 1), axis=1)[:, -(k + 1) :] if near.shape[1] > k + 1 else near
                    best[d] = np.sort(np.concatenate([best[d], top], axis=1), axis=1)[:, -(k + 1) :]
                    q, n = np.nonzero(near >= best[d][:, :1] - SLACK)
                    yield pairs(asks[q], at[n], near[q, n])
                yield pairs(np.repeat(odd, len(at)), np.tile(at, len(odd)))
            yield pairs(np.tile(np.arange(len(names)), len(rest)), np.repeat(rest, len(names)))

    return items.select(key, "v").mapInArrow(run, f"query {kinds[0]}, `{key}` {kinds[1]}, near double")


def vector_topk(items: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, blocks: int = 8, max_broadcast: int = 20_000) -> DataFrame:
    """(query, key, similarity, rank): each query's k most similar items by cosine, ties by key; the query itself is left out.

    A stated query set that fits is broadcast whole and met by matrices of items, which leave few candidates for the exact score; of equal vectors those
    with the smallest keys alone can be among them. A larger set meets all items in blocks. Norms are taken once per row; within each block and
    partition only k rows per query survive before they are shuffled (the rank filter is pushed below the exchange).
    """
    unit = lambda df, name: df.select(F.col(key).alias(name), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    q = unit(queries, "query").withColumnRenamed("v", "qv")
    i = unit(items, key)
    norm = lambda c: F.sqrt(G.dot(c, c))
    if queries.count() <= max_broadcast:
        i = i.withColumn("_r", F.row_number().over(W.partitionBy("v").orderBy(key))).where(F.col("_r") <= k + 1).drop("_r")
        scratch = Scratch(items.sparkSession, "vectors")
        near = scratch.table(_candidates(i, q, key, k).where(F.col("query") != F.col(key)))
        best = near.where("near is not null").withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("near")))).where(F.col("_r") == k)
        near = near.join(best.select("query", F.col("near").alias("_least")), "query", "left").where(F.col("near").isNull() | F.col("_least").isNull() | (F.col("near") >= F.col("_least") - SLACK))
        met = near.select("query", key).join(i, key).join(q, "query").withColumns({"n": norm("v"), "qn": norm("qv")})
    else:
        q = q.withColumns({"qn": norm("qv"), "block": F.pmod(F.xxhash64("query"), F.lit(blocks))})
        i = i.withColumn("n", norm("v")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        met = i.join(q, "block").where(F.col("query") != F.col(key))
    scored = met.select("query", key, F.round(G.dot("v", "qv") / (F.col("n") * F.col("qn")), 6).alias("similarity"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), key))).where(F.col("rank") <= k)


def hybrid(chunks: DataFrame, questions: DataFrame, question: str, tokens: str, vector: str, key: str, k: int = 8, top: int = 64, threshold: float = 0.1, vector_weight: float = 0.3, document: str | None = None, documents: str | None = None) -> DataFrame:
    """(question, key, similarity, rank): token overlap and cosine, weighted; candidates share a token with the question.

    The share of the question's distinct tokens is an equi-join on tokens. Of the best ``top`` by that share, those over
    the threshold are ranked by the weighted sum. ``documents`` names an array column of the questions: only chunks whose
    ``document`` is in it count; an empty or null one searches all.
    """
    scope, own = ([F.col(documents).alias("_scope")], [F.col(document).alias("_doc")]) if documents else ([], [])
    q = questions.select(question, *scope, F.explode(F.array_distinct(F.col(tokens))).alias("t"), F.size(F.array_distinct(F.col(tokens))).alias("n"))
    c = chunks.select(key, *own, F.explode(F.array_distinct(F.col(tokens))).alias("t"))
    met = q.join(c, "t")
    if documents:
        met = met.where((F.coalesce(F.size("_scope"), F.lit(0)) <= 0) | F.array_contains("_scope", F.col("_doc")))
    shared = met.groupBy(question, key).agg((F.count("*") / F.max("n")).alias("words"))
    pre = shared.withColumn("r", F.row_number().over(W.partitionBy(question).orderBy(F.desc("words"), key))).where(F.col("r") <= top)
    both = pre.join(questions.select(question, F.col(vector).alias("qv")), question).join(chunks.select(key, F.col(vector).alias("cv")), key)
    score = F.round(vector_weight * G.cosine("qv", "cv") + (1 - vector_weight) * F.col("words"), 4)
    out = both.select(question, key, score.alias("similarity")).where(F.col("similarity") >= threshold)
    return out.withColumn("rank", F.row_number().over(W.partitionBy(question).orderBy(F.desc("similarity"), key))).where(F.col("rank") <= k)


def dedup_chunks(chunks: DataFrame, ident: Column, order: str) -> DataFrame:
    """One row per identity: the last one's columns at the first one's place."""
    cols = [c for c in chunks.columns if c != order]
    rows = chunks.withColumn("_id", ident)
    out = rows.groupBy("_id").agg(F.max_by(F.struct(*cols), order).alias("x"), F.min(order).alias(order))
    return out.select("x.*", order)


def saved_answers(questions: DataFrame, saved: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Questions with the saved answer of the same text, blanks at the ends and case aside; the first by answer when several."""
    norm = F.lower(F.trim(question))
    known = saved.groupBy(norm.alias("_k")).agg(F.min(answer).alias(answer))
    return questions.withColumn("_k", norm).join(known, "_k", "left").drop("_k")


def question_ok(question: Column | str) -> Column:
    return F.char_length(F.trim(T.lit_col(question))).between(5, 1000)


def facts_for(questions: DataFrame, question: str, entities: DataFrame, kind: str, stems: dict[str, list[str]]) -> DataFrame:
    """Questions joined with the entities of each group that a token of theirs begins a stem of."""
    pairs = [(k, s) for k, own in stems.items() for s in own]
    groups = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in pairs)), lambda p: F.exists("_t", lambda t: t.startswith(p.s)))
    asked = questions.withColumn("_t", T.tokens(question)).select(question, F.explode(F.array_distinct(F.transform(groups, lambda p: p.k))).alias(kind))
    return asked.join(entities, kind)


def answer_qc(answers: DataFrame, answer: str, valid: str) -> DataFrame:
    """Columns cited, invalid_citations and qc: pass when an answer cites pages and all of them are valid (an array of numbers)."""
    cited = T.cited_pages(answer)
    out = answers.withColumn("cited", cited).withColumn("invalid_citations", F.array_sort(F.array_except("cited", valid)))
    return out.withColumn("qc", F.when((F.size("cited") > 0) & (F.size("invalid_citations") == 0), "pass").otherwise("review"))


def extractive_answer(chunks: DataFrame, question: str, rank: str, evidence: str, content: str, n: int = 2) -> DataFrame:
    """(question, answer): excerpts of the first chunks that have evidence, each with its page; empty when none has."""
    page = F.regexp_extract(F.get(F.col(evidence), F.lit(0)), r"(\d+)$", 1).try_cast("int")
    kept = chunks.where(F.size(evidence) > 0).withColumn("_r", F.row_number().over(W.partitionBy(question).orderBy(rank))).where(F.col("_r") <= n)
    line = F.concat(T.excerpt(content), F.lit(" [стр. "), page.cast("string"), F.lit("]"))
    found = kept.groupBy(question).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("l")))), lambda x: x.l), "\n").alias("answer"))
    return chunks.select(question).distinct().join(found, question, "left").select(question, F.coalesce("answer", F.lit("")).alias("answer"))
