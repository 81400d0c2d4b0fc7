"""Agents over retrieved chunks, answers with checked citations, stage checks and the scheduler of a dependency graph.

Models and services are functions from DataFrame to DataFrame (see ``sources.readers.connector``), so tests pass tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval, status
from .graph import Scratch


def contexts(chunks: DataFrame, agent: str, ident: str, content: str, order: str) -> DataFrame:
    """(agent, context, allowed): each agent's distinct chunks as one numbered text, and the references that occur in them."""
    distinct = chunks.groupBy(agent, ident).agg(F.max_by(content, order).alias("c"), F.min(order).alias("o"))
    n = distinct.withColumn("n", F.row_number().over(W.partitionBy(agent).orderBy("o", ident)))
    part = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]\n"), "c")
    out = n.groupBy(agent).agg(F.array_sort(F.collect_list(F.struct("n", part.alias("t"), T.source_refs("c").alias("r")))).alias("x"))
    allowed = F.array_sort(F.array_distinct(F.flatten(F.transform("x", lambda i: i.r))))
    return out.select(agent, F.array_join(F.transform("x", lambda i: i.t), "\n\n").alias("context"), allowed.alias("allowed"))


def run_agents(asked: DataFrame, agents: DataFrame, retrieve: Callable[[DataFrame], DataFrame], answer: Callable[[DataFrame], DataFrame], agent: str = "agent", saved: DataFrame | None = None, model: str = "") -> DataFrame:
    """(agent, status, reply, n_items, invalid, missing, key, cached): every agent's reply to its chunks, checked against their references.

    ``retrieve`` maps (agent, query) to chunks (agent, id, content, order), ``answer`` maps (agent, context) to (agent, reply).
    Agents without a chunk fail; replies that aren't an object, name a reference that no chunk has, or leave an item without
    evidence go to review. ``key`` is the hash of model, agent and context; agents whose key is in ``saved`` (key, reply; the
    least reply of several) take that reply and aren't asked.
    """
    context = contexts(retrieve(asked), agent, "id", "content", "order")
    context = context.withColumn("key", F.sha2(F.concat_ws("\n", F.lit(model), F.col(agent).cast("string"), "context"), 256))
    if saved is None:
        replies = answer(context.select(agent, "context")).select(agent, "reply", F.lit(False).alias("cached"))
    else:
        known = saved.where("reply is not null").groupBy("key").agg(F.min("reply").alias("reply"))
        replies = answer(context.join(known, "key", "left_anti").select(agent, "context")).select(agent, "reply", F.lit(False).alias("cached"))
        replies = replies.unionByName(context.join(known, "key").select(agent, "reply", F.lit(True).alias("cached")))
    value = replies.select(agent, "reply", "cached", T.json_object("reply").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$.items", "array<struct<evidence: array<string>>>"), F.array().cast("array<struct<evidence: array<string>>>"))
    refs = F.array_distinct(F.flatten(F.transform("items", lambda i: F.coalesce(i.evidence, F.array().cast("array<string>")))))
    joined = agents.select(agent).distinct().join(context.select(agent, "allowed", "key"), agent, "left").join(value.withColumn("items", items), agent, "left")
    out = joined.withColumn("invalid", F.array_sort(F.array_except(refs, F.coalesce("allowed", F.array().cast("array<string>")))))
    bare = F.size(F.filter("items", lambda i: F.coalesce(F.size(i.evidence), F.lit(0)) <= 0))
    verdict = F.when(F.col("allowed").isNull(), "failed").when(F.col("v").isNull() | (F.size("invalid") > 0) | (bare > 0), "review").otherwise("completed")
    return out.select(agent, verdict.alias("status"), "reply", F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), "invalid", bare.alias("missing"), "key", F.coalesce("cached", F.lit(False)).alias("cached"))


def ask(questions: DataFrame, chunks: DataFrame, question: str, answer: Callable[[DataFrame], DataFrame] | None = None, saved: DataFrame | None = None) -> DataFrame:
    """(question, answer, mode, cited, invalid_citations, qc) for each question of proper length.

    chunks: question, rank, evidence (array of page ids), content. Without a model the mode is retrieval_only. An answer with
    citations that no chunk has is asked for once more; if it is still wrong, excerpts with their pages take its place.
    Questions without chunks get an empty answer. ``saved`` holds rows of an earlier call: with a model, a question of the same
    text (blanks at the ends and case aside) that a model answered then takes that row, the least of several, as mode cached.
    """
    asked = questions.where(retrieval.question_ok(question)).select(question).distinct()
    if answer is not None and saved is not None:
        told = F.struct("answer", "cited", "invalid_citations", "qc")
        known = saved.where("mode not in ('no_chunks', 'retrieval_only')").groupBy(F.lower(F.trim(question)).alias("_k")).agg(F.min(told).alias("_a"))
        asked = asked.withColumn("_k", F.lower(F.trim(question)))
        cached = asked.join(known, "_k").select(question, "_a.answer", F.lit("cached").alias("mode"), "_a.cited", "_a.invalid_citations", "_a.qc")
        return ask(asked.join(known, "_k", "left_anti").select(question), chunks, question, answer).unionByName(cached)
    # pages combine as a set before the shuffle; a question whose chunks name none has an empty one
    page = F.regexp_extract("_e", r"(\d+)$", 1).try_cast("int")
    valid = chunks.select(question, F.explode_outer("evidence").alias("_e")).groupBy(question).agg(F.array_sort(F.collect_set(page)).alias("valid"))
    base = asked.join(valid, question, "left")
    extract = retrieval.extractive_answer(chunks, question, "rank", "evidence", "content").withColumnRenamed("answer", "_extract")
    none = F.array().cast("array<int>")
    if answer is None:
        rows = base.join(extract, question, "left").withColumn("answer", F.coalesce("_extract", F.lit(""))).withColumn("mode", F.when(F.col("valid").isNull(), "no_chunks").otherwise("retrieval_only"))
    else:
        ready = base.where("valid is not null")
        good = lambda df: retrieval.answer_qc(df.join(ready, question), "answer", "valid")
        once = good(answer(ready.select(question)))
        wrong = once.where("qc <> 'pass'").select(question)
        twice = good(answer(wrong)).where("qc = 'pass'").select(question, "answer", F.lit("repaired").alias("mode"))
        told = once.where("qc = 'pass'").select(question, "answer", F.lit("model").alias("mode")).unionByName(twice)
        rows = base.join(told, question, "left").join(extract, question, "left")
        rows = rows.withColumn("mode", F.coalesce("mode", F.when(F.col("valid").isNull(), "no_chunks").otherwise("extractive"))).withColumn("answer", F.coalesce("answer", "_extract", F.lit("")))
    out = retrieval.answer_qc(rows.withColumn("valid", F.coalesce("valid", none)), "answer", "valid")
    return out.select(question, "answer", "mode", "cited", "invalid_citations", "qc")


def stage_checks(rows: DataFrame, by: list[str], rules: dict[str, Column]) -> DataFrame:
    """(by, stage, valid): per report and stage whether all its rows meet the stage's rule."""
    agg = rows.groupBy(*by).agg(*(F.bool_and(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))
    return agg.unpivot(by, list(rules), "stage", "valid")


def run_waves(spark: SparkSession, nodes: DataFrame, edges: DataFrame, execute: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """(name, status) after running a dependency graph wave by wave.

    ``execute`` maps the ready nodes (name) to their outcomes (name, status). Nodes whose requirement failed are blocked. The
    state is written down after each wave, so a run can go on from it; the loop has as many rounds as the graph is deep. Nodes that
    ``execute`` gives no outcome count as failed, so every wave ends some.
    """
    state = scratch.table(nodes.select("name", "status"))
    while True:
        verdicts = scratch.table(status.ready(state, edges).where("verdict <> 'waiting'"))
        if verdicts.isEmpty():
            return state
        due = verdicts.where("verdict = 'ready'").select("name")
        told = execute(due).select("name", F.col("status").alias("_s"))
        ended = due.join(told, "name", "left").select("name", F.when(F.col("_s") != "pending", F.col("_s")).otherwise("failed").alias("_s"))
        ended = ended.unionByName(verdicts.where("verdict = 'blocked'").select("name", F.lit("blocked").alias("_s")))
        state = scratch.table(state.join(ended, "name", "left").select("name", F.coalesce("_s", "status").alias("status")))
