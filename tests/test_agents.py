"""Agents, answers and the scheduler with tables in place of services."""

from pyspark.sql import functions as F

from stratum.operators import agents
from stratum.operators.graph import Scratch
from stratum.plans.pages import EDGES


def test_run_agents(spark):
    names = spark.createDataFrame([("wells",), ("maps",), ("bad",), ("none",)], "agent string")
    chunks = [("wells", "a", "[SOURCE_PAGE: page:00001] x", 1), ("wells", "a", "[SOURCE_PAGE: page:00001] y", 2), ("maps", "b", "[SOURCE_PAGE: page:00002]", 1), ("bad", "c", "[SOURCE_PAGE: page:00003]", 1)]
    replies = {"wells": '```json\n{"items": [{"evidence": ["page:00001"]}]}```', "maps": '{"items": [{"evidence": ["page:00009"]}, {"name": "n"}]}', "bad": "sorry"}
    out = agents.run_agents(names, names, lambda q: spark.createDataFrame(chunks, "agent string, id string, content string, order int"), lambda c: c.select("agent", F.element_at(F.create_map(*(F.lit(x) for kv in replies.items() for x in kv)), F.col("agent")).alias("reply")))
    got = {r.agent: (r.status, r.n_items, r.invalid, r.missing) for r in out.collect()}
    assert got["wells"][:3] == ("completed", 1, []) and got["maps"] == ("review", 2, ["page:00009"], 1) and got["bad"][0] == "review" and got["none"][0] == "failed"


def test_contexts_number_distinct_chunks(spark):
    rows = [("w", "a", "old", 1), ("w", "b", "B", 2), ("w", "a", "new", 3)]
    r = agents.contexts(spark.createDataFrame(rows, "agent string, id string, content string, o int"), "agent", "id", "content", "o").first()
    assert r.context == "[1]\nnew\n\n[2]\nB"


def test_ask(spark):
    q = spark.createDataFrame([("good question",), ("wrong once",), ("always wrong",), ("nothing found",), ("hi",)], "question string")
    chunks = spark.createDataFrame([(x, 1, ["text:00007"], "some\ncontent") for x in ("good question", "wrong once", "always wrong")] + [("good question", 2, [], "no page")], "question string, rank int, evidence array<string>, content string")
    calls = []

    def model(asked):
        calls.append(1)
        first = len(calls) == 1
        return asked.withColumn("answer", F.when((F.col("question") == "good question") | ((F.col("question") == "wrong once") & F.lit(not first)), "yes [стр. 7]").otherwise("no [стр. 8]"))

    got = {r.question: (r.mode, r.answer, r.qc) for r in agents.ask(q, chunks, "question", model).collect()}
    assert got == {"good question": ("model", "yes [стр. 7]", "pass"), "wrong once": ("repaired", "yes [стр. 7]", "pass"), "always wrong": ("extractive", "some content [стр. 7]", "pass"), "nothing found": ("no_chunks", "", "review")}
    assert {r.mode for r in agents.ask(q, chunks, "question").collect()} == {"retrieval_only", "no_chunks"}


def test_waves(spark):
    names = sorted({n for c, p, _ in EDGES for n in (c, p)})
    nodes = spark.createDataFrame([(n, "pending") for n in names], "name string, status string")
    edges = spark.createDataFrame(EDGES, "child string, parent string, kind string")
    run = lambda ready: ready.withColumn("status", F.when(F.col("name") == "map", "failed").otherwise("completed"))
    got = {r.name: r.status for r in agents.run_waves(spark, nodes, edges, run, Scratch(spark, "t")).collect()}
    assert got == {n: "failed" if n == "map" else "completed" for n in names}
    run = lambda ready: ready.withColumn("status", F.when(F.col("name") == "ocr", "failed").otherwise("completed"))
    got = {r.name: r.status for r in agents.run_waves(spark, nodes, edges, run, Scratch(spark, "t")).collect()}
    assert [n for n in names if got[n] == "blocked"] == ["bundle", "export", "markdown", "qc", "rag"]


def test_stage_checks(spark):
    rows = spark.createDataFrame([("r1", 1, None), ("r1", 1, "x"), ("r2", 0, "y")], "r string, a int, b string")
    got = {(x.r, x.stage): x.valid for x in agents.stage_checks(rows, ["r"], {"routing": F.col("a") == 1, "ocr": F.col("b").isNotNull()}).collect()}
    assert got == {("r1", "routing"): True, ("r1", "ocr"): False, ("r2", "routing"): False, ("r2", "ocr"): True}


def test_saved_replies(spark):
    q = spark.createDataFrame([(" Good question",), ("new question",)], "question string")
    chunks = spark.createDataFrame([(x, 1, ["text:00007"], "c") for x in (" Good question", "new question")], "question string, rank int, evidence array<string>, content string")
    asked = []

    def model(rows):
        asked.append({r[0] for r in rows.collect()})
        return rows.withColumn("answer", F.lit("yes [стр. 7]"))

    saved = spark.createDataFrame([("good question", "old [стр. 7]", "model", [7], [], "pass"), ("new question", "excerpt", "retrieval_only", [], [], "review")], "question string, answer string, mode string, cited array<int>, invalid_citations array<int>, qc string")
    got = {r.question: (r.mode, r.answer, r.qc) for r in agents.ask(q, chunks, "question", model, saved).collect()}
    assert got == {" Good question": ("cached", "old [стр. 7]", "pass"), "new question": ("model", "yes [стр. 7]", "pass")} and asked[0] == {"new question"}

    names = spark.createDataFrame([("a",), ("b",)], "agent string")
    pages = spark.createDataFrame([(n, "i", "[SOURCE_PAGE: page:00001] " + n, 1) for n in "ab"], "agent string, id string, content string, order int")
    reply = '{"items": [{"evidence": ["page:00001"]}]}'
    first = agents.run_agents(names.where("agent = 'a'"), names, lambda _: pages.where("agent = 'a'"), lambda c: c.select("agent", F.lit(reply).alias("reply")), model="m").where("status = 'completed'")
    again = {r.agent: (r.status, r.reply, r.cached) for r in agents.run_agents(names, names, lambda _: pages, lambda c: c.select("agent", F.lit("no").alias("reply")), saved=first.select("key", "reply"), model="m").collect()}
    assert again == {"a": ("completed", reply, True), "b": ("review", "no", False)}
