"""Calls to outside services: errors become rows, and a stage fails where a page of its queue has no result."""

import pandas as pd

from stratum.sources import readers


def test_errors_are_rows(spark):
    rows = spark.createDataFrame([("r", f"p{i}", i) for i in range(20)], "report string, page string, n int").repartition(3)

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch.n % 7 == 3).any():
            raise ValueError(f"page {batch.n.iloc[0]} is unreadable" if len(batch) == 1 else "bad batch")
        return batch.assign(text=batch.n.astype(str))[["text", "page", "report"]]

    out = readers.captured_calls(rows, call, "report string, page string, text string", "page", waits=(0.01,))
    got = {r.page: r for r in out.collect()}
    assert len(got) == 20
    for i in range(20):
        r = got[f"p{i}"]
        assert (r.text, r.error) == ((None, f"ValueError: page {i} is unreadable") if i % 7 == 3 else (str(i), None))
    assert readers.captured_calls(rows.limit(0), call, "report string, page string, text string", "page").count() == 0


def test_stage_verdict(spark):
    queue = spark.createDataFrame([(r, p) for r in "abc" for p in ("1", "2", "3")] + [("a", "1")], "report string, page string")
    results = spark.createDataFrame([("a", "1", None), ("a", "2", None), ("a", "3", None), ("b", "1", None), ("b", "2", "x"), ("b", "3", "E"), ("b", "3", None), ("c", "1", None), ("d", "9", "not queued")], "report string, page string, error string")
    got = {r.report: tuple(r)[1:] for r in readers.stage_verdict(results, queue, ["report"], "page").collect()}
    assert got == {"a": (3, 3, 0, 0, None, "completed"), "b": (3, 2, 1, 0, "x", "failed"), "c": (3, 1, 0, 2, None, "failed")}


def test_tolerant_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"report_id": "r",\n "pages": 3}')
    (tmp_path / "b.json").write_text('{"report_id": ')
    got = sorted((r.report_id or "", r.pages or 0, bool(r._corrupt_record)) for r in readers.tolerant_json(spark, str(tmp_path), "report_id string, pages int").collect())
    assert got == [("", 0, True), ("r", 3, False)]
