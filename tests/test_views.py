"""Greedy pairs, crossing lines, skeleton chains, long texts and stage rules against brute force."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from stratum.functions import text as T
from stratum.operators import chunking, lines, status, views
from stratum.operators.graph import Scratch


def test_disjoint_pairs(spark):
    rng = random.Random(1)
    pairs = list({(rng.randrange(40), rng.randrange(40), rng.randrange(12)) for _ in range(200)})
    got = views.disjoint_pairs(spark.createDataFrame(pairs, "a long, b long, s long"), "a", "b", "s", Scratch(spark, "t")).collect()
    used, want = set(), []
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a != b and not {a, b} & used:
            used |= {a, b}
            want.append((a, b, s))
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_prune_crossings(spark):
    rng = random.Random(2)
    rows = [(i, rng.random() < 0.8, rng.random() < 0.3, rng.choice([None, 0.0, 0.1, 0.2]), rng.choice([None, 0.1]), rng.random()) for i in range(30)]
    pairs = [(a, b) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.12]
    got = lines.prune_crossings(spark.createDataFrame(rows, "k long, accepted boolean, direct_label boolean, residual double, spread double, coverage double"), spark.createDataFrame(pairs, "first long, second long"), "k", Scratch(spark, "t")).collect()
    weak = {i: (not d, (r or 1.0) + (s or 1.0), -c, i) for i, _, d, r, s, c in rows}
    live = {i for i, a, *_ in rows if a}
    for i in sorted(live, key=weak.get):  # from the strongest on, what stays removes all weaker ones that it crosses
        if i in live:
            live -= {j for p in pairs if i in p for j in p if j != i and weak[j] > weak[i]}
    assert {r.k for r in got if r.accepted} == live
    assert all((r.rejection_reason is not None) == (next(a for i, a, *_ in rows if i == r.k) and r.k not in live) for r in got)


def test_stitch(spark):
    ends = [("m", 1, "stop", 0.0, 0.0, 1.0, 0.0), ("m", 2, "start", 5.0, 0.0, -1.0, 0.0), ("m", 2, "stop", 10.0, 0.0, 1.0, 0.0), ("m", 3, "start", 50.0, 0.5, -1.0, 0.0), ("m", 4, "start", 12.0, 30.0, 0.0, 1.0), ("n", 5, "start", 5.0, 0.0, -1.0, 0.0)]
    got = lines.stitch(spark.createDataFrame(ends, "map string, line long, end string, x double, y double, dx double, dy double"), "map", "line", Scratch(spark, "t")).collect()
    assert {r.line: r.whole for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_long_texts(spark):
    """A million characters: no pattern recurses, and lines and parts are numbered in linear time."""
    begun = time.time()
    texts = ["1." * 400_000, "ОТ" * 400_000, "О." * 300_000 + "1", "\n".join(f"line {i // 2}" for i in range(60_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    fixed = {r.k: r.o for r in df.select("k", T.numeric_ocr("t").alias("o")).collect()}
    assert fixed[0] == texts[0] and fixed[1] == texts[1] and fixed[2] == "0." * 300_000 + "1"
    kept = df.where("k = 3").select("k", chunking.without_repeats(chunking.lines("t")).alias("l"))
    assert kept.select(F.size("l")).first()[0] == 30_000
    parts = [r.n_lines for r in chunking.parts(kept, "l", 1000, ["k"]).orderBy("part").collect()]
    want, used = [], 2000
    for i in range(30_000):
        n = len(f"line {i}") + 1
        if used + n > 1000:
            want.append(0)
            used = 0
        used += n
        want[-1] += 1
    assert parts == want and time.time() - begun < 90


GLYPHS, JOINTS = "0123456789ІIОоOoТт", ".,:/-"


def plainly_fixed(text):
    """Run by run: all glyphs up to the last digit, and those that follow it with single joints at most in between."""
    out = list(text)
    for run in re.finditer(f"[{re.escape(GLYPHS + JOINTS)}]+", text):
        last = max((i for i in range(*run.span()) if text[i].isdigit()), default=None)
        i = run.start() if last is not None else run.end()
        while i < run.end():
            if text[i] in GLYPHS:
                out[i] = {"І": "1", "I": "1", "Т": "1", "т": "1", "О": "0", "о": "0", "O": "0", "o": "0"}.get(text[i], text[i])
            elif i > last and (i + 1 >= run.end() or text[i + 1] not in GLYPHS):
                break
            i += 1
    return "".join(out)


def test_numeric_runs(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("0О1ІоТт.,-/ xOI") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    got = [r.o for r in spark.createDataFrame(list(enumerate(texts)), "k long, t string").orderBy("k").select(T.numeric_ocr("t").alias("o")).collect()]
    assert got == [plainly_fixed(t) for t in texts]


def test_natural_order_of_long_numbers(spark):
    names = ["p" + "9" * 30, "p1" + "0" * 30, "p007", "p7a", "p10", "P2"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.natural_key("n").alias("k")).orderBy("k", "n").collect()
    assert [r.n for r in rows] == ["P2", "p007", "p7a", "p10", "p" + "9" * 30, "p1" + "0" * 30]


def test_unknown_stages_fail(spark):
    df = spark.createDataFrame([(["ocr", "x"],)], "f array<string>")
    assert df.select(views.unknown_stages("f", ["ocr"]).alias("u")).first().u == ["x"]
    with pytest.raises(Exception, match="unknown stages: x"):
        df.select(views.unknown_stages("f", ["ocr"], fail=True)).collect()


def test_zero_filled_by_group(spark):
    rows, domain = spark.createDataFrame([("a", "x"), ("b", "y")], "g string, s string"), spark.createDataFrame([(f"s{i}",) for i in range(1500)] + [("x",)], "s string")
    assert status.zero_filled(rows, domain, "s", ["g"]).count() == 2 * 1501


def test_npz_round_trip(spark, tmp_path):
    from stratum.sources import readers, writers

    cells = [(m, r, c, c * 2.0, r * 3.0, None if (r + c) % 4 == 0 else r + c + m / 10) for m in (1, 2) for r in range(5) for c in range(3 + m)]
    for row in writers.npz_files(spark.createDataFrame(cells, "map long, row long, col long, x double, y double, z double"), "map").collect():
        (tmp_path / f"{row['map']}.npz").write_bytes(row["content"])
    back = readers.npz_grids(spark, str(tmp_path)).collect()
    assert sorted((int(r.path[-5]), *r[1:]) for r in back) == sorted(cells, key=lambda t: t[:3])


def test_pages_go_on_after_a_stop(spark, tmp_path):
    from stratum.streaming import inbox

    for i in range(3):
        spark.createDataFrame([(i, "p")], "page long, t string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []

    def work(rows):
        seen.append([r.page for r in rows.collect()])
        if len(seen) == 2:
            raise RuntimeError("stopped")
        return rows.withColumn("done", F.lit(True))

    run = lambda: inbox.run_pages(inbox.changes(spark, str(tmp_path / "in"), "page long, t string", files=1), work, str(tmp_path / "out"), str(tmp_path / "ck"))
    with pytest.raises(Exception, match="stopped"):
        run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    run()
    assert sorted(r.page for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2] and all(len(s) == 1 for s in seen) and len(seen) == 4
