"""The pipeline on the smallest tables, stage by stage."""

import re

import corpus_pipeline
from stratum.llm import queries
from stratum.llm.common import Scratch, read

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch, docs = Scratch(spark, "t"), read(spark, SF, "documents")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, SF))
        seen.append(name)
        if name != "packing":
            assert docs.columns == columns
            rows = {r.doc_id: r for r in docs.collect()}
            assert set(rows) <= set(before) and all(r.n_chars == len(r.text) for r in rows.values())
    assert seen == ["toxicity", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    texts = [r.text for r in rows.values() if r.text]
    assert len(set(texts)) == len(texts)
    assert not any(re.search(r"@mail\d\.example\.com", t) for t in texts)
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(rows)


def test_registered():
    assert [next(q for q in queries.QUERIES if q.startswith(f"op{n}_")) for n in range(1, 11)]


def test_odd_rows(spark, tmp_path):
    """Null and empty texts, repeated rows, a missing id and clashing columns pass every stage; empty tables too."""
    labels = read(spark, SF, "labels")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    some = [(r.doc_id, r.text) for r in read(spark, SF, "documents").limit(30).collect()]
    rows = [(i, t, len(t), 0.1, "a") for i, t in [*some, some[0], some[0], (10**6, ""), (10**6 + 1, "")]] + [(10**6 + 2, None, None, None, None), (None, "one two three", 13, 0.2, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, toxic_score double, _own string")
    for docs in (df.repartition(3), df.limit(0)):
        scratch = Scratch(spark, "t")
        for name, stage in corpus_pipeline.STAGES:
            last = scratch.table(stage(spark, docs, str(tmp_path)))
            if name != "packing":
                assert last.columns == df.columns
                docs = last
        kept = {r.doc_id: r.text for r in docs.collect()}
        if kept:
            assert kept[None] and min(i for i in kept if i is not None and i >= 10**6) == 10**6 and kept[10**6] == ""
            assert last.select("doc_id").distinct().count() == len(kept)


def test_near_copies_are_found(spark):
    """Of pairs with a Jaccard similarity of 0.8 or more over five-word shingles nine in ten meet at least; none below is linked."""
    from stratum.llm import simhash_dedup

    docs = [(r.doc_id, r.text) for r in read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect() if r.text]
    sets = {}
    for i, t in docs:
        w = t.encode().translate(simhash_dedup.LOWER).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    share = {}
    for own in by.values():
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                share[own[a], own[b]] = share.get((own[a], own[b]), 0) + 1
    want = {(a, b) for (a, b), n in share.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8 and dict.fromkeys(sets[a]) != dict.fromkeys(sets[b])}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    comp = {r.doc_id: r.component for r in simhash_dedup.near_duplicates(frame, radius=3, size=5, words=6, check=4, far=48).collect()}
    found = sum(comp[a] == comp[b] for a, b in want)
    assert len(want) > 10 and found >= 0.9 * len(want), (found, len(want))
    groups = {}
    for i, c in comp.items():
        groups.setdefault(c, []).append(i)
    for c, own in groups.items():
        linked = {c}
        for _ in own:
            linked |= {b for a, b in want if a in linked} | {a for a, b in want if b in linked} | {i for i in own if any(sets[i] == sets[j] for j in linked)}
        assert set(own) <= linked
