"""Archives expanded by the sink: once, whole or not at all, and with a word on each."""

import io
import os
import tarfile
import zipfile

import pytest

from stratum.sources import expand
from stratum.sources.expand import ExpandedSink, ExpandedWriter

SCHEMA = "path string, destination string"


def archive(path, files):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)


def below(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if not os.path.relpath(d, root).startswith((".outcomes", ".partial")))


@pytest.fixture
def box(tmp_path):
    (tmp_path / "in").mkdir()
    root = tmp_path / "out"
    root.mkdir()
    archive(tmp_path / "in/a.zip", {"d/x.txt": b"hi", "отчёт.txt": b"\x00" * 3000})
    (tmp_path / "in/a.zip.policy.json").write_text("{}")
    with tarfile.open(tmp_path / "in/b.tgz", "w:gz") as t:
        m = tarfile.TarInfo("./e/y.bin")
        m.size = 4
        t.addfile(m, io.BytesIO(b"abcd"))
    archive(tmp_path / "in/evil.zip", {"ok.txt": b"1", "../up.txt": b"2"})
    with tarfile.open(tmp_path / "in/link.tar", "w") as t:
        m = tarfile.TarInfo("l")
        m.type, m.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(m)
    (tmp_path / "in/c.7z").write_bytes(b"7z\xbc\xaf")
    good = (tmp_path / "in/a.zip").read_bytes()
    (tmp_path / "in/torn.zip").write_bytes(good[: len(good) // 2])
    return tmp_path / "in", root


def rows(spark, inbox, names):
    return spark.createDataFrame([(f"{inbox}/{n}", d) for n, d in names], SCHEMA)


ALL = [("a.zip", "a"), ("b.tgz", None), ("evil.zip", "evil"), ("link.tar", "link"), ("c.7z", "c"), ("torn.zip", "torn"), ("gone.zip", "gone"), ("a.zip", "../a"), ("a.zip", "r/copy")]


def test_expand_twice(spark, box):
    inbox, root = box
    spark.dataSource.register(ExpandedSink)
    df = rows(spark, inbox, ALL).unionByName(spark.createDataFrame([(None, None)], SCHEMA))
    df.write.format("expanded").mode("append").save(str(root))
    want = sorted(["a/.extracted.json", "a/.upload_policy.json", "a/d/x.txt", "a/отчёт.txt", "b/.extracted.json", "b/e/y.bin", "r/copy/.extracted.json", "r/copy/.upload_policy.json", "r/copy/d/x.txt", "r/copy/отчёт.txt"])
    assert below(root) == want and (root / "b/e/y.bin").read_bytes() == b"abcd"
    told = lambda: {(os.path.basename(r.path), r.destination): (r.status, r.files, r.bytes) for r in expand.outcomes(spark, str(root)).collect()}
    first = told()
    assert first["a.zip", "a"] == first["a.zip", "r/copy"] == ("expanded", 2, 3002) and first["b.tgz", "b"] == ("expanded", 1, 4)
    assert {k[0]: v[0] for k, v in first.items() if v[0] != "expanded"} == {"evil.zip": "refused", "link.tar": "refused", "c.7z": "unsupported", "torn.zip": "unsupported", "gone.zip": "missing", "a.zip": "refused"}
    seen = {p: os.stat(root / p).st_mtime_ns for p in want if "policy" not in p}
    df.write.format("expanded").mode("append").save(str(root))
    assert {p: os.stat(root / p).st_mtime_ns for p in seen} == seen and below(root) == want and told() == first
    assert not os.path.isdir(root / ".partial") or os.listdir(root / ".partial") == []


def test_killed_run_leaves_no_half_archive(spark, box, monkeypatch):
    inbox, root = box
    writer = ExpandedWriter({"path": str(root), "runId": "r1"})
    with monkeypatch.context() as m:  # a process killed before the move doesn't clean up either
        m.setattr(expand.os, "rename", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        m.setattr(expand.shutil, "rmtree", lambda *_, **__: None)
        with pytest.raises(KeyboardInterrupt):
            writer.expand(f"{inbox}/a.zip", "a", None)
    assert below(root) == [] and len(os.listdir(root / ".partial/r1")) == 1
    assert ExpandedWriter({"path": str(root)}).expand(f"{inbox}/a.zip", "a", None)["status"] == "expanded"
    assert expand.sweep(str(root)) == 0 and expand.sweep(str(root), hours=-1) >= 1 and os.path.exists(root / "a/d/x.txt")


def test_space_content_and_races(spark, box):
    inbox, root = box
    small = ExpandedWriter({"path": str(root), "freeBytes": "3302"}).expand(f"{inbox}/a.zip", "a", None)
    assert small["status"] == "refused" and "free space" in small["error"] and below(root) == []
    data = (inbox / "a.zip").read_bytes()
    assert ExpandedWriter({"path": str(root), "freeBytes": "3303"}).expand("hdfs://x/a.zip", "a", data)["files"] == 2
    os.makedirs(root / "taken/other")
    assert "without a marker" in ExpandedWriter({"path": str(root)}).expand(f"{inbox}/a.zip", "taken", None)["error"]
    with pytest.raises(Exception, match="append"):
        spark.dataSource.register(ExpandedSink)
        rows(spark, inbox, ALL[:1]).write.format("expanded").mode("overwrite").save(str(root))


def test_inbox_and_unsupported(spark):
    names = ["a.zip", "A.TAR", "b.tar.gz", "a.zip.policy.json", "x/scan.png", "scan.png", "noext", ".zip", None]
    kinds = expand.inbox(spark.createDataFrame([(n,) for n in names], "p string"), "p")
    assert {r.path: (r.kind, r.destination) for r in kinds.collect()} == {"a.zip": ("archive", "a"), "A.TAR": ("archive", "A"), "b.tar.gz": ("archive", "b.tar"), "a.zip.policy.json": ("policy", None), "x/scan.png": ("container", None), "scan.png": ("unsupported", None), "noext": ("unsupported", None), ".zip": ("archive", ".zip")}
    told = spark.createDataFrame([("a.zip", "a", "expanded", 1, 1, None), ("A.TAR", "A", "refused", 0, 0, "ValueError: x")], expand.OUTCOME)
    assert {tuple(r) for r in expand.unsupported(kinds, told).collect()} == {("scan.png", None), ("noext", None), ("A.TAR", "ValueError: x")}
