"""Archives expanded below a folder, as a Spark sink that can be run again: markers, a guard of paths and of space, and an outcome for each archive.

``rows.write.format("expanded").mode("append").save(root)`` after ``spark.dataSource.register(ExpandedSink)``; rows are (path, destination), or
(path, destination, content) where Spark has read the archives from a store that workers can't open. The root is a folder that all
workers mount.
"""

from __future__ import annotations

import gzip
import io
import json
import lzma
import os
import shutil
import tarfile
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Suffixes of archives, and names of the marker and of the policies beside and within.
ARCHIVES = ["zip", "tar", "gz", "tgz", "rar", "7z"]
MARKER, POLICY, POLICY_INSIDE = ".extracted.json", ".policy.json", ".upload_policy.json"
#: Free space must be this multiple of what an archive unpacks to.
MARGIN = 1.1
OUTCOME = "path string, destination string, status string, files bigint, bytes bigint, error string"
DAMAGED = (ValueError, EOFError, RuntimeError, NotImplementedError, zlib.error, lzma.LZMAError, gzip.BadGzipFile, tarfile.TarError, zipfile.BadZipFile)


class Unsupported(ValueError):
    pass


def inside(name: str) -> bool:
    """Whether a member's or a folder's name stays below the folder it is put into."""
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts and ":" not in parts[0] and "\0" not in name


def members(path: str, source) -> Iterator[tuple[str, int, object]]:
    """(name, size, open file) of each file; folders come with size -1. Links and devices are refused."""
    if zipfile.is_zipfile(source):
        with zipfile.ZipFile(source) as z:
            for m in z.infolist():
                if m.is_dir():
                    yield m.filename, -1, None
                else:
                    with z.open(m) as f:
                        yield m.filename, m.file_size, f
        return
    if hasattr(source, "seek"):
        source.seek(0)
    if not tarfile.is_tarfile(source):
        raise Unsupported(f"not a zip or tar file: {os.path.basename(path)}")
    if hasattr(source, "seek"):
        source.seek(0)
    with tarfile.open(fileobj=source) if hasattr(source, "seek") else tarfile.open(source) as t:
        for m in t:
            if m.isdir():
                yield m.name, -1, None
            elif m.isfile():
                yield m.name, m.size, t.extractfile(m)
            else:
                raise ValueError(f"refused archive member {m.name!r}")


def declared(path: str, source) -> int:
    """Bytes that the members say they have, with every name checked first, so that a bad one leaves nothing behind."""
    total = 0
    for name, size, _ in members(path, source):
        if not inside(name) and name.strip("./"):
            raise ValueError(f"refused archive member {name!r}")
        total += max(size, 0)
    return total


def unpack(path: str, source, target: str, free: int) -> tuple[int, int]:
    """(files, bytes) put below a folder. Stops where a member is longer than it says or the space is too small."""
    total = declared(path, source)
    if total * MARGIN > free:
        raise ValueError(f"not enough free space: {total} needed, {free} free")
    files = done = 0
    for name, size, f in members(path, source):
        where = os.path.join(target, *[p for p in name.replace("\\", "/").split("/") if p not in ("", ".")])
        if size < 0:
            os.makedirs(where, exist_ok=True)
            continue
        os.makedirs(os.path.dirname(where), exist_ok=True)
        with open(where, "wb") as out:
            got = 0
            while block := f.read(1 << 20):
                got += len(block)
                if got > size:
                    raise ValueError(f"member {name!r} is longer than it says")
                out.write(block)
        files, done = files + 1, done + got
    return files, done


@dataclass
class Told(WriterCommitMessage):
    part: str | None


class ExpandedSink(DataSource):
    """Options: path (the root), freeBytes (else what the disk has), runId (else random)."""

    @classmethod
    def name(cls) -> str:
        return "expanded"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("expanded folders are only added to: use mode append")
        return ExpandedWriter(dict(self.options))


class ExpandedWriter(DataSourceWriter):
    """Each archive is unpacked into a folder of its attempt below .partial, gets its marker there and is moved into place in one step.

    So a folder is whole or absent, whatever is killed, and attempts that race can't mix: the second finds the marker and drops its own.
    """

    def __init__(self, options: dict) -> None:
        self.root = options["path"].removeprefix("file://").replace("file:", "", 1)
        self.free = options.get("freebytes", options.get("freeBytes"))
        self.run = options.get("runid", options.get("runId")) or uuid.uuid4().hex

    def expand(self, path: str, destination: str | None, content: bytes | None) -> dict:
        plain = path.removeprefix("file://").replace("file:", "", 1)
        destination = destination or os.path.splitext(os.path.basename(plain))[0]
        out = {"path": path, "destination": destination, "status": "expanded", "files": 0, "bytes": 0, "error": None}
        final, staged = os.path.join(self.root, destination), os.path.join(self.root, ".partial", self.run, uuid.uuid4().hex)
        policy = plain + POLICY
        try:
            if not inside(destination) or destination.startswith("."):
                raise ValueError(f"refused destination {destination!r}")
            if not os.path.exists(os.path.join(final, MARKER)):
                os.makedirs(staged)
                free = int(self.free) if self.free is not None else shutil.disk_usage(self.root).free
                source = plain if content is None else io.BytesIO(content)
                out["files"], out["bytes"] = unpack(plain, source, staged, free)
                size = os.path.getsize(plain) if content is None else len(content)
                with open(os.path.join(staged, MARKER), "w", encoding="utf-8") as f:
                    json.dump({"archive": path, "size": size, "extracted_at": datetime.now(UTC).isoformat()}, f, ensure_ascii=False)
                os.makedirs(os.path.dirname(final), exist_ok=True)
                try:
                    os.rename(staged, final)
                except OSError:
                    if not os.path.exists(os.path.join(final, MARKER)):
                        raise ValueError(f"folder without a marker in the way: {destination!r}") from None
                    out |= {"status": "known", "files": 0, "bytes": 0}
            else:
                out["status"] = "known"
            if content is None and os.path.exists(policy):
                shutil.copyfile(policy, os.path.join(final, POLICY_INSIDE))
        except Unsupported as e:
            out |= {"status": "unsupported", "error": str(e)}
        except DAMAGED as e:
            out |= {"status": "refused", "files": 0, "bytes": 0, "error": f"{type(e).__name__}: {e}"}
        except FileNotFoundError as e:
            if os.path.exists(plain) or content is not None:
                raise
            out |= {"status": "missing", "files": 0, "bytes": 0, "error": f"{type(e).__name__}: {plain}"}
        finally:
            shutil.rmtree(staged, ignore_errors=True)
        return out

    def write(self, iterator) -> Told:
        part, told = os.path.join(self.root, ".outcomes", self.run, f"{uuid.uuid4().hex}.json"), None
        for row in iterator:
            if row["path"] is None:
                continue
            if told is None:
                os.makedirs(os.path.dirname(part), exist_ok=True)
                told = open(part + ".tmp", "w", encoding="utf-8")  # noqa: SIM115
            got = row.asDict()
            told.write(json.dumps(self.expand(got["path"], got.get("destination"), got.get("content")), ensure_ascii=False) + "\n")
        if told is None:
            return Told(None)
        told.close()
        return Told(part)

    def commit(self, messages) -> None:
        for m in messages:
            if m is not None and m.part:
                os.replace(m.part + ".tmp", m.part)
        self._drop()

    def abort(self, messages) -> None:
        """Folders in place stay, as they are whole; the rest of the run goes."""
        self._drop()
        shutil.rmtree(os.path.join(self.root, ".outcomes", self.run), ignore_errors=True)

    def _drop(self) -> None:
        shutil.rmtree(os.path.join(self.root, ".partial", self.run), ignore_errors=True)


def sweep(root: str, hours: float = 24) -> int:
    """Removes what killed runs left below .partial, if nothing was put there for some hours; returns how many runs went."""
    base, gone = os.path.join(root, ".partial"), 0
    for run in os.listdir(base) if os.path.isdir(base) else []:
        where = os.path.join(base, run)
        if time.time() - max(os.path.getmtime(d) for d, _, _ in os.walk(where)) > hours * 3600:
            shutil.rmtree(where, ignore_errors=True)
            gone += 1
    return gone


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    """(path, destination, status, files, bytes, error): of each archive and destination the best word of all runs, expanded before known before the rest."""
    where = os.path.join(root, ".outcomes")
    if not os.path.isdir(where):
        return spark.createDataFrame([], OUTCOME)
    rows = spark.read.schema(OUTCOME).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(where)
    rank = F.when(F.col("status") == "expanded", 0).when(F.col("status") == "known", 1).otherwise(2)
    best = rows.groupBy("path", "destination").agg(F.min_by(F.struct("status", "files", "bytes", "error"), F.struct(rank, "status", "error")).alias("r"))
    return best.select("path", "destination", "r.*")


def inbox_kind(path: str) -> Column:
    """container, policy, archive or unsupported, by a path relative to the inbox: files in folders belong to their container."""
    name, suffix = F.lower(F.col(path)), F.regexp_extract(F.lower(F.col(path)), r"\.([^./]+)$", 1)
    return F.when(F.instr(path, "/") > 0, "container").when(F.endswith(name, F.lit(POLICY)), "policy").when(suffix.isin(ARCHIVES), "archive").otherwise("unsupported")


def inbox(files: DataFrame, path: str) -> DataFrame:
    """(path, kind, destination): archives go to the folder of their name without its last suffix; the others have none. Null paths are left out."""
    rows = files.where(F.col(path).isNotNull()).select(F.col(path).alias("path"))
    kinds = rows.withColumn("kind", inbox_kind("path"))
    return kinds.withColumn("destination", F.when(F.col("kind") == "archive", F.regexp_replace("path", r"(?<=.)\.[^.]*$", "")))


def unsupported(kinds: DataFrame, told: DataFrame) -> DataFrame:
    """(path, error): files of no known kind, without an error, and archives that couldn't be expanded, with theirs."""
    files = kinds.where("kind = 'unsupported'").select("path", F.lit(None).cast("string").alias("error"))
    failed = told.where("status not in ('expanded', 'known')").select("path", "error")
    return files.unionByName(failed).groupBy("path").agg(F.max("error").alias("error"))
