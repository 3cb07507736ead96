"""The list of live parts: one JSON file for each version, published by a rename that fails if the version exists.

Version 0 is published when a table is created, so a root without any version isn't an empty table but a lost one. The rename
is atomic on HDFS and local file systems; on a store without such a rename a table may have one writer only.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..schema import FORMAT


class Conflict(RuntimeError):
    """Another writer has published this version."""


class Missing(RuntimeError):
    """There is no table at this root: it was never created, or its folder is lost or out of reach."""


def unreachable(why: BaseException) -> bool:
    """Whether an error says that files are gone or out of reach, and not that they or a query are wrong."""
    if isinstance(why, Missing):
        return True
    text = str(why)
    return isinstance(why, Py4JJavaError | OSError) and any(x in text for x in ("java.io.IOException", "java.io.FileNotFoundException", "java.net.", "AccessControlException", "PATH_NOT_FOUND", "FAILED_READ_FILE.FILE_NOT_EXIST"))


class Files:
    """The few file operations that a table needs, on whatever file system Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)
        self.jvm, self.gateway = jvm, spark.sparkContext._gateway

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(path))) if self.exists(path) else []

    def ages(self, path: str) -> list[tuple[str, int]]:
        """(name, milliseconds since the epoch of its last change) of what a folder holds."""
        return sorted((s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(self.path(path))) if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Writes a new file as a whole, or raises Conflict if it exists."""
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(temporary), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(path).toUri(), self.conf).rename(self.path(temporary), self.path(path), none)
        except Py4JJavaError as why:
            self.fs.delete(self.path(temporary), False)
            if "FileAlreadyExists" in str(why.java_exception):
                raise Conflict(path) from why
            raise

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def bytes(self, path: str) -> int:
        return self.fs.getContentSummary(self.path(path)).getLength() if self.exists(path) else 0


@dataclass(frozen=True)
class Part:
    """One day of one shard of one flush or merge."""

    name: str
    day: int
    rows: int
    blocks: int
    min_ts: int
    max_ts: int
    indexed: bool
    logical_bytes: int = 0
    shard: int = 0
    tokens: bool = True

    @property
    def at(self) -> str:
        return f"part={self.name}/day={self.day}/shard={self.shard}"


@dataclass(frozen=True)
class Manifest:
    """columns: fields that are stored as columns of their own; gone: (place, milliseconds) of parts that left and may still be read."""

    version: int = 0
    parts: tuple[Part, ...] = field(default=())
    shards: int = 1
    columns: tuple[str, ...] = ()
    gone: tuple[tuple[str, int], ...] = ()

    @staticmethod
    def versions(files: Files, root: str) -> list[int]:
        return [int(n[1:-5]) for n in files.names(f"{root}/manifest") if n.startswith("v") and n.endswith(".json")]

    @staticmethod
    def load(files: Files, root: str) -> Manifest:
        versions = Manifest.versions(files, root)
        if not versions:
            raise Missing(f"no table at {root}")
        x = json.loads(files.read(f"{root}/manifest/v{max(versions):012d}.json"))
        if x["format"] != FORMAT:
            raise ValueError(f"format {x['format']} of this table isn't {FORMAT}")
        return Manifest(max(versions), tuple(Part(**p) for p in x["parts"]), x["shards"], tuple(x["columns"]), tuple((p, t) for p, t in x["gone"]))

    def save(self, files: Files, root: str, parts: list[Part], gone: list[tuple[str, int]] = (), version: int | None = None) -> Manifest:
        new = Manifest(self.version + 1 if version is None else version, tuple(sorted(parts, key=lambda p: (p.day, p.shard, p.name))), self.shards, self.columns, tuple(gone))
        text = {"format": FORMAT, "shards": new.shards, "columns": list(new.columns), "gone": [list(g) for g in new.gone], "parts": [p.__dict__ for p in new.parts]}
        files.publish(f"{root}/manifest/v{new.version:012d}.json", json.dumps(text))
        return new
