"""Manifests: small, versioned lists of immutable runs, committed by a step that fails if the version exists.

All file access goes through Hadoop's file system API, so a store can be wherever Spark can write.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import os
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import SparkSession


class Files:
    """The few file operations a store needs, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self._path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def mkdirs(self, path: str) -> None:
        self.fs.mkdirs(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path))) if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_once(self, path: str, text: str) -> None:
        """Creates the file with its whole content, or fails if it exists.

        The deciding step is one that the file system does at once: a hard link on local disks, where a rename replaces its target;
        a rename on HDFS, which refuses to; elsewhere (object stores) a file that is made visible by its close and only where there is
        none, which is as safe as the store's conditional writes."""
        scheme = self.fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs"):
            try:
                return self._create(path, text)
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    raise FileExistsError(path) from e
                raise
        temp = f"{path}.{uuid.uuid4().hex}.tmp"
        self._create(temp, text)
        try:
            if scheme == "file":
                os.link(self._path(temp).toUri().getPath(), self._path(path).toUri().getPath())
            elif self.exists(path) or not self.fs.rename(self._path(temp), self._path(path)):
                raise FileExistsError(path)
        finally:
            self.delete(temp)

    def _create(self, path: str, text: str) -> None:
        stream = self.fs.create(self._path(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def age(self, path: str) -> float:
        """Seconds since a file or folder was changed."""
        return time.time() - self.fs.getFileStatus(self._path(path)).getModificationTime() / 1000

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


@dataclass(frozen=True)
class Run:
    """What is known of a sorted run without reading it."""

    path: str
    entry_count: int
    tombstone_count: int
    size: int
    key_min: object
    key_max: object
    lt_min: int
    lt_max: int
    level: int = -1  # -1: flushed and not yet compacted


def _plain(v):
    if isinstance(v, (bytes, bytearray)):
        return {"bytes": base64.b64encode(bytes(v)).decode()}
    if isinstance(v, datetime.datetime):
        return {"datetime": v.isoformat()}
    if isinstance(v, datetime.date):
        return {"date": v.isoformat()}
    if isinstance(v, decimal.Decimal):
        return {"decimal": str(v)}
    return v


def _rich(v):
    if isinstance(v, dict):
        (kind, x), = v.items()
        return {"bytes": base64.b64decode, "datetime": datetime.datetime.fromisoformat, "date": datetime.date.fromisoformat, "decimal": decimal.Decimal}[kind](x)
    return v


@dataclass(frozen=True)
class Manifest:
    schema: str
    strategy: dict
    version: int = 0
    logical_time: int = 0
    runs: tuple[Run, ...] = ()
    applied: dict = field(default_factory=dict)  # last batch id of each stream that writes here

    FOLDER = "_manifests"

    def with_runs(self, runs, **kw) -> Manifest:
        return replace(self, runs=tuple(runs), version=self.version + 1, **kw)

    def commit(self, files: Files) -> Manifest:
        d = asdict(self)
        for r in d["runs"]:
            r["key_min"], r["key_max"] = _plain(r["key_min"]), _plain(r["key_max"])
        files.mkdirs(files.at(self.FOLDER))
        files.write_once(files.at(f"{self.FOLDER}/{self.version:012d}.json"), json.dumps(d))
        return self

    @classmethod
    def versions(cls, files: Files) -> list[str]:
        return [n for n in files.names(files.at(cls.FOLDER)) if n.endswith(".json")]

    @classmethod
    def load(cls, files: Files, name: str | None = None) -> Manifest:
        """The newest version, or the named one."""
        names = [name] if name else cls.versions(files)
        if not names:
            raise FileNotFoundError(f"no store at {files.root}")
        d = json.loads(files.read(files.at(f"{cls.FOLDER}/{names[-1]}")))
        runs = tuple(Run(**{**r, "key_min": _rich(r["key_min"]), "key_max": _rich(r["key_max"])}) for r in d.pop("runs"))
        return cls(**d, runs=runs)
