"""Tables and models kept in versions, published as a whole and read by any session.

    folder/data-<uuid>/            what a version holds
    folder/manifest-<number>.json  where it is, of what inputs it was made, when

A writer writes the data first and then renames a finished manifest to the next free number; a rename doesn't replace a file, so
of two writers one takes the number after. One that dies leaves data that no manifest names, and readers keep the version before. A
manifest that can't be read is passed over likewise. Renames are atomic on HDFS and local folders; an object store needs a committer
of its own. The last `keep` versions stay for readers that have begun.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

PREFIX = "manifest-"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; only a local session that has none gets one here."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkrank-"))
        base = spark.sparkContext.getCheckpointDir()
    return base


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the application's process ends."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    store = at.getFileSystem(context._jsc.hadoopConfiguration())
    store.mkdirs(at)  # only what exists can be marked
    store.deleteOnExit(at)
    return f"{at.toString()}/data"


class Folder:
    """Files of a folder, in whatever store it is."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.jvm = spark, path, spark.sparkContext._jvm
        self.store = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        if not self.store.exists(self._at()):
            return []
        return sorted(x.getPath().getName() for x in self.store.listStatus(self._at()))

    def read(self, name: str) -> str:
        stream = self.store.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, content: str) -> bool:
        """Whether the file is there as a whole now; False if the name was taken."""
        draft = f".{name}-{uuid.uuid4().hex}"
        stream = self.store.create(self._at(draft), False)
        stream.write(bytearray(content.encode()))
        stream.close()
        if not self.store.exists(self._at(name)) and self.store.rename(self._at(draft), self._at(name)):
            return True
        self.store.delete(self._at(draft), False)
        return False

    def delete(self, name: str = "") -> None:
        self.store.delete(self._at(name), True)


def fingerprint(*inputs: DataFrame) -> str:
    """Of the files that the inputs read: their paths, lengths and times. No file is opened."""
    context, digest = inputs[0].sparkSession.sparkContext, hashlib.sha256()
    for path in sorted({p for df in inputs for p in df.inputFiles()}):
        at = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(path))
        status = at.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(at)
        digest.update(f"{path}\n{status.getLen()}\n{status.getModificationTime()}\n".encode())
    return digest.hexdigest()


class Versions:
    """The versions of one thing in a folder."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.folder, self.keep, self.clock = spark, Folder(spark, path), keep, clock

    def _numbers(self) -> list[int]:
        return sorted(int(n.removeprefix(PREFIX).removesuffix(".json")) for n in self.folder.names() if n.startswith(PREFIX))

    def manifests(self) -> Iterator[dict]:
        """Manifests that can be read, the newest first."""
        for number in reversed(self._numbers()):
            try:
                found = json.loads(self.folder.read(f"{PREFIX}{number:012d}.json"))
                found["path"] = f"{self.folder.path}/{found['data']}"
            except (ValueError, KeyError, TypeError):
                continue
            yield found | {"number": number}

    def publish(self, write: Callable[[str], None], **entries) -> dict:
        """write(path) fills a new version's data; then its manifest appears, with the entries."""
        data = f"data-{uuid.uuid4().hex}"
        write(f"{self.folder.path}/{data}")
        manifest = entries | {"data": data, "made_at": self.clock()}
        number = (self._numbers() or [0])[-1] + 1
        while not self.folder.write_new(f"{PREFIX}{number:012d}.json", json.dumps(manifest)):
            number += 1
        for old in self._numbers()[: -self.keep]:
            name = f"{PREFIX}{old:012d}.json"
            try:
                self.folder.delete(json.loads(self.folder.read(name))["data"])
            except (ValueError, KeyError, TypeError):
                pass  # its data can't be known; a broken manifest goes alone
            self.folder.delete(name)
        return manifest | {"number": number, "path": f"{self.folder.path}/{data}"}

    def clear(self) -> None:
        self.folder.delete()


class PublishedTable:
    """A table built of inputs, kept until one of them changes or `ttl` seconds have passed."""

    def __init__(self, spark: SparkSession, path: str, ttl: float = 300.0, **options) -> None:
        self.spark, self.ttl, self.versions = spark, ttl, Versions(spark, path, **options)

    def current(self, made_of: str) -> dict | None:
        """The newest version, if it is of these inputs and not too old."""
        found = next(self.versions.manifests(), None)
        fresh = found and found.get("made_of") == made_of and self.versions.clock() - found["made_at"] < self.ttl
        return found if fresh else None

    def read(self, inputs: list[DataFrame], build: Callable[[], DataFrame]) -> DataFrame:
        made_of = fingerprint(*inputs)
        found = self.current(made_of)
        if not found:
            made = build()
            found = self.versions.publish(lambda path: made.write.parquet(path), made_of=made_of, schema=made.schema.json())
        return self.spark.read.parquet(found["path"])

    def refresh(self) -> None:
        """The next read builds anew."""
        self.versions.clear()
