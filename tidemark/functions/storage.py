"""Files in the folder that all executors share, reached through Hadoop's file system API."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if its stored files are at most this large and hold at most so many rows.
BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 250_000
#: Copies made of the smaller side, and parts of each key of the larger, when it is larger than that: an eighth of the shuffle partitions between these.
LEAST_SALTS, MOST_SALTS = 16, 256


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(_forget, root.removeprefix("file://"))
    return root.rstrip("/")


def _forget(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


_WORKSPACES: list[str] = []


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder of one run's own in the shared folder. A query's result reads it, so it stays until ``release``."""
    path = f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _WORKSPACES.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the workspaces of all queries of this process so far; their results can be read no more."""
    fs = Storage(spark)
    while _WORKSPACES:
        fs.delete(_WORKSPACES.pop())


class Storage:
    """The few file operations that the commit protocols need."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str) -> tuple[Any, Any]:
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """Names of what a folder holds, sorted; none if it doesn't exist."""
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def make_folder(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def move(self, source: str, target: str) -> None:
        """Rename a folder; nothing happens if it has been."""
        fs, p = self._at(source)
        if fs.exists(p) and not fs.rename(p, self._at(target)[1]):
            raise OSError(f"cannot move {source} to {target}")

    def create(self, path: str, value: dict) -> bool:
        """Write a JSON file whole or not at all. False if there is one already, which stays as it was.

        On HDFS and local disks a draft is renamed, which one writer wins. Object stores have no such rename; there the file is put under the
        condition that it does not exist, which Azure's and Google's connectors do by themselves and S3A from Hadoop 3.4.2 on by the option set here.
        Of an older S3A only one writer a table may be used.
        """
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        text = bytearray(json.dumps(value, sort_keys=True).encode())
        if fs.getUri().getScheme() not in ("file", "hdfs", "viewfs"):
            try:
                out = fs.createFile(p).recursive().overwrite(False).opt("fs.option.create.conditional.overwrite", True).build()
                out.write(text)
                out.close()
            except Py4JJavaError as e:
                if fs.exists(p):
                    return False
                raise OSError(f"cannot create {path}") from e
            return True
        _, draft = self._at(f"{path}.{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        out.write(text)
        out.close()
        if fs.exists(p) or not fs.rename(draft, p):
            fs.delete(draft, False)
            return False
        return True

    def load(self, path: str) -> dict:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it again: lineage ends in files that outlive executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(left: DataFrame, right: DataFrame, path: str, on: list[str], spread: list[str], how: str = "left") -> DataFrame:
    """Join the large ``left`` with a lookup table whose keys ``on`` are unique.

    ``right`` is first stored at ``path`` and its size read from the files. Up to BROADCAST_BYTES and BROADCAST_ROWS it is broadcast; a
    larger one is joined by key and salt, so that a key with a third of all rows of ``left`` is spread over an eighth of all tasks.
    ``spread`` names columns of ``left`` that differ between rows of one key. A column of ``left`` that has the name of one that
    ``right`` brings is replaced by it.
    """
    right = stored(right, path)
    left = left.drop(*[c for c in right.columns if c not in on], "_salt")
    if Storage(left.sparkSession).size(path) <= BROADCAST_BYTES and right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    salts = min(MOST_SALTS, max(LEAST_SALTS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")


class Conflict(RuntimeError):
    """Another writer committed the version that this one was about to commit."""


class Versions:
    """A table of buckets under ``path``: each version is a manifest, created whole and never replaced, that names the files of every bucket."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.fs = spark, path.rstrip("/"), Storage(spark)
        if not self.numbers():
            count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self.fs.create(self._manifest(0), {"version": 0, "buckets": count, "files": {}, "batches": []})

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def numbers(self) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in self.fs.names(f"{self.path}/manifests") if x.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of an older version."""
        return self.fs.load(self._manifest(self.numbers()[-1] if version is None else version))

    def commit(self, old: dict, **changed) -> int:
        """A version after ``old``; Conflict if there is one."""
        number = old["version"] + 1
        if not self.fs.create(self._manifest(number), {**old, **changed, "version": number}):
            raise Conflict(f"version {number} of {self.path} is taken")
        return number

    def size(self) -> int:
        """Bytes of the newest version."""
        return sum(self.fs.size(x) for x in self.manifest()["files"].values())

    def vacuum(self, keep: int = 2) -> int:
        """Delete what only versions before the ``keep`` newest name, and what runs left that died before their commit; how many folders. No other writer may be at work."""
        numbers = self.numbers()
        named = {x for n in numbers[-keep:] for x in self.manifest(n)["files"].values()}
        batches = {x.rsplit("/bucket=", 1)[0] for x in named}
        gone = 0
        for batch in [f"{self.path}/data/{x}" for x in self.fs.names(f"{self.path}/data")]:
            if batch not in batches:
                self.fs.delete(batch)
                gone += 1
                continue
            for folder in [f"{batch}/{x}" for x in self.fs.names(batch) if x.startswith("bucket=")]:
                if folder not in named:
                    self.fs.delete(folder)
                    gone += 1
        for n in numbers[:-keep]:
            self.fs.delete(self._manifest(n))
        return gone
